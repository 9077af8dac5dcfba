"""Embedding near-dedup by product quantisation: cosine links of at least a threshold.

Equal vectors are one vector with a count, so a group of copies costs one row.  On at
most ``SAMPLE`` unit vectors (smallest hashes of their ids) a coarse k-means and, on its
residuals, one codebook per subspace are fitted.  Every vector is filed in the inverted list
of its nearest centroid with its residual codes and the error that the codes make; it probes
every list that may hold a vector within the threshold's distance.  A list is passed over only
where that distance is less than the vector's to the ball around the list's centroid that holds all its
members, or to the half space of what is nearer to that centroid than to the vector's own; both lose
nothing, whatever the number of lists.  In a list, the codes are read back and one matrix product a block
gives the distance to each coded vector; a pair is dropped only if that distance less the coding error exceeds the
threshold's distance, which loses nothing either, and the rest is decided by the exact cosine in
double precision.  Of two lists only one probes the other, so a pair meets once and counts for both sides.

Where the vectors are scattered evenly nearly every list may hold a link, so the work stays that of all pairs (one
multiplication and addition in single precision a component); of groups that lie apart only the near ones meet.

Lists share shelves of about ``MOST_MEMBERS`` vectors (more in a large table), which are compared in blocks of bounded
size; a block hands on each vector's number of links and the links of a spanning forest only, never all pairs.
A vector goes to all shelves that it probes, which are the more the larger the table.  So the shelves take turns, in
rounds whose rows are in proportion to the table; the files of a round go before the next begins.

Defined cases: see ``vectors.usable`` for vectors that link with nothing (they get a row of
their own; null ids share one, with a null component); rows with equal ids are one
vector; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import forget, pick, written
from carelake.llm.components import components
from carelake.llm.vectors import blocks, matrix, sample_rows, usable

SAMPLE, LIST_ROWS, MOST_LISTS = 20_000, 256, 4096
SUBSPACES, CODES, ROUNDS = 16, 64, 8
MOST_MEMBERS, MOST_PROBERS = 4096, 4096
#: A side of a block is about a so manieth of all vectors, but at the most so many times the least side.
BLOCKS, WIDEST = 12, 4
#: Rows sent to the blocks at a time: so many bytes, or so many times the vectors; bytes of a row besides its vector.
ROUND_BYTES, ROUND_SHARE, ROW_BYTES = 512 << 20, 1.25, 64
#: Links held before they are counted; rows of the rounds, in times the vectors, before they are summed.
MOST_HITS, MOST_HELD = 2_000_000, 4
#: More than rounding can make of a distance or a cosine here, or of an inner product in single precision.
SLACK, CLOSE, SINGLE = 1e-6, 1e-9, 1e-4


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, centre, 1)[:, 0]
        order = np.argsort(near, kind="stable")
        first = np.r_[0, np.flatnonzero(np.diff(near[order])) + 1]
        centre = centre.copy()
        centre[near[order][first]] = np.add.reduceat(x[order], first) / np.diff(np.r_[first, len(x)])[:, None]
    return centre


def nearest(x: np.ndarray, centre: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each row, nearest first."""
    far = (centre**2).sum(1) - 2 * x @ centre.T
    if n == 1:
        return far.argmin(1)[:, None]
    return np.argsort(far, axis=1, kind="stable")[:, :n]


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to the rows of y."""
    return np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T, 0)


class Quantiser:
    """Coarse centroids and the codebooks of the residuals' subspaces; of bounded size."""

    def __init__(self, sample: np.ndarray, rows: int):
        lists = int(np.clip(rows // LIST_ROWS, 1, min(MOST_LISTS, len(sample))))
        self.centres = k_means(sample, lists, 1)
        self.width = -(-sample.shape[1] // SUBSPACES)
        rest = self.split(sample - self.centres[nearest(sample, self.centres, 1)[:, 0]])
        self.books = [k_means(rest[:, s], CODES, 2 + s) for s in range(SUBSPACES)]

    def split(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), SUBSPACES * self.width))
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), SUBSPACES, self.width)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals and the length of what they miss."""
        rest = self.split(x - self.centres[lists])
        codes = np.stack([nearest(rest[:, s], book, 1)[:, 0] for s, book in enumerate(self.books)], 1)
        return codes.astype(np.uint8), np.sqrt(((rest - self.decoded(codes)) ** 2).sum((1, 2)))

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        """The residuals that the codes stand for, by subspace."""
        return np.stack([book[codes[:, s]] for s, book in enumerate(self.books)], 1)

    def coded(self, codes: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """The vectors that the lists and codes stand for."""
        centres = self.centres[lists]
        return centres + self.decoded(codes).reshape(len(codes), -1)[:, : centres.shape[1]]

    def reached(self, x: np.ndarray, home: np.ndarray, lists: np.ndarray, radius: np.ndarray, reach: float) -> np.ndarray:
        """Whether each row, filed in list ``home``, probes each of the lists.

        No list that holds a vector within ``reach`` is left out, but for the turn: of two lists one probes the other.
        """
        centres, own = self.centres[lists], home[:, None]
        far = squared(x, centres)
        at_home = ((x - self.centres[home]) ** 2).sum(1)[:, None]
        gap = np.sqrt(squared(self.centres[home], centres))
        near = (np.sqrt(far) <= radius[lists] + reach) & (far - at_home <= 2 * reach * gap + SLACK)
        turn = (own == lists) | (((own + lists) % 2 == 0) == (own < lists))
        return near & turn


def forest(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node) with the components of the links a[i]-b[i] between ids left and right."""
    ids, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    p, q = place[: len(left)][a], place[len(left):][b]
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        np.minimum.at(new, p, label[q])
        np.minimum.at(new, q, new[p])
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]


def on_shelves(held: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first lists of the groups that share a shelf of about ``most`` vectors, and each group's shelves: a list of more has several for itself."""
    first, parts, full = [], [], most + 1
    for i, size in enumerate(held.tolist()):
        if full + size > most:
            first.append(i)
            parts.append(max(1, -(-size // most)))
            full = 0
        full += size
    return np.array(first), np.array(parts)


def rounds(size: np.ndarray, most: int) -> list[tuple[int, int]]:
    """The first and last shelf of each round: shelves that follow each other, of ``most`` rows in all, or a single one of more."""
    out, low, full = [], 0, 0
    for i, rows in enumerate(size.tolist()):
        if i > low and full + rows > most:
            out.append((low, i - 1))
            low, full = i, 0
        full += rows
    return [*out, (low, len(size) - 1)]


def summed(tables: list[DataFrame]) -> DataFrame:
    """What the rounds found as one table: a vector's links once, and a spanning forest; ``tables`` go."""
    both = functools.reduce(DataFrame.unionByName, tables)
    links = both.where("links > 0").groupBy("vec_id").agg(F.sum("links").alias("links"))
    found = components(both.where("links = 0").select(F.col("vec_id").alias("a"), F.col("other").alias("b")))
    out = written(links.select("vec_id", "links", F.lit(-1).cast("long").alias("other")).unionByName(
        found.where("node <> component").select(F.col("node").alias("vec_id"), F.lit(0).cast("long").alias("links"), F.col("component").alias("other"))), "met")
    forget(*tables, found)
    return out


def near_vectors(vectors: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector id."""
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, embedding)
    # equal vectors: one class, known by its least id
    classes = written(rows.groupBy("vector").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies")), "classes")
    every = pick(vectors, vec_id=vec_id).select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    n = classes.count()
    if not n:
        forget(rows, classes)
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    several = classes.where("copies > 1").select(F.col("vec_id").alias("class"), "vector")
    copies = written(rows.join(several, "vector").select("vec_id", "class"), "copies")
    forget(rows)

    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.sqrt((x * x).sum(1))[:, None]

    made = spark.sparkContext.broadcast(Quantiser(unit(sample_rows(classes, SAMPLE)), n))

    def file(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        quantiser = made.value
        for f in frames:
            for at in range(0, len(f), 2048):
                part = f.iloc[at: at + 2048]
                x = unit(matrix(part["vector"]))
                lists = nearest(x, quantiser.centres, 1)[:, 0]
                codes, missed = quantiser.encode(x, lists)
                away = np.sqrt(((x - quantiser.centres[lists]) ** 2).sum(1))
                yield part.assign(list=lists, away=away, codes=[c.tobytes() for c in codes], missed=missed)

    filed = written(classes.mapInPandas(file, "vector binary, vec_id long, copies long, list int, away double, "
                                              "codes binary, missed double"), "filed")
    forget(classes)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    # at most MOST_LISTS rows; a list without members is never reached
    radius, held = np.full(len(made.value.centres), -np.inf), np.zeros(len(made.value.centres), int)
    for r in filed.groupBy("list").agg(F.max("away").alias("away"), F.count(F.lit(1)).alias("n")).collect():
        radius[r["list"]], held[r["list"]] = r["away"], r["n"]
    most_members, most_probers = (int(np.clip(n // BLOCKS, most, WIDEST * most)) for most in (MOST_MEMBERS, MOST_PROBERS))
    first, parts = on_shelves(held, most_members)
    # of each list its first shelf and how many it has; of each shelf its lists
    begin = np.cumsum(parts) - parts
    group = np.cumsum(np.isin(np.arange(len(held)), first)) - 1
    group_of_shelf = np.repeat(np.arange(len(parts)), parts)

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        quantiser, lists = made.value, np.arange(len(radius))
        for f in frames:
            for at in range(0, len(f), 512):
                part = f.iloc[at: at + 512]
                may = quantiser.reached(unit(matrix(part["vector"])), part["list"].to_numpy(), lists, radius, reach)
                may = np.logical_or.reduceat(may, first, axis=1)[:, group_of_shelf]
                yield part.assign(shelves=[np.flatnonzero(row) for row in may])

    probing = written(filed.drop("away").mapInPandas(probe, "vector binary, vec_id long, copies long, list int, codes binary, missed double, shelves array<int>"), "probing")
    forget(filed)
    of_list = lambda x: F.element_at(F.array(*map(F.lit, x[group].tolist())), F.col("list") + 1)
    placed = probing.drop("shelves").withColumn("shelf", (of_list(begin) + F.pmod(F.xxhash64("vec_id", F.lit("shelf")), of_list(parts))).cast("int"))

    def compare(members: pd.DataFrame, probers: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"vec_id": [], "links": [], "other": []}).astype("int64")
        if not len(members) or not len(probers):
            return out
        quantiser = made.value
        y, x = unit(matrix(members["vector"])), unit(matrix(probers["vector"]))
        codes = np.frombuffer(b"".join(members["codes"]), np.uint8).reshape(len(members), SUBSPACES)
        listed, home = members["list"].to_numpy(), probers["home"].to_numpy()
        limit = (reach + members["missed"].to_numpy()) ** 2
        ids, others = probers["vec_id"].to_numpy(), members["vec_id"].to_numpy()
        lists = np.unique(listed)
        may = np.concatenate([quantiser.reached(x[at: at + 1024], home[at: at + 1024], lists, radius, reach) for at in range(0, len(x), 1024)])
        coded = quantiser.coded(codes, listed)
        # the least inner product of a coded vector with a unit vector that may be linked
        least = ((1 + (coded**2).sum(1) - limit) / 2 - SINGLE).astype(np.float32)
        coded, single = coded.astype(np.float32), x.astype(np.float32)
        counts_a, counts_b = np.zeros(len(ids), np.int64), np.zeros(len(others), np.int64)
        copies_a, copies_b = probers["copies"].to_numpy(), members["copies"].to_numpy()
        hits_a, hits_b, links = [], [], []

        def fold() -> None:
            """Counts what was found and keeps a spanning forest of it."""
            a, b = np.concatenate(hits_a), np.concatenate(hits_b)
            counts_a[:] += np.bincount(a, copies_b[b], len(ids)).astype(np.int64)
            counts_b[:] += np.bincount(b, copies_a[a], len(others)).astype(np.int64)
            links.append(forest(ids, others, a, b))
            hits_a.clear()
            hits_b.clear()

        for k, one in enumerate(lists):
            some, rows = np.flatnonzero(listed == one), np.flatnonzero(may[:, k])
            step = int(np.clip(MOST_HITS // len(some), 64, 512))
            for at in range(0, len(rows), step):
                part = rows[at: at + step]
                mask = coded[some] @ single[part].T >= least[some, None]
                # within a list each of two vectors probes the other
                own = np.flatnonzero(home[part] == one)
                mask[:, own] &= ids[part[own]] < others[some, None]
                if np.count_nonzero(mask) > mask.size // 8:
                    cosine = y[some] @ x[part].T
                    close = mask & (np.abs(cosine - threshold) < CLOSE)
                    b, a = np.nonzero(mask & ~close & (cosine >= threshold))
                    hits_a.append(part[a])
                    hits_b.append(some[b])
                    mask = close
                b, a = np.nonzero(mask)
                pa, pb = part[a], some[b]
                near = np.einsum("ij,ij->i", x[pa], y[pb]) >= threshold
                hits_a.append(pa[near])
                hits_b.append(pb[near])
            if sum(map(len, hits_a)) > MOST_HITS:
                fold()
        if any(map(len, hits_a)):
            fold()
        node, root = (np.concatenate(x) for x in zip(*links, strict=True)) if links else (ids[:0], ids[:0])
        node, root = forest(node, root, np.arange(len(node)), np.arange(len(node))) if len(links) > 1 else (node, root)
        return pd.concat([
            pd.DataFrame({"vec_id": ids, "links": counts_a, "other": -1})[counts_a > 0],
            pd.DataFrame({"vec_id": others, "links": counts_b, "other": -1})[counts_b > 0],
            pd.DataFrame({"vec_id": node, "links": 0, "other": root})])

    # rows that the blocks of a shelf are sent: a prober once a part of the members, a member once a part of the probers
    size = np.zeros(len(group_of_shelf))
    held = {r["shelf"]: r["count"] for r in placed.groupBy("shelf").count().collect()}
    for r in probing.select(F.explode("shelves").alias("shelf")).groupBy("shelf").count().collect():
        here = held.get(r["shelf"], 0)
        size[r["shelf"]] = r["count"] * -(-here // most_members) + here * -(-r["count"] // most_probers)
    wide = 8 * made.value.centres.shape[1] + ROW_BYTES
    tables, held_rows = [], 0
    for low, high in rounds(size, max(ROUND_BYTES // wide, int(ROUND_SHARE * n))):
        left, right = blocks(placed.where(F.col("shelf").between(low, high)),
                             probing.select("vec_id", "vector", "copies", F.col("list").alias("home"),
                                            F.explode(F.filter("shelves", lambda x: x.between(low, high))).alias("shelf")),
                             "shelf", most_members, most_probers)
        tables.append(written(left.cogroup(right).applyInPandas(compare, "vec_id long, links long, other long"), "met"))
        held_rows += tables[-1].count()
        if len(tables) > 1 and held_rows > MOST_HELD * n:
            tables = [summed(tables)]
            held_rows = tables[0].count()
    met = summed(tables) if len(tables) > 1 else tables[0]
    single = written(probing.select(F.col("vec_id").alias("class"), "copies"), "classes")
    forget(probing)
    links = met.where("links > 0").groupBy("vec_id").agg(F.sum("links").alias("links"))
    found = components(met.where("links = 0").select(F.col("vec_id").alias("a"), F.col("other").alias("b")))
    of_class = (single.join(links.withColumnRenamed("vec_id", "class"), "class", "left")
                .join(found.withColumnRenamed("node", "class"), "class", "left")
                .select("class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                        F.coalesce("component", "class").alias("component_id")))
    member = copies.unionByName(single.where("copies = 1").select(F.col("class").alias("vec_id"), "class"))
    linked = member.join(of_class, "class").select("vec_id", "n_links", "component_id")
    out = every.join(linked, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))

"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, exactly.

Two sets link when ``100 * |A & B| >= similarity * |A | B|``; the result is each document's
set size and connected component.

1. Equal sets are one class.  A fixed-size table of how often the shingles of a hash slot
   occur, counted over all documents, orders all shingles from rare to common.
2. Sets that link share a shingle among the first ``|A| - ceil(similarity |A|) + 1`` in that
   order.  These prefixes make inverted lists, packed per hash partition.
3. Lists of one class go.  A list of at most ``MOST_LIST`` gives the pairs for which its shingle can be the
   first that they share: in both sets what follows it suffices for the required overlap, and the ``HEADS``
   earliest shared shingles of each class, which go with its shingles, have none in common before it.  So
   nearly all pairs are given once, whatever number of shingles and partitions they share.  A pair goes on
   if the number of prefix shingles that it shares plus the larger rest reaches the required overlap (an
   upper bound, so nothing is lost).  Longer lists, as of a large group of near copies, give only a star,
   and the stars' components are clusters.
4. The remaining pairs, grouped by one of their classes, and the clusters, in chunks, are decided by
   T-occurrence search (DivideSkip): inverted lists over the whole sets of a group, the short
   ones merged and counted, the long ones only probed by binary search for what can still
   reach the overlap.  A cluster's chunks first search for their most shared member, then
   exchange the best of these, and only members still outside the cluster's largest component
   are searched against all of it; links come out as spanning forests.
5. Connected components of the links.

Words are lower-cased (A-Z) runs of characters other than ASCII white space; shingles are
64-bit hashes.  Defined cases: fewer words than a shingle make one shingle of all of them; null,
empty or blank text has the empty set and links with nothing; a null id links with nothing and
has a null component; rows with equal ids are joined to each other; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from carelake.llm.common import Words, as_number, as_text, drop_caches, forget, freeing, give_back, giving_back, gram_hashes, may_be_among, mix64, pick, written
from carelake.llm.components import components

SIZE, SIMILARITY = 5, 75
LEAST_SLOT_BITS, MOST_SLOT_BITS, SLOT_RANGES = 20, 22, 64
PARTITION_BYTES, FLUSH = 8 << 20, 2_000_000
MOST_LIST, CHUNK, HUBS = 64, 4096, 8
#: Levels of the slots, without those of the most frequent ones; counts above the most are ranked as one.
RANKS, MOST_COUNT = 192, 1 << 20
#: Shared shingles that go with each posting.
HEADS = 4


def shingles(words: Words, text: str | None, size: int = SIZE) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    found = words.hashes(text)
    return np.unique(gram_hashes(found, min(size, max(len(found), 1))))


def class_of(found: np.ndarray) -> int:
    """A 64-bit identity of a set."""
    if not len(found):
        return 0
    both = np.array([found.sum(), np.bitwise_xor.reduce(found), len(found)], np.uint64)
    return int(mix64(mix64(mix64(both[:1]) + both[1]) + both[2]).view(np.int64)[0])


def needed(a, b, similarity: int = SIMILARITY):
    """The least overlap with which sets of sizes a and b link."""
    return -(-similarity * (a + b) // (100 + similarity))


def prefix_of(n, similarity: int = SIMILARITY):
    return n - (-(-similarity * n // 100)) + 1


def ranked(counts: list[np.ndarray]) -> np.ndarray:
    """The level of each slot, from the counts by range: its rank among all slots in ``RANKS`` steps, and above these a level each doubling.

    The larger the input, the more shingles share a slot.  A frequent one then still lifts its slot above the rest,
    by less than a doubling, so coarser levels would leave it among the rare ones.
    """
    upto = np.cumsum(sum(np.bincount(np.minimum(c, MOST_COUNT), minlength=MOST_COUNT + 1) for c in counts))
    steps = np.searchsorted(upto, np.arange(1, RANKS) * upto[-1] // RANKS, "right")  # the counts at these ranks

    def level(c: np.ndarray) -> np.ndarray:
        over = np.clip(np.floor(np.log2(np.maximum(c, 1) / max(1, steps[-1]))), 0, 255 - RANKS)
        return (np.searchsorted(steps, c, "left") + np.where(c > steps[-1], over, 0)).astype(np.uint8)

    return np.concatenate([level(c) for c in counts])


class Index:
    """Inverted lists over sets; rows are numbered in order."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.keys, self.first = np.unique(every[order], return_index=True)
        self.rows = owner[order]  # within a key in ascending order
        self.ends = np.r_[self.first[1:], len(every)]

    def popularity(self, sets: list[np.ndarray]) -> np.ndarray:
        lengths = self.ends - self.first
        return np.array([int(lengths[np.searchsorted(self.keys, s)].sum()) for s in sets])

    def search(self, query: np.ndarray, similarity: int = SIMILARITY) -> np.ndarray:
        """Rows that link with the query: T-occurrence by DivideSkip."""
        at = np.minimum(np.searchsorted(self.keys, query), len(self.keys) - 1)
        at = at[self.keys[at] == query]
        least = -(-similarity * len(query) // 100)  # the overlap with any set is at least this
        if len(at) < least:
            return at[:0]
        first, length = self.first[at], self.ends[at] - self.first[at]
        order = np.argsort(-length, kind="stable")
        long = min(least - 1, int((length > 16).sum()))
        # the short lists merged and counted
        f, n = first[order[long:]], length[order[long:]]
        upto = np.cumsum(n)
        merged = self.rows[np.repeat(f - (upto - n), n) + np.arange(upto[-1])] if len(n) else at[:0]
        counts = np.bincount(merged, minlength=len(self.sizes))
        found = np.flatnonzero(counts >= max(1, least - long))
        need = needed(len(query), self.sizes[found], similarity)
        counts = counts[found]
        for rank, i in enumerate(order[:long]):
            keep = counts + (long - rank) >= need
            found, counts, need = found[keep], counts[keep], need[keep]
            if not len(found):
                break
            some = self.rows[first[i]: first[i] + length[i]]
            place = np.minimum(np.searchsorted(some, found), len(some) - 1)
            counts = counts + (some[place] == found)
        return found[counts >= need]


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def resolve(sets: list[np.ndarray], similarity: int) -> tuple[list[tuple[int, int]], int]:
    """A spanning forest of all links among the sets, and the most shared set."""
    index, union, links = Index(sets), Union(len(sets)), []
    popular = index.popularity(sets)
    hub = int(np.argmax(popular))

    def ask(i: int) -> None:
        for j in index.search(sets[i], similarity):
            if union.join(i, int(j)):
                links.append((i, int(j)))

    ask(hub)
    # a link across components has an end outside the hub's
    rest = [i for i in np.argsort(-popular, kind="stable").tolist() if union.root(i) != union.root(hub)]
    for i in rest:
        ask(i)
    return links, hub


# --- the Spark job ----------------------------------------------------------------------


def _texts(frames: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple]:
    for f in frames:
        yield from zip(*[f[c] for c in columns], strict=True)


def _levels(rows: DataFrame, size: int) -> tuple[DataFrame, np.ndarray, int]:
    """(id, n, cls) of every document, the level of each hash slot, and the slots' bits."""
    spark = rows.sparkSession
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = int(np.clip(np.ceil(np.log2(max(n_bytes / 6 / 64, 1))), LEAST_SLOT_BITS, MOST_SLOT_BITS))
    shift, width = np.uint64(64 - bits), (1 << bits) // SLOT_RANGES

    @giving_back
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drop_caches()
        words, counts, held, size_held = Words(), np.zeros(1 << bits, np.uint32), [], 0
        for f in frames:
            out = []
            for key, text in zip(f["id"], f["text"], strict=True):
                found = shingles(words, text, size)
                out.append((key, len(found), class_of(found)))
                held.append((found >> shift).astype(np.int64))
                size_held += len(found)
                if size_held > FLUSH:
                    counts += np.bincount(np.concatenate(held), minlength=len(counts)).astype(np.uint32)
                    held, size_held = [], 0
            yield pd.DataFrame(out, columns=["id", "n", "cls"]).assign(range=-1, counts=None)
        if held:
            counts += np.bincount(np.concatenate(held), minlength=len(counts)).astype(np.uint32)
        if counts.any():
            yield pd.DataFrame({"id": None, "n": 0, "cls": 0, "range": np.arange(SLOT_RANGES),
                                "counts": [np.minimum(counts[i * width: (i + 1) * width], 65535).astype(np.uint16).tobytes() for i in range(SLOT_RANGES)]})

    table = written(as_number(as_text(rows, "id").mapInPandas(read, "id string, n long, cls long, range int, counts binary"), "id"), "sets")

    def add(f: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, np.int64)
        for c in f["counts"]:
            total += np.frombuffer(c, np.uint16)
        return pd.DataFrame({"range": f["range"].iloc[:1], "counts": [total.tobytes()]})

    summed = table.where("range >= 0").groupBy("range").applyInPandas(add, "range int, counts binary")
    # SLOT_RANGES rows of one fixed-size table
    with freeing(spark):
        ranges = {r["range"]: np.frombuffer(r["counts"], np.int64) for r in summed.collect()}
    levels = ranked([ranges.get(i, np.zeros(width, np.int64)) for i in range(SLOT_RANGES)])
    return table.where("range < 0").select("id", "n", "cls"), levels, max(5, int(np.ceil(np.log2(max(1, n_bytes / PARTITION_BYTES)))))


def _arrays(f: pd.DataFrame, **kinds: type) -> list[np.ndarray]:
    """The arrays that the rows of ``f`` hold as bytes, end to end."""
    return [np.concatenate([np.frombuffer(x, kind) for x in f[name]]) for name, kind in kinds.items()]


def _dealt(part: np.ndarray, parts: int, **columns: np.ndarray) -> pd.DataFrame:
    """Each part's share of the columns as bytes, a row a part that has any; ``part`` ascends."""
    cuts = np.searchsorted(part, np.arange(parts + 1))
    out = [(p, *[x[a:b].tobytes() for x in columns.values()]) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
    return pd.DataFrame(out, columns=["part", *columns])


POSTINGS = {"keys": np.uint64, "owners": np.int64, "sizes": np.int32, "places": np.int32}
POSTINGS_SQL = "part int, keys binary, owners binary, sizes binary, places binary"


def _shared_postings(rows: DataFrame, levels: np.ndarray, bits: int, size: int, similarity: int, most_list: int) -> DataFrame:
    """Prefix shingles that 2 to ``most_list`` classes share, packed by their owner; as part -1 a star (keys, owners) of longer lists."""
    shared_levels = rows.sparkSession.sparkContext.broadcast(levels)
    slot = np.uint64(64 - int(np.log2(len(levels))))
    shift, owner_bits = np.uint64(64 - bits), bits - 2

    @giving_back
    def prefixes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, level, seen = Words(), shared_levels.value, set()
        keys, owners, sizes, held = [], [], [], 0

        def packed() -> pd.DataFrame:
            lengths = [len(x) for x in keys]
            k, o, n = np.concatenate(keys), np.array(owners, np.int64), np.array(sizes, np.int32)
            own, place = np.repeat(np.arange(len(keys)), lengths), np.concatenate([np.arange(x, dtype=np.int32) for x in lengths])
            order = np.argsort(k)
            k, own, place = k[order], own[order], place[order]
            return _dealt((k >> shift).astype(np.int64), 1 << bits, keys=k, owners=o[own], sizes=n[own], places=place)

        for key, text in _texts(frames, ["id", "text"]):
            found = shingles(words, text, size)
            cls = class_of(found)
            if not len(found) or key is None or key != key or cls in seen:  # a copy in this task adds nothing
                continue
            seen.add(cls)
            order = np.argsort(level[(found >> slot).astype(np.int64)], kind="stable")
            keys.append(found[order[: prefix_of(len(found), similarity)]])
            owners.append(cls)
            sizes.append(len(found))
            held += len(keys[-1])
            if held > FLUSH:
                yield packed()
                keys, owners, sizes, held = [], [], [], 0
        if keys:
            yield packed()

    def several(f: pd.DataFrame) -> pd.DataFrame:
        give_back()
        key, owner, n, place = _arrays(f, **POSTINGS)
        order = np.lexsort((owner, key))
        key, owner, n, place = key[order], owner[order], n[order], place[order]
        fresh = np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]
        key, owner, n, place = key[fresh], owner[fresh], n[fresh], place[fresh]
        first = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1]
        length = np.diff(np.r_[first, len(key)])
        each = np.repeat(length, length)
        some = np.flatnonzero((each > 1) & (each <= most_list))
        bucket = (owner[some].view(np.uint64) >> np.uint64(64 - owner_bits)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        some = some[by]
        short = _dealt(bucket[by], 1 << owner_bits, keys=key[some], owners=owner[some], sizes=n[some], places=place[some])
        # a star per long list, from its least member
        long = np.flatnonzero(each > most_list)
        ends = np.unique(np.column_stack([np.repeat(owner[first], length)[long], owner[long]]), axis=0)
        ends = ends[ends[:, 0] != ends[:, 1]]
        if not len(ends):
            return short
        return pd.concat([short, pd.DataFrame([(-1, ends[:, 0].tobytes(), ends[:, 1].tobytes(), b"", b"")], columns=["part", *POSTINGS])])

    return written(rows.mapInPandas(prefixes, POSTINGS_SQL).groupBy("part").applyInPandas(several, POSTINGS_SQL), "postings")


def _meetings(postings: DataFrame, bits: int, similarity: int) -> tuple[DataFrame, DataFrame]:
    """The classes (cls, n, keys, places) with their shared prefix shingles in order, and the pairs (a, b) where these first meet."""
    shift = np.uint64(64 - bits)

    def by_owner(f: pd.DataFrame) -> pd.DataFrame:
        give_back()
        key, owner, n, place = _arrays(f, **POSTINGS)
        order = np.lexsort((place, owner))
        key, owner, n, place = key[order], owner[order], n[order], place[order]
        cuts = np.r_[0, np.flatnonzero(owner[1:] != owner[:-1]) + 1, len(owner)]
        return pd.DataFrame([(owner[a], n[a], key[a:b].tobytes(), place[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)],
                            columns=["cls", "n", "keys", "places"])

    known = written(postings.where("part >= 0").groupBy("part").applyInPandas(by_owner, "cls long, n long, keys binary, places binary"), "shared")

    @giving_back
    def with_heads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            key, place = _arrays(f, keys=np.uint64, places=np.int32)
            lengths = np.array([len(x) // 8 for x in f["keys"]])
            first = np.repeat(np.cumsum(lengths) - lengths, lengths)
            rank = np.arange(len(key)) - first
            heads = np.zeros((len(key), HEADS), np.uint64)
            for i in range(HEADS):  # shared shingles of the same class that come before
                later = np.flatnonzero(rank > i)
                heads[later, i] = key[first[later] + i]
            order = np.argsort(key)
            yield _dealt((key[order] >> shift).astype(np.int64), 1 << bits, keys=key[order], owners=np.repeat(f["cls"].to_numpy(), lengths)[order],
                         sizes=np.repeat(f["n"].to_numpy().astype(np.int32), lengths)[order], places=place[order], heads=heads[order])

    def pairs(f: pd.DataFrame) -> pd.DataFrame:
        give_back()
        key, owner, n, place, heads = _arrays(f, **POSTINGS, heads=np.uint64)
        order = np.lexsort((owner, key))
        key, owner, n, place, heads = key[order], owner[order], n[order].astype(np.int64), place[order], heads.reshape(-1, HEADS)[order]
        first = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1]
        length = np.diff(np.r_[first, len(key)])
        out = [np.zeros((0, 2), np.int64)]
        for size_ in np.unique(length):
            at = first[length == size_]
            i, j = np.triu_indices(int(size_), 1)
            step = max(1, 200_000 // max(1, len(i)))
            for s in range(0, len(at), step):
                x, y = (at[s: s + step, None] + i).ravel(), (at[s: s + step, None] + j).ravel()
                # the first shingle that two linked sets share leaves room for their overlap in both
                need = needed(n[x], n[y], similarity)
                room = (place[x] <= n[x] - need) & (place[y] <= n[y] - need)
                x, y = x[room], y[room]
                # and shares no shingle before it
                before = heads[x][:, :, None]
                fresh = ~((before == heads[y][:, None, :]) & (before != 0)).any((1, 2))
                out.append(np.column_stack([owner[x[fresh]], owner[y[fresh]]]))
        return pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["a", "b"])

    return known, known.mapInPandas(with_heads, f"{POSTINGS_SQL}, heads binary").groupBy("part").applyInPandas(pairs, "a long, b long")


def _candidates(rows: DataFrame, levels: np.ndarray, bits: int, size: int, similarity: int, most_list: int) -> tuple[DataFrame, DataFrame]:
    """Class pairs (a, b) of short lists that may link, and the stars (a, b) of long lists."""
    postings = _shared_postings(rows, levels, bits, size, similarity, most_list)

    @giving_back
    def spokes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a, b in zip(f["keys"], f["owners"], strict=True):
                yield pd.DataFrame({"a": np.frombuffer(a, np.int64), "b": np.frombuffer(b, np.int64)})

    stars = written(postings.where("part < 0").select("keys", "owners").mapInPandas(spokes, "a long, b long").distinct(), "stars")
    known, met = _meetings(postings, bits, similarity)
    forget(postings)
    side = lambda c: known.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("keys").alias(f"keys_{c}"))

    @giving_back
    def reach(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            na, nb = f["na"].to_numpy(), f["nb"].to_numpy()
            shared = np.array([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                               for x, y in zip(f["keys_a"], f["keys_b"], strict=True)], np.int64)
            rest = np.maximum(na - prefix_of(na, similarity), nb - prefix_of(nb, similarity))
            yield f.loc[shared + rest >= needed(na, nb, similarity), ["a", "b"]]

    pairs = written(met.distinct().join(side("a"), "a").join(side("b"), "b").mapInPandas(reach, "a long, b long"), "pairs")
    forget(known)
    return pairs, stars


def _sets(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """block, cls, asks, shingles (bytes): the sets of the classes wanted in blocks (cls, id, block, asks)."""
    wanted = written(wanted, "wanted")
    jobs = wanted.groupBy("id", "cls").agg(F.collect_list(F.struct("block", "asks")).alias("blocks"))
    texts = rows.where(may_be_among(wanted.select("id").distinct())(F.col("id"))).join(jobs, "id")

    @giving_back
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, out, held = Words(), [], 0
        for text, cls, blocks, asks in _texts(frames, ["text", "cls", "block", "asks"]):
            found = shingles(words, text, size)
            if class_of(found) != cls:  # another row of the same id
                continue
            data = found.tobytes()
            for block, ask in zip(blocks, asks, strict=True):
                out.append((block, cls, ask, data))
                held += len(data)
                if held > 8 << 20:
                    yield pd.DataFrame(out, columns=["block", "cls", "asks", "shingles"])
                    out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=["block", "cls", "asks", "shingles"])

    return texts.select("text", "cls", F.col("blocks.block").alias("block"), F.col("blocks.asks").alias("asks")).mapInPandas(read, "block long, cls long, asks boolean, shingles binary")


def _links_of_pairs(rows: DataFrame, reps: DataFrame, pairs: DataFrame, size: int, similarity: int) -> DataFrame:
    """Verified links (a, b): a block per left class, which asks for its partners."""
    ends = pairs.select(F.col("a").alias("cls"), F.col("a").alias("block"), F.lit(True).alias("asks")).distinct().unionByName(
        pairs.select(F.col("b").alias("cls"), F.col("a").alias("block"), F.lit(False).alias("asks")))
    sets = _sets(rows, ends.join(reps, "cls"), size)
    buckets = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs.count() // 5000 + 1)

    def decide(f: pd.DataFrame) -> pd.DataFrame:
        out = []
        for block, some in f.groupby("block", sort=False):
            found = [np.frombuffer(x, np.uint64) for x in some["shingles"]]
            asks, cls = some["asks"].to_numpy(), some["cls"].to_numpy()
            others = np.flatnonzero(~asks)
            if not asks.any() or not len(others):
                continue
            index = Index([found[i] for i in others])
            hit = index.search(found[int(np.flatnonzero(asks)[0])], similarity)
            out.append(pd.DataFrame({"a": block, "b": cls[others[hit]]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []}).astype("int64")

    return (sets.withColumn("bucket", F.pmod(F.xxhash64("block"), F.lit(buckets))).groupBy("bucket")
            .applyInPandas(decide, "a long, b long"))


def _links_of_clusters(rows: DataFrame, reps: DataFrame, stars: DataFrame, size: int, similarity: int, chunk: int) -> DataFrame:
    """Spanning links of the clusters that long lists make."""
    cluster = written(components(stars).select(F.col("node").alias("cls"), F.col("component").alias("cluster")), "clusters")
    sizes = cluster.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("chunks"))
    placed = cluster.join(sizes, "cluster").withColumn("chunk", F.pmod(F.xxhash64("cls"), "chunks"))
    blocks = placed.withColumn("block", F.xxhash64("cluster", "chunk"))
    sets = written(_sets(rows, blocks.join(reps, "cls").select("id", "cls", "block", F.lit(False).alias("asks")), size)
                   .select("block", "cls", "shingles"), "cluster_sets")

    def within(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("cls")
        found, cls = [np.frombuffer(x, np.uint64) for x in f["shingles"]], f["cls"].to_numpy()
        links, hub = resolve(found, similarity)
        return pd.DataFrame([(cls[i], cls[j], 0) for i, j in links] + [(cls[hub], cls[hub], len(links))], columns=["a", "b", "hub"])

    first = written(sets.groupBy("block").applyInPandas(within, "a long, b long, hub long"), "within")
    links = first.where("a <> b").select("a", "b")
    several = placed.where("chunks > 1")
    if several.isEmpty():
        forget(sets)
        return links

    def ask(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": [], "b": []}).astype("int64")
        if not len(index) or not len(queries):
            return none
        lists, cls = Index([np.frombuffer(x, np.uint64) for x in index["shingles"]]), index["cls"].to_numpy()
        union, out, at = Union(len(index) + len(queries)), [], len(index)
        for i, (q, data) in enumerate(zip(queries["cls"], queries["shingles"], strict=True)):
            for j in lists.search(np.frombuffer(data, np.uint64), similarity):
                if cls[j] != q and union.join(at + i, int(j)):
                    out.append((q, cls[j]))
        return pd.DataFrame(out, columns=["a", "b"]) if out else none

    every = several.select("cluster", "chunk").distinct().select("cluster", F.xxhash64("cluster", "chunk").alias("block"))

    def asked(members: DataFrame) -> DataFrame:
        """Links of some members (cls, cluster) with all chunks of their cluster."""
        queries = members.join(sets.select("cls", "shingles"), "cls").join(every, "cluster").select("block", "cls", "shingles")
        part = F.pmod(F.xxhash64("cls"), F.lit(1 << 20)) % F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(Window.partitionBy("block")) / chunk))
        queries = queries.withColumn("part", part.cast("int"))
        parts = queries.select("block", "part").distinct()
        fresh = lambda df: df.select(*[F.col(c).alias(c) for c in ("block", "part", "cls", "shingles")])
        return (fresh(sets.join(parts, "block")).groupBy("block", "part").cogroup(fresh(queries).groupBy("block", "part"))
                .applyInPandas(ask, "a long, b long"))

    order = Window.partitionBy("cluster").orderBy(F.desc("hub"), "a")
    hubs = (first.where("a = b").join(several.select(F.col("cls").alias("a"), "cluster"), "a")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= HUBS).select(F.col("a").alias("cls"), "cluster"))
    links = written(links.unionByName(asked(hubs)), "hub_links")
    known = components(links).select(F.col("node").alias("cls"), "component")
    member = several.select("cls", "cluster").join(known, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    largest = (member.groupBy("cluster", "component").count()
               .groupBy("cluster").agg(F.max_by("component", F.struct("count", "component")).alias("largest")))
    outside = member.join(largest, "cluster").where("component <> largest").select("cls", "cluster")
    links = links.unionByName(written(asked(outside), "outside_links"))
    forget(sets)
    return links


def jaccard_components(docs: DataFrame, similarity: int = SIMILARITY, size: int = SIZE, doc_id: str = "doc_id", text: str = "text",
                       most_list: int = MOST_LIST, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    rows = pick(docs, id=doc_id, text=text).select(F.col("id").cast("long").alias("id"), "text")
    table, levels, bits = _levels(rows, size)
    usable = table.where("n > 0 and id is not null")
    classes = usable.groupBy("cls").agg(F.min("id").alias("id"))
    pairs, stars = _candidates(rows, levels, bits, size, similarity, most_list)
    reps = written(classes, "classes")
    links = _links_of_pairs(rows, reps, pairs, size, similarity)
    if not stars.isEmpty():
        links = links.unionByName(_links_of_clusters(rows, reps, stars, size, similarity, chunk))
    # classes to documents: a class is known by its least id, and rows with one id are one node
    named = lambda c: reps.select(F.col("cls").alias(c), F.col("id").alias(f"{c}_id"))
    between = written(links, "links").join(named("a"), "a").join(named("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    copies = usable.join(reps.withColumnRenamed("id", "rep"), "cls").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    found = components(between.unionByName(copies.where("a <> b")))
    out = table.join(found.withColumnRenamed("node", "id"), "id", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id")).alias("component_id"))

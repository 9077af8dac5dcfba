"""Suffix-array dedup: removes every byte covered by a string of ``length`` bytes that also
starts anywhere else in the corpus, the same document included.

1. Every start of a string of ``length`` bytes is assigned its anchor: the leftmost least hash of
   the ``gram``-byte pieces in it.  Equal strings have equal anchors at equal distances, so
   starts fall into segments (runs of starts with one anchor), and only segments whose anchor's
   bytes occur in another segment can hold repeats.
2. Segments with the same bytes are counted: where there are two, all their starts repeat.
   Different segments with the same anchor bytes go to the same shard.
3. A shard builds two suffix arrays over its segments, read from the anchor forwards and
   backwards, by Larsson-Sadakane refinement in numpy (symbols of eight bytes; only unsorted
   groups are sorted again, by the rank as many symbols ahead as are known), and common prefixes
   by Kasai's sweep, all segments in step.  Cut at a depth, each sorted order falls into
   classes, found by binary search in running minima; two strings at distance d before the
   anchor are equal if they share the class of depth d backwards and of depth ``length - d`` forwards.
   This is exact and never compares pairs.
4. Anchors that more than ``MOST_GROUP`` different segments share are too many for one task;
   their strings are counted one by one by hash, with partial counts, in a Spark aggregation.
5. Tasks hand on each segment of a chunk of documents once, with all its places, so that a passage of every
   document costs one row a chunk; repeated starts meet the chunks again, and then the documents, which drop the
   bytes covered.

Defined cases: null text is empty; texts shorter than ``length`` keep all; equal rows (same id
and text, null ids too) are each other's repeats; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.llm.common import Rolling, as_text, drop_caches, give_back, giving_back, mix64, pick, written

LENGTH = 400
BLOCK_STARTS = 1 << 18
SHARD_ROWS, MOST_GROUP = 10_000, 4096
SEGMENT = ["f", "h", "n", "a"]
#: Segments handed on together, a document's with one chunk.
CHUNK = 50_000
_NONE = np.zeros((0, 3), np.int64)


def gram_of(length: int) -> int:
    return max(1, length * 4 // 25)


def leftmost_least(x: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the index of its leftmost least one."""
    at, now, size = np.arange(len(x)), x, 1
    while size < width:
        step = min(size, width - size)
        take = now[step:] < now[:-step]
        at = np.where(take, at[step:], at[:-step])
        now = np.where(take, now[step:], now[:-step])
        size += step
    return at


class Segmenter:
    """Segments of a text: first start, starts, distance to the anchor, anchor hash, content hash."""

    def __init__(self, length: int):
        self.length, self.gram = length, gram_of(length)
        self.rolling = Rolling(BLOCK_STARTS + length + 1)

    def segments(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        starts = len(data) - self.length + 1
        for at in range(0, max(starts, 0), BLOCK_STARTS):
            part = data[at: at + BLOCK_STARTS + self.length - 1]
            prefix = self.rolling.prefix(part)
            i = np.arange(len(part) - self.gram + 1)
            grams = self.rolling.ranges(prefix, i, i + self.gram)
            anchor = leftmost_least(grams, self.length - self.gram + 1)
            first = np.r_[0, np.flatnonzero(np.diff(anchor)) + 1]
            n = np.diff(np.r_[first, len(anchor)])
            where = anchor[first]
            content = mix64(self.rolling.ranges(prefix, first, first + n + self.length - 1) + np.uint64(1))
            yield first + at, n, where - first, grams[where].view(np.int64), content.view(np.int64)


# --- suffix arrays over many short strings ----------------------------------------------


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Sorted order of all suffixes of the rows (as row * (m + 1) + column; equal ones in any order).

    Larsson-Sadakane: ranks by the first h symbols give those by 2h, and only groups
    that are not yet sorted are sorted again.
    """
    n, m = symbols.shape
    rank = np.zeros((n, m + 1), np.int64)  # column m: the end, before every symbol
    rank[:, :m] = np.unique(symbols, return_inverse=True)[1].reshape(n, m) + 1
    rank = rank.ravel()
    order = np.argsort(rank, kind="stable")
    column = np.arange(n * (m + 1)) % (m + 1)
    ranked = rank[order]
    fresh = np.r_[True, ranked[1:] != ranked[:-1]]
    rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    h = 1
    while h <= m:
        last = np.r_[fresh[1:], True]
        open_ = np.flatnonzero(~(fresh & last))  # places in groups of more than one
        open_ = open_[column[order[open_]] + h <= m + 1]
        if not len(open_):
            break
        some = order[open_]
        inside = column[some] + h <= m
        ahead = np.where(inside, rank[np.minimum(some + h, len(rank) - 1)], -1)
        group = rank[some]
        by = np.lexsort((ahead, group))
        # a group's places are contiguous and all of it is open, or its rest is shorter than h
        order[open_] = some[by]
        g, a = group[by], ahead[by]
        new = np.r_[True, (g[1:] != g[:-1]) | (a[1:] != a[:-1])]
        fresh[open_] |= new & (np.r_[True, g[1:] == g[:-1]] | fresh[open_])
        starts = np.flatnonzero(fresh)
        rank[order] = starts[np.cumsum(fresh) - 1]
        h *= 2
    return order


def kasai(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix, in symbols, of each place of the order with the one before; rows swept in step."""
    n, m = symbols.shape
    width = m + 1
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    before = np.r_[order[0], order[:-1]]
    out = np.zeros(len(order), np.int64)
    known = np.zeros(n, np.int64)
    rows = np.arange(n)
    for j in range(m):
        at = place[rows * width + j]
        other = before[at]
        other_row, other_column = other // width, other % width
        known = np.where(at > 0, np.maximum(known - 1, 0), 0)
        live = np.flatnonzero(at > 0)
        while len(live):
            k = known[live]
            a, b = j + k, other_column[live] + k
            live, a, b = (x[(a < m) & (b < m)] for x in (live, a, b))
            same = symbols[live, a] == symbols[other_row[live], b]
            live = live[same]
            known[live] += 1
        out[at] = known
    return out


def row_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted place of each byte row, and the common prefix in bytes of each place with the one before."""
    n, width = rows.shape
    wide = -(-width // 8) * 8
    text = np.zeros((n, wide), np.uint8)
    text[:, :width] = rows
    symbols = text.view(">u8").astype(np.uint64)
    order = suffix_array(symbols)
    common = kasai(symbols, order)
    m = symbols.shape[1]
    whole = np.flatnonzero(order % (m + 1) == 0)  # suffixes that are whole rows
    sorted_rows = order[whole] // (m + 1)
    prefix = np.zeros(n, np.int64)
    if n > 1:
        prefix[1:] = np.minimum.reduceat(common, whole[:-1] + 1)[: n - 1] if n == 2 else _between(common, whole)
        more = prefix[1:] < m
        at = np.minimum(prefix[1:], m - 1)[:, None] * 8 + np.arange(8)
        same = text[sorted_rows[1:, None], at] == text[sorted_rows[:-1, None], at]
        prefix[1:] = prefix[1:] * 8 + np.where(more, np.cumprod(same, axis=1).sum(1), 0)
    place = np.empty(n, np.int64)
    place[sorted_rows] = np.arange(n)
    return place, prefix


def _between(common: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Least common prefix over the places after one whole row up to the next."""
    return np.minimum.reduceat(common[: whole[-1] + 1], whole[:-1] + 1)


def repeated_starts(texts: list[bytes], n: np.ndarray, a: np.ndarray, length: int) -> np.ndarray:
    """Which starts (row, start) of different segments repeat in another segment of the shard."""
    rows = len(texts)
    reach = length - gram_of(length) + 1
    back, ahead = np.zeros((rows, max(1, reach - 1)), np.uint8), np.zeros((rows, length), np.uint8)
    for i, t in enumerate(texts):
        data = np.frombuffer(t, np.uint8)
        back[i, : a[i]] = data[: a[i]][::-1]
        rest = data[a[i]: a[i] + length]
        ahead[i, : len(rest)] = rest
    (place_b, common_b), (place_a, common_a) = row_order(back), row_order(ahead)
    out = np.zeros((rows, int(n.max())), bool)
    for d in range(int(a.max()) + 1):
        active = np.flatnonzero((a >= d) & (a - n < d))
        if len(active) < 2:
            continue
        class_b = np.cumsum(common_b < d)[place_b[active]] if d else np.zeros(len(active), np.int64)
        class_a = np.cumsum(common_a < length - d)[place_a[active]]
        key = class_b * (rows + 1) + class_a
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(active), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = active[twice]
        out[hit, a[hit] - d] = True
    return out


def _runs(flags: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return edge[::2].tolist(), edge[1::2].tolist()


# --- the Spark job ----------------------------------------------------------------------


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _spans(docs: DataFrame, length: int, most_group: int) -> DataFrame:
    """id, th, lo, hi: arrays of the runs of repeated starts, for documents that have any."""

    @giving_back
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drop_caches()
        maker = Segmenter(length)
        keys: list[tuple[int, int, int]] = []
        parts: list[tuple[np.ndarray, ...]] = []
        chunk = TaskContext.get().partitionId() << 32

        def table() -> pd.DataFrame:
            sizes = [k[2] for k in keys]
            s, n, a, fp, h = (np.concatenate(x) for x in zip(*parts, strict=True))
            place = np.stack([np.repeat(np.array([k[0] for k in keys], np.int64), sizes),
                              np.repeat(np.array([k[1] for k in keys], np.int64), sizes), s.astype(np.int64)], 1)
            # each segment once, with all its places in the chunk
            order = np.lexsort((a, n, h, fp))
            key = np.stack([fp[order], h[order], n[order], a[order]], 1)
            first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])
            c = np.diff(np.r_[first, len(order)])
            rest = np.full(len(first), None, object)
            for i in np.flatnonzero(c > 1).tolist():
                rest[i] = place[order[first[i] + 1: first[i] + c[i]]].tobytes()
            at = order[first]
            keys.clear()
            parts.clear()
            return pd.DataFrame({"chunk": chunk, "id": place[at, 0], "th": place[at, 1], "s": place[at, 2], "n": n[at].astype(np.int32),
                                 "a": a[at].astype(np.int32), "f": fp[at], "h": h[at], "c": c, "rest": rest})

        held = 0
        for f in frames:
            for key, th, t in zip(f["id"], f["th"], f["text"], strict=True):
                for part in maker.segments(np.frombuffer(_raw(t), np.uint8)):
                    keys.append((key, th, len(part[0])))
                    parts.append(part)
                    held += len(part[0])
                if held > CHUNK:  # a document lies in one chunk
                    yield table()
                    held, chunk = 0, chunk + 1
        if keys:
            yield table()

    found = written(docs.mapInPandas(cut, "chunk long, id long, th long, s long, n int, a int, f long, h long, c long, rest binary"), "segments")
    different = found.groupBy(*SEGMENT).agg(F.sum("c").alias("c"), F.min(F.struct("id", "th", "s")).alias("at"))
    different = written(different, "different")
    shared = different.groupBy("f").agg(F.count(F.lit(1)).alias("g")).where("g > 1")
    # segments that occur twice repeat as they are; those that share their anchor are compared
    twice = different.where("c > 1").select(*SEGMENT, F.array(F.struct(F.lit(0).alias("lo"), F.col("n").alias("hi"))).alias("runs"))
    places = different.join(shared, "f").select(*SEGMENT, "g", "c", "at.*")
    wanted = places.groupBy("id", "th").agg(F.collect_list(F.struct(*SEGMENT, "g", "c", "s")).alias("wanted"))
    columns = [*SEGMENT, "g", "c", "s"]
    texts = (docs.join(wanted, ["id", "th"]).dropDuplicates(["id", "th"])
             .select("text", *[F.col(f"wanted.{x}").alias(x) for x in columns]))

    @giving_back
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[np.ndarray]] = {x: [] for x in columns[:-1]}
        cut_texts: list[bytes] = []
        size = 0

        def table() -> pd.DataFrame:
            out = pd.DataFrame({x: np.concatenate(v) for x, v in held.items()}).assign(text=cut_texts)
            for v in held.values():
                v.clear()
            cut_texts.clear()
            return out

        for f in frames:
            for t, *arrays in zip(f["text"], *[f[x] for x in columns], strict=True):
                data, row = _raw(t), dict(zip(columns, arrays, strict=True))
                for at in range(0, len(row["s"]), 4096):
                    for x in held:
                        held[x].append(row[x][at: at + 4096])
                    for s, n in zip(row["s"][at: at + 4096].tolist(), row["n"][at: at + 4096].tolist(), strict=True):
                        cut_texts.append(data[s: s + n + length - 1])
                        size += n + length - 1
                    if size > 4 << 20:
                        yield table()
                        size = 0
        if cut_texts:
            yield table()

    shown = written(texts.mapInPandas(read, "f long, h long, n int, a int, g long, c long, text binary"), "shown")
    count = shown.count()
    shards = max(1, -(-count // SHARD_ROWS))
    runs = "f long, h long, n int, a int, runs array<struct<lo:int,hi:int>>"

    def resolve(rows: pd.DataFrame) -> pd.DataFrame:
        give_back()
        flags = repeated_starts(list(rows["text"]), rows["n"].to_numpy(), rows["a"].to_numpy(), length)
        flags[rows["c"].to_numpy() > 1] = False  # known already
        some = np.flatnonzero(flags.any(1))
        found = rows.iloc[some][SEGMENT]
        return found.assign(runs=pd.Series([[{"lo": x, "hi": y} for x, y in zip(*_runs(flags[i]), strict=True)] for i in some], found.index, object))

    near = (shown.where(F.col("g") <= most_group).withColumn("shard", F.pmod(F.xxhash64("f"), F.lit(shards)))
            .groupBy("shard").applyInPandas(resolve, runs))

    @giving_back
    def strings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, two = Rolling(2 * length), Rolling(2 * length)
        for f in frames:
            for row in f.itertuples():
                data = np.frombuffer(row.text, np.uint8)
                i = np.arange(row.n)
                yield pd.DataFrame({"f": row.f, "h": row.h, "n": row.n, "a": row.a, "i": i.astype(np.int32),
                                    "w": one.ranges(one.prefix(data), i, i + length).view(np.int64),
                                    "v": mix64(two.ranges(two.prefix(data[::-1]), len(data) - i - length, len(data) - i)).view(np.int64)})

    each = shown.where(F.col("g") > most_group).mapInPandas(strings, "f long, h long, n int, a int, i int, w long, v long")
    again = each.groupBy("f", "w", "v").agg(F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    hot = (each.join(again, ["f", "w", "v"]).groupBy(*SEGMENT)
           .agg(F.collect_set(F.struct(F.col("i").alias("lo"), (F.col("i") + 1).alias("hi"))).alias("runs")))
    resolved = twice.unionByName(near).unionByName(hot.select(twice.columns))

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        """The repeated starts of a chunk's documents, one row each."""
        more = [np.frombuffer(x, np.int64).reshape(-1, 3) if x is not None else _NONE for x in rows["rest"]]
        row = np.r_[np.arange(len(rows)), np.repeat(np.arange(len(rows)), [len(x) for x in more])]
        place = np.concatenate([rows[["id", "th", "s"]].to_numpy(), *more])
        low, high = rows["lo"].to_numpy(), rows["hi"].to_numpy()
        sizes = np.array([len(x) for x in low])[row]
        lo, hi = (np.concatenate([x[i] for i in row]).astype(np.int64) + np.repeat(place[:, 2], sizes) for x in (low, high))
        key = np.column_stack([np.repeat(place[:, :2], sizes, axis=0), lo, hi])
        # rows with equal id and text have equal segments: each once, whatever number of rows there are
        key = key[np.lexsort(key.T[::-1])]
        key = key[np.r_[True, (key[1:] != key[:-1]).any(1)]]
        first = np.flatnonzero(np.r_[True, (key[1:, :2] != key[:-1, :2]).any(1)])
        return pd.DataFrame({"id": key[first, 0], "th": key[first, 1],
                             "lo": np.split(key[:, 2], first[1:]), "hi": np.split(key[:, 3], first[1:])})

    hits = found.join(resolved, SEGMENT).select("chunk", "id", "th", "s", "rest", F.col("runs.lo").alias("lo"), F.col("runs.hi").alias("hi"))
    starts = hits.groupBy("chunk").applyInPandas(gather, "id long, th long, lo array<long>, hi array<long>")
    starts = starts.groupBy("id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    return starts.select("id", "th", F.flatten("runs.lo").alias("lo"), F.flatten("runs.hi").alias("hi"))


ROWS = 250


def _with_kept(docs: DataFrame, doc_id: str, text: str, length: int, most_group: int, decode: bool = False) -> DataFrame:
    """The rows of ``docs`` (without their text) with n_bytes, n_removed, n_spans, kept: bytes, or text if ``decode``."""
    known = [c for c in docs.columns if c not in (text, "n_bytes", "n_removed", "n_spans", "kept", "_text", "_id", "_th", "_lo", "_hi")]
    keyed = docs.select(*[F.col(f"`{c}`") for c in known], F.col(f"`{text}`").alias("_text"),
                        F.coalesce(F.col(f"`{doc_id}`"), F.lit(-(1 << 63))).cast("long").alias("_id"),
                        F.xxhash64(F.col(f"`{text}`"), F.length(F.col(f"`{text}`"))).alias("_th"))
    spans = _spans(keyed.select(F.col("_id").alias("id"), F.col("_th").alias("th"), F.col("_text").alias("text")), length, most_group)
    spans = spans.select(F.col("id").alias("_id"), F.col("th").alias("_th"),
                         F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))

    def row(t: str | None, low: np.ndarray | None, high: np.ndarray | None) -> tuple:
        data = np.frombuffer(_raw(t), np.uint8)
        if low is None or not len(low):
            return len(data), 0, 0, t if decode else data.tobytes()
        step = np.zeros(len(data) + 1, np.int32)
        np.add.at(step, low, 1)
        np.add.at(step, high + (length - 1), -1)
        gone = np.cumsum(step[:-1]) > 0
        n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        kept = data[~gone].tobytes()
        return len(data), int(gone.sum()), n_spans, kept.decode("utf-8", "ignore") if decode else kept

    @giving_back
    def drop(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), ROWS):
                part = f.iloc[at: at + ROWS]
                made = [row(t, low, high) for t, low, high in zip(part["_text"], part["_lo"], part["_hi"], strict=True)]
                made = pd.DataFrame(made, columns=["n_bytes", "n_removed", "n_spans", "kept"])
                yield pd.concat([part[known].reset_index(drop=True), made], axis=1)

    whole = {c: docs.schema[c].dataType for c in known if isinstance(docs.schema[c].dataType, T.IntegralType)}
    kinds = "".join(f"`{c}` {'string' if c in whole else docs.schema[c].dataType.simpleString()}, " for c in known)
    found = as_text(keyed.join(spans, ["_id", "_th"], "left"), *whole).mapInPandas(
        drop, f"{kinds}n_bytes long, n_removed long, n_spans long, kept {'string' if decode else 'binary'}")
    return found.withColumns({c: F.col(f"`{c}`").cast(kind) for c, kind in whole.items()})


def remove_repeats(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text",
                   most_group: int = MOST_GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay), n_kept (their number) of every document."""
    rows = pick(docs, doc_id=doc_id, text=text)
    return _with_kept(rows, "doc_id", "text", length, most_group).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept", (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` (doc_id, text, n_chars and others) with the kept text; rows that lose nothing are unchanged.

    What a removed run leaves of a character at its edges goes too.
    """
    found = _with_kept(docs, "doc_id", "text", length, MOST_GROUP, decode=True)
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return found.select(*[F.col("kept").alias("text") if c == "text" else n_chars.alias("n_chars") if c == "n_chars"
                          else F.col(f"`{c}`") for c in docs.columns])

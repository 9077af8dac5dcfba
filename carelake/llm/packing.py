"""Packing of documents into sequences of fixed capacity by linear grouping, then best fit.

1. Documents are tokenised; longer ones than a sequence are cut into full pieces, the
   first of which takes the remainder.  The piece table is written once.
2. The plan needs only how many pieces have each length: a histogram of at most
   ``capacity`` rows, whatever the corpus holds.  On it, pieces above ``SMALL`` of the
   capacity are sorted and dealt into groups of equal cardinality, each length rounded up
   to its group's longest; the configuration linear programme over these few sizes is
   solved by column generation (dense simplex, knapsack pricing) and rounded down; the
   actual lengths take the places of the rounded ones; what is left and all small pieces go
   by best fit, longest first, into the fullest sequences that hold them.  This is done for
   several numbers of groups, and with filled configurations kept always or only where the
   actual pieces leave little room; the plan with the fewest sequences is kept.
3. A piece's rank among those of its length gives its sequence and offset.  Ranks come from
   counts by (hash bucket, length), so a length that a third of all pieces share is
   ranked in many tasks.

Defined cases: null text is empty (a single end id); an empty table gives no piece; null and repeated
ids are documents like any other, spread over the buckets by a number of the piece; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from carelake.llm.common import as_number, as_text, give_back, giving_back, pick, written
from carelake.llm.tokens import Encoder, tokenizer_path

END_ID = 0
SMALL = 0.4
#: Numbers of groups, each with the most room that a filled configuration may leave (None: any).
TRIALS = ((24, None), (48, None), (96, None), (48, 64), (48, 16))
BUCKET_ROWS, LEAST_BUCKETS = 200_000, 32
#: Documents tokenised at a time.
ROWS = 500
PIECES = "doc_id string, piece int, start long, length long, ids_crc32 long"


def tokenise(docs: DataFrame, capacity: int, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id (as text), piece, start, length, ids_crc32, nth (its number in its task)."""
    end = np.array([END_ID], dtype="<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "nth"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, nth = Encoder.of(tokenizer), 0
        for batch in batches:
            # texts become Python's a few at a time; a batch may hold 10,000
            for rows in (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS)):
                out: list[tuple] = []
                texts = [t or "" for t in rows.column("text").to_pylist()]
                for key, ids in zip(rows.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                    ids += end
                    n, at, piece = len(ids) // 4, 0, 0
                    while at < n:
                        size = (n - at) % capacity or capacity
                        out.append((key, piece, at, size, zlib.crc32(ids[4 * at: 4 * (at + size)]), nth))
                        at, piece, nth = at + size, piece + 1, nth + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return as_text(pick(docs, doc_id=doc_id, text=text), "doc_id").mapInArrow(giving_back(cut), PIECES + ", nth long")


# --- the plan, from the histogram of lengths -----------------------------------------


def _best_pattern(value: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: how many of each size fill a sequence with the greatest value."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    sizes_up, value_up = sizes[order], value[order]
    for w in range(int(sizes_up[0]), capacity + 1):
        k = np.searchsorted(sizes_up, w, side="right")
        gain = best[w - sizes_up[:k]] + value_up[:k]
        j = int(np.argmax(gain))
        if gain[j] > best[w - 1] + 1e-12:
            best[w], took[w] = gain[j], order[j]
        else:
            best[w] = best[w - 1]
    pattern = np.zeros(len(sizes), np.int64)
    w = capacity
    while w > 0:
        if took[w] < 0:
            w -= 1
            continue
        pattern[took[w]] += 1
        w -= int(sizes[took[w]])
    return float(value @ pattern), pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Column generation for the configuration LP: patterns and how often each is used (rounded down)."""
    k = len(sizes)
    patterns = np.diag(capacity // sizes).astype(float)
    for _ in range(rounds):
        inverse = np.linalg.inv(patterns)
        used = inverse @ demand
        prices = np.ones(k) @ inverse
        worth, pattern = _best_pattern(np.maximum(prices, 0), sizes, capacity)
        if worth <= 1 + 1e-7:
            break
        direction = inverse @ pattern
        ratio = np.full(k, np.inf)
        up = direction > 1e-9
        ratio[up] = np.maximum(used[up], 0) / direction[up]
        patterns[:, int(np.argmin(ratio))] = pattern
    used = np.linalg.solve(patterns, demand)
    return [(patterns[:, j].astype(np.int64), int(used[j] + 1e-6)) for j in range(k) if used[j] + 1e-6 >= 1]


def _grouped(lengths: list[int], counts: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Equal-cardinality groups, longest first: [length, count] runs; a length may span groups."""
    total = sum(counts[x] for x in lengths)
    share = -(-total // groups)
    out: list[list[list[int]]] = [[]]
    room = share
    for x in lengths:
        left = counts[x]
        while left:
            n = min(left, room)
            out[-1].append([x, n])
            left, room = left - n, room - n
            if not room:
                out.append([])
                room = share
    return [g for g in out if g]


def plan(histogram: dict[int, int], capacity: int, groups: int,
         most_room: int | None = None) -> list[tuple[int, list[int]]]:
    """Sequences as (how many, lengths in order) for ``histogram`` (length -> number of pieces)."""
    counts = dict(histogram)
    bins: list[tuple[int, list[int]]] = []
    if full := counts.pop(capacity, 0):
        bins.append((full, [capacity]))
    large = sorted((x for x in counts if x > capacity * SMALL), reverse=True)
    open_bins: list[tuple[int, list[int]]] = []
    if large:
        grouped = _grouped(large, counts, groups)
        merged: dict[int, list[list[int]]] = {}
        for g in grouped:
            merged.setdefault(g[0][0], []).extend(g)
        sizes = np.array(list(merged), dtype=np.int64)
        demand = np.array([sum(n for _, n in merged[s]) for s in merged], dtype=float)
        for pattern, times in configurations(sizes, demand, capacity):
            left = times
            places = [int(s) for s, a in zip(sizes, pattern, strict=True) for _ in range(a)]
            while left:
                # the actual pieces of each rounded size, dealt longest first; stop where any run ends
                need = {s: places.count(s) for s in dict.fromkeys(places)}
                if any(not merged[s] for s in need):
                    break
                if any(merged[s][0][1] < a for s, a in need.items()):
                    actual, n = [], 1
                    for s, a in need.items():
                        for _ in range(a):
                            if not merged[s]:
                                break
                            actual.append(merged[s][0][0])
                            merged[s][0][1] -= 1
                            if not merged[s][0][1]:
                                merged[s].pop(0)
                else:
                    n = min(left, *(merged[s][0][1] // a for s, a in need.items()))
                    actual = [merged[s][0][0] for s in places]
                    for s, a in need.items():
                        merged[s][0][1] -= n * a
                        if not merged[s][0][1]:
                            merged[s].pop(0)
                left -= n
                if most_room is None or capacity - sum(actual) <= most_room:
                    open_bins.append((n, actual))
                    for x in set(actual):
                        counts[x] -= n * actual.count(x)
    # best fit, longest first; bins are kept by room, equal ones together
    by_room: dict[int, list[tuple[int, list[int]]]] = {}
    rooms: list[int] = []

    def put(n: int, items: list[int], room: int) -> None:
        if not n:
            return
        if room not in by_room:
            by_room[room] = []
            bisect.insort(rooms, room)
        by_room[room].append((n, items))

    for n, items in open_bins:
        put(n, items, capacity - sum(items))
    for x in sorted((x for x, n in counts.items() if n), reverse=True):
        left = counts[x]
        while left:
            at = bisect.bisect_left(rooms, x)
            if at == len(rooms):
                room, n, items = capacity, left, []
            else:
                room = rooms[at]
                n, items = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(at)
            m = room // x
            whole = min(n, left // m)
            put(whole, items + [x] * m, room - m * x)
            left -= whole * m
            if whole < n and 0 < left < m:
                put(1, items + [x] * left, room - left * x)
                left, whole = 0, whole + 1
            if items:
                put(n - whole, items, room)
    return bins + [b for room in rooms for b in by_room[room]]


def best_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """The plan with the fewest sequences over ``TRIALS``."""
    found = [plan(histogram, capacity, *trial) for trial in TRIALS]
    return min(found, key=lambda bins: sum(n for n, _ in bins)) if histogram else []


def _places(bins: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first ranks, first sequences and offsets of its runs of places."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    first = 0
    for n, items in bins:
        offset = 0
        for x in items:
            r = ranks.get(x, 0)
            out.setdefault(x, []).append((r, first, offset))
            ranks[x], offset = r + n, offset + x
        first += n
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) for x, rows in out.items()}


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece with its place: the columns of ``PIECES``, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = written(tokenise(docs, capacity, tokenizer or tokenizer_path(), doc_id, text), "pieces")
    # at most `capacity` rows come back
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = spark.sparkContext.broadcast(_places(best_plan(histogram, capacity)))
    buckets = max(LEAST_BUCKETS, -(-sum(histogram.values()) // BUCKET_ROWS))
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", "nth"), F.lit(buckets)))
    counts = keyed.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # names of its own: both sides come from one table, whose columns Spark would otherwise confuse when it prunes them
    offsets = counts.select(F.col("bucket").alias("in_bucket"), F.col("length").alias("of_length"),
                            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ranked"))

    def place(rows: pd.DataFrame, ranked: pd.DataFrame) -> pd.DataFrame:
        give_back()
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32", "nth"], kind="stable")
        base = dict(zip(ranked["of_length"], ranked["ranked"], strict=True))
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        lengths = rows["length"].to_numpy()
        edges = np.r_[0, np.flatnonzero(np.diff(lengths)) + 1, len(lengths)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            first_rank, first_sequence, at = places.value[int(lengths[a])]
            rank = base[lengths[a]] + np.arange(b - a)
            run = np.searchsorted(first_rank, rank, side="right") - 1
            sequence[a:b] = first_sequence[run] + rank - first_rank[run]
            offset[a:b] = at[run]
        return rows.drop(columns=["bucket", "nth"]).assign(sequence_id=sequence, offset=offset)

    return as_number(keyed.groupBy("bucket").cogroup(offsets.groupBy("in_bucket"))
                     .applyInPandas(place, PIECES + ", sequence_id long, offset long"), "doc_id")

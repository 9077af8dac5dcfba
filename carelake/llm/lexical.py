"""Ranked lexical search with hashed max-sketches.

A score is the sum over the item's terms of weight * impact; weights come from document counts,
impacts from a term's occurrences and the document's length, all in 64-bit integers.

1. **Index** (one scan of the texts, written): a document's term hashes are folded into ``COORDS``
   coordinates, each with the greatest number of occurrences of its terms.  A document's impact
   grows with the occurrences, so the impact of that maximum is the maximum of the impacts; stored
   this way the sketch needs no corpus statistics and holds only its coordinates that aren't zero.  Beside the sketches,
   each task writes the document counts of its terms' hashes.
2. **Bounds**: items go in blocks; one scan of the sketches per block looks the coordinates of all
   terms of the block up and multiplies them with the weights.  Different terms in one coordinate can
   only raise a sum, so it bounds the score from above.  Each task keeps its ``KEPT`` best per item.
3. **Rescoring**: the documents of the ``FIRST`` highest bounds of an item are scored exactly from
   their texts, which gives a threshold: the ``k``-th best score (and id) so far.  Then all others
   whose bound reaches it are scored.  Where a task may have left such documents out, the sketches are
   read again for these items with the threshold, so the result is exact at any size.

Terms are compared by 64-bit hashes of their bytes.  Defined cases: null or empty texts (and texts without terms) are
in no ranking and don't count; rows that share an item id are one item with all their different texts; repeated rows
of documents are documents of their own, which count and rank one by one; of equal scores the smaller id comes first, null ids last;
texts of any length are read whole; empty tables give no row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from carelake.llm.common import LOWER, Rolling, may_be_among, mix64, pick, written

COORDS = 1 << 16
#: Occurrences are stored in a byte; this value stands for itself and all above, whose impact is below MOST.
MANY, MOST = 255, 1_000_000
KEPT, FIRST, SALTS = 32, 64, 16
#: Bounds of a block of items and of what is sent to tasks for it; a single item may exceed the second.
BLOCK_ITEMS, BLOCK_TERMS = 256, 1 << 14
#: Hashes that a task holds before it writes their counts; documents that meet a block of items at once.
HELD, ROWS = 1 << 21, 256
TEXT_BLOCK = 1 << 20

_TERM = np.zeros(256, bool)
_TERM[0x30:0x3A] = _TERM[0x41:0x5B] = _TERM[0x61:0x7B] = _TERM[0x80:] = True


class Terms:
    """64-bit hashes of the terms of texts, in blocks cut between terms."""

    def __init__(self):
        self.rolling = Rolling(TEXT_BLOCK + (1 << 12))

    def of(self, texts: pa.Array) -> list[np.ndarray]:
        """One sorted array of hashes, with repeats, per text; null texts have none."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not len(texts):
            return []
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8) if at[-1] > at[0] else np.zeros(0, np.uint8)
        docs, hashes, low = [], [], int(at[0])
        while low < at[-1]:
            high = self._cut(data, at, low)
            starts, found = self._block(data, at, low, high)
            docs.append(np.searchsorted(at, starts, "right") - 1)
            hashes.append(found)
            low = high
        if not docs:
            return [np.zeros(0, np.uint64)] * len(texts)
        edges = np.searchsorted(np.concatenate(docs), np.arange(len(texts) + 1))
        every = np.concatenate(hashes)
        return [np.sort(every[a:b]) for a, b in zip(edges, edges[1:])]

    @staticmethod
    def _cut(data: np.ndarray, at: np.ndarray, low: int) -> int:
        """The end of the block from ``low``: the end of a text, or else between two terms of a long one."""
        end = min(low + TEXT_BLOCK, int(at[-1]))
        text = int(at[np.searchsorted(at, end, "right") - 1])
        if text > low:
            return text
        stop = int(at[np.searchsorted(at, low, "right")])
        while end < stop and _TERM[data[end]]:
            gap = np.flatnonzero(~_TERM[data[end: min(end + TEXT_BLOCK, stop)]])
            end = end + int(gap[0]) if len(gap) else min(end + TEXT_BLOCK, stop)
        return end

    def _block(self, data: np.ndarray, at: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.rolling.up) <= high - low:
            self.rolling = Rolling(high - low + (high - low) // 4)
        part = data[low:high]
        inside = _TERM[part]
        first = np.zeros(len(part) + 1, bool)
        texts = at[np.searchsorted(at, low): np.searchsorted(at, high, "right")]
        first[texts - low] = True
        first[0] = first[-1] = True
        before = np.concatenate([[False], inside[:-1]])
        starts = np.flatnonzero(inside & (~before | first[:-1]))
        after = np.concatenate([inside[1:], [False]])
        ends = np.flatnonzero(inside & (~after | first[1:])) + 1
        found = self.rolling.ranges(self.rolling.prefix(LOWER[part]), starts, ends)
        return starts + low, found ^ mix64((ends - starts).astype(np.uint64))


def coordinate(hashes: np.ndarray) -> np.ndarray:
    """The coordinate of term hashes, ascending as these are: their upper 16 bits."""
    return (hashes >> np.uint64(48)).astype(np.uint16)


def counted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values of a sorted array and how often each occurs."""
    edge = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[edge], np.diff(np.append(edge, len(hashes)))


def _merged(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    edge = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return hashes[edge], np.add.reduceat(counts, edge)


INDEX = "doc_id long, n long, coords binary, tfs binary, hashes binary, counts binary"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sketch per document, and the document counts of the task's term hashes in rows of bounded size."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), *[(c, pa.binary()) for c in ("coords", "tfs", "hashes", "counts")]])
    terms, known, loose, held = Terms(), (np.zeros(0, np.uint64), np.zeros(0, np.int64)), [], 0

    def vocabulary():
        return pa.record_batch([[None], [None], [None], [None], [known[0].tobytes()], [known[1].tobytes()]], schema=schema)

    for batch in batches:
        rows = []
        for hashes in terms.of(batch.column("text")):
            found, tf = counted(hashes)
            coords = coordinate(found)
            edge = np.flatnonzero(np.concatenate([[True], coords[1:] != coords[:-1]])) if len(coords) else []
            tf = np.maximum.reduceat(np.minimum(tf, MANY), edge).astype(np.uint8) if len(coords) else np.zeros(0, np.uint8)
            coords = coords[edge] if len(coords) else coords
            rows.append((len(hashes), np.diff(coords, prepend=np.uint16(0)).astype("<u2").tobytes(), tf.tobytes()))
            loose.append(found)
            held += len(found)
            if held >= HELD:
                new = counted(np.sort(np.concatenate(loose)))
                known = _merged(np.concatenate([known[0], new[0]]), np.concatenate([known[1], new[1]]))
                loose, held = [], 0
                if len(known[0]) >= HELD:
                    yield vocabulary()
                    known = (known[0][:0], known[1][:0])
        empty = pa.nulls(len(rows), pa.binary())
        yield pa.record_batch([batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()),
                               pa.array([r[2] for r in rows], pa.binary()), empty, empty], schema=schema)
    if loose:
        new = counted(np.sort(np.concatenate(loose)))
        known = _merged(np.concatenate([known[0], new[0]]), np.concatenate([known[1], new[1]])) if len(new[0]) + len(known[0]) else known
    if len(known[0]):
        yield vocabulary()


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Sketches and document counts of all rows, written to the shared folder."""
    return written(pick(docs, doc_id=doc_id, text=text).mapInArrow(_index, INDEX), "sketches")


class Block:
    """A block of items: their terms, weights and the weights by coordinate."""

    def __init__(self, items: list[tuple[int, list[np.ndarray]]]):
        self.ids = [i for i, _ in items]
        self.own = [counted(np.sort(np.concatenate(h))) if h else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for _, h in items]
        self.terms = np.unique(np.concatenate([t for t, _ in self.own]))

    def weigh(self, df: dict[int, int], n_docs: int, n_terms: int) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        weight = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1)))
        self.weights = [np.array([c * weight(t) for t, c in zip(terms.tolist(), counts.tolist())], np.int64) for terms, counts in self.own]
        coords = np.unique(coordinate(self.terms))
        self.column = np.full(COORDS, -1, np.int32)
        self.column[coords] = np.arange(len(coords))
        self.matrix = np.zeros((len(coords), len(self.ids)))
        for i, ((terms, _), w) in enumerate(zip(self.own, self.weights)):
            np.add.at(self.matrix, (self.column[coordinate(terms)], i), w)

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """m of documents of n terms."""
        return np.array([75 + 25 * int(x) * self.n_docs // self.n_terms for x in n], np.int64)

    def bounds(self, n: np.ndarray, coords: list[bytes], tfs: list[bytes]) -> np.ndarray:
        """Upper bounds of the scores, one row per document, one column per item."""
        sizes = np.array([len(t) for t in tfs])
        tf = np.frombuffer(b"".join(tfs), np.uint8).astype(np.int64)
        steps = np.frombuffer(b"".join(coords), "<u2").astype(np.int64).cumsum()
        ends = sizes.cumsum()
        start = np.concatenate([[0], steps])[ends - sizes]
        column = self.column[steps - start.repeat(sizes)]
        used = np.flatnonzero(column >= 0)
        doc = np.arange(len(sizes)).repeat(sizes)[used]
        tf, m = tf[used], self.lengths(n)[doc]
        impact = np.where(tf < MANY, 1_000_000_000 * tf // (1000 * tf + 12 * m), MOST)
        found = np.zeros((len(sizes), len(self.matrix)))
        found[doc, column[used]] = impact
        return found @ self.matrix  # whole numbers below 2**53: exact

    def score(self, item: int, n: int, terms: np.ndarray, tf: np.ndarray) -> int:
        own, weights = self.own[item][0], self.weights[item]
        if not len(terms):
            return 0
        at = np.minimum(np.searchsorted(terms, own), len(terms) - 1)
        there = terms[at] == own
        tf = tf[at[there]].astype(np.int64)
        m = self.lengths([n])[0]
        return int((weights[there] * (1_000_000_000 * tf // (1000 * tf + 12 * m))).sum())


FOUND = "item int, no_id boolean, doc_id long, bound long, task int"


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column("doc_id")
    return pc.is_null(ids).to_numpy(zero_copy_only=False), pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)


def _best_bounds(block, limits=None):
    """Per task the KEPT best bounds of every item; with limits (item: bound, id) all that reach them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, task = block.value, TaskContext.get().partitionId()
        items = len(b.ids)
        kept = [np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        least = np.ones(items)
        if limits is not None:
            least = np.array([limits[i][0] if i in limits else np.inf for i in range(items)])

        def rows(item, no_id, doc_id, bound):
            return pa.record_batch([pa.array(item, pa.int32()), pa.array(no_id), pa.array(doc_id, pa.int64()), pa.array(bound, pa.int64()),
                                    pa.array(np.full(len(item), task), pa.int32())], names=[c.split()[0] for c in FOUND.split(", ")])

        for batch in batches:
            no_id, ids = _keys(batch)
            n, coords, tfs = batch.column("n").to_numpy(), batch.column("coords").to_pylist(), batch.column("tfs").to_pylist()
            for low in range(0, len(ids), ROWS):
                part = slice(low, low + ROWS)
                bounds = b.bounds(n[part], coords[part], tfs[part])
                doc, item = np.nonzero((bounds >= least) & (bounds > 0))
                new = [item, no_id[part][doc], ids[part][doc], bounds[doc, item].astype(np.int64)]
                if limits is not None:
                    if len(item):
                        yield rows(*new)
                    continue
                kept = [np.concatenate(x) for x in zip(kept, new)]
                order = np.lexsort((kept[2], kept[1], -kept[3], kept[0]))
                kept = [x[order] for x in kept]
                rank = np.arange(len(order)) - np.searchsorted(kept[0], kept[0])
                kept = [x[rank < KEPT] for x in kept]
                last = np.flatnonzero(rank[rank < KEPT] == KEPT - 1)
                least[kept[0][last]] = kept[3][last]
        if len(kept[0]):
            yield rows(*kept)

    return run


def _exact(block):
    """Exact scores of documents (no_id, doc_id, text) for the items listed with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, terms = block.value, Terms()
        for batch in batches:
            out, no_id = [], batch.column("no_id").to_pylist()
            for i, doc, hashes, items in zip(no_id, batch.column("doc_id").to_pylist(), terms.of(batch.column("text")), batch.column("items").to_pylist()):
                found, tf = counted(hashes)
                out += [(k, i, doc, b.score(k, len(hashes), found, tf)) for k in items]
            yield pa.record_batch([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.bool_()),
                                   pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.int64())],
                                  names=["item", "no_id", "doc_id", "score"])

    return run


def _top(rows: DataFrame, by: str, k: int, spread) -> DataFrame:
    """The k best rows of each item, first within salts: no item's rows meet in one task before they are cut."""
    order = [F.col(by).desc(), F.col("no_id"), F.col("doc_id")]
    cut = rows.withColumn("_salt", F.pmod(spread, F.lit(SALTS)))
    cut = cut.withColumn("rank", F.row_number().over(Window.partitionBy("item", "_salt").orderBy(*order))).where(F.col("rank") <= k)
    return cut.drop("_salt").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def _rescored(docs: DataFrame, wanted: DataFrame, block, few: bool) -> DataFrame:
    """Exact scores of the (item, no_id, doc_id) wanted, written; ``few``: at most FIRST an item of one block."""
    by_doc = wanted.groupBy("no_id", "doc_id").agg(F.collect_list("item").alias("items"))
    rows = docs.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text")
    if few:
        by_doc = F.broadcast(by_doc)
    else:  # only texts that may be wanted are shuffled
        rows = rows.where(may_be_among(wanted.select("doc_id").distinct())(F.col("doc_id")))
    found = rows.join(by_doc, ["no_id", "doc_id"]).select("no_id", "doc_id", "text", "items")
    return written(found.mapInArrow(_exact(block), "item int, no_id boolean, doc_id long, score long"), "scores")


def _search_block(spark: SparkSession, docs: DataFrame, sketches: DataFrame, block: Block, k: int) -> DataFrame:
    shared = spark.sparkContext.broadcast(block)
    bounds = written(sketches.where("coords is not null").select("doc_id", "n", "coords", "tfs").mapInArrow(_best_bounds(shared), FOUND), "bounds")
    keys = ["item", "no_id", "doc_id"]
    first = written(_top(bounds, "bound", FIRST, F.col("task")).select(*keys).distinct(), "first")
    scores = _rescored(docs, first, shared, True)

    def limits() -> dict[int, tuple[int, bool, int]]:
        """What a document must reach per item: the k-th best so far, or any score above 0."""
        last = _top(scores, "score", k, F.xxhash64("doc_id")).where(F.col("rank") == k).collect()
        return {r["item"]: (r["score"], r["no_id"], r["doc_id"]) for r in last if r["score"] > 0}

    def reaching(rows: DataFrame, at: dict) -> DataFrame:
        each = [(i, *at.get(i, (0, True, (1 << 63) - 1))) for i in range(len(block.ids))]
        lines = F.broadcast(spark.createDataFrame(each, "item int, least long, least_no_id boolean, least_id long"))
        better = (F.col("bound") > F.col("least")) | ((F.col("bound") == F.col("least")) & (
            F.struct("no_id", "doc_id") < F.struct(F.col("least_no_id").alias("no_id"), F.col("least_id").alias("doc_id"))))
        return rows.join(lines, "item").where(better)

    at = limits()
    more = reaching(bounds, at).select(*keys).distinct().join(first, keys, "left_anti")
    more = written(more, "more")
    if not more.isEmpty():
        scores = scores.unionByName(_rescored(docs, more, shared, False))
        at = limits()
    # tasks whose last kept bound still reaches the threshold may have left documents out
    full = bounds.groupBy("task", "item").agg(F.count(F.lit(1)).alias("n"), F.min("bound").alias("bound")).where(F.col("n") == KEPT)
    lines = spark.createDataFrame([(i, at.get(i, (0,))[0]) for i in range(len(block.ids))], "item int, least long")
    open_items = [r["item"] for r in full.join(F.broadcast(lines), "item").where("bound >= least").select("item").distinct().collect()]
    if open_items:
        rest = sketches.where("coords is not null").select("doc_id", "n", "coords", "tfs").mapInArrow(
            _best_bounds(shared, {i: at.get(i, (1, True, 0)) for i in open_items}), FOUND)
        rest = reaching(rest, at).select(*keys).distinct().join(first.unionByName(more), keys, "left_anti")
        rest = written(rest, "rest")
        if not rest.isEmpty():
            scores = scores.unionByName(_rescored(docs, rest, shared, False))
    names = F.broadcast(spark.createDataFrame(list(enumerate(block.ids)), "item int, item_id long"))
    best = _top(scores.where("score > 0"), "score", k, F.xxhash64("doc_id")).join(names, "item")
    return written(best.select("item_id", "rank", F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "score"), "best")


def _blocks(items: DataFrame) -> Iterator[Block]:
    """Items in blocks of bounded size; rows of one item follow each other."""
    terms, now, size = Terms(), [], 0
    for r in items.orderBy(F.col("item_id").asc_nulls_first(), "text").toLocalIterator():
        hashes = terms.of(pa.array([r["text"]], pa.string()))
        if now and now[-1][0] == r["item_id"]:
            now[-1][1].extend(hashes)
            size += len(hashes[0])
            continue
        if len(now) >= BLOCK_ITEMS or size >= BLOCK_TERMS:
            yield Block(now)
            now, size = [], 0
        now.append((r["item_id"], hashes))
        size += len(hashes[0])
    if now:
        yield Block(now)


def search(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``k`` documents of the highest score above 0 of every item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    docs = pick(docs, doc_id=doc_id, text=text)
    sketches = index(docs)
    n_docs, n_terms = sketches.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in _blocks(pick(items, item_id=item_id, text=item_text).distinct()) if n_docs else ():
        wanted = spark.sparkContext.broadcast(block.terms)
        block.weigh(_document_counts(sketches, wanted), n_docs, n_terms)
        out = out.unionByName(_search_block(spark, docs, sketches, block, k))
    return out


def _document_counts(sketches: DataFrame, wanted) -> dict[int, int]:
    """In how many documents each wanted term hash occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = wanted.value
        for batch in batches:
            for hashes, counts in zip(batch.column("hashes").to_pylist(), batch.column("counts").to_pylist()):
                own, counts = np.frombuffer(hashes, np.uint64), np.frombuffer(counts, np.int64)
                at = np.minimum(np.searchsorted(own, terms), len(own) - 1)
                there = own[at] == terms
                yield pa.record_batch([pa.array(terms[there].view(np.int64)), pa.array(counts[at[there]])], names=["term", "n"])

    parts = sketches.where("hashes is not null").select("hashes", "counts").mapInArrow(run, "term long, n long")
    return {r["term"] % (1 << 64): r["n"] for r in parts.groupBy("term").agg(F.sum("n").alias("n")).collect()}


_CLASS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWERED}'), '{_CLASS}')) AS term FROM documents
), q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWERED}'), '{_CLASS}')) AS term FROM benchmark
), qc AS (SELECT item_id, term, count(*) AS c FROM q GROUP BY item_id, term
), lengths AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id
), stats AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM lengths
), tfs AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term
), w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs CROSS JOIN stats GROUP BY term, nd
), s AS (
  SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // l)))) AS BIGINT) AS score
  FROM qc JOIN w USING (term) JOIN tfs USING (term) JOIN lengths USING (doc_id) CROSS JOIN stats GROUP BY item_id, doc_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""

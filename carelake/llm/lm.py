"""Language-model scores by stupid backoff, from n-gram counts over all documents.

A document is scored by the counts of all other documents (its own are taken off):
``S(w|v) = c(vw)/c(v)`` where the n-gram occurs, else ``BACKOFF * S(w|shorter v)``, down to
``c(w)/N``; a word that occurs nowhere else counts as one of N.  Words are lower-cased (A-Z)
runs of characters other than ASCII white space.

The work is a relational one: explode, count by key, join the counts back, sum per document.
So that a corpus' worth of single n-grams needn't be rows, the rows are packed: documents
fall into blocks, and a row holds one block's distinct n-grams of one hash partition as
sorted 64-bit hashes with counts.  Count tables are grouped by hash partition, where the
blocks' counts are added and handed back aligned with the block's own n-grams; blocks
then meet their documents again and sum.  A frequent n-gram is one entry per block, so no key
gathers more than that; every count covers every document.

Defined cases: null, empty or blank text has no tokens, log_score 0 and a null mean; rows with
equal or null ids are separate documents; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from carelake.llm.common import Words, as_number, as_text, gram_hashes, pick, written

ORDER, BACKOFF = 2, 0.4
BLOCK_ROWS, PARTITION_BYTES = 4096, 8 << 20


def _blocked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """block, doc_id, text: rows of a file in runs of ``BLOCK_ROWS``; hashed ids where rows have no file."""
    try:
        at = docs.select(F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / BLOCK_ROWS)).alias("block"),
                         F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
        at.schema  # noqa: B018  fails here where the rows come from no file
        return at
    except AnalysisException:
        rows = pick(docs, doc_id=doc_id, text=text)
        blocks = -(-rows.count() // BLOCK_ROWS) or 1
        return rows.select(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(blocks)).alias("block"), "doc_id", "text").repartition("block")


def _distinct(blocks: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    grams = np.concatenate([gram_hashes(w, n) for w in blocks]) if blocks else np.zeros(0, np.uint64)
    return np.unique(grams, return_counts=True)


def score(docs: DataFrame, order: int = ORDER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_score (natural log, summed over the document), mean_log."""
    rows = _blocked(docs, doc_id, text)
    # a power of two of hash partitions, by the bytes of text
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(5, int(np.ceil(np.log2(max(1, size / PARTITION_BYTES)))))
    shift = np.uint64(64 - bits)
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << shift

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, block, held, rows_held = Words(), None, [], 0

        def packed() -> Iterator[pd.DataFrame]:
            for n in range(1, order + 1):
                keys, counts = _distinct(held, n)
                cuts = np.r_[0, np.searchsorted(keys, edges), len(keys)]
                out = [(block, n, p, keys[a:b].tobytes(), counts[a:b].astype("<u4").tobytes())
                       for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
                if out:
                    yield pd.DataFrame(out, columns=["block", "n", "part", "keys", "counts"])

        for f in frames:
            for key, t in zip(f["block"], f["text"], strict=True):
                if key != block or rows_held >= BLOCK_ROWS:
                    yield from packed()
                    block, held, rows_held = key, [], 0
                held.append(words.hashes(t))
                rows_held += 1
        yield from packed()

    tables = rows.mapInPandas(count, "block long, n int, part int, keys binary, counts binary")

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(k, np.uint64) for k in rows["keys"]]
        counts = np.concatenate([np.frombuffer(c, "<u4") for c in rows["counts"]]).astype(np.int64)
        every, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(where, counts, len(every)).astype(np.int64)
        out = []
        for block, some in rows.groupby("block", sort=False).indices.items():
            place = np.unique(np.concatenate([keys[i] for i in some])) if len(some) > 1 else keys[some[0]]
            out.append((block, rows["n"].iloc[0], rows["part"].iloc[0], total[np.searchsorted(every, place)].tobytes(), int(total.sum())))
        return pd.DataFrame(out, columns=["block", "n", "part", "totals", "mass"])

    back = written(tables.groupBy("n", "part").applyInPandas(add, "block long, n int, part int, totals binary, mass long"), "totals")
    words_total = back.where("n = 1").groupBy("part").agg(F.max("mass").alias("mass")).agg(F.coalesce(F.sum("mass"), F.lit(0))).first()[0]

    def total(documents: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        words = Words()
        texts = [words.hashes(t) for t in documents["text"]]
        sizes = np.array([len(t) for t in texts])
        counted = counted.sort_values(["n", "part"])
        # per order: what all other documents count of each n-gram occurrence, documents in a row
        left: dict[int, np.ndarray] = {}
        starts: dict[int, np.ndarray] = {}
        for n in range(1, order + 1):
            grams = np.concatenate([gram_hashes(t, n) for t in texts])
            place = np.unique(grams, return_inverse=True)[1].astype(np.int32)
            del grams
            found = np.frombuffer(b"".join(counted.loc[counted["n"] == n, "totals"]), np.int64)
            starts[n] = np.cumsum(np.r_[0, np.maximum(sizes - n + 1, 0)])
            left[n] = found[place] if len(place) else found[:0]
            for a, b in zip(starts[n][:-1], starts[n][1:], strict=True):
                _, at, own = np.unique(place[a:b], return_inverse=True, return_counts=True)
                left[n][a:b] -= own[at]
        out = np.zeros(len(texts))
        for d, size in enumerate(sizes):
            if not size:
                continue
            rest = max(words_total - int(size), 1)
            one = left[1][starts[1][d]: starts[1][d + 1]]
            logs = np.log(np.maximum(one, 1) / rest)
            shorter = one
            for n in range(2, min(order, size) + 1):
                now = left[n][starts[n][d]: starts[n][d + 1]]
                context = shorter[: len(now)]
                logs[n - 1:] = np.where(now > 0, np.log(np.maximum(now, 1) / np.maximum(context, 1)), np.log(BACKOFF) + logs[n - 1:])
                shorter = now
            out[d] = logs.sum()
        return pd.DataFrame({"doc_id": documents["doc_id"].to_numpy(), "n_tokens": sizes, "log_score": out,
                             "mean_log": [s / n if n else None for s, n in zip(out, sizes, strict=True)]})

    return as_number(as_text(rows, "doc_id").groupBy("block").cogroup(back.groupBy("block")).applyInPandas(
        total, "doc_id string, n_tokens long, log_score double, mean_log double"), "doc_id")


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^ \t-\r]+') AS words FROM documents
), o AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM t
), n AS (SELECT sum(len(words)) AS total FROM t
), p AS (SELECT a.doc_id, a.i, a.w, b.w AS v FROM o a LEFT JOIN o b ON a.doc_id = b.doc_id AND b.i = a.i - 1
), u AS (SELECT w, count(*) AS c FROM o GROUP BY w
), ud AS (SELECT doc_id, w, count(*) AS c FROM o GROUP BY doc_id, w
), b AS (SELECT v, w, count(*) AS c FROM p WHERE v IS NOT NULL GROUP BY v, w
), bd AS (SELECT doc_id, v, w, count(*) AS c FROM p WHERE v IS NOT NULL GROUP BY doc_id, v, w
), s AS (
  SELECT p.doc_id,
         ln(greatest(u.c - ud.c, 1) / greatest(n.total - len(t.words), 1)) AS one,
         CASE WHEN p.v IS NULL THEN NULL ELSE b.c - bd.c END AS pair,
         uv.c - uvd.c AS context
  FROM p JOIN t ON p.doc_id = t.doc_id CROSS JOIN n
  JOIN u ON p.w = u.w JOIN ud ON p.w = ud.w AND p.doc_id = ud.doc_id
  LEFT JOIN b ON p.v = b.v AND p.w = b.w LEFT JOIN bd ON p.v = bd.v AND p.w = bd.w AND p.doc_id = bd.doc_id
  LEFT JOIN u uv ON p.v = uv.w LEFT JOIN ud uvd ON p.v = uvd.w AND p.doc_id = uvd.doc_id
), l AS (
  SELECT doc_id, CASE WHEN pair IS NULL THEN one WHEN pair > 0 THEN ln(pair / greatest(context, 1)) ELSE ln(0.4) + one END AS x FROM s
), d AS (SELECT doc_id, sum(x) AS x FROM l GROUP BY doc_id)
SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_tokens, round(coalesce(d.x, 0), 4) AS log_score, round(d.x / len(words), 6) AS mean_log
FROM t LEFT JOIN d ON t.doc_id = d.doc_id
"""

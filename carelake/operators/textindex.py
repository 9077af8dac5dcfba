"""Substring index for the search of a listing (T1): trigram posting lists per block of rows.

The rows are written once in blocks of ``BLOCK_ROWS``, and for every three characters in a row's text the blocks
that hold them, as posting lists of at most ``CHUNK`` blocks each.  A term can only be in blocks that hold all of its
trigrams; only those are read, and each of their rows is judged by the literal rule of ``tableview.search``, so
the result is that of the scan.  Terms of fewer than three characters have no trigram and scan all blocks.

Blocks follow the order of the rows as given: a listing sorted by what users search for has its hits in few blocks.
Trigrams are cut by code points in one pass over the joined texts of a block, so that each is met once per block; a set of up
to ``GROUP`` blocks that follow each other goes on as the bits of one number.  Those that span two rows' texts are
listed too: they name blocks that are read in vain for a term with a line break, never one too few.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tableview as TV

GRAM, BLOCK_ROWS, CHUNK = 3, 1024, 4096
#: Blocks whose set is one 64-bit number.
GROUP = 64
#: Bytes of a row group, the least that a scan can skip.
ROW_GROUP = 4 << 20
#: Up to so many blocks are named to the scan, as at most so many ranges; more are joined.
FEW_BLOCKS, MOST_RANGES = 20_000, 64


@dataclass
class Found:
    """``rows`` that hold the term; ``read`` of the ``blocks`` blocks are read for it."""

    rows: DataFrame
    read: int
    blocks: int


def _grams(text: Column) -> Column:
    """The different trigrams of a text; the match ahead steps by one code point, so that they overlap."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))."), F.lit(1)))


def _lists(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``gram``, ``chunk``, ``blocks``: the posting lists of rows with their ``_block``.

    Blocks that follow each other lie in one task: it joins the texts of each, cuts them, and hands on one row
    per trigram and ``GROUP`` blocks."""
    by_group = rows.select(F.shiftright("_block", GROUP.bit_length() - 1).alias("_group"), "_block", TV.row_text(rows, columns).alias("_text")).repartition("_group")
    joined = by_group.groupBy("_group", "_block").agg(F.concat_ws("\n", F.collect_list("_text")).alias("_text"))
    held = joined.select("_group", "_block", F.explode(_grams(F.col("_text"))).alias("gram"))
    bits = held.groupBy("_group", "gram").agg(F.expr(f"bit_or(shiftleft(1L, cast(_block % {GROUP} as int)))").alias("_bits"))
    named = bits.withColumn("_blocks", F.expr(
        f"transform(filter(sequence(0, {GROUP - 1}), i -> getbit(_bits, i) = 1), i -> _group * {GROUP} + i)"))
    chunk = F.floor(F.col("_group") * GROUP / CHUNK).alias("chunk")
    return named.groupBy("gram", chunk).agg(F.flatten(F.collect_list("_blocks")).alias("blocks"))


class TextIndex:
    """The index under ``path``: ``rows`` (the listing with ``_block``) and ``postings`` (``gram``, ``chunk``, ``blocks``)."""

    def __init__(self, rows: DataFrame, postings: DataFrame, columns: Sequence[str]):
        self._rows, self._postings, self.columns = rows, postings, list(columns)
        self.blocks = rows.select("_block").distinct().count()

    @staticmethod
    def build(listing: DataFrame, path: str, columns: Sequence[str] | None = None) -> "TextIndex":
        """Write the index of a listing; ``columns`` are the cells that are searched (all, if none are named)."""
        spark, names = listing.sparkSession, list(columns) if columns is not None else listing.columns
        shift = BLOCK_ROWS.bit_length() - 1
        # numbers within a task's rows: the blocks are those of the rows as written, read back below
        numbered = listing.withColumn("_block", F.shiftright(F.monotonically_increasing_id(), shift))
        numbered.write.option("parquet.block.size", ROW_GROUP).parquet(f"{path}/rows")
        rows = spark.read.schema(numbered.schema).parquet(f"{path}/rows")
        (_lists(rows, names).repartitionByRange("gram", "chunk").sortWithinPartitions("gram", "chunk")
         .write.option("parquet.block.size", ROW_GROUP).parquet(f"{path}/postings"))
        return TextIndex.load(spark, path, names)

    @staticmethod
    def load(spark, path: str, columns: Sequence[str] | None = None) -> "TextIndex":
        rows = spark.read.parquet(f"{path}/rows")
        return TextIndex(rows, spark.read.parquet(f"{path}/postings"), columns or [c for c in rows.columns if c != "_block"])

    def candidates(self, term: str) -> DataFrame | None:
        """``_block`` of each block that holds all trigrams of a term; None where the term has none."""
        norm = term.strip().lower()
        grams = sorted({norm[i: i + GRAM] for i in range(len(norm) - GRAM + 1)})
        if not grams:
            return None
        hits = self._postings.where(F.col("gram").isin(grams)).select(F.explode("blocks").alias("_block"))
        return hits.groupBy("_block").count().where(F.col("count") == len(grams)).select("_block")

    def search(self, term: str | None) -> Found:
        """T1 over the index: the rows of the listing whose text contains ``term``; a blank term keeps every row."""
        keep = TV.search_predicate(self._rows.drop("_block"), term, self.columns)
        blocks = self.candidates(term or "")
        if blocks is None:
            return Found(self._rows.where(keep).drop("_block"), self.blocks, self.blocks)
        first = sorted(r[0] for r in blocks.limit(FEW_BLOCKS + 1).collect())
        if len(first) > FEW_BLOCKS:
            read = blocks.count()
            rows = self._rows.join(blocks, "_block", "left_semi")
        else:
            read = len(first)
            named = self._rows.sparkSession.createDataFrame([(b,) for b in first], "_block long")
            rows = self._rows.where(_within(first)).join(F.broadcast(named), "_block", "left_semi")
        return Found(rows.where(keep).drop("_block"), read, self.blocks)


def _within(blocks: list[int]) -> Column:
    """A predicate that the scan can use to skip row groups: the blocks as ranges, split at their widest gaps."""
    if not blocks:
        return F.lit(False)
    gaps = sorted((i for i in range(1, len(blocks)) if blocks[i] > blocks[i - 1] + 1), key=lambda i: blocks[i - 1] - blocks[i])
    starts = sorted([0, *gaps[: MOST_RANGES - 1]])
    found = F.lit(False)
    for a, b in zip(starts, [*starts[1:], len(blocks)], strict=True):
        found = found | F.col("_block").between(blocks[a], blocks[b - 1])
    return found

"""The corpus pipeline: quality filter, near-duplicate removal, repeated passages out, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next stage's docs.  All but the
last return the columns of ``documents`` (doc_id, text, lang, source, n_chars); extra columns
of the input are dropped, missing lang or source become null.  Null text counts as empty in
every stage and stays null where a stage doesn't change it; an empty table passes through.
"""

from __future__ import annotations

from carelake.llm import jaccard, packing, quality, repeats
from carelake.llm.common import importable, may_be_among, written
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*[(F.col(f"`{c}`") if c in docs.columns else F.lit(None)).cast(kind).alias(c) for c, kind in COLUMNS.items()])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (op 9, fitted on the labels of ``sf_dir``)."""
    docs = _documents(docs)
    labels = importable(spark).read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels)
    return quality.with_score(docs, model).where(F.col("predicted") == 1).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of the n-gram Jaccard join (op 7).

    Documents without words, and those without an id, belong to no group and stay.  Rows that share
    an id are documents of their own: unlike ones stay, of like ones one stays.
    """
    docs = _documents(docs)
    importable(spark)
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        rows = written(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
        found = jaccard.jaccard_components(rows.where("doc_id is not null"), doc_id="row").select(F.col("doc_id").alias("row"), "component_id")
        first = F.min_by("row", F.struct("doc_id", "row")).alias("row")
        kept = found.join(rows.select("row", "doc_id"), "row").groupBy("component_id").agg(first).select("row")
        kept = rows.where("doc_id is not null").join(kept, "row", "left_semi")
        return kept.unionByName(rows.where("doc_id is null")).select(*COLUMNS)
    found = jaccard.jaccard_components(docs)
    dropped = written(found.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct(), "dropped")
    # only texts that may go are shuffled
    at_risk = may_be_among(dropped)(F.col("doc_id"))
    rest = docs.where(~at_risk).unionByName(docs.where(at_risk).join(dropped, "doc_id", "left_anti").select(*COLUMNS))
    return rest


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of repeated 400-byte strings (op 2), with n_chars of what stays.

    Characters cut by the edge of a removed run go with it; every document stays, if empty.
    """
    docs = _documents(docs)
    importable(spark)
    return repeats.without_repeats(docs).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of 2048 tokens (op 4)."""
    importable(spark)
    return packing.pack(_documents(docs), 2048)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", repeats_stage),
    ("best-fit packing", packing_stage),
]

#: A learnt classifier can't be told in SQL; tests/llm compares the other stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = importable(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)

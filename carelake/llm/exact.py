"""Exact dedup by skew-safe combining (DataFrame functions only).

Texts are equal when they are identical after each run of ASCII white space becomes one
space.  Three stages, each grouping by digest *and* whole text, so a digest alone never
decides: (1) every task combines its own equal texts (the map side of the first grouping),
(2) the digest groups are merged under a salt that all rows of a task share, so a text that a
third of all rows carry meets in ``SALTS`` places and not in one, (3) the winners of the
salts, at most ``SALTS`` rows a text, are combined globally.

The groups then return to the documents by digest and a salt of the row.  Only digests and ids
travel there; should one digest stand for several texts, its rows are matched by their whole
texts instead.

Defined cases: null text counts as empty; an empty text, or one of white space alone (which
becomes one space), is a text like any other; of a group, the row with the smallest id stays, a null id comes after all others; of
rows that tie on the id exactly one stays, so a repeated row is a copy; every row is returned,
dropped ones too; an empty table gives no row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import pick, written

SALTS = 64
LAST = (1 << 63) - 1


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def content_groups(texts: DataFrame) -> DataFrame:
    """digest, text, keep_id, group_size of rows (doc_id, text, digest): the three stages."""
    salted = texts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    winners = salted.groupBy("digest", "salt", "text").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    return winners.groupBy("digest", "text").agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))


def _returned(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with keep_id and group_size of its group and whether it is the one that stays.

    Rows meet their group under (keys, salt); a group is copied once per salt that its rows have.
    """
    order = F.coalesce("doc_id", F.lit(LAST))
    salted = written(rows.groupBy(*keys, "salt").agg(F.min_by("row", order).alias("row"), F.min(order).alias("low")), "salted")
    first = salted.groupBy(*keys).agg(F.min_by("row", "low").alias("first"))
    homes = salted.select(*keys, "salt").join(groups.join(first, keys), keys)
    found = rows.join(homes, [*keys, "salt"])
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("first")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    texts = pick(docs, doc_id=doc_id, text=text).withColumn("text", normalised(F.col("text")))
    texts = texts.withColumn("digest", digest(F.col("text")))
    groups = written(content_groups(texts).drop("text"), "groups")
    rows = texts.withColumn("row", F.monotonically_increasing_id()).withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)))
    rows = rows.withColumn("text_sha256", sha256(F.col("text")) if digest is not sha256 else F.col("digest"))
    clashing = written(groups.groupBy("digest").count().where("count > 1").select("digest"), "clashing")
    if clashing.isEmpty():
        return _returned(written(rows.drop("text"), "rows"), groups, ["digest"])
    apart = written(rows.drop("text").join(clashing, "digest", "left_anti"), "rows")
    whole = written(rows.join(clashing, "digest", "left_semi"), "clashing_rows")
    by_text = written(content_groups(whole.select("doc_id", "text", "digest")), "clashing_groups")
    return _returned(apart, groups.join(clashing, "digest", "left_anti"), ["digest"]).unionByName(
        _returned(whole, by_text, ["digest", "text"]))


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one row of each text."""
    kept = exact_dedup(docs, doc_id, text).where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha256"))
    marked = docs.withColumn("_sha256", sha256(normalised(F.col(f"`{text}`"))))
    found = marked.join(kept, (F.col("_sha256") == F.col("_kept_sha256")) & F.col(f"`{doc_id}`").eqNullSafe(F.col("_kept_id")))
    return found.dropDuplicates(["_sha256"]).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""

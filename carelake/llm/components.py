"""Connected components of a link table by alternating large-star and small-star steps.

Links stay distributed; a node that a third of all links share is met by partial
minima and by joins that Spark can split.  Every step is written to the shared folder; the last one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import forget, written


#: Links a partition; there are never more partitions than that needs.
ROWS = 250_000


def _down(pairs: DataFrame) -> DataFrame:
    """Links as distinct (u, v) with u > v."""
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) of every node that has a link."""
    now = written(_down(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")), "links")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
    before = mark(now)
    parts = max(8, before[0] // ROWS)
    while True:
        # large star: every larger neighbour of a node is linked to the least of its neighbourhood
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = now.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(now.join(least, "u").where("m < u").select("u", F.col("m").alias("v")))
        large = _down(large.coalesce(parts)).coalesce(parts)
        # small star: all smaller neighbours of a node are linked to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        last, now = now, written(_down(small.coalesce(parts)).coalesce(parts), "links")
        forget(last)
        after = mark(now)
        if after == before:
            break
        before = after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = stars.unionByName(stars.select(F.col("component").alias("node"), "component")).distinct()
    out.written_to = now.written_to
    return out

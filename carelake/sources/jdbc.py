"""S3: reading a clinic table from a relational database over JDBC.

A partitioned read: ``numPartitions`` range queries on the integer primary key,
so executors pull slices in parallel instead of one connection reading all.
Needs a reachable database and its JDBC driver on the classpath; not exercised
by the tests here (no database is started).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .schema import PRIMARY_KEYS, SCHEMAS
from .tables import conform


def read_table(spark: SparkSession, url: str, table: str, lower: int, upper: int,
               partitions: int, properties: dict[str, str] | None = None,
               source_name: str | None = None) -> DataFrame:
    """Read ``table`` (clinic name) from ``url`` split on its primary key."""
    reader = (spark.read.format("jdbc")
              .option("url", url)
              .option("dbtable", source_name or table.capitalize())
              .option("partitionColumn", PRIMARY_KEYS[table])
              .option("lowerBound", str(lower))
              .option("upperBound", str(upper))
              .option("numPartitions", str(partitions)))
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    df = reader.load()
    return conform(df.toDF(*[c.lower() for c in df.columns]), table) if SCHEMAS.get(table) else df

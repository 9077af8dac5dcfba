"""Session helpers: a configured local session for tests/bench and the checkpoint folder."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "carelake") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own session."""
    spark = (SparkSession.builder.master(f"local[{cores}]").appName(app)
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", os.environ.get("CARELAKE_DRIVER_MEMORY", "8g"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none (tests on one machine) a folder under the warehouse is
    set, which a cluster shares as well.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        configured = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_carelake_scratch"
        spark.sparkContext.setCheckpointDir(configured)
    return configured


#: The intermediate tables of this process by application, in the order in which they were begun.
_SCRATCH: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A fresh path for an intermediate table, in the shared folder if none is named; ``scratch`` removes it."""
    path = f"{(folder or checkpoint_dir(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """On leaving, removes the intermediate tables that were begun within; they are listed in what it gives.

    Results are lazy and read those tables: write or collect them before leaving.  Blocks may be nested; a block removes
    what it saw begin, also when it is left by an error.  Jobs that run side by side in one process share one list, so wrap
    them in one block.
    """
    made = _SCRATCH.setdefault(spark.sparkContext.applicationId, [])
    before = len(made)
    seen: list[str] = []
    try:
        yield seen
    finally:
        seen.extend(made[before:])
        del made[before:]
        for path in seen:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet under the shared folder and read back: cuts the lineage,
    so that results drawn from it don't read its inputs again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cluster_settings(input_bytes: int, executor_cores: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Settings for a cluster run, sized from the bytes the jobs read.

    * scans split at 256 MiB (``maxPartitionBytes``) so each task's input fits memory;
    * shuffles start with one partition per ``target_partition_bytes`` of input (at
      least twice the cores) and AQE coalesces them toward 128 MiB after seeing the
      real sizes, so reduce tasks neither spill heavily nor become tiny;
    * AQE skew handling splits partitions over 512 MiB that are 5x the median;
    * broadcasts stay size-checked (AQE's runtime threshold, 64 MiB), never hinted.

    Pass the result to ``SparkSession.builder.config(map=...)`` or ``spark-submit --conf``.
    """
    initial = max(2 * executor_cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(initial),
        "spark.sql.shuffle.partitions": str(initial),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
        "spark.sql.files.maxPartitionBytes": "256m",
        "spark.sql.parquet.filterPushdown": "true",
    }

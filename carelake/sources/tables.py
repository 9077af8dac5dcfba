"""S1 table scan: the clinic tables as typed DataFrames.

``Tables`` is a plain name -> DataFrame mapping. Readers apply the declared
schema (no inference); a column that a file lacks reads as NULL, which the integrity checks report.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import SCHEMAS, TABLES


class Tables(dict):
    """name -> DataFrame for the eight clinic tables (attribute access for brevity).

    A value may also be a zero-argument function building the DataFrame; it is
    built on first access, so tables a job never reads are never planned.

    ``bucket_keys`` names the column by which a table's snapshot is bucketed, where it is: jobs
    that join on it then leave the table where it lies.
    """

    def __init__(self, *args, bucket_keys: Mapping[str, str] | None = None):
        super().__init__(*args)
        known = args[0].bucket_keys if args and isinstance(args[0], Tables) else {}
        self.bucket_keys = dict(known if bucket_keys is None else bucket_keys)

    def bucketed(self, column: str, *names: str) -> bool:
        """Are all these tables bucketed by ``column``?"""
        return all(self.bucket_keys.get(n) == column for n in names)

    def __getitem__(self, name: str) -> DataFrame:
        v = dict.__getitem__(self, name)
        if callable(v) and not isinstance(v, DataFrame):
            v = v()
            dict.__setitem__(self, name, v)
        return v

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self[name]
        except KeyError as exc:  # pragma: no cover - attribute protocol
            raise AttributeError(name) from exc

    def items(self):
        return [(k, self[k]) for k in self.keys()]

    def values(self):
        return [self[k] for k in self.keys()]

    def replace(self, **changed: DataFrame) -> "Tables":
        out = Tables(self, bucket_keys={n: k for n, k in self.bucket_keys.items() if n not in changed})
        out.update(changed)
        return out


def conform(df: DataFrame, table: str) -> DataFrame:
    """Select and cast the declared columns of ``table`` in declared order."""
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[table].fields])


def load_tables(spark: SparkSession, path: str, fmt: str = "parquet", names: Sequence[str] = TABLES) -> Tables:
    """Read ``{path}/{table}`` for every clinic table (or those named) with its fixed schema."""
    out = Tables()
    for name in names:
        out[name] = spark.read.schema(SCHEMAS[name]).format(fmt).load(f"{path}/{name}")
    return out


#: The bucket columns that serve the visit histories and the billing job; payments look bills up by ``bill_id``.
VISIT_BUCKETS = {"appointment": "appointment_id", "diagnosis": "appointment_id", "bill": "appointment_id"}
PAYMENT_BUCKETS = {"bill": "bill_id"}


def load_bucketed(spark: SparkSession, prefix: str, bucket_keys: Mapping[str, str] = VISIT_BUCKETS, others: Tables | None = None) -> Tables:
    """The bucketed tables ``{prefix}{name}`` of the session's catalog (``sinks.write_bucketed``); the rest from ``others``."""
    out = Tables(others or {}, bucket_keys=bucket_keys)
    for name in bucket_keys:
        out[name] = conform(spark.table(f"{prefix}{name}"), name)
    return out


def tables_from(mapping: Mapping[str, DataFrame]) -> Tables:
    return Tables({name: conform(mapping[name], name) for name in TABLES})

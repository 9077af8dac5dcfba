"""Scalar expressions X1-X16 and the ENUM helpers."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from carelake.functions import expr as X
from carelake.sources.schema import PAYMENT_STATUSES


def test_display_forms(spark):
    df = spark.createDataFrame([("Ada", None, dt.date(2024, 5, 1), "08:30:00", 7)],
                               "first string, last string, d date, t string, n int")
    r = df.select(X.full_name("first", "last").alias("name"), X.full_name("first", F.lit("Lee")).alias("name2"),
                  X.display_date("d").alias("d"), X.display_time("t").alias("t"),
                  X.with_suffix("n", " days").alias("n"), X.null_text("last").alias("nt"),
                  X.if_null("last", "Unknown").alias("u")).first()
    assert (r.name, r.name2, r.d, r.t, r.n, r.nt, r.u) == (None, "Ada Lee", "01 May 2024", "08:30", "7 days", "-",
                                                          "Unknown")


def test_money_half_even_vs_half_up(spark):
    df = spark.createDataFrame([(Decimal("2.50"),), (Decimal("3.50"),), (Decimal("1234.49"),)], "x decimal(10,2)")
    got = df.select(X.money_text("x").alias("up"), X.money_text_half_even("x").alias("even")).collect()
    assert [(r.up, r.even) for r in got] == [("Le 3", "Le 2"), ("Le 4", "Le 4"), ("Le 1,234", "Le 1,234")]


def test_enum_ordinal_and_ordered_text(spark):
    df = spark.createDataFrame([(1, "Paid"), (1, "Unpaid"), (1, "Paid"), (2, "Partial")], "k int, s string")
    per = df.groupBy("k").agg(*[F.max(F.col("s") == v).alias(v) for v in PAYMENT_STATUSES])
    got = dict(per.select("k", X.ordered_distinct_text([(F.col(v), v) for v in PAYMENT_STATUSES])).collect())
    assert got == {1: "Unpaid, Paid", 2: "Partial"}
    o = df.select(X.ordinal("s", PAYMENT_STATUSES).alias("o")).collect()
    assert [r.o for r in o] == [3, 1, 3, 2]


def test_status_ladder_and_cents(spark):
    df = spark.createDataFrame([(Decimal("0"), Decimal("10")), (Decimal("5"), Decimal("10")),
                                (Decimal("10"), Decimal("10"))], "p decimal(10,2), t decimal(10,2)")
    assert [r[0] for r in df.select(X.status_ladder("p", "t")).collect()] == ["Unpaid", "Partial", "Paid"]
    assert df.select(X.normalized(F.lit("  MiXed "))).first()[0] == "mixed"

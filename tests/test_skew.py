"""Visits that hold most of the diagnoses, or of the bills: same rows, no task with much more than the others."""

from statistics import median

import pytest
from pyspark.sql import functions as F

from carelake.plans import reports as R
from carelake.plans import skew
from test_scale import NO_BROADCAST, conf


@pytest.fixture(scope="module")
def hot(spark, seed):
    """Two thirds of 90,000 diagnoses on visit 1, half of 20,000 bills on visit 2."""
    n = F.col("id")
    diag = spark.range(0, 90_000).select(
        (n + 1000).alias("diagnosis_id"), F.when(n < 60_000, 1).otherwise(n % 9 + 2).cast("long").alias("appointment_id"),
        F.lit("B54").alias("diagnosis_code"), F.lit("Unspecified").alias("description"), F.lit("Mild").alias("severity"),
        F.lit("2024-05-01").cast("date").alias("diagnosed_date"))
    bill = spark.range(0, 20_000).select(
        (n + 1000).alias("bill_id"), F.lit(1).cast("long").alias("patient_id"), F.when(n < 10_000, 2).otherwise(n % 13 + 1).cast("long").alias("appointment_id"),
        F.lit(5).cast("decimal(10,2)").alias("total_amount"), F.lit(1).cast("decimal(10,2)").alias("amount_paid"),
        F.lit("2024-05-01").cast("date").alias("bill_date"), F.lit("Partial").alias("payment_status"))
    return seed.replace(diagnosis=seed.diagnosis.unionByName(diag), bill=seed.bill.unionByName(bill))


@pytest.mark.parametrize("most_hot", [skew.MOST_HOT, 1])
def test_same_rows_as_the_plain_join(spark, hot, most_hot):
    one = hot.appointment.select("appointment_id", "reason")
    plain = hot.diagnosis.join(one, "appointment_id")
    got = skew.salted_join(hot.diagnosis, one, "appointment_id", F.xxhash64("diagnosis_id"), 500, most_hot)
    assert sorted(got.columns) == sorted(plain.columns)
    assert sorted(map(repr, got.select(plain.columns).collect())) == sorted(map(repr, plain.collect()))


def test_no_task_holds_the_hot_key(spark, hot):
    one = hot.appointment.select("appointment_id", "reason")
    dealt, repeated = skew.salted(hot.diagnosis, one, "appointment_id", F.xxhash64("diagnosis_id"), 200)
    keys = [F.col("appointment_id"), F.col(skew.SALT)]
    sizes = [r["count"] for r in dealt.repartition(16, *keys).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * median(sizes)
    plain = [r["count"] for r in dealt.repartition(16, "appointment_id").groupBy(F.spark_partition_id()).count().collect()]
    assert max(plain) > 60_000
    # the side of one row per key grows with the shares only
    assert repeated.count() <= one.count() + 90_000 // 200 + one.count()


def test_histories_are_the_same_however_keys_are_salted(spark, monkeypatch, hot):
    rows = {}
    for share in (100_000, 300):
        monkeypatch.setattr(skew, "ROWS_PER_SALT", share)
        monkeypatch.setattr(R, "salted_join", lambda *a, share=share: skew.salted_join(*a, rows_per_salt=share))
        with conf(spark, NO_BROADCAST):
            rows[share] = [sorted(map(repr, f(hot).collect())) for f in (R.full_visit_history, lambda t: R.patient_visit_history(t, display=False))]
    assert rows[300] == rows[100_000]
    full, every = rows[300]
    # each diagnosis once, and each bill beyond a visit's first; visits without a child stay in the second
    bills = hot.bill.groupBy("appointment_id").count().collect()
    assert len(every) >= hot.diagnosis.count() + sum(r["count"] - 1 for r in bills) and len(full) <= len(every)


def test_null_keys_and_empty_sides(spark):
    many = spark.createDataFrame([(1, 10), (None, 11), (2, 12)], "k long, id long")
    one = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k long, v string")
    got = skew.salted_join(many, one, "k", F.xxhash64("id"), 1)
    assert [tuple(r) for r in got.collect()] == [(1, 10, "a")]
    assert skew.salted_join(many.where("false"), one, "k", F.xxhash64("id")).count() == 0

"""Jobs read their rows once, and a task's share doesn't grow with the table."""

import pytest
from pyspark.sql import functions as F

from carelake.operators import changes as C
from carelake.operators import integrity as K
from carelake.operators import tableview as TV


def counted(spark, df, key):
    """``df`` and an accumulator of the rows that were computed of it."""
    seen = spark.sparkContext.accumulator(0)

    def look(_):
        seen.add(1)
        return True

    return df.where(F.udf(look, "boolean")(F.col(key))), seen


def test_new_rows_are_judged_once(spark):
    rows, seen = counted(spark, spark.range(0, 3000, 1, 4).select((F.col("id") * 7 % 3000).alias("seq")), "seq")
    got = C.assign_ids(rows, "new_id", 10)
    assert got.where("new_id <> seq + 11").count() == 0 and got.count() == 3000
    assert seen.value == 3000


def test_a_page_computes_its_listing_once(spark, monkeypatch):
    monkeypatch.setattr(TV, "SORTED_ROWS", 200)
    rows, seen = counted(spark, spark.range(0, 5000, 1, 4).select((F.col("id") * 7 % 5000).alias("k")), "k")
    got = TV.page(rows.repartition(5), [(F.col("k"), False)], 981, 1000).orderBy("position")
    assert [(r.k, r.position) for r in got.collect()] == [(4999 - i, i + 1) for i in range(980, 1000)]
    assert seen.value == 5000


@pytest.mark.parametrize("rows", [None, 5000])
def test_numbered_rows_stay_where_they_are(spark, monkeypatch, rows):
    monkeypatch.setattr(TV, "RANGE_ROWS", 100)
    keys = spark.range(0, 5000, 1, 4).select((F.col("id") * 7 % 5000).alias("k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = TV.positions(keys, [F.col("k")], rows=rows)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert got.where("position <> k + 1").count() == 0 and got.count() == 5000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    parts = {f.rsplit("/", 1)[1] for f in got.inputFiles()}
    assert len(parts) > 30 if rows else len(parts) <= 8


def test_keys_are_counted_without_names(spark, seed):
    plan = K.key_audit(seed)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [_parent#" in plan and "parent_table#" not in plan.split("Aggregate [_parent#")[1].split("]")[0]
    names = {r.parent_table for r in K.key_audit(seed).select("parent_table").distinct().collect()}
    assert names == {p for p in names if p in seed} and {"patient", "bill", "clinic"} <= names


def test_the_ledger_derives_bills_and_visits_once(spark):
    import upkeep_queries as Q
    from carelake.sources.adapter import clinic_tables
    from paths import SF_SMALL as SF

    t = clinic_tables(spark, SF)
    n_visits = t.appointment.count()
    bill, bills = counted(spark, t.bill, "bill_id")
    appointment, visits = counted(spark, t.appointment, "appointment_id")
    for table in (bill, appointment):
        table.write.format("noop").mode("overwrite").save()
    once = bills.value, visits.value
    got = Q.q_dashboard_kept_up(spark, SF, t.replace(bill=bill, appointment=appointment)).first()
    assert got.appointments == n_visits
    assert (bills.value, visits.value) == (2 * once[0], 2 * once[1])


def test_a_large_batch_meets_its_parents_once(spark, monkeypatch):
    from carelake.operators import validate as V

    monkeypatch.setattr(V, "FEW", 0)
    parent = spark.range(0, 1000).select((F.col("id") % 500).alias("pid"))
    batch, seen = counted(spark, spark.range(0, 2000, 1, 4).select(F.col("id").alias("seq"), F.col("id").cast("string").alias("p")), "seq")
    marked = V.mark_existing(batch, V.parse_id("p"), parent, "pid", "_has", small=False)
    assert {r.seq for r in marked.collect() if r._has} == set(range(500))
    assert seen.value == 2000

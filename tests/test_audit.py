"""One-shuffle audits and single-pass changes: results on dirty tables, and the plans they promise."""

import re

import pytest
from pyspark.sql import functions as F

import audit_queries as A
from carelake.operators import changes as C
from carelake.operators import forms as FM
from carelake.operators import integrity as K
from carelake.operators import validate as V
from carelake.sources.adapter import clinic_tables
from carelake.sources.sinks import write_snapshot
from carelake.sources.tables import load_tables
from paths import SF_SMALL
from test_scale import NO_BROADCAST, conf


@pytest.fixture(scope="module")
def dirty(spark):
    return A.dirty_tables(clinic_tables(spark, SF_SMALL))


def exchanges(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    return re.findall(r"Exchange (hashpartitioning\([^)]*\)|SinglePartition)", plan)


def test_dirty_tables_break_every_kind_of_rule(dirty):
    assert sum(r.orphan_rows > 0 for r in K.foreign_key_orphans(dirty).collect()) >= 7
    keys = {r.table_name: r for r in K.primary_key_violations(dirty).collect()}
    assert keys["patient"].duplicate_keys and keys["bill"].duplicate_rows and keys["medication"].null_keys
    assert sum(r.null_rows > 0 for r in K.null_violations(dirty).collect()) >= 4
    assert sum(r.bad_rows > 0 for r in K.domain_violations(dirty).collect()) >= 4


def test_audit_equals_one_anti_join_per_edge(dirty):
    want = {(c, fk): K.orphans(dirty, c, fk, p).count() for c, fk, p in K.FOREIGN_KEYS}
    assert {(r.child_table, r.child_column): r.orphan_rows for r in K.foreign_key_orphans(dirty).collect()} == want
    assert {(r.child_table, r.child_column): r["sum(orphan_rows)"] for r in K.orphan_keys(dirty).groupBy("child_table", "child_column").sum("orphan_rows").collect()} == {
        k: n for k, n in want.items() if n}


def test_audit_takes_one_shuffle(spark, tmp_path, seed):
    for name, df in seed.items():
        write_snapshot(df, str(tmp_path / name))
    t = load_tables(spark, str(tmp_path))
    report = K.foreign_key_orphans(t)
    assert [x.startswith("hash") for x in exchanges(report)].count(True) == 1
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == len(t)  # each table once
    empty = K.foreign_key_orphans(load_tables(spark, str(tmp_path)).replace(**{n: df.where("false") for n, df in t.items()}))
    assert [r.orphan_rows for r in empty.collect()] == [0] * len(K.FOREIGN_KEYS)


@pytest.mark.parametrize("few", [V.FEW, 0])
def test_delete(spark, monkeypatch, seed, few):
    """Repeated, unreadable, null and unknown ids; with a small batch's ids broadcast, and in one aggregation."""
    monkeypatch.setattr(V, "FEW", few)
    free = seed.patient.where("patient_id = 1").withColumn("patient_id", F.lit(1 << 40))
    t = seed.replace(patient=seed.patient.unionByName(free))
    rows = [(1, "1"), (2, " 1 "), (3, None), (4, "x"), (5, "999"), (6, str(1 << 40)), (7, str(1 << 40))]
    batch = spark.createDataFrame(rows, "seq long, id string")
    ch = C.delete_restrict(t, "patient", batch)
    got = {r.seq: r.outcome for r in ch.accepted.collect()} | {r.seq: r.errors[0] for r in ch.rejected.collect()}
    assert got == {1: "blocked", 2: "blocked", 3: "not found", 4: "not found", 5: "not found", 6: "deleted", 7: "deleted"}
    assert sorted(r.patient_id for r in ch.table.collect()) == sorted(r.patient_id for r in seed.patient.collect())
    guarded = C.delete_restrict(t, "patient", batch, guard=("gender", "nobody"))
    assert guarded.accepted.count() == 0 and {r.errors[0] for r in guarded.rejected.collect()} == {"guard failed", "not found"}
    if not few:
        with conf(spark, NO_BROADCAST):
            keys = C.delete_restrict(seed, "patient", batch).table
            assert len([x for x in exchanges(keys) if "patient_id" in x]) == 2  # the role bits, and the table itself


def test_keys_present_is_one_aggregation(spark, monkeypatch):
    monkeypatch.setattr(V, "FEW", 0)
    parent = spark.range(0, 1000).select((F.col("id") % 500).alias("pid")).unionByName(spark.createDataFrame([(None,)], "pid long"))
    batch = spark.createDataFrame([(1, "5"), (2, "5"), (3, "700"), (4, None), (5, "y")], "seq long, p string")
    with conf(spark, NO_BROADCAST):
        marked = V.mark_existing(batch, V.parse_id("p"), parent, "pid", "_has")
        assert {r.seq: r._has for r in marked.collect()} == {1: True, 2: True, 3: False, 4: False, 5: False}
        assert "LeftSemi" not in marked._jdf.queryExecution().executedPlan().toString()


def test_base_is_read_once_for_all_three_results(spark, tmp_path, seed):
    for name, df in seed.items():
        write_snapshot(df, str(tmp_path / name))
    t = load_tables(spark, str(tmp_path))
    bill = t.bill.orderBy("bill_id").first()
    jobs = {
        "bill": C.apply_payments(t.bill, spark.createDataFrame([(1, str(bill.bill_id), "1"), (2, "999", "1"), (3, "1", "x")], "seq long, bill_id string, amount string")),
        "appointment": C.change_status(t.appointment, spark.createDataFrame(
            [(1, "1", "Cancelled", ""), (2, "1", "Completed", ""), (3, "999", "Completed", ""), (4, "2", "Gone", "")],
            "seq long, appointment_id string, status string, expected_status string")),
        "medication": FM.update_rows(t, "medication", spark.createDataFrame(
            [(1, "1", "New", "", "tablet", "5"), (2, "1", "Late", "", "tablet", "5"), (3, "999", "None", "", "tablet", "5"), (4, "2", "", "", "", "x")],
            "seq long, medication_id string, medication_name string, description string, unit string, stock_quantity string")),
    }
    for name, job in jobs.items():
        assert job.judged._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1, name
        once = job.stored()
        for part in ("table", "accepted", "rejected"):
            view = getattr(once, part)
            assert not [f for f in view.inputFiles() if f"/{name}/" in f], (name, part)
            assert sorted(map(repr, view.collect())) == sorted(map(repr, getattr(job, part).collect())), (name, part)
        assert once.table.count() == t[name].count() and once.rejected.count() >= 2


def test_guard_on_a_null_value_fails(spark, seed):
    base = seed.appointment.withColumn("status", F.lit(None).cast("string"))
    ch = C.change_status(base, spark.createDataFrame([(1, "1", "Completed", "Scheduled"), (2, "2", "Completed", "")],
                                                     "seq long, appointment_id string, status string, expected_status string"))
    assert [r.seq for r in ch.accepted.collect()] == [2]
    assert [(r.seq, r.errors) for r in ch.rejected.collect()] == [(1, ["current value differs from the expected one"])]


def test_restock_keeps_what_would_overflow(spark, seed):
    batch = spark.createDataFrame([(1, "1", "2147483647"), (2, "1", "2147483647"), (3, "2", "4"), (4, "2", "0"), (5, "77", "1")],
                                  "seq long, medication_id string, quantity string")
    ch = C.restock(seed.medication, batch)
    before = {r.medication_id: r.stock_quantity for r in seed.medication.collect()}
    assert {r.medication_id: r.stock_quantity for r in ch.table.collect()} == {**before, 2: before[2] + 4}
    assert [(r.medication_id, r.deliveries, r.added) for r in ch.accepted.collect()] == [(2, 1, 4)]
    assert {r.seq: r.errors for r in ch.rejected.collect()} == {
        1: ["Stock would exceed its limit"], 2: ["Stock would exceed its limit"],
        4: ["Quantity must be a whole number greater than zero"], 5: ["Medication does not exist"]}


def test_counts_of_the_write_equal_the_checks(spark, tmp_path, dirty):
    """K3 and K4 counted while the snapshots are written; the snapshots hold all rows; an empty table counts zeros."""
    report = {(r.table_name, r.column_name, r.rule): r.bad_rows for r in K.write_checked_tables(dirty, str(tmp_path)).collect()}
    want = {(r.table_name, r.column_name, "null"): r.null_rows for r in K.null_violations(dirty).collect()}
    want |= {(r.table_name, r.column_name, "domain"): r.bad_rows for r in K.domain_violations(dirty).collect()}
    assert report == want and sum(n > 0 for n in want.values()) >= 8
    again = load_tables(spark, str(tmp_path))
    assert {n: again[n].count() for n in again} == {n: dirty[n].count() for n in again}
    counts = K.write_checked(dirty.patient.where("false"), "patient", str(tmp_path / "none"))
    assert set(counts.values()) == {0} and "rows" in counts

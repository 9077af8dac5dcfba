"""Bucketed snapshots: same results, and no shuffle on the bucketed key."""

import re
import uuid

import pytest

from carelake.operators import changes as C
from carelake.operators import validate as V
from carelake.plans import reports as R
from carelake.sources.sinks import write_bucketed
from carelake.sources.tables import PAYMENT_BUCKETS, VISIT_BUCKETS, Tables, load_bucketed
from test_scale import NO_BROADCAST, conf


def bucketed(spark, seed, folder, keys, buckets=4) -> Tables:
    prefix = f"t{uuid.uuid4().hex[:8]}_"
    for name, key in keys.items():
        write_bucketed(seed[name], prefix + name, str(folder / name), key, buckets)
    return load_bucketed(spark, prefix, keys, seed)


def shuffled(df) -> list[str]:
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_one_file_a_bucket(spark, seed, tmp_path):
    t = bucketed(spark, seed, tmp_path, VISIT_BUCKETS)
    for name in VISIT_BUCKETS:
        assert len(list((tmp_path / name).glob("part-*.parquet"))) <= 4
        same(t[name], seed[name])


@pytest.mark.parametrize("report", [R.full_visit_history, lambda t: R.patient_visit_history(t, display=False)])
def test_histories(spark, seed, tmp_path, report):
    same(report(bucketed(spark, seed, tmp_path, VISIT_BUCKETS)), report(seed))


def test_history_without_a_shuffle_by_visit(spark, seed, tmp_path):
    t = bucketed(spark, seed, tmp_path, VISIT_BUCKETS)
    with conf(spark, NO_BROADCAST):
        assert any("appointment_id" in x for x in shuffled(R.full_visit_history(seed)))
        assert not [x for x in shuffled(R.full_visit_history(t)) if "appointment_id" in x]


@pytest.mark.parametrize("few", [V.FEW, 0])
def test_bills(spark, monkeypatch, seed, tmp_path, few):
    monkeypatch.setattr(V, "FEW", few)
    t = bucketed(spark, seed, tmp_path, VISIT_BUCKETS)
    rows = [(i, str(i), "100", "10" if i % 2 else "", "2024-06-01") for i in range(1, 20)] + [(50, "13", "5", "", "2024-06-01"), (51, "x", "5", "9", "no")]
    batch = spark.createDataFrame(rows, "seq long, appointment_id string, total_amount string, amount_paid string, bill_date string")
    plain, ch = C.create_bills(seed, batch, 100), C.create_bills(t, batch, 100)
    assert plain.accepted.count() > 0
    same(ch.accepted, plain.accepted)
    same(ch.rejected, plain.rejected)
    same(ch.table, plain.table)
    with conf(spark, NO_BROADCAST):  # only the batch goes to the visits
        assert not [x for x in shuffled(C.create_bills(t, batch, 100).rejected) if "appointment_id" in x and "_id#" not in x]
        scans = C.create_bills(t, batch, 100).rejected._jdf.queryExecution().executedPlan().toString()
        assert "SelectedBucketsCount" in scans


def test_payments(spark, seed, tmp_path):
    t = bucketed(spark, seed, tmp_path, PAYMENT_BUCKETS, 16)
    batch = spark.createDataFrame([(i, str(i), str(i * 1000)) for i in range(1, 14)], "seq long, bill_id string, amount string")
    plain, ch = C.apply_payments(seed.bill, batch), C.apply_payments(t.bill, batch)
    for part in ("table", "accepted", "rejected"):
        same(getattr(ch, part), getattr(plain, part))
    with conf(spark, NO_BROADCAST):
        # the payments' sums go to the bills: the bills are read by bucket and only what is joined to them is shuffled
        table = C.apply_payments(t.bill, batch).table
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "SelectedBucketsCount" in plan and "disabled by query planner" not in plan
        left = plan[plan.index("FullOuter") if "FullOuter" in plan else plan.index("Outer"):]
        assert left.index("FileScan") < left.index("Exchange")


def test_replaced_tables_are_not_bucketed(seed):
    t = Tables(seed, bucket_keys=VISIT_BUCKETS)
    assert t.bucketed("appointment_id", "bill", "diagnosis") and Tables(t).bucketed("appointment_id", "bill")
    assert not t.replace(bill=seed.bill).bucketed("appointment_id", "bill") and not t.bucketed("bill_id", "bill")

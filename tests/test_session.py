"""Session settings and the snapshot workflow."""


def test_cluster_settings():
    from carelake.session import cluster_settings
    s = cluster_settings(100 * 10**12, 8000)
    assert int(s["spark.sql.shuffle.partitions"]) == -(-100 * 10**12 // (256 << 20))
    assert cluster_settings(10, 8)["spark.sql.shuffle.partitions"] == "16"


def test_end_to_end_snapshot_workflow(spark, seed, tmp_path):
    """Load tables, apply a payment batch, write the changed table to a fresh path, report on it."""
    from decimal import Decimal

    from carelake.operators.changes import apply_payments
    from carelake.plans import reports as R
    from carelake.sources.sinks import write_snapshot
    from carelake.sources.tables import load_tables

    for name, df in seed.items():
        write_snapshot(df, str(tmp_path / "v0" / name))
    t = load_tables(spark, str(tmp_path / "v0"))
    pay = spark.createDataFrame([(1, "3", "30000")], "seq long, bill_id string, amount string")
    write_snapshot(apply_payments(t.bill, pay).table, str(tmp_path / "v1" / "bill"))
    t["bill"] = load_tables(spark, str(tmp_path / "v1"), names=["bill"])["bill"]
    r = R.dashboard_metrics(t).first()
    assert (r.collected, r.outstanding) == (Decimal("560000.00"), Decimal("175000.00"))


def test_scratch_removes_what_it_saw_begin(spark, seed):
    import os

    import pytest

    from carelake.operators.tableview import positions
    from carelake.session import scratch, stored

    at = lambda df: df.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    before = at(stored(seed.clinic, "kept"))
    with scratch(spark) as outer:
        first = at(stored(seed.clinic, "outer"))
        with pytest.raises(KeyError), scratch(spark) as inner:
            second = at(positions(seed.staff, ["staff_id"]))
            assert os.path.isdir(second)
            raise KeyError
        assert inner and not os.path.exists(second) and os.path.isdir(first)
        rows = stored(seed.clinic, "outer").collect()
    assert len(outer) == 2 and not os.path.exists(first) and os.path.isdir(before) and rows

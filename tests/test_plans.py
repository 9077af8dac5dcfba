"""Plan checks: the physical shapes the reports rely on at scale."""

import contextlib
import io

import pytest

from carelake.plans import reports as R


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_unbilled_is_anti_join(seed):
    assert "LeftAnti" in plan(R.unbilled_appointments(seed))


def test_clinic_activity_has_no_distinct_expand(seed):
    p = plan(R.clinic_activity(seed))
    assert "Expand" not in p


def test_revenue_by_clinic_has_no_expand(seed):
    assert "Expand" not in plan(R.revenue_by_clinic(seed))


@pytest.mark.parametrize("name", ["recent_appointments", "latest_patients", "top_medications",
                                  "top_prescribed_medications"])
def test_topk_uses_take_ordered(seed, name):
    assert "TakeOrderedAndProject" in plan(R.REPORTS[name](seed))


def test_no_python_in_any_report(seed):
    for name, fn in R.REPORTS.items():
        p = plan(fn(seed))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


def test_filter_reaches_scan(spark, tmp_path, seed):
    from carelake.sources.sinks import write_snapshot
    from carelake.sources.tables import load_tables
    for name, df in seed.items():
        write_snapshot(df, str(tmp_path / name))
    t = load_tables(spark, str(tmp_path))
    p = plan(R.patients_registered_since(t))
    assert "GreaterThanOrEqual(registration_date,2024-01-01)" in p
    assert "ReadSchema: struct<patient_id:bigint,first_name:string,last_name:string,registration_date:date>" in p

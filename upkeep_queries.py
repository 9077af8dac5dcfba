"""Registered queries for the reports kept up to date from accepted changes; their DuckDB oracles compute them anew from the changed bills."""

from __future__ import annotations

from pyspark.sql import DataFrame

from carelake.operators import changes as C
from carelake.plans import upkeep as U
from carelake.session import stored
from carelake.sources.adapter import clinic_tables
from operator_queries import BILL_BATCH_SQL, PAYMENT_BATCH_SQL, _high_water, _plain, _with, bill_batch, payment_batch

_LEDGERS: dict[tuple, DataFrame] = {}


def _ledger(spark, sf_dir, t) -> DataFrame:
    """The ledger of the tables after a batch of bills and one of payments (made once per session and input)."""
    key = (spark.sparkContext.applicationId, t.bill.semanticHash())
    if key not in _LEDGERS:
        # both are read several times: as snapshots, not derived anew each time
        t = t.replace(bill=stored(t.bill, "bill"), appointment=stored(t.appointment, "appointment"))
        before = stored(U.of_tables(t), "ledger")
        billed = C.create_bills(t, bill_batch(spark, sf_dir), _high_water(t.bill, "bill_id"))
        paid = C.apply_payments(t.bill, payment_batch(spark, sf_dir)).stored()
        after = U.merged(before, U.of_new_bills(billed.accepted, t.appointment), U.of_payments(paid.moved, t.appointment))
        _LEDGERS[key] = stored(after, "ledger")
    return _LEDGERS[key]


def q_dashboard_kept_up(spark, sf_dir, t=None):
    """Q1 after a batch of bills and payments, from the ledger."""
    t = t or clinic_tables(spark, sf_dir)
    return _plain(U.dashboard_metrics(_ledger(spark, sf_dir, t)))


def q_revenue_by_clinic_kept_up(spark, sf_dir, t=None):
    """Q19 after a batch of bills and payments, from the ledger."""
    t = t or clinic_tables(spark, sf_dir)
    return _plain(U.revenue_by_clinic(_ledger(spark, sf_dir, t), t.clinic))


def q_revenue_by_billed_clinic_kept_up(spark, sf_dir, t=None):
    """Q28 after a batch of bills and payments, from the ledger."""
    t = t or clinic_tables(spark, sf_dir)
    return _plain(U.revenue_by_billed_clinic(_ledger(spark, sf_dir, t), t.clinic))


def q_monthly_revenue_kept_up(spark, sf_dir, t=None):
    """R4 after a batch of bills and payments, from the ledger."""
    t = t or clinic_tables(spark, sf_dir)
    return _plain(U.monthly_revenue(_ledger(spark, sf_dir, t)))


QUERIES = {
    "dashboard_kept_up": q_dashboard_kept_up,
    "revenue_by_clinic_kept_up": q_revenue_by_clinic_kept_up,
    "revenue_by_billed_clinic_kept_up": q_revenue_by_billed_clinic_kept_up,
    "monthly_revenue_kept_up": q_monthly_revenue_kept_up,
}

# the bills after both batches: payments of old bills capped at the total, new bills as they were accepted
_AFTER = BILL_BATCH_SQL + "," + PAYMENT_BATCH_SQL + """,
taken AS (SELECT bid, sum(amt) AS amt FROM pe WHERE len(errs) = 0 GROUP BY bid),
after AS (
  SELECT appointment_id, bill_date, total_amount AS total, CAST(least(total_amount, amount_paid + coalesce(amt, 0)) AS DECIMAL(20,2)) AS paid
  FROM bill LEFT JOIN taken ON bid = bill_id
  UNION ALL
  SELECT aid, d, tot, paid FROM be WHERE len(errs) = 0),
place AS (SELECT after.*, clinic_id FROM after LEFT JOIN appointment USING (appointment_id)),
earned AS (SELECT clinic_id, sum(total) AS total, sum(paid) AS paid FROM place GROUP BY clinic_id),
seen AS (SELECT clinic_id, count(*) AS visits FROM appointment GROUP BY clinic_id)"""
_MONEY = """CAST(coalesce(total, 0) AS DOUBLE) AS total_billed, CAST(coalesce(paid, 0) AS DOUBLE) AS total_collected,
       CAST(coalesce(total - paid, 0) AS DOUBLE) AS total_outstanding"""
SQL = {
    "dashboard_kept_up": _with(_AFTER, """
SELECT (SELECT count(*) FROM patient) AS patients, (SELECT count(*) FROM staff) AS staff, (SELECT count(*) FROM clinic) AS clinics,
       (SELECT count(*) FROM appointment) AS appointments, CAST(coalesce(sum(paid), 0) AS DOUBLE) AS collected,
       CAST(coalesce(sum(total - paid), 0) AS DOUBLE) AS outstanding FROM after"""),
    "revenue_by_clinic_kept_up": _with(_AFTER, f"""
SELECT clinic_id, clinic_name, coalesce(visits, 0) AS visits, {_MONEY}
FROM clinic LEFT JOIN seen USING (clinic_id) LEFT JOIN earned USING (clinic_id)"""),
    "revenue_by_billed_clinic_kept_up": _with(_AFTER, f"""
SELECT clinic_id, clinic_name, {_MONEY} FROM clinic JOIN earned USING (clinic_id)"""),
    "monthly_revenue_kept_up": _with(_AFTER, """
SELECT strftime(date_trunc('month', bill_date), '%Y-%m-%d') AS month, count(*) AS bills, CAST(sum(total) AS DOUBLE) AS total_billed,
       CAST(sum(paid) AS DOUBLE) AS total_collected, CAST(sum(total - paid) AS DOUBLE) AS total_outstanding
FROM after GROUP BY date_trunc('month', bill_date)"""),
}

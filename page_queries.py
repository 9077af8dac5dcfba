"""Registered queries for pages by position, ordered exports, bucketed snapshots and indexed search, each with its DuckDB oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.operators import tableview as TV
from carelake.operators import textindex as TX
from carelake.plans import reports as R
from carelake.session import checkpoint_dir
from carelake.sources.adapter import clinic_tables
from carelake.sources.sinks import export_ordered_csv, write_bucketed
from carelake.sources.tables import VISIT_BUCKETS, load_bucketed
from operator_queries import _BAL, _NUM, OPERATOR_SQL, _plain, _wrap
from oracle_sql import REPORT_SQL

PAGE, ROWS = 50, 20


def q_bill_page(spark, sf_dir, t=None) -> DataFrame:
    """Page 50 of the whole bill list in page order, rows 981 to 1000, without numbering the rest."""
    bills = R.bill_list(t or clinic_tables(spark, sf_dir), display=False)
    order = [(F.col("bill_date"), False), (F.col("bill_id"), False)]
    return _plain(TV.page(bills, order, (PAGE - 1) * ROWS + 1, PAGE * ROWS))


def q_bill_page_by_balance(spark, sf_dir, t=None) -> DataFrame:
    """Page 50 of the bill page sorted by its balance text, largest first."""
    bills = R.bill_list(t or clinic_tables(spark, sf_dir), display=True)
    base = [(F.to_date("bill_date", "dd MMM yyyy"), False), (F.col("bill_id"), False)]
    return TV.page(bills, TV.sort_pairs("balance", False, base), (PAGE - 1) * ROWS + 1, PAGE * ROWS)


def q_exported_bill_lines(spark, sf_dir, t=None) -> DataFrame:
    """The lines of the whole bill page exported in page order, read back with their place in the joined parts."""
    bills = R.bill_list(t or clinic_tables(spark, sf_dir), display=True)
    path = f"{checkpoint_dir(spark).rstrip('/')}/export-{uuid.uuid4().hex}"
    order = [(F.to_date("bill_date", "dd MMM yyyy"), False), (F.col("bill_id"), False)]
    if not export_ordered_csv(bills, path, order, BILL_HEADINGS):
        return spark.createDataFrame([], "line string")
    return spark.read.option("lineSep", "\r\n").text(path).withColumnRenamed("value", "line")


# The headings of the bill page.
BILL_HEADINGS = ["ID", "Patient", "Date", "Total", "Paid", "Balance", "Status"]
_BUCKETED: dict[tuple, object] = {}


def q_full_visit_history_bucketed(spark, sf_dir, t=None) -> DataFrame:
    """Q34 over snapshots bucketed by visit (written once per session and input)."""
    t = t or clinic_tables(spark, sf_dir)
    key = (spark.sparkContext.applicationId, t.bill.semanticHash())
    if key not in _BUCKETED:
        prefix, folder = f"t{uuid.uuid4().hex}_", checkpoint_dir(spark).rstrip("/")
        buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        for name, column in VISIT_BUCKETS.items():
            write_bucketed(t[name], prefix + name, f"{folder}/{prefix}{name}", column, buckets)
        _BUCKETED[key] = prefix
    return _plain(R.full_visit_history(load_bucketed(spark, _BUCKETED[key], VISIT_BUCKETS, t)))


_INDEXES: dict[tuple, TX.TextIndex] = {}


def q_search_appointments_indexed(spark, sf_dir, t=None) -> DataFrame:
    """The search of the whole schedule through its substring index (written once per session and input)."""
    t = t or clinic_tables(spark, sf_dir)
    key = (spark.sparkContext.applicationId, t.appointment.semanticHash())
    if key not in _INDEXES:
        listing = R.appointment_list(t, display=True)
        _INDEXES[key] = TX.TextIndex.build(listing, f"{checkpoint_dir(spark).rstrip('/')}/text-{uuid.uuid4().hex}")
    return _INDEXES[key].search("  Completed 1-URGENT ").rows


QUERIES = {
    "bill_page": q_bill_page,
    "bill_page_by_balance": q_bill_page_by_balance,
    "exported_bill_lines": q_exported_bill_lines,
    "full_visit_history_bucketed": q_full_visit_history_bucketed,
    "search_appointments_indexed": q_search_appointments_indexed,
}


def _cell(c: str) -> str:
    text = f"coalesce(CAST({c} AS VARCHAR), '-')"
    return f"CASE WHEN regexp_matches({text}, '[,\"\\r\\n]') THEN '\"' || replace({text}, '\"', '\"\"') || '\"' ELSE {text} END"


_COLUMNS = ["bill_id", "patient_name", "bill_date", "total_amount", "amount_paid", "balance", "payment_status"]
_BETWEEN = f"position BETWEEN {(PAGE - 1) * ROWS + 1} AND {PAGE * ROWS}"
SQL = {
    "bill_page": _wrap("bill_list", f"""
SELECT page.bill_id, page.patient_name, strftime(b.bill_date, '%Y-%m-%d') AS bill_date, CAST(b.total_amount AS DOUBLE) AS total_amount,
       CAST(b.amount_paid AS DOUBLE) AS amount_paid, CAST(b.total_amount - b.amount_paid AS DOUBLE) AS balance, page.payment_status, position
FROM (SELECT *, row_number() OVER (ORDER BY strptime(bill_date, '%d %b %Y') DESC, bill_id DESC) AS position FROM page) page
JOIN bill b ON b.bill_id = page.bill_id WHERE {_BETWEEN}"""),
    "bill_page_by_balance": _wrap("bill_list", f"""
SELECT * FROM (SELECT *, row_number() OVER (ORDER BY
    CASE WHEN regexp_matches({_BAL}, '{_NUM}') THEN 0 ELSE 1 END DESC, CASE WHEN regexp_matches({_BAL}, '{_NUM}') THEN CAST({_BAL} AS DOUBLE) END DESC NULLS LAST,
    CASE WHEN NOT regexp_matches({_BAL}, '{_NUM}') THEN lower({_BAL}) END DESC NULLS LAST,
    strptime(bill_date, '%d %b %Y') DESC, bill_id DESC) AS position FROM page) WHERE {_BETWEEN}"""),
    "exported_bill_lines": _wrap("bill_list", f"""
SELECT 'ID,Patient,Date,Total,Paid,Balance,Status' AS line UNION ALL
SELECT {" || ',' || ".join(_cell(c) for c in _COLUMNS)} FROM page"""),
    "full_visit_history_bucketed": REPORT_SQL["full_visit_history"],
    "search_appointments_indexed": OPERATOR_SQL["search_appointments"],
}

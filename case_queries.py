"""Registered queries that compare, group and order text under a collation, each with its DuckDB oracle.

The stand-in tables spell their texts in upper, lower or given case, row by row; the collation makes the
spellings equal, as the original database's default comparison does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.functions.expr import ANY_CASE
from carelake.operators import changes as C
from carelake.operators import tableview as TV
from carelake.plans import reports as R
from carelake.sources.adapter import _lines, clinic_tables, read_driver_tables
from carelake.sources.tables import Tables
from operator_queries import _plain, _with


def _mixed(c: str, key: str) -> Column:
    k = F.col(key)
    return F.when(k % 3 == 0, F.upper(c)).when(k % 3 == 1, F.lower(c)).otherwise(F.col(c)).alias(c)


def _mixed_sql(c: str, key: str) -> str:
    return f"CASE {key} % 3 WHEN 0 THEN upper({c}) WHEN 1 THEN lower({c}) ELSE {c} END AS {c}"


MIXED = {"appointment": ["reason", "status"], "patient": ["first_name", "last_name"],
         "diagnosis": ["diagnosis_code", "description", "severity"], "bill": ["payment_status"]}


def mixed_tables(t: Tables) -> Tables:
    out = Tables(t)
    for name, columns in MIXED.items():
        out[name] = lambda name=name, columns=columns: t[name].withColumns({c: _mixed(c, f"{name}_id") for c in columns})
    return out


MIXED_SQL = ",\n".join(
    f"m_{name} AS (SELECT * REPLACE ({', '.join(_mixed_sql(c, f'{name}_id') for c in columns)}) FROM {name})" for name, columns in MIXED.items())


def _tables(spark, sf_dir, t) -> Tables:
    return mixed_tables(t or clinic_tables(spark, sf_dir))


def q_facet_any_case(spark, sf_dir, t=None) -> DataFrame:
    """T2 under a collation: visits whose reason equals '4-Not Specified' in any case."""
    a = _tables(spark, sf_dir, t).appointment.select("appointment_id", "reason", "status")
    return TV.facet(a, "reason", "4-Not Specified", ANY_CASE)


def q_patients_sorted_any_case(spark, sf_dir, t=None) -> DataFrame:
    """T3 under a collation: positions of the patient register by full name, descending, register order among equals."""
    page = R.patient_list(_tables(spark, sf_dir, t), collation=ANY_CASE).select("patient_id", "full_name", "gender")
    short = page.withColumn("full_name", F.substring_index("full_name", " ", 1))
    return TV.positions(short, TV.sort_order("full_name", False, [F.col("patient_id")], collation=ANY_CASE))


def q_common_diagnoses_any_case(spark, sf_dir, t=None) -> DataFrame:
    """Q20 under a collation: codes, descriptions and severities count together whatever their case."""
    return _plain(R.common_diagnoses(_tables(spark, sf_dir, t), collation=ANY_CASE))


def q_outstanding_by_patient_status_any_case(spark, sf_dir, t=None) -> DataFrame:
    """Q30 under a collation: open balance per patient and status in any case."""
    return _plain(R.outstanding_by_patient_status(_tables(spark, sf_dir, t), collation=ANY_CASE))


def q_restock_by_name_any_case(spark, sf_dir, t=None) -> DataFrame:
    """C5 by name under a collation: one delivery per line, named in mixed case."""
    t = t or clinic_tables(spark, sf_dir)
    lines = _lines(read_driver_tables(spark, sf_dir, ("lineitem",))["lineitem"])
    names = t.medication.select("medication_id", "medication_name")
    batch = lines.join(names, F.col("l_partkey") == F.col("medication_id")).select(
        F.col("line_id").alias("seq"), _mixed("medication_name", "line_id"),
        F.round(F.col("l_tax") * 100).cast("int").cast("string").alias("quantity"))
    return _plain(C.restock(t.medication, batch, ANY_CASE).accepted)


QUERIES = {
    "facet_any_case": q_facet_any_case,
    "patients_sorted_any_case": q_patients_sorted_any_case,
    "common_diagnoses_any_case": q_common_diagnoses_any_case,
    "outstanding_by_patient_status_any_case": q_outstanding_by_patient_status_any_case,
    "restock_by_name_any_case": q_restock_by_name_any_case,
}

SQL = {
    "facet_any_case": _with(MIXED_SQL, """
SELECT appointment_id, reason, status FROM m_appointment WHERE reason COLLATE NOCASE = '4-Not Specified'"""),
    "patients_sorted_any_case": _with(MIXED_SQL, """
SELECT patient_id, first_name AS full_name, gender,
       row_number() OVER (ORDER BY first_name COLLATE NOCASE DESC, patient_id) AS position
FROM m_patient"""),
    "common_diagnoses_any_case": _with(MIXED_SQL, """
SELECT min(diagnosis_code) AS diagnosis_code, min(description) AS description, count(*) AS total_cases,
       count(*) FILTER (WHERE severity COLLATE NOCASE = 'Severe') AS severe_cases,
       count(*) FILTER (WHERE severity COLLATE NOCASE = 'Moderate') AS moderate_cases,
       count(*) FILTER (WHERE severity COLLATE NOCASE = 'Mild') AS mild_cases
FROM m_diagnosis GROUP BY diagnosis_code COLLATE NOCASE, description COLLATE NOCASE"""),
    "outstanding_by_patient_status_any_case": _with(MIXED_SQL, """
SELECT b.patient_id, p.first_name || ' ' || p.last_name AS patient_name, p.phone, b.outstanding_balance, b.payment_status
FROM (SELECT patient_id, min(payment_status) AS payment_status,
             CAST(sum(total_amount - amount_paid) AS DOUBLE) AS outstanding_balance
      FROM m_bill WHERE payment_status COLLATE NOCASE IN ('Unpaid', 'Partial')
      GROUP BY patient_id, payment_status COLLATE NOCASE) b
JOIN m_patient p ON p.patient_id = b.patient_id"""),
    "restock_by_name_any_case": _with("""
named AS (SELECT line_id, medication_name, CAST(round(l_tax * 100) AS INTEGER) AS q
          FROM line JOIN medication ON l_partkey = medication_id)""", """
SELECT m.medication_id, count(*) AS deliveries, CAST(sum(q) AS BIGINT) AS added,
       CAST(m.stock_quantity AS BIGINT) AS stock_before, CAST(m.stock_quantity + sum(q) AS BIGINT) AS stock_after
FROM named JOIN medication m ON lower(named.medication_name) = lower(m.medication_name)
WHERE q > 0 GROUP BY m.medication_id, m.stock_quantity"""),
}

"""Registered queries on tables that break the declared rules, on batches with repeated, blank and
unreadable rows, and of the new tables that change jobs return; each with its DuckDB oracle.

The stand-in tables take the clinic tables and break a constant share of their rows: null and unknown
references, repeated and null keys, values outside their domains.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.operators import changes as C
from carelake.operators import forms as FM
from carelake.operators import integrity as K
from carelake.session import checkpoint_dir
from carelake.sources.adapter import _lines, clinic_tables, read_driver_tables
from carelake.sources.schema import DOMAINS, FOREIGN_KEYS, PRIMARY_KEYS, TABLES, not_null_columns
from carelake.sources.tables import Tables
from operator_queries import (MEDICATION_UPDATE_SQL, PATIENT_UPDATE_SQL, PAYMENT_BATCH_SQL, _errors_text, _high_water, _plain, _s, _with,
                              medication_update_batch, patient_update_batch, payment_batch, restock_batch)

# table -> column -> [(share of the ids, value)]; then the share of rows that occur twice and that are missing
BROKEN: dict[str, dict[str, list[tuple[int, str]]]] = {
    "patient": {"gender": [(5, "'Unknown'")], "phone": [(4, "NULL")]},
    "appointment": {"patient_id": [(7, "NULL")], "staff_id": [(11, "staff_id + 1000000")], "clinic_id": [(13, "777")],
                    "status": [(10, "'No Show'"), (17, "NULL")]},
    "diagnosis": {"severity": [(3, "lower(severity)")]},
    "medication": {"medication_id": [(6, "NULL")]},
    "bill": {"payment_status": [(8, "'Open'")], "patient_id": [(14, "patient_id + 5000000")]},
}
TWICE = {"patient": 9, "bill": 12, "clinic": 5}
MISSING = {"appointment": 19}


def dirty_tables(t: Tables) -> Tables:
    out = Tables(t)

    def broken(name: str) -> DataFrame:
        k, df = PRIMARY_KEYS[name], t[name]
        if name in MISSING:
            df = df.where(f"{k} % {MISSING[name]} <> 0")
        if name in TWICE:
            df = df.unionByName(df.where(f"{k} % {TWICE[name]} = 0"))
        cases = {c: F.expr("CASE " + " ".join(f"WHEN {k} % {n} = 0 THEN {v}" for n, v in when) + f" ELSE {c} END")
                 for c, when in BROKEN.get(name, {}).items()}
        return df.select(*[cases[c].cast(df.schema[c].dataType).alias(c) if c in cases else F.col(c) for c in df.columns])

    for name in {*BROKEN, *TWICE, *MISSING}:
        out[name] = lambda name=name: broken(name)
    return out


def _dirty_sql() -> str:
    parts = []
    for name in TABLES:
        k = PRIMARY_KEYS[name]
        cases = ", ".join(f"CASE {' '.join(f'WHEN {k} % {n} = 0 THEN {v}' for n, v in when)} ELSE {c} END AS {c}"
                          for c, when in BROKEN.get(name, {}).items())
        replaced = f" REPLACE ({cases})" if cases else ""
        there = f" WHERE {k} % {MISSING[name]} <> 0" if name in MISSING else ""
        again = f" UNION ALL SELECT *{replaced} FROM {name} WHERE {k} % {TWICE[name]} = 0" if name in TWICE else ""
        parts.append(f"d_{name} AS (SELECT *{replaced} FROM {name}{there}{again})")
    return "\n" + ",\n".join(parts)


DIRTY_SQL = _dirty_sql()


def _dirty(spark, sf_dir, t) -> Tables:
    return dirty_tables(t or clinic_tables(spark, sf_dir))


def q_dirty_primary_keys(spark, sf_dir, t=None) -> DataFrame:
    """K1 on tables with repeated and null keys."""
    return K.primary_key_violations(_dirty(spark, sf_dir, t))


def q_dirty_foreign_keys(spark, sf_dir, t=None) -> DataFrame:
    """K2 on tables with null and unknown references and missing parents."""
    return K.foreign_key_orphans(_dirty(spark, sf_dir, t))


def q_dirty_orphan_keys(spark, sf_dir, t=None) -> DataFrame:
    """K2: each unknown or null key with the rows that name it."""
    return K.orphan_keys(_dirty(spark, sf_dir, t))


def q_dirty_nulls(spark, sf_dir, t=None) -> DataFrame:
    """K3 on tables with nulls where none may be."""
    return K.null_violations(_dirty(spark, sf_dir, t))


def q_dirty_domains(spark, sf_dir, t=None) -> DataFrame:
    """K4 on tables with values outside their domains."""
    return K.domain_violations(_dirty(spark, sf_dir, t))


def q_observed_violations(spark, sf_dir, t=None) -> DataFrame:
    """S7 + K3 + K4: the broken tables written as snapshots, and what was counted while they were written."""
    return K.write_checked_tables(_dirty(spark, sf_dir, t), f"{checkpoint_dir(spark).rstrip('/')}/checked-{uuid.uuid4().hex}")


def patient_delete_batch(spark, sf_dir: str) -> DataFrame:
    """A request per customer and a second one for every third; blanks around ids, unreadable, null and unknown ids."""
    c = read_driver_tables(spark, sf_dir, ("customer",))["customer"]
    k = F.col("c_custkey")
    text = (F.when(k % 10 == 0, F.lit(None)).when(k % 10 == 1, F.concat(F.lit("x"), _s(k))).when(k % 10 == 2, F.concat(F.lit(" "), _s(k), F.lit(" ")))
            .when(k % 10 == 3, _s(k + 10_000_000)).otherwise(_s(k)))
    one = c.select(k.alias("seq"), text.alias("id"))
    return one.unionByName(one.where(F.col("seq") % 3 == 0).withColumn("seq", F.col("seq") + 100_000_000))


PATIENT_DELETE_SQL = """
del0 AS (SELECT c_custkey AS seq, CASE c_custkey % 10 WHEN 0 THEN NULL WHEN 1 THEN 'x' || c_custkey WHEN 2 THEN ' ' || c_custkey || ' '
                WHEN 3 THEN CAST(c_custkey + 10000000 AS VARCHAR) ELSE CAST(c_custkey AS VARCHAR) END AS id FROM customer),
del AS (SELECT * FROM del0 UNION ALL SELECT seq + 100000000, id FROM del0 WHERE seq % 3 = 0),
del2 AS (SELECT seq, id, TRY_CAST(trim(id) AS BIGINT) AS k FROM del),
outcomes AS (
  SELECT seq, id, k, CASE WHEN NOT EXISTS (SELECT 1 FROM d_patient p WHERE p.patient_id = k) THEN 'not found'
       WHEN EXISTS (SELECT 1 FROM d_appointment a WHERE a.patient_id = k) OR EXISTS (SELECT 1 FROM d_bill b WHERE b.patient_id = k) THEN 'blocked'
       ELSE 'deleted' END AS outcome
  FROM del2)"""


def _deleted(spark, sf_dir, t) -> C.Changed:
    return C.delete_restrict(_dirty(spark, sf_dir, t), "patient", patient_delete_batch(spark, sf_dir))


def q_delete_patients(spark, sf_dir, t=None) -> DataFrame:
    """Outcome of each request, repeated, unreadable and unknown ids among them."""
    ch = _deleted(spark, sf_dir, t)
    return ch.accepted.unionByName(ch.rejected.select("seq", "id", F.col("errors")[0].alias("outcome")))


def q_patients_after_delete(spark, sf_dir, t=None) -> DataFrame:
    """The new patient table."""
    return _plain(_deleted(spark, sf_dir, t).table)


def repeated_medication_batch(spark, sf_dir: str) -> DataFrame:
    """Every medication's edit twice, for every fourth a third time with the same seq: only the first applies."""
    one = medication_update_batch(spark, sf_dir)
    second = one.select(F.col("seq") + 10_000_000, "medication_id", F.concat("medication_name", F.lit(" II")).alias("medication_name"),
                        "description", "unit", "stock_quantity").toDF(*one.columns)
    third = second.where(F.col("seq") % 4 == 0).withColumn("medication_name", F.concat("medication_name", F.lit("I")))
    return one.unionByName(second).unionByName(third)


REPEATED_SQL = MEDICATION_UPDATE_SQL.replace("med_in AS (", "med_one AS (", 1).replace("  FROM part),", """  FROM part),
med_two AS (SELECT seq + 10000000 AS seq, medication_id, medication_name || ' II' AS medication_name, description, unit, stock_quantity FROM med_one),
med_in AS (SELECT * FROM med_one UNION ALL SELECT * FROM med_two
           UNION ALL SELECT * REPLACE (medication_name || 'I' AS medication_name) FROM med_two WHERE seq % 4 = 0),""", 1) + """,
med_first AS (SELECT *, row_number() OVER (PARTITION BY mid ORDER BY seq, medication_name) AS nth FROM me WHERE len(errs) = 0)"""


def q_update_medications_repeated_rejected(spark, sf_dir, t=None) -> DataFrame:
    """Refused rows of a batch that edits each medication several times."""
    t = t or clinic_tables(spark, sf_dir)
    return _errors_text(FM.update_rows(t, "medication", repeated_medication_batch(spark, sf_dir)).rejected)


def q_medications_after_update(spark, sf_dir, t=None) -> DataFrame:
    """The new medication table after that batch."""
    t = t or clinic_tables(spark, sf_dir)
    return _plain(FM.update_rows(t, "medication", repeated_medication_batch(spark, sf_dir)).table)


def q_bills_after_payments(spark, sf_dir, t=None) -> DataFrame:
    """The new bill table."""
    t = t or clinic_tables(spark, sf_dir)
    return _plain(C.apply_payments(t.bill, payment_batch(spark, sf_dir)).table)


def q_restock_medications_rejected(spark, sf_dir, t=None) -> DataFrame:
    """Deliveries refused: no quantity, or a medication that isn't there."""
    t = t or clinic_tables(spark, sf_dir)
    return _errors_text(C.restock(t.medication.where("medication_id % 3 <> 0"), restock_batch(spark, sf_dir)).rejected)


def q_update_patients_rejected(spark, sf_dir, t=None) -> DataFrame:
    """C2 on the patient edit form: refused rows, for patients that are gone too."""
    t = t or clinic_tables(spark, sf_dir)
    t = t.replace(patient=t.patient.where("patient_id % 4 <> 0"))
    return _errors_text(FM.update_rows(t, "patient", patient_update_batch(spark, sf_dir)).rejected)


def q_rekey_patients_refused(spark, sf_dir, t=None) -> DataFrame:
    """Refused map rows: unknown and repeated old ids, repeated, missing and used new ids."""
    t = t or clinic_tables(spark, sf_dir)
    c = read_driver_tables(spark, sf_dir, ("customer",))["customer"]
    k = F.col("c_custkey").cast("long")
    old = F.when(k % 8 == 0, k + 10_000_000).when(k % 8 == 1, k - 1).otherwise(k)
    new = F.when(k % 6 == 0, F.lit(None)).when(k % 6 == 1, F.lit(3_000_000_000)).when(k % 6 == 2, k).otherwise(k + 3_000_000_000)
    _, refused = C.rekey(t, "patient", c.select(old.alias("old_id"), new.alias("new_id")))
    return _errors_text(refused)


def _from_supplier(spark, sf_dir: str, *columns: Column) -> DataFrame:
    return read_driver_tables(spark, sf_dir, ("supplier",))["supplier"].select(*columns)


def clinic_batch(spark, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return _from_supplier(spark, sf_dir, k.alias("seq"), F.when(k % 9 == 0, "  ").otherwise(F.col("s_name")).alias("clinic_name"),
                          F.concat("s_name", F.lit(" Road")).alias("location"), F.when(k % 4 == 0, F.repeat(F.lit("d"), 60)).otherwise("West").alias("district"),
                          F.concat(F.lit("+232-"), _s(k)).alias("phone"), F.when(k % 2 == 0, "").otherwise("a@b").alias("email"),
                          F.when(k % 3 == 0, "").when(k % 3 == 1, F.lit("2001-2-3")).otherwise("2001-02-30").alias("established_date"))


def staff_batch(spark, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return _from_supplier(spark, sf_dir, k.alias("seq"), _s(k % 30).alias("clinic_id"), F.lit("Ama").alias("first_name"), F.col("s_name").alias("last_name"),
                          F.when(k % 7 == 0, "").otherwise("Nurse").alias("role"), F.when(k % 2 == 0, " Female ").otherwise("female").alias("gender"),
                          F.concat(F.lit("+232-"), _s(k)).alias("phone"), F.lit("  ").alias("email"), F.lit("2020-5-6").alias("hire_date"))


def diagnosis_batch(spark, sf_dir: str) -> DataFrame:
    lines = _lines(read_driver_tables(spark, sf_dir, ("lineitem",))["lineitem"])
    k = F.col("line_id")
    return lines.select(k.alias("seq"), F.when(k % 5 == 0, F.lit("none")).otherwise(_s(F.col("l_orderkey") + k % 2)).alias("appointment_id"),
                        F.col("l_returnflag").alias("diagnosis_code"), F.when(k % 6 == 0, F.lit("\t ")).otherwise("cough").alias("description"),
                        F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, "Severe").otherwise("severe").alias("severity"),
                        _s(F.col("l_shipdate").cast("date")).alias("diagnosed_date"))


def _registered(name: str, batch) -> tuple:
    def accepted(spark, sf_dir, t=None) -> DataFrame:
        t = t or clinic_tables(spark, sf_dir)
        return _plain(FM.insert_rows(t, name, batch(spark, sf_dir), _high_water(t[name], PRIMARY_KEYS[name])).accepted)

    def rejected(spark, sf_dir, t=None) -> DataFrame:
        return _errors_text(FM.insert_rows(t or clinic_tables(spark, sf_dir), name, batch(spark, sf_dir), 0).rejected)

    accepted.__doc__, rejected.__doc__ = f"C1 on the {name} form: accepted rows with new ids.", f"{name} form rows refused, with their messages."
    return accepted, rejected


QUERIES = {
    "dirty_primary_keys": q_dirty_primary_keys, "dirty_foreign_keys": q_dirty_foreign_keys, "dirty_orphan_keys": q_dirty_orphan_keys,
    "dirty_nulls": q_dirty_nulls, "dirty_domains": q_dirty_domains, "observed_violations": q_observed_violations,
    "delete_patients": q_delete_patients, "patients_after_delete": q_patients_after_delete,
    "update_medications_repeated_rejected": q_update_medications_repeated_rejected, "medications_after_update": q_medications_after_update,
    "bills_after_payments": q_bills_after_payments, "restock_medications_rejected": q_restock_medications_rejected,
    "update_patients_rejected": q_update_patients_rejected, "rekey_patients_refused": q_rekey_patients_refused,
}
for _name, _key, _batch in (("clinic", "clinics", clinic_batch), ("staff", "staff", staff_batch), ("diagnosis", "diagnoses", diagnosis_batch)):
    QUERIES[f"register_{_key}"], QUERIES[f"register_{_key}_rejected"] = _registered(_name, _batch)


def _each(parts: list[str]) -> str:
    return _with(DIRTY_SQL, "\nUNION ALL\n".join(parts))


_REJECTED_MEDICATION = "SELECT seq, medication_id, medication_name, description, unit, stock_quantity, "


def _form_sql(rows: str, checks: list[str], typed: str) -> str:
    """``typed_in``: the batch with its parsed columns; ``judged``: with the messages of its rules in order."""
    return f"""
typed_in AS (SELECT b.*, {typed} FROM ({rows}) b),
judged AS (SELECT *, list_filter([{', '.join(checks)}], lambda x: x IS NOT NULL) AS errs FROM typed_in)"""


def _text(c: str, label: str, n: int | None = None) -> list[str]:
    blank = rf"trim({c}, ' ' || chr(9))"
    out = [f"CASE WHEN coalesce({blank} = '', true) THEN '{label} is required' END"]
    return out + ([f"CASE WHEN length({blank}) > {n} THEN '{label} is longer than {n} characters' END"] if n else [])


CLINIC_SQL = _form_sql("""SELECT s_suppkey AS seq, CASE WHEN s_suppkey % 9 = 0 THEN '  ' ELSE s_name END AS clinic_name, s_name || ' Road' AS location,
       CASE WHEN s_suppkey % 4 = 0 THEN repeat('d', 60) ELSE 'West' END AS district, '+232-' || s_suppkey AS phone,
       CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'a@b' END AS email,
       CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN '2001-2-3' ELSE '2001-02-30' END AS established_date FROM supplier""",
                       [*_text("clinic_name", "Clinic Name", 100), *_text("location", "Location", 150), *_text("district", "District", 50),
                        *_text("phone", "Phone", 20), "CASE WHEN length(trim(email)) > 100 THEN 'Email is longer than 100 characters' END",
                        "CASE WHEN trim(established_date) <> '' AND d IS NULL THEN 'Established Date must be a date (YYYY-MM-DD)' END"],
                       "try_strptime(trim(established_date), '%Y-%m-%d')::DATE AS d")
STAFF_SQL = _form_sql("""SELECT s_suppkey AS seq, CAST(s_suppkey % 30 AS VARCHAR) AS clinic_id, 'Ama' AS first_name, s_name AS last_name,
       CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE 'Nurse' END AS role, CASE WHEN s_suppkey % 2 = 0 THEN ' Female ' ELSE 'female' END AS gender,
       '+232-' || s_suppkey AS phone, '  ' AS email, '2020-5-6' AS hire_date FROM supplier""",
                      ["CASE WHEN cid IS NULL OR cid NOT IN (SELECT clinic_id FROM clinic) THEN 'Clinic does not exist' END",
                       *_text("first_name", "First Name", 50), *_text("last_name", "Last Name", 50), *_text("role", "Role", 50),
                       "CASE WHEN trim(gender) NOT IN ('Male', 'Female', 'Other') THEN 'Gender must be one of Male, Female, Other' END",
                       *_text("phone", "Phone", 20)], "TRY_CAST(clinic_id AS BIGINT) AS cid")
DIAGNOSIS_SQL = _form_sql("""SELECT line_id AS seq, CASE WHEN line_id % 5 = 0 THEN 'none' ELSE CAST(l_orderkey + line_id % 2 AS VARCHAR) END AS appointment_id,
       l_returnflag AS diagnosis_code, CASE WHEN line_id % 6 = 0 THEN chr(9) || ' ' ELSE 'cough' END AS description,
       CASE line_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Severe' ELSE 'severe' END AS severity,
       CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS diagnosed_date FROM line""",
                          ["CASE WHEN aid IS NULL OR aid NOT IN (SELECT appointment_id FROM appointment) THEN 'Appointment does not exist' END",
                           *_text("diagnosis_code", "Code", 20), *_text("description", "Description", 300),
                           "CASE WHEN severity NOT IN ('', 'Mild', 'Moderate', 'Severe') THEN 'Severity must be one of Mild, Moderate, Severe' END"],
                          "TRY_CAST(appointment_id AS BIGINT) AS aid")


def _new_id(table: str) -> str:
    k = PRIMARY_KEYS[table]
    return f"(SELECT max({k}) FROM {table}) + row_number() OVER (ORDER BY seq) AS {k}"


SQL = {
    "dirty_primary_keys": _each([f"""SELECT '{t}' AS table_name, '{k}' AS key_column, count(*) FILTER (WHERE {k} IS NOT NULL AND n > 1) AS duplicate_keys,
       CAST(coalesce(sum(n) FILTER (WHERE {k} IS NOT NULL AND n > 1), 0) AS BIGINT) AS duplicate_rows,
       CAST(coalesce(sum(n) FILTER (WHERE {k} IS NULL), 0) AS BIGINT) AS null_keys
FROM (SELECT {k}, count(*) AS n FROM d_{t} GROUP BY {k})""" for t, k in PRIMARY_KEYS.items()]),
    "dirty_foreign_keys": _each([f"""SELECT '{c}' AS child_table, '{fk}' AS child_column, '{p}' AS parent_table, count(*) AS orphan_rows
FROM d_{c} x WHERE NOT EXISTS (SELECT 1 FROM d_{p} y WHERE y.{PRIMARY_KEYS[p]} = x.{fk})""" for c, fk, p in FOREIGN_KEYS]),
    "dirty_orphan_keys": _each([f"""SELECT '{c}' AS child_table, '{fk}' AS child_column, '{p}' AS parent_table, CAST({fk} AS BIGINT) AS key, count(*) AS orphan_rows
FROM d_{c} x WHERE NOT EXISTS (SELECT 1 FROM d_{p} y WHERE y.{PRIMARY_KEYS[p]} = x.{fk}) GROUP BY {fk}""" for c, fk, p in FOREIGN_KEYS]),
    "dirty_nulls": _each([f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_rows FROM d_{t}"
                          for t in TABLES for c in not_null_columns(t)]),
    "dirty_domains": _each([f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) FILTER (WHERE {c} NOT IN {tuple(values)}) AS bad_rows FROM d_{t}"
                            for (t, c), values in DOMAINS.items()]),
    "observed_violations": _each(
        [f"SELECT '{t}' AS table_name, '{c}' AS column_name, 'null' AS rule, count(*) FILTER (WHERE {c} IS NULL) AS bad_rows FROM d_{t}"
         for t in TABLES for c in not_null_columns(t)]
        + [f"SELECT '{t}' AS table_name, '{c}' AS column_name, 'domain' AS rule, count(*) FILTER (WHERE {c} NOT IN {tuple(values)}) AS bad_rows FROM d_{t}"
           for (t, c), values in DOMAINS.items()]),
    "delete_patients": _with(DIRTY_SQL + "," + PATIENT_DELETE_SQL, "SELECT seq, id, outcome FROM outcomes"),
    "patients_after_delete": _with(DIRTY_SQL + "," + PATIENT_DELETE_SQL, """
SELECT * REPLACE (strftime(date_of_birth, '%Y-%m-%d') AS date_of_birth, strftime(registration_date, '%Y-%m-%d') AS registration_date) FROM d_patient
WHERE patient_id NOT IN (SELECT k FROM outcomes WHERE outcome = 'deleted')"""),
    "update_medications_repeated_rejected": _with(REPEATED_SQL, f"""
{_REJECTED_MEDICATION} array_to_string(errs, '; ') AS errors FROM me WHERE len(errs) > 0
UNION ALL {_REJECTED_MEDICATION} 'duplicate in batch' FROM med_first WHERE nth > 1"""),
    "medications_after_update": _with(REPEATED_SQL, """
SELECT m.medication_id, CASE WHEN f.mid IS NULL THEN m.medication_name ELSE trim(f.medication_name) END AS medication_name,
       CASE WHEN f.mid IS NULL THEN m.description ELSE nullif(trim(f.description), '') END AS description,
       CASE WHEN f.mid IS NULL THEN m.unit ELSE trim(f.unit) END AS unit,
       CAST(CASE WHEN f.mid IS NULL THEN m.stock_quantity ELSE f.q END AS BIGINT) AS stock_quantity
FROM medication m LEFT JOIN (SELECT * FROM med_first WHERE nth = 1) f ON m.medication_id = f.mid"""),
    "bills_after_payments": _with(PAYMENT_BATCH_SQL, """
, per AS (SELECT bid, sum(amt) AS paid_now FROM pe WHERE len(errs) = 0 GROUP BY bid),
nb AS (SELECT b.*, CASE WHEN per.bid IS NULL THEN b.amount_paid ELSE least(b.total_amount, b.amount_paid + per.paid_now) END AS now, per.bid
       FROM bill b LEFT JOIN per ON b.bill_id = per.bid)
SELECT bill_id, patient_id, appointment_id, CAST(total_amount AS DOUBLE) AS total_amount, CAST(now AS DOUBLE) AS amount_paid,
       strftime(bill_date, '%Y-%m-%d') AS bill_date,
       CASE WHEN bid IS NULL THEN payment_status WHEN now >= total_amount THEN 'Paid' ELSE 'Partial' END AS payment_status FROM nb"""),
    "restock_medications_rejected": _with("""
restock_in AS (SELECT line_id AS seq, CAST(l_partkey AS VARCHAR) AS medication_id,
                      CAST(CAST(round(l_tax * 100) AS INTEGER) AS VARCHAR) AS quantity FROM line),
judged AS (SELECT *, list_filter([
    CASE WHEN CAST(quantity AS INTEGER) <= 0 THEN 'Quantity must be a whole number greater than zero' END,
    CASE WHEN CAST(medication_id AS BIGINT) NOT IN (SELECT m.medication_id FROM medication m WHERE m.medication_id % 3 <> 0)
         THEN 'Medication does not exist' END], lambda x: x IS NOT NULL) AS errs FROM restock_in)""", """
SELECT seq, medication_id, quantity, array_to_string(errs, '; ') AS errors FROM judged WHERE len(errs) > 0"""),
    "update_patients_rejected": _with(PATIENT_UPDATE_SQL, """
SELECT seq, patient_id, first_name, last_name, date_of_birth, gender, address, phone, blood_type, registration_date,
       CASE WHEN len(errs) > 0 THEN array_to_string(errs, '; ') ELSE 'id does not exist' END AS errors
FROM pe2 WHERE len(errs) > 0 OR CAST(patient_id AS BIGINT) NOT IN (SELECT p.patient_id FROM patient p WHERE p.patient_id % 4 <> 0)"""),
    "rekey_patients_refused": _with("""
km AS (SELECT CAST(CASE c_custkey % 8 WHEN 0 THEN c_custkey + 10000000 WHEN 1 THEN c_custkey - 1 ELSE c_custkey END AS BIGINT) AS old_id,
              CAST(CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 3000000000 WHEN 2 THEN c_custkey ELSE c_custkey + 3000000000 END AS BIGINT) AS new_id
       FROM customer),
judged AS (SELECT *, list_filter([
    CASE WHEN old_id NOT IN (SELECT patient_id FROM patient) THEN 'Old id does not exist' END,
    CASE WHEN count(*) OVER (PARTITION BY old_id) > 1 THEN 'Old id is named twice' END,
    CASE WHEN new_id IS NULL THEN 'New id is missing' END,
    CASE WHEN new_id IS NOT NULL AND count(*) OVER (PARTITION BY new_id) > 1 THEN 'New id is named twice' END,
    CASE WHEN new_id IN (SELECT patient_id FROM patient) THEN 'New id is in use' END], lambda x: x IS NOT NULL) AS errs FROM km)""", """
SELECT old_id, new_id, array_to_string(errs, '; ') AS errors FROM judged WHERE len(errs) > 0"""),
    "register_clinics": _with(CLINIC_SQL, f"""
SELECT {_new_id('clinic')}, trim(clinic_name) AS clinic_name, location, district, phone, nullif(email, '') AS email,
       strftime(d, '%Y-%m-%d') AS established_date FROM judged WHERE len(errs) = 0"""),
    "register_clinics_rejected": _with(CLINIC_SQL, """
SELECT seq, clinic_name, location, district, phone, email, established_date, array_to_string(errs, '; ') AS errors FROM judged WHERE len(errs) > 0"""),
    "register_staff": _with(STAFF_SQL, f"""
SELECT {_new_id('staff')}, cid AS clinic_id, first_name, last_name, role, trim(gender) AS gender, phone, CAST(NULL AS VARCHAR) AS email,
       '2020-05-06' AS hire_date FROM judged WHERE len(errs) = 0"""),
    "register_staff_rejected": _with(STAFF_SQL, """
SELECT seq, clinic_id, first_name, last_name, role, gender, phone, email, hire_date, array_to_string(errs, '; ') AS errors FROM judged WHERE len(errs) > 0"""),
    "register_diagnoses": _with(DIAGNOSIS_SQL, f"""
SELECT {_new_id('diagnosis')}, aid AS appointment_id, diagnosis_code, description, CASE severity WHEN '' THEN 'Mild' ELSE severity END AS severity,
       diagnosed_date FROM judged WHERE len(errs) = 0"""),
    "register_diagnoses_rejected": _with(DIAGNOSIS_SQL, """
SELECT seq, appointment_id, diagnosis_code, description, severity, diagnosed_date, array_to_string(errs, '; ') AS errors FROM judged WHERE len(errs) > 0"""),
}

"""Named reads (Q1-Q35) and the README reports (R1-R4) as DataFrame jobs.

Every function takes the clinic ``Tables`` and returns a lazy DataFrame.  With
``display=True`` the columns carry the text the application shows (dates as
``01 May 2024``, money as ``Le 1,234``, NULL as ``-``); otherwise they are typed.

Plan rules followed throughout:

* aggregate a child table on its key *before* joining it to the parent, so
  m x n fan-outs never form and ``COUNT(DISTINCT)`` becomes a plain count;
* group facts by the key alone and join descriptive columns afterwards;
* top-k runs on the fact table first and joins the k survivors afterwards
  (the declared foreign keys guarantee every fact row has its parents);
* joins carry no hints: AQE broadcasts a side only when its measured size is
  under ``spark.sql.autoBroadcastJoinThreshold`` and sort-merges otherwise.

Every top-k and listing appends the unique key as the last sort key, so ties are
resolved deterministically.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..sources.tables import Tables
from .skew import salted_join


def _zero() -> Column:
    return F.lit(0).cast("decimal(20,2)")


def _patients(t: Tables) -> DataFrame:
    return t.patient.select("patient_id", X.full_name("first_name", "last_name").alias("patient_name"))


def _staff_names(t: Tables) -> DataFrame:
    return t.staff.select("staff_id", X.full_name("first_name", "last_name").alias("staff_name"))


def _clinic_names(t: Tables) -> DataFrame:
    return t.clinic.select("clinic_id", "clinic_name")


def _date(c: str, display: bool) -> Column:
    return X.display_date(c).alias(c) if display else F.col(c)


def _money(c: Column, name: str, display: bool) -> Column:
    return (X.money_text(c) if display else c).alias(name)


def _topk(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def _sum0(c: Column) -> Column:
    return F.coalesce(F.sum(c), _zero())


def _bills_per_appointment(t: Tables) -> DataFrame:
    """One row per billed appointment: summed amounts (several bills are legal)."""
    return t.bill.groupBy("appointment_id").agg(
        F.sum("total_amount").alias("billed"),
        F.sum("amount_paid").alias("collected"),
        F.sum(F.col("total_amount") - F.col("amount_paid")).alias("outstanding"),
    )


# ── Q1 ──────────────────────────────────────────────────────────────────────
def dashboard_metrics(t: Tables, display: bool = False) -> DataFrame:
    """Q1: patients, staff, clinics, appointments, collected, outstanding in one row.

    Each table is reduced to one row by its own aggregate; the rows are unioned
    and folded into one, so no cross join is needed.
    """
    parts = [
        t.patient.agg(F.count(F.lit(1)).alias("patients")),
        t.staff.agg(F.count(F.lit(1)).alias("staff")),
        t.clinic.agg(F.count(F.lit(1)).alias("clinics")),
        t.appointment.agg(F.count(F.lit(1)).alias("appointments")),
        t.bill.agg(
            _sum0(F.col("amount_paid")).cast("decimal(20,2)").alias("collected"),
            _sum0(F.col("total_amount") - F.col("amount_paid")).cast("decimal(20,2)").alias("outstanding"),
        ),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    names = ["patients", "staff", "clinics", "appointments", "collected", "outstanding"]
    one = rows.agg(*[F.max(n).alias(n) for n in names])
    if not display:
        return one
    # the dashboard cards format money half-even (X8), the report tables half-up
    return one.select(*[X.thousands(n).alias(n) for n in names[:4]],
                      *[X.money_text_half_even(n).alias(n) for n in names[4:]])


# ── Q2 / Q6 / Q15 appointment listings ──────────────────────────────────────
def _newest() -> tuple[Column, ...]:
    return (F.col("appointment_date").desc(), F.col("appointment_time").desc(), F.col("appointment_id").asc())


def _appointment_rows(appts: DataFrame, t: Tables, display: bool, with_reason: bool) -> DataFrame:
    df = (appts.join(_patients(t), "patient_id")
          .join(_staff_names(t), "staff_id")
          .join(_clinic_names(t), "clinic_id"))
    cols = [F.col("appointment_id"), _date("appointment_date", display),
            (X.display_time("appointment_time") if display else F.col("appointment_time")).alias("appointment_time"),
            "patient_name", "staff_name", "clinic_name", "status"]
    if with_reason:
        cols.append("reason")
    return df.orderBy(*_newest()).select(*cols)


def recent_appointments(t: Tables, k: int = 10, display: bool = True) -> DataFrame:
    """Q2: the newest ``k`` visits with patient, staff and clinic names."""
    newest = _topk(t.appointment, k, *_newest())
    return _appointment_rows(newest, t, display, with_reason=False)


def appointment_list(t: Tables, display: bool = True) -> DataFrame:
    """Q6: the full schedule, newest first."""
    return _appointment_rows(t.appointment, t, display, with_reason=True)


def appointment_options(t: Tables, display: bool = True) -> DataFrame:
    """Q15: appointment picker rows, newest first."""
    return (t.appointment.join(_patients(t), "patient_id").orderBy(*_newest())
            .select("appointment_id", "patient_name", _date("appointment_date", display), "status"))


# ── Q3 / Q23 / Q24 / Q33 patient listings ───────────────────────────────────
_BY_NAME = ("last_name", "first_name", "patient_id")


def _by_name(collation: str | None) -> list[Column]:
    return [X.collated("last_name", collation), X.collated("first_name", collation)]


def patient_list(t: Tables, display: bool = True, collation: str | None = None) -> DataFrame:
    """Q3: the patient register ordered by last then first name."""
    p = t.patient
    return p.orderBy(*_by_name(collation), "patient_id").select(
        "patient_id", X.full_name("first_name", "last_name").alias("full_name"),
        _date("date_of_birth", display), "gender", "phone",
        (X.if_null("blood_type", X.NULL_TEXT) if display else F.col("blood_type")).alias("blood_type"),
        _date("registration_date", display))


def patient_options(t: Tables) -> DataFrame:
    """Patient picker rows (Q3 cut to id and name), by last then first name."""
    return t.patient.orderBy(*_BY_NAME).select(
        "patient_id", X.full_name("first_name", "last_name").alias("patient_name"))


def patients_basic(t: Tables) -> DataFrame:
    """Q23: id, name, birth date, gender, phone by last then first name."""
    return t.patient.orderBy(*_BY_NAME).select(
        "patient_id", X.full_name("first_name", "last_name").alias("full_name"),
        "date_of_birth", "gender", "phone")


def patients_registered_since(t: Tables, since: str = "2024-01-01") -> DataFrame:
    """Q24: patients registered on or after ``since`` (pushed to the scan)."""
    return (t.patient.where(F.col("registration_date") >= F.lit(since).cast("date"))
            .orderBy("registration_date", "patient_id")
            .select("patient_id", X.full_name("first_name", "last_name").alias("full_name"),
                    "registration_date"))


def latest_patients(t: Tables, k: int = 5) -> DataFrame:
    """Q33: the ``k`` most recently registered patients."""
    return (_topk(t.patient, k, F.col("registration_date").desc(), F.col("patient_id").asc())
            .select("patient_id", X.full_name("first_name", "last_name").alias("full_name"),
                    "registration_date"))


# ── Q4 / Q17 / Q35 staff and clinic listings ────────────────────────────────
def staff_list(t: Tables, display: bool = True) -> DataFrame:
    """Q4: staff with their clinic, by clinic, role and last name."""
    s = t.staff.join(_clinic_names(t), "clinic_id")
    return s.orderBy("clinic_name", "role", "last_name", "staff_id").select(
        "staff_id", X.full_name("first_name", "last_name").alias("staff_name"), "role",
        "clinic_name", "gender", "phone",
        (X.if_null("email", X.NULL_TEXT) if display else F.col("email")).alias("email"),
        _date("hire_date", display))


def staff_directory(t: Tables, collation: str | None = None) -> DataFrame:
    """Q17: staff picker rows by last then first name."""
    return t.staff.orderBy(*_by_name(collation), "staff_id").select(
        "staff_id", X.full_name("first_name", "last_name").alias("staff_name"), "role")


def clinic_directory(t: Tables, collation: str | None = None) -> DataFrame:
    """Q35: clinic picker rows by name."""
    return t.clinic.orderBy(X.collated("clinic_name", collation), "clinic_id").select("clinic_id", "clinic_name")


def clinic_activity(t: Tables, display: bool = True) -> DataFrame:
    """Q5: clinics with their staff and appointment counts (zero kept).

    Both children are counted per clinic first and then left-joined, instead of
    joining both to the clinic and counting distinct ids over the m x n product.
    """
    staff_n = t.staff.groupBy("clinic_id").agg(F.count(F.lit(1)).alias("staff_count"))
    appt_n = t.appointment.groupBy("clinic_id").agg(F.count(F.lit(1)).alias("appointment_count"))
    c = t.clinic.join(staff_n, "clinic_id", "left").join(appt_n, "clinic_id", "left")
    return c.orderBy("clinic_name", "clinic_id").select(
        "clinic_id", "clinic_name", "district", "location", "phone",
        (X.if_null("email", X.NULL_TEXT) if display else F.col("email")).alias("email"),
        F.coalesce("staff_count", F.lit(0)).alias("staff_count"),
        F.coalesce("appointment_count", F.lit(0)).alias("appointment_count"))


# ── Q7 / Q16 diagnosis listings ─────────────────────────────────────────────
def _diagnoses_with_patient(t: Tables) -> DataFrame:
    visits = t.appointment.select("appointment_id", "patient_id", F.col("status").alias("visit_status"))
    return t.diagnosis.join(visits, "appointment_id").join(_patients(t), "patient_id")


def _diag_order() -> tuple[Column, ...]:
    return (F.col("diagnosed_date").desc(), F.col("diagnosis_id").desc())


def diagnosis_list(t: Tables, display: bool = True) -> DataFrame:
    """Q7: diagnoses with the patient and the visit status, newest first."""
    return _diagnoses_with_patient(t).orderBy(*_diag_order()).select(
        "diagnosis_id", _date("diagnosed_date", display), "patient_name", "diagnosis_code",
        "description", "severity", "visit_status")


def diagnosis_options(t: Tables, display: bool = True) -> DataFrame:
    """Q16: diagnosis picker rows, newest first."""
    return _diagnoses_with_patient(t).orderBy(*_diag_order()).select(
        "diagnosis_id", "diagnosis_code", "patient_name", _date("diagnosed_date", display))


# ── Q8 / Q9 / Q18 medication listings ──────────────────────────────────────
def prescription_list(t: Tables, display: bool = True) -> DataFrame:
    """Q8: prescriptions through diagnosis and visit to the patient, plus the medication."""
    visits = t.appointment.select("appointment_id", "patient_id")
    df = (t.prescription
          .join(t.diagnosis.select("diagnosis_id", "appointment_id"), "diagnosis_id")
          .join(visits, "appointment_id")
          .join(_patients(t), "patient_id")
          .join(t.medication.select("medication_id", "medication_name"), "medication_id"))
    return df.orderBy(F.col("prescribed_date").desc(), F.col("prescription_id").desc()).select(
        "prescription_id", _date("prescribed_date", display), "patient_name", "medication_name",
        "dosage", "frequency",
        (X.with_suffix("duration_days", " days") if display else F.col("duration_days")).alias("duration"))


def medication_inventory(t: Tables, display: bool = True) -> DataFrame:
    """Q9: the medication table by name."""
    return t.medication.orderBy("medication_name", "medication_id").select(
        "medication_id", "medication_name", "unit", "stock_quantity",
        (X.if_null("description", X.NULL_TEXT) if display else F.col("description")).alias("description"))


def medication_stock_options(t: Tables, with_stock: bool = True) -> DataFrame:
    """Q18: medication picker rows by name (optionally with stock)."""
    cols = ["medication_id", "medication_name"] + (["stock_quantity"] if with_stock else [])
    return t.medication.orderBy("medication_name", "medication_id").select(*cols)


# ── Q10 / Q14 / Q26 bill listings ───────────────────────────────────────────
def _bills_with_patient(t: Tables) -> DataFrame:
    return t.bill.join(_patients(t), "patient_id").withColumn(
        "balance", F.col("total_amount") - F.col("amount_paid"))


def bill_list(t: Tables, display: bool = True) -> DataFrame:
    """Q10: bills with the balance, newest first."""
    return _bills_with_patient(t).orderBy(F.col("bill_date").desc(), F.col("bill_id").desc()).select(
        "bill_id", "patient_name", _date("bill_date", display),
        _money(F.col("total_amount"), "total_amount", display),
        _money(F.col("amount_paid"), "amount_paid", display),
        _money(F.col("balance"), "balance", display), "payment_status")


def outstanding_bills(t: Tables) -> DataFrame:
    """Q14: bills with something left to pay (payment picker), newest first."""
    return (_bills_with_patient(t).where(F.col("total_amount") > F.col("amount_paid"))
            .orderBy(F.col("bill_date").desc(), F.col("bill_id").desc())
            .select("bill_id", "patient_name", "total_amount", "amount_paid", "balance"))


def bills_by_amount(t: Tables) -> DataFrame:
    """Q26: bills by total, highest first."""
    return _bills_with_patient(t).orderBy(F.col("total_amount").desc(), F.col("bill_id").asc()).select(
        "bill_id", "patient_name", "total_amount", "amount_paid",
        F.col("balance").alias("outstanding_balance"), "payment_status")


# ── Q11 / Q12 / Q34 visit histories ─────────────────────────────────────────
def _first_per_appointment(df: DataFrame, id_col: str, cols: list[str], prefix: str) -> DataFrame:
    """The row with the smallest ``id_col`` per appointment, by an algebraic aggregate."""
    pick = F.min_by(F.struct(id_col, *cols), F.col(id_col)).alias("first")
    return df.groupBy("appointment_id").agg(pick).select(
        "appointment_id", *[F.col(f"first.{c}").alias(f"{prefix}{c}") for c in [id_col, *cols]])


def _visit_pairs(t: Tables, visits: DataFrame, outer: bool) -> DataFrame:
    """Visit rows carrying a diagnosis and a bill of the same appointment.

    Every diagnosis is paired with the appointment's first bill, and every further
    bill with the appointment's first diagnosis.  This equals the plain
    ``diagnosis x bill`` join whenever an appointment has at most one bill or at
    most one diagnosis (the billing job never creates a second bill), and stays
    linear when both are many.  ``outer=True`` keeps visits without either child.
    """
    how = "left" if outer else "inner"
    diag = t.diagnosis.select("appointment_id", "diagnosis_id", "description", "severity")
    bills = t.bill.select("appointment_id", "bill_id", "total_amount", "payment_status")
    first_bill = _first_per_appointment(bills, "bill_id", ["total_amount", "payment_status"], "b_")
    first_diag = _first_per_appointment(diag, "diagnosis_id", ["description", "severity"], "d_")

    def named(df: DataFrame, p: str) -> DataFrame:
        return df.select("appointment_id", *[F.col(c).alias(p + c) for c in df.columns if c != "appointment_id"])

    # One row per visit with its first bill and first diagnosis; the children meet it under salts,
    # so a visit that holds most of the diagnoses (or bills) is spread over many tasks.
    one = visits.join(first_bill, "appointment_id", how).join(first_diag, "appointment_id", how)
    of_bill, of_diag = ([c for c in df.columns if c != "appointment_id"] for df in (first_bill, first_diag))
    each_diag = salted_join(named(diag, "d_"), one.drop(*of_diag), "appointment_id", F.xxhash64("d_diagnosis_id"))
    if outer:
        each_diag = each_diag.unionByName(one.where(F.col("d_diagnosis_id").isNull()).drop(*of_diag), allowMissingColumns=True)
    first = one.withColumnRenamed("b_bill_id", "first_bill_id").drop(*of_bill)
    each_more_bill = (salted_join(named(bills, "b_"), first, "appointment_id", F.xxhash64("b_bill_id"))
                      .where(F.col("b_bill_id") != F.col("first_bill_id")).drop("first_bill_id"))
    return each_diag.unionByName(each_more_bill)


def patient_visit_history(t: Tables, patient_id: int | None = None, display: bool = True) -> DataFrame:
    """Q11: every visit with clinic, staff, diagnosis and bill; one patient or all.

    Visits without a diagnosis or a bill are kept (outer), shown as ``-``.
    """
    a = t.appointment if patient_id is None else t.appointment.where(F.col("patient_id") == patient_id)
    visits = a.join(_clinic_names(t), "clinic_id").join(_staff_names(t), "staff_id")
    rows = _visit_pairs(t, visits, outer=True)
    nt = (lambda c: X.null_text(c)) if display else F.col
    bill_total = (F.coalesce(X.money_text("b_total_amount"), F.lit(X.NULL_TEXT)) if display
                  else F.col("b_total_amount"))
    return rows.orderBy("patient_id", *_newest(), "d_diagnosis_id", "b_bill_id").select(
        "patient_id", "appointment_id", _date("appointment_date", display),
        (X.display_time("appointment_time") if display else F.col("appointment_time")).alias("appointment_time"),
        "clinic_name", "staff_name", "status", "reason",
        nt("d_description").alias("diagnosis"), nt("d_severity").alias("severity"),
        bill_total.alias("bill_total"), nt("b_payment_status").alias("payment_status"))


def patient_header(t: Tables, patient_id: int | None = None) -> DataFrame:
    """Q12: name, phone, blood type (or ``Unknown``), gender and the visit-row count.

    The count equals the number of rows ``patient_visit_history`` lists for the
    patient, computed from per-appointment counts without building those rows.
    """
    p = t.patient if patient_id is None else t.patient.where(F.col("patient_id") == patient_id)
    a = t.appointment if patient_id is None else t.appointment.where(F.col("patient_id") == patient_id)
    a = a.join(t.clinic, "clinic_id", "left_semi").join(t.staff, "staff_id", "left_semi")
    nd = t.diagnosis.groupBy("appointment_id").agg(F.count(F.lit(1)).alias("nd"))
    nb = t.bill.groupBy("appointment_id").agg(F.count(F.lit(1)).alias("nb"))
    per_visit = (a.select("appointment_id", "patient_id")
                 .join(nd, "appointment_id", "left").join(nb, "appointment_id", "left")
                 .select("patient_id",
                         (F.greatest(F.coalesce("nd", F.lit(0)), F.lit(1))
                          + F.greatest(F.coalesce("nb", F.lit(0)) - 1, F.lit(0))).alias("rows")))
    per_patient = per_visit.groupBy("patient_id").agg(F.sum("rows").alias("visit_rows"))
    return p.join(per_patient, "patient_id", "left").select(
        "patient_id", X.full_name("first_name", "last_name").alias("patient_name"), "phone",
        X.if_null("blood_type", "Unknown").alias("blood_type"), "gender",
        F.coalesce("visit_rows", F.lit(0)).cast("long").alias("visit_rows"))


def full_visit_history(t: Tables) -> DataFrame:
    """Q34: patient, visit date, clinic, diagnosis and bill for visits having both.

    Names are looked up before the children are joined, while there is one row a visit.  Where the snapshots are bucketed
    by visit they come last instead, so that visits and children meet without a shuffle.
    """
    visits = t.appointment.select("appointment_id", "patient_id", "clinic_id", "appointment_date")
    named = lambda df: df.join(_patients(t), "patient_id").join(_clinic_names(t), "clinic_id")
    if t.bucketed("appointment_id", "appointment", "diagnosis", "bill"):
        rows = named(_visit_pairs(t, visits, outer=False))
    else:
        rows = _visit_pairs(t, named(visits), outer=False)
    return rows.orderBy("patient_id", "appointment_date", "appointment_id", "d_diagnosis_id", "b_bill_id").select(
        "patient_id", "patient_name", "appointment_date", "clinic_name",
        F.col("d_description").alias("diagnosis"), F.col("d_severity").alias("severity"),
        F.col("b_total_amount").alias("total_amount"), F.col("b_payment_status").alias("payment_status"))


# ── Q13 / Q25 appointment filters ───────────────────────────────────────────
def unbilled_appointments(t: Tables, display: bool = True) -> DataFrame:
    """Q13: appointments without any bill (anti join against the billed ids, each once), newest first."""
    a = t.appointment.join(t.bill.select("appointment_id").distinct(), "appointment_id", "left_anti")
    return (a.join(_patients(t), "patient_id").join(_clinic_names(t), "clinic_id")
            .orderBy(*_newest())
            .select("appointment_id", "patient_id", "patient_name",
                    _date("appointment_date", display), "clinic_name"))


def clinic_visits_by_status(t: Tables, clinic_id: int = 1, status: str = "Completed") -> DataFrame:
    """Q25: one clinic's appointments in one status, by date."""
    a = t.appointment.where((F.col("clinic_id") == clinic_id) & (F.col("status") == status))
    return (a.join(_patients(t), "patient_id").orderBy("appointment_date", "appointment_id")
            .select("appointment_id", "patient_name", "appointment_date", "reason", "status"))


# ── Q19 / Q27 / Q28 clinic aggregates ───────────────────────────────────────
def revenue_by_clinic(t: Tables, display: bool = False) -> DataFrame:
    """Q19: visits, billed, collected and outstanding per clinic, clinics without visits kept.

    Bills are summed per appointment first (one row per appointment), so the visit
    count is a plain count and no distinct aggregate or fan-out is needed.
    """
    per_visit = (t.appointment.select("appointment_id", "clinic_id")
                 .join(_bills_per_appointment(t), "appointment_id", "left"))
    per_clinic = per_visit.groupBy("clinic_id").agg(
        F.count(F.lit(1)).alias("visits"),
        F.sum("billed").alias("billed"), F.sum("collected").alias("collected"),
        F.sum("outstanding").alias("outstanding"))
    c = _clinic_names(t).join(per_clinic, "clinic_id", "left")
    money = [(F.coalesce(F.col(s), _zero()).cast("decimal(20,2)"), n) for s, n in
             (("billed", "total_billed"), ("collected", "total_collected"), ("outstanding", "total_outstanding"))]
    return c.orderBy(F.coalesce(F.col("collected"), _zero()).desc(), F.col("clinic_id")).select(
        "clinic_id", "clinic_name", F.coalesce("visits", F.lit(0)).alias("visits"),
        *[_money(e, n, display) for e, n in money])


def appointments_per_clinic(t: Tables) -> DataFrame:
    """Q27: appointment count per clinic, zero kept."""
    n = t.appointment.groupBy("clinic_id").agg(F.count(F.lit(1)).alias("total_appointments"))
    c = _clinic_names(t).join(n, "clinic_id", "left").select(
        "clinic_id", "clinic_name", F.coalesce("total_appointments", F.lit(0)).alias("total_appointments"))
    return c.orderBy(F.col("total_appointments").desc(), "clinic_id")


def revenue_by_billed_clinic(t: Tables) -> DataFrame:
    """Q28: bill sums per clinic over billed visits only (inner: empty clinics drop out)."""
    per_clinic = (_bills_per_appointment(t)
                  .join(t.appointment.select("appointment_id", "clinic_id"), "appointment_id")
                  .groupBy("clinic_id").agg(
                      F.sum("billed").cast("decimal(20,2)").alias("total_billed"),
                      F.sum("collected").cast("decimal(20,2)").alias("total_collected"),
                      F.sum("outstanding").cast("decimal(20,2)").alias("total_outstanding")))
    return (per_clinic.join(_clinic_names(t), "clinic_id")
            .orderBy(F.col("total_collected").desc(), "clinic_id")
            .select("clinic_id", "clinic_name", "total_billed", "total_collected", "total_outstanding"))


# ── Q20 / Q31 diagnosis aggregates ──────────────────────────────────────────
def _grouped_text(df: DataFrame, columns: list[str], collation: str, *aggregates: Column) -> DataFrame:
    """A8 under a collation: values equal under it are one group, shown as the least spelling in it (by bytes).

    Each spelling is aggregated first, by bytes, where partial hash aggregation serves; the few
    spellings of a group meet afterwards.  ``aggregates`` are the sums of the spellings' columns.
    """
    keys = [X.collated(c, collation).alias(f"_key_{c}") for c in columns]
    shown = [F.min(c).alias(c) for c in columns]
    return df.groupBy(*keys).agg(*shown, *aggregates).drop(*[f"_key_{c}" for c in columns])


def _severity_counts(t: Tables, collation: str | None = None) -> DataFrame:
    same = lambda v: X.collated("severity", collation) == X.collated(F.lit(v), collation)
    counts = ["total_cases", "severe_cases", "moderate_cases", "mild_cases"]
    per = t.diagnosis.groupBy("diagnosis_code", "description").agg(
        F.count("diagnosis_id").alias("total_cases"),
        *[F.count_if(same(v)).alias(n) for v, n in zip(("Severe", "Moderate", "Mild"), counts[1:])])
    if collation is None:
        return per
    return _grouped_text(per, ["diagnosis_code", "description"], collation, *[F.sum(c).alias(c) for c in counts])


def _by_cases(counted: DataFrame, collation: str | None) -> DataFrame:
    texts = [X.collated(c, collation) for c in ("diagnosis_code", "description")]
    return counted.orderBy(F.col("total_cases").desc(), *texts)


def common_diagnoses(t: Tables, collation: str | None = None) -> DataFrame:
    """Q20: cases per code and description with the severity split, most cases first.

    With a ``collation`` codes, descriptions and severities that are equal under it count together.
    """
    return _by_cases(_severity_counts(t, collation), collation)


def diagnosis_counts(t: Tables, collation: str | None = None) -> DataFrame:
    """Q31: as Q20, ordered by case count only (ties then by code and description)."""
    return _by_cases(_severity_counts(t, collation), collation)


# ── Q21 / Q29 / Q30 patient money ───────────────────────────────────────────
def outstanding_by_patient(t: Tables, display: bool = False) -> DataFrame:
    """Q21: open balance per patient and the distinct statuses in ENUM order."""
    open_bills = t.bill.where(F.col("total_amount") > F.col("amount_paid"))
    st = F.col("payment_status")
    per = open_bills.groupBy("patient_id").agg(
        F.sum(F.col("total_amount") - F.col("amount_paid")).cast("decimal(20,2)").alias("outstanding_balance"),
        *[F.max(st == v).alias(f"has_{v}") for v in ("Unpaid", "Partial", "Paid")])
    statuses = X.ordered_distinct_text([(F.col(f"has_{v}"), v) for v in ("Unpaid", "Partial", "Paid")])
    p = t.patient.select("patient_id", X.full_name("first_name", "last_name").alias("patient_name"), "phone")
    return (per.join(p, "patient_id")
            .orderBy(F.col("outstanding_balance").desc(), "patient_id")
            .select("patient_id", "patient_name", "phone",
                    _money(F.col("outstanding_balance"), "outstanding_balance", display),
                    statuses.alias("payment_statuses")))


def billing_per_patient(t: Tables) -> DataFrame:
    """Q29: bills, total and average bill per patient, highest total first."""
    per = t.bill.groupBy("patient_id").agg(
        F.count("bill_id").alias("number_of_visits"),
        F.sum("total_amount").cast("decimal(20,2)").alias("total_billed"),
        F.avg("total_amount").alias("avg_bill_amount"))
    return (per.join(_patients(t), "patient_id")
            .orderBy(F.col("total_billed").desc(), "patient_id")
            .select("patient_id", "patient_name", "number_of_visits", "total_billed", "avg_bill_amount"))


def outstanding_by_patient_status(t: Tables, statuses: tuple[str, ...] = ("Unpaid", "Partial"),
                                  collation: str | None = None) -> DataFrame:
    """Q30: open balance per patient and status, for the given statuses (equal under the ``collation``)."""
    wanted = X.collated("payment_status", collation).isin(*[X.collated(F.lit(s), collation) for s in statuses])
    per = (t.bill.where(wanted)
           .groupBy("patient_id", "payment_status").agg(
               F.sum(F.col("total_amount") - F.col("amount_paid")).cast("decimal(20,2)")
               .alias("outstanding_balance")))
    if collation is not None:
        per = (per.groupBy("patient_id", X.collated("payment_status", collation).alias("_status"))
               .agg(F.min("payment_status").alias("payment_status"),
                    F.sum("outstanding_balance").cast("decimal(20,2)").alias("outstanding_balance")).drop("_status"))
    p = t.patient.select("patient_id", X.full_name("first_name", "last_name").alias("patient_name"), "phone")
    return (per.join(p, "patient_id")
            .orderBy(F.col("outstanding_balance").desc(), "patient_id", "payment_status")
            .select("patient_id", "patient_name", "phone", "outstanding_balance", "payment_status"))


# ── Q22 / Q32 medication aggregates ─────────────────────────────────────────
def _prescription_counts(t: Tables) -> DataFrame:
    return t.prescription.groupBy("medication_id").agg(F.count("prescription_id").alias("times_prescribed"))


def top_medications(t: Tables, k: int = 10, display: bool = True) -> DataFrame:
    """Q22: the ``k`` most prescribed medications, never-prescribed ones counted as 0."""
    m = t.medication.join(_prescription_counts(t), "medication_id", "left").withColumn(
        "times_prescribed", F.coalesce("times_prescribed", F.lit(0)))
    top = _topk(m, k, F.col("times_prescribed").desc(), F.col("medication_id").asc())
    stock = (F.concat(F.col("stock_quantity").cast("string"), F.lit(" "), F.col("unit")) if display
             else F.col("stock_quantity"))
    return top.select("medication_id", "medication_name", "times_prescribed", stock.alias("stock"))


def top_prescribed_medications(t: Tables, k: int = 5) -> DataFrame:
    """Q32: the ``k`` most prescribed medications among those prescribed at all."""
    counts = _topk(_prescription_counts(t), k, F.col("times_prescribed").desc(), F.col("medication_id").asc())
    return (counts.join(t.medication.select("medication_id", "medication_name", "unit"), "medication_id")
            .orderBy(F.col("times_prescribed").desc(), "medication_id")
            .select("medication_id", "medication_name", "unit", "times_prescribed"))


# ── R1-R4 README reports ────────────────────────────────────────────────────
def appointment_statistics(t: Tables) -> DataFrame:
    """Appointments per clinic split by status, clinics without visits kept."""
    st = F.col("status")
    per = t.appointment.groupBy("clinic_id").agg(
        F.count(F.lit(1)).alias("total_appointments"),
        *[F.count_if(st == v).alias(f"{v.lower()}_appointments") for v in ("Scheduled", "Completed", "Cancelled")])
    cols = ["total_appointments", "scheduled_appointments", "completed_appointments", "cancelled_appointments"]
    return (_clinic_names(t).join(per, "clinic_id", "left")
            .select("clinic_id", "clinic_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in cols])
            .orderBy(F.col("total_appointments").desc(), "clinic_id"))


def medication_inventory_report(t: Tables) -> DataFrame:
    """R2: every medication with stock and the number of prescriptions (no limit)."""
    return (t.medication.join(_prescription_counts(t), "medication_id", "left")
            .orderBy("medication_name", "medication_id")
            .select("medication_id", "medication_name", "unit", "stock_quantity", "description",
                    F.coalesce("times_prescribed", F.lit(0)).alias("times_prescribed")))


def patient_activity(t: Tables) -> DataFrame:
    """Visits, diagnoses, billed, paid and outstanding per patient.

    Each child is reduced per appointment, then per patient, before the joins.
    """
    diag_per_visit = t.diagnosis.groupBy("appointment_id").agg(F.count(F.lit(1)).alias("nd"))
    diag_per_patient = (diag_per_visit.join(t.appointment.select("appointment_id", "patient_id"), "appointment_id")
                        .groupBy("patient_id").agg(F.sum("nd").alias("diagnoses")))
    visits = t.appointment.groupBy("patient_id").agg(F.count(F.lit(1)).alias("visits"))
    money = t.bill.groupBy("patient_id").agg(
        F.sum("total_amount").alias("billed"), F.sum("amount_paid").alias("paid"))
    out = (t.patient.select("patient_id", X.full_name("first_name", "last_name").alias("patient_name"))
           .join(visits, "patient_id", "left").join(diag_per_patient, "patient_id", "left")
           .join(money, "patient_id", "left"))
    billed = F.coalesce("billed", _zero()).cast("decimal(20,2)")
    paid = F.coalesce("paid", _zero()).cast("decimal(20,2)")
    return out.orderBy("patient_id").select(
        "patient_id", "patient_name",
        F.coalesce("visits", F.lit(0)).alias("visits"),
        F.coalesce("diagnoses", F.lit(0)).cast("long").alias("diagnoses"),
        billed.alias("total_billed"), paid.alias("total_paid"),
        (billed - paid).cast("decimal(20,2)").alias("total_outstanding"))


def monthly_revenue(t: Tables) -> DataFrame:
    """Bills, billed, collected and outstanding per calendar month of the bill date."""
    month = F.trunc("bill_date", "month").alias("month")
    return (t.bill.groupBy(month).agg(
        F.count(F.lit(1)).alias("bills"),
        F.sum("total_amount").cast("decimal(20,2)").alias("total_billed"),
        F.sum("amount_paid").cast("decimal(20,2)").alias("total_collected"),
        F.sum(F.col("total_amount") - F.col("amount_paid")).cast("decimal(20,2)").alias("total_outstanding"))
        .orderBy("month"))


REPORTS = {
    "dashboard_metrics": dashboard_metrics,
    "recent_appointments": recent_appointments,
    "patient_list": patient_list,
    "staff_list": staff_list,
    "clinic_activity": clinic_activity,
    "appointment_list": appointment_list,
    "diagnosis_list": diagnosis_list,
    "prescription_list": prescription_list,
    "medication_inventory": medication_inventory,
    "bill_list": bill_list,
    "patient_visit_history": patient_visit_history,
    "patient_header": patient_header,
    "unbilled_appointments": unbilled_appointments,
    "outstanding_bills": outstanding_bills,
    "appointment_options": appointment_options,
    "diagnosis_options": diagnosis_options,
    "staff_directory": staff_directory,
    "patient_options": patient_options,
    "medication_stock_options": medication_stock_options,
    "revenue_by_clinic": revenue_by_clinic,
    "common_diagnoses": common_diagnoses,
    "outstanding_by_patient": outstanding_by_patient,
    "top_medications": top_medications,
    "patients_basic": patients_basic,
    "patients_registered_since": patients_registered_since,
    "clinic_visits_by_status": clinic_visits_by_status,
    "bills_by_amount": bills_by_amount,
    "appointments_per_clinic": appointments_per_clinic,
    "revenue_by_billed_clinic": revenue_by_billed_clinic,
    "billing_per_patient": billing_per_patient,
    "outstanding_by_patient_status": outstanding_by_patient_status,
    "diagnosis_counts": diagnosis_counts,
    "top_prescribed_medications": top_prescribed_medications,
    "latest_patients": latest_patients,
    "full_visit_history": full_visit_history,
    "clinic_directory": clinic_directory,
    "appointment_statistics": appointment_statistics,
    "medication_inventory_report": medication_inventory_report,
    "patient_activity": patient_activity,
    "monthly_revenue": monthly_revenue,
}

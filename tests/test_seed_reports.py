"""Seed goldens (FIXTURES §2): reports on the sample rows, before and after the four DML steps."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from carelake.operators import changes as C
from carelake.plans import reports as R


def rows(df):
    return [tuple(r) for r in df.collect()]


def col(df, c):
    return [r[c] for r in df.collect()]


@pytest.fixture(scope="module")
def after(spark, seed):
    """Apply the four DML steps of the schema script with the batch jobs."""
    st = spark.createDataFrame([(1, "12", "Cancelled", "Scheduled")],
                               "seq long, appointment_id string, status string, expected_status string")
    t = seed.replace(appointment=C.change_status(seed.appointment, st).table)
    pay = spark.createDataFrame([(1, "3", "30000.00")], "seq long, bill_id string, amount string")
    t = t.replace(bill=C.apply_payments(t.bill, pay).table)
    rs = spark.createDataFrame([(1, "Artemether-Lumefantrine", "200")],
                               "seq long, medication_name string, quantity string")
    t = t.replace(medication=C.restock(t.medication, rs).table)
    dl = spark.createDataFrame([(1, "12")], "seq long, id string")
    t = t.replace(appointment=C.delete_restrict(t, "appointment", dl, guard=("status", "Cancelled")).table)
    return t


def test_dashboard_before(seed):
    r = R.dashboard_metrics(seed).first()
    assert (r.patients, r.staff, r.clinics, r.appointments) == (10, 8, 5, 13)
    assert (r.collected, r.outstanding) == (Decimal("530000.00"), Decimal("205000.00"))
    d = R.dashboard_metrics(seed, display=True).first()
    assert d.collected == "Le 530,000" and d.patients == "10"


def test_dashboard_after(after):
    r = R.dashboard_metrics(after).first()
    assert r.appointments == 12
    assert (r.collected, r.outstanding) == (Decimal("560000.00"), Decimal("175000.00"))


def test_recent_appointments(seed, after):
    assert col(R.recent_appointments(seed), "appointment_id") == [13, 12, 11, 10, 9, 8, 7, 6, 5, 4]
    assert col(R.recent_appointments(after), "appointment_id") == [13, 11, 10, 9, 8, 7, 6, 5, 4, 3]
    first = R.recent_appointments(seed).first()
    assert first.appointment_date == "10 Jun 2024" and first.appointment_time == "10:00"
    assert first.patient_name == "Isata Turay" and first.staff_name == "Mariama Turay"


def test_clinic_activity(seed, after):
    by_id = {r.clinic_id: (r.staff_count, r.appointment_count) for r in R.clinic_activity(seed).collect()}
    assert by_id == {1: (3, 5), 2: (2, 3), 3: (1, 3), 4: (1, 0), 5: (1, 2)}
    by_id = {r.clinic_id: (r.staff_count, r.appointment_count) for r in R.clinic_activity(after).collect()}
    assert by_id[1] == (3, 4)


def test_unbilled(seed, after):
    assert sorted(col(R.unbilled_appointments(seed), "appointment_id")) == [12, 13]
    assert col(R.unbilled_appointments(after), "appointment_id") == [13]


def test_revenue_by_clinic(seed, after):
    got = {r.clinic_id: (r.visits, r.total_billed, r.total_collected, r.total_outstanding)
           for r in R.revenue_by_clinic(seed).collect()}
    D = Decimal
    assert got[1] == (5, D("335000.00"), D("230000.00"), D("105000.00"))
    assert got[2] == (3, D("170000.00"), D("70000.00"), D("100000.00"))
    assert got[3] == (3, D("110000.00"), D("110000.00"), D("0.00"))
    assert got[4] == (0, D("0.00"), D("0.00"), D("0.00"))
    assert got[5] == (2, D("120000.00"), D("120000.00"), D("0.00"))
    got = {r.clinic_id: (r.visits, r.total_collected, r.total_outstanding)
           for r in R.revenue_by_clinic(after).collect()}
    assert got[1] == (4, D("230000.00"), D("105000.00"))
    assert got[2] == (3, D("100000.00"), D("70000.00"))
    disp = R.revenue_by_clinic(seed, display=True).first()
    assert disp.total_collected == "Le 230,000"


def test_revenue_by_billed_clinic_drops_empty(seed):
    assert sorted(col(R.revenue_by_billed_clinic(seed), "clinic_id")) == [1, 2, 3, 5]


def test_outstanding_by_patient(seed, after):
    got = [(r.patient_name, r.outstanding_balance, r.payment_statuses) for r in R.outstanding_by_patient(seed).collect()]
    assert got == [("Alimamy Sesay", Decimal("70000.00"), "Unpaid"),
                   ("David Fullah", Decimal("60000.00"), "Partial"),
                   ("Isata Turay", Decimal("45000.00"), "Partial"),
                   ("Hawa Bangura", Decimal("30000.00"), "Partial")]
    assert len(R.outstanding_by_patient(after).collect()) == 3


def test_common_diagnoses(seed):
    out = R.common_diagnoses(seed).collect()
    assert len(out) == 10
    assert tuple(out[0]) == ("B54", "Unspecified malaria", 2, 1, 1, 0)


def test_top_medications(seed):
    got = {r.medication_id: r.times_prescribed for r in R.top_medications(seed).collect()}
    assert got == {5: 4, 1: 2, 7: 2, 2: 1, 3: 1, 4: 1, 6: 1, 8: 1, 10: 1, 9: 0}
    assert col(R.top_medications(seed), "medication_id")[:3] == [5, 1, 7]
    assert R.top_medications(seed).first().stock == "1000 tablet"
    assert col(R.top_prescribed_medications(seed), "medication_id") == [5, 1, 7, 2, 3]


def test_patient_filters(seed):
    assert col(R.patients_registered_since(seed), "patient_id") == [7, 8, 9, 10]
    assert col(R.clinic_visits_by_status(seed, 1, "Completed"), "appointment_id") == [1, 2, 5, 10]
    assert col(R.latest_patients(seed), "patient_id") == [10, 9, 8, 7, 6]


def test_billing_per_patient(seed):
    r = R.billing_per_patient(seed).where(F.col("patient_id") == 1).first()
    assert (r.number_of_visits, r.total_billed, r.avg_bill_amount) == (2, Decimal("115000.00"), Decimal("57500.000000"))


def test_full_visit_history(seed):
    assert R.full_visit_history(seed).count() == 11


def test_appointment_statistics(seed, after):
    def totals(t):
        r = R.appointment_statistics(t).agg(F.sum("scheduled_appointments"), F.sum("completed_appointments")).first()
        return tuple(r)
    assert totals(seed) == (2, 11)
    assert totals(after) == (1, 11)


def test_restock_by_name(after):
    r = after.medication.where("medication_id = 1").first()
    assert r.stock_quantity == 700


def test_display_listing(seed):
    b = R.bill_list(seed).where("bill_id = 10").first()
    assert (b.total_amount, b.amount_paid, b.balance, b.bill_date) == ("Le 120,000", "Le 60,000", "Le 60,000", "10 May 2024")
    p = R.prescription_list(seed).where("prescription_id = 5").first()
    assert p.duration == "30 days" and p.patient_name == "Thomas Koroma"


def test_visit_history_and_header(seed):
    h = R.patient_visit_history(seed, patient_id=1).collect()
    assert len(h) == 2 and h[0].appointment_date == "01 Jun 2024" and h[0].bill_total == "Le 40,000"
    hdr = R.patient_header(seed, patient_id=1).first()
    assert hdr.visit_rows == 2 and hdr.blood_type == "O+"
    # patient 3 has an unbilled, undiagnosed visit: shown with '-' cells
    h3 = R.patient_visit_history(seed, patient_id=3).collect()
    assert [r.diagnosis for r in h3] == ["-", "Acute upper respiratory infection"]


def test_visit_pairs_several_bills(spark, seed):
    """Two diagnoses and two bills on one visit: every diagnosis and every bill appears,
    linearly (d + b - 1 rows), and the header count agrees with the history."""
    from seed import seed_rows, seed_tables
    rows = seed_rows()
    rows["diagnosis"].append((12, 1, "R50", "Fever", "Mild", rows["diagnosis"][0][5]))
    b = rows["bill"][0]
    rows["bill"].append((12, b[1], 1, Decimal("5000.00"), Decimal("0.00"), b[5], "Unpaid"))
    t = seed_tables(spark, rows)
    h = R.patient_visit_history(t, patient_id=1).where("appointment_id = 1").collect()
    assert len(h) == 3
    assert {r.diagnosis for r in h} == {"Unspecified malaria", "Fever"}
    assert {r.bill_total for r in h} == {"Le 75,000", "Le 5,000"}
    assert R.patient_header(t, patient_id=1).first().visit_rows == 4
    assert R.full_visit_history(t).where("patient_id = 1").count() == 4
    # revenue counts the visit once and sums both bills
    r = R.revenue_by_clinic(t).where("clinic_id = 1").first()
    assert r.visits == 5 and r.total_billed == Decimal("340000.00")

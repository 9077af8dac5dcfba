"""S4 seed-row source: the sample rows of the clinic schema as typed DataFrames (tests only)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import SparkSession

from carelake.sources.schema import SCHEMAS
from carelake.sources.tables import Tables


def _d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


# The sample rows of the original schema script (ids in insertion order).
CLINICS = [
    ("Connaught Community Clinic", "Siaka Stevens Street, Freetown", "Western Area Urban", "+232-76-100001", "connaught@health.gov.sl", "2005-03-15"),
    ("Kissy Public Health Clinic", "Kissy Road, Freetown", "Western Area Urban", "+232-76-100002", "kissy@health.gov.sl", "2008-07-20"),
    ("Bo District Health Clinic", "Dambara Road, Bo", "Bo District", "+232-76-100003", "bo.clinic@health.gov.sl", "2010-01-10"),
    ("Makeni General Clinic", "Rogbonko Road, Makeni", "Bombali District", "+232-76-100004", "makeni@health.gov.sl", "2012-05-05"),
    ("Kenema Health Post", "Hangha Road, Kenema", "Kenema District", "+232-76-100005", "kenema@health.gov.sl", "2015-09-01"),
]
STAFF = [
    (1, "Mohamed", "Kamara", "Doctor", "Male", "+232-77-200001", "mkamara@health.sl", "2010-06-01"),
    (1, "Aminata", "Conteh", "Nurse", "Female", "+232-77-200002", "aconteh@health.sl", "2012-03-15"),
    (1, "Ibrahim", "Sesay", "Receptionist", "Male", "+232-77-200003", "isesay@health.sl", "2015-01-10"),
    (2, "Fatmata", "Koroma", "Doctor", "Female", "+232-77-200004", "fkoroma@health.sl", "2009-08-20"),
    (2, "Samuel", "Bangura", "Nurse", "Male", "+232-77-200005", "sbangura@health.sl", "2013-11-01"),
    (3, "Mariama", "Turay", "Doctor", "Female", "+232-77-200006", "mturay@health.sl", "2011-04-15"),
    (4, "Abdul", "Jalloh", "Nurse", "Male", "+232-77-200007", "ajalloh@health.sl", "2016-02-28"),
    (5, "Patricia", "Mansaray", "Doctor", "Female", "+232-77-200008", "pmansaray@health.sl", "2018-07-01"),
]
PATIENTS = [
    ("Adama", "Fofanah", "1990-04-12", "Female", "14 Wellington Street, Freetown", "+232-78-300001", "O+", "2023-01-10"),
    ("Sorie", "Kamara", "1985-09-25", "Male", "7 Circular Road, Freetown", "+232-78-300002", "A+", "2023-02-14"),
    ("Hawa", "Bangura", "2000-06-30", "Female", "22 Sanders Street, Freetown", "+232-78-300003", "B+", "2023-03-05"),
    ("Thomas", "Koroma", "1978-11-03", "Male", "5 Liverpool Street, Freetown", "+232-78-300004", "AB+", "2023-04-20"),
    ("Isata", "Turay", "1995-07-17", "Female", "9 Kroo Bay, Freetown", "+232-78-300005", "O-", "2023-05-11"),
    ("Alimamy", "Sesay", "1970-02-28", "Male", "30 Lumley Beach Road, Freetown", "+232-78-300006", "A-", "2023-06-01"),
    ("Kadiatu", "Conteh", "2005-12-15", "Female", "18 Bo Highway, Bo", "+232-78-300007", "B-", "2024-01-08"),
    ("Emmanuel", "Jalloh", "1988-08-09", "Male", "4 Makeni Central, Makeni", "+232-78-300008", "O+", "2024-02-22"),
    ("Memunatu", "Mansaray", "1993-03-21", "Female", "12 Kenema Town, Kenema", "+232-78-300009", "A+", "2024-03-15"),
    ("David", "Fullah", "1965-10-10", "Male", "3 Hill Station, Freetown", "+232-78-300010", "AB-", "2024-04-05"),
]
APPOINTMENTS = [
    (1, 1, 1, "2024-05-01", "08:30:00", "Fever and headache", "Completed"),
    (2, 1, 1, "2024-05-02", "09:00:00", "Routine check-up", "Completed"),
    (3, 4, 2, "2024-05-03", "10:00:00", "Persistent cough", "Completed"),
    (4, 6, 3, "2024-05-04", "11:00:00", "Diabetes management", "Completed"),
    (5, 1, 1, "2024-05-05", "08:00:00", "Malaria symptoms", "Completed"),
    (6, 4, 2, "2024-05-06", "09:30:00", "Hypertension follow-up", "Completed"),
    (7, 6, 3, "2024-05-07", "10:30:00", "Vaccination", "Completed"),
    (8, 8, 5, "2024-05-08", "14:00:00", "Abdominal pain", "Completed"),
    (9, 8, 5, "2024-05-09", "11:00:00", "Prenatal visit", "Completed"),
    (10, 1, 1, "2024-05-10", "15:00:00", "Joint pain and swelling", "Completed"),
    (1, 4, 2, "2024-06-01", "08:30:00", "Malaria follow-up", "Completed"),
    (3, 1, 1, "2024-06-05", "09:00:00", "Respiratory check", "Scheduled"),
    (5, 6, 3, "2024-06-10", "10:00:00", "Malaria re-test", "Scheduled"),
]
DIAGNOSES = [
    (1, "B54", "Unspecified malaria", "Moderate", "2024-05-01"),
    (2, "Z00.0", "General adult medical examination", "Mild", "2024-05-02"),
    (3, "J06.9", "Acute upper respiratory infection", "Mild", "2024-05-03"),
    (4, "E11.9", "Type 2 diabetes without complications", "Moderate", "2024-05-04"),
    (5, "B54", "Unspecified malaria", "Severe", "2024-05-05"),
    (6, "I10", "Essential (primary) hypertension", "Moderate", "2024-05-06"),
    (7, "Z23", "Encounter for immunisation", "Mild", "2024-05-07"),
    (8, "R10.4", "Other and unspecified abdominal pain", "Moderate", "2024-05-08"),
    (9, "Z34.1", "Supervision of normal second pregnancy", "Mild", "2024-05-09"),
    (10, "M05.9", "Seropositive rheumatoid arthritis, unspecified", "Severe", "2024-05-10"),
    (11, "B54", "Unspecified malaria – follow-up resolved", "Mild", "2024-06-01"),
]
MEDICATIONS = [
    ("Artemether-Lumefantrine", "First-line antimalarial (ACT)", "tablet", 500),
    ("Amoxicillin", "Broad-spectrum antibiotic", "capsule", 300),
    ("Metformin", "Oral antidiabetic – biguanide class", "tablet", 400),
    ("Amlodipine", "Calcium channel blocker for BP", "tablet", 250),
    ("Paracetamol", "Analgesic and antipyretic", "tablet", 1000),
    ("ORS Sachets", "Oral Rehydration Salts", "sachet", 800),
    ("Ibuprofen", "NSAID – anti-inflammatory", "tablet", 600),
    ("Folic Acid", "Prenatal supplement", "tablet", 350),
    ("Vitamin C", "Immune support supplement", "tablet", 700),
    ("Hydroxychloroquine", "DMARD for rheumatoid arthritis", "tablet", 150),
]
PRESCRIPTIONS = [
    (1, 1, "20mg/120mg", "Twice daily", 3, "2024-05-01"),
    (1, 5, "500mg", "Three times daily", 5, "2024-05-01"),
    (3, 2, "500mg", "Three times daily", 7, "2024-05-03"),
    (3, 5, "500mg", "As needed", 5, "2024-05-03"),
    (4, 3, "500mg", "Twice daily", 30, "2024-05-04"),
    (5, 1, "20mg/120mg", "Twice daily", 3, "2024-05-05"),
    (5, 6, "1 sachet", "After each loose stool", 3, "2024-05-05"),
    (6, 4, "5mg", "Once daily", 30, "2024-05-06"),
    (8, 5, "500mg", "Three times daily", 5, "2024-05-08"),
    (8, 7, "400mg", "Twice daily", 5, "2024-05-08"),
    (9, 8, "5mg", "Once daily", 90, "2024-05-09"),
    (10, 10, "200mg", "Twice daily", 60, "2024-05-10"),
    (10, 7, "400mg", "Twice daily", 14, "2024-05-10"),
    (11, 5, "500mg", "As needed", 3, "2024-06-01"),
]
BILLS = [
    (1, 1, "75000.00", "75000.00", "2024-05-01", "Paid"),
    (2, 2, "50000.00", "50000.00", "2024-05-02", "Paid"),
    (3, 3, "60000.00", "30000.00", "2024-05-03", "Partial"),
    (4, 4, "80000.00", "80000.00", "2024-05-04", "Paid"),
    (5, 5, "90000.00", "45000.00", "2024-05-05", "Partial"),
    (6, 6, "70000.00", "0.00", "2024-05-06", "Unpaid"),
    (7, 7, "30000.00", "30000.00", "2024-05-07", "Paid"),
    (8, 8, "65000.00", "65000.00", "2024-05-08", "Paid"),
    (9, 9, "55000.00", "55000.00", "2024-05-09", "Paid"),
    (10, 10, "120000.00", "60000.00", "2024-05-10", "Partial"),
    (1, 11, "40000.00", "40000.00", "2024-06-01", "Paid"),
]


def seed_rows() -> dict[str, list[tuple]]:
    """Typed rows with AUTO_INCREMENT ids 1..n."""
    def ids(rows):
        return [(i, *r) for i, r in enumerate(rows, start=1)]

    return {
        "clinic": [(i, n, l, d, p, e, _d(est)) for i, n, l, d, p, e, est in ids(CLINICS)],
        "staff": [(i, c, f, la, r, g, p, e, _d(h)) for i, c, f, la, r, g, p, e, h in ids(STAFF)],
        "patient": [(i, f, la, _d(b), g, a, p, bt, _d(r)) for i, f, la, b, g, a, p, bt, r in ids(PATIENTS)],
        "appointment": [(i, p, s, c, _d(d), t, r, st) for i, p, s, c, d, t, r, st in ids(APPOINTMENTS)],
        "diagnosis": [(i, a, c, de, s, _d(d)) for i, a, c, de, s, d in ids(DIAGNOSES)],
        "medication": [(i, n, de, u, s) for i, n, de, u, s in ids(MEDICATIONS)],
        "prescription": [(i, d, m, do, f, n, _d(p)) for i, d, m, do, f, n, p in ids(PRESCRIPTIONS)],
        "bill": [(i, p, a, Decimal(t), Decimal(pd), _d(d), s) for i, p, a, t, pd, d, s in ids(BILLS)],
    }


def seed_tables(spark: SparkSession, rows: dict[str, list[tuple]] | None = None) -> Tables:
    rows = rows or seed_rows()
    return Tables({name: spark.createDataFrame(rows[name], SCHEMAS[name]) for name in SCHEMAS})

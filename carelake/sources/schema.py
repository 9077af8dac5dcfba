"""Fixed schemas of the eight clinic tables, their domains, defaults and keys.

The schema is declared DDL, never inferred: every reader applies these
StructTypes, and the validation / integrity jobs read their rules from here.
"""

from __future__ import annotations

from pyspark.sql import types as T

L = T.LongType()
I = T.IntegerType()
S = T.StringType()
D = T.DateType()
MONEY = T.DecimalType(10, 2)


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


CLINIC = _struct(
    ("clinic_id", L, False), ("clinic_name", S, False), ("location", S, False),
    ("district", S, False), ("phone", S, False), ("email", S, True),
    ("established_date", D, True),
)
STAFF = _struct(
    ("staff_id", L, False), ("clinic_id", L, False), ("first_name", S, False),
    ("last_name", S, False), ("role", S, False), ("gender", S, False),
    ("phone", S, False), ("email", S, True), ("hire_date", D, False),
)
PATIENT = _struct(
    ("patient_id", L, False), ("first_name", S, False), ("last_name", S, False),
    ("date_of_birth", D, False), ("gender", S, False), ("address", S, False),
    ("phone", S, False), ("blood_type", S, True), ("registration_date", D, False),
)
# appointment_time is TIME in the DDL; kept as zero-padded 'HH:mm:ss' text, which sorts correctly.
APPOINTMENT = _struct(
    ("appointment_id", L, False), ("patient_id", L, False), ("staff_id", L, False),
    ("clinic_id", L, False), ("appointment_date", D, False), ("appointment_time", S, False),
    ("reason", S, False), ("status", S, False),
)
DIAGNOSIS = _struct(
    ("diagnosis_id", L, False), ("appointment_id", L, False), ("diagnosis_code", S, False),
    ("description", S, False), ("severity", S, False), ("diagnosed_date", D, False),
)
MEDICATION = _struct(
    ("medication_id", L, False), ("medication_name", S, False), ("description", S, True),
    ("unit", S, False), ("stock_quantity", I, False),
)
PRESCRIPTION = _struct(
    ("prescription_id", L, False), ("diagnosis_id", L, False), ("medication_id", L, False),
    ("dosage", S, False), ("frequency", S, False), ("duration_days", I, False),
    ("prescribed_date", D, False),
)
BILL = _struct(
    ("bill_id", L, False), ("patient_id", L, False), ("appointment_id", L, False),
    ("total_amount", MONEY, False), ("amount_paid", MONEY, False), ("bill_date", D, False),
    ("payment_status", S, False),
)

SCHEMAS: dict[str, T.StructType] = {
    "clinic": CLINIC, "staff": STAFF, "patient": PATIENT, "appointment": APPOINTMENT,
    "diagnosis": DIAGNOSIS, "medication": MEDICATION, "prescription": PRESCRIPTION, "bill": BILL,
}
TABLES = tuple(SCHEMAS)

PRIMARY_KEYS: dict[str, str] = {
    "clinic": "clinic_id", "staff": "staff_id", "patient": "patient_id",
    "appointment": "appointment_id", "diagnosis": "diagnosis_id",
    "medication": "medication_id", "prescription": "prescription_id", "bill": "bill_id",
}

# (child table, child column, parent table). All edges are ON DELETE RESTRICT, ON UPDATE CASCADE.
FOREIGN_KEYS: tuple[tuple[str, str, str], ...] = (
    ("staff", "clinic_id", "clinic"),
    ("appointment", "patient_id", "patient"),
    ("appointment", "staff_id", "staff"),
    ("appointment", "clinic_id", "clinic"),
    ("diagnosis", "appointment_id", "appointment"),
    ("prescription", "diagnosis_id", "diagnosis"),
    ("prescription", "medication_id", "medication"),
    ("bill", "patient_id", "patient"),
    ("bill", "appointment_id", "appointment"),
)

# The ENUM domains of the DDL, in declaration (= sort ordinal) order.
GENDERS = ("Male", "Female", "Other")
APPOINTMENT_STATUSES = ("Scheduled", "Completed", "Cancelled")
SEVERITIES = ("Mild", "Moderate", "Severe")
PAYMENT_STATUSES = ("Unpaid", "Partial", "Paid")
# Blood types offered by the patient form.
BLOOD_TYPES = ("A+", "A-", "B+", "B-", "AB+", "AB-", "O+", "O-")

# (table, column) -> allowed values
DOMAINS: dict[tuple[str, str], tuple[str, ...]] = {
    ("staff", "gender"): GENDERS,
    ("patient", "gender"): GENDERS,
    ("appointment", "status"): APPOINTMENT_STATUSES,
    ("diagnosis", "severity"): SEVERITIES,
    ("bill", "payment_status"): PAYMENT_STATUSES,
}

# VARCHAR(n) lengths of the DDL.
VARCHAR_LENGTHS: dict[tuple[str, str], int] = {
    ("clinic", "clinic_name"): 100, ("clinic", "location"): 150, ("clinic", "district"): 50,
    ("clinic", "phone"): 20, ("clinic", "email"): 100,
    ("staff", "first_name"): 50, ("staff", "last_name"): 50, ("staff", "role"): 50,
    ("staff", "phone"): 20, ("staff", "email"): 100,
    ("patient", "first_name"): 50, ("patient", "last_name"): 50, ("patient", "address"): 200,
    ("patient", "phone"): 20, ("patient", "blood_type"): 5,
    ("appointment", "reason"): 200,
    ("diagnosis", "diagnosis_code"): 20, ("diagnosis", "description"): 300,
    ("medication", "medication_name"): 100, ("medication", "description"): 200,
    ("medication", "unit"): 30,
    ("prescription", "dosage"): 100, ("prescription", "frequency"): 100,
}

# Declared column defaults (registration_date defaults to the current date).
DEFAULTS: dict[tuple[str, str], object] = {
    ("appointment", "status"): "Scheduled",
    ("diagnosis", "severity"): "Mild",
    ("medication", "stock_quantity"): 0,
    ("bill", "total_amount"): "0.00",
    ("bill", "amount_paid"): "0.00",
    ("bill", "payment_status"): "Unpaid",
    ("patient", "registration_date"): "CURRENT_DATE",
}


def not_null_columns(table: str) -> list[str]:
    return [f.name for f in SCHEMAS[table].fields if not f.nullable]

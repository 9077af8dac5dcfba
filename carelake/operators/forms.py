"""Entry forms of every table as declarative field specs, and the generic batch jobs
built from them: C1 (append validated rows with new ids) and C2 (full-row update by key).

A spec lists the fields a clerk types, in form order, each with its kind; the
validation rules (V1-V10) and the typed columns follow from the kind, and the
rules are evaluated in field order.

Kinds:
  text      required text (trimmed), VARCHAR length checked
  opt_text  optional text, blank -> NULL
  date      required ``yyyy-M-d`` date;  opt_date: blank -> NULL
  time      required ``H:m`` time, stored ``HH:mm:ss``
  pos_int   whole number > 0;  nonneg_int: whole number >= 0
  enum      one of the domain values (blank -> declared default when there is one)
  opt_enum  one of the domain values, or blank / ``None`` -> NULL
  ref       id of an existing row of the parent table
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schema import (APPOINTMENT_STATUSES, BLOOD_TYPES, DEFAULTS, GENDERS, PRIMARY_KEYS,
                              SEVERITIES, VARCHAR_LENGTHS)
from ..sources.tables import Tables, conform
from . import validate as V
from .changes import Changed, assign_ids, update_by_key


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    label: str
    domain: tuple[str, ...] = ()
    parent: str | None = None


def _f(name, kind, label, domain=(), parent=None) -> Field:
    return Field(name, kind, label, tuple(domain), parent)


# Field order and labels of the entry forms.
FORMS: dict[str, list[Field]] = {
    "patient": [
        _f("first_name", "text", "First Name"), _f("last_name", "text", "Last Name"),
        _f("date_of_birth", "date", "Date of Birth"), _f("gender", "enum", "Gender", GENDERS),
        _f("address", "text", "Address"), _f("phone", "text", "Phone"),
        _f("blood_type", "opt_enum", "Blood Type", BLOOD_TYPES),
        _f("registration_date", "date", "Registration Date"),
    ],
    "clinic": [
        _f("clinic_name", "text", "Clinic Name"), _f("location", "text", "Location"),
        _f("district", "text", "District"), _f("phone", "text", "Phone"),
        _f("email", "opt_text", "Email"), _f("established_date", "opt_date", "Established Date"),
    ],
    "staff": [
        _f("clinic_id", "ref", "Clinic", parent="clinic"), _f("first_name", "text", "First Name"),
        _f("last_name", "text", "Last Name"), _f("role", "text", "Role"),
        _f("gender", "enum", "Gender", GENDERS), _f("phone", "text", "Phone"),
        _f("email", "opt_text", "Email"), _f("hire_date", "date", "Hire Date"),
    ],
    "appointment": [
        _f("patient_id", "ref", "Patient", parent="patient"), _f("staff_id", "ref", "Staff", parent="staff"),
        _f("clinic_id", "ref", "Clinic", parent="clinic"), _f("appointment_date", "date", "Date"),
        _f("appointment_time", "time", "Time"), _f("reason", "text", "Reason"),
        _f("status", "enum", "Status", APPOINTMENT_STATUSES),
    ],
    "diagnosis": [
        _f("appointment_id", "ref", "Appointment", parent="appointment"),
        _f("diagnosis_code", "text", "Code"), _f("description", "text", "Description"),
        _f("severity", "enum", "Severity", SEVERITIES), _f("diagnosed_date", "date", "Diagnosed Date"),
    ],
    "prescription": [
        _f("diagnosis_id", "ref", "Diagnosis", parent="diagnosis"),
        _f("medication_id", "ref", "Medication", parent="medication"),
        _f("dosage", "text", "Dosage"), _f("frequency", "text", "Frequency"),
        _f("duration_days", "pos_int", "Duration Days"), _f("prescribed_date", "date", "Prescribed Date"),
    ],
    "medication": [
        _f("medication_name", "text", "Name"), _f("description", "opt_text", "Description"),
        _f("unit", "text", "Unit"), _f("stock_quantity", "nonneg_int", "Stock Quantity"),
    ],
}


def _flag(field: Field) -> str:
    return f"_has_{field.name}"


def _enum_value(table: str, field: Field, editing: bool = False) -> Column:
    """The chosen value; a blank takes the declared default in a new row, never in an edit."""
    v = V.blank_to_null(field.name)
    if field.kind == "opt_enum":
        return F.when(v == "None", F.lit(None).cast("string")).otherwise(v)
    default = None if editing else DEFAULTS.get((table, field.name))
    return F.coalesce(v, F.lit(default)) if default is not None else v


def field_rules(table: str, field: Field, editing: bool = False) -> list[V.Rule]:
    c, label, k = field.name, field.label, field.kind
    if k == "text":
        rules = [V.required_text(c, label)]
    elif k == "opt_text":
        rules = []
    elif k == "date":
        return [V.required_date(c, label)]
    elif k == "opt_date":
        return [V.optional_date(c, label)]
    elif k == "time":
        return [V.required_time(c, label)]
    elif k == "pos_int":
        return [V.positive_int(c, label)]
    elif k == "nonneg_int":
        return [V.nonnegative_int(c, label)]
    elif k in ("enum", "opt_enum"):
        v = _enum_value(table, field, editing)
        ok = v.isin(*field.domain) | (v.isNull() if k == "opt_enum" else F.lit(False))
        return [(f"{label} must be one of {', '.join(field.domain)}", ~F.coalesce(ok, F.lit(False)))]
    elif k == "ref":
        return [V.reference_exists(_flag(field), label)]
    else:  # pragma: no cover - spec error
        raise ValueError(k)
    n = VARCHAR_LENGTHS.get((table, c))
    if n:
        rules.append(V.max_length(c, n, label))
    return rules


def field_value(table: str, field: Field, editing: bool = False) -> Column:
    c, k = field.name, field.kind
    if k == "text":
        return V.stripped(c)
    if k == "opt_text":
        return V.blank_to_null(c)
    if k in ("date", "opt_date"):
        return V.parse_date(c)
    if k == "time":
        return V.parse_time(c)
    if k in ("pos_int", "nonneg_int"):
        return V.parse_int(c)
    if k in ("enum", "opt_enum"):
        return _enum_value(table, field, editing)
    if k == "ref":
        return V.parse_id(c)
    raise ValueError(k)  # pragma: no cover


def check_form(t: Tables, table: str, batch: DataFrame, with_key: bool = False) -> V.Checked:
    """Validate a batch of typed-in rows of ``table`` (plus its id when ``with_key``)."""
    fields = FORMS[table]
    text_cols = batch.columns
    b, small = batch, any(f.kind == "ref" for f in fields) and V.is_few(batch)
    for f in fields:
        if f.kind == "ref":
            b = V.mark_existing(b, field_value(table, f), t[f.parent], PRIMARY_KEYS[f.parent], _flag(f), small)
    rules: list[V.Rule] = []
    typed: dict[str, Column] = {}
    key = PRIMARY_KEYS[table]
    if with_key:
        rules.append(V.positive_id(key, "Id"))
        typed[key] = V.parse_id(key)
    for f in fields:
        rules.extend(field_rules(table, f, with_key))
        typed[f.name] = field_value(table, f, with_key)
    checked = V.validate(b.withColumn("_row", F.struct(*text_cols)), rules, typed, keep=("seq", "_row"))
    return V.Checked(checked.valid, checked.rejected.select(*text_cols, "errors"))


def insert_rows(t: Tables, table: str, batch: DataFrame, high_water: int) -> Changed:
    """C1 for any table: validate the form batch, give the valid rows new ids, append."""
    checked = check_form(t, table, batch)
    key = PRIMARY_KEYS[table]
    ch = Changed(None, lambda: conform(assign_ids(checked.valid.drop("_row"), key, high_water), table), checked.rejected)
    ch._parts["table"] = lambda: t[table].unionByName(ch.accepted)
    return ch


def update_rows(t: Tables, table: str, batch: DataFrame) -> Changed:
    """C2 for any table: full-row update by id from an edit-form batch.

    Unknown ids and invalid rows are rejected; one update per id (lowest ``seq``).
    """
    checked = check_form(t, table, batch, with_key=True)
    key = PRIMARY_KEYS[table]
    cols = [f.name for f in FORMS[table]]
    ch = update_by_key(t[table], checked.valid, key, cols)

    def views(judged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        new, accepted, refused = ch._drawn_from(judged)
        refused = refused.select("_row.*", "errors").select(*batch.columns, "errors")
        accepted = accepted.select("seq", *[F.col(c).cast(t[table].schema[c].dataType).alias(c) for c in [key, *cols]])
        return conform(new, table), accepted, checked.rejected.unionByName(refused)

    return Changed(judged=ch.judged, drawn_from=views)

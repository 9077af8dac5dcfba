"""Batch change jobs (C1-C10): the application's single-row forms re-aimed as
set-based jobs over a whole change batch.

Plain Parquet tables have no UPDATE/DELETE/MERGE, so every job is a pure function
``(base tables, change batch) -> Changed(table, accepted, rejected)``; the caller
writes ``table`` as a new snapshot (``sources.sinks.write_snapshot``) and swaps
the pointer.  Batches are text columns plus a ``seq`` column giving the order in
which a clerk would have entered them.

Shared rules: every batch is validated first (``operators.validate``); ids of new
rows come from a high-water mark plus the row's position in ``seq`` order (no
single-partition window); rows that touch one key are reduced with algebraic
aggregates, never collected per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..sources.schema import APPOINTMENT_STATUSES, FOREIGN_KEYS, PRIMARY_KEYS, VARCHAR_LENGTHS
from ..sources.tables import Tables, conform
from . import validate as V
from ..session import stored
from .tableview import positions


class Changed:
    """Result of a change job: ``table`` (the new version of the changed table),
    ``accepted`` (what was applied) and ``rejected`` (batch rows refused, with an
    ``errors`` array).  A field may be given as a zero-argument function; it is then
    built on first access, so asking only for ``rejected`` never assigns ids.

    Where all three are drawn from one judged frame (base and batch merged by key in one join),
    ``drawn_from`` is given instead; ``stored()`` then writes that frame once and draws them from there, so that
    the base is read once for all three.  Payments also give ``moved``, what ``plans.upkeep`` adds to its reports."""

    def __init__(self, table=None, accepted=None, rejected=None, *, judged: DataFrame | None = None, drawn_from=None):
        self._parts = {"table": table, "accepted": accepted, "rejected": rejected}
        self.judged, self._drawn_from = judged, drawn_from
        if judged is not None:
            self._parts = dict(zip(("table", "accepted", "rejected", "moved"), drawn_from(judged)))

    def stored(self) -> "Changed":
        """The same result, drawn from the judged frame as written to the shared folder."""
        if self.judged is None:
            return self
        return Changed(judged=stored(self.judged, "judged"), drawn_from=self._drawn_from)

    def _get(self, name: str) -> DataFrame:
        v = self._parts[name]
        if callable(v) and not isinstance(v, DataFrame):
            v = self._parts[name] = v()
        return v

    table = property(lambda self: self._get("table"))
    accepted = property(lambda self: self._get("accepted"))
    rejected = property(lambda self: self._get("rejected"))
    moved = property(lambda self: self._get("moved"))


# ── C1 append with new ids ──────────────────────────────────────────────────
def assign_ids(df: DataFrame, id_col: str, high_water: int, order: Sequence[str] = ("seq",)) -> DataFrame:
    """``id = high_water + position`` in ``order``; ids are never reused.

    ``high_water`` is the last id ever issued (an argument, not ``max(id)``, because
    deleted ids must not come back).  The rows are written once before they are sorted: sampling
    the sort's ranges would judge the whole batch a second time.
    """
    new = stored(df, "new")
    ranked = positions(new, [F.col(c) for c in order], name="_pos", rows=new.count())
    return ranked.withColumn(id_col, F.lit(high_water).cast("long") + F.col("_pos")).drop("_pos")


def register_appointments(t: Tables, batch: DataFrame, high_water: int) -> Changed:
    """C1 for appointments: validate, check the referenced patient/staff/clinic, append.

    A blank status takes the declared default ``Scheduled``.
    """
    text_cols, small = batch.columns, V.is_few(batch)
    b = V.mark_existing(batch, V.parse_id("patient_id"), t.patient, "patient_id", "_has_patient", small)
    b = V.mark_existing(b, V.parse_id("staff_id"), t.staff, "staff_id", "_has_staff", small)
    b = V.mark_existing(b, V.parse_id("clinic_id"), t.clinic, "clinic_id", "_has_clinic", small)
    rules = [
        V.required_text("reason", "Reason"),
        V.max_length("reason", VARCHAR_LENGTHS[("appointment", "reason")], "Reason"),
        V.required_date("appointment_date", "Date"),
        V.required_time("appointment_time", "Time"),
        V.in_domain("status", APPOINTMENT_STATUSES, "Status", optional=True),
        V.reference_exists("_has_patient", "Patient"),
        V.reference_exists("_has_staff", "Staff"),
        V.reference_exists("_has_clinic", "Clinic"),
    ]
    typed = {
        "patient_id": V.parse_id("patient_id"),
        "staff_id": V.parse_id("staff_id"),
        "clinic_id": V.parse_id("clinic_id"),
        "appointment_date": V.parse_date("appointment_date"),
        "appointment_time": V.parse_time("appointment_time"),
        "reason": V.stripped("reason"),
        "status": F.coalesce(V.blank_to_null("status"), F.lit("Scheduled")),
    }
    checked = V.validate(b, rules, typed)
    new = lambda: conform(assign_ids(checked.valid, "appointment_id", high_water), "appointment")
    ch = Changed(None, new, checked.rejected.select(*text_cols, "errors"))
    ch._parts["table"] = lambda: t.appointment.unionByName(ch.accepted)
    return ch


# ── C2 / C3 / C4 updates by key ─────────────────────────────────────────────
def update_by_key(base: DataFrame, updates: DataFrame, key: str, columns: Sequence[str],
                  expected: dict[str, str] | None = None) -> Changed:
    """C2 (full-row update) and C4 (guarded update) on typed updates.

    ``updates`` has ``seq``, ``key``, the new ``columns`` and optionally one
    ``expected_<col>`` column per guard in ``expected`` (``{col: expected_col}``);
    a NULL expectation means no guard.  Several updates of one key: the first
    (lowest ``seq``) applies, the rest are rejected.  Unknown keys and failed
    guards are rejected.  An update to NULL is applied (match flag, not coalesce).

    Base and updates meet once, in a full outer join by key: the judged frame.  The new table, the
    accepted and the refused rows are its three views; for one view Catalyst narrows the join to
    the side and the columns that it needs.
    """
    upd_cols = updates.columns
    first = V.first_per_key(updates, key)
    u = first.valid.select(F.col(key), *[F.col(c).alias(f"_upd_{c}") for c in upd_cols], F.lit(True).alias("_asked"))
    judged = base.withColumn("_known", F.lit(True)).join(u, key, "full_outer")
    guard_ok = F.lit(True)
    for c, e in (expected or {}).items():
        guard_ok = guard_ok & (F.col(f"_upd_{e}").isNull() | F.coalesce(F.col(f"_upd_{e}") == F.col(c), F.lit(False)))
    err = (F.when(F.col("_known").isNull(), F.lit("id does not exist"))
           .when(~guard_ok, F.lit("current value differs from the expected one")))
    judged = judged.withColumn("_err", F.when(F.col("_asked"), err))
    late = first.rejected.select(*upd_cols, "errors")

    def views(judged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        hit = F.coalesce(F.col("_asked"), F.lit(False)) & F.col("_err").isNull()
        new = judged.where("_known").select(*[F.when(hit, F.col(f"_upd_{c}")).otherwise(F.col(c)).alias(c) if c in columns
                                              else F.col(c) for c in base.columns])
        asked = judged.where("_asked")
        accepted = asked.where(F.col("_err").isNull()).select(F.col("_upd_seq").alias("seq"), key, *[F.col(f"_upd_{c}").alias(c) for c in columns])
        refused = asked.where(F.col("_err").isNotNull()).select(*[F.col(f"_upd_{c}").alias(c) for c in upd_cols], F.array("_err").alias("errors"))
        return new, accepted, refused.unionByName(late)

    return Changed(judged=judged, drawn_from=views)


def change_status(appointment: DataFrame, status_in: DataFrame) -> Changed:
    """Appointment status changes, optionally guarded by the expected current status.

    No state machine: any listed status may follow any other, as in the forms.
    """
    text_cols = status_in.columns
    rules = [V.positive_id("appointment_id", "Appointment"),
             V.in_domain("status", APPOINTMENT_STATUSES, "Status"),
             V.in_domain("expected_status", APPOINTMENT_STATUSES, "Expected status", optional=True)]
    checked = V.validate(status_in, rules, {
        "appointment_id": V.parse_id("appointment_id"),
        "status": V.stripped("status"),
        "expected_status": V.blank_to_null("expected_status")})
    ch = update_by_key(appointment, checked.valid, "appointment_id", ["status"],
                       expected={"status": "expected_status"})

    def views(judged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        new, accepted, refused = ch._drawn_from(judged)
        refused = refused.select(
            "seq", F.col("appointment_id").cast("string").alias("appointment_id"), "status",
            F.coalesce("expected_status", F.lit("")).alias("expected_status"), "errors")
        return new, accepted, checked.rejected.select(*text_cols, "errors").unionByName(refused.select(*text_cols, "errors"))

    return Changed(judged=ch.judged, drawn_from=views)


# ── C5 restock ──────────────────────────────────────────────────────────────
MOST_STOCK = 2147483647


def _held_by_name(rows: DataFrame, known: DataFrame, collation: str | None, bad: Column) -> DataFrame:
    """Rows of a batch by name with ``_has`` and ``_over`` of each medication of the name that gives them an error.

    What a name's medications are is counted per name first; a row that all of them accept meets none of them."""
    names = known.select(X.collated("medication_name", collation).alias("_asked"), "medication_id")
    state = known.where("medication_id is not null").select("medication_id", "_over")
    per_name = names.join(state, "medication_id", "left").where(F.col("_asked").isNotNull()).groupBy("_asked").agg(
        F.count_if(F.col("_over")).alias("_n_over"), F.count_if(~F.col("_over")).alias("_n_fit"), F.count_if(F.col("_over").isNull()).alias("_n_lost"))
    held = rows.withColumn("_key", X.collated("_name", collation)).join(per_name, F.col("_key") == F.col("_asked"), "left")
    kinds = [(True, True, F.coalesce("_n_over", F.lit(0))), (True, False, F.when(bad, F.coalesce("_n_fit", F.lit(0))).otherwise(0)),
             (False, False, F.coalesce("_n_lost", F.lit(1)))]
    found = F.concat(*[F.array_repeat(F.struct(F.lit(has).alias("_has"), F.lit(over).alias("_over")), n.cast("int")) for has, over, n in kinds])
    return held.select(*rows.columns, F.inline(found))


def restock(medication: DataFrame, restock_in: DataFrame, collation: str | None = None) -> Changed:
    """Add positive quantities to stock; several rows per medication are summed first.

    The batch names a medication by ``medication_id`` or, if it has no such
    column, by ``medication_name`` (every medication of that name is restocked; names
    are equal under the ``collation``).  Deliveries summed per medication meet the table once; those given by name are
    summed per name before, so a name that many medications share costs its deliveries plus its medications, not their product.
    """
    text_cols = restock_in.columns
    by_name = "medication_id" not in text_cols
    rows = restock_in.withColumn("_quantity", V.parse_int("quantity"))
    counts = F.col("_quantity") > 0
    sums = [F.sum(F.when(counts, F.col("_quantity"))).alias("_added"), F.count_if(counts).alias("_deliveries")]
    if by_name:
        rows = rows.withColumn("_name", V.stripped("medication_name"))
        # per spelling first: equal bytes are hashed, and few rows are left to be sorted under the collation
        spelt = rows.where(F.col("_name").isNotNull()).groupBy("_name").agg(*sums)
        again = [F.sum(c).alias(c) for c in ("_added", "_deliveries")]
        named = spelt.groupBy(X.collated("_name", collation).alias("_asked")).agg(*again)
        names = medication.where("medication_id is not null").select("medication_id", X.collated("medication_name", collation).alias("_name"))
        summed = names.join(named, names["_name"] == named["_asked"]).groupBy("medication_id").agg(*again)
    else:
        rows = rows.withColumn("_id", V.parse_id("medication_id"))
        summed = rows.where(F.col("_id").isNotNull()).groupBy(F.col("_id").alias("medication_id")).agg(*sums)
    judged = medication.withColumn("_known", F.lit(True)).join(summed, "medication_id", "full_outer")
    after = F.col("stock_quantity").cast("long") + F.coalesce("_added", F.lit(0))
    judged = judged.withColumn("_over", F.col("_known") & (after > MOST_STOCK))
    message, bad = V.positive_int("quantity", "Quantity")

    def views(judged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        known = judged.where("_known")
        new = known.select(*[F.when(F.col("_over"), F.col(c)).otherwise(after).cast("int").alias(c) if c == "stock_quantity"
                             else F.col(c) for c in medication.columns])
        accepted = known.where((F.col("_deliveries") > 0) & ~F.col("_over")).select(
            "medication_id", F.col("_deliveries").alias("deliveries"), F.col("_added").cast("long").alias("added"),
            F.col("stock_quantity").alias("stock_before"), after.cast("int").alias("stock_after"))
        if by_name:
            held = _held_by_name(rows, known, collation, bad)
        else:
            state = judged.where(F.col("_deliveries").isNotNull()).select(
                F.col("medication_id").alias("_id"), F.coalesce("_known", F.lit(False)).alias("_has"), "_over")
            held = rows.join(state, "_id", "left")
        rules = [(message, bad), ("Medication does not exist", ~F.coalesce("_has", F.lit(False)))]
        errors = V.errors_column(rules)
        over = F.when((F.size("_errors") == 0) & F.coalesce("_over", F.lit(False)),
                      F.array(F.lit("Stock would exceed its limit"))).otherwise(F.col("_errors"))
        refused = held.withColumn("_errors", errors).select(*text_cols, over.alias("errors")).where(F.size("errors") > 0)
        return new, accepted, refused

    return Changed(judged=judged, drawn_from=views)


# ── C6 create bills ─────────────────────────────────────────────────────────
def _with_visit_state(t: Tables, b: DataFrame, bill_in: DataFrame) -> DataFrame:
    """``b`` with ``patient_id`` of its visit (``_id``) and ``_roles``: 1 the visit exists, 2 it has a bill; one aggregation by visit."""
    ids = b.select("_id").where("_id is not null")
    parts = [(t.appointment, F.col("patient_id"), 1), (t.bill, F.lit(None).cast("long"), 2)]
    tagged = [df.select(F.col("appointment_id").alias("_id"), p.alias("_patient"), F.lit(r).alias("_roles")) for df, p, r in parts]
    few = V.is_few(bill_in)
    if few:
        tagged = [df.join(F.broadcast(ids), "_id", "left_semi") for df in tagged]
    else:
        tagged.append(ids.select("_id", F.lit(None).cast("long").alias("_patient"), F.lit(4).alias("_roles")))
    union = tagged[0]
    for part in tagged[1:]:
        union = union.unionByName(part)
    state = union.groupBy("_id").agg(F.max("_patient").alias("patient_id"), F.bit_or("_roles").alias("_roles"))
    if not few:
        state = state.where(F.col("_roles") >= 4)
    return b.join(state, "_id", "left").withColumn("_roles", F.coalesce("_roles", F.lit(0)))


def create_bills(t: Tables, bill_in: DataFrame, high_water: int) -> Changed:
    """Bills for unbilled appointments only; the patient comes from the appointment.

    total > 0, 0 <= paid <= total, status by the ladder; a second row for one
    appointment in the batch is rejected (the lowest ``seq`` wins).  What the batch has to know of an appointment
    (does it exist, whose is it, has it a bill) comes from one aggregation over appointments, bills and batch.
    """
    text_cols = bill_in.columns
    paid_text = F.when(V.stripped("amount_paid") == "", F.lit("0")).otherwise(F.col("amount_paid"))
    b = (bill_in.withColumn("_row", F.struct(*text_cols)).withColumn("_id", V.parse_id("appointment_id")).withColumn("_paid_text", paid_text))
    if t.bucketed("appointment_id", "appointment", "bill"):
        # both lie by visit already: only the batch is shuffled
        owner = t.appointment.select(F.col("appointment_id").alias("_id"), "patient_id", F.lit(1).alias("_there"))
        billed = t.bill.select(F.col("appointment_id").alias("_id")).distinct().withColumn("_billed", F.lit(2))
        b = b.join(owner, "_id", "left").join(billed, "_id", "left")
        b = b.withColumn("_roles", F.coalesce("_there", F.lit(0)) + F.coalesce("_billed", F.lit(0))).drop("_there", "_billed")
    else:
        b = _with_visit_state(t, b, bill_in)
    rules = [
        ("Appointment does not exist", F.col("_roles").bitwiseAND(1) == 0),
        ("Appointment already has a bill", F.col("_roles").bitwiseAND(2) != 0),
        V.amount("total_amount", "Total Amount", positive=True),
        V.amount("_paid_text", "Amount Paid"),
        V.not_above(V.parse_amount("_paid_text"), V.parse_amount("total_amount"), "Paid cannot exceed total"),
        V.required_date("bill_date", "Bill Date"),
    ]
    checked = V.validate(b, rules, {
        "appointment_id": F.col("_id"), "patient_id": F.col("patient_id"), "total_amount": V.parse_amount("total_amount"),
        "amount_paid": V.parse_amount("_paid_text"), "bill_date": V.parse_date("bill_date")}, keep=("seq", "_row"))
    once = V.first_per_key(checked.valid, "appointment_id")
    priced = once.valid.drop("_row").withColumn(
        "payment_status", F.when(F.col("amount_paid") == F.col("total_amount"), "Paid")
        .when(F.col("amount_paid") > 0, "Partial").otherwise("Unpaid"))
    dup = once.rejected.select("_row.*", "errors").select(*text_cols, "errors")
    rejected = checked.rejected.select(*text_cols, "errors").unionByName(dup)
    ch = Changed(None, lambda: conform(assign_ids(priced, "bill_id", high_water), "bill"), rejected)
    ch._parts["table"] = lambda: t.bill.unionByName(ch.accepted)
    return ch


# ── C7 payments ─────────────────────────────────────────────────────────────
def apply_payments(bill: DataFrame, payment_in: DataFrame) -> Changed:
    """``new_paid = least(total, paid + sum(payments))``; Paid when it reaches total.

    Only open bills (total > paid) take payments; amounts must be > 0 (NaN and
    infinities refused).  All payments of a bill are summed first: since each is
    positive, capping once equals capping after each.  The excess over the total
    is reported as ``unapplied``.  The sums meet the bills once, in a full outer join: the judged frame.
    """
    text_cols = payment_in.columns
    rows = payment_in.withColumn("_id", V.parse_id("bill_id")).withColumn("_amount", V.parse_amount("amount"))
    counts = F.col("_amount") > 0
    summed = rows.where(F.col("_id").isNotNull()).groupBy(F.col("_id").alias("bill_id")).agg(
        F.sum(F.when(counts, F.col("_amount"))).alias("_paid_now"), F.count_if(counts).alias("_payments"))
    is_open = F.col("total_amount") > F.col("amount_paid")
    judged = bill.withColumn("_known", F.lit(True)).join(summed, "bill_id", "full_outer")
    message, bad = V.amount("amount", "Payment", positive=True)

    def views(judged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        known = judged.where("_known")
        hit = F.coalesce((F.col("_payments") > 0) & is_open, F.lit(False))
        new_paid = F.least(F.col("total_amount"), F.col("amount_paid") + F.col("_paid_now")).cast("decimal(10,2)")
        status = X.status_ladder(new_paid, F.col("total_amount"))
        changed = {"amount_paid": new_paid, "payment_status": status}
        new = known.select(*[F.when(hit, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in bill.columns])
        accepted = known.where(hit).select(
            "bill_id", F.col("_payments").alias("payments"), F.col("_paid_now").cast("decimal(20,2)").alias("paid_now"),
            F.col("amount_paid").alias("paid_before"), new_paid.alias("paid_after"),
            (F.col("amount_paid") + F.col("_paid_now") - new_paid).cast("decimal(20,2)").alias("unapplied"),
            status.alias("payment_status"))
        state = judged.where(F.col("_payments").isNotNull()).select(
            F.col("bill_id").alias("_id"), F.coalesce("_known", F.lit(False)).alias("_has"), F.coalesce(is_open, F.lit(False)).alias("_open"))
        held = rows.join(state, "_id", "left").withColumn("_has", F.coalesce("_has", F.lit(False)))
        rules = [(message, bad), ("Bill does not exist", ~F.col("_has")), ("Bill is already paid", F.col("_has") & ~F.col("_open"))]
        refused = held.withColumn("errors", V.errors_column(rules)).where(F.size("errors") > 0).select(*text_cols, "errors")
        moved = known.where(hit).select("bill_id", "appointment_id", "bill_date", (new_paid - F.col("amount_paid")).cast("decimal(10,2)").alias("collected"))
        return new, accepted, refused, moved

    return Changed(judged=judged, drawn_from=views)


# ── C8 / C9 deletes ─────────────────────────────────────────────────────────
def delete_restrict(t: Tables, table: str, delete_in: DataFrame,
                    guard: tuple[str, str] | None = None) -> Changed:
    """C8 (delete by key, ON DELETE RESTRICT) and C9 (guarded delete, e.g. only Cancelled).

    Each requested id is ``deleted``, ``blocked`` (a child row references it),
    ``guard failed`` or ``not found``.  ``table`` of the result is the parent
    without the deleted rows.  One aggregation over the tagged union of requests, parent and all
    children gives each key's role bits, whatever the number of children.
    """
    key = PRIMARY_KEYS[table]
    base = t[table]
    req = delete_in.select("seq", F.col("id").alias("id_text"), V.parse_id("id").alias(key))
    guarded = F.lit(3) if guard is None else F.when(F.col(guard[0]) == F.lit(guard[1]), 3).otherwise(1)
    parts = [(base, F.col(key), guarded), (req, F.col(key), 8)]
    parts += [(t[child], F.col(fk), 4) for child, fk, parent in FOREIGN_KEYS if parent == table]
    few = req.select(key).where(F.col(key).isNotNull()) if V.is_few(delete_in) else None
    has = lambda bit: F.coalesce(F.col("roles").bitwiseAND(bit), F.lit(0)) != 0
    judged = V.roles_of_keys(parts, key, few).where(has(8))
    outcome = (F.when(~has(1), "not found").when(~has(2), "guard failed").when(has(4), "blocked").otherwise("deleted"))
    report = req.join(judged, key, "left").select("seq", F.col("id_text").alias("id"), outcome.alias("outcome"))
    deleted_ids = judged.where(outcome == "deleted").select(key)
    new = base.join(deleted_ids, key, "left_anti")
    rejected = report.where(F.col("outcome") != "deleted").select(
        "seq", "id", F.array("outcome").alias("errors"))
    return Changed(new, report.where(F.col("outcome") == "deleted"), rejected)


# ── C10 re-key with ON UPDATE CASCADE ───────────────────────────────────────
def rekey(t: Tables, table: str, key_map: DataFrame) -> tuple[Tables, DataFrame]:
    """Change primary keys of ``table`` (``old_id``, ``new_id``) and cascade to every child
    foreign key.  Returns all tables (unchanged ones are the same plans) and the refused map rows
    with an ``errors`` array: an id that is missing, named twice (as old or as new), or a new id
    that is in use.  Each table is joined once with the rest (N:1 on the old key).
    """
    key = PRIMARY_KEYS[table]
    m = key_map.select(F.col("old_id").cast("long").alias("_old"), F.col("new_id").cast("long").alias("_new"))
    for side in ("_old", "_new"):
        m = m.join(m.groupBy(side).agg(F.count(F.lit(1)).alias(f"{side}_times")), side, "left")
        known = V.keys_present(t[table], key, m, side, alias=side).withColumn(f"{side}_known", F.lit(True))
        m = m.join(known, side, "left")
    rules = [("Old id does not exist", F.col("_old_known").isNull()), ("Old id is named twice", F.col("_old_times") > 1),
             ("New id is missing", F.col("_new").isNull()), ("New id is named twice", F.col("_new_times") > 1),
             ("New id is in use", F.col("_new_known").isNotNull())]
    m = m.withColumn("errors", V.errors_column([(msg, F.coalesce(bad, F.lit(False))) for msg, bad in rules]))
    refused = m.where(F.size("errors") > 0).select(F.col("_old").alias("old_id"), F.col("_new").alias("new_id"), "errors")
    m = m.where(F.size("errors") == 0).select("_old", "_new")

    def remap(df: DataFrame, col: str) -> DataFrame:
        j = df.join(m, df[col] == m["_old"], "left")
        return j.select(*[F.coalesce(F.col("_new"), F.col(c)).alias(c) if c == col else F.col(c)
                          for c in df.columns])

    out = Tables(t)
    out[table] = remap(t[table], key)
    for child, fk, parent in FOREIGN_KEYS:
        if parent == table:
            out[child] = remap(out[child], fk)
    return out, refused

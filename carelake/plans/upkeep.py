"""Reports kept up to date from what change jobs applied, without reading the fact tables again.

The ledger is the mergeable state behind the dashboard (Q1), the clinic revenue reports (Q19, Q28) and the
monthly revenue (R4): sums per clinic and month.  Sums of disjoint rows add up, so the ledger after a batch is
the ledger before it plus the ledger of the batch, and its size is clinics times months whatever the tables hold.

    ledger = stored(of_tables(t), "ledger")                       # once, the only pass over the bills
    paid = C.apply_payments(t.bill, payments).stored()
    ledger = stored(merged(ledger, of_payments(paid.moved, t.appointment)), "ledger")
    revenue_by_clinic(ledger, t.clinic)

Rows of the ledger: ``entry`` is ``money`` (``clinic_id``, ``month`` and the sums of the bills of that month whose visit
is at that clinic), ``visits`` (``clinic_id`` and its visits as ``n``) or ``rows`` (a table's name as ``of`` and its
rows as ``n``).  Bills without a visit, or without a date, are under NULL; they count for the dashboard and the month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..sources.tables import Tables

KEYS = {"entry": "string", "of": "string", "clinic_id": "bigint", "month": "date"}
SUMS = {"n": "bigint", "billed": "decimal(20,2)", "collected": "decimal(20,2)"}
COUNTED = ("patient", "staff", "clinic", "appointment")


def _entries(df: DataFrame, entry: str, **columns: Column) -> DataFrame:
    """Ledger rows of one kind, summed by their key."""
    given = {"entry": F.lit(entry), **columns}
    rows = df.select(*[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in KEYS.items()],
                     *[given.get(c, F.lit(0)).cast(t).alias(c) for c, t in SUMS.items()])
    return _summed(rows)


def _summed(rows: DataFrame) -> DataFrame:
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast(t).alias(c) for c, t in SUMS.items()]
    return rows.groupBy(*KEYS).agg(*sums)


def _money(bills: DataFrame, appointment: DataFrame, n: Column, billed: Column, collected: Column) -> DataFrame:
    """Bills are summed per visit and month before they meet their visits, so that a clinic that holds a third of them shuffles sums."""
    per_visit = bills.groupBy("appointment_id", F.trunc("bill_date", "month").alias("month")).agg(
        F.sum(n).alias("n"), F.sum(billed).alias("billed"), F.sum(collected).alias("collected"))
    placed = per_visit.join(appointment.select("appointment_id", "clinic_id"), "appointment_id", "left")
    return _entries(placed, "money", clinic_id=F.col("clinic_id"), month=F.col("month"), n=F.col("n"),
                    billed=F.col("billed"), collected=F.col("collected"))


# ── what a ledger is made of ────────────────────────────────────────────────
def of_tables(t: Tables) -> DataFrame:
    """The ledger of whole tables; each is read once."""
    return merged(of_new_bills(t.bill, t.appointment), of_new_visits(t.appointment),
                  *[of_new_rows(name, t[name]) for name in COUNTED if name != "appointment"])


def of_new_bills(accepted: DataFrame, appointment: DataFrame) -> DataFrame:
    """What new bills (C6 ``accepted``) add."""
    return _money(accepted, appointment, F.lit(1), F.col("total_amount"), F.col("amount_paid"))


def of_payments(moved: DataFrame, appointment: DataFrame) -> DataFrame:
    """What payments (C7 ``moved``: visit and date of each paid bill, and what it took) add."""
    return _money(moved, appointment, F.lit(0), F.lit(0), F.col("collected"))


def of_new_visits(accepted: DataFrame) -> DataFrame:
    """What new visits (C1 ``accepted``) add."""
    return merged(_entries(accepted, "visits", clinic_id=F.col("clinic_id"), n=F.lit(1)), of_new_rows("appointment", accepted))


def of_deleted_visits(accepted: DataFrame, appointment: DataFrame) -> DataFrame:
    """What deleted visits (C8, C9 ``accepted``, with ``appointment`` as it was before) take away; they had no bills.

    A request may name one visit twice; it is taken away once."""
    ids = accepted.select(F.trim("id").try_cast("bigint").alias("appointment_id")).distinct()
    gone = appointment.select("appointment_id", "clinic_id").join(ids, "appointment_id", "left_semi")
    return merged(_entries(gone, "visits", clinic_id=F.col("clinic_id"), n=F.lit(-1)),
                  _entries(gone, "rows", of=F.lit("appointment"), n=F.lit(-1)))


def of_new_rows(table: str, accepted: DataFrame) -> DataFrame:
    """What new rows of ``table`` add to its count."""
    return _entries(accepted, "rows", of=F.lit(table), n=F.lit(1))


def merged(ledger: DataFrame, *more: DataFrame) -> DataFrame:
    """One ledger of several; the order doesn't matter."""
    for part in more:
        ledger = ledger.unionByName(part)
    return _summed(ledger)


# ── the reports ─────────────────────────────────────────────────────────────
def _cash(c: Column, name: str) -> Column:
    return F.coalesce(c, F.lit(0)).cast("decimal(20,2)").alias(name)


def _due() -> Column:
    return F.sum(F.col("billed") - F.col("collected"))


def dashboard_metrics(ledger: DataFrame, display: bool = False) -> DataFrame:
    """Q1 from the ledger."""
    rows, money = F.col("entry") == "rows", F.col("entry") == "money"
    one = ledger.agg(
        *[F.coalesce(F.sum(F.when(rows & (F.col("of") == t), F.col("n"))), F.lit(0)).alias(name)
          for t, name in zip(COUNTED, ("patients", "staff", "clinics", "appointments"), strict=True)],
        _cash(F.sum(F.when(money, F.col("collected"))), "collected"),
        _cash(F.sum(F.when(money, F.col("billed") - F.col("collected"))), "outstanding"))
    if not display:
        return one
    return one.select(*[X.thousands(c).alias(c) for c in one.columns[:4]],
                      *[X.money_text_half_even(c).alias(c) for c in one.columns[4:]])


def revenue_by_clinic(ledger: DataFrame, clinic: DataFrame) -> DataFrame:
    """Q19 from the ledger: visits and sums per clinic, clinics without visits kept."""
    sums = ledger.groupBy("clinic_id").agg(
        F.sum(F.when(F.col("entry") == "visits", F.col("n"))).alias("visits"),
        F.sum("billed").alias("billed"), F.sum("collected").alias("collected"), _due().alias("due"))
    return (clinic.select("clinic_id", "clinic_name").join(sums, "clinic_id", "left")
            .select("clinic_id", "clinic_name", F.coalesce("visits", F.lit(0)).alias("visits"), _cash(F.col("billed"), "total_billed"),
                    _cash(F.col("collected"), "total_collected"), _cash(F.col("due"), "total_outstanding"))
            .orderBy(F.col("total_collected").desc(), "clinic_id"))


def revenue_by_billed_clinic(ledger: DataFrame, clinic: DataFrame) -> DataFrame:
    """Q28 from the ledger: clinics with at least one bill."""
    sums = (ledger.where("entry = 'money' and clinic_id is not null").groupBy("clinic_id")
            .agg(F.sum("n").alias("n"), _cash(F.sum("billed"), "total_billed"), _cash(F.sum("collected"), "total_collected"),
                 _cash(_due(), "total_outstanding")).where("n > 0"))
    return (sums.join(clinic.select("clinic_id", "clinic_name"), "clinic_id").orderBy(F.col("total_collected").desc(), "clinic_id")
            .select("clinic_id", "clinic_name", "total_billed", "total_collected", "total_outstanding"))


def monthly_revenue(ledger: DataFrame) -> DataFrame:
    """R4 from the ledger."""
    return (ledger.where("entry = 'money'").groupBy("month")
            .agg(F.sum("n").alias("bills"), _cash(F.sum("billed"), "total_billed"), _cash(F.sum("collected"), "total_collected"),
                 _cash(_due(), "total_outstanding")).where("bills > 0").orderBy("month"))

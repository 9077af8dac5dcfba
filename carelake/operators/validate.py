"""Validation of typed-in change batches (V1-V10) as one Spark job per batch.

A batch arrives as text columns (what a clerk typed) plus a ``seq`` column.
Parsers turn text into typed columns with ``try_*`` built-ins (NULL on failure);
rules are ``(message, failing_condition)`` pairs.  ``validate`` evaluates every
rule on every row and splits the batch into

* ``valid``    - typed rows that passed every rule, and
* ``rejected`` - the original text rows with an ``errors`` array of messages.

``valid`` + ``rejected`` always account for every input row exactly once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


Rule = tuple[str, Column]


# ── parsers (text -> typed, NULL when unparseable) ─────────────────────────
# The white space characters of Unicode.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(c: str) -> Column:
    """Text without white space (blanks, tabs, line breaks and the like) at either end."""
    return F.btrim(F.col(c), F.lit(WHITE_SPACE))


def blank_to_null(c: str) -> Column:
    """Optional text: stripped, and NULL when blank."""
    return F.nullif(stripped(c), F.lit(""))


def parse_date(c: str) -> Column:
    """V2: ``yyyy-M-d`` after stripping; accepts ``2024-5-1``, rejects ``2024-02-30`` and ``2024-05-001``."""
    text = stripped(c)
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.try_to_date(text, "yyyy-M-d"))


def parse_time(c: str) -> Column:
    """V4: ``H:m`` after stripping, stored as ``HH:mm:ss`` text; rejects ``24:00`` and ``009:05``."""
    text = stripped(c)
    ts = F.try_to_timestamp(text, F.lit("H:m"))
    return F.when(text.rlike(r"^[0-9]{1,2}:[0-9]{1,2}$"), F.date_format(ts, "HH:mm:ss"))


def parse_int(c: str) -> Column:
    """V5: whole number of a quantity; ``+5`` and `` 7 `` accepted, ``5.0`` and ``abc`` rejected."""
    return stripped(c).try_cast("int")


def parse_id(c: str) -> Column:
    """Whole number of a key: as wide as the id columns (64 bits)."""
    return stripped(c).try_cast("bigint")


def parse_amount(c: str) -> Column:
    """V6: decimal amount quantised to cents half-even (X16), rounded once; NaN, infinities and
    amounts beyond DECIMAL(10,2) are rejected (NULL).  Read with 28 decimals."""
    wide = stripped(c).try_cast("decimal(38,28)")
    return F.bround(wide, 2).try_cast("decimal(10,2)")


# ── rule builders ───────────────────────────────────────────────────────────
def required_text(c: str, label: str) -> Rule:
    """V1."""
    return f"{label} is required", F.coalesce(stripped(c) == "", F.lit(True))


def required_date(c: str, label: str) -> Rule:
    """V2."""
    return f"{label} must be a date (YYYY-MM-DD)", parse_date(c).isNull()


def optional_date(c: str, label: str) -> Rule:
    """V3: blank is fine, anything else must parse."""
    return f"{label} must be a date (YYYY-MM-DD)", blank_to_null(c).isNotNull() & parse_date(c).isNull()


def required_time(c: str, label: str) -> Rule:
    """V4."""
    return f"{label} must be a time (HH:MM)", parse_time(c).isNull()


def positive_int(c: str, label: str) -> Rule:
    """V5 (> 0)."""
    v = parse_int(c)
    return f"{label} must be a whole number greater than zero", v.isNull() | (v <= 0)


def positive_id(c: str, label: str) -> Rule:
    """V5 (> 0) for a key."""
    v = parse_id(c)
    return f"{label} must be a whole number greater than zero", v.isNull() | (v <= 0)


def nonnegative_int(c: str, label: str) -> Rule:
    """V5 (>= 0)."""
    v = parse_int(c)
    return f"{label} must be a whole number, not negative", v.isNull() | (v < 0)


def amount(c: str, label: str, positive: bool = False) -> Rule:
    """V6: a valid non-negative amount (or > 0 for totals and payments)."""
    v = parse_amount(c)
    bad = v.isNull() | ((v <= 0) if positive else (v < 0))
    return f"{label} must be a valid amount {'greater than zero' if positive else 'not negative'}", bad


def not_above(lower: Column, upper: Column, message: str) -> Rule:
    """V7: e.g. paid must not exceed total (only checked when both parse)."""
    return message, F.coalesce(lower > upper, F.lit(False))


def max_length(c: str, n: int, label: str) -> Rule:
    """V8: VARCHAR(n) length."""
    return f"{label} is longer than {n} characters", F.coalesce(F.length(stripped(c)) > n, F.lit(False))


def in_domain(c: str, values: Sequence[str], label: str, optional: bool = False) -> Rule:
    """V9: value in a fixed domain (blank allowed when ``optional``)."""
    v = blank_to_null(c)
    ok = v.isin(*values)
    if optional:
        ok = ok | v.isNull()
    return f"{label} must be one of {', '.join(values)}", ~F.coalesce(ok, F.lit(False))


def reference_exists(flag_col: str, label: str) -> Rule:
    """The referenced id exists (``flag_col`` set by :func:`mark_existing`)."""
    return f"{label} does not exist", ~F.col(flag_col)


#: Ids of a batch that are sent to every task (8 bytes each); above that both sides are shuffled.
FEW = 100_000


def is_few(batch: DataFrame) -> bool:
    """Has the batch so few rows that its ids may be broadcast?  Counts at most ``FEW`` + 1 rows."""
    return batch.limit(FEW + 1).count() <= FEW


def roles_of_keys(parts: Sequence[tuple[DataFrame, Column, int | Column]], alias: str, few: DataFrame | None = None) -> DataFrame:
    """One row per key with the bits of all roles it occurs in: ``alias``, ``roles``.

    ``parts`` are (rows, key, role bits).  The tagged union takes one shuffle however many
    parts there are, and a hot key is reduced before it.  ``few`` (a small batch's ids, named
    ``alias``) restricts the parts by a broadcast first, so that a large table is scanned but not shuffled.
    """
    union = None
    for rows, key, role in parts:
        tagged = rows.select(key.alias(alias), (role if isinstance(role, Column) else F.lit(role)).cast("int").alias("roles"))
        tagged = tagged.where(F.col(alias).isNotNull())
        if few is not None:
            tagged = tagged.join(F.broadcast(few), alias, "left_semi")
        union = tagged if union is None else union.unionByName(tagged)
    return union.groupBy(alias).agg(F.bit_or("roles").alias("roles"))


def keys_present(keys: DataFrame, key: str, wanted: DataFrame, wanted_key: str, alias: str = "_k", small: bool = False) -> DataFrame:
    """The distinct ids of ``wanted`` that occur as ``key`` in ``keys``.

    ``small``: ``wanted`` passed :func:`is_few`, its ids are broadcast to the scan of ``keys``;
    otherwise both sides meet in one aggregation of role bits.
    """
    ids = wanted.select(F.col(wanted_key).alias(alias)).where(F.col(alias).isNotNull())
    if small:
        return keys.select(F.col(key).alias(alias)).join(F.broadcast(ids), alias, "left_semi").distinct()
    return roles_of_keys([(keys, F.col(key), 1), (wanted, F.col(wanted_key), 2)], alias).where("roles = 3").select(alias)


def mark_existing(df: DataFrame, id_expr: Column, parent: DataFrame, parent_key: str, flag: str, small: bool | None = None) -> DataFrame:
    """Add a boolean ``flag``: does ``id_expr`` exist as ``parent_key`` in ``parent``?

    A small batch reduces the parent keys to its ids first (:func:`keys_present`); a large one meets the
    distinct parent keys as they are, without a pass over its ids before.  Either has one row per id, so no fan-out.
    ``small`` is the answer of :func:`is_few` where it is known.
    """
    probe_col, key_col = f"_{flag}_probe", f"_{flag}_key"
    small = is_few(df) if small is None else small
    out = df.withColumn(probe_col, id_expr)
    if small:
        found = keys_present(parent, parent_key, out, probe_col, alias=key_col, small=True)
    else:
        found = parent.select(F.col(parent_key).alias(key_col)).where(F.col(key_col).isNotNull()).distinct()
    found = found.withColumn(flag, F.lit(True))
    out = out.join(found, out[probe_col] == found[key_col], "left")
    return out.withColumn(flag, F.coalesce(F.col(flag), F.lit(False))).drop(probe_col, key_col)


@dataclass
class Checked:
    valid: DataFrame
    rejected: DataFrame


def errors_column(rules: Sequence[Rule]) -> Column:
    """Array of the messages of the failing rules (bounded by the number of rules)."""
    msgs = F.array(*[F.when(bad, F.lit(msg)) for msg, bad in rules])
    return F.filter(msgs, lambda m: m.isNotNull())


def validate(df: DataFrame, rules: Sequence[Rule], typed: dict[str, Column],
             keep: Sequence[str] = ("seq",)) -> Checked:
    """Evaluate ``rules`` on every row; typed columns for the valid rows, messages for the rest."""
    text_cols = list(df.columns)
    marked = df.withColumn("errors", errors_column(rules))
    valid = marked.where(F.size("errors") == 0).select(
        *[F.col(k) for k in keep], *[c.alias(n) for n, c in typed.items()])
    rejected = marked.where(F.size("errors") > 0).select(*text_cols, "errors")
    return Checked(valid, rejected)


def first_per_key(df: DataFrame, key: str, order: str = "seq", reason: str = "duplicate in batch") -> Checked:
    """Keep the lowest-``order`` row per key; the others are rejected with ``reason``.

    The lowest ``order`` is an algebraic aggregate, so a hot key is reduced map-side; only
    rows that tie on it are numbered, by all their columns, and one of them stays.
    """
    first = df.groupBy(key).agg(F.min(order).alias("_first"))
    marked = df.join(first, key)
    least = marked.where(F.col(order) == F.col("_first")).drop("_first")
    ranked = least.withColumn("_tie", F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c) for c in df.columns])))
    refused = F.array(F.lit(reason))
    late = marked.where(F.col(order) != F.col("_first")).drop("_first").withColumn("errors", refused)
    tied = ranked.where("_tie > 1").drop("_tie").withColumn("errors", refused)
    return Checked(ranked.where("_tie = 1").drop("_tie"), late.unionByName(tied))

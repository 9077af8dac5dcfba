"""Scalar expressions (X1-X16) as built-in Spark column expressions.

Everything here returns a ``Column`` and stays inside whole-stage codegen; there
are no Python UDFs in the library.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# The display conventions of the reports.
NULL_TEXT = "-"              # how a missing value is shown
CURRENCY_PREFIX = "Le "      # money prefix
DATE_DISPLAY = "dd MMM yyyy"  # e.g. 01 May 2024


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def full_name(first: ColumnOrName, last: ColumnOrName) -> Column:
    """``first || ' ' || last``; NULL when either part is NULL."""
    return F.concat(_c(first), F.lit(" "), _c(last))


def with_suffix(value: ColumnOrName, suffix: str) -> Column:
    """Number followed by a unit text, e.g. ``7 days``; explicit cast under ANSI."""
    return F.concat(_c(value).cast("string"), F.lit(suffix))


def display_date(d: ColumnOrName) -> Column:
    """``01 May 2024``."""
    return F.date_format(_c(d), DATE_DISPLAY)


def display_time(t: ColumnOrName) -> Column:
    """``HH:mm`` from ``HH:mm:ss`` text."""
    return F.substring(_c(t), 1, 5)


def if_null(x: ColumnOrName, default) -> Column:
    """X5."""
    return F.coalesce(_c(x), default if isinstance(default, Column) else F.lit(default))


def thousands(x: ColumnOrName) -> Column:
    """Whole number with thousands separators, halves rounded away from zero.

    ``format_number`` alone rounds half-even, so round half-up first.
    """
    return F.format_number(F.round(_c(x), 0), 0)


def money_text(x: ColumnOrName) -> Column:
    """``Le 1,234`` with halves rounded away from zero; NULL stays NULL."""
    return F.concat(F.lit(CURRENCY_PREFIX), thousands(x))


def money_text_half_even(x: ColumnOrName) -> Column:
    """``Le 1,234`` rounded half-even, as the dashboard cards format money.

    Reports use :func:`money_text` (half away from zero); the two differ only on
    amounts ending in exactly ``.50``.
    """
    return F.concat(F.lit(CURRENCY_PREFIX), F.format_number(F.bround(_c(x), 0), 0))


def null_text(x: ColumnOrName) -> Column:
    """Display text of any value, ``-`` for NULL."""
    return F.coalesce(_c(x).cast("string"), F.lit(NULL_TEXT))


def normalized(x: ColumnOrName) -> Column:
    """Trimmed lower-case text."""
    return F.lower(F.trim(_c(x)))


# Collations that compare text as the original database's default does (letters
# of either case are equal); None compares bytes.
ANY_CASE = "UTF8_LCASE"


def collated(x: ColumnOrName, collation: str | None) -> Column:
    """Text compared, grouped, joined and ordered under a named collation; ``None`` leaves it binary."""
    return _c(x) if collation is None else F.collate(_c(x).cast("string"), collation)


def plain_text(x: ColumnOrName) -> Column:
    """Collated text as binary text again, so that no collation leaves a report in its schema."""
    return F.collate(_c(x), "UTF8_BINARY")


def status_ladder(paid: ColumnOrName, total: ColumnOrName) -> Column:
    """Paid when paid reaches total, Partial when something is paid, else Unpaid."""
    p, t = _c(paid), _c(total)
    return F.when(p >= t, "Paid").when(p > 0, "Partial").otherwise("Unpaid")


def cents(x: ColumnOrName) -> Column:
    """Quantise to cents with half-even rounding, as a DECIMAL(10,2)."""
    return F.bround(_c(x), 2).cast("decimal(10,2)")


def ordinal(x: ColumnOrName, domain: tuple[str, ...]) -> Column:
    """ENUM ordinal (1-based) of a domain value; ENUMs sort by ordinal, not by text."""
    expr = None
    for i, v in enumerate(domain, start=1):
        expr = F.when(_c(x) == v, i) if expr is None else expr.when(_c(x) == v, i)
    return expr


def ordered_distinct_text(flags: list[tuple[Column, str]], sep: str = ", ") -> Column:
    """``GROUP_CONCAT(DISTINCT x ORDER BY x)`` for an ENUM with few values.

    ``flags`` are per-group booleans (``max(x = v)``) listed in ordinal order, so
    the group never has to be collected into an array.
    """
    return F.concat_ws(sep, *[F.when(flag, F.lit(v)) for flag, v in flags])

"""Table operators over any DataFrame (T1-T8): search, facet, typed sort, counts, export.

They reproduce the application's table layer but run on executors inside the
same plan as the report that feeds them: search and facet are filters, the sort
is a distributed range sort, counts are one aggregate pass.  Comparisons use the
display text of each cell (``-`` for NULL), as the application does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..session import scratch_path, stored

# Text forms of a number the sort accepts (decimal, exponent, infinity).
NUMBER_PATTERN = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
INFINITY_PATTERN = r"^[+-]?([iI][nN][fF]|[iI][nN][fF][iI][nN][iI][tT][yY])$"
ALL = "All"


def row_text(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """The cells of a row as display text joined by single spaces, lower-cased."""
    cols = list(columns) if columns is not None else df.columns
    return F.lower(F.concat_ws(" ", *[X.null_text(F.col(f"`{c}`")) for c in cols]))


def search_predicate(df: DataFrame, term: str | None, columns: Sequence[str] | None = None) -> Column:
    """T1 predicate: the trimmed lower-case term occurs in the joined row text.

    The term is a literal substring (no wildcards) and may span adjacent cells.
    """
    norm = (term or "").strip().lower()
    if not norm:
        return F.lit(True)
    return row_text(df, columns).contains(F.lit(norm))


def search(df: DataFrame, term: str | None, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows whose text contains ``term``; a blank term keeps every row."""
    return df.where(search_predicate(df, term, columns))


def facet_predicate(column: str, value: str | None, collation: str | None = None) -> Column:
    """T2 predicate: case-insensitive equality of the cell text; ``All`` keeps every row.

    With a ``collation`` the cell equals the value under its rules instead (for example
    ``UNICODE_CI_AI``, which ignores accents too).
    """
    if value is None or value == ALL:
        return F.lit(True)
    cell = X.null_text(F.col(f"`{column}`"))
    if collation is not None:
        return X.collated(cell, collation) == X.collated(F.lit(value), collation)
    return F.lower(cell) == F.lit(value.lower())


def facet(df: DataFrame, column: str, value: str | None, collation: str | None = None) -> DataFrame:
    """Facet filter on one column."""
    return df.where(facet_predicate(column, value, collation))


def sort_keys(column: str, collation: str | None = None) -> tuple[Column, Column, Column]:
    """T3 keys of a display cell: (is_text, number, lower text, or the text under a collation).

    The currency prefix and thousands separators are dropped first, so money
    text sorts by amount; anything that is not a number sorts after all numbers,
    by lower-case text.
    """
    raw = F.trim(F.replace(F.replace(X.null_text(F.col(f"`{column}`")), F.lit(X.CURRENCY_PREFIX), F.lit("")),
                           F.lit(","), F.lit("")))
    is_num = raw.rlike(NUMBER_PATTERN) | raw.rlike(INFINITY_PATTERN)
    is_text = F.when(is_num, F.lit(0)).otherwise(F.lit(1))
    num = F.when(is_num, raw.cast("double"))
    txt = F.when(~is_num, F.lower(raw) if collation is None else X.collated(raw, collation))
    return is_text, num, txt


def sort_order(column: str, ascending: bool = True, base_order: Sequence[Column] = (),
               mode: str = "display", collation: str | None = None) -> list[Column]:
    """T3/T4 sort columns: the keys in the chosen direction, then the page's own order
    unflipped (a stable sort keeps the page order among equal keys).

    ``mode="display"`` applies the mixed number/text rule to the cell text (so
    ``dd Mon yyyy`` dates sort as text, as on screen); ``mode="typed"`` sorts the
    column's own values (real dates, amounts; text under the ``collation``).
    """
    if mode == "typed":
        c = X.collated(F.col(f"`{column}`"), collation)
        keys = [c.asc_nulls_first() if ascending else c.desc_nulls_last()]
    else:
        keys = [k.asc() if ascending else k.desc() for k in sort_keys(column, collation)]
    return keys + list(base_order)


def typed_sort(df: DataFrame, column: str, ascending: bool = True,
               base_order: Sequence[Column] = (), mode: str = "display", collation: str | None = None) -> DataFrame:
    """Distributed (range-partitioned) sort of one column, see :func:`sort_order`.

    Without a ``base_order`` equal cells are ordered by all columns, so a value that many rows
    share is spread over sort partitions and the order is the same in every run.
    """
    ties = list(base_order) or [F.col(f"`{c}`") for c in df.columns]
    return df.orderBy(*sort_order(column, ascending, ties, mode, collation))


def toggle(current_column: int | None, current_reverse: bool, clicked: int) -> tuple[int, bool]:
    """T4: clicking the sorted column flips the direction; another column sorts ascending."""
    if current_column == clicked:
        return clicked, not current_reverse
    return clicked, False


def table_view(df: DataFrame, term: str | None = None, facet_on: tuple[str, str] | None = None,
               sort_on: tuple[str, bool] | None = None, base_order: Sequence[Column] = (),
               collation: str | None = None) -> DataFrame:
    """T5: search, then facet, then sort, as one lazy plan; facet and sort under the ``collation``."""
    out = search(df, term)
    if facet_on is not None:
        out = facet(out, *facet_on, collation=collation)
    if sort_on is not None:
        out = typed_sort(out, sort_on[0], sort_on[1], base_order, collation=collation)
    return out


def visible_counts(df: DataFrame, term: str | None = None,
                   facet_on: tuple[str, str] | None = None) -> DataFrame:
    """Visible and total row counts in one aggregate pass, with the label text."""
    pred = search_predicate(df, term)
    if facet_on is not None:
        pred = pred & facet_predicate(*facet_on)
    counts = df.agg(F.count_if(pred).alias("visible"), F.count(F.lit(1)).alias("total"))
    label = F.concat(X.thousands("visible"), F.lit(" of "), X.thousands("total"), F.lit(" records"))
    return counts.select("visible", "total", label.alias("label"))


def with_headings(df: DataFrame, headings: Sequence[str]) -> DataFrame:
    """Positional columns renamed to display headings."""
    return df.toDF(*headings)


#: Rows of a sort partition where the number of rows is known: a task's memory doesn't grow with the table.
RANGE_ROWS = 1_000_000


def _sorted(df: DataFrame, order: Sequence[Column], rows: int | None) -> DataFrame:
    """``df`` in a global order; tables of more rows than the session's partitions should take get partitions by their rows."""
    if rows is None or rows <= RANGE_ROWS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.orderBy(*order)
    return df.repartitionByRange(-(-rows // RANGE_ROWS), *order).sortWithinPartitions(*order)


def positions(df: DataFrame, order: Sequence[Column], name: str = "position", rows: int | None = None) -> DataFrame:
    """Dense 1-based positions in a global sort order, without a single-partition window.

    The rows are range-sorted and each row records its sort partition and its
    index inside that partition (``monotonically_increasing_id``); this is written
    once as Parquet under ``spark.checkpoint.dir``, which cuts the lineage and makes
    both values stable however the files are read back.  A row's position is the
    count of rows in earlier partitions (one small row per partition)
    plus its index in its own partition.  ``rows`` is their number, where it is known.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "positions")
    (_sorted(df, order, rows)
     .withColumn("_pid", F.spark_partition_id())
     .withColumn("_local", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
     .write.parquet(path))
    ranked = spark.read.parquet(path)
    per_part = ranked.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = per_part.select(
        "_pid", (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    # one row per sort partition: broadcast, else all ranked rows would be shuffled to meet them
    out = ranked.join(F.broadcast(offsets), "_pid")
    return (out.withColumn(name, F.coalesce(F.col("_off"), F.lit(0)) + F.col("_local") + 1)
            .drop("_pid", "_local", "_off"))


def sort_pairs(column: str, ascending: bool = True, base_order: Sequence[tuple[Column, bool]] = (),
               collation: str | None = None) -> list[tuple[Column, bool]]:
    """T3/T4 as (column, ascending) pairs: the display keys in the chosen direction, then the page's own order."""
    return [(k, ascending) for k in sort_keys(column, collation)] + list(base_order)


def _precedes(keys: Sequence[tuple[Column, bool]], values: Sequence[Column]) -> Column:
    """Does a row stand before the key values?  Nulls first ascending, last descending, as Spark sorts."""
    out = F.lit(False)
    for (key, up), value in reversed(list(zip(keys, values))):
        null_before = (key.isNull() & value.isNotNull()) if up else (key.isNotNull() & value.isNull())
        before = F.coalesce(key < value if up else key > value, F.lit(False))
        out = null_before | before | (key.eqNullSafe(value) & out)
    return out


#: Splitters of a pass, rows sampled for them, and the size of a range that is simply sorted.
SPLITTERS, SAMPLED, SORTED_ROWS = 32, 4_000, 50_000


def page(df: DataFrame, order: Sequence[tuple[Column, bool]], first: int, last: int, name: str = "position") -> DataFrame:
    """Rows at the 1-based positions ``first`` to ``last`` of a sort by (column, ascending) pairs, numbered.

    Distributed selection: splitters are sampled from the rows, one aggregation counts the rows before each of them
    (a few numbers a task, no shuffle of rows), and only the range between the two splitters around the page goes on;
    this repeats until a range is small.  Only its rows are sorted and numbered.  The rows are written once, with their
    keys, so that the passes read columns and don't compute the listing again.  The order has to be
    total (end it with a unique key); where rows tie on all of it and can't be split, they are sorted whole.
    """
    keyed = stored(df.withColumns({f"_order{i}": key for i, (key, _) in enumerate(order)}), "page")
    names = [f"_order{i}" for i in range(len(order))]
    keys = [(F.col(n), up) for n, (_, up) in zip(names, order)]
    sort = [c.asc() if up else c.desc() for c, up in keys]
    here, rows, before = keyed, keyed.count(), 0
    while rows > SORTED_ROWS and first <= before + rows:
        share = min(1.0, SAMPLED / rows)
        sampled = here.select(*names).sample(fraction=share, seed=rows).orderBy(*sort).collect()
        picked = sampled[:: max(1, len(sampled) // SPLITTERS)]
        splitters = [[F.lit(v).cast(here.schema[n].dataType) for n, v in zip(names, r)] for r in picked]
        if not splitters:
            break
        counts = here.agg(*[F.count_if(_precedes(keys, s)).alias(f"n{i}") for i, s in enumerate(splitters)]).first()
        low = max((i for i, n in enumerate(counts) if before + n < first), default=None)
        high = min((i for i, n in enumerate(counts) if before + n >= last), default=None)
        start, end = (0 if low is None else counts[low]), (rows if high is None else counts[high])
        if end - start == rows:
            break
        if low is not None:
            here = here.where(~_precedes(keys, splitters[low]))
        if high is not None:
            here = here.where(_precedes(keys, splitters[high]))
        before, rows = before + start, end - start
    ranked = positions(here, sort, name).withColumn(name, F.col(name) + before)
    return ranked.where(F.col(name).between(first, last)).drop(*names)

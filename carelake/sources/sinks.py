"""Sinks: CSV export of visible rows (S5/T7) and table snapshots.

Both write through the DataFrame writer, so executors write their partitions in
parallel; nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X

# CSV dialect of the export (comma, double-quote doubling, CRLF rows,
# cells written as-is, empty text written empty).
CSV_OPTIONS = {
    "header": "true",
    "sep": ",",
    "quote": '"',
    "escape": '"',
    "lineSep": "\r\n",
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def export_csv(df: DataFrame, path: str, headings: Sequence[str] | None = None,
               single_file: bool = False, mode: str = "errorifexists") -> bool:
    """Write the visible rows as CSV with display headings.

    Cells are display text (``-`` for NULL).  Returns False and writes nothing
    when there are no rows.  ``single_file`` funnels the rows through one task
    and is only meant for small exports; the default writes one file per partition.
    """
    if df.isEmpty():
        return False
    names = list(headings) if headings is not None else df.columns
    out = df.select(*[X.null_text(F.col(f"`{c}`")).alias(h) for c, h in zip(df.columns, names)])
    if single_file:
        out = out.coalesce(1)
    out.write.mode(mode).options(**CSV_OPTIONS).csv(path)
    return True


def csv_line(cells: Sequence[Column]) -> Column:
    """One line of the export's dialect: a cell is quoted where it holds a comma, a quote or a line break, quotes doubled."""
    def cell(c: Column) -> Column:
        return F.when(c.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)

    if len(cells) == 1:  # a line with one empty cell would be an empty line
        return F.when(cells[0] == "", F.lit('""')).otherwise(cell(cells[0]))
    return F.concat_ws(",", *[cell(c) for c in cells])


def export_ordered_csv(df: DataFrame, path: str, order: Sequence[tuple[Column, bool]], headings: Sequence[str] | None = None,
                       mode: str = "errorifexists") -> bool:
    """S5/T7 in many parts: the visible rows in ``order`` ((column, ascending) pairs), in files that make the one file of a single
    writer when they are joined by name; the headings stand in the first only.

    The rows are range-partitioned by the order, so every executor writes its part of the file and none
    is funnelled through one task.  Returns False and writes nothing when there are no rows.
    """
    if df.isEmpty():
        return False
    names = list(headings) if headings is not None else df.columns
    lines = df.select(F.lit(1).alias("_row"), csv_line([X.null_text(F.col(f"`{c}`")) for c in df.columns]).alias("_line"),
                      *[c.alias(f"_key{i}") for i, (c, _) in enumerate(order)])
    head = df.sparkSession.range(1).select(
        F.lit(0).alias("_row"), csv_line([F.lit(h) for h in names]).alias("_line"),
        *[F.lit(None).cast(lines.schema[f"_key{i}"].dataType).alias(f"_key{i}") for i in range(len(order))])
    keys = [F.col(f"_key{i}").asc() if up else F.col(f"_key{i}").desc() for i, (_, up) in enumerate(order)]
    whole = head.unionByName(lines).orderBy("_row", *keys)
    whole.select("_line").write.mode(mode).option("lineSep", "\r\n").text(path)
    return True


def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> str:
    """S7 for tables that are joined on one key again and again: a snapshot in ``buckets`` files by the hash of
    ``key``, sorted by it, at a fresh ``path`` and named ``table`` in the session's catalog.

    Joins and aggregations on ``key`` between tables of the same number of buckets then need no shuffle.
    Rows are dealt to their bucket before they are written, so there is one file a bucket.  Take at least as many
    buckets as shuffle partitions: a join with more partitions than buckets would shuffle the table again.
    """
    dealt = df.repartition(buckets, key)
    dealt.write.mode("errorifexists").format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return table


def write_snapshot(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Write a changed table as a new Parquet snapshot at a fresh ``path``.

    The caller then points readers at ``path``; the snapshot being read is never
    overwritten in place.  Large facts can be partitioned (e.g. by month).
    """
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path

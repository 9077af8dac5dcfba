"""Declared integrity as whole-table check jobs (K1-K5).

Each check is one job over the tables it needs and returns a small report DataFrame with one
row per table / edge / column, so an empty problem list is still a visible row
with a zero count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.sinks import write_snapshot
from ..sources.schema import DEFAULTS, DOMAINS, FOREIGN_KEYS, PRIMARY_KEYS, TABLES, not_null_columns
from ..sources.tables import Tables


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def primary_key_violations(t: Tables) -> DataFrame:
    """K1: per table, keys that occur more than once and NULL keys.

    Keys are counted with a partial (map-side) aggregate, so a hot duplicate key
    is reduced before the shuffle.
    """
    parts = []
    for name in TABLES:
        key = PRIMARY_KEYS[name]
        per_key = t[name].groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        parts.append(per_key.agg(
            F.lit(name).alias("table_name"), F.lit(key).alias("key_column"),
            F.count_if(F.col(key).isNotNull() & (F.col("n") > 1)).alias("duplicate_keys"),
            F.coalesce(F.sum(F.when(F.col(key).isNotNull() & (F.col("n") > 1), F.col("n"))), F.lit(0))
            .cast("long").alias("duplicate_rows"),
            F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).cast("long").alias("null_keys")))
    return _union(parts)


def orphans(t: Tables, child: str, fk: str, parent: str) -> DataFrame:
    """Rows of ``child`` whose ``fk`` has no row in ``parent`` (anti join)."""
    pk = PRIMARY_KEYS[parent]
    keys = t[parent].select(F.col(pk).alias(fk))
    return t[child].join(keys, fk, "left_anti")


def edges_of(parent: str) -> list[tuple[str, str]]:
    """(child table, child column) of the foreign keys that point at ``parent``, in declared order."""
    return [(c, fk) for c, fk, p in FOREIGN_KEYS if p == parent]


MOST_EDGES = max(len(edges_of(p)) for p in TABLES)


def key_audit(t: Tables) -> DataFrame:
    """Every key value of every parent with its uses: parent_table, key, parent_rows, refs_1, refs_2.

    Each table is scanned once and gives a tagged row per key column; one aggregation over
    the union counts the roles of a key, reduced before the one shuffle, so a parent that a third of all rows
    name is one row per task.  ``refs_i`` counts the rows of the parent's i-th edge (``edges_of``).  Until the keys are
    counted a parent goes by its number, so that a task's table of keys holds no names.
    """
    parts = []
    for name in TABLES:
        uses = [(name, PRIMARY_KEYS[name], 0)]
        uses += [(p, fk, edges_of(p).index((c, fk)) + 1) for c, fk, p in FOREIGN_KEYS if c == name]
        tagged = [F.struct(F.lit(TABLES.index(p)).cast("byte").alias("_parent"), F.col(c).cast("long").alias("key"), F.lit(role).alias("role")) for p, c, role in uses]
        parts.append(t[name].select(F.inline(F.array(*tagged))))
    refs = [F.count_if(F.col("role") == i + 1).alias(f"refs_{i + 1}") for i in range(MOST_EDGES)]
    audit = _union(parts).groupBy("_parent", "key").agg(F.count_if(F.col("role") == 0).alias("parent_rows"), *refs)
    named = F.element_at(F.array(*[F.lit(name) for name in TABLES]), F.col("_parent") + 1).alias("parent_table")
    return audit.select(named, "key", "parent_rows", *[f"refs_{i + 1}" for i in range(MOST_EDGES)])


def orphan_keys(t: Tables) -> DataFrame:
    """The key values that child rows name but no parent row has (NULL too): one row per edge and value, with its rows."""
    lost = key_audit(t).where(F.col("key").isNull() | (F.col("parent_rows") == 0))
    edges = [F.when(F.col("parent_table") == p, F.struct(F.lit(c).alias("child_table"), F.lit(fk).alias("child_column"),
                                                         F.col(f"refs_{edges_of(p).index((c, fk)) + 1}").alias("orphan_rows")))
             for c, fk, p in FOREIGN_KEYS]
    return lost.select("parent_table", "key", F.inline(F.array_compact(F.array(*edges)))).where("orphan_rows > 0").select(
        "child_table", "child_column", "parent_table", "key", "orphan_rows")


def foreign_key_orphans(t: Tables) -> DataFrame:
    """K2: orphan row count for each of the declared foreign-key edges (a NULL reference counts), from one audit of all keys."""
    lost = F.col("key").isNull() | (F.col("parent_rows") == 0)
    sums = [F.coalesce(F.sum(F.when(lost & (F.col("parent_table") == p), F.col(f"refs_{edges_of(p).index((c, fk)) + 1}"))), F.lit(0)).alias(f"n{i}")
            for i, (c, fk, p) in enumerate(FOREIGN_KEYS)]
    rows = ", ".join(f"'{c}', '{fk}', '{p}', n{i}" for i, (c, fk, p) in enumerate(FOREIGN_KEYS))
    return key_audit(t).agg(*sums).select(F.expr(
        f"stack({len(FOREIGN_KEYS)}, {rows}) AS (child_table, child_column, parent_table, orphan_rows)"))


def null_violations(t: Tables) -> DataFrame:
    """K3: NULL count of every NOT NULL column, one aggregate pass per table."""
    parts = []
    for name in TABLES:
        cols = not_null_columns(name)
        wide = t[name].agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
        stack = F.expr("stack({n}, {args}) AS (column_name, null_rows)".format(
            n=len(cols), args=", ".join(f"'{c}', `{c}`" for c in cols)))
        parts.append(wide.select(F.lit(name).alias("table_name"), stack))
    return _union(parts)


def domain_violations(t: Tables) -> DataFrame:
    """K4: rows whose ENUM column holds a value outside its domain (NULL counts separately in K3)."""
    parts = []
    for (name, col), values in DOMAINS.items():
        c = F.col(col)
        parts.append(t[name].agg(
            F.lit(name).alias("table_name"), F.lit(col).alias("column_name"),
            F.count_if(c.isNotNull() & ~c.isin(*values)).alias("bad_rows")))
    return _union(parts)


def write_checked(df: DataFrame, table: str, path: str, partition_by: tuple[str, ...] = ()) -> dict[str, int]:
    """S7 with K3 and K4 in the same pass: writes the snapshot of ``table`` and counts, while its rows go by,
    all rows, NULLs of NOT NULL columns and values outside their domains.

    Returns ``rows``, ``null:<column>`` and ``domain:<column>`` counts; a caller that finds one above 0 doesn't
    switch its readers to the new path.  The rows are read once.
    """
    counts = {"rows": F.count(F.lit(1))}
    counts |= {f"null:{c}": F.count_if(F.col(c).isNull()) for c in not_null_columns(table)}
    counts |= {f"domain:{c}": F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*values)) for (name, c), values in DOMAINS.items() if name == table}
    seen = Observation()
    write_snapshot(df.observe(seen, *[e.alias(name) for name, e in counts.items()]), path, partition_by)
    return {name: int(n) for name, n in seen.get.items()}


def write_checked_tables(t: Tables, path: str) -> DataFrame:
    """All tables as snapshots under ``path``, with a report of what was counted on the way: table, column, rule, bad rows."""
    found = [(name, *measure.split(":")[::-1], n) for name in TABLES
             for measure, n in write_checked(t[name], name, f"{path}/{name}").items() if measure != "rows"]
    return next(iter(t.values())).sparkSession.createDataFrame(found, "table_name string, column_name string, rule string, bad_rows long")


def with_defaults(df: DataFrame, table: str, as_of: str | None = None) -> DataFrame:
    """K5: fill NULL cells of ``table`` with the declared defaults.

    ``as_of`` pins the date default (``registration_date``); without it the
    session's current date is used.
    """
    fills = {}
    for (name, col), value in DEFAULTS.items():
        if name != table or col not in df.columns:
            continue
        if value == "CURRENT_DATE":
            fills[col] = F.lit(as_of).cast("date") if as_of else F.current_date()
        else:
            fills[col] = F.lit(value).cast(df.schema[col].dataType)
    return df.select(*[F.coalesce(F.col(c), fills[c]).alias(c) if c in fills else F.col(c)
                       for c in df.columns])

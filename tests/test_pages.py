"""Pages by position and ordered exports, against a whole sort and Python's csv writer."""

import csv
import datetime as dt
import io
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from carelake.operators import tableview as TV
from carelake.sources.sinks import export_csv, export_ordered_csv
from test_scale import conf


def rows(n=6000):
    r = random.Random(4)
    days = [None, *(dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(9))]
    return [(i, r.choice(days), r.choice([None, Decimal("1.50"), Decimal(r.randrange(500))]), r.choice(["a", "B", None, "c"])) for i in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), "id long, day date, amount decimal(10,2), word string").repartition(5)


ORDERS = {
    "up": [("day", True), ("id", True)], "down": [("day", False), ("id", False)],
    "mixed": [("amount", False), ("word", True), ("day", False), ("id", True)], "unique": [("id", False)],
}


@pytest.mark.parametrize("order", sorted(ORDERS))
@pytest.mark.parametrize("first, last", [(1, 20), (2981, 3000), (5990, 6000), (5995, 7000), (7001, 7020)])
def test_page_equals_positions(spark, monkeypatch, table, order, first, last):
    """Ranges of many rows are narrowed by splitters several times."""
    monkeypatch.setattr(TV, "SPLITTERS", 4)
    monkeypatch.setattr(TV, "SAMPLED", 60)
    monkeypatch.setattr(TV, "SORTED_ROWS", 50)
    written = []
    whole = TV.positions
    monkeypatch.setattr(TV, "positions", lambda df, *a, **k: written.append(df.count()) or whole(df, *a, **k))
    keys = [(F.col(c), up) for c, up in ORDERS[order]]
    got = sorted(TV.page(table, keys, first, last).collect(), key=lambda r: r.position)

    def key(r):
        return [((v is not None), v if v is not None else 0) for v in (r[["id", "day", "amount", "word"].index(c)] for c, _ in ORDERS[order])]

    want = rows()
    for i, (c, up) in reversed(list(enumerate(ORDERS[order]))):
        want.sort(key=lambda r, i=i: (key(r)[i][0], key(r)[i][1]), reverse=not up)
    want = [(*r, p + 1) for p, r in enumerate(want)][first - 1: last]
    assert [tuple(r) for r in got] == want
    if first <= 6000:
        assert sum(written) < 1500  # few of the rows are sorted, numbered and written


def test_rows_that_tie_on_the_whole_order(spark, monkeypatch):
    monkeypatch.setattr(TV, "SORTED_ROWS", 50)
    same = spark.range(0, 500).select(F.lit(7).alias("k"))
    assert sorted(r.position for r in TV.page(same, [(F.col("k"), True)], 11, 30).collect()) == list(range(11, 31))
    assert TV.page(same.where("false"), [(F.col("k"), True)], 1, 20).count() == 0


CELLS = ["plain", "a,b", 'say "hi"', "two\nlines", "cr\r\nlf", "", " blank ", "back\\slash", "é, ü", None, "-", '"', ","]


def joined(path) -> bytes:
    return b"".join(p.read_bytes() for p in sorted(path.glob("part-*")))


@pytest.mark.parametrize("columns", [1, 3])
def test_parts_make_the_one_file(spark, tmp_path, columns):
    r = random.Random(8)
    data = [(i, *(r.choice(CELLS) for _ in range(columns - 1))) if columns > 1 else (CELLS[i % len(CELLS)],) for i in range(3000)]
    names = ["id", "b", "c"][:columns] if columns > 1 else ["only"]
    schema = "id long, b string, c string" if columns > 1 else "only string"
    df = spark.createDataFrame(data, schema).repartition(7)
    order = [(F.col(names[0]), False)]
    with conf(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        assert export_ordered_csv(df, str(tmp_path / "out"), order, [f"H, {n}" for n in names])
    out = io.StringIO()
    writer = csv.writer(out)
    writer.writerow([f"H, {n}" for n in names])
    want = sorted(data, reverse=True) if columns > 1 else sorted(data, key=lambda x: (x[0] is not None, (x[0] or "").encode()), reverse=True)
    writer.writerows([["-" if v is None else v for v in row] for row in want])
    assert joined(tmp_path / "out") == out.getvalue().encode()
    parts = list((tmp_path / "out").glob("part-*"))
    assert len(parts) > 3 and sum(b"H, " in p.read_bytes() for p in parts) == 1


def test_nothing_to_export(spark, tmp_path):
    df = spark.createDataFrame([], "a string")
    assert not export_ordered_csv(df, str(tmp_path / "none"), [(F.col("a"), True)])
    assert not export_csv(df, str(tmp_path / "none")) and not (tmp_path / "none").exists()

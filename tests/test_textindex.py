"""The substring index gives what the scan gives."""

import time

import pytest

from carelake.operators import tableview as TV
from carelake.operators import textindex as TX

TERMS = ["john", "50%", "a_b", "%%", "smith john", "o 1", "- x", "İst", "é𝄞z", "nothing like it", "  ANNA ", "ab", "", None, "###", "name7 "]


@pytest.fixture(scope="module")
def listing(spark):
    names = ["John", "Anna", None, "a_b", "50% off", "", "Istanbul İst", "é𝄞z", "%%", "Smith"]
    rows = [(i, names[i % 10] if i % 97 else "Mid Smith", names[(i * 7) % 10], f"name{i // 40}") for i in range(2000)]
    return spark.createDataFrame(rows, "id long, first string, last string, note string").repartitionByRange(3, "id")


@pytest.mark.parametrize("columns", [None, ["first", "last"]])
def test_equals_the_scan(spark, listing, tmp_path, monkeypatch, columns):
    monkeypatch.setattr(TX, "BLOCK_ROWS", 32)
    monkeypatch.setattr(TX, "CHUNK", 8)
    index = TX.TextIndex.build(listing, str(tmp_path / "index"), columns)
    assert index.blocks >= 2000 // 32
    for few in (TX.FEW_BLOCKS, 2):
        monkeypatch.setattr(TX, "FEW_BLOCKS", few)
        for term in TERMS:
            found = index.search(term)
            want = TV.search(listing, term, columns)
            assert sorted(map(repr, found.rows.collect())) == sorted(map(repr, want.collect())), term
    monkeypatch.undo()
    assert TX.TextIndex.load(spark, str(tmp_path / "index"), columns).search("john").rows.columns == listing.columns


def test_reads_the_blocks_that_can_hold_the_term(spark, listing, tmp_path, monkeypatch):
    monkeypatch.setattr(TX, "BLOCK_ROWS", 32)
    index = TX.TextIndex.build(listing, str(tmp_path / "index"))
    rare, absent, short = index.search("name37"), index.search("qqq"), index.search("na")
    assert 0 < rare.read < index.blocks // 4 and rare.rows.count() == 40
    assert (absent.read, absent.rows.count()) == (0, 0)
    assert short.read == index.blocks
    scan = rare.rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in scan or "PushedFilters: [And(" in scan or "GreaterThanOrEqual(_block" in scan


def test_ranges():
    assert "false" in str(TX._within([])).lower()


def test_empty_listing(spark, listing, tmp_path):
    index = TX.TextIndex.build(listing.limit(0), str(tmp_path / "index"))
    assert index.blocks == 0 and index.search("john").rows.count() == 0 and index.search("").rows.count() == 0


def test_lists_of_many_blocks(spark):
    rows = [((1 << 23 if i % 3 else 0) + i // 4, f"Wort{i % 89}", "é𝄞z" if i % 50 == 0 else None) for i in range(1200)]
    want = {}
    for block, a, b in rows:
        text = f"{a} {b or '-'}".lower()
        for i in range(len(text) - 2):
            want.setdefault(text[i: i + 3], set()).add(block)
    lists = TX._lists(spark.createDataFrame(rows, "_block long, a string, b string"), ["a", "b"]).collect()
    assert len({(r.gram, r.chunk) for r in lists}) == len(lists) and all(b // TX.CHUNK == r.chunk for r in lists for b in r.blocks)
    got = {}
    for r in lists:
        assert len(set(r.blocks)) == len(r.blocks) <= TX.CHUNK
        got.setdefault(r.gram, set()).update(r.blocks)
    assert {g: b for g, b in got.items() if "\n" not in g} == want


def test_a_long_cell_is_cut_in_one_pass(spark):
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(600_000))
    began = time.monotonic()
    got = spark.createDataFrame([(0, text)], "_block long, a string")
    assert {r.gram for r in TX._lists(got, ["a"]).collect()} == {text[i: i + 3] for i in range(len(text) - 2)}
    assert time.monotonic() - began < 20

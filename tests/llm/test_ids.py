"""Ids beyond 2**53 beside null and repeated ones, through every operator that reads in Python."""

import time
import zlib

import pytest
from pyspark.sql import functions as F

from carelake.llm import html, jaccard, lm, packing, pieces, repeats

A, B = (1 << 60) + 1, (1 << 60) + 3
IDS = sorted([None, None, A, B, B], key=repr)


@pytest.fixture(scope="module")
def docs(sp):
    long = " ".join(f"word{i}" for i in range(200))
    rows = [(A, long, A), (B, long + " end", None), (None, None, B), (B, "", 3), (None, "one two three four five six", 5)]
    return sp.createDataFrame(rows, "doc_id long, text string, n_chars long").coalesce(1)


def ids_of(df, name="doc_id"):
    return sorted([r[name] for r in df.select(name).collect()], key=repr)


def test_pieces(docs):
    encoded = pieces.encode(docs)
    assert ids_of(encoded) == ids_of(pieces.decode(encoded)) == IDS
    got = pieces.round_trip(docs)
    assert ids_of(got) == IDS and sorted((r["doc_id"], r["text"]) for r in got.where("doc_id is not null").collect())[0][0] == A


def test_repeats(docs):
    got = repeats.remove_repeats(docs, 400)
    assert ids_of(got) == IDS and all(r["n_kept"] == r["n_bytes"] - r["n_removed"] == len(r["kept"]) for r in got.collect())
    kept = repeats.without_repeats(docs, 400)
    assert ids_of(kept) == IDS and kept.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert sorted(r["n_chars"] for r in kept.where("doc_id is null or text = ''").collect() if r["n_chars"] is not None)[-1] == B


def test_packing(docs):
    got = packing.pack(docs, 64)
    assert sorted({r["doc_id"] for r in got.collect()}, key=repr) == sorted({None, A, B}, key=repr)
    # pieces of one id and length don't meet in one bucket
    many = docs.sparkSession.range(0, 4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    rows = packing.pack(many, 64).collect()
    places = {(r["sequence_id"], r["offset"]) for r in rows}
    assert len(places) == len(rows) == 4000
    cut = packing.tokenise(many, 64, packing.tokenizer_path())
    assert cut.select(F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", "nth"), F.lit(32)).alias("b")).groupBy("b").count().agg(F.max("count")).first()[0] < 400


def test_pages(sp):
    rows = [(A, "u", "<article><p>x y</p></article>"), (B, "u", ""), (None, "u", None), (B, None, "<p>z")]
    assert ids_of(html.extract(sp.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)), "page_id") == sorted([A, B, B, None], key=repr)


def test_lm_and_jaccard(docs):
    assert ids_of(lm.score(docs)) == IDS
    got = jaccard.jaccard_components(docs)
    assert ids_of(got) == IDS
    assert {r["component_id"] for r in got.where(F.col("doc_id") >= A).where("n_shingles > 0").collect()} == {A}


def test_many_equal_rows(sp):
    """20,000 equal rows, and as many with null ids: linear, and all of their bytes repeat."""
    text = " ".join(f"{zlib.crc32(str(i).encode()):x}" for i in range(120))
    rows = sp.range(0, 40_000).select(F.when(F.col("id") % 2 == 0, 7).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    began = time.time()
    got = repeats.remove_repeats(rows, 400).groupBy("n_bytes", "n_removed", "n_spans").count().collect()
    assert [tuple(r) for r in got] == [(len(text), len(text), 1, 40_000)] and time.time() - began < 60

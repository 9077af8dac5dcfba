"""Exact dedup against a dictionary of whole texts."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from carelake.llm import exact

SCHEMA = "doc_id long, text string, digest string, row long, salt int, keep_id int"


def rows_of(seed=5):
    r = random.Random(seed)
    texts = [None, "", " ", "\t\n", "a b", "a  b", "a b", "a b ", " a b", "A b", "é\x0bx", "é x", "x" * 300_000, "x " * 200_000]
    rows = [(i, r.choice(texts)) for i in range(400)] + [(1000 + i, "hot copy") for i in range(300)]
    rows += [((1 << 60) + 1, "wide"), ((1 << 60) + 3, "wide"), (None, "wide"), (None, "no id"), (None, "no id"),
             (7, "repeated"), (7, "repeated"), (7, "repeated"), (7, "unlike"), (-5, "repeated")]
    r.shuffle(rows)
    return rows


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        at = ids.index(keep)
        out += [(i, keep, len(ids), k == at, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("digest", [exact.sha256, lambda t: F.substring(t, 1, 1), lambda t: F.when(F.length(t) < 5, "same").otherwise(t)])
def test_against_whole_texts(sp, digest):
    """Also with digests that several texts share: whole texts decide."""
    rows = rows_of()
    df = sp.createDataFrame([(i, t, "d", 1, 2, 3) for i, t in rows], SCHEMA).repartition(7)
    got = exact.exact_dedup(df, digest=digest)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(rows)


def test_rows_that_stay(sp):
    rows = rows_of(6)
    df = sp.createDataFrame([(i, t, "d", 1, 2, 3) for i, t in rows], SCHEMA)
    got = exact.without_copies(df)
    assert got.columns == df.columns
    want = sorted(repr((x[0], x[4])) for x in expected(rows) if x[3])
    assert sorted(repr((r["doc_id"], hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "").encode()).hexdigest())) for r in got.collect()) == want


def test_empty_table_and_native_plan(sp):
    df = sp.createDataFrame([(1, "x")], "doc_id long, text string")
    assert exact.exact_dedup(df.where("false")).count() == 0
    plan = exact.exact_dedup(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan

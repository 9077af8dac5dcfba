"""Ranked lexical search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from carelake.llm import lexical, queries
from oracle_compare import compare, duck

SF_SMALL = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, item_id int, bound int, n int, score int"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items, k):
    docs = [(i, Counter(terms(t))) for i, t in docs]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    joined = {}
    for i, t in sorted(set(items), key=repr):
        joined.setdefault(i, []).extend(terms(t))
    out = []
    for item, words in joined.items():
        scored = []
        for i, c, n in docs:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 12 * m)) for w in words)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def texts(seed, n):
    r = random.Random(seed)
    words = [f"{c}{i}" for i in range(30) for c in "abÉñ"]
    some = lambda k: r.choice([" ", "-", "\n"]).join(r.choice(words[: r.choice([5, 40, 120])]) for _ in range(k))
    docs = [(i, some(r.choice([1, 3, 30, 200]))) for i in range(n)]
    docs += [(n + i, "Hot copy of a1 and b2") for i in range(150)] + [(n + 200, None), (n + 201, ""), (n + 202, "., !"), (n + 203, "a1 " * 400_000 + "é" * 70_000)]
    docs += [((1 << 60) + 1, "wide a1"), ((1 << 60) + 3, "wide a1"), (None, "wide a1"), (None, "wide a1"), (4, "A1 a1 again"), (4, "A1 a1 again")]
    r.shuffle(docs)
    items = [(i, some(r.randint(1, 40))) for i in range(25)] + [(30, None), (31, "zzz"), (32, "copy HOT"), (33, "wide"), (33, "again"), (33, "again"), (34, "é" * 70_000)]
    return docs, items


@pytest.mark.parametrize("case", ["plain", "deep", "blocks"])
def test_against_all_documents(sp, monkeypatch, case):
    """Also where every task leaves documents out, and over many blocks."""
    if case == "deep":
        monkeypatch.setattr(lexical, "KEPT", 3)
        monkeypatch.setattr(lexical, "FIRST", 5)
    if case == "blocks":
        for name, value in (("BLOCK_ITEMS", 7), ("ROWS", 16)):
            monkeypatch.setattr(lexical, name, value)
    docs, items = texts(3, 400)
    df = sp.createDataFrame([(*r, 1, 2, 3, 4) for r in docs], SCHEMA).repartition(3)
    got = lexical.search(df, sp.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int"), 10)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(docs, items, 10)


def test_terms_of_texts_that_touch():
    t = lexical.Terms()
    one = lambda x: t.of(pa.array([x], pa.string()))[0].tolist()
    for batch in ([None, "ab", "cd", "", "e f", "é", "Ab"], ["x" * 3_000_000, "x"], ["", None], ["a " * 700_000, "b" * 1_100_000 + " c"]):
        whole = t.of(pa.array(["skipped", *batch], pa.string())[1:])
        assert [h.tolist() for h in whole] == [one(x) for x in batch] and [len(h) for h in whole] == [len(terms(x)) for x in batch]
    assert one("ab") == one("AB") != one("ba")


def batch_of(docs):
    return pa.record_batch([pa.array([i for i, _ in docs]), pa.array([x for _, x in docs], pa.string())], names=["doc_id", "text"])


@pytest.mark.parametrize("bits", [48, 60])
def test_bounds_hold(monkeypatch, bits):
    """No bound is below the exact score, also where terms share 16 coordinates; alone they are mostly equal."""
    monkeypatch.setattr(lexical, "coordinate", lambda h: (h >> np.uint64(bits)).astype(np.uint16))
    docs, items = texts(4, 60)
    t = lexical.Terms()
    block = lexical.Block([(i, t.of(pa.array([x]))) for i, x in items[:25]])
    block.weigh({}, 50, 2000)
    hashes = t.of(batch_of(docs).column("text"))
    rows = next(lexical._index(iter([batch_of(docs)])))
    bounds = block.bounds(rows["n"].to_numpy(), rows["coords"].to_pylist(), rows["tfs"].to_pylist())
    exact = np.array([[block.score(i, len(h), *lexical.counted(h)) for i in range(25)] for h in hashes])
    assert (bounds >= exact).all() and ((bounds == exact).mean() > 0.9) == (bits == 48)


def test_document_counts(monkeypatch):
    """In rows of bounded size, each term's counts add up to the documents that hold it."""
    monkeypatch.setattr(lexical, "HELD", 64)
    monkeypatch.setattr(lexical, "TEXT_BLOCK", 100)
    docs, _ = texts(5, 80)
    found, rows = Counter(), 0
    for b in lexical._index(iter([batch_of(docs[:50]), batch_of(docs[50:])])):
        for h, c in zip(b["hashes"].to_pylist(), b["counts"].to_pylist()):
            if h is not None:
                rows += 1
                found.update(dict(zip(np.frombuffer(h, np.uint64).tolist(), np.frombuffer(c, np.int64).tolist())))
    t = lexical.Terms()
    want = Counter(w for _, x in docs for w in set(terms(x)))
    assert rows > 1 and found == {t.of(pa.array([w]))[0].tolist()[0]: n for w, n in want.items()}


def test_empty_tables(sp):
    docs = sp.createDataFrame([(1, "x")], "doc_id long, text string")
    items = sp.createDataFrame([(1, "x")], "item_id long, text string")
    assert lexical.search(docs.where("false"), items).count() == 0
    assert lexical.search(docs, items.where("false")).count() == 0
    assert [tuple(r)[:3] for r in lexical.search(docs, items).collect()] == [(1, 1, 1)]


def test_query_matches_oracle(sp):
    problems, _, _ = compare(sp, duck(SF_SMALL), "op12", queries.op12_lexical_search, lexical.ORACLE_SQL, SF_SMALL)
    assert not problems, problems

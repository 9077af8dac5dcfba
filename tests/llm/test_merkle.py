"""Merkle manifest and proofs against trees folded one by one."""

import hashlib
import random
import zlib

import pytest

from carelake.llm import merkle, queries
from oracle_compare import compare, duck

SF_SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest string, tree int, pos int, part int"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text))


def proof(nodes, at):
    """(top, siblings per level) of the node at a place."""
    siblings = []
    while len(nodes) > 1:
        run = at // 16 * 16
        siblings.append((nodes[run:at], nodes[at + 1: run + 16]))
        nodes, at = [h(nodes[i: i + 16]) for i in range(0, len(nodes), 16)], at // 16
    return nodes[0], siblings


def fold(node, siblings):
    for before, after in siblings:
        node = h([*before, node, *after])
    return node


def expected(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    order = {s: sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]))) for s in names}
    leaves = {s: [leaf(r, r[4]) for r in order[s]] for s in names}
    tops = [proof(leaves[s], 0)[0] for s in names]
    out = []
    for k, s in enumerate(names):
        root, above = proof(tops, k)
        for i, r in enumerate(order[s]):
            subroot, siblings = proof(leaves[s], i)
            changed = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and changed is not None:
                changed = "".join(c.lower() if "A" <= c <= "Z" else c for c in changed)
            path = siblings + above
            folded = fold(leaf(r, changed), path)
            out.append((r[0], leaves[s][i], subroot, root, h(x for b, a in path for x in (*b, *a)), folded, folded == root))
    return sorted(out, key=repr)


def some_rows(seed, sources, n):
    r = random.Random(seed)
    texts = [None, "", "Ab", "ab", "Éa Z", "x" * 50_000, "Long Text " * 30_000]
    rows = [(i, r.choice(sources), r.choice(["en", None]), r.choice([None, 3, -7]), r.choice(texts)) for i in range(n)]
    rows += [((1 << 60) + 1, None, None, None, "A"), ((1 << 60) + 3, None, None, None, "A"), (None, "", "en", 1, "B"), (None, "", "en", 1, "C")]
    rows += [(5, sources[0], "en", 1, "Same")] * 40 + [(5, sources[0], "en", 1, "Other")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("partition, seed, sources, n", [(1 << 13, 1, ["a"], 20), (50, 2, ["hot"] * 8 + ["b", "é", "", None, "B"], 900),
                                                         (37, 3, [f"s{i}" for i in range(300)], 500), (1, 4, ["hot", "hot", "b"], 60)])
def test_against_single_trees(sp, monkeypatch, partition, seed, sources, n):
    """Partitions that cut sources, and that hold many; also with one leaf each."""
    monkeypatch.setattr(merkle, "PARTITION", partition)
    monkeypatch.setattr(merkle, "SORTED", 128)
    rows = some_rows(seed, sources, n)
    df = sp.createDataFrame([(*r, "d", 1, 2, 3) for r in rows], SCHEMA).repartition(5)
    got = merkle.verified_proofs(*merkle.manifest(df, merkle.lowered_fifth(df)))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = sorted((tuple(r) for r in got.collect()), key=repr)
    assert found == expected(rows)
    assert 0 < sum(not r[-1] for r in found) < len(found)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(1, "a", None, None, "X")] * 3, [(i, str(i), "en", 1, "t") for i in range(17)]])
def test_small_tables(sp, rows):
    df = sp.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = merkle.verified_proofs(*merkle.manifest(df, merkle.lowered_fifth(df)))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(rows)


def test_missing_is_least(sp):
    """A partition fetches just what its leaves' proofs hold and its own leaves can't give."""
    r = random.Random(5)
    for _ in range(60):
        n = r.randint(1, 5000)
        a = r.randrange(n)
        b = r.randint(a + 1, n)
        needed, known, first, end, size, level = set(), set(), a, b, n, 0
        while size > 1:
            known |= {(level, p) for p in range(first, end)}
            for p in range(first, end):
                needed |= {(level, q) for q in range(p // 16 * 16, min(p // 16 * 16 + 16, size))}
            first, end, size, level = first // 16, (end - 1) // 16 + 1, (size + 15) // 16, level + 1
        assert sorted(merkle.missing(a, b, n)) == sorted(needed - known)


def test_untampered_tables_verify(sp):
    docs = sp.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert merkle.verified_proofs(*merkle.manifest(docs)).where("not verified").count() == 0


def test_query_matches_oracle(sp):
    problems, _, _ = compare(sp, duck(SF_SMALL), "op13", queries.op13_merkle_manifest, merkle.ORACLE_SQL, SF_SMALL)
    assert not problems, problems

"""Merkle manifest of a dataset: one 16-ary hash tree per source, one over the sources, and proofs.

H is the lowercase hex SHA-256 of its inputs joined; digests go in as hex text.  Leaves are hashed
in the scan, so texts are read once and never shuffled.  The leaves get their place from one
range-partitioned sort (written), the trees are folded level by level with DataFrame functions.

Proofs come from an octopus multiproof per leaf partition (``PARTITION`` leaves that follow each
other, of one or many sources):

1. from its intervals alone a partition computes the union of the node coordinates that the
   proofs of all its leaves need and that it can't derive itself (at most 30 a level and source),
2. these are fetched in one join with the node table,
3. it derives the interiors that its leaves share, then
4. expands the proof of each leaf locally, folds the leaf (the tampered one, if there is one)
   up to the root along it, and compares the result with the manifest's root.

Defined cases: a null value is hashed as ``-``; null ids come first within a source; rows that tie
on the id are ordered by their leaf digest, so repeated rows are leaves next to each other; the null
source is a source of its own; a run of one node is hashed again, like any run; a lone leaf is
its source's subroot; an empty table has no leaf; texts of any length are hashed whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import pick, written

FAN = 16
PARTITION = 1 << 13
#: Rows of a sort partition; the driver holds one count for each of these.
SORTED = 1 << 17
#: Tree names: '=' and the source; the null source sorts before them, the tree over the sources is apart.
NULL_SOURCE, TOP = "", "top"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _field(c: Column) -> Column:
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    parts = F.concat(*[_field(c) for c in (doc_id, source, lang, n_chars, text)])
    return F.sha2(parts.cast("binary"), 256)


def digest_of(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def _ordered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``place``, their 0-based rank in ``order``; written, ties split by the scan's order."""
    spark = rows.sparkSession
    count = rows.count()
    parts = max(-(-count // SORTED), min(spark.sparkContext.defaultParallelism, -(-count // PARTITION)), 1)
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    sort = [F.col(c).asc_nulls_first() for c in [*order, "_tie"]]
    placed = written(tied.repartitionByRange(parts, *sort).sortWithinPartitions(*sort).drop("_tie")
                     .withColumn("_id", F.monotonically_increasing_id()), name)
    part = F.shiftrightunsigned("_id", 33).cast("int")
    sizes = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        starts.append((p, total))
        total += sizes.get(p, 0)
    # one row per sort partition
    offsets = spark.createDataFrame(starts, "_part int, _start long")
    found = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return found.withColumn("place", F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_part", "_start")


def trees(leaves: DataFrame) -> list[DataFrame]:
    """All levels above (tree, pos, n, digest), written: element k holds the nodes of level k+1.

    ``n`` is the number of nodes of the tree at that level; a tree ends at n = 1.
    """
    levels, now = [], leaves.select("tree", "pos", "n", "digest")
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        runs = now.where("n > 1").groupBy("tree", F.expr(f"pos div {FAN}").alias("pos"))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"]), "")
        now = written(runs.agg(F.expr(f"(any_value(n) + {FAN - 1}) div {FAN}").alias("n"), F.sha2(joined.cast("binary"), 256).alias("digest")),
                      "level").select("tree", "pos", "n", "digest")
        levels.append(now)
        most = -(-most // FAN)
    return levels


def ends(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """tree, digest of each tree's last node."""
    out = leaves.where("n = 1").select("tree", "digest")
    for level in levels:
        out = out.unionByName(level.where("n = 1").select("tree", "digest"))
    return out


def missing(first: int, end: int, n: int):
    """(level, pos) that the leaves first to end-1 of a tree of n leaves need and can't derive."""
    level = 0
    while n > 1:
        low, high = first // FAN * FAN, min(-(-end // FAN) * FAN, n)
        for pos in (*range(low, first), *range(end, high)):
            yield level, pos
        first, end, n, level = first // FAN, -(-end // FAN), -(-n // FAN), level + 1


def _requests(f: pd.DataFrame) -> pd.DataFrame:
    """The union over one leaf partition's (tree, first, end, n, top, n_top)."""
    out = [(t, level, pos) for t, a, b, n in zip(f["tree"], f["first"], f["end"], f["n"]) for level, pos in missing(a, b, n)]
    out += [(TOP, level, pos) for level, pos in missing(f["top"].min(), f["top"].max() + 1, f["n_top"].iloc[0])]
    return pd.DataFrame({"part": f["part"].iloc[0], "tree": pd.Series([x[0] for x in out], dtype=object), "level": pd.Series([x[1] for x in out], dtype="int32"),
                         "pos": pd.Series([x[2] for x in out], dtype="int64")})


def _derived(own: list[str], first: int, n: int, fetched: dict) -> list[tuple[int, int, list[str]]]:
    """Per level: its length, where the known nodes begin and these, from own leaves and fetched nodes; the end last."""
    out, level = [], 0
    while True:
        if n == 1:
            out.append((n, 0, own))
            return out
        end = first + len(own)
        low, high = first // FAN * FAN, min(-(-end // FAN) * FAN, n)
        own = [fetched[level, p] for p in range(low, first)] + own + [fetched[level, p] for p in range(end, high)]
        out.append((n, low, own))
        own = [digest_of(own[i: i + FAN]) for i in range(0, len(own), FAN)]
        first, n, level = low // FAN, -(-n // FAN), level + 1


def _climb(levels: list[tuple[int, int, list[str]]], pos: int, node: str, siblings: list[str]) -> str:
    """The tree's end folded from ``node`` at ``pos``; siblings passed are appended."""
    for n, low, known in levels[:-1]:
        run = pos // FAN * FAN - low
        nodes, at = known[run: run + FAN], pos % FAN
        siblings += nodes[:at] + nodes[at + 1:]
        node = digest_of(nodes[:at] + [node] + nodes[at + 1:])
        pos //= FAN
    return node


RESULT = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _expand(leaves: pd.DataFrame, info: pd.DataFrame, root: str) -> pd.DataFrame:
    """The proofs of one leaf partition, expanded from its fetched nodes."""
    fetched: dict[str, dict] = {}
    for t, level, pos, d in zip(info["tree"], info["level"], info["pos"], info["digest"]):
        fetched.setdefault(t, {})[level, pos] = d
    leaves = leaves.sort_values("place", kind="stable")
    own, subroots = {}, []
    for t, f in leaves.groupby("tree", sort=False):
        own[t] = _derived(f["digest"].tolist(), int(f["pos"].iloc[0]), int(f["n"].iloc[0]), fetched.get(t, {}))
        subroots.append((int(f["top"].iloc[0]), own[t][-1][2][0]))
    subroots.sort()
    top = _derived([d for _, d in subroots], subroots[0][0], int(leaves["n_top"].iloc[0]), fetched.get(TOP, {}))
    proofs, folded = [], []
    for t, pos, at, leaf, is_changed, changed in zip(leaves["tree"], leaves["pos"], leaves["top"], leaves["digest"],
                                                     leaves["tampered"].notna(), leaves["tampered"]):
        siblings: list[str] = []
        subroot = _climb(own[t], pos, changed if is_changed else leaf, siblings)
        folded.append(_climb(top, at, subroot, siblings))
        proofs.append(digest_of(siblings))
    texts = lambda values: np.array(list(values), object)
    return pd.DataFrame({"no_id": leaves["no_id"].to_numpy(), "doc_id": leaves["doc_id"].to_numpy(), "leaf": texts(leaves["digest"]),
                         "subroot": texts(own[t][-1][2][0] for t in leaves["tree"]), "root": texts([root] * len(leaves)),
                         "proof_sha256": texts(proofs), "folded_root": texts(folded), "verified": texts(folded) == root})


def manifest(docs: DataFrame, tampered: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(leaves, nodes) of a table with doc_id, source, lang, n_chars, text.

    leaves: doc_id, tree, pos, n, digest, tampered, top, n_top, place; nodes: tree, level, pos, digest of
    every level of every tree.  ``tampered`` is the digest to fold in place of a leaf, null for none.
    """
    rows = pick(docs, **{c: c for c in ("doc_id", "source", "lang", "n_chars", "text")})
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    rows = rows.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(NULL_SOURCE)).alias("tree"),
                       leaf_digest(*columns).alias("digest"),
                       (F.lit(None).cast("string") if tampered is None else tampered).alias("tampered"))
    placed = _ordered(written(rows, "digests"), ["tree", "doc_id", "digest"], "leaves").withColumn("part", F.expr(f"place div {PARTITION}"))
    # how far each source reaches, from counts per (leaf partition, source): a hot source is one row a partition
    spans = written(placed.groupBy("part", "tree").agg(F.min("place").alias("from"), F.count(F.lit(1)).alias("size")), "spans")
    sources = spans.groupBy("tree").agg(F.min("from").alias("start"), F.sum("size").alias("n"))
    sources = _ordered(sources, ["tree"], "sources").withColumnRenamed("place", "top")
    n_top = F.lit(spans.select("tree").distinct().count()).cast("long")
    where = spans.select("part", "tree").join(sources, "tree").withColumn("n_top", n_top)
    leaves = written(placed.join(where, ["part", "tree"]).withColumn("pos", F.col("place") - F.col("start")).drop("start"), "leaves")
    levels = trees(leaves)
    tops = written(ends(leaves, levels).join(sources.select("tree", "top"), "tree")
                   .select(F.lit(TOP).alias("tree"), F.col("top").alias("pos"), n_top.alias("n"), "digest"), "subroots")
    nodes = leaves.select("tree", F.lit(0).alias("level"), "pos", "digest")
    for at, level in enumerate(levels):
        nodes = nodes.unionByName(level.select("tree", F.lit(at + 1).alias("level"), "pos", "digest"))
    for at, level in enumerate([tops, *trees(tops)]):
        nodes = nodes.unionByName(level.select("tree", F.lit(at).alias("level"), "pos", "digest"))
    return leaves, nodes


def verified_proofs(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each leaf with its subroot, the root, the digest of its proof and the root folded along it."""
    last = nodes.where(F.col("tree") == TOP).orderBy(F.col("level").desc()).limit(1).collect()
    root = last[0]["digest"] if last else ""
    spans = leaves.groupBy("part", "tree", "n", "top", "n_top").agg(F.min("pos").alias("first"), (F.max("pos") + 1).alias("end"))
    wanted = spans.groupBy("part").applyInPandas(_requests, "part long, tree string, level int, pos long")
    fetched = wanted.join(nodes, ["tree", "level", "pos"])
    shown = leaves.withColumn("no_id", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    out = shown.groupBy("part").cogroup(fetched.groupBy("part")).applyInPandas(
        lambda own, fetched: _expand(own, fetched, root), "no_id boolean, " + RESULT)
    return out.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def lowered_fifth(docs: DataFrame) -> Column:
    """The leaf digest with A-Z of the text in lower case where 5 divides crc32(doc_id in decimal), else null."""
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = leaf_digest(*columns, F.translate("text", UPPER, LOWER))
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, changed)


def _oracle(source_levels: int = 8, top_levels: int = 8) -> str:
    """DuckDB SQL by plain per-document proofs; serves sources of up to 16**8 documents and as many sources."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    joined = lambda text: " || ".join([field(c) for c in ("doc_id", "source", "lang", "n_chars")] + [field(text)])
    out = [f"""
WITH RECURSIVE crc(i, k, c) AS (
  SELECT i, 0, CAST(i AS BIGINT) FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8
), d AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS tree, sha256({joined('text')}) AS leaf,
         sha256({joined("low")}) AS changed,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
             lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc
  FROM (SELECT *, translate(text, '{UPPER}', '{LOWER}') AS low FROM documents CROSS JOIN crc_table)
), s0 AS (
  SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n, leaf AS digest,
         doc_id, CASE WHEN crc % 5 = 0 THEN changed ELSE leaf END AS folded, leaf
  FROM d"""]
    for k in range(source_levels):
        out.append(f"""), s{k + 1} AS (
  SELECT tree, pos // 16 AS pos, CASE WHEN any_value(n) = 1 THEN 1 ELSE (any_value(n) + 15) // 16 END AS n,
         CASE WHEN any_value(n) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest
  FROM s{k} GROUP BY tree, pos // 16""")
    out.append(f"""), t0 AS (
  SELECT tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, digest FROM s{source_levels}""")
    for k in range(top_levels):
        out.append(f"""), t{k + 1} AS (
  SELECT pos // 16 AS pos, CASE WHEN any_value(n) = 1 THEN 1 ELSE (any_value(n) + 15) // 16 END AS n,
         CASE WHEN any_value(n) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest
  FROM t{k} GROUP BY pos // 16""")
    at = "), p0 AS (SELECT row_number() OVER () AS row, doc_id, leaf, tree, pos, folded, '' AS proof FROM s0"
    out.append(at)
    steps = [(f"s{k}", "AND s.tree = p.tree") for k in range(source_levels)] + [(f"t{k}", "") for k in range(top_levels)]
    for k, (level, on) in enumerate(steps):
        start = "t.pos" if level == "t0" else "p.pos"
        top = "JOIN t0 t ON t.tree = p.tree" if level == "t0" else ""
        out.append(f"""), p{k + 1} AS (
  SELECT row, any_value(p.doc_id) AS doc_id, any_value(p.leaf) AS leaf, any_value(p.tree) AS tree, any_value({start}) // 16 AS pos,
         CASE WHEN any_value(s.n) = 1 THEN any_value(p.folded)
              ELSE sha256(string_agg(CASE WHEN s.pos = {start} THEN p.folded ELSE s.digest END, '' ORDER BY s.pos)) END AS folded,
         any_value(p.proof) || coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (s.pos <> {start}), '') AS proof
  FROM p{k} p {top} JOIN {level} s ON s.pos // 16 = {start} // 16 {on} GROUP BY row""")
    out.append(f""")
SELECT p.doc_id, p.leaf, s.digest AS subroot, r.digest AS root, sha256(p.proof) AS proof_sha256, p.folded AS folded_root, p.folded = r.digest AS verified
FROM p{len(steps)} p JOIN s{source_levels} s ON s.tree = p.tree CROSS JOIN t{top_levels} r""")
    return "".join(out)


ORACLE_SQL = _oracle(5, 3)

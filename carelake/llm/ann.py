"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees.

Vectors get one more coordinate, ``sqrt(M^2 - |v|^2)`` with M the largest norm of the
table (0 for a query), which makes the nearest by angle the one of largest inner product.
The trees are fitted on at most ``SAMPLE`` vectors (smallest hashes of their ids): a node
splits at the median of the projection on the difference of two of its vectors.  Every
vector is then routed to a leaf of each tree.  A query walks all trees through one
priority queue, nearest margin first, until the leaves it has taken hold ``FRACTION`` of the
sample and at least ``LEAST`` sample rows; each leaf is compared with its queries in blocks
of bounded size by exact inner products in double precision.  A score below a query's k-th
best among the sample rows of its own leaves can't be among its k best and is not kept.

Measured recall at 20 against brute force: see the README.

Defined cases: see ``vectors.usable`` for rows that take no part; a query whose id has
several rows is one query; equal scores rank by smaller id; with fewer candidates than
k all that were found are returned; an empty table gives no row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from carelake.llm.common import written
from carelake.llm.vectors import blocks, matrix, sample_rows, usable

SAMPLE, TREES, LEAVES, LEAST_LEAF = 20_000, 6, 128, 16
FRACTION, LEAST = 0.68, 400
MOST_MEMBERS, MOST_PROBERS = 4096, 1024


class Forest:
    """Trees as flat arrays; node i of all trees together has a normal, a threshold and two children."""

    def __init__(self, sample: np.ndarray, largest: float, trees: int = TREES, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.largest = largest
        points = self.lift(sample)
        self.normals: list[np.ndarray] = []
        self.thresholds: list[float] = []
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray] = []
        most = max(LEAST_LEAF, len(sample) // LEAVES)
        self.roots = [self._grow(points, np.arange(len(points)), most, rng) for _ in range(trees)]
        self.normals_matrix = np.array(self.normals)

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.largest**2 - (x**2).sum(1), 0)
        return np.column_stack([x, np.sqrt(rest)])

    def _grow(self, points: np.ndarray, rows: np.ndarray, most: int, rng: np.random.Generator) -> int:
        me = len(self.children)
        self.children.append(None)
        self.normals.append(np.zeros(points.shape[1]))
        self.thresholds.append(0.0)
        self.rows.append(rows)
        for _ in range(3 if len(rows) > most else 0):
            a, b = points[rng.choice(rows, 2, replace=False)]
            normal = a - b
            if (size := np.linalg.norm(normal)) < 1e-9:
                continue
            place = points[rows] @ (normal / size)
            at = float(np.median(place))
            low = place < at
            if low.any() and not low.all():
                self.normals[me], self.thresholds[me] = normal / size, at
                self.rows[me] = rows[:0]
                self.children[me] = (self._grow(points, rows[low], most, rng), self._grow(points, rows[~low], most, rng))
                break
        return me

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        points = self.lift(x)
        out = np.zeros((len(x), len(self.roots)), np.int32)
        for t, root in enumerate(self.roots):
            todo = [(root, np.arange(len(x)))]
            while todo:
                node, rows = todo.pop()
                if self.children[node] is None:
                    out[rows, t] = node
                else:
                    up = points[rows] @ self.normals[node] >= self.thresholds[node]
                    todo += [(self.children[node][0], rows[~up]), (self.children[node][1], rows[up])]
        return out

    def search(self, queries: np.ndarray, fraction: float, least: int, sample: np.ndarray,
               k: int) -> tuple[list[list[int]], np.ndarray]:
        """Leaves of each query, through one queue over all trees, and a floor for its k-th best score.

        The floor is the (k+1)-th best (one may be the query) of the sample rows in those leaves.
        """
        total, floor = len(sample), np.full(len(queries), -np.inf)
        margins = np.column_stack([queries, np.zeros(len(queries))]) @ self.normals_matrix.T - np.array(self.thresholds)
        enough = min(total, max(least, int(np.ceil(fraction * total))))
        out = []
        for margin in margins:
            queue = [(0.0, root) for root in self.roots]
            seen, found, leaves = np.zeros(total, bool), 0, []
            while queue and found < enough:
                far, node = heapq.heappop(queue)
                if self.children[node] is None:
                    rows = self.rows[node]
                    found += int(len(rows) - seen[rows].sum())
                    seen[rows] = True
                    leaves.append(node)
                    continue
                low, high = self.children[node]
                m = float(margin[node])
                near, other = (high, low) if m >= 0 else (low, high)
                heapq.heappush(queue, (far, near))
                heapq.heappush(queue, (max(far, abs(m)), other))
            out.append(leaves)
            scores = sample[seen] @ queries[len(out) - 1]
            if len(scores) > k:
                best = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
                floor[len(out) - 1] = best - 1e-9 * (1 + abs(best))
        return out, floor


def search(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding",
           fraction: float = FRACTION) -> DataFrame:
    """The k nearest of each query row among all other rows: query_id, rank, vec_id, score.

    ``is_query`` is a condition on the column ``vec_id``.
    """
    spark = vectors.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    table = usable(vectors, vec_id, embedding)
    sample = sample_rows(table, SAMPLE)
    if not len(sample):
        return spark.createDataFrame([], empty)

    def norms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame({"most": [float((matrix(f["vector"]) ** 2).sum(1).max())]})

    largest = float(np.sqrt(table.mapInPandas(norms, "most double").agg(F.max("most")).first()[0]))
    made = Forest(sample, largest)
    forest, fixed = spark.sparkContext.broadcast(made), spark.sparkContext.broadcast(sample)

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield f.assign(leaves=list(forest.value.route(matrix(f["vector"]))))

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = fixed.value
        for f in frames:
            for at in range(0, len(f), 256):
                part = f.iloc[at: at + 256]
                q = matrix(part["vector"])
                leaves, floor = forest.value.search(q, fraction, LEAST, rows, k)
                yield part.assign(leaves=leaves, floor=floor)

    members = written(table.mapInPandas(route, "vec_id long, vector binary, leaves array<int>"), "members")
    probers = written(table.where(is_query).mapInPandas(walk, "vec_id long, vector binary, leaves array<int>, floor double"),
                      "probers")
    left, right = blocks(members.withColumn("leaf", F.explode("leaves")).drop("leaves"),
                         probers.withColumn("leaf", F.explode("leaves")).drop("leaves"), "leaf", MOST_MEMBERS, MOST_PROBERS)

    def compare(found: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("vec_id")
        ids, out = found["vec_id"].to_numpy(), []
        if len(found) and len(queries):
            scores = matrix(queries["vector"]) @ matrix(found["vector"]).T
            keep = scores >= queries["floor"].to_numpy()[:, None]
            keep &= queries["vec_id"].to_numpy()[:, None] != ids[None, :]
            for q, row, mask in zip(queries["vec_id"], scores, keep, strict=True):
                at = np.flatnonzero(mask)
                at = at[np.argsort(-row[at], kind="stable")[:k]]
                out.append(pd.DataFrame({"query_id": q, "vec_id": ids[at], "score": row[at]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
            {"query_id": "int64", "vec_id": "int64"})

    # the same pair meets in several trees; its score may differ in the last bit by block shape
    pairs = (left.cogroup(right).applyInPandas(compare, "query_id long, vec_id long, score double")
             .groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


"""Shared pieces of the two vector operators: usable rows, sampling, block keys."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import pick, written


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, vector (its doubles as bytes) of every row that can take part.

    Left out: null ids, null, empty or all-zero vectors, null or non-finite
    components, and vectors whose length is not the table's most common one (ties: the
    longer).  Rows with the same id are one vector, the least of them.
    """
    v = F.col("v")
    rows = pick(vectors, vec_id=vec_id, v=embedding).select(F.col("vec_id").cast("long").alias("vec_id"),
                                                           v.cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"vec_id": f["vec_id"], "size": [len(x) for x in f["v"]],
                                "vector": [np.asarray(x, np.float64).tobytes() for x in f["v"]]})

    table = written(rows.mapInPandas(pack, "vec_id long, size int, vector binary"), "vectors")
    common = table.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    size = common[0]["size"] if common else 0
    out = table.where(F.col("size") == size).select("vec_id", "vector")
    out.written_to = table.written_to
    return out


def matrix(column: Iterable[bytes]) -> np.ndarray:
    """Rows of doubles from their bytes."""
    rows = list(column)
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 1))


def sample_rows(table: DataFrame, most: int) -> np.ndarray:
    """Vectors of the ``most`` rows with the smallest hashes of their ids (bounded by ``most``)."""
    turn = F.xxhash64("vec_id", F.lit("sample"))
    return matrix(table.orderBy(turn, "vec_id").limit(most).toPandas()["vector"])


def shares(counts: DataFrame, key: str, most: int) -> dict[int, int]:
    """Into how many parts a key's rows are split so that each has about ``most``; only keys over it."""
    rows = counts.where(F.col("n") > most).collect()  # fewer than the index has keys
    return {r[key]: math.ceil(r["n"] / most) for r in rows}


def parts(shared: dict[int, int], key: str):
    """A column: the number of parts of ``key``."""
    if not shared:
        return F.lit(1)
    pairs = [F.lit(x) for kv in shared.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col(key)), F.lit(1))


def blocks(members: DataFrame, probers: DataFrame, key: str, most_members: int, most_probers: int):
    """Both sides keyed so that each (key, mpart, ppart) is a block of bounded size.

    A member lies in one part of its key and meets every part of the probers, and the
    other way round; a key that holds a third of all rows becomes many blocks.
    """
    count = lambda df: df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    m, p = shares(count(members), key, most_members), shares(count(probers), key, most_probers)
    each = lambda other: F.explode(F.sequence(F.lit(0), other - 1))
    left = (members.withColumn("mpart", F.pmod(F.xxhash64("vec_id"), parts(m, key)).cast("int"))
            .withColumn("ppart", each(parts(p, key))))
    right = (probers.withColumn("ppart", F.pmod(F.xxhash64("vec_id"), parts(p, key)).cast("int"))
             .withColumn("mpart", each(parts(m, key))))
    # columns of its own on one side: both may come from one table
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    return left.groupBy(key, "mpart", "ppart"), right.groupBy(key, "mpart", "ppart")

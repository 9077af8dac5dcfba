"""Shared helpers: the written-table lineage cut, what frees disk, hashing tables, batched text reading."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none (tests, a plain local run) the warehouse folder
    is used, which Spark itself requires to be shared on a cluster.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_llm_scratch"
    return base.rstrip("/")


@contextlib.contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs within go when it has ended, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: cuts the lineage.

    A lost executor then costs a reread, not a recomputation, and values such as
    partial results stay the same however often they are read.
    """
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}/{name}"
    with freeing(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Removes tables that ``written`` gave, once nothing reads them any more; results are lazy and may."""
    for table in tables:
        spark = table.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(table.written_to).getParent()
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it.

    A cluster without a shared install ships the package with ``--py-files`` instead.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


#: What empties the caches that operators keep in a Python worker from task to task.
CACHES: list[Callable[[], None]] = []


def give_back() -> None:
    """Returns memory that freed arrays and batches have left in this Python worker to the system.

    Workers are reused by later jobs; without this each job's peak would be added to what the last ones kept.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, for ``mapInPandas`` or ``mapInArrow``, giving memory back before and after.

    An executor has more Python workers than tasks at a time, and takes them in turn: what a task leaves in
    its worker would stay there while the others work.
    """
    def task(batches: Iterator) -> Iterator:
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def drop_caches() -> None:
    """Empties the caches too: called where an operator starts a task that uses none."""
    for empty in CACHES:
        empty()
    give_back()


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns (``new=old``): extra or clashing columns of the input go."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def as_text(df: DataFrame, *columns: str) -> DataFrame:
    """Whole-number columns as decimal text, for a way through pandas.

    There a bigint column with a null becomes float64, which rounds above 2**53; text stays exact.
    """
    return df.withColumns({c: F.col(f"`{c}`").cast("string") for c in columns})


def as_number(df: DataFrame, *columns: str) -> DataFrame:
    """The way back from ``as_text``."""
    return df.withColumns({c: F.col(f"`{c}`").cast("long") for c in columns})


BITMAP_RANGES = 16


def may_be_among(ids: DataFrame):
    """A test for columns: may a value be among the single column of ``ids``?  False is certain.

    The ids become one bitmap of their hashes, 16 bits an id up to 16 MB in all, so what is
    sent to the tasks is bounded; beyond that more values pass.  It goes before a join, which decides.
    """
    spark = ids.sparkSession
    bits = 1 << int(np.clip(np.ceil(np.log2(16 * max(ids.count(), 1))), 16, 27))
    width = bits // BITMAP_RANGES

    def place(keys) -> np.ndarray:
        return (mix64(np.asarray(keys, np.int64).view(np.uint64)) % np.uint64(bits)).astype(np.int64)

    def mark(frames):
        seen = np.zeros(bits, bool)
        for f in frames:
            seen[place(f.iloc[:, 0].dropna())] = True
        yield pd.DataFrame({"range": range(BITMAP_RANGES),
                            "bits": [np.packbits(seen[i * width: (i + 1) * width]).tobytes() for i in range(BITMAP_RANGES)]})

    def either(f: pd.DataFrame) -> pd.DataFrame:
        whole = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in f["bits"]])
        return pd.DataFrame({"range": f["range"].iloc[:1], "bits": [whole.tobytes()]})

    parts = ids.mapInPandas(mark, "range int, bits binary").groupBy("range").applyInPandas(either, "range int, bits binary").collect()
    data = b"".join(bytes(r["bits"]) for r in sorted(parts, key=lambda r: r["range"]))
    shared = spark.sparkContext.broadcast(np.frombuffer(data or bytes(bits // 8), np.uint8))

    def known(keys: pd.Series) -> pd.Series:
        out = np.zeros(len(keys), bool)
        there = keys.notna().to_numpy()
        at = place(keys[there])
        out[there] = (shared.value[at >> 3] >> (7 - (at & 7))) & 1
        return pd.Series(out)

    return F.pandas_udf(known, "boolean")


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), element-wise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes of byte ranges modulo 2**64, by prefix sums.

    ``prefix(b)`` gives sums S with S[j]-S[i] = sum of (b+1)*B**k over i <= k < j;
    multiplying by B**-i (B is odd, so invertible) removes the position.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, most: int):
        inverse = pow(self.BASE, -1, 1 << 64)
        self.up = self._powers(self.BASE, most + 1)
        self.down = self._powers(inverse, most + 1)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((prefix[end] - prefix[start]) * self.down[start])


# --- words: lower-cased A-Z, runs of bytes other than ASCII white space ------------------

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD_BLOCK = 1 << 20


class Words:
    """64-bit hashes of the words of whole texts, in blocks cut at white space."""

    def __init__(self):
        self.rolling = Rolling(WORD_BLOCK + (1 << 12))

    def hashes(self, text: str | None) -> np.ndarray:
        data = LOWER[np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)]
        if len(data) <= WORD_BLOCK:
            return self._block(data)
        out, at = [], 0
        while at < len(data):
            end = min(at + WORD_BLOCK, len(data))
            while end < len(data) and not SPACE[data[end]]:
                ahead = np.flatnonzero(SPACE[data[end: end + WORD_BLOCK]])
                end += int(ahead[0]) if len(ahead) else WORD_BLOCK
            end = min(end, len(data))
            out.append(self._block(data[at:end]))
            at = end
        return np.concatenate(out)

    def _block(self, data: np.ndarray) -> np.ndarray:
        if len(self.rolling.up) <= len(data):
            self.rolling = Rolling(len(data) + len(data) // 4)
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~SPACE[data]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edge[::2], edge[1::2]
        return self.rolling.ranges(self.rolling.prefix(data), starts, ends) ^ mix64((ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of a word sequence (order matters)."""
    if len(words) < n:
        return words[:0]
    size = len(words) - n + 1
    out = words[:size]
    for i in range(1, n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[i: size + i]
    return mix64(out + np.uint64(n)) if n > 1 else out

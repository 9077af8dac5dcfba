"""Quality classifier: random-indexing word vectors pooled per document, then a small network.

* Every word is hashed to a bucket with a fixed sparse ternary *index vector*; its *context
  vector* is the sum of the index vectors of its neighbours (two on either side), counted
  over all documents and normalised.  A word's shape (the kinds of its characters, runs
  shortened) is hashed to index vectors of its own.  Words and shapes are hashed from the bytes of a whole block at once.
* A document pools, over all of its words: the mean context vector, the mean shape vector,
  the mean product of neighbouring words' index vectors (large where words repeat), the
  norm of the mean index vector and the log of its length.  Nothing but the text is used.
* A two-layer network in numpy maps the pooled vector to a logit; a temperature fitted on
  a part of the sample that it was not trained on calibrates the probability.

Fitting uses at most ``SAMPLE`` labelled rows (those with the smallest hashes of their ids);
their pooled vectors and the context matrix, both of fixed size, meet in the driver.  The
context matrix and scoring cover every document.

Defined cases: null, empty or blank text pools to zeros and gets the score the network
gives that; without labelled rows every score is 0.5; a document labelled twice counts
twice; labels that are null are left out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import LOWER, SPACE, Rolling, drop_caches, giving_back, mix64, pick

SAMPLE = 8_000
WORDS, SHAPES, DIM, NONZERO, REACH = 1 << 14, 1 << 11, 32, 4, 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 128, 2e-3, 1e-4
THRESHOLD = 0.3
BLOCK_BYTES = 1 << 19
CONTEXT_WORDS, CONTEXT_TASKS = 1 << 16, 32


def index_vectors(rows: int, seed: int) -> np.ndarray:
    """Sparse ternary vectors: ``NONZERO`` entries of +-1 per row, scaled to unit length."""
    rng = np.random.default_rng(seed)
    out = np.zeros((rows, DIM), np.float32)
    for _ in range(NONZERO):
        out[np.arange(rows), rng.integers(0, DIM, rows)] += rng.choice([-1.0, 1.0], rows)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    out[norm[:, 0] == 0, 0] = 1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


# Kinds of bytes: letters of either case, digits and other letters (known by the first byte of a
# character, the rest go) are each one kind, any other byte is its own.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[0x80:0xC0], _KIND[0xC0:] = 65, 97, 48, 0, 97


class Coder:
    """Codes of the words of a text: bucket * SHAPES + shape bucket, from the bytes of all words at once."""

    def __init__(self):
        drop_caches()
        self.rolling = Rolling(BLOCK_BYTES + (1 << 12))

    def codes(self, text: str) -> Iterator[np.ndarray]:
        """In blocks cut at white space; words are runs of bytes other than ASCII white space."""
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        at = 0
        while at < len(data):
            end = min(at + BLOCK_BYTES, len(data))
            while end < len(data) and not SPACE[data[end]]:
                ahead = np.flatnonzero(SPACE[data[end: end + BLOCK_BYTES]])
                end = min(end + (int(ahead[0]) if len(ahead) else BLOCK_BYTES), len(data))
            found = self._block(data[at:end])
            if len(found):
                yield found
            at = end

    def _block(self, data: np.ndarray) -> np.ndarray:
        rolling = self.rolling if len(data) < len(self.rolling.up) else Rolling(len(data))
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~SPACE[data]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edge[::2], edge[1::2]
        words = rolling.ranges(rolling.prefix(LOWER[data]), starts, ends) ^ mix64((ends - starts).astype(np.uint64))
        # the shape: the kinds of a word's characters, runs of three or more shortened to two ("Thanks!!!" is Aaa!!)
        kinds = _KIND[data]
        there = kinds != 0
        kinds, place = kinds[there], np.r_[0, np.cumsum(there)]
        short = np.ones(len(kinds), bool)
        short[2:] = (kinds[2:] != kinds[1:-1]) | (kinds[1:-1] != kinds[:-2])
        kinds, place = kinds[short], np.r_[0, np.cumsum(short)][place]
        starts, ends = place[starts], place[ends]
        shapes = rolling.ranges(rolling.prefix(kinds), starts, ends) ^ mix64((ends - starts).astype(np.uint64))
        return ((words % np.uint64(WORDS)) * np.uint64(SHAPES) + shapes % np.uint64(SHAPES)).astype(np.int64)


def _context(runs: list[np.ndarray], index: np.ndarray, into: np.ndarray) -> None:
    """Adds the context vectors of the words of several runs; the last row of ``index`` is zero and stands between them."""
    gap = np.full(REACH, WORDS, np.uint16)
    words = np.concatenate([part for codes in runs for part in ((codes // SHAPES).astype(np.uint16), gap)])
    vectors = index[words]
    near = np.zeros_like(vectors)
    for d in range(1, REACH + 1):
        near[d:] += vectors[:-d]
        near[:-d] += vectors[d:]
    order = np.argsort(words, kind="stable")
    sorted_words = words[order]
    first = np.r_[0, np.flatnonzero(np.diff(sorted_words)) + 1]
    into[sorted_words[first]] += np.add.reduceat(near[order], first, dtype=np.float64)


FEATURES = 4 * DIM + 2


def pooled(coder: Coder, text: str | None, index: np.ndarray, shapes: np.ndarray, context: np.ndarray) -> np.ndarray:
    """The fixed-size vector of one whole text."""
    sums = np.zeros((4, DIM))
    n = pairs = 0
    last = None
    for codes in coder.codes(text or ""):
        words, kinds = codes // SHAPES, codes % SHAPES
        vectors = index[words]
        sums[0] += context[words].sum(0)
        sums[1] += shapes[kinds].sum(0)
        sums[3] += vectors.sum(0)
        run = vectors if last is None else np.concatenate([last, vectors])
        sums[2] += np.einsum("ij,ij->j", run[1:], run[:-1])
        last = vectors[-1:]
        n, pairs = n + len(codes), pairs + len(run) - 1
    mean = sums / max(n, 1)
    mean[2] = sums[2] / max(pairs, 1)
    return np.concatenate([mean.ravel(), [np.linalg.norm(mean[3]), np.log1p(n)]]).astype(np.float32)


@dataclass
class Model:
    """Everything a scorer needs; of fixed size."""

    context: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(features) / self.temperature, -500, 500)))

    def logit(self, features: np.ndarray) -> np.ndarray:
        x = (features.astype(float) - self.mean) / self.scale
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2


def train_network(context: np.ndarray, features: np.ndarray, labels: np.ndarray, seed: int = 7) -> Model:
    """Adam on cross-entropy over most rows; the temperature on every sixth row."""
    features, labels = features.astype(float), labels.astype(float)
    rng = np.random.default_rng(seed)
    held = np.arange(len(labels)) % 6 == 5
    if not held.any():
        held[:] = False
    mean, scale = features.mean(0), features.std(0) + 1e-6
    x, y = (features[~held] - mean) / scale, labels[~held]
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
         rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        rate = RATE * (0.5 + 0.5 * np.cos(np.pi * epoch / EPOCHS))
        for at in range(0, len(y), BATCH):
            rows = order[at: at + BATCH]
            h = np.tanh(x[rows] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -500, 500))) - y[rows]) / len(rows)
            back = np.outer(d, p[2]) * (1 - h * h)
            grads = [x[rows].T @ back + DECAY * p[0], back.sum(0), h.T @ d + DECAY * p[2], np.array([d.sum()])]
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                p[i] = p[i] - rate * first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    model = Model(context, mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    if held.any():
        logits = model.logit(features[held])
        sign = np.where(labels[held] > 0.5, 1.0, -1.0)
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 121))
        model.temperature = float(min(grid, key=lambda t: np.logaddexp(0, -sign * logits / t).mean()))
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a document's labels are never learnt from: crc32 of its id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id",
        text: str = "text", label: str = "quality") -> Model | None:
    """A model learnt from the words of all documents and at most ``sample`` labelled rows outside the held-out fold."""
    marks = pick(labels, doc_id=doc_id, label=label).where(F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    marks = marks.withColumn("turn", F.xxhash64("doc_id", F.lit("sample"))).orderBy("turn", "doc_id", "label").limit(sample)
    # at most `sample` ids and labels: small by its parameter
    rows = (pick(docs, doc_id=doc_id, text=text).join(F.broadcast(marks), "doc_id")
            .select("turn", "doc_id", "text", F.col("label").cast("double").alias("label")))

    @giving_back
    def contexts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, total = np.concatenate([index_vectors(WORDS, 1), np.zeros((1, DIM), np.float32)]), np.zeros((WORDS + 1, DIM))
        coder, runs, held = Coder(), [], 0
        for frame in frames:
            for t in frame["text"]:
                for codes in coder.codes(t or ""):
                    runs.append(codes)
                    held += len(codes)
                    if held >= CONTEXT_WORDS:
                        _context(runs, index, total)
                        runs, held = [], 0
        if runs:
            _context(runs, index, total)
        seen = np.flatnonzero(np.abs(total[:WORDS]).sum(1))
        if len(seen):
            yield pd.DataFrame({"bucket": seen, "vector": list(total[seen])})

    # a task hands on up to WORDS rows, so there are no more tasks than keep the cores busy
    tasks = max(CONTEXT_TASKS, 4 * docs.sparkSession.sparkContext.defaultParallelism)
    vectors = pick(docs, text=text).coalesce(tasks).mapInPandas(contexts, "bucket long, vector array<double>")
    summed = vectors.groupBy("bucket").agg(F.array(*[F.sum(F.col("vector")[i]) for i in range(DIM)]).alias("vector"))
    context = np.zeros((WORDS, DIM), np.float32)
    for row in summed.toPandas().itertuples():  # at most WORDS rows of DIM numbers
        context[row.bucket] = row.vector
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    shared = docs.sparkSession.sparkContext.broadcast(context)

    @giving_back
    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, index, shapes = Coder(), index_vectors(WORDS, 1), index_vectors(SHAPES, 2)
        for frame in frames:
            found = [pooled(coder, t, index, shapes, shared.value).tobytes() for t in frame["text"]]
            yield frame[["turn", "doc_id", "label"]].assign(features=found)

    table = (rows.mapInPandas(features, "turn long, doc_id long, label double, features binary").toPandas()
             .sort_values(["turn", "doc_id", "label"]))
    if table.empty:
        return None
    matrix = np.stack([np.frombuffer(b, np.float32) for b in table["features"]])
    return train_network(context, matrix, (table["label"] > 0.5).to_numpy())


def with_score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1, higher: better) and predicted (1 from ``THRESHOLD``).

    Columns of ``docs`` with these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder, index, shapes, made = Coder(), index_vectors(WORDS, 1), index_vectors(SHAPES, 2), shared.value
        for texts in batches:
            if made is None or not len(texts):
                yield pd.Series(np.full(len(texts), 0.5))
            else:
                yield pd.Series(made.score(np.stack([pooled(coder, t, index, shapes, made.context) for t in texts])))

    scored = docs.withColumn("score", F.pandas_udf(run, "double")(F.col(f"`{text}`")))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def score(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score and predicted of every document."""
    return with_score(pick(docs, doc_id=doc_id, text=text), model).select("doc_id", "score", "predicted")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Fit on the labelled rows outside the held-out fold, then score all documents."""
    scored = score(docs, fit(docs, labels, sample))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

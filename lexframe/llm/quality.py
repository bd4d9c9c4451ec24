"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network on them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from lexframe.llm._common import SPACE_WORDS, bounded_batches, text_runs, tidy, word_hashes, word_spans

#: Buckets of words and of word shapes, and the width of their vectors: the model's size is fixed.
WORDS, SHAPES, WIDTH = 16_384, 4_096, 32
ENTRIES = WORDS + SHAPES
FEATURES = 4 * WIDTH + 1
_SIGNS = 4

_CLASSES = np.arange(256, dtype=np.uint8)
_CLASSES[48:58] = ord("0")
_CLASSES[65:91] = ord("A")
_CLASSES[97:123] = ord("a")
_CLASSES[128:] = ord("a")


@lru_cache(maxsize=1)
def index_vectors() -> np.ndarray:
    """The sparse random vector of each entry: a few components of 1 or -1, from a fixed seed."""
    rng = np.random.default_rng(11)
    out = np.zeros((ENTRIES, WIDTH), dtype=np.float32)
    for i in range(_SIGNS):
        at = rng.integers(0, WIDTH, ENTRIES)
        out[np.arange(ENTRIES), at] += rng.choice([-1.0, 1.0], ENTRIES).astype(np.float32)
    return out


def entries(data: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a run of texts: the word entry and the shape entry of each word, and each text's first word.

    A word's shape is its sequence of character classes, each run of a class once: 'Word!!' is 'Aa!'.
    """
    starts, ends = word_spans(data, SPACE_WORDS)
    classes = _CLASSES[data]
    keep = np.ones(len(data) + 1, dtype=bool)
    keep[1:-1] = classes[1:] != classes[:-1]
    keep[starts] = True
    before = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(keep[:-1], out=before[1:])
    words = word_hashes(data, starts, ends) % np.uint64(WORDS)
    shapes = word_hashes(classes[keep[:-1]], before[starts], before[ends]) % np.uint64(SHAPES)
    return words.astype(np.int64), shapes.astype(np.int64) + WORDS, np.searchsorted(starts, texts)


def _contexts(column: pa.Array, total: np.ndarray) -> None:
    """Add to each entry's context vector the index vectors of its neighbours, entry by entry of each text."""
    index = index_vectors()
    for _, data, texts in text_runs(column, 1 << 19):
        words, shapes, bounds = entries(data, texts)
        if not len(words):
            continue
        own = index[words] + index[shapes]
        near = np.zeros_like(own)
        near[1:] += own[:-1]
        near[:-1] += own[1:]
        cut = bounds[(bounds > 0) & (bounds < len(words))]  # no context across texts
        cut = np.unique(cut)
        near[cut] -= own[cut - 1]
        near[cut - 1] -= own[cut]
        for ids in (words, shapes):
            for k in range(WIDTH):
                total[:, k] += np.bincount(ids, weights=near[:, k], minlength=ENTRIES)


def context_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """(ENTRIES, WIDTH) word vectors of a corpus: summed contexts over all documents, centred, of unit length.

    Each task sums its own rows into one table of fixed size; Spark sums the tables. What comes to
    the driver has a fixed size too.
    """
    names = [f"v{k}" for k in range(WIDTH)]

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((ENTRIES, WIDTH))
        for batch in batches:
            _contexts(batch.column(0), total)
        seen = np.flatnonzero(np.abs(total).sum(axis=1) > 0)
        columns = [pa.array(seen.astype(np.int32)), *(pa.array(total[seen, k].astype(np.int64)) for k in range(WIDTH))]
        yield pa.RecordBatch.from_arrays(columns, ["entry", *names])
        tidy()

    bounded_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("entry", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in names)])
    summed = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(tables, schema).groupBy("entry").agg(*(F.sum(n).alias(n) for n in names))
    out = np.zeros((ENTRIES, WIDTH), dtype=np.float32)
    for row in summed.toLocalIterator():
        out[row[0]] = row[1:]
    seen = np.flatnonzero(np.abs(out).sum(axis=1) > 0)
    if len(seen):
        unit = out[seen] / np.linalg.norm(out[seen], axis=1, keepdims=True)
        unit -= unit.mean(axis=0)
        out[seen] = unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-6)
    return out


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """(rows, FEATURES): mean and spread of the word vectors and of the shape vectors, and the log of the length."""
    out = np.zeros((len(column), FEATURES), dtype=np.float32)
    for first, data, texts in text_runs(column, 1 << 18):
        words, shapes, bounds = entries(data, texts)
        counts = np.diff(bounds)
        rows = np.flatnonzero(counts)
        n = counts[rows][:, None]
        at = first + rows
        out[at, -1] = np.log1p(counts[rows]) / 8
        for k, ids in enumerate((words, shapes)):
            if len(rows):
                each = vectors[ids]
                mean = np.add.reduceat(each, bounds[:-1][rows]) / n
                square = np.add.reduceat(each * each, bounds[:-1][rows]) / n
                out[at, 2 * k * WIDTH : (2 * k + 1) * WIDTH] = mean
                out[at, (2 * k + 1) * WIDTH : (2 * k + 2) * WIDTH] = np.sqrt(np.maximum(square - mean * mean, 0))
    return out


@dataclass
class Network:
    """Two layers on standardized features; probabilities at a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, steps: int = 4000, seed: int = 3) -> Network:
    """Fit by Adam on four fifths of the rows, then set the temperature for the least log loss on the rest.

    Without rows of both labels the network is a constant: the share of label 1, or 1 without rows.
    """
    if len(set(y.tolist())) < 2:
        z = np.zeros(1)
        return Network(z, z, z, z, z, 0.0, constant=float(y.mean()) if len(y) else 1.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, used = order[: len(x) // 5], order[len(x) // 5 :]
    mean, scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-3
    z, t = (x - mean) / scale, y.astype(np.float64)
    params = [rng.normal(0, np.sqrt(2 / z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        rows = used[rng.integers(0, len(used), 256)]
        a = z[rows] @ params[0] + params[1]
        h = np.maximum(a, 0)
        error = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40))) - t[rows]) / len(rows)
        back = error[:, None] * params[2] * (a > 0)
        grads = [z[rows].T @ back + 1e-4 * params[0], back.sum(axis=0), h.T @ error + 1e-4 * params[2], np.array([error.sum()])]
        rate = 3e-3 * (1 - step / (steps + 1))
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            params[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, params[0], params[1], params[2], float(params[3][0]))
    if len(held):
        logits, label = net.logits(x[held]), t[held]

        def loss(temperature: float) -> float:
            p = np.clip(1 / (1 + np.exp(-np.clip(logits / temperature, -40, 40))), 1e-9, 1 - 1e-9)
            return float(-(label * np.log(p) + (1 - label) * np.log(1 - p)).mean())

        net.temperature = min(np.geomspace(0.25, 8, 81).tolist(), key=loss)
    return net


@dataclass
class QualityModel:
    """Word vectors and a network; score() makes a column from it."""

    vectors: np.ndarray
    network: Network
    _sent: dict = field(default_factory=dict, repr=False)

    def score(self, df: DataFrame, text: Column) -> Column:
        """The probability (double) that a text has label 1; null and empty texts have one too."""
        bounded_batches(df.sparkSession)
        sent = df.sparkSession.sparkContext.broadcast((self.vectors, self.network))

        @arrow_udf(T.DoubleType())
        def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            vectors, network = sent.value
            for column in batches:
                yield pa.array(network.scores(pooled(column, vectors)), pa.float64())
            tidy()

        return scores(text)


def held_out(doc_id: Column) -> Column:
    """Whether a row's labels are kept for the test: crc32 of the id as text, modulo 4, is 2. False for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", train_rows: int = 20_000) -> QualityModel:
    """Learn from the labelled documents that are not held out.

    The word vectors come from all documents. The network is fitted on at most train_rows labelled
    documents, those whose ids have the least hashes; this is the only bound, and their pooled features
    (FEATURES numbers each) are what the driver gets. Several labels of an id count by their mean,
    null labels and ids not at all; of several documents with an id one is used.
    """
    vectors = context_vectors(docs, text)
    marks = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    marks = marks.groupBy(F.col(doc_id).alias("_id")).agg((F.avg(label) >= 0.5).cast("int").alias("_label"))
    marks = marks.orderBy(F.xxhash64("_id"), "_id").limit(train_rows)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    @arrow_udf(T.ArrayType(T.FloatType()))
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            x = pooled(column, sent.value)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * FEATURES), pa.array(x.ravel()))

    chosen = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(marks), "_id")
    chosen = chosen.select("_id", "_label", features("_text").alias("x")).groupBy("_id").agg(F.min("x").alias("x"), F.min("_label").alias("y"))
    rows = sorted((r["_id"], r["x"], r["y"]) for r in chosen.toLocalIterator())
    x = np.array([r[1] for r in rows], dtype=np.float64).reshape(-1, FEATURES)
    return QualityModel(vectors, train(x, np.array([r[2] for r in rows])))


def score_quality(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", accept_at: float = 0.7, train_rows: int = 20_000) -> DataFrame:
    """docs with held_out (boolean), score (double, 0 to 1) and predicted (1 where score >= accept_at, else 0).

    Labels, ids and other columns are no inputs of a score. Every row is scored on its whole text, equal
    texts alike. Columns of docs stay, those of the three names are replaced; an empty table gives none.
    """
    model = fit_quality(docs, labels, doc_id=doc_id, text=text, label=label, train_rows=train_rows)
    out = docs.withColumn("held_out", held_out(F.col(doc_id))).withColumn("score", model.score(docs, F.col(text)))
    return out.withColumn("predicted", (F.col("score") >= accept_at).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", accept_at: float = 0.7, train_rows: int = 20_000) -> DataFrame:
    """The rows of docs whose score is at least accept_at; all columns as they were, whatever their names.

    Null and empty texts have a score like any other text, equal texts the same one; repeated rows stay or go together.
    Without labels of both kinds the score is one for all. An empty table stays empty.
    """
    model = fit_quality(docs, labels, doc_id=doc_id, text=text, label=label, train_rows=train_rows)
    return docs.filter(model.score(docs, F.col(text)) >= accept_at)

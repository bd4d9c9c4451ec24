"""Shared helpers of the training-data operators: written intermediates and byte-level word scanning."""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexframe.sources.scratch import scratch_path

#: Bytes of an Arrow batch that goes to a Python worker. Spark's own bound is 64 MB, and a worker holds a
#: batch several times over: as Arrow, as strings, as words.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's bound on the bytes of an Arrow batch, if it is above BATCH_BYTES."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(name)).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet to the shared folder and read it again.

    A lost executor then costs only the tasks that it ran; nothing is recomputed from the texts.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Written intermediates of one operator, removed from the shared folder as soon as what they lead to is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Remove what was written so far; no table read from it may be used after this."""
        for path in self.paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.paths = []


#: A key is hot if it has more than one in so many of all rows, so there are at most as many hot keys.
HOT = 200
#: Up to so many rows a join needs no care for hot keys.
FEW = 2000


def hot_join(left: DataFrame, right: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """left joined to right, which has each key once and in _n the number of left's rows with it; _n goes.

    total is the sum of all _n, or more, so there are at most HOT hot keys. They are sent to all tasks, so their rows stay
    where they are; others are shuffled by key.
    """
    if total <= FEW:
        return left.join(right.drop("_n"), key, how)
    hot = right.filter(F.col("_n") * HOT > total).drop("_n")
    cold = right.filter(F.col("_n") * HOT <= total).drop("_n")
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return left.join(F.broadcast(hot), key).unionByName(rest, allowMissingColumns=True)


def whole_number(doc_id: str = "doc_id") -> Column:
    """An id as a long: itself if it is a number or the text of one, else a hash of it; null stays null."""
    return F.coalesce(F.col(doc_id).try_cast("long"), F.when(F.col(doc_id).isNotNull(), F.xxhash64(F.col(doc_id).cast("string"))))


def row_key(doc_id: str = "doc_id", text: str = "text") -> list:
    """Two columns that tell rows apart: the id as a number (a text hash where it is null) and the text's CRC.

    Rows that agree in both hold the same id and text, and so get the same result.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    return [
        F.coalesce(whole_number(doc_id), F.xxhash64(body)).alias("_k1"),
        F.crc32(body).alias("_k2"),
    ]


def stashed(df: DataFrame, *needed: str) -> DataFrame:
    """The needed columns of df and one column with all others, so that new columns clash with none."""
    rest = [c for c in df.columns if c not in needed]
    return df.select(*needed, F.struct(F.lit(0).alias("_"), *(F.col(c) for c in rest)).alias("_row"))


def unstashed(df: DataFrame, like: DataFrame, *needed: str) -> DataFrame:
    """The columns of `like` again: the needed ones as they are now, the others as they were."""
    return df.select(*(F.col(c) if c in needed else F.col("_row")[c].alias(c) for c in like.columns))


def _byte_class(separators: bytes) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: Bytes outside `[^\x20\x09-\x0D]+`, and outside `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
SPACE_WORDS = _byte_class(bytes([0x20, *range(0x09, 0x0E)]))
ALNUM_WORDS = _byte_class(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased in UTF-8 bytes; nothing else changes."""
    return _LOWER[data]


def word_spans(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte offsets of the words in one UTF-8 text."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = is_word[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_MASK = (1 << 64) - 1
_POLY = 0x9E3779B97F4A7C15
_POLY_INV = pow(_POLY, -1, 1 << 64)
_CHUNK = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    have, step = 1, base & _MASK
    with np.errstate(over="ignore"):
        while have < n:
            take = min(have, n - have)
            out[have : have + take] = out[:take] * np.uint64(step)
            have += take
            step = step * step & _MASK
    return out


_UP, _DOWN = _powers(_POLY, _CHUNK + 1), _powers(_POLY_INV, _CHUNK + 1)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from one running sum over the bytes and not a call for each word.

    Works through the text in chunks that end between words, so the temporary arrays stay small.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            base = int(starts[at])
            to = max(at + 1, int(np.searchsorted(ends, base + _CHUNK, side="right")))
            size = int(ends[to - 1]) - base
            up, down = (_UP, _DOWN) if size <= _CHUNK else (_powers(_POLY, size + 1), _powers(_POLY_INV, size + 1))
            run = np.zeros(size + 1, dtype=np.uint64)
            np.cumsum(_BYTE[data[base : base + size]] * up[:size], out=run[1:])
            s, e = starts[at:to] - base, ends[at:to] - base
            out[at:to] = mix((run[e] - run[s]) * down[s] + (e - s).astype(np.uint64))
            at = to
    return out


def window_hashes(words: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every run of `length` words, put together from runs of half the length."""
    if length <= 0 or len(words) < length:
        return np.empty(0, dtype=np.uint64)
    base = (_POLY + 2 * seed * 0xD1342543DE82EF95) & _MASK | 1

    def run(n: int) -> np.ndarray:
        if n == 1:
            return words
        left = run(n // 2)
        half = np.uint64(pow(base, n - n // 2, 1 << 64))
        right = run(n - n // 2) if n % 2 else left
        return left[: len(words) - n + 1] * half + right[n // 2 : n // 2 + len(words) - n + 1]

    with np.errstate(over="ignore"):
        return mix(run(length) + np.uint64(seed))


def texts_of(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each text of an Arrow column, without a copy; null is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield body[bounds[i] : bounds[i + 1]] if valid[i] else body[:0]


def text_runs(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, where each text starts) for runs of rows with about `most` bytes of text.

    A newline stands after each text, so that no word goes over from one text to the next. The starts
    have one more entry, the length of the bytes.
    """
    parts: list[np.ndarray] = []
    first = size = 0
    for row, data in enumerate(texts_of(column)):
        parts += [data, _NEWLINE]
        size += len(data)
        if size >= most or row + 1 == len(column):
            starts = np.zeros(len(parts) // 2 + 1, dtype=np.int64)
            np.cumsum([len(x) + 1 for x in parts[::2]], out=starts[1:])
            yield first, np.concatenate(parts), starts
            parts, first, size = [], row + 1, 0


_NEWLINE = np.frombuffer(b"\n", dtype=np.uint8)


_LIBC = ctypes.CDLL(None)


def tidy() -> None:
    """Give back to the system what a Python worker has freed, as it lives on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that are done, so that levels don't add up on the executors' disks.

    Spark cleans them once the driver's JVM has collected the plan objects. This asks for a collection, and for another
    when the listeners have let go of the last job.
    """
    for wait in (0.5, 1.0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(wait)

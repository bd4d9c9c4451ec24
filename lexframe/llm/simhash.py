"""SimHash near-duplicates: Golay-code fuzzy keys over fingerprint segments, verified joins, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from lexframe.llm._common import SPACE_WORDS, Scratch, bounded_batches, hot_join, lower_ascii, row_key, stashed, texts_of, tidy, unstashed, word_spans, written
from lexframe.llm._components import components
from lexframe.llm.golay import codeword_keys

#: Fixed value: the seed of the shingle hashes.
SEED = 42
#: Links join fingerprints that differ in at most this many bits; the keys below are made for it.
MOST_BITS = 4
_BLOCK = 1 << 14


def fingerprint_of(data: np.ndarray, shingle: int = 4) -> int:
    """The 64-bit SimHash of one UTF-8 text given as bytes."""
    data = lower_ascii(data)
    starts, ends = word_spans(data, SPACE_WORDS)
    n = len(starts)
    if n == 0:
        return 0
    votes = np.zeros(64, dtype=np.int64)
    total = max(1, n - shingle + 1)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, total, _BLOCK):
        to = min(total, lo + _BLOCK)
        last = min(n, to + shingle - 1)
        raw = data[starts[lo] : ends[last - 1]].tobytes()
        sizes = ends[lo:last] - starts[lo:last]
        raw = b" ".join(raw.split())  # splits at the same six white-space bytes
        at = np.zeros(last - lo + 1, dtype=np.int64)
        np.cumsum(sizes + 1, out=at[1:])
        step = min(shingle, n)
        a, b = at[: to - lo].tolist(), (at[step : step + to - lo] - 1).tolist()
        hashes = np.array([digest(raw[x:y], SEED) for x, y in zip(a, b)], dtype="<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.flatnonzero(2 * votes > total)
    return int(sum(1 << int(b) for b in bits))


def fingerprint(text: Column, shingle: int = 4) -> Column:
    """The fingerprint of a text column as a signed long (the same 64 bits); null counts as empty."""

    @arrow_udf("long")
    def marks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            found = np.fromiter((fingerprint_of(x, shingle) for x in texts_of(column)), dtype=np.uint64, count=len(column))
            yield pa.array(found.view(np.int64))
        tidy()

    return marks(text)


def segment_keys(fingerprints: np.ndarray, every: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs: two fingerprints that differ in at most 4 bits have a key in common.

    A fingerprint is cut into segments of 21, 21 and 22 bits, each a word of the Golay code with 2, 2 and 1
    zero data bits. Of 4 errors over three segments, either none falls into some segment: then that segment is
    the same, another has at most 2 errors, and the key is the one's bits with a codeword index of the
    other. Or each segment has some: then none has over 2, and the key is an index of each. So every key
    fixes 33 to 36 bits, and keys of unrelated fingerprints seldom meet. Without `every` the keys of the second kind
    are left out, five sixths of all: those that are left hold for pairs with a segment in common.
    """
    fp = fingerprints.view(np.uint64)
    cut = np.uint64((1 << 21) - 1)
    plain = [(fp & cut).astype(np.int64), (fp >> np.uint64(21) & cut).astype(np.int64), (fp >> np.uint64(42)).astype(np.int64)]
    near = [codeword_keys(x << s) for x, s in zip(plain, (2, 2, 1))]
    rows, keys = [], []
    for i in range(3):
        for j in range(3):
            if i != j:
                index, count = near[j]
                for a in range(6):
                    row = np.flatnonzero(count > a)
                    rows.append(row)
                    keys.append((np.int64(i * 3 + j + 1) << 40) | plain[i][row] << 12 | index[row, a])
    for a in range(6 if every else 0):
        for b in range(6):
            for c in range(6):
                row = np.flatnonzero((near[0][1] > a) & (near[1][1] > b) & (near[2][1] > c))
                rows.append(row)
                keys.append(near[0][0][row, a].astype(np.int64) << 24 | near[1][0][row, b].astype(np.int64) << 12 | near[2][0][row, c])
    return np.concatenate(rows), np.concatenate(keys)


def golay_keys(fingerprint: Column, every: bool = True) -> Column:
    """The segment_keys() of a column of fingerprints, as an array."""

    @arrow_udf(T.ArrayType(T.LongType()))
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            done = []
            for at in range(0, max(1, len(column)), 2048):
                part = column.slice(at, 2048)
                rows, keys = segment_keys(part.to_numpy(zero_copy_only=False), every)
                order = np.argsort(rows, kind="stable")
                bounds = np.zeros(len(part) + 1, dtype=np.int32)
                np.cumsum(np.bincount(rows, minlength=len(part)), out=bounds[1:])
                done.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys[order])))
            yield pa.concat_arrays(done)
        tidy()

    return made(fingerprint)


def _near(most: int):
    return lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= most


def linked_fingerprints(fingerprints: DataFrame) -> DataFrame:
    """(fp, label) for the distinct fingerprints (column fp) with a link; label is the least one of the component.

    All links count, yet no group is paired with itself. First every member of a key's bucket is held
    against the least member only, which joins dense groups into components in linear work. Then only
    members of different components are compared: in a bucket, all against those outside the component with the
    least label.
    """
    held = Scratch(fingerprints.sparkSession)
    near, by_key = _near(MOST_BITS), Window.partitionBy("key")
    # Each fingerprint becomes about 180 rows, so the few bytes of them are dealt to all tasks first.
    fingerprints = fingerprints.repartition(int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    buckets = fingerprints.select("fp", F.explode(golay_keys(F.col("fp"))).alias("key"))
    buckets = buckets.withColumns({"rep": F.min("fp").over(by_key), "top": F.max("fp").over(by_key)}).filter("rep < top").drop("top")
    buckets = held.written(buckets, "simhash-buckets")
    stars = held.written(buckets.filter((F.col("fp") != F.col("rep")) & near("fp", "rep")).select(F.col("fp").alias("a"), F.col("rep").alias("b")).distinct(), "simhash-stars")
    first = components(stars, "simhash-first")
    marked = buckets.select("key", "fp").join(first.withColumnRenamed("id", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    marked = marked.withColumns({"main": F.min("label").over(by_key), "last": F.max("label").over(by_key)}).filter("main < last").drop("last")
    marked = held.written(marked, "simhash-mixed")
    other = marked.filter("label <> main").select("key", F.col("fp").alias("fq"), F.col("label").alias("other"))
    across = marked.join(other, "key").filter((F.col("label") != F.col("other")) & near("fp", "fq")).select(F.col("label").alias("a"), F.col("other").alias("b"))
    found = components(stars.unionByName(across), "simhash-links")
    held.clear()
    return found.select(F.col("id").alias("fp"), "label")


def _resolved(df: DataFrame, doc_id: str, text: str, shingle: int) -> tuple[DataFrame, DataFrame, int]:
    """(_k1, _k2, doc_id, fp) of each row, (fp, label, component_id, _n) of each distinct fingerprint, the number of rows."""
    bounded_batches(df.sparkSession)
    held = Scratch(df.sparkSession)
    keyed = df.select(*row_key(doc_id, text), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marks = written(keyed.select("_k1", "_k2", "doc_id", fingerprint(F.col("text"), shingle).alias("fp")), "simhash-marks")
    nodes = held.written(marks.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("_n")), "simhash-nodes")
    total = nodes.agg(F.sum("_n")).first()[0] or 0
    labels = held.written(nodes.join(linked_fingerprints(nodes.select("fp")), "fp", "left").withColumn("label", F.coalesce("label", "fp")), "simhash-labels")
    reached = labels.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("_k"))
    known = hot_join(labels.select("fp", "label", F.col("_n").alias("_m")), reached.withColumnRenamed("_k", "_n"), "label", nodes.count())
    known = written(known.select("fp", "label", "component_id", F.col("_m").alias("_n")), "simhash-known")
    held.clear()
    return marks, known, total


def near_duplicates(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id, fp (long), component_id (the smallest doc_id that links reach, its own included) for each row.

    A fingerprint is the SimHash over the text's shingles (XXH64, seed 42; A-Z lower-cased; words end at
    ASCII white space; repeats count). A bit is set if over half the shingles set it. A text of fewer words
    is one shingle, one without words or null has fingerprint 0 and links like any other. Fingerprints
    link at 4 or fewer differing bits; links carry on (components). Rows of equal texts share a fingerprint,
    and repeated rows come out repeated. A null doc_id never is a component's smallest id, unless all of
    them are null: then component_id is null. Ids may be of any type that orders. Other columns of df are not read. An
    empty table gives none.

    The texts are read once. What follows works on distinct fingerprints, so copies cost nothing there; rows of a
    frequent fingerprint are not shuffled.
    """
    marks, known, total = _resolved(df, doc_id, text, shingle)
    return hot_join(marks, known, "fp", total).select("doc_id", "fp", "component_id")


def drop_near_duplicates(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """One row of each component stays, with all its columns: the one with the smallest id.

    Null ids come last; of rows with the same id the one with the least text CRC stays, of rows that are
    the same in both any one.
    """
    marks, known, total = _resolved(df, doc_id, text, shingle)
    return keep_least(df, hot_join(marks, known, "fp", total), doc_id, text)


def keep_least(df: DataFrame, known: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Of the rows of df one for each label; known: label, doc_id, _k1, _k2 of each row."""
    each = known.select("label", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k2", "_k1").alias("row"))
    keep = each.groupBy("label").agg(F.min("row").alias("row")).select("row._k1", "row._k2").distinct()
    rest = list(dict.fromkeys((doc_id, text)))
    held = stashed(df, *rest)
    held = held.withColumns({f"_k{i + 1}": k for i, k in enumerate(row_key(doc_id, text))})
    return unstashed(held.join(keep, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]), df, *rest)

"""Near copies by the Jaccard similarity of word shingles: Golay keys of SimHash fingerprints, and MinHash bands for what is
further apart, name candidates; the sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from lexframe.llm._buckets import linked
from lexframe.llm._common import SPACE_WORDS, Scratch, bounded_batches, hot_join, lower_ascii, mix, row_key, texts_of, tidy, window_hashes, word_hashes, word_spans, written
from lexframe.llm.simhash import golay_keys, keep_least

#: A pair of similarity s shares none of the bands with probability (1 - s ** _ROWS) ** _BANDS: 0.00006 at 0.8.
_BANDS, _ROWS = 32, 6
_RANDOM = np.random.default_rng(20240611)
_TIMES = _RANDOM.integers(0, 1 << 31, size=_BANDS * _ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FLIP = _RANDOM.integers(0, 1 << 32, size=_BANDS * _ROWS, dtype=np.uint32)
_BLOCK = 256


def shingle_set(data: np.ndarray, shingle: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles; a shorter text is one shingle, one without words {0}."""
    data = lower_ascii(data)
    words = word_hashes(data, *word_spans(data, SPACE_WORDS))
    if len(words) == 0:
        return np.zeros(1, dtype=np.uint64)
    n = min(shingle, len(words))
    return np.unique(window_hashes(words, n, n))


def set_key(hashes: np.ndarray) -> np.uint64:
    """64 bits that equal sets have in common."""
    total = mix(hashes ^ np.uint64(0x5BF0A8B1457B1F4D)).sum(dtype=np.uint64)
    return mix(np.array([total ^ np.uint64(len(hashes))], dtype=np.uint64))[0]


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """The MinHash signature of a set."""
    low = (mix(hashes) >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_TIMES), (1 << 32) - 1, dtype=np.uint32)
    for at in range(0, len(low), _BLOCK):
        np.minimum(out, (low[at : at + _BLOCK, None] * _TIMES ^ _FLIP).min(axis=0), out=out)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A row of 64-bit keys for each signature, one a band."""
    parts = signatures.reshape(-1, _BANDS, _ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, _BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for i in range(_ROWS):
        keys = mix((keys << np.uint64(1)) + mix(parts[:, :, i] + np.uint64(1)))
    return keys


def fingerprint_of_set(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of a set of shingle hashes: the bits that over half of them have."""
    votes = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def _marks(keyed: DataFrame, shingle: int) -> DataFrame:
    """_k1, _k2, doc_id, set (key of the text's shingle set), fp (its SimHash), keys (of its bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, prints = np.zeros(batch.num_rows, dtype=np.uint64), np.zeros(batch.num_rows, dtype=np.uint64)
            signatures = np.zeros((batch.num_rows, _BANDS * _ROWS), dtype=np.uint32)
            for i, data in enumerate(texts_of(batch.column("text"))):
                hashes = shingle_set(data, shingle)
                sets[i], prints[i], signatures[i] = set_key(hashes), fingerprint_of_set(hashes), least_hashes(hashes)
            bounds = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * _BANDS)
            keys = pa.ListArray.from_arrays(bounds, pa.array(band_keys(signatures).reshape(-1).view(np.int64)))
            columns = [*(batch.column(c) for c in ("_k1", "_k2", "doc_id")), pa.array(sets.view(np.int64)), pa.array(prints.view(np.int64)), keys]
            yield pa.RecordBatch.from_arrays(columns, ["_k1", "_k2", "doc_id", "set", "fp", "keys"])
        tidy()

    kinds = keyed.schema
    long = T.LongType()
    schema = T.StructType([*(T.StructField(c, kinds[c].dataType) for c in ("_k1", "_k2", "doc_id")), T.StructField("set", long), T.StructField("fp", long), T.StructField("keys", T.ArrayType(long))])
    return keyed.mapInArrow(run, schema)


class _Sets:
    """The shingle sets of the distinct texts, made anew from the texts for those sets that are asked for."""

    def __init__(self, keyed: DataFrame, nodes: DataFrame, shingle: int, similarity: float):
        self.keyed, self.rows, self.shingle, self.similarity = keyed, nodes.select("set", "row"), shingle, similarity

    def hashes(self, needed: DataFrame, held: Scratch) -> DataFrame:
        """needed (set, and other columns; each set once) with hashes (array of longs)."""
        shingle = self.shingle

        @arrow_udf(T.ArrayType(T.LongType()))
        def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in batches:
                each = [shingle_set(x, shingle) for x in texts_of(column)]
                bounds = np.zeros(len(each) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in each], out=bounds[1:])
                yield pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.empty(0, np.uint64), *each]).view(np.int64)))
            tidy()

        rows = held.written(self.rows.join(needed, "set").select(*needed.columns, "row._k1", "row._k2"), "near-needed")
        bodies = self.keyed.select("_k1", "_k2", "text").join(rows, ["_k1", "_k2"]).dropDuplicates(["set"])
        return held.written(bodies.select(*needed.columns, made("text").alias("hashes")), "near-sets")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of sets whose Jaccard similarity, counted on the sets, reaches the bound."""
        held = Scratch(pairs.sparkSession)
        pairs = held.written(pairs, "near-pairs")
        total = pairs.count()
        needed = pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set"))).groupBy("set").agg(F.count("*").alias("_n"))
        sets = self.hashes(needed, held)
        one, two = (sets.select(F.col("set").alias(x), F.col("hashes").alias(f"in_{x}"), "_n") for x in ("a", "b"))
        # _n counts both ends of the pairs, so its sum is twice their number.
        both = hot_join(hot_join(pairs, one, "a", 2 * total), two, "b", 2 * total).withColumn("same", F.size(F.array_intersect("in_a", "in_b")))
        out = written(both.filter(F.col("same") / (F.size("in_a") + F.size("in_b") - F.col("same")) >= self.similarity).select("a", "b"), "near-links")
        held.clear()
        return out

    def measure(self, nodes: DataFrame) -> DataFrame:
        """node, size for nodes (node, label): how many shingles a set has, how many of them are frequent, and those that are rare.

        Only shingles that sets of several labels have are in an overlap across labels, so only they count. Frequent is
        what more than one in 64 of these sets has: a dense group has its common text there, and its edits among the rare.
        """
        held = Scratch(nodes.sparkSession)
        sets = self.hashes(nodes.withColumnRenamed("node", "set"), held)
        each = held.written(sets.select("set", "label", F.explode("hashes").alias("h")), "near-shingles")
        many = max(4, sets.count() // 64)
        known = each.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("_n")).filter("lo < hi").select("h", "_n", F.col("_n").alias("df"))
        met = hot_join(each.select("set", "h"), known, "h", each.count()).groupBy("set").agg(F.count_if(F.col("df") > many).alias("frequent"), F.collect_list(F.when(F.col("df") <= many, F.col("h"))).alias("rare"))
        sizes = sets.select("set", F.size("hashes").alias("every")).join(met, "set", "left")
        none = F.array().cast("array<bigint>")
        size = F.struct("every", F.coalesce("frequent", F.lit(0)).alias("frequent"), F.coalesce("rare", none).alias("rare"))
        out = written(sizes.select(F.col("set").alias("node"), size.alias("size")), "near-sizes")
        held.clear()
        return out

    def fits(self, a: str, b: str) -> Column:
        """Whether two sets can be similar enough: they have the rare shingles in common that both have, and of the
        frequent ones at best as many as the one with fewer."""
        one, two = F.col(a), F.col(b)
        some = F.least(one["frequent"], two["frequent"]) + F.least(F.size(one["rare"]), F.size(two["rare"]))
        most = F.least(one["frequent"], two["frequent"]) + F.size(F.array_intersect(one["rare"], two["rare"]))
        enough = lambda n: n >= F.lit(self.similarity) * (one["every"] + two["every"] - n)
        return F.when(enough(some), enough(most)).otherwise(False)


#: Fingerprints of sets of similarity 0.8 differ in 9.7 of 64 bits on average and, bit for bit, in over 22 with probability
#: 0.00004, those of unrelated texts in 32. Pairs that differ in more are not held against each other.
_MOST_BITS = 22


def _resolved(df: DataFrame, doc_id: str, text: str, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame, int]:
    """(_k1, _k2, doc_id, set) of each row, (set, label, component_id, _n) of each distinct set, the number of rows."""
    spark = df.sparkSession
    bounded_batches(spark)
    held = Scratch(spark)
    keyed = df.select(*row_key(doc_id, text), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marks = written(_marks(keyed, shingle), "near-marks")
    nodes = marks.groupBy("set").agg(F.min("doc_id").alias("least"), F.min(F.struct("_k1", "_k2")).alias("row"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.count("*").alias("_n"))
    nodes = held.written(nodes, "near-nodes")
    total = nodes.agg(F.sum("_n")).first()[0] or 0
    keyed_nodes = nodes.select(F.col("set").alias("node"), F.col("fp").alias("mark"), F.concat("keys", golay_keys(F.col("fp"), every=False)).alias("keys"))
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= _MOST_BITS
    sets = _Sets(keyed, nodes, shingle, similarity)
    labels = linked(keyed_nodes, near, sets.verify, sets.measure, sets.fits)
    joined = held.written(nodes.select("set", "least", "_n").join(labels.withColumnRenamed("id", "set"), "set", "left").withColumn("label", F.coalesce("label", "set")), "near-labels")
    reached = joined.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("_k"))
    known = hot_join(joined.select("set", "label", F.col("_n").alias("_m")), reached.withColumnRenamed("_k", "_n"), "label", joined.count())
    known = written(known.select("set", "label", "component_id", F.col("_m").alias("_n")), "near-known")
    held.clear()
    return marks, known, total


def near_copies(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, component_id (the smallest doc_id that links reach, its own included) for each row.

    Two texts link if the sets of their shingles (runs of `shingle` words, A-Z lower-cased; words end at ASCII
    white space) have a Jaccard similarity of at least `similarity`; links carry on (components). A text of
    fewer words is one shingle, texts without words and nulls are alike. Candidates share a Golay key of their SimHash
    fingerprints (all within 4 bits and with one of three segments the same do) or a MinHash band; keys only name candidates, the sets themselves decide. So no
    pair below the similarity links; of pairs at exactly 0.8 about 0.006 % have no key in common, above it fewer.
    Shingles and sets are known by 64 hash bits. For a lower similarity than 0.8 the keys miss more. Repeated rows come out
    each; a null id is a component's smallest only if all are null; an empty table gives none.
    """
    marks, known, total = _resolved(df, doc_id, text, shingle, similarity)
    return hot_join(marks.select("doc_id", "set"), known, "set", total).select("doc_id", "component_id")


def drop_near_copies(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each component of near_copies() stays, chosen as drop_near_duplicates() does."""
    marks, known, total = _resolved(df, doc_id, text, shingle, similarity)
    return keep_least(df, hot_join(marks.drop("keys", "fp"), known, "set", total), doc_id, text)

"""Benchmark decontamination: Wu-Manber search for word windows of benchmark items in documents."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from lexframe.llm._common import ALNUM_WORDS, Scratch, bounded_batches, lower_ascii, stashed, texts_of, tidy, unstashed, word_hashes, word_spans, written

#: Words of a document that are in work at once.
_CHUNK = 1 << 16


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes of a text, and where its words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` start and end."""
    data = lower_ascii(data)
    return data, *word_spans(data, ALNUM_WORDS)


def _blocks(hashes: np.ndarray) -> np.ndarray:
    """A key for each pair of consecutive words, listed at the second of them."""
    with np.errstate(over="ignore"):
        return hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]


class Matcher:
    """Wu-Manber tables for patterns of `length` words; words are the symbols, two of them a block.

    shift: block -> how far the search may advance when a block of the text ends here; blocks that no
    pattern has allow the most, length - 1. buckets: last block -> the patterns that end in it, each
    with the key of its first block, its bytes and its items.
    """

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, list[tuple[int, bytes, set[str]]]] = {}
        self.known: dict[bytes, set[str]] = {}

    def keys(self, hashes: np.ndarray) -> list[int]:
        """keys[i] is the key of the block that ends at word i (the first is a filler for blocks of two)."""
        return hashes.tolist() if self.block == 1 else [0, *_blocks(hashes).tolist()]

    def add(self, keys: list[int], at: int, text: bytes, item: str) -> None:
        """Add the pattern of words at .. at + length; keys are those of its item."""
        if text in self.known:
            self.known[text].add(item)
            return
        self.known[text] = items = {item}
        end = at + self.length - 1
        for i in range(at + self.block - 1, end + 1):
            self.shift[keys[i]] = min(end - i, self.shift.get(keys[i], self.far))
        self.buckets.setdefault(keys[end], []).append((keys[at + self.block - 1], text, items))

    def find(self, keys: list[int], text) -> Iterator[tuple[int, set[str]]]:
        """(start, items) of each occurrence; text(a, b) gives the words a .. b joined by spaces."""
        shift, far, back, first = self.shift.get, self.far, self.length - 1, self.block - 1
        i, n = back, len(keys)
        while i < n:
            step = shift(keys[i], far)
            if step:
                i += step
                continue
            begin = i - back
            for prefix, pattern, items in self.buckets[keys[i]]:
                if prefix == keys[begin + first] and pattern == text(begin, i + 1):
                    yield begin, items
            i += 1


class Patterns:
    """The matchers of a block of benchmark items: one for the windows, one for each size of shorter items."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.matchers: dict[int, Matcher] = {}
        for item, body in items:
            data, starts, ends = words_of(np.frombuffer((body or "").encode(), np.uint8))
            n = len(starts)
            if not n:
                continue
            size = min(n, window)
            matcher = self.matchers.setdefault(size, Matcher(size))
            keys = matcher.keys(word_hashes(data, starts, ends))
            words = [data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
            for at in range(n - size + 1):
                matcher.add(keys, at, b" ".join(words[at : at + size]), item)

    def search(self, data: np.ndarray) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Of one text: the number of its words, the word spans inside occurrences (merged), the items found."""
        data, starts, ends = words_of(data)
        n = len(starts)
        hashes = word_hashes(data, starts, ends)
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for size, matcher in self.matchers.items():
            for lo in range(0, n - size + 1, _CHUNK):
                part = slice(lo, lo + _CHUNK + size - 1)

                def text(a: int, b: int, lo: int = lo) -> bytes:
                    return b" ".join([data[x:y].tobytes() for x, y in zip(starts[lo + a : lo + b], ends[lo + a : lo + b])])

                for at, found in matcher.find(matcher.keys(hashes[part]), text):
                    items |= found
                    if spans and spans[-1][0] <= lo + at <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], max(spans[-1][1], lo + at + size))
                    else:
                        spans.append((lo + at, lo + at + size))
        return n, spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans without overlaps; those that touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@lru_cache(maxsize=1)
def _patterns(sent: Broadcast, window: int) -> Patterns:
    return Patterns(sent.value, window)


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_spans", _SPANS), T.StructField("items", T.ArrayType(T.StringType()))])
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _search(sent: Broadcast, window: int):
    """An Arrow function text -> n_words, hit_spans, items for one block of items."""

    @arrow_udf(_FOUND)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        patterns = _patterns(sent, window)
        for texts in batches:
            counts, spans, items = [], [], []
            for data in texts_of(texts):
                n, hit, names = patterns.search(data)
                counts.append(n)
                spans.append([{"start": a, "end": b} for a, b in merged(hit)])
                items.append(sorted(names))
            yield pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), pa.array(spans, _ARROW_SPANS), pa.array(items, pa.list_(pa.string()))], ["n_words", "hit_spans", "items"]
            )
        tidy()

    return found


#: Words of an item that stay together; longer ones go to the blocks in pieces that overlap by a window.
_PIECE = 4096


def _pieces(benchmark: DataFrame, item_id: str, item_text: str, window: int) -> DataFrame:
    """name, body: the distinct items, long ones cut into pieces that have every window of theirs in one of them."""
    names = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"), F.coalesce(F.col(item_text), F.lit("")).alias("body")).distinct()
    words = F.regexp_extract_all("body", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    starts = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(_PIECE))
    cut = F.transform(starts, lambda i: F.array_join(F.slice(words, i, _PIECE + window - 1), " "))
    return names.select("name", F.explode(cut).alias("body")).filter("body <> ''").distinct()


def _dealt(pieces: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """pieces with a block, and the number of blocks: doubled until none has over block_bytes, or a single piece each has."""
    size = F.octet_length("body") + F.octet_length("name")
    known = pieces.agg(F.sum(size).alias("all"), F.max(size).alias("most")).first()
    blocks = max(1, math.ceil((known["all"] or 0) / block_bytes))
    while True:
        dealt = pieces.withColumn("block", F.pmod(F.xxhash64("name", "body"), F.lit(blocks)))
        if blocks == 1 or dealt.groupBy("block").agg(F.sum(size).alias("s")).agg(F.max("s")).first()[0] <= max(block_bytes, 2 * known["most"]):
            return dealt, blocks
        blocks *= 2


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """docs with n_words (long), hit_spans (array of word spans start, end, end exclusive) and items (array of strings).

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A pattern is a run
    of `window` words of an item; an item of fewer words is one pattern, one without words none. hit_spans
    covers the document's words inside any occurrence of a pattern, items names the items with an
    occurrence, sorted as strings. Null texts have no words; a null item_id is named ''. Repeated items count once
    by name, repeated documents each. Empty tables have no hits or no rows. Columns of docs stay, whatever their names;
    those of the three names are replaced.

    The items, each once and long ones in pieces, go to the tasks in blocks of block_bytes of text at most (or two
    pieces), so that the tables of a worker and what the driver holds have a bound whatever the size of the benchmark. With
    one block there is one pass and no shuffle. With more, all documents are searched for each block; what is found is
    written by the rows' keys, not the texts, and joined to the documents once.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    held = Scratch(spark)
    items, blocks = _dealt(held.written(_pieces(benchmark, item_id, item_text, window), "benchmark"), block_bytes)
    old = docs.drop("n_words", "hit_spans", "items")
    rows = stashed(old, text)

    def sent(k: int) -> Broadcast:
        return spark.sparkContext.broadcast([(r["name"], r["body"]) for r in items.filter(F.col("block") == k).select("name", "body").toLocalIterator()])

    if blocks == 1:
        found = rows.withColumn("_found", _search(sent(0), window)(F.col(text)))
        held.clear()
    else:
        keys = [F.xxhash64(text, F.lit(1)).alias("_k1"), F.xxhash64(F.lit(2), text).alias("_k2")]
        each = held.written(docs.select(*keys, F.col(text).alias("_text")).dropDuplicates(["_k1", "_k2"]), "distinct-texts")
        parts = None
        for k in range(blocks):
            block = sent(k)
            part = held.written(each.select("_k1", "_k2", _search(block, window)(F.col("_text")).alias("f")), "block-hits")
            block.destroy()
            parts = part if parts is None else parts.unionByName(part)
        gathered = parts.groupBy("_k1", "_k2").agg(F.max("f.n_words").alias("n_words"), F.flatten(F.collect_list("f.hit_spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("f.items")))).alias("items"))
        gathered = written(gathered.select("_k1", "_k2", F.struct("n_words", joined_spans(F.col("spans")).alias("hit_spans"), "items").alias("_found")), "hits")
        held.clear()
        found = rows.withColumns({"_k1": keys[0], "_k2": keys[1]}).join(gathered, ["_k1", "_k2"])
    back = [F.col(c) if c == text else F.col("_row")[c].alias(c) for c in old.columns]
    return found.select(*back, *(F.col("_found")[c].alias(c) for c in ("n_words", "hit_spans", "items")))


def joined_spans(spans: Column) -> Column:
    """An array of spans in order, those that overlap or touch as one."""
    kind = "array<struct<start:int,end:int>>"

    def step(out: Column, x: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(out) > 0) & (x["start"] <= last["end"]), F.array_append(F.slice(out, F.lit(1), F.size(out) - 1), grown)).otherwise(F.array_append(out, x))

    return F.aggregate(F.array_sort(spans).cast(kind), F.array().cast(kind), step)


def hit_words() -> Column:
    """The number of words in hit_spans, as a column."""
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["start"]))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The rows of docs without a word inside an occurrence; all columns as they were, whatever their names.

    Null and empty texts have no words and stay, repeated rows stay or go together; without items all stay.
    """
    found = contamination(stashed(docs, text), benchmark, text=text, **options)
    return unstashed(found.filter(F.size("hit_spans") == 0), docs, text)

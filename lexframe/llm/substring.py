"""Substring dedup: windows of words that repeat, found level by level at doubling lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from lexframe.llm._common import SPACE_WORDS, Scratch, bounded_batches, mix, release_shuffles, row_key, stashed, text_runs, texts_of, tidy, unstashed, window_hashes, word_hashes, word_spans

#: Windows that a task holds before it sums up equal ones and passes them on.
_HELD = 1 << 18
#: The first level's windows are at least this long, unless the windows asked for are shorter.
_BASE = 16

#: h, mark, key, place. A window: 64 bits of its hash; 32 more and its weight; its text's two keys and its
#: start, the second key above the start. Known starts: a number to deal them out by; 64 starts as bits; the
#: same keys, and the first of the 64 starts with bit 31 set. Four numbers, as these rows are most of what is shuffled.
_ROWS = "h long, mark long, key long, place long"
_ARROW = pa.schema([(n, pa.int64()) for n in ("h", "mark", "key", "place")])
_KNOWN, _MASK32 = 1 << 31, (1 << 32) - 1


def level_lengths(length: int, base: int = _BASE) -> list[int]:
    """The lengths of the levels, each at most twice the one before, the last one as given: 35 -> 18, 35."""
    out = [length]
    while (half := -(-out[0] // 2)) >= base:
        out.insert(0, half)
    return out


class _Run:
    """The words of a run of texts, and which window starts stay inside their text."""

    def __init__(self, data: np.ndarray, texts: np.ndarray):
        starts, ends = word_spans(data, SPACE_WORDS)
        self.words = word_hashes(data, starts, ends)
        self.bounds = np.searchsorted(starts, texts)
        counts = np.diff(self.bounds)
        self.text = np.repeat(np.arange(len(counts)), counts)
        self.left = np.repeat(self.bounds[1:], counts) - np.arange(len(starts))

    def inside(self, length: int) -> np.ndarray:
        return np.flatnonzero(self.left >= length)

    def anchors(self, starts: np.ndarray, length: int, base: int) -> np.ndarray:
        """For each window of `length` words, the start in it of the base window with the least hash, leftmost.

        The words alone decide, so windows of equal words have their anchors at the same place inside. The anchors
        of neighbouring windows mostly agree, so there are few of them.
        """
        if length == base or not len(starts):
            return starts
        span = length - base + 1
        least = np.lib.stride_tricks.sliding_window_view(window_hashes(self.words, base), span).argmin(axis=1)
        return starts + least[starts]


class _Sums:
    """Windows of a task, equal ones summed up before they leave it."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, *columns: np.ndarray) -> bool:
        """h, g, k1, k2, pos of some windows; True if it is time to flush."""
        self.parts.append(columns)
        self.held += len(columns[0])
        return self.held >= _HELD

    def flush(self) -> Iterator[pa.RecordBatch]:
        """A row with weight 1 for each window seen once, weight 2 for one of those seen more often.

        The latter are repeated for sure, all of them: their places go out as bits, 64 starts of a text in
        a row. So whatever the number of copies, a task sends few rows of a window.
        """
        if not self.held:
            return
        h, g, k1, k2, pos = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.held = [], 0
        order = np.argsort(h, kind="stable")
        h, g, k1, k2, pos = h[order], g[order], k1[order], k2[order], pos[order]
        first = np.ones(len(h), dtype=bool)
        first[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        heads = np.flatnonzero(first)
        sizes = np.diff(np.append(heads, len(h)))
        weight = np.minimum(sizes, 2).astype(np.int32)
        yield self.batch(h[heads], g[heads].astype(np.int64) << 2 | weight, k1[heads], k2[heads], pos[heads])
        many = np.repeat(sizes > 1, sizes)
        if many.any():
            k1, k2, pos = k1[many], k2[many], pos[many]
            order = np.lexsort((pos, k2, k1))
            k1, k2, pos = k1[order], k2[order], pos[order]
            block = pos >> 6
            new = np.ones(len(pos), dtype=bool)
            new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (block[1:] != block[:-1])
            at = np.flatnonzero(new)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (pos & 63).astype(np.uint64), at).view(np.int64)
            spread = mix(k1[at].view(np.uint64) + block[at].astype(np.uint64)).view(np.int64)
            yield self.batch(spread, bits, k1[at], k2[at], block[at] << 6 | _KNOWN)

    @staticmethod
    def batch(h, mark, k1, k2, pos) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (h, mark, k1, k2 << 32 | pos)], schema=_ARROW)


def _mask(blocks, size: int) -> np.ndarray:
    """Bits by block as a boolean array of `size` entries."""
    out = np.zeros(size + 64, dtype=bool)
    for x in blocks or ():
        at = x["block"] * 64
        if at < size:
            out[at : at + 64] = np.unpackbits(np.array([x["bits"]], dtype="<i8").view(np.uint8), bitorder="little")
    return out[:size]


def _level(docs: DataFrame, length: int, before: int | None, first: bool, base: int, top: int) -> DataFrame:
    """Rows of the windows that may repeat at one length.

    docs: _k1, _k2, text, and blocks (the starts that survived the level before) after the first one.
    """

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for row, data, texts in text_runs(batch.column(2)):
                run = _Run(data, texts)
                if first:
                    starts = np.unique(run.anchors(run.inside(top), top, base))
                else:
                    counts = np.diff(run.bounds)
                    alive = np.concatenate([_mask(batch.column(3)[row + i].as_py(), int(n)) for i, n in enumerate(counts)])
                    starts = run.inside(length)
                    if before == base:
                        starts = starts[alive[run.anchors(starts, length, base)]] if length == top else starts[alive[starts] & alive[starts + length - before]]
                    else:
                        starts = starts[alive[starts] & alive[starts + length - before]]
                if not len(starts):
                    continue
                h = window_hashes(run.words, length)[starts].view(np.int64)
                g = (window_hashes(run.words, length, seed=1)[starts] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                at = run.text[starts]
                if sums.add(h, g, k1[row + at], k2[row + at], starts - run.bounds[at]):
                    yield from sums.flush()
        yield from sums.flush()
        del sums
        tidy()

    return docs.mapInArrow(windows, _ROWS)


def _repeated(rows: DataFrame) -> DataFrame:
    """_k1, _k2, blocks: for each text, the starts of windows that occur at least twice."""
    known = F.col("place").bitwiseAND(F.lit(_KNOWN)) != 0
    same = Window.partitionBy("h", F.shiftright("mark", 2))
    total = F.sum(F.when(known, 0).otherwise(F.col("mark").bitwiseAND(F.lit(3)))).over(same)
    found = rows.withColumn("_n", total).filter(known | (F.col("_n") > 1))
    bits = F.when(known, F.col("mark")).otherwise(F.expr("shiftleft(1L, cast(place & 63 as int))"))
    block = F.shiftright(F.col("place").bitwiseAND(F.lit(~_KNOWN)), 6)
    packed = found.select(F.col("key").alias("_k1"), block.alias("_b"), bits.alias("bits")).groupBy("_k1", "_b").agg(F.bit_or("bits").alias("bits"))
    place = F.struct(F.col("_b").bitwiseAND(F.lit((1 << 26) - 1)).cast("int").alias("block"), "bits")
    return packed.groupBy("_k1", F.shiftrightunsigned("_b", 26).bitwiseAND(F.lit(_MASK32)).alias("_k2")).agg(F.collect_list(place).alias("blocks"))


def repeated_starts(df: DataFrame, *, length: int = 35, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """_k1, _k2 (see row_key), blocks: the starts of all windows of `length` words that occur elsewhere too.

    The first level takes windows of about half of `length` or less (level_lengths). Of those in a longer one it needs the
    anchor only: if a long window repeats, so does its anchor. Windows that repeat at a level alone are extended to twice
    the length (to `length` at last), until the last level or until none is left. For 35 words these are two levels, 18 and
    35: windows of 9 words or fewer repeat in unrelated texts, so a level below costs a shuffle and cuts out little. What
    occurs in a task more than once is summed up there, so a window that a third of the rows share is no hot key. Windows
    count as equal if 96 bits of two hashes agree; among 10^12 windows two unlike ones do with probability 0.000006.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    held = Scratch(spark)
    keyed = df.select(*row_key(doc_id, text), F.coalesce(F.col(text), F.lit("")).alias("text"))
    lengths = level_lengths(length)
    top = lengths[1] if len(lengths) > 1 else length
    found = held.written(_repeated(_level(keyed, lengths[0], None, True, lengths[0], top)), "repeated-windows")
    for k in range(1, len(lengths)):
        if found.isEmpty():
            break
        release_shuffles(spark)
        alive = keyed.join(found, ["_k1", "_k2"]).select("_k1", "_k2", "text", "blocks")
        rows = _level(alive, lengths[k], lengths[k - 1], False, lengths[0], top)
        longer = Scratch(spark)
        found = longer.written(_repeated(rows), "repeated-windows")
        held.clear()
        held = longer
        del alive, rows
    release_shuffles(spark)
    return found


_KEPT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])


def _without(length: int):
    @arrow_udf(_KEPT)
    def kept(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, blocks in batches:
            total, removed, out = [], [], []
            for data, found in zip(texts_of(texts), blocks):
                starts, ends = word_spans(data, SPACE_WORDS)
                n = len(starts)
                body = b" ".join(data.tobytes().split())
                covered = 0
                if (found := found.as_py()) and n:
                    hit = np.flatnonzero(_mask(found, n))
                    depth = np.zeros(n + 1, dtype=np.int32)
                    depth[hit] += 1
                    np.subtract.at(depth, np.minimum(hit + length, n), 1)
                    keep = np.cumsum(depth[:n]) == 0
                    covered = int(n - keep.sum())
                    body = b" ".join([w for w, stays in zip(body.split(b" "), keep.tolist()) if stays])
                total.append(n)
                removed.append(covered)
                out.append(body)
            strings = pa.array(out, pa.binary()).cast(pa.string())
            yield pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.array(removed, pa.int64()), strings], ["n_words", "n_removed", "kept"])
        tidy()

    return kept


def remove_repeats(df: DataFrame, *, length: int = 35, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with n_words, n_removed (long) and kept (the words that stay, joined by one space).

    Words end at ASCII white space. Removed is each word that lies in a window of `length` words whose
    sequence also starts anywhere else, in the same text or another; all occurrences go, and all windows are
    judged on the input. Null and short texts lose nothing (null: kept is ''). Rows that are the same twice
    are two places. An empty table gives none. Columns of df stay, whatever their names; those of the three names are
    replaced.
    """
    found = repeated_starts(df, length=length, doc_id=doc_id, text=text)
    old = df.drop("n_words", "n_removed", "kept")
    needed = list(dict.fromkeys((doc_id, text)))
    keyed = stashed(old, *needed)
    keyed = keyed.withColumns({f"_k{i + 1}": k for i, k in enumerate(row_key(doc_id, text))})
    joined = keyed.join(found, ["_k1", "_k2"], "left").withColumn("_kept", _without(length)(F.col(text), F.col("blocks")))
    back = [F.col(c) if c in needed else F.col("_row")[c].alias(c) for c in old.columns]
    return joined.select(*back, *(F.col("_kept")[c].alias(c) for c in ("n_words", "n_removed", "kept")))


def dedup_text(df: DataFrame, *, length: int = 35, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """df with repeated passages cut out of the text (words then joined by one space) and n_chars set anew.

    Texts without a repeat stay as they are, null ones too; of a text that is all repeats '' is left. Repeated rows are
    repeats of each other. n_chars is set in a table that has it; all other columns stay. An empty table stays empty.
    """
    rest = [c for c in dict.fromkeys((doc_id, text, n_chars)) if c in df.columns]
    out = remove_repeats(stashed(df, *rest), length=length, doc_id=doc_id, text=text)
    out = out.withColumn(text, F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(text)))
    return unstashed(out.withColumn(n_chars, F.length(text).cast("long")), df, *rest)

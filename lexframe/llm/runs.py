"""Periodic runs of words: a run-length grammar by recompression, and its exact common extensions.

Each text gets a grammar. Rounds of two steps make it: equal neighbours become one block symbol, then neighbours
whose symbols fall into a left and a right class become one pair symbol. Both steps look at symbols alone, so equal
passages get equal symbols but for their edges. How far two places of a text agree, to the right or to the left, is
read off the grammar symbol by symbol, the highest that starts (ends) at both first; blocks count as one step.

A run of period q and length of at least max(shortest, 2 * q) has max(q, shortest - q) neighbouring places whose word
stands q places further on too. So one of them is on the grid of that width, and the sum of all grids is harmonic:
n log n places for a text of n words. Those that hold equal words are extended both ways by the grammar.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexframe.llm._common import bounded_batches, mix, tidy

#: Texts are worked on in groups of about so many words; a longer text is a group of its own.
GROUP_WORDS = 1 << 18
#: Places that are extended at once.
_CHUNK = 1 << 18
#: Rounds after which no level is added. Extensions stay exact, they only take more steps.
_ROUNDS = 200


@dataclass
class _Side:
    """What starts (or ends) at each place on each of its levels, at first[place] + level: symbol, its words, and how
    many of that symbol follow each other from there."""

    symbol: np.ndarray
    words: np.ndarray
    times: np.ndarray


class Grammar:
    """The grammar of a row of symbols; negative ones stand between texts, each once, and are never combined."""

    def __init__(self, row: np.ndarray):
        self.levels = list(_levels(row.astype(np.int64)))
        self.top = np.zeros(len(row), dtype=np.int16)
        for level, (_, starts) in enumerate(self.levels):
            self.top[starts] = level
        self.first = np.zeros(len(row), dtype=np.int64)
        np.cumsum(self.top[:-1] + np.int64(1), out=self.first[1:])
        entries = int(self.first[-1]) + int(self.top[-1]) + 1 if len(row) else 0
        self.right, self.left = (_Side(np.full(entries, -1, np.int32), np.zeros(entries, np.int32), np.zeros(entries, np.int32)) for _ in range(2))
        for level, (symbols, starts) in enumerate(self.levels):
            words = np.diff(starts, append=len(row))
            edge = np.flatnonzero(np.diff(symbols, prepend=symbols[0] - 1))
            size = np.diff(edge, append=len(symbols))
            block = np.repeat(np.arange(len(edge)), size)
            before = np.arange(len(symbols)) - edge[block]
            at = self.first[starts] + level
            for side, put, take, times in ((self.right, at, slice(None), size[block] - before), (self.left, at[1:], slice(None, -1), before + 1)):
                side.symbol[put], side.words[put], side.times[put] = symbols[take], words[take], times[take]
        self.levels = []

    def extend(self, a: np.ndarray, b: np.ndarray, side: _Side, step: int) -> np.ndarray:
        """How many words agree from the places a and b on (step 1, side right) or before them (step -1, side left)."""
        a, b, total = a.copy(), b.copy(), np.zeros(len(a), dtype=np.int64)
        live = np.arange(len(a))
        level = np.minimum(self.top[a], self.top[b]).astype(np.int64)
        while len(live):
            one, two = self.first[a[live]] + level[live], self.first[b[live]] + level[live]
            same = (side.symbol[one] == side.symbol[two]) & (side.symbol[one] >= 0)
            on, down = live[same], live[~same]
            if len(on):
                one, two = one[same], two[same]
                far = np.minimum(side.times[one], side.times[two]).astype(np.int64) * side.words[one]
                total[on] += far
                a[on] += step * far
                b[on] += step * far
                level[on] = np.minimum(self.top[a[on]], self.top[b[on]])
            level[down] -= 1
            live = live[level[live] >= 0]
        return total


def _levels(symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(symbols, where they start) of each level, from the words up, until each text is one symbol."""
    starts = np.arange(len(symbols))
    fresh = int(symbols.max(initial=0)) + 1
    yield symbols, starts
    for round_ in range(_ROUNDS):
        edge = np.flatnonzero(np.diff(symbols, prepend=symbols[0] - 1)) if len(symbols) else starts
        if len(edge) < len(symbols):  # blocks of equal neighbours
            size = np.diff(edge, append=len(symbols))
            symbols, starts = symbols[edge], starts[edge]
            many = np.flatnonzero(size > 1)
            kinds, which = np.unique(symbols[many] << 32 | size[many], return_inverse=True)
            symbols[many] = fresh + which
            fresh += len(kinds)
            yield symbols, starts
        inner = (symbols[:-1] >= 0) & (symbols[1:] >= 0)
        if not inner.any():
            return
        half = (mix(symbols.astype(np.uint64) + (np.uint64(round_ + 1) << np.uint64(40))) & np.uint64(1)).astype(bool)
        pairs = max((inner & (half[:-1] == x) & (half[1:] != x) for x in (False, True)), key=np.count_nonzero)
        lead = np.flatnonzero(pairs)
        if not len(lead):
            continue
        kinds, which = np.unique(symbols[lead] << 32 | symbols[lead + 1], return_inverse=True)
        kept = np.ones(len(symbols), dtype=bool)
        kept[lead + 1] = False
        symbols = symbols.copy()
        symbols[lead] = fresh + which
        fresh += len(kinds)
        symbols, starts = symbols[kept], starts[kept]
        yield symbols, starts


def _least_period(found: np.ndarray) -> np.ndarray:
    """Rows (start, end, period): of those with one start and end the one with the smallest period, in order."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    return found[new]


def runs_of(row: np.ndarray, reach: np.ndarray, shortest: int) -> np.ndarray:
    """Rows (start, end, period) of all runs. reach[q] is where the texts end that are long enough for the period q.

    A stretch that has a period q has its multiples too, as far as they fit twice; all of these are found with the same
    start and end, so the smallest period of a start and end is the run's.
    """
    grammar = Grammar(row)
    out, held, size = [np.empty((0, 3), dtype=np.int64)], [], 0

    def flush() -> None:
        places, periods = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        held.clear()
        ahead = grammar.extend(places, places + periods, grammar.right, 1)
        back = grammar.extend(places, places + periods, grammar.left, -1)
        long = ahead + back >= np.maximum(periods, shortest - periods)
        found = np.stack([places - back, places + periods + ahead, periods], axis=1)[long]
        out[:] = [_least_period(np.concatenate([*out, found]))]

    for q in range(1, len(reach)):
        width = max(q, shortest - q)
        end = int(reach[q])
        hits = np.flatnonzero(row[0 : end - q : width] == row[q:end:width])
        if len(hits):
            held.append((hits * width, np.full(len(hits), q)))
            size += len(hits)
        if size >= _CHUNK:
            flush()
            size = 0
    if held:
        flush()
    return out[0]


def _words(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of all texts, a number for each (equal words, equal numbers), and where each text's begin."""
    lists = pc.split_pattern_regex(pc.fill_null(column.cast(pa.large_string()), ""), pattern="[\\x20\\x09-\\x0D]+")
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    seen = np.zeros(len(flat) + 1, dtype=np.int64)
    np.cumsum(real, out=seen[1:])
    bounds = seen[np.cumsum(np.concatenate([[0], pc.list_value_length(lists).to_numpy(zero_copy_only=False)]).astype(np.int64))]
    flat = flat.filter(pa.array(real))
    return flat, flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), bounds


def _group(numbers: np.ndarray, bounds: np.ndarray, texts: np.ndarray, shortest: int) -> np.ndarray:
    """Rows (text, start, end, period) of the runs of some texts, given from the longest to the shortest."""
    sizes = bounds[texts + 1] - bounds[texts]
    begins = np.cumsum(np.concatenate([[1], sizes[:-1] + 1]))
    row = -1 - np.arange(int(sizes.sum()) + len(texts) + 1)
    for text, begin, size in zip(texts.tolist(), begins.tolist(), sizes.tolist(), strict=True):
        row[begin : begin + size] = numbers[bounds[text] : bounds[text] + size]
    if sizes[0] < shortest:
        return np.empty((0, 4), dtype=np.int64)
    enough = np.maximum(shortest, 2 * np.arange(int(sizes[0]) // 2 + 1))
    many = len(sizes) - np.searchsorted(sizes[::-1], enough, side="left")
    reach = (begins + sizes)[many - 1]
    found = runs_of(row, reach, shortest)
    owner = np.searchsorted(begins, found[:, 0], side="right") - 1
    return np.stack([texts[owner], found[:, 0] - begins[owner], found[:, 1] - begins[owner], found[:, 2]], axis=1)


def batch_runs(column: pa.Array, shortest: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of a column of texts, where each text's begin, and rows (text, start, end, period), ordered, of all runs."""
    flat, numbers, bounds = _words(column)
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] >= shortest]
    groups, found = np.cumsum(sizes[order]) // GROUP_WORDS, [np.empty((0, 4), dtype=np.int64)]
    for group in np.unique(groups):
        found.append(_group(numbers, bounds, order[groups == group], shortest))
    runs = np.concatenate(found)
    return flat, bounds, runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def _spaced(flat: pa.Array, bounds: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by single spaces."""
    seen = np.zeros(len(kept) + 1, dtype=np.int64)
    np.cumsum(kept, out=seen[1:])
    lists = pa.LargeListArray.from_arrays(pa.array(seen[bounds]), flat.filter(pa.array(kept)))
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


_RUN = T.StructType([T.StructField(x, T.LongType(), False) for x in ("start", "length", "period")])


def periodic_runs(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shortest: int = 12) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start and period), collapsed (text) for each row.

    Words end at ASCII white space. A run is a stretch of words that repeats itself with its smallest period, is at
    least twice as long as that and at least `shortest` words, and that no neighbouring word carries on. `collapsed` has
    the words joined by spaces, without those that a run holds after its first period. All runs are found, whatever
    their period, in whole texts.

    Nulls and empty texts have no words, no runs and an empty collapsed text; a null id stays null; repeated rows come out
    each; other columns are not read. A text is worked on in one task: its grammar takes some 100 bytes a word.
    """
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([pa.field(x, pa.int64(), False) for x in ("start", "length", "period")])
        for batch in batches:
            flat, bounds, runs = batch_runs(batch.column("_text"), shortest)
            base = bounds[runs[:, 0]]
            cover = np.zeros(len(flat) + 1, dtype=np.int32)
            np.add.at(cover, base + runs[:, 1] + runs[:, 3], 1)
            np.add.at(cover, base + runs[:, 2], -1)
            starts = np.searchsorted(runs[:, 0], np.arange(batch.num_rows + 1)).astype(np.int32)
            parts = [pa.array(x) for x in (runs[:, 1], runs[:, 2] - runs[:, 1], runs[:, 3])]
            lists = pa.ListArray.from_arrays(pa.array(starts), pa.StructArray.from_arrays(parts, fields=list(kind)))
            collapsed = _spaced(flat, bounds, np.cumsum(cover[:-1]) == 0).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(np.diff(bounds)), lists, collapsed], ["doc_id", "n_words", "runs", "collapsed"])
        tidy()

    schema = T.StructType(
        [
            T.StructField("doc_id", df.schema[doc_id].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("runs", T.ArrayType(_RUN, False)),
            T.StructField("collapsed", T.StringType()),
        ]
    )
    return df.select(df[doc_id].alias("_id"), df[text].cast("string").alias("_text")).mapInArrow(run, schema)

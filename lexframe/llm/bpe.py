"""BPE encoding and decoding with byte-level vocabularies, by a contiguous array of adjacent ranks."""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from lexframe.llm._common import bounded_batches, stashed, tidy

#: The rank of a pair that no merge joins.
NONE = np.int32(2**31 - 1)
#: Words of more bytes than this take the heap, as a scan for each merge is quadratic in them.
SHORT = 64
#: Words of more bytes than this are merged in whole arrays, as a heap would take a hundred times their size.
HUGE = 1 << 16
#: Encoded words that a worker remembers, twice at most.
REMEMBERED = 60_000
#: A word starts anew wherever white space follows another character, so a text may be cut there.
_SAFE = re.compile(r"(?<=\S)(?=[ \n])")
#: The pre-tokenization pattern of byte-level BPE vocabularies of this format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _ranges(test) -> str:
    """The inside of a character class with all characters that pass a test."""
    marks = [test(chr(i)) for i in range(sys.maxunicode + 1)] + [False]
    out, start = [], None
    for i, hit in enumerate(marks):
        if hit and start is None:
            start = i
        elif not hit and start is not None:
            out.append(f"\\U{start:08x}-\\U{i - 1:08x}")
            start = None
    return "".join(out)


@lru_cache(maxsize=1)
def words_pattern() -> re.Pattern:
    """PATTERN for the standard library, whose own classes differ: L, N by category, s without 1C to 1F."""
    letters = _ranges(lambda c: unicodedata.category(c)[0] == "L")
    numbers = _ranges(lambda c: unicodedata.category(c)[0] == "N")
    space = _ranges(lambda c: c.isspace() and c not in "\x1c\x1d\x1e\x1f")
    return re.compile(
        PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]")
        .replace(r"\p{L}", f"[{letters}]")
        .replace(r"\p{N}", f"[{numbers}]")
        .replace(r"(?!\S)", f"(?![^{space}])")
        .replace(r"\s", f"[{space}]")
    )


def safe_pieces(text: str, most: int) -> Iterator[str]:
    """Cut a text into pieces of about `most` characters, only where a token can't span the cut.

    A run without such a place stays whole, however long it is.
    """
    at = 0
    while len(text) - at > most:
        cut = _SAFE.search(text, at + most)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def byte_batches(texts: Iterable[tuple[int, str]], piece_chars: int, batch_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """Group the safe pieces of (row, text) pairs into batches of about equal UTF-8 bytes, whatever the row count."""
    batch: list[tuple[int, str]] = []
    size = 0
    for row, text in texts:
        for piece in safe_pieces(text, piece_chars):
            batch.append((row, piece))
            size += len(piece) if piece.isascii() else len(piece.encode())
            if size >= batch_bytes:
                yield batch
                batch, size = [], 0
    if batch:
        yield batch


class _Pairs:
    """(left id, right id) -> rank for whole arrays: static hash tables, later ones for what collides earlier."""

    BITS = 18

    def __init__(self, left: np.ndarray, right: np.ndarray):
        keys, ranks = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64), np.arange(len(left), dtype=np.int32)
        self.tables = []
        while len(keys):
            mult = np.uint64(0x9E3779B97F4A7C15 + 2 * 0x5851F42D4C957F2D * len(self.tables) & (1 << 64) - 1 | 1)
            slots = self._slots(keys, mult)
            first = np.unique(slots, return_index=True)[1]
            held, value = np.full(1 << self.BITS, (1 << 64) - 1, np.uint64), np.full(1 << self.BITS, NONE, np.int32)
            held[slots[first]], value[slots[first]] = keys[first], ranks[first]
            self.tables.append((mult, held, value))
            keys, ranks = np.delete(keys, first), np.delete(ranks, first)

    def _slots(self, keys: np.ndarray, mult: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * mult >> np.uint64(64 - self.BITS)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        out = np.full(keys.shape, NONE, np.int32)
        for mult, held, value in self.tables:
            slots = self._slots(keys, mult)
            out = np.where(held[slots] == keys, value[slots], out)
        return out


def byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: printable bytes stand for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one byte-level BPE vocabulary (the JSON of the tokenizers library)."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        letters = byte_letters()

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        vocab = data["model"]["vocab"]
        ids = {raw(t): i for t, i in vocab.items() if all(c in letters for c in t)}
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.byte_ids = np.array([ids[bytes([b])] for b in range(256)], dtype=np.uint32)
        pairs = [[raw(x) for x in (p.split(" ") if isinstance(p, str) else p)] for p in data["model"]["merges"]]
        self.pairs = _Pairs(np.array([ids[a] for a, _ in pairs]), np.array([ids[b] for _, b in pairs]))
        self.joined = np.array([ids[a + b] for a, b in pairs], dtype=np.uint32)
        self.by_pair = {(ids[a], ids[b]): rank for rank, (a, b) in enumerate(pairs)}
        spelled = {i: t for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        listed = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        self.blob = np.frombuffer(b"".join(listed), dtype=np.uint8)
        self.sizes = np.array([len(t) for t in listed], dtype=np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def short_words(self, words: np.ndarray) -> list[bytes]:
        """Packed ids of words of equal length, given as a matrix of bytes; all words take a step at once.

        Each word has its parts (the ids between its boundaries) and the ranks of adjacent parts side
        by side. A step scans for the least rank, leftmost first, deletes the boundary there and looks up
        the ranks on both sides anew; every word in work loses one part in a step, so the rows stay even.
        """
        out: list[bytes] = [b""] * len(words)
        rows, parts = np.arange(len(words)), self.byte_ids[words]
        ranks = self.pairs.ranks(parts[:, :-1], parts[:, 1:])
        while len(rows):
            each = np.arange(len(rows))
            if parts.shape[1] > 1:
                at = ranks.argmin(axis=1)
                least = ranks[each, at]
                going = least != NONE
            else:
                going = np.zeros(len(rows), dtype=bool)
            packed, step = parts[~going].astype("<u4").tobytes(), 4 * parts.shape[1]
            for k, row in enumerate(rows[~going].tolist()):
                out[row] = packed[k * step : (k + 1) * step]
            if not going.any():
                break
            rows, parts, ranks, at, least = rows[going], parts[going], ranks[going], at[going], least[going]
            each = each[: len(rows)]
            width = parts.shape[1] - 1
            columns = np.arange(width)
            parts = np.take_along_axis(parts, columns + (columns > at[:, None]), axis=1)
            parts[each, at] = self.joined[least]
            ranks = np.take_along_axis(ranks, columns[:-1] + (columns[:-1] >= at[:, None]), axis=1)
            right, left = at < width - 1, at > 0
            ranks[each[right], at[right]] = self.pairs.ranks(parts[each[right], at[right]], parts[each[right], at[right] + 1])
            ranks[each[left], at[left] - 1] = self.pairs.ranks(parts[each[left], at[left] - 1], parts[each[left], at[left]])
        return out

    def long_word(self, word: bytes) -> bytes:
        """The same for a long word, in time n log n: parts in a linked list, pairs in a heap."""
        n = len(word)
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        rank = self.by_pair.get
        queue = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            r, a, left, right = heapq.heappop(queue)
            b = after[a]
            if not alive[a] or b >= n or ids[a] != left or ids[b] != right:
                continue
            alive[b], after[a], ids[a] = False, after[b], int(self.joined[r])
            if after[a] < n:
                before[after[a]] = a
                if (r := rank((ids[a], ids[after[a]]))) is not None:
                    heapq.heappush(queue, (r, a, ids[a], ids[after[a]]))
            if (p := before[a]) >= 0 and (r := rank((ids[p], ids[a]))) is not None:
                heapq.heappush(queue, (r, p, ids[p], ids[a]))
        return np.array([x for x, here in zip(ids, alive) if here], dtype="<u4").tobytes()

    def huge_word(self, word: bytes) -> bytes:
        """The same for a word of any size, by arrays of a few numbers a byte.

        A merge makes a token whose own merges all come later, so the pairs of one rank can be merged together, from left
        to right, and the ranks in their order. Pairs wait by rank as the places of their left parts.
        """
        n = len(word)
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].astype(np.int32)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        alive = np.ones(n, dtype=bool)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks_due: list[int] = []

        def wait(places: np.ndarray) -> None:
            ranks = self.pairs.ranks(ids[places], ids[after[places]])
            places, ranks = places[ranks != NONE], ranks[ranks != NONE]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, part in zip(ranks[np.r_[0, cuts]].tolist() if len(ranks) else (), np.split(places, cuts)):
                if rank not in waiting:
                    waiting[rank] = []
                    heapq.heappush(ranks_due, rank)
                waiting[rank].append(part)

        wait(np.arange(n - 1, dtype=np.int32))
        while ranks_due:
            rank = heapq.heappop(ranks_due)
            at = np.unique(np.concatenate(waiting.pop(rank)))
            at = at[alive[at]]
            at = at[after[at] < n]
            at = at[self.pairs.ranks(ids[at], ids[after[at]]) == rank]
            if not len(at):
                continue
            # Of pairs that overlap (a run of one token) every second one counts, from the left.
            first = np.ones(len(at), dtype=bool)
            first[1:] = at[1:] != after[at[:-1]]
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0]
            gone = after[at]
            alive[gone] = False
            ids[at] = self.joined[rank]
            after[at] = after[gone]
            inner = at[after[at] < n]
            before[after[inner]] = inner
            left = before[at]
            wait(np.unique(np.concatenate([inner, left[left >= 0]])))
        return ids[alive].astype("<u4").tobytes()

    def learn(self, words: set[str]) -> list[str]:
        """See that self.young has these words; returns those too long to be remembered."""
        if len(self.young) >= REMEMBERED:
            self.old, self.young = self.young, {}
        by_size: dict[int, list[str]] = {}
        raws: dict[int, list[bytes]] = {}
        long = []
        for word in words:
            if word in self.young:
                continue
            if (found := self.old.get(word)) is not None:
                self.young[word] = found
                continue
            raw = word.encode()
            if len(raw) > SHORT:
                self.young[word] = self.long_word(raw) if len(raw) <= HUGE else self.huge_word(raw)
                long.append(word)
            else:
                by_size.setdefault(len(raw), []).append(word)
                raws.setdefault(len(raw), []).append(raw)
        for size, group in by_size.items():
            matrix = np.frombuffer(b"".join(raws[size]), dtype=np.uint8).reshape(-1, size)
            self.young.update(zip(group, self.short_words(matrix)))
        return long

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        find = words_pattern().findall
        split: list[list] = []
        for text in texts:
            if self.split is None or not any(s in text for s in self.special):
                split.append(find(text))
            else:
                split.append([w for x in self.split.split(text) for w in ([(self.special[x],)] if x in self.special else find(x))])
        long = self.learn({w for words in split for w in words if type(w) is str})
        got = self.young.__getitem__
        out = []
        for words in split:
            try:
                out.append(b"".join(map(got, words)))
            except KeyError:
                out.append(b"".join(got(w) if type(w) is str else w[0].to_bytes(4, "little") for w in words))
        for word in long:
            del self.young[word]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; ids without a token give nothing, broken UTF-8 the replacement character."""
        out = []
        for at in range(0, len(ids), 1 << 18):
            each = np.frombuffer(ids[at : at + (1 << 18)], dtype="<u4").astype(np.int64)
            each = each[each < len(self.sizes)]
            sizes = self.sizes[each]
            ends = np.cumsum(sizes)
            take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.offsets[each] - (ends - sizes), sizes)
            out.append(self.blob[take].tobytes())
        return b"".join(out).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec_of(spec: str) -> Codec:
    """The codec of a vocabulary file's contents, made once in each Python worker."""
    return Codec(spec)


def _arrays(values: Iterable, kind: pa.DataType, most: int = 1 << 24) -> pa.Array:
    """An Arrow array of strings or bytes, built in runs of about `most` bytes."""
    done, run, size = [], [], 0
    for value in values:
        run.append(value)
        size += len(value)
        if size >= most:
            done.append(pa.array(run, kind))
            run, size = [], 0
    done.append(pa.array(run, kind))
    return pa.concat_arrays(done)


def encoded(codec: Codec, column: pa.Array, piece_chars: int = 32_768, batch_bytes: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(row, ids) for the pieces of an Arrow column of texts, in order; null and empty texts have no piece."""
    rows = ((i, x) for i, v in enumerate(column) if (x := v.as_py()))
    for batch in byte_batches(rows, piece_chars, batch_bytes):
        yield from zip([row for row, _ in batch], codec.batch([piece for _, piece in batch]))


def _ids(codec: Codec, column: pa.Array) -> list[bytes]:
    """The packed ids of each text of a column."""
    whole = [b""] * len(column)
    for row, pieces in groupby(encoded(codec, column), key=lambda x: x[0]):
        whole[row] = b"".join(x for _, x in pieces)
    return whole


_BOTH = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])


class Bpe:
    """Spark columns of one vocabulary: encode(text), decode(ids) and both at once, ids packed as little-endian uint32."""

    def __init__(self, spark: SparkSession, tokenizer_path: str):
        with open(tokenizer_path, encoding="utf-8") as f:
            self.spec = spark.sparkContext.broadcast(f.read())

    def encode(self, text: Column) -> Column:
        """Binary column of ids. A null text counts as empty and has none; so does an empty one."""
        spec = self.spec

        @arrow_udf("binary")
        def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            codec = codec_of(spec.value)
            for column in batches:
                yield _arrays(_ids(codec, column), pa.binary())
            tidy()

        return ids(text)

    def decode(self, ids: Column) -> Column:
        """The text of a binary column of ids; null gives an empty text."""
        spec = self.spec

        @arrow_udf("string")
        def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            codec = codec_of(spec.value)
            for column in batches:
                yield _arrays((codec.decode(v.as_py() or b"") for v in column), pa.string())

        return text(ids)

    def roundtrip(self, text: Column) -> Column:
        """struct<ids, decoded> in one evaluation, so that a task has one Python worker and not two."""
        spec = self.spec

        @arrow_udf(_BOTH)
        def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            codec = codec_of(spec.value)
            for column in batches:
                whole = _ids(codec, column)
                yield pa.StructArray.from_arrays([_arrays(whole, pa.binary()), _arrays((codec.decode(x) for x in whole), pa.string())], ["ids", "decoded"])
            tidy()

        return both(text)


def bpe_roundtrip(df: DataFrame, tokenizer_path: str, *, text: str = "text") -> DataFrame:
    """df with ids (binary: little-endian uint32), n_tokens (long) and decoded (the text of these ids).

    Every text is encoded whole, however long: its words are, and a word of megabytes takes memory in proportion.
    Special strings in a text become their own ids and decode to themselves. Null counts as empty; repeated rows are
    encoded each; an empty table stays empty. Other columns stay, columns of the three names are replaced. One pass, no
    shuffle.
    """
    bounded_batches(df.sparkSession)
    made = stashed(df.drop("ids", "n_tokens", "decoded"), text).withColumn("_both", Bpe(df.sparkSession, tokenizer_path).roundtrip(F.col(text)))
    rest = [c for c in df.columns if c not in ("ids", "n_tokens", "decoded")]
    columns = [F.col(c) if c == text else F.col("_row")[c].alias(c) for c in rest]
    return made.select(*columns, F.col("_both.ids").alias("ids"), (F.octet_length("_both.ids") / 4).cast("long").alias("n_tokens"), F.col("_both.decoded").alias("decoded"))


def unpack_ids(ids: bytes) -> list[int]:
    """Packed ids as integers."""
    return np.frombuffer(ids, dtype="<u4").tolist()

"""Repair of the structure of conversations by depth-first branch and bound.

A conversation is legal if the initials of its roles read s?(ua)+ or nothing at all. Edits in order of the rows make it
so: Keep a row (costs 0), Rerole it to user or assistant (1), Delete it (2; blank and repeated rows must go), Insert an
empty row of user or assistant (5). A truncated row that isn't deleted costs 5 more. Which role an edit gives is settled
by what stands before it, so the initials of the edits, the audit, say everything.

The search works on one letter a row, never on texts. Long conversations are cut into segments of at most SEGMENT rows:
what a segment costs from each state to each state is a 4 x 4 table, tables are put together backwards, and every
segment is searched by itself, in parallel, with the exact costs of all that follows it at its end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexframe.llm._common import Scratch, bounded_batches, written

#: Rows of a segment are those with one value of row number >> _SHIFT.
_SHIFT = 14
SEGMENT = 1 << _SHIFT

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
_NEVER = 1 << 60

#: What was written last: nothing, a system row, a user's, an assistant's.
_NONE, _SYSTEM, _USER, _ASSISTANT = range(4)
#: What a rerole or an insertion leads to from each of these.
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
#: Where keeping a row leads to, by the row's role (s, u, a, other) and what was written last; None: it can't be kept.
_KEEP = ((_SYSTEM, None, None, None), (_USER, _USER, None, _USER), (None, None, _ASSISTANT, None), (None, None, None, None))
_LEGAL_END = (0, _NEVER, _NEVER, 0)
#: A letter is "A" + 4 * role + fault. Faults: none, blank, duplicate, truncated.
_ROLES, _FAULTS = "sua", ("none", "blank", "duplicate", "truncated")


def _choices(letter: int, state: int) -> list[tuple[str, int, int, int]]:
    """(edit, cost, rows taken, next state) at a row, in the order of the edits' letters."""
    role, fault = divmod(letter, 4)
    out = [("D", DELETE, 1, state), ("I", INSERT, 0, _NEXT[state])]
    if fault in (0, 3):
        stays = TRUNCATED if fault == 3 else 0
        kept = _KEEP[role][state]
        out += [("K", stays, 1, kept)] if kept is not None else []
        out.append(("R", REROLE + stays, 1, _NEXT[state]))
    return out


_CHOICES = [[_choices(letter, state) for state in range(4)] for letter in range(16)]


def _before(choices: list, after: list[int]) -> list[int]:
    """Least cost from each state before a row, given that from each state after it."""
    taken = [min(cost + after[to] for _, cost, rows, to in choices[state] if rows) for state in range(4)]
    return [min(taken[s], INSERT + taken[_NEXT[s]], 2 * INSERT + taken[_NEXT[_NEXT[s]]]) for s in range(4)]


def transfer(letters: str) -> list[int]:
    """Least cost of a segment from each state (row by row) to each state after its last row, as 16 numbers."""
    out = [0] * 16
    for end in range(4):
        costs = [0 if s == end else _NEVER for s in range(4)]
        for letter in reversed(letters):
            costs = _before(_CHOICES[ord(letter) - 65], costs)
        out[end::4] = [min(c, _NEVER) for c in costs]
    return out


def repair_segment(letters: str, state: int, ends: tuple[int, ...], last: bool) -> tuple[int, str, int]:
    """(cost, audit, state at the end) of the cheapest edits of a segment's rows, of these the ASCII-least audit.

    `ends` is what each state costs after the last row. Rows can be inserted after it only in a conversation's last
    segment; else they belong to the next one, so that no audit is the beginning of another.

    Suffix lower bounds: the cost of the rows from i on from each state, with the end relaxed to its cheapest state.
    Incumbent: at first what following the least bound leads to; then any better (cost, audit). Children are taken in
    the order of their letters, so audits come in ASCII order, and a node (row, state) that was reached at no higher
    cost before dominates: the earlier prefix is no longer and its audit is less.
    """
    n = len(letters)
    rows = [_CHOICES[ord(x) - 65] for x in letters]
    least_end = min(ends)
    bounds = [[least_end] * 4]
    for choices in reversed(rows):
        bounds.append(_before(choices, bounds[-1]))
    bounds.reverse()
    tail = [[("I", INSERT, 0, _NEXT[s])] if last and ends[s] >= _NEVER else [] for s in range(4)]
    rows.append(tail)

    at, here, cost, audit = 0, state, 0, []
    while at < n or tail[here]:
        edit, more, taken, to = min(rows[at][here], key=lambda x: x[1] + bounds[at + x[2]][x[3]])
        at, here, cost = at + taken, to, cost + more
        audit.append(edit)
    best, found, end = cost + ends[here], "".join(audit), here

    seen = [[_NEVER] * 4 for _ in range(n + 1)]
    path: list[str] = []
    ours = False  # whether the incumbent comes from the search, so that what follows is greater in ASCII
    stack = [(0, state, 0, 0, "")]
    while stack:
        at, here, cost, depth, edit = stack.pop()
        bound = cost + bounds[at][here]
        if bound > best or (ours and bound == best) or cost >= seen[at][here]:
            continue
        seen[at][here] = cost
        if depth:
            path[depth - 1 :] = [edit]
        if at == n and not tail[here]:
            total = cost + ends[here]
            if total < best or (total == best and not ours):
                best, found, end, ours = total, "".join(path[:depth]), here, True
            continue
        for step, more, taken, to in reversed(rows[at][here]):
            stack.append((at + taken, to, cost + more, depth + 1, step))
    return best - ends[end], found, end


_repair_short = lru_cache(maxsize=1 << 14)(repair_segment)


def _searched(letters: str, state: int, ends: tuple[int, ...], last: bool) -> tuple[int, str, int]:
    return (_repair_short if len(letters) <= 64 else repair_segment)(letters, state, ends, last)


def _key(role: Column, text: Column) -> Column:
    """128 bits of a row's role and text."""
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


#: ASCII white space, plainly.
_BLANKS = " \t\n\x0b\x0c\r"


def _plain(df: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """_c, _t, _role, _text, _key: nulls in role and text are one space."""
    words = [F.coalesce(df[x].cast("string"), F.lit(" ")) for x in (role, text)]
    return df.select(df[conv_id].alias("_c"), df[turn].alias("_t"), words[0].alias("_role"), words[1].alias("_text"), _key(*words).alias("_key"))


def _lettered(plain: DataFrame, held: Scratch) -> DataFrame:
    """_c, _t, letter, id of each row; ids run with the conversations, turns (nulls first) and keys, over all partitions."""
    body = F.rtrim(F.col("_text"), F.lit(_BLANKS))
    fault = F.when(body == "", 1).when(~F.substring(body, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    first = F.substring("_role", 1, 1)
    role = reduce(lambda found, x: F.when(first == x, _ROLES.index(x)).otherwise(found), _ROLES, F.lit(3))
    rows = held.written(plain.select("_c", "_t", "_key", role.alias("role"), fault.alias("fault"), F.monotonically_increasing_id().alias("tie")), "repair-rows")
    place = F.struct(F.col("_t").isNotNull().alias("known"), "_t", "tie")
    many = rows.groupBy("_c", "_key").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("_c").alias("_c2"), F.col("_key").alias("_key2"), "first")
    joined = rows.join(many, F.col("_c").eqNullSafe(F.col("_c2")) & (F.col("_key") == F.col("_key2")), "left")
    again = F.when((F.col("fault") != 1) & (F.col("first")["tie"] != F.col("tie")), 2).otherwise(F.col("fault"))
    letter = F.char((F.lit(65) + 4 * F.col("role") + again).cast("long"))
    lettered = held.written(joined.select("_c", "_t", "_key", "tie", letter.alias("letter")), "repair-letters")
    order = [F.col("_c").asc_nulls_first(), F.col("_t").asc_nulls_first(), "_key", "tie"]
    dealt = lettered.repartitionByRange(*order).sortWithinPartitions(*order)
    return held.written(dealt.select("_c", "_t", "letter", F.monotonically_increasing_id().alias("id")), "repair-order")


def _segments(ordered: DataFrame) -> DataFrame:
    """One row for each segment of a conversation: its letters and counts, those across its start too, and segs (how many)."""
    rows = F.array_sort(F.collect_list(F.struct("id", "letter", "_t")))
    faults = [F.count_if((F.ascii("letter") - 65) % 4 == i).alias(x) for i, x in enumerate(_FAULTS) if i]
    made = ordered.groupBy("_c", F.shiftright("id", _SHIFT).alias("seg")).agg(rows.alias("rows"), F.min("_t").alias("lo"), F.max("_t").alias("hi"), *faults)
    letters = F.array_join(F.transform("rows", lambda x: x["letter"]), "")
    turns = F.size(F.array_distinct(F.array_compact(F.transform("rows", lambda x: x["_t"]))))
    made = made.select("_c", "seg", "lo", "hi", *_FAULTS[1:], letters.alias("letters"), turns.alias("turns"))
    made = made.withColumn("initials", F.translate("letters", "ABCDEFGHIJKLMNOP", "ssssuuuuaaaaxxxx"))
    legal = lambda pair: pair.isin("su", "ua", "au")
    pairs = F.filter(F.sequence(F.lit(1), F.length("initials") - 1), lambda i: ~legal(F.substr(F.col("initials"), i, F.lit(2))))
    inside = F.when(F.length("initials") > 1, F.size(pairs)).otherwise(0)
    one, order = Window.partitionBy("_c"), Window.partitionBy("_c").orderBy("seg")
    across = F.coalesce((~legal(F.concat(F.lag(F.substring("initials", -1, 1)).over(order), F.substring("initials", 1, 1)))).cast("int"), F.lit(0))
    shared = F.coalesce((F.lag("hi").over(order) == F.col("lo")).cast("int"), F.lit(0))
    return made.select(
        "_c", "seg", "lo", "hi", *_FAULTS[1:], "letters", (F.col("turns") - shared).alias("turns"), (inside + across).alias("illegal"), F.count("*").over(one).alias("segs")
    )


_FOUND = T.ArrayType(T.StructType([T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType()), T.StructField("end", T.IntegerType())]))


def _search(segments: DataFrame) -> DataFrame:
    """segments (with ends, last, states) and found: (cost, audit, end) from each of the states."""

    @F.arrow_udf(_FOUND)
    def found(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for letters, ends, last, states in batches:
            rows = zip(letters.to_pylist(), ends.to_pylist(), last.to_pylist(), states.to_pylist(), strict=True)
            out = [[dict(zip(("cost", "audit", "end"), _searched(x, s, tuple(e), z), strict=True)) for s in many] for x, e, z, many in rows]
            yield pa.array(out, pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string()), ("end", pa.int32())])))

    return segments.withColumn("found", found("letters", "ends", "last", "states"))


def _with_ends(many: DataFrame) -> DataFrame:
    """The segments of conversations with several of them, with ends (what is to come costs, from each state) and last."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def table(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for letters in batches:
            yield pa.array([transfer(x) for x in letters.to_pylist()], pa.list_(pa.int64()))

    def backwards(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seg", ascending=False)
        ends, out = list(_LEGAL_END), []
        for i, costs in enumerate(group["costs"]):
            out.append([int(x) for x in ends])
            if i == 0:  # rows can be inserted after the last one
                ends = [min(ends[s], INSERT + ends[_NEXT[s]], 2 * INSERT + ends[_NEXT[_NEXT[s]]]) for s in range(4)]
            ends = [min(int(costs[4 * s + e]) + ends[e] for e in range(4)) for s in range(4)]
        return pd.DataFrame({"_c": group["_c"], "seg": group["seg"], "ends": out, "last": [True] + [False] * (len(out) - 1)})

    kind = many.schema["_c"].dataType
    schema = T.StructType([T.StructField("_c", kind), T.StructField("seg", T.LongType()), T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("last", T.BooleanType())])
    ends = many.select("_c", "seg", table("letters").alias("costs")).groupBy("_c").applyInPandas(backwards, schema)
    return many.join(ends.select(F.col("_c").alias("_c2"), F.col("seg").alias("seg2"), "ends", "last"), F.col("_c").eqNullSafe(F.col("_c2")) & (F.col("seg") == F.col("seg2"))).drop("_c2", "seg2")


def _chained(searched: DataFrame) -> DataFrame:
    """Of what was found from each state, for segments of conversations with several, what follows from the segment before."""

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group, state, out = group.sort_values("seg"), _NONE, []
        for ends in group["exits"]:
            out.append(state)
            state = int(ends[state])
        return pd.DataFrame({"_c": group["_c"], "seg": group["seg"], "state": out})

    kind = searched.schema["_c"].dataType
    schema = T.StructType([T.StructField("_c", kind), T.StructField("seg", T.LongType()), T.StructField("state", T.IntegerType())])
    exits = searched.select("_c", "seg", F.transform("found", lambda x: x["end"]).alias("exits")).groupBy("_c").applyInPandas(walk, schema)
    exits = exits.select(F.col("_c").alias("_c2"), F.col("seg").alias("seg2"), "state")
    joined = searched.join(exits, F.col("_c").eqNullSafe(F.col("_c2")) & (F.col("seg") == F.col("seg2")))
    return joined.withColumn("found", F.array(F.element_at("found", F.col("state") + 1)))


_SUMMARY = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _summary(plain: DataFrame) -> DataFrame:
    """_c and _SUMMARY of each conversation, written."""
    held = Scratch(plain.sparkSession)
    segments = held.written(_segments(_lettered(plain, held)), "repair-segments")
    own = [*segments.columns, "found"]
    legal_end = F.array(*(F.lit(x).cast("long") for x in _LEGAL_END))
    one = segments.filter("segs = 1").withColumns({"ends": legal_end, "last": F.lit(True), "states": F.array(F.lit(_NONE))})
    many = _with_ends(segments.filter("segs > 1")).withColumn("states", F.array(*map(F.lit, range(4))))
    chained = _chained(held.written(_search(many), "repair-searched"))
    each = _search(one).select(*own).unionByName(chained.select(*own)).withColumn("best", F.element_at("found", 1))
    gaps = F.coalesce(F.max("hi") - F.min("lo") + 1 - F.sum("turns"), F.lit(0))
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "best.audit"))), lambda x: x["audit"]), "")
    sums = [F.sum(x).cast("long").alias(x) for x in ("blank", "duplicate", "truncated", "illegal")]
    out = written(each.groupBy("_c").agg(gaps.cast("long").alias("gaps"), *sums, F.sum("best.cost").alias("cost"), audit.alias("audit")), "repair-summary")
    held.clear()
    return out


def _streamed(plain: DataFrame, summary: DataFrame) -> DataFrame:
    """Each conversation's summary row, and then its rows in order; a partition holds whole conversations."""
    some = {x: F.lit(None).cast(summary.schema[x].dataType) for x in _SUMMARY}
    heads = summary.withColumn("_head", F.lit(True))
    rows = plain.withColumns(some).withColumn("_head", F.lit(False))
    every = heads.unionByName(rows, allowMissingColumns=True)
    return every.repartition("_c").sortWithinPartitions(F.col("_c").asc_nulls_first(), F.col("_head").desc(), F.col("_t").asc_nulls_first(), "_key")


class _Edits:
    """The edits of one conversation, applied as its rows come by."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, _NONE

    def _written(self) -> str:
        self.state = _NEXT[self.state]
        return "user" if self.state == _USER else "assistant"

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield "I", self._written(), ""

    def applied(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of what a row becomes, after what is inserted before it."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _KEEP["sua".index(role[0])][self.state]
            yield edit, role, text
        elif edit == "R":
            yield edit, self._written(), text


def _runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(x).to_pylist() for x in names), strict=True)


def repair_conversations(df: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows count in the order of their turns, nulls first; rows of one turn in the order of an MD5 of role and text. A null
    role or text is one space; null is a conversation like any other. gaps are the turns left out between the first and
    the last one. A row's first fault counts: blank (no character but ASCII white space), duplicate (role and text seen
    before, known by 128 bits), truncated (the last such character is none of . ! ?). illegal are neighbours whose roles'
    initials aren't su, ua or au. repaired_sha256 is of the repaired `role:text`, joined by newlines. An empty table gives none.

    Rows are dealt by ranges of conversation and turn, so a conversation of any size is cut into parts that are searched
    apart. Only the digest goes through a whole conversation in one task: batch by batch, it never holds the texts.
    """
    bounded_batches(df.sparkSession)
    plain = _plain(df, conv_id, turn, role, text)
    summary = _summary(plain)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: list[tuple] = []
        sums: list[str] = []
        edits, digest, begun = _Edits(""), hashlib.sha256(), False

        def put(parts: Iterator[tuple[str, str, str]]) -> None:
            nonlocal begun
            for _, who, said in parts:
                digest.update((("\n" if begun else "") + f"{who}:{said}").encode())
                begun = True

        def made() -> pa.RecordBatch:
            columns = [pa.array([x[i] for x in heads], batch_kind[i]) for i in range(len(kept))]
            out = pa.RecordBatch.from_arrays([*columns, pa.array(sums, pa.string())], [*kept, "repaired_sha256"])
            heads.clear()
            sums.clear()
            return out

        batch_kind: list = []
        for batch in batches:
            batch_kind = batch_kind or [batch.schema.field(x).type for x in kept]
            for *head, is_head, who, said in _runs(iter([batch]), (*kept, "_head", "_role", "_text")):
                if is_head:
                    if len(heads) > len(sums):
                        put(edits.inserted())
                        sums.append(digest.hexdigest())
                        if len(sums) >= 4096:
                            yield made()
                    heads.append(tuple(head))
                    edits, digest, begun = _Edits(head[-1]), hashlib.sha256(), False
                else:
                    put(edits.applied(who, said))
        if heads:
            put(edits.inserted())
            sums.append(digest.hexdigest())
            yield made()

    kept = ("_c", *_SUMMARY)
    schema = T.StructType([*(summary.schema[x] for x in kept), T.StructField("repaired_sha256", T.StringType())])
    return _streamed(plain, summary).select(*kept, "_head", "_role", "_text").mapInArrow(digests, schema).withColumnRenamed("_c", "conv_id")


def repaired_turns(df: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations themselves: conv_id, position (from 0), edit (K, R or I), role, text.

    Conversations of which nothing is left have no rows. Else as repair_conversations().
    """
    bounded_batches(df.sparkSession)
    plain = _plain(df, conv_id, turn, role, text)
    summary = _summary(plain)
    kind = plain.schema["_c"].dataType

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits, owner, position = _Edits(""), None, 0
        for batch in batches:
            out: list[tuple] = []

            def put(parts: Iterator[tuple[str, str, str]], out: list = out) -> None:
                nonlocal position
                for part in parts:
                    out.append((owner, position, *part))
                    position += 1

            for conv, audit, is_head, who, said in _runs(iter([batch]), ("_c", "audit", "_head", "_role", "_text")):
                if is_head:
                    put(edits.inserted())
                    edits, owner, position = _Edits(audit), conv, 0
                else:
                    put(edits.applied(who, said))
            yield _table(out, batch.schema.field("_c").type)
            held = batch.schema.field("_c").type
        out = []
        if edits.audit:
            for part in edits.inserted():
                out.append((owner, position, *part))
                position += 1
            yield _table(out, held)

    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("position", T.LongType()), *(T.StructField(x, T.StringType()) for x in ("edit", "role", "text"))])
    return _streamed(plain, summary).select("_c", "audit", "_head", "_role", "_text").mapInArrow(turns, schema)


def _table(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["conv_id", "position", "edit", "role", "text"])

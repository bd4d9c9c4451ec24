"""Which of many patterns occur in a text: an inverted index of the words that a pattern can't do without."""

from __future__ import annotations

import json
import re
from zlib import crc32

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of a word that are indexed; a longer word is known by its first ones.
PREFIX = 4
#: Places of the index. Words that share one only make more candidates.
PLACES = 4096
#: So many patterns are tried one by one: to take a text apart into words costs more.
FEW = 32

#: A piece of a pattern: an escape, a class, the beginning or the end of a group, or one character; and how often it may occur.
_PIECE = re.compile(r"(?P<x>\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?[imsux]+\)|\(\?(?:[:=!>]|<[=!])|[()|]|.)(?P<q>[?*+]|\{[0-9,]*\})?[?+]?", re.S)


def alternatives(pattern: str) -> list[list[tuple[str, str]]]:
    """The alternatives of a pattern's outermost level as lists of (piece, quantifier); a whole group is the piece '('."""
    out, depth = [[]], 0
    for m in _PIECE.finditer(pattern):
        x, q = m["x"], m["q"] or ""
        if x.startswith("(") and not re.fullmatch(r"\(\?[imsux]+\)", x):
            depth += 1
        elif x == ")":
            depth -= 1
            if depth == 0:
                out[-1].append(("(", q))
        elif depth == 0 and x == "|":
            out.append([])
        elif depth == 0:
            out[-1].append((x, q))
    return out


def _keys(pieces: list[tuple[str, str]]) -> list[str]:
    """The indexed words that every match of a sequence of pieces holds."""
    found, run, left = [], "", False

    def close(right: bool) -> None:
        if left and (len(run) >= PREFIX or (run and right)):
            found.append(run.lower()[:PREFIX])

    for x, q in pieces:
        optional = q in ("?", "*") or q.startswith(("{0", "{,"))
        if re.fullmatch(r"\w", x, re.A) and not optional:
            run += x
            if q:  # it may go on with the same letter
                close(False)
                run, left = "", False
            continue
        edge = not optional and (x in (r"\b", r"\s", r"\W", "^", "$") or bool(re.fullmatch(r"\\[^\w\s]|[^\w\\.\[(^$]", x, re.A)))
        if x.startswith("(?"):
            continue
        close(edge)
        run, left = "", edge
    close(False)
    return found


def anchors(pattern: str) -> frozenset[str] | None:
    """Words (their first PREFIX letters, lower case) of which each text with the pattern holds at least one; None if none are sure.

    A word counts if an edge stands before it and it has PREFIX letters, or another edge stands behind it. Groups, classes
    and optional pieces give none; the longest word of an alternative is taken.
    """
    if re.search(r"\(\?[a-z]*[ux]|\\[QE]|\[[^\]]*\[", pattern):  # flags that change words, quoting, classes in classes
        return None
    best = [max(_keys(pieces), key=len, default=None) for pieces in alternatives(pattern)]
    return None if None in best else frozenset(best)


def _place(key: str) -> int:
    return crc32(key.encode()) % PLACES


#: A pattern that is a word by itself, perhaps in either case.
_WORD = re.compile(r"(\(\?i\))?\\b([A-Za-z0-9_]+)\\b")


def _tokens(text: Column) -> tuple[Column, Column]:
    """The distinct words of a text, and the runs of ASCII letters, digits and '_' inside those that have other characters too."""
    words = F.array_distinct(F.split(text, r"[^\p{L}\p{M}\p{N}_]+"))
    mixed = F.filter(words, lambda w: F.rlike(w, F.lit(r"[^\x00-\x7F]")))
    return words, F.flatten(F.transform(mixed, lambda w: F.split(w, r"[^A-Za-z0-9_]+")))


def _words_found(tokens: Column, words: list[tuple[int, str, bool]]) -> Column:
    """array<int>: the positions of those of the words (position, word, either case) that are among the tokens."""
    either = any(c for _, _, c in words)
    places: list[list[dict]] = [[] for _ in range(PLACES)]
    for i, word, c in words:
        places[_place(word.lower() if either else word)].append({"i": i, "w": word.lower() if c else word, "c": c})
    index = constant(places, "array<array<struct<i:int,w:string,c:boolean>>>")

    def met(w: Column) -> Column:
        low = F.translate(w, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if either else w
        here = F.get(index, (F.crc32(low.cast("binary")) % PLACES).cast("int"))
        return F.transform(F.filter(here, lambda e: F.when(e["c"], e["w"] == low).otherwise(e["w"] == w)), lambda e: e["i"])

    return F.array_distinct(F.flatten(F.transform(tokens, met)))


def constant(value: object, schema: str) -> Column:
    """A constant of a nested type, in one expression."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def pattern_hits(text: Column, patterns: list[str]) -> Column:
    """array<int>: the positions in `patterns` of those that occur in a text, ascending; none for null.

    A pattern is tried only on texts that hold one of its anchors, so the work goes with the texts' words and the
    candidates, not with texts times patterns. FEW patterns are tried as they are. Patterns without anchors are tried on every text. Patterns that are a word by
    itself are looked up among the text's words, and tried only where they stand beside letters past ASCII. There is no shuffle.
    """
    if len(patterns) <= FEW:
        return F.array_compact(F.array(*(F.when(text.rlike(p), i) for i, p in enumerate(patterns)))) if patterns else F.array().cast("array<int>")
    places: list[list[int]] = [[] for _ in range(PLACES)]
    always: list[int] = []
    words = [(i, m[2], m[1] is not None) for i, p in enumerate(patterns) if (m := _WORD.fullmatch(p))]
    alone = {i for i, _, _ in words}
    for i, pattern in enumerate(patterns):
        if i in alone:
            continue
        keys = anchors(pattern)
        for at in {_place(k) for k in keys or ()}:
            places[at].append(i)
        if keys is None:
            always.append(i)
    held = constant(patterns, "array<string>")
    tried, sure = constant(always, "array<int>"), F.array().cast("array<int>")
    tokens, pieces = _tokens(text)
    if words:
        # Between characters that are no letters, marks, numbers or '_' a word has an edge on either side whatever a pattern
        # takes for one; next to letters past ASCII the pattern itself decides.
        sure, tried = _words_found(tokens, words), F.concat(tried, _words_found(pieces, words))
    if len(always) + len(words) < len(patterns):
        index = constant(places, "array<array<int>>")
        asked = F.array_distinct(F.transform(F.concat(tokens, pieces), lambda w: (F.crc32(F.lower(F.substring(w, 1, PREFIX)).cast("binary")) % PLACES).cast("int")))
        tried = F.concat(tried, F.flatten(F.transform(asked, lambda at: F.get(index, at))))
    hits = F.filter(F.array_distinct(tried), lambda i: F.rlike(text, F.get(held, i)))
    return F.coalesce(F.sort_array(F.array_distinct(F.concat(sure, hits))), F.array().cast("array<int>"))

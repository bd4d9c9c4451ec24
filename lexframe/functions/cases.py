"""Case citations read word by word: a year in brackets, then a fold over the words behind it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexframe.functions.courts import is_court, is_series, wrong_bracket
from lexframe.functions.offsets import let, match_offsets

#: A year from 1800 on, alone in square or round brackets.
BRACKETED_YEAR = r"\[(?:18|19|20)[0-9]{2}\]|\((?:18|19|20)[0-9]{2}\)"
#: What may stand behind a year, piece by piece, each with the white space before it: words with dots, numbers, signs.
_PIECES = r"\s*(?:[A-Za-z][A-Za-z0-9.]*|[0-9][0-9A-Za-z]*|\S)"
#: Characters behind a year that are looked at, and pieces of these.
_REACH, _MOST = 96, 24
#: White space within a citation, words of a name, digits of a number (all that an int holds).
_SPACES, _NAME_WORDS, _DIGITS = 3, 4, 9

#: What the fold waits for.
_VOLUME, _NAME, _NUMBER_READ, _PIN, _PAGE_READ, _PARAGRAPH, _CLOSE, _CLOSED, _TO, _LAST, _LAST_CLOSE, _DONE = range(12)
_FIELDS = {
    "phase": "int", "run": "int", "kept": "int", "core": "int", "words": "int", "volume": "string", "name": "string", "number": "string",
    "page": "string", "held": "string", "pin": "string", "pin_to": "string",
}


def _state(**values: object) -> Column:
    at = {x: values.get(x) for x in _FIELDS}
    return F.struct(*((v if isinstance(v, Column) else F.lit(v)).cast(_FIELDS[x]).alias(x) for x, v in at.items()))


def _step(s: Column, piece: Column) -> Column:
    """The state after one more piece. `kept` is how many characters belong to the citation for certain, `run` all so far."""

    def after(word: Column) -> Column:
        run = s["run"] + F.length(piece)

        def to(phase: int, keep: bool = False, **values: object) -> Column:
            rest = {x: s[x] for x in _FIELDS}
            return _state(**(rest | {"phase": phase, "run": run} | ({"kept": run} if keep else {}) | values))

        is_at = lambda *phases: s["phase"].isin(*phases)
        number, name = word.rlike(f"^[0-9]{{1,{_DIGITS}}}$"), word.rlike("^[A-Za-z]")
        longer = F.when(s["words"] == 0, word).otherwise(F.concat_ws(" ", s["name"], word))
        return (
            F.when(is_at(_DONE), s)
            .when(F.length(piece) - F.length(word) > _SPACES, to(_DONE))
            .when(is_at(_VOLUME) & number & s["volume"].isNull(), to(_VOLUME, volume=word))
            .when(is_at(_VOLUME, _NAME) & name & (s["words"] < _NAME_WORDS), to(_NAME, name=longer, words=s["words"] + 1))
            .when(is_at(_NAME) & number, to(_NUMBER_READ, True, number=word, core=run))
            .when(is_at(_NUMBER_READ) & F.lower(word).isin(",", "at"), to(_PIN))
            .when(is_at(_PIN) & number, to(_PAGE_READ, True, page=word))
            .when(is_at(_PIN, _PAGE_READ) & (word == "["), to(_PARAGRAPH))
            .when(is_at(_PARAGRAPH) & number, to(_CLOSE, held=word))
            .when(is_at(_CLOSE) & (word == "]"), to(_CLOSED, True, pin=s["held"]))
            .when(is_at(_CLOSED) & word.isin("-", "–"), to(_TO))
            .when(is_at(_TO) & (word == "["), to(_LAST))
            .when(is_at(_LAST) & number, to(_LAST_CLOSE, held=word))
            .when(is_at(_LAST_CLOSE) & (word == "]"), to(_DONE, True, pin_to=s["held"]))
            .otherwise(to(_DONE))
        )

    return let(F.regexp_replace(piece, r"^\s+", ""), after)


def _read(mark: Column, behind: Column) -> Column:
    """The citation that begins with a bracketed year, with `behind` after it, as a struct; null if there is none.

    Grammars overlap ('[1977] VR 430' has the form of a neutral citation), so the tables decide: a known court in
    square brackets without a volume is neutral, a known series is a report, however they are spelled. An unknown name in
    capitals is kept: a report if it has a volume, else neutral in form, with a reason. Round brackets need a volume.
    """
    pieces = F.slice(F.regexp_extract_all(F.substring(behind, 1, _REACH), F.lit(_PIECES), F.lit(0)), 1, _MOST)
    start = _state(phase=_VOLUME, run=0, kept=0, words=0)

    def made(s: Column) -> Column:
        bracket = F.when(mark.startswith("["), "square").otherwise("round")
        known_court, series = is_court(s["name"]), is_series(s["name"])
        court = (bracket == "square") & s["volume"].isNull() & known_court
        report = ~court & series
        capitals = s["name"].rlike(r"^[A-Z]\S*(?: [A-Z]\S*)*$")
        kind = F.when(court, "neutral").when(report | s["volume"].isNotNull(), "report").otherwise("neutral")
        reason = F.when(court | (report & ~wrong_bracket(s["name"], bracket)), F.lit(None).cast("string")).when(report, "bracket_style")
        reason = reason.when(s["volume"].isNotNull(), "unknown_series").otherwise("unknown_court")
        fields = F.struct(
            F.concat(mark, F.substr(behind, F.lit(1), s["kept"])).alias("raw"), F.concat(mark, F.substr(behind, F.lit(1), s["core"])).alias("core"), kind.alias("kind"), F.substring(mark, 2, 4).cast("int").alias("year"), bracket.alias("bracket"),
            s["volume"].cast("int").alias("volume"), s["name"].alias("token"), s["number"].cast("int").alias("number"), s["page"].cast("int").alias("page"),
            s["pin"].alias("pin"), s["pin_to"].alias("pin_to"), reason.alias("reason"), F.substr(behind, s["kept"] + 1, F.lit(_REACH)).alias("after"),
        )
        whole = s["number"].isNotNull() & ((bracket == "square") | s["volume"].isNotNull()) & (known_court | series | capitals)
        return F.when(whole, fields)

    return let(F.aggregate(pieces, start, _step), made)


def case_citations(text: Column) -> Column:
    """array<struct<pos, cite>> of the citations of a text, in order; cite has raw, core (raw without a pinpoint), kind, year, bracket, volume, token, number,
    page, pin, pin_to, reason, and after (what follows it)."""
    behind = F.split(text, BRACKETED_YEAR, -1)
    marks = match_offsets(text, BRACKETED_YEAR)
    each = F.zip_with(marks, F.slice(behind, F.lit(2), F.size(marks)), lambda m, b: F.struct(m["pos"].alias("pos"), _read(m["raw"], b).alias("cite")))
    return F.filter(each, lambda x: x["cite"].isNotNull())


def read_citation(raw: Column) -> Column:
    """The fields of a citation given by itself, null if it is none."""
    return _read(F.nullif(F.regexp_extract(raw, f"^(?:{BRACKETED_YEAR})", 0), F.lit("")), F.substr(raw, F.lit(7), F.length(raw)))

"""What a text says of a provision that it cites (X6), read from the words behind and before the citation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexframe.functions.offsets import let

#: Verbs that say what a provision does, with the words that must follow them.
VERBS = (
    ("allow", ""), ("concern", ""), ("confer", ""), ("cover", ""), ("create", ""), ("deal", "with"), ("define", ""), ("entitle", ""), ("establish", ""), ("forbid", ""), ("govern", ""),
    ("impose", ""), ("make", "it an offence to"), ("oblige", ""), ("permit", ""), ("prohibit", ""), ("provide", "for"), ("relate", "to"), ("render", ""), ("require", ""), ("set", "out"),
)
#: Participles of the passive, nouns before 'on' or 'for', what something is made, verbs of saying, and modal verbs.
PARTICIPLES = ("addressed", "banned", "covered", "created", "dealt", "defined", "forbidden", "found", "governed", "imposed", "prohibited", "regulated", "required", "set")
NOUNS = ("ban", "definition", "duty", "obligation", "offence", "prohibition", "provision", "requirement", "rule", "test")
MADE = ("actionable", "offence", "unlawful", "void", "voidable")
SAYING, MODAL = ("provides", "says", "states"), ("can", "cannot", "may", "must", "shall")
NAMED, BEING = ("entitled", "headed", "titled"), ("are", "is", "was", "were")
ABOUT, PLACED = ("about", "against", "for", "of", "on"), ("at", "by", "in", "under")
LINKING, STARTING = ("and", "that", "where", "which"), ("a", "an", "any", "each", "every", "no", "the")
#: Words without content; a claim has two others at least. First words of notes, units and lists, which are none.
FILLERS = (
    "a", "all", "an", "and", "any", "are", "as", "at", "be", "been", "but", "by", "for", "from", "if", "in", "is", "it", "its", "no", "not", "of", "on", "or", "such",
    "that", "the", "their", "then", "there", "this", "to", "was", "were", "which", "who", "whom", "with",
)
NOTES = ("ad", "am", "amended", "ch", "cl", "div", "inserted", "para", "pt", "r", "reg", "regs", "rep", "repealed", "rs", "s", "sch", "ss", "substituted")
#: Characters read behind and before a citation, words of a claim, and of what stands before a passive.
BEHIND, BEFORE, MOST_WORDS, SUBJECT_WORDS = 240, 160, 40, 16


def _first(words: Column, test: Callable[[Column], Column]) -> Column:
    """The place (from 1) of the first word that passes, else null."""
    return F.array_min(F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: test(F.get(words, i - 1))))


def _last(words: Column, test: Callable[[Column], Column]) -> Column:
    return F.array_max(F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: test(F.get(words, i - 1))))


def _plain(words: Column) -> Column:
    """Words in lower case without signs around them."""
    return F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"^[^a-z0-9]+|[^a-z0-9]+$", ""))


def _said(words: Column, start: Column, end: Column) -> Column:
    """The words from start to end (from 1, both included) if they describe something, else null."""
    def judged(text: Column) -> Column:
        low = _plain(F.split(text, " "))
        content = F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: (F.length(w) > 1) & ~w.isin(*FILLERS))
        note = low[0].isin(*NOTES) | ((low[0] == "as") & F.get(low, F.lit(1)).isin(*NOTES)) | text.rlike("^[0-9]")
        return F.when((F.length(text) >= 3) & (F.size(content) >= 2) & ~F.coalesce(note, F.lit(False)), text)

    def between(p: Column) -> Column:
        piece = F.array_join(F.slice(words, p["a"], p["b"] - p["a"] + 1), " ")
        bare = F.regexp_replace(piece, r"^[\s\"'‘“]+|[\s\"'‘’“”,]+$", "")
        return F.when((p["a"] >= 1) & (p["b"] >= p["a"]) & (p["b"] - p["a"] < MOST_WORDS), let(bare, judged))

    return let(F.struct(start.alias("a"), end.alias("b")), between)


def _passive(low: Column) -> Column:
    """The place of a form of 'be' right before a participle, within reach of the beginning."""
    return F.array_min(F.filter(F.sequence(F.lit(2), F.greatest(F.size(low) - 1, F.lit(2))), lambda i: F.get(low, i - 1).isin(*BEING) & F.get(low, i).isin(*PARTICIPLES) & (i <= SUBJECT_WORDS)))


def _claim(text: Column, source: str) -> Column:
    return let(text, lambda t: F.when(t.isNotNull(), F.struct(t.alias("claim"), F.lit(source).alias("source"))))


def _behind(tail: Column) -> Column:
    """What the rest of the sentence says, by its first sign or word."""
    body = F.regexp_replace(tail, r"^[\s,]+", "")
    comma = tail.rlike(r"^\s?,")

    def read(words: Column) -> Column:
        n = F.size(words)

        def found(low: Column) -> Column:
            k = F.coalesce(_first(low, lambda w: ~w.isin(*LINKING, "is")), F.lit(1))
            return let(k, lambda k: let(F.struct(F.get(low, k - 1).alias("head"), _passive(low).alias("be")), lambda x: from_word(low, k, x["head"], x["be"])))

        def from_word(low_: Column, k: Column, head: Column, be: Column) -> Column:
            verbs = []
            for lemma, more in VERBS:
                follow = more.split()
                met = head.isin(lemma, f"{lemma}s", f"{lemma}es")
                for i, w in enumerate(follow):
                    met = met & (F.get(low_, k + i) == w)
                verbs.append(F.when(met, k + 1 + len(follow)))
            made = _first(low_, lambda w: w.isin(*MADE))
            article = F.when(F.get(low_, made - 2).isin("a", "an"), made - 2).otherwise(made - 1)
            subject = F.when(F.get(low_, F.lit(0)).isin("where", "under"), F.lit(2)).otherwise(F.lit(1))
            modal = _first(low_, lambda w: w.isin(*MODAL))
            says = F.when(F.get(low_, k) == "that", k + 2).otherwise(k + 1)
            quoted = F.coalesce(_first(F.slice(words, k + 1, n), lambda w: w.rlike("[\"'’”][^A-Za-z]*$")), n - k) + k
            return F.coalesce(
                _claim(F.when(head.isin(*NAMED), _said(words, k + 1, quoted)), "titled"),
                _claim(_said(words, F.coalesce(*verbs), n), "verb"),
                _claim(F.when(head.isin("make", "makes"), _said(words, k + 1, article)), "verb"),
                _claim(F.when(comma, _said(words, subject, be - 1)), "verb"),
                _claim(F.when(F.get(low_, F.lit(0)).isin(*STARTING) & (modal <= SUBJECT_WORDS), _said(words, F.lit(1), n)), "proposition"),
                _claim(F.when(head.isin(*SAYING), _said(words, says, n)), "proposition"),
            )

        return let(_plain(words), found)

    inner = F.split(F.regexp_extract(body, r"^\(([^()]*)\)", 1), r"\s+")
    dashed = F.split(F.regexp_extract(body, r"^[:—–-]\s*(.*)$", 1), r"\s+")
    return F.coalesce(
        _claim(let(inner, lambda w: _said(w, F.lit(1), F.size(w))), "parenthetical"),
        _claim(let(dashed, lambda w: _said(w, F.lit(1), F.size(w))), "dash"),
        let(F.split(F.trim(body), r"\s+"), read),
    )


def _before(head: Column) -> Column:
    """What stands before a citation that a preposition leads to: 'the rule on ... in', '... is prohibited by'."""

    def read(words: Column) -> Column:
        def from_word(low: Column) -> Column:
            end = F.size(low) - F.when(F.element_at(low, -1) == "the", 1).otherwise(0)
            led = F.get(low, end - 1).isin(*PLACED)
            noun = F.array_min(F.filter(F.sequence(F.lit(1), F.size(low)), lambda i: F.get(low, i - 1).isin(*NOUNS) & F.get(low, i).isin(*ABOUT)))
            be = F.array_max(F.filter(F.sequence(F.lit(1), F.size(low)), lambda i: F.get(low, i - 1).isin(*BEING) & F.get(low, i).isin(*PARTICIPLES) & (i + 2 >= end - 1)))
            start = F.coalesce(_last(F.slice(low, F.lit(1), F.greatest(be - 1, F.lit(0))), lambda w: w.isin("and", "but")), F.lit(0)) + 1
            return F.when(led, F.coalesce(_claim(_said(words, noun + 2, end - 1), "preceding"), _claim(_said(words, start, be - 1), "preceding")))

        return let(_plain(words), from_word)

    return let(F.split(F.trim(head), r"\s+"), read)


def extract_claim(citations: DataFrame, docs: DataFrame, *, text: str = "text") -> DataFrame:
    """X6. citations (doc_id, raw, pos if there is one) with claim, claim_source: what the text says of the provision.

    The rest of the citation's sentence is read first: in brackets ('parenthetical'), after a dash, 'titled', from a verb
    on, 'makes ... unlawful', 'it is prohibited' (all 'verb'), a full statement ('proposition'); then what stands before the
    citation ('preceding'). Only pieces with two words of content count. pos makes a repeated citation have its own
    claim; without it the first mention counts.
    """
    joined = citations.join(docs.select("doc_id", F.col(text).alias("_t")), "doc_id")
    at = F.col("pos") if "pos" in citations.columns else F.instr(F.col("_t"), F.col("raw")) - 1
    joined = joined.withColumn("_at", at)
    marks = lambda c: F.regexp_replace(c, "[*_`]", "")
    tail = F.regexp_extract(marks(F.substr(F.col("_t"), F.col("_at") + F.length("raw") + 1, F.lit(BEHIND))), r"^[^.;\n]*", 0)
    start = F.greatest(F.col("_at") - BEFORE, F.lit(0))
    head = F.regexp_extract(marks(F.substr(F.col("_t"), start + 1, F.col("_at") - start)), r"[^.;:\n]*$", 0)
    joined = joined.withColumns({"_tail": tail, "_head": head})
    found = F.coalesce(_behind(F.col("_tail")), _before(F.col("_head")))
    return joined.withColumn("_f", found).withColumns({"claim": F.col("_f.claim"), "claim_source": F.col("_f.source")}).drop("_t", "_at", "_tail", "_head", "_f")

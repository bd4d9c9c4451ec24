"""Case and statute citations, provision references and their claims in free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexframe.functions.courts import court_code, court_seat
from lexframe.functions.cases import BRACKETED_YEAR, case_citations, read_citation
from lexframe.functions.claims import extract_claim
from lexframe.functions.names import longest_ending
from lexframe.functions.offsets import let, match_offsets

#: Kinds of provisions, their short form and the words for them, singular and plural. Longer words may have a capital.
UNITS = {
    "section": ("s", ("section",), ("ss", "sections")),
    "regulation": ("reg", ("regulation",), ("regs", "regulations")),
    "clause": ("cl", ("clause",), ("cll", "clauses")),
    "part": ("pt", ("part",), ("pts", "parts")),
    "division": ("div", ("division",), ("divs", "divisions")),
    "chapter": ("ch", ("chapter",), ("chs", "chapters")),
    "schedule": ("sch", ("schedule",), ("schs", "schedules")),
}
#: Kinds that are numbered in Roman numerals too.
ROMAN_KINDS = ("part", "division", "chapter", "schedule")


def _words_of(kinds: tuple[str, ...]) -> str:
    """A pattern for the words of some kinds, the longest first."""
    words = {w for k in kinds for w in (UNITS[k][0], *UNITS[k][1], *UNITS[k][2])}
    return "|".join(w if len(w) < 2 else f"[{w[0].upper()}{w[0]}]{w[1:]}" for w in sorted(words, key=lambda w: (-len(w), w)))


UNIT = rf"(?:{_words_of(tuple(UNITS))})"
#: Upper case, up to 39; letters behind it are a suffix: IVA is IV and A.
ROMAN = r"(?=[IVX])X{0,3}(?:IX|IV|V?I{0,3})"
_SUBS = r"(?:\([0-9A-Za-z]{1,6}\))*"
#: Four digits at most: the first four of a longer number are none.
NUMBER = rf"(?:(?![0-9]{{5}})[0-9]{{1,4}}(?:[.][0-9]{{1,3}})*[A-Z]{{0,3}}(?:-[0-9]{{1,4}}[A-Z]{{0,3}})?{_SUBS}|(?<=\b(?:{_words_of(ROMAN_KINDS)})[.]? ){ROMAN}[A-Z]{{0,3}}(?![A-Za-z]){_SUBS})"
#: Four numbers with dots between are an internet address; only clauses are counted as deep as that, by numbers under 100.
_FOUR = r"[0-9]{1,3}(?:[.][0-9]{1,3}){3}(?![.]?[0-9])"
_CLAUSE = rf"\b(?:{_words_of(('clause',))})[.]? "
_NO_ADDRESS = rf"(?:(?<!{_CLAUSE})(?!{_FOUR})|(?<={_CLAUSE})(?!(?=[0-9.]*[0-9]{{3}}){_FOUR}))"
REFERENCE = rf"\b({UNIT})\.? {_NO_ADDRESS}({NUMBER})"


CITATION_FIELDS = ("kind", "year", "bracket", "volume", "token", "number", "page", "pin", "pin_to", "reason")


def citation_parts(raw: Column) -> dict[str, Column]:
    """The fields of one citation: year, bracket, volume, token, number, page, pin, pin_to, kind and reason; see lexframe.functions.cases."""
    read = read_citation(raw)
    return {x: read[x] for x in CITATION_FIELDS}


def extract_case_citations(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """X2. doc_id, pos, raw and the fields of citation_parts() for each distinct citation text of a document.

    '[2020] HCA 41', '[2020] hca 41', '(1992) 175 CLR 1', '[1977] VR 430', '[2008] 3 All ER 1069', each with a pinpoint
    behind it; pos is that of the first mention. Null texts give none.
    """
    # A cheap test first: most texts have no bracketed year.
    some = docs.filter(F.col(text).rlike(BRACKETED_YEAR))
    rows = some.select("doc_id", F.explode(case_citations(F.col(text))).alias("m")).select("doc_id", "m.pos", "m.cite")
    once = rows.groupBy("doc_id", F.col("cite.raw").alias("raw")).agg(F.min("pos").alias("pos"), F.min_by("cite", "pos").alias("cite"))
    return once.select("doc_id", "pos", "raw", *(F.col(f"cite.{x}").alias(x) for x in CITATION_FIELDS))


#: A word of a title, or several in brackets, and the small words that may stand between.
_CAPITAL = r"[A-Z][A-Za-z'’&-]*"
LINKS = ("and", "of", "the", "for", "to", "in", "on", "with", "by", "from", "or", "a", "an", "at")
_LINK = rf"(?:{'|'.join(LINKS)})"
TITLE_WORDS = rf"(?:(?:{_CAPITAL}|\({_CAPITAL}(?: (?:{_LINK}|{_CAPITAL}))*\)),? (?:{_LINK} ){{0,3}})"
LAW_KINDS = r"(?:Act|Regulations?|Rules|Code|Ordinance)"
#: A full statute citation, 'Widget and Gadget Act 1975 (Cth)': title and year, jurisdiction.
FULL_LAW = rf"({TITLE_WORDS}+{LAW_KINDS} [12][0-9]{{3}})(?: \((Cth|NSW|Vic|Qld|SA|WA|Tas|ACT|NT)\))?"
#: The same without a year.
BARE_LAW = rf"{TITLE_WORDS}+{LAW_KINDS}"


def _roman(n: int) -> str:
    return "X" * (n // 10) + ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")[n % 10]


def _looked_up(of: dict, key: Column) -> Column:
    """What a small table has for a key, null if it has none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in of.items() for x in pair)), key)


def roman_value(numeral: Column) -> Column:
    """The number of an upper-case Roman numeral up to XXXIX, else null."""
    return _looked_up({_roman(n): n for n in range(1, 40)}, numeral)


_KIND_OF = {w: k for k, (short, one, many) in UNITS.items() for w in (short, *one, *many)}
_PLURALS = tuple(w for _, _, many in UNITS.values() for w in many)


#: What stands between the groups of a reference that was taken apart.
_MARK = "\x01"


def parse_ref(ref: Column) -> Column:
    """X4. struct<kind, number, suffix, subsections, plural, schedule, range_end, value> of a provision reference, null if it is none.

    'sch 2 s 134A(1)' has schedule 2, number 134, suffix A, subsections [1]; 'reg 3.01' the number 3.01; 'Part IVA' the number
    IV, suffix A, value 4. 's 355-25' is one provision; a hyphen is a range only behind a plural and between numbers
    that go up: 'ss 5-7' has number 5, range_end 7. Roman numerals are in upper case.
    """
    head = rf"^(?:[Ss]ch(?:edule)? ([0-9]+[A-Z]*),? )?({UNIT})[.]? "
    arabic = head + rf"([0-9]{{1,4}}(?:[.][0-9]{{1,3}})*)(?:-([0-9]{{1,4}}))?([A-Z]{{0,3}})({_SUBS})$"
    roman = head.replace(UNIT, f"(?:{_words_of(ROMAN_KINDS)})") + rf"({ROMAN})()([A-Z]{{0,3}})({_SUBS})$"
    parts = ("schedule", "unit", "number", "high", "suffix", "subs")

    def groups(pattern: str) -> Column:
        # One pass for all groups: a reference is put down as its groups, each with a mark behind it that no reference has.
        listed = F.regexp_replace(ref, pattern, "".join(f"${i + 1}{_MARK}" for i in range(len(parts))))
        made = let(F.split(listed, _MARK), lambda g: F.when(F.size(g) > len(parts), F.struct(*(F.nullif(F.get(g, F.lit(i)), F.lit("")).alias(x) for i, x in enumerate(parts)))))
        return F.when(~F.contains(ref, F.lit(_MARK)), made)

    def made(g: Column) -> Column:
        unit, span = F.lower(g["unit"]), g["high"].try_cast("int") - g["number"].try_cast("int")
        ranges = F.coalesce(unit.isin(*_PLURALS) & span.between(1, 200), F.lit(False))
        number = F.when(g["high"].isNull() | ranges, g["number"]).otherwise(F.concat(g["number"], F.lit("-"), g["high"]))
        value = F.coalesce(g["number"].try_cast("int"), roman_value(g["number"]))
        subsections = F.regexp_extract_all(F.coalesce(g["subs"], F.lit("")), F.lit(r"\(([^()]+)\)"), F.lit(1))
        return F.when(
            g.isNotNull(),
            F.struct(
                _looked_up(_KIND_OF, unit).alias("kind"), number.alias("number"), g["suffix"].alias("suffix"), subsections.alias("subsections"), unit.isin(*_PLURALS).alias("plural"),
                g["schedule"].alias("schedule"), F.when(ranges, g["high"]).alias("range_end"), F.when(g["high"].isNull() | ranges, value).alias("value"),
            ),
        )

    return let(F.coalesce(groups(arabic), groups(roman)), made)


def format_ref(ref: Column) -> Column:
    """The canonical text of a parsed reference; parse_ref of it gives the same again (singular, but for a range)."""

    def made(r: Column) -> Column:
        short = F.when(r["range_end"].isNull(), _looked_up({k: v[0] for k, v in UNITS.items()}, r["kind"])).otherwise(_looked_up({k: v[2][0] for k, v in UNITS.items()}, r["kind"]))
        subs = F.array_join(F.transform(r["subsections"], lambda x: F.concat(F.lit("("), x, F.lit(")"))), "")
        head = F.coalesce(F.concat(F.lit("sch "), r["schedule"], F.lit(" ")), F.lit(""))
        return F.concat(head, short, F.lit(" "), r["number"], F.coalesce(F.concat(F.lit("-"), r["range_end"]), F.lit("")), F.coalesce(r["suffix"], F.lit("")), subs)

    return let(ref, made)


def extract_refs(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """X5. doc_id, pos, raw, ref (canonical) for each provision reference in a text."""
    rows = docs.select("doc_id", F.explode(match_offsets(F.col(text), REFERENCE)).alias("m")).select("doc_id", "m.pos", "m.raw")
    return rows.withColumn("ref", format_ref(parse_ref(F.regexp_replace("raw", r"\. ", " "))))


#: Words that begin a sentence before a law's name, and are no part of it.
NO_NAME = ("See", "Under", "In", "The", "By", "And", "But", "Cf", "Per", "For", "From", "With", "That", "Then", "Also", "Both", "Where", "While", "Since", "If", "As", "To", "Of", "On", "At", "This")


def law_title(name: Column) -> Column:
    """What a run of title words names when no register says it: without words that begin a sentence, and from the last
    'and the' (or, by, in, with, for, to, on, at) on, which parts a law from what is named before it."""
    bare = F.regexp_replace(name, rf"^(?:(?:{'|'.join(NO_NAME)}) (?:{_LINK} )*)+", "")
    return F.regexp_replace(bare, r"^.* (?:and|or|by|in|with|from|at|for|to|on) the ", "")


_law = law_title


def _stateless(docs: DataFrame, starts: Column, text: str, whole: str) -> DataFrame:
    """What extract_statute_citations() reads of a stream: each reference with the last full citation before it and its short name's law.

    A stream keeps no state and has no window, so the full citations of a paragraph and the short names of a text go with their references.
    """
    named = FULL_LAW + r" \((?:the )?['\"‘“]([^'\"’”()]{2,40})['\"’”]\)"
    part = lambda raw, pattern, i: F.nullif(F.regexp_extract(raw, pattern, i), F.lit(""))
    shorts = F.transform(F.regexp_extract_all(F.col(text), F.lit(named), F.lit(0)), lambda x: F.struct(F.lower(F.regexp_replace(part(x, named, 3), "^[Tt]he ", "")), F.struct(_law(part(x, named, 1)), part(x, named, 2))))
    told = docs.select("doc_id", F.col(text), starts.alias("starts"), shorts.cast("array<struct<short:string,law:struct<law_name:string,jurisdiction:string>>>").alias("defined"))
    paras = told.select("doc_id", "defined", F.posexplode(F.arrays_zip(F.split(F.col(text), r"\n\s*\n", -1).alias("body"), F.col("starts").alias("start"))).alias("para", "p")).select("doc_id", "defined", "para", "p.body", "p.start")
    laws = F.transform(match_offsets(F.col("body"), FULL_LAW), lambda m: F.struct(m["pos"], part(m["raw"], FULL_LAW, 1), part(m["raw"], FULL_LAW, 2))).cast("array<struct<pos:int,law:string,law_jur:string>>")
    paras = paras.filter(F.col("body").rlike(REFERENCE)).withColumn("laws", laws)
    rows = paras.select("doc_id", "defined", "para", "start", "laws", F.explode(match_offsets(F.col("body"), whole)).alias("m"))
    last = F.try_element_at(F.filter("laws", lambda x: x["pos"] <= F.col("m.pos")), F.lit(-1))
    return rows.select("doc_id", "defined", "para", F.col("m.pos").alias("pos"), (F.col("start") + F.col("m.pos")).alias("at"), F.col("m.raw").alias("raw"), F.struct(last["law"].alias("law"), last["law_jur"].alias("law_jur")).alias("last"))


def short_forms(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """doc_id, short, law_name, jurisdiction: the short names that a document gives to laws, 'Widget Act 1975 (Cth) (the "WA")'."""
    named = FULL_LAW + r" \((?:the )?['\"‘“]([^'\"’”()]{2,40})['\"’”]\)"
    rows = docs.filter(F.col(text).rlike(r"\((?:the )?['\"‘“]")).select("doc_id", F.posexplode(F.regexp_extract_all(F.col(text), F.lit(named), F.lit(0))).alias("n", "raw"))
    part = lambda i: F.nullif(F.regexp_extract("raw", named, i), F.lit(""))
    rows = rows.select("doc_id", "n", F.lower(F.regexp_replace(part(3), "^[Tt]he ", "")).alias("short"), _law(part(1)).alias("law_name"), part(2).alias("jurisdiction"))
    return rows.groupBy("doc_id", "short").agg(F.min_by(F.struct("law_name", "jurisdiction"), "n").alias("x")).select("doc_id", "short", "x.*")


_LISTED = rf"[0-9]{{1,4}}(?:[.][0-9]{{1,3}})*[A-Z]{{0,3}}(?:-[0-9]{{1,4}}[A-Z]{{0,3}})?{_SUBS}|\b{ROMAN}[A-Z]{{0,3}}\b{_SUBS}"


def _each_number(list_text: Column, plural: Column) -> Column:
    """The provision numbers of '1, 2 and 5-7' as an array; a range of whole numbers that goes up is spelled out after a plural."""
    # Behind the first number a Roman one has no unit before it, so each is taken as what stands between the commas.
    items = F.regexp_extract_all(list_text, F.lit(rf"((?:{_LISTED})(?: to (?:{_LISTED}))?)"), F.lit(1))

    def spread(x: Column) -> Column:
        low, high = (F.regexp_extract(x, r"^(\d{1,4})(?:-| to )(\d{1,4})$", i).try_cast("int") for i in (1, 2))
        fits = plural & (low < high) & (high - low <= 200)
        return F.when(F.coalesce(fits, F.lit(False)), F.transform(F.sequence(low, high), lambda n: n.cast("string"))).otherwise(F.array(F.regexp_replace(x, " to .*$", "")))

    return F.flatten(F.transform(items, spread))


def extract_statute_citations(docs: DataFrame, aliases: DataFrame | None = None, titles: DataFrame | None = None, *, text: str = "text") -> DataFrame:
    """X3. doc_id, para, pos, item, at, raw, ref, law_name, jurisdiction, attached_by: a row for each provision that a text cites.

    pos counts in the paragraph para, at in the whole text; raw is all that was read, item the provision's number in it.
    Lists and ranges after a plural ('ss 1, 2 and 5-7') become a row each. The law, and attached_by, in this order: a full
    citation right before the reference (trailing-cite); the last full citation in the same paragraph for 'the Act' before
    or 'of the Act' behind it (anaphora; null if there is none); a title or an alias after 'of the' (leading-cite); a name
    before it that the document has defined (short-form); a title without a year (bare-name); an alias (abbreviation). Others
    have no law (none). aliases: alias, official, jurisdiction. titles: name; a run of title words that ends with names of this
    register is the longest of them, as the register spells it, so of 'Consumer Act 2010' and 'Competition and
    Consumer Act 2010' the one that stands there is meant. Without a register (or for names not in it) see law_title().
    """
    breaks = match_offsets(F.col(text), r"\n\s*\n")
    starts = F.concat(F.array(F.lit(0)), F.transform(breaks, lambda b: b["pos"] + F.length(b["raw"])))
    paras = docs.select("doc_id", F.posexplode(F.arrays_zip(F.split(F.col(text), r"\n\s*\n", -1).alias("body"), starts.alias("start"))).alias("para", "p")).select("doc_id", "para", "p.body", "p.start")
    # A cheap test first: few paragraphs have a reference, and the whole grammar is costly on those without.
    paras = paras.filter(F.col("body").rlike(REFERENCE))
    more = rf"(?:(?:, | and |, and | to ){NUMBER})*"
    lead = rf"(?:({FULL_LAW}|[Tt]he Act|{BARE_LAW}|[A-Z][A-Za-z]+),? )?"
    behind = rf"(?: (?:of|in|under) (?:the|this) ({TITLE_WORDS}*(?:{LAW_KINDS}|Constitution)\b(?: [12][0-9]{{3}})?(?: \((?:Cth|NSW|Vic|Qld|SA|WA|Tas|ACT|NT)\))?|[A-Z]{{2,8}}\b))?"
    whole = rf"{lead}{REFERENCE}({more}){behind}"
    if docs.isStreaming:
        rows = _stateless(docs, starts, text, whole)
    else:
        rows = paras.select("doc_id", "para", "start", F.explode(match_offsets(F.col("body"), whole)).alias("m")).select("doc_id", "para", F.col("m.pos").alias("pos"), (F.col("start") + F.col("m.pos")).alias("at"), F.col("m.raw").alias("raw"))
    g = lambda i: F.nullif(F.regexp_extract("raw", whole, i), F.lit(""))
    jurisdiction = lambda c: F.nullif(F.regexp_extract(c, r"\((\w+)\)$", 1), F.lit(""))
    rows = rows.withColumns({"before": g(1), "full": g(2), "jur": g(3), "unit": g(4), "list": F.concat(F.coalesce(g(5), F.lit("")), F.coalesce(g(6), F.lit(""))), "after": g(7)})
    if not docs.isStreaming:
        # 'the Act' may stand before or behind; every full citation counts as an antecedent, whether it has a reference or not.
        laws = paras.select("doc_id", "para", F.explode(match_offsets(F.col("body"), FULL_LAW)).alias("m")).select("doc_id", "para", F.col("m.pos").alias("pos"), F.regexp_extract("m.raw", FULL_LAW, 1).alias("law"), F.nullif(F.regexp_extract("m.raw", FULL_LAW, 2), F.lit("")).alias("law_jur"))
        both = rows.unionByName(laws.select("doc_id", "para", "pos", F.struct("law", "law_jur").alias("_law")), allowMissingColumns=True)
        sofar = Window.partitionBy("doc_id", "para").orderBy("pos", F.col("_law").isNull().cast("int")).rowsBetween(Window.unboundedPreceding, -1)
        rows = both.withColumn("last", F.last("_law", ignorenulls=True).over(sofar)).filter("_law is null").drop("_law")
    that = F.lower("before").eqNullSafe("the act") | F.col("after").eqNullSafe("Act")
    rows = rows.withColumns({"that": that, "name": F.lower(F.when(~F.lower("before").eqNullSafe("the act"), F.col("before"))), "other": F.lower("after")})
    if docs.isStreaming:
        rows = rows.withColumn("short", F.get(F.filter("defined", lambda x: x["short"] == F.col("name")), F.lit(0))["law"]).drop("defined")
    else:
        defined = short_forms(docs, text=text).select(F.col("doc_id").alias("_d"), F.col("short").alias("_s"), F.struct("law_name", "jurisdiction").alias("short"))
        rows = rows.join(defined, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("name") == F.col("_s")), "left").drop("_d", "_s")
    if aliases is None:
        rows = rows.withColumns({c: F.lit(None).cast("struct<law_name:string,jurisdiction:string>") for c in ("known", "known_after")})
    else:
        table = aliases.groupBy(F.lower("alias").alias("_a")).agg(F.min(F.struct(F.col("official").alias("law_name"), "jurisdiction")).alias("_x"))
        for on, out in (("name", "known"), ("other", "known_after")):
            rows = rows.join(table.select(F.col("_a").alias(f"_{out}"), F.col("_x").alias(out)), F.col(on) == F.col(f"_{out}"), "left").drop(f"_{out}")
    none = F.lit(None).cast("string")
    after_title = F.when(F.col("after").rlike(rf"(?: {LAW_KINDS}\b|Constitution)"), F.col("after"))
    bare = F.when(F.col("before").rlike(rf"^{BARE_LAW}$"), F.col("before"))
    ways = [
        ("trailing-cite", F.col("full").isNotNull(), F.col("full"), F.col("jur")),
        ("anaphora", F.col("that"), F.col("last.law"), F.col("last.law_jur")),
        ("leading-cite", F.col("known_after").isNotNull(), F.col("known_after.law_name"), F.col("known_after.jurisdiction")),
        ("leading-cite", after_title.isNotNull(), F.regexp_replace(after_title, r" \(\w+\)$", ""), jurisdiction(after_title)),
        ("short-form", F.col("short").isNotNull(), F.col("short.law_name"), F.col("short.jurisdiction")),
        ("bare-name", bare.isNotNull(), bare, none),
        ("abbreviation", F.col("known").isNotNull(), F.col("known.law_name"), F.col("known.jurisdiction")),
    ]
    chosen = F.coalesce(*(F.when(test, F.struct(F.lit(n).alias("by"), law.alias("law"), j.alias("jur"))) for n, test, law, j in ways), F.struct(F.lit("none").alias("by"), none.alias("law"), none.alias("jur")))
    unit = F.col("unit")
    single = F.coalesce(_looked_up({w: short for short, _, many in UNITS.values() for w in many}, F.lower(unit)), unit)
    plural = F.lower(unit).isin(*_PLURALS)
    out = rows.select("doc_id", "para", "pos", "at", "raw", chosen.alias("c"), single.alias("_unit"), F.posexplode(_each_number(F.col("list"), plural)).alias("item", "number"))
    ref = format_ref(parse_ref(F.concat("_unit", F.lit(" "), "number")))
    out = out.select("doc_id", "para", "pos", "item", "at", "raw", ref.alias("ref"), F.col("c.law").alias("law_name"), F.col("c.jur").alias("jurisdiction"), F.col("c.by").alias("attached_by"))
    if titles is None:
        return out.withColumn("law_name", law_title(F.col("law_name")))
    named = titles.select("name").unionByName(titles.select(F.regexp_replace("name", " [12][0-9]{3}$", "").alias("name"))).distinct()
    known = longest_ending(out.filter("law_name is not null"), named, asked_by="law_name").select(F.col("raw").alias("_raw"), F.col("name").alias("_name"))
    joined = out.join(known, F.col("law_name") == F.col("_raw"), "left")
    return joined.withColumn("law_name", F.coalesce("_name", law_title(F.col("law_name")))).drop("_raw", "_name")


#: Kinds and labels of later treatment and the phrases that show it; a part in brackets may be left out.
TREATMENTS = (
    ("overruling", "overruled", ("overrule", "overruled", "overruling")),
    ("overruling", "no longer good law", ("no longer good law",)),
    ("overruling", "should not be followed", ("should not be followed", "should no longer be followed")),
    ("overruling", "ought not to be followed", ("ought not (now) to be followed",)),
    ("overruling", "declined to follow", ("decline to follow", "declined to follow", "declining to follow")),
    ("overruling", "wrongly decided", ("wrongly decided",)),
    ("overruling", "not authority", ("should not be regarded as authority",)),
    ("overruling", "no longer authority", ("is no longer authority", "ceased to be authority")),
    ("overruling", "departed from", tuple(f"{v} from (the) {n}" for v in ("depart", "departs", "departed", "departing") for n in ("decision", "reasoning", "holding"))),
    ("overruling", "cannot stand with", ("cannot stand with",)),
    ("doubting", "disapproved", ("disapprove", "disapproved", "disapproves", "disapproving")),
    ("doubting", "doubted", ("doubted", "doubts", "doubtful", "with respect we doubt", "with respect I doubt", "with respect, we doubt", "with respect, I doubt")),
    ("doubting", "not followed", ("not followed",)),
    ("doubting", "distinguished", ("distinguished", "distinguishes", "distinguishing")),
    ("doubting", "per incuriam", ("per incuriam",)),
    ("doubting", "confined to its facts", ("qualified by", "confined to its (own) facts")),
)
#: Phrases of a dissent, and of what several judges say together.
DISSENT = ("dissent", "dissents", "dissented", "dissenting", "in dissent", "I respectfully disagree", "contrary view")
PLURALITY = ("joint judgment", "joint reasons", "the plurality", "the majority", "we would", "in our view", "in our opinion", "the Court held", "the Court concluded")


def phrase_pattern(phrases: tuple[str, ...]) -> str:
    """A pattern for any of some phrases, whatever the case and white space; '(now)' stands for a word that may be missing."""

    def one(phrase: str) -> str:
        words = phrase.split()
        return "".join((rf"(?:{w[1:-1]}\s+)?" if w[0] == "(" else w + (r"\s+" if i + 1 < len(words) else "")) for i, w in enumerate(words))

    return r"(?i)\b(?:" + "|".join(map(one, phrases)) + r")\b"


def treatment_scan(docs: DataFrame, mentions: DataFrame, *, text: str = "text", around: int = 400) -> DataFrame:
    """X10. doc_id, citation, kind, label, near_dissent, near_plurality: treatment words `around` a mention, once each.

    mentions: doc_id, citation, and names (array) of the parties if there are any. Mentions are the citation, the short
    names that the document gives it (X11) and the names; all of them count. The flags are those of the first mention
    whose surroundings have the label.
    """
    asked = mentions.withColumn("names", F.array().cast("array<string>")) if "names" not in mentions.columns else mentions
    asked = asked.groupBy("doc_id", "citation").agg(F.flatten(F.collect_set(F.coalesce("names", F.array().cast("array<string>")))).alias("names"))
    short = case_short_names(docs, text=text).groupBy("doc_id", "citation").agg(F.collect_set("short_name").alias("_short"))
    asked = asked.join(short, ["doc_id", "citation"], "left")
    needles = F.array_distinct(F.concat(F.array("citation"), F.col("names"), F.coalesce("_short", F.array().cast("array<string>"))))
    quoted = F.array_join(F.transform(F.filter(needles, lambda n: F.length(n) >= 3), lambda n: F.concat(F.lit(r"\Q"), n, F.lit(r"\E"))), "|")
    joined = asked.select("doc_id", "citation", F.concat(F.lit("(?i)"), quoted).alias("_p")).join(docs.select("doc_id", F.col(text).alias("_t")), "doc_id").filter(F.rlike("_t", "_p"))
    found = joined.select("doc_id", "citation", "_t", F.explode(match_offsets(F.col("_t"), F.col("_p"))).alias("m"))
    begin = F.greatest(F.col("m.pos") - around, F.lit(0))
    windows = found.select("doc_id", "citation", F.col("m.pos").alias("pos"), F.substr(F.col("_t"), begin + 1, F.col("m.pos") - begin + around).alias("w"))
    hits = F.array_compact(F.array(*[F.when(F.col("w").rlike(phrase_pattern(p)), F.struct(F.lit(k).alias("kind"), F.lit(n).alias("label"))) for k, n, p in TREATMENTS]))
    rows = windows.withColumns({"h": hits, "f": F.struct(F.col("w").rlike(phrase_pattern(DISSENT)).alias("dissent"), F.col("w").rlike(phrase_pattern(PLURALITY)).alias("plurality"))})
    rows = rows.select("doc_id", "citation", "pos", "f", F.explode("h").alias("h"))
    out = rows.groupBy("doc_id", "citation", F.col("h.kind").alias("kind"), F.col("h.label").alias("label")).agg(F.min_by("f", "pos").alias("f"))
    return out.select("doc_id", "citation", "kind", "label", F.col("f.dissent").alias("near_dissent"), F.col("f.plurality").alias("near_plurality"))


#: A short name in brackets and quotes right behind a citation; it may have a part in brackets itself.
_SHORT_NAME = r"^\s?\(['‘\"“]([^'’\"”()]{2,60}(?:\([^()]*\))?)['’\"”]\)"


def case_short_names(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """X11. doc_id, citation, short_name for "(1992) 175 CLR 1 ('Mabo')"."""
    some = docs.filter(F.col(text).rlike(r"\d\]?\s?\(['‘\"“]"))
    rows = some.select("doc_id", F.explode(case_citations(F.col(text))).alias("m")).select("doc_id", F.col("m.cite.core").alias("citation"), F.regexp_extract("m.cite.after", _SHORT_NAME, 1).alias("short_name"))
    return rows.filter("short_name <> ''").distinct()


def split_trailing_citation(title: Column) -> tuple[Column, Column]:
    """X23. (title, citation) of 'Name v Name [2010] XYZ 1'; a null citation if there is none."""
    last = F.try_element_at(case_citations(title), F.lit(-1))
    raw = F.when(F.trim(last["cite"]["after"]) == "", last["cite"]["raw"])
    return F.when(raw.isNull(), title).otherwise(F.rtrim(F.substr(title, F.lit(1), last["pos"]))), raw


def canonical_citation(year: Column, court: Column, number: Column) -> Column:
    """X24. '[2020] HCA 41' from its parts, dots in the court dropped."""
    return F.format_string("[%s] %s %s", year.cast("string"), F.replace(court, F.lit("."), F.lit("")), number.cast("string"))


#: Addresses of decisions, by site.
CASE_PAGE = "https://www.austlii.edu.au/cgi-bin/viewdoc/au/cases/%s/%s/%s/%s.html"
FEDERAL_PAGE = "https://www.judgments.fedcourt.gov.au/judgments/Judgments/fca/%s/%s/%s%s%s"
CITATOR_PAGE = "https://lawcite.austlii.edu.au/cgi-bin/LawCite?cit=%s"


def deep_link(court: Column, year: Column, number: Column, site: str = "cases") -> Column:
    """X24. The address of a decision; null for an unknown court, as an address isn't made up.

    site: 'cases' (every known court), 'federal' (FCA and FCAFC, null for others) or 'citator' (a look-up of the citation).
    """
    code, y, n = court_code(court), year.cast("string"), number.cast("string")
    if site == "cases":
        link = F.format_string(CASE_PAGE, court_seat(code), code, y, n)
    elif site == "federal":
        bench = F.when(code == "FCA", "single").when(code == "FCAFC", "full")
        link = F.when(bench.isNotNull(), F.format_string(FEDERAL_PAGE, bench, y, y, F.lower(code), F.when(F.length(n) < 4, F.lpad(n, 4, "0")).otherwise(n)))
    elif site == "citator":
        link = F.format_string(CITATOR_PAGE, F.replace(F.url_encode(canonical_citation(year, code, number)), F.lit("+"), F.lit("%20")))
    else:
        raise ValueError(f"no such site: {site}")
    return F.when(code.isNotNull() & y.isNotNull() & n.isNotNull(), link)

"""What a question is about: scenarios, dispute domains, expansions, the laws that it names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexframe.functions.citations import LINKS, law_title, phrase_pattern
from lexframe.functions.names import find_names
from lexframe.functions.offsets import match_offsets
from lexframe.operators.joins import JURISDICTIONS, split_jurisdiction
from lexframe.functions.folds import fold_key

#: Written-out names of the jurisdictions, and the token that each stands for.
PLACES = {
    "New South Wales": "NSW", "Victoria": "Vic", "Victorian": "Vic", "Queensland": "Qld", "Western Australia": "WA", "South Australia": "SA",
    "Tasmania": "Tas", "Tasmanian": "Tas", "Northern Territory": "NT", "Commonwealth": "Cth", "federal": "Cth",
}

#: Scenarios in the order in which they are tried (precedence, then as listed): name, task, precedence, phrases.
#: '..' in a phrase stands for up to 40 characters, '*' for the rest of a word, {place} and {year} for one of these.
SCENARIOS = (
    ("compliance", "state_law_compare", 4, tuple(f"{{place}} .. {w} .. {{place}}" for w in ("vs", "versus", "and", "compared to", "compared with"))
        + ("inconsistent", "inconsistency", "covering the field", "harmonised", "harmonized", "model law", "uniform legislation")
        + tuple(f"same in {w} {p}" for w in ("every", "each", "another", "other") for p in ("state", "territory", "jurisdiction"))),
    ("time_travel", "amendment_track", 4, tuple(f"{{year}} {w} {{year}} .. {x}" for w in ("vs", "versus", "and", "to") for x in ("version*", "compilation*", "compare", "comparison", "difference*", "changed"))
        + ("compare .. version*", "comparison of .. version*", "time travel", "between {year} and {year} version*", "between {year} and {year} compilation*", "before and after", "what changed")),
    ("law_system", "law_system", 6, ("law system", "legislative scheme", "legislative hierarchy", "legislative structure", "legislative framework", "statutory scheme", "statutory framework", "how does .. fit together", "how do .. fit together", "structure of the")),
    ("document_review", "document_review", 6, tuple(f"review {w} .. {x}" for w in ("this", "my", "the following", "these") for x in ("contract", "agreement", "clause", "clauses", "deed", "lease", "letter", "advice", "draft", "terms"))
        + ("contract review", "agreement review", "document review", "unfair terms in this", "unfair terms in my", "unfair terms in our", "unfair term in this", "unfair term in my", "unfair term in our")
        + tuple(f"check {w} {x}" for w in ("this", "my") for x in ("contract", "agreement", "lease", "deed"))),
    ("dispute", "dispute_prep", 6, ("dispute prep", "dispute preparation", "litigation strategy", "litigation risk", "litigation prospects", "who hears", "who else hears", "cause of action")
        + tuple(f"prepare (for) (a) {x}" for x in ("dispute", "hearing", "case", "proceeding"))),
    ("delegation", "law_system", 7, ("delegated legislation", "regulation-making power", "regulation making power", "enabling provision", "henry viii clause", "subordinate legislation")),
    ("impact", "law_system", 7, ("consequential amendment*", "flow-on effect*", "flow on effect*", "knock-on", "knock on", "impact analysis", "impact of the amendment*", "ripple effect*")),
    ("customs", "full_research", 8, ("customs", "import", "imports", "importing", "export", "exports", "exporting", "tariff", "excise", "duty rate", "HS code", "tariff classification", "free trade agreement", "rule of origin", "rules of origin")),
    ("procedure", "procedure_detail", 10, ("procedure*", "process", "how do i", "fee", "fees", "form", "forms", "lodge*", "time limit", "time limits", "deadline", "deadlines")),
    ("penalty", "action_basis", 11, ("penalty", "penalties", "fine", "fines", "infringement", "sanction", "pecuniary penalty", "civil penalty", "enforcement action", "contravention")),
    ("eligibility", "action_basis", 11, ("unfair dismissal", "minimum employment period", "ground for", "grounds for", "what power", "what authority", "eligibility for", "eligibility to", "eligibility criteria", "entitlement for", "entitlement to", "entitlement criteria")
        + tuple(f"{b} {w} {x}" for b, w in (("am", "i"), ("are", "we"), ("are", "they")) for x in ("eligible", "entitled", "covered", "protected"))
        + tuple(f"do {w} {x}" for w in ("i", "we", "they") for x in ("qualify", "have a claim"))),
    ("action_plan", "full_research", 12, tuple(f"can {w}" for w in ("i", "we", "they")) + tuple(f"what {v} {w} do" for v in ("can", "should") for w in ("i", "we", "they")) + ("my rights", "what are my options", "am i allowed")),
)

#: Domains of disputes in the order in which they are tried, with their words.
DOMAINS = (
    ("tax", ("tax", "taxation", "gst", "income tax", "deduction*", "assessment*", "ato", "excise", "customs", "duty", "superannuation")),
    ("workplace", ("employ*", "dismissal", "redundan*", "award", "enterprise agreement", "wage*", "underpay*", "fair work", "industrial", "stand down", "standdown")),
    ("privacy", ("privacy", "personal information", "data breach", "surveillance", "oaic", "credit report*")),
    ("competition", ("competition", "cartel*", "misuse of market power", "merger*", "accc", "anticompetitive", "anti-competitive", "price fixing")),
    ("integrity", ("corrupt*", "integrity", "whistleblow*", "public interest disclosure", "nacc", "maladministration")),
    ("public_service", ("aps", "public service", "code of conduct", "merit protection", "promotion review")),
)
#: What else a question asks for, by its words.
EXPANSIONS = (
    ("schedule_fee", ("fee", "fees", "charge", "charges", "penalty", "penalties", "fine", "fines", "infringement*", "levy", "levies", "cost", "costs", "penalty unit", "penalty units")),
    ("schedule_form", ("form", "forms", "approved form", "notice of", "template")),
    ("schedule_table", ("schedule", "schedules", "table", "rate", "rates", "scale", "threshold", "thresholds")),
    ("cases", ("case", "cases", "judgment", "judgments", "judgement", "judgements", "court", "decided", "authority", "precedent", "precedents")),
    ("rulings", ("ruling", "rulings", "interpretation", "interpretations", "guidance", "ato view", "determination", "determinations")),
)
DOLLARS = r"\$\s?[0-9]"


def wording(phrases: tuple[str, ...]) -> str:
    """A pattern for any of some phrases; see SCENARIOS for what '..', '*', {place} and {year} stand for."""
    place = "(?:" + "|".join(p.replace(" ", r"\s+") for p in (*JURISDICTIONS, *PLACES)) + ")"
    body = phrase_pattern(phrases).replace("*", r"\w*")
    body = body.replace(r"\s+..\s+", r"\b.{0,40}?\b").replace("{place}", place).replace("{year}", r"(?:18|19|20)\d\d")
    return body


def scenario_label(queries: DataFrame, scenarios=SCENARIOS) -> DataFrame:
    """X28. queries (query, task) with scenario: of those of the query's task the first whose phrases occur, else null."""
    label = F.lit(None).cast("string")
    for name, task, _, phrases in sorted(scenarios, key=lambda r: r[2])[::-1]:
        label = F.when((F.col("task") == task) & F.col("query").rlike(wording(phrases)), name).otherwise(label)
    return queries.withColumn("scenario", label)


def dispute_domain(query: Column, domains=DOMAINS) -> Column:
    """X29. The first domain one of whose words occurs, else 'general'."""
    return F.coalesce(*(F.when(query.rlike(wording(words)), F.lit(name)) for name, words in domains), F.lit("general"))


def expansions(query: Column, kinds=EXPANSIONS) -> Column:
    """X29. All kinds of further material whose words occur, in order; an amount of dollars asks for fees."""
    tests = [(name, query.rlike(wording(words)) | (query.rlike(DOLLARS) if name == "schedule_fee" else F.lit(False))) for name, words in kinds]
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests)))


#: What a law's name looks like: capitalised words, a kind of law, and perhaps a number, a year, a jurisdiction.
KINDS = ("Act", "Acts", "Regulation", "Regulations", "Rules", "Code", "Constitution", "Determination", "Standards", "Ordinance", "Bylaw", "Bylaws", "By-law", "By-laws", "Order")
_TITLE = rf"(?:(?:[A-Z][A-Za-z'’&-]*|\([A-Z][A-Za-z'’& -]*\)),?\s+(?:(?:{'|'.join(LINKS)})\s+){{0,3}}){{1,9}}"
LAW_NAME = rf"{_TITLE}(?:{'|'.join(KINDS)})\b(?:\s+\(?No[.]?\s?[0-9]{{1,3}}\)?)?(?:\s+(?:18|19|20)[0-9]{{2}})?(?:\s*\((?:{'|'.join(JURISDICTIONS)})\))?"
#: Aliases of so many characters are matched by case, as their letters may be a word in lower case.
SHORT_ALIAS = 4
_LEADING = rf"^(?:{'|'.join((*JURISDICTIONS, *(j.upper() for j in JURISDICTIONS), *PLACES))})\s+"
_YEAR_AT_END = r"\s*(?:\(?No[.]?\s?[0-9]{1,3}\)?\s*)?(?:18|19|20)[0-9]{2}\s*$"


def _named(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """query_id, pos, end of what looks like a law's name, or is an alias or an official name; overlaps and all."""
    found = queries.select("query_id", F.explode(match_offsets(F.col("query"), LAW_NAME)).alias("m")).select("query_id", (F.col("m.pos") + F.length("m.raw")).alias("_to"), F.rtrim("m.raw").alias("raw"), F.col("m.pos").alias("_at"))
    title = law_title(F.col("raw"))
    end = F.col("_at") + F.length("raw")
    grammar = found.select("query_id", (end - F.length(title)).alias("pos"), end.alias("end"))
    names = aliases.select(F.col("alias").alias("name")).unionByName(aliases.select(F.col("official").alias("name"))).distinct()
    met = find_names(queries.select("query_id", "query"), names, by="query_id", text="query").join(queries.select("query_id", "query"), "query_id")
    # Letters of a short name may be a word in lower case.
    same = (F.length("name") > SHORT_ALIAS) | (F.substr("query", F.col("pos") + 1, F.col("end") - F.col("pos")) == F.col("name"))
    return grammar.unionByName(met.filter(same).select("query_id", "pos", "end")).distinct()


def _longest(spans: DataFrame) -> DataFrame:
    """query_id, pos, end: of spans that overlap the longest, then the leftmost; shorter ones stay if they meet no kept one."""
    order = Window.partitionBy("query_id").orderBy("pos", F.desc("end"))
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("_new", F.coalesce((F.col("pos") >= reach).cast("int"), F.lit(1))).withColumn("_g", F.sum("_new").over(order))
    rows = islands.groupBy("query_id", "_g").agg(F.array_sort(F.collect_list(F.struct((F.col("pos") - F.col("end")).alias("size"), "pos", "end"))).alias("s"))
    none = F.array().cast(rows.schema["s"].dataType)
    step = lambda kept, x: F.when(F.exists(kept, lambda k: (k["pos"] < x["end"]) & (x["pos"] < k["end"])), kept).otherwise(F.array_append(kept, x))
    return rows.select("query_id", F.explode(F.aggregate("s", none, step)).alias("m")).select("query_id", "m.pos", "m.end")


def law_mentions(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """X30. query_id, pos, raw, name, jurisdiction, needs_jurisdiction, body, is_primary for each law that a query names.

    aliases: alias, official, jurisdiction, and body (true for an agency) if there is one. Of names that overlap
    the longest is the mention, so no name inside another is one. A mention is looked up folded among aliases and official names; without
    success again without the jurisdiction before it, then without the year behind it, then without both. name is the
    official one (of several the least), else the mention's without the jurisdiction; needs_jurisdiction: several remain.
    The primary mention is the first that isn't an agency, else the first.
    """
    whole = _longest(_named(queries, aliases))
    found = whole.join(queries.select("query_id", "query"), "query_id").select("query_id", "pos", F.substr("query", F.col("pos") + 1, F.col("end") - F.col("pos")).alias("raw"))
    bare = F.trim(F.regexp_replace("raw", _LEADING, ""))
    tries = F.array(F.col("raw"), bare, F.trim(F.regexp_replace("raw", _YEAR_AT_END, "")), F.trim(F.regexp_replace(bare, _YEAR_AT_END, "")))
    asked = found.select("query_id", "pos", F.posexplode(tries).alias("_try", "_name"))
    plain, stated = split_jurisdiction(F.col("_name"))
    asked = asked.select("query_id", "pos", "_try", fold_key(plain, ascii_only=True).alias("_key"), stated.alias("_stated")).filter(F.length("_key") >= 2)
    body = F.col("body") if "body" in aliases.columns else F.lit(False)
    rows = aliases.withColumn("_body", F.coalesce(body, F.lit(False)))
    known = rows.select(fold_key(F.col("alias"), ascii_only=True).alias("_key"), "official", "jurisdiction", "_body").unionByName(rows.select(fold_key(F.col("official"), ascii_only=True).alias("_key"), "official", "jurisdiction", "_body")).distinct()
    hits = asked.join(known, "_key").withColumn("_fits", F.coalesce(F.col("jurisdiction") == F.col("_stated"), F.lit(False)))
    best = hits.groupBy("query_id", "pos", "_try").agg(
        F.min_by(F.struct("official", "jurisdiction", "_body"), F.struct(~F.col("_fits"), "official", "jurisdiction")).alias("_first"), F.bool_or("_fits").alias("_narrow"), (F.count_distinct("jurisdiction") > 1).alias("_many")
    )
    chosen = best.groupBy("query_id", "pos").agg(F.min_by(F.struct("_first", "_narrow", "_many"), "_try").alias("c"))
    out = found.join(chosen, ["query_id", "pos"], "left").select(
        "query_id", "pos", "raw", F.coalesce("c._first.official", F.when(bare == "", F.col("raw")).otherwise(bare)).alias("name"), F.col("c._first.jurisdiction").alias("jurisdiction"),
        F.coalesce(F.col("c._many") & ~F.col("c._narrow"), F.lit(False)).alias("needs_jurisdiction"), F.coalesce("c._first._body", F.lit(False)).alias("body"),
    )
    first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("body").cast("int"), "pos"))
    return out.withColumn("is_primary", first == 1)

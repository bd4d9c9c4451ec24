"""Look-ups between events, citations, titles, versions and edges.

Every look-up that can miss says why in a status column: absent is not the same as not covered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexframe.functions.courts import series_rows, token_key
from lexframe.functions.folds import fold_key, fold_words
from lexframe.sources.scratch import scratch_path

#: The jurisdictions that a name may end with in brackets.
JURISDICTIONS = ("Cth", "NSW", "Vic", "Qld", "SA", "WA", "Tas", "ACT", "NT")


def split_jurisdiction(name: Column) -> tuple[Column, Column]:
    """(name without it, jurisdiction or null) of 'Crimes Act 1900 (NSW)'."""
    ending = r"\s*\((" + "|".join(JURISDICTIONS) + r")\)\s*$"
    return F.regexp_replace(name, ending, ""), F.nullif(F.regexp_extract(name, ending, 1), F.lit(""))


def resolve_alias(names: DataFrame, aliases: DataFrame, *, ascii_only: bool = True) -> DataFrame:
    """J1. name_id, alias, official, jurisdiction, matched_by, needs_jurisdiction, status for each name.

    Folded alias hits win over official-name hits. A jurisdiction stated in the name narrows the candidates, if any
    is left by it. needs_jurisdiction: more than one remains. Names without a candidate keep a row: absent.
    """
    bare, stated = split_jurisdiction(F.col("name"))
    asked = names.select("name_id", fold_key(bare, ascii_only=ascii_only).alias("key"), stated.alias("stated"))
    by = [(aliases.select(fold_key(F.col(c), ascii_only=ascii_only).alias("key"), "alias", "official", "jurisdiction", F.lit(kind).alias("matched_by"), F.lit(rank).alias("by_rank"))) for rank, (c, kind) in enumerate((("alias", "alias"), ("official", "official")))]
    held = by[0].unionByName(by[1])
    # What decides about a name is summed up by key first: the least rank, and the few jurisdictions at each rank.
    kinds = held.groupBy("key").agg(F.min("by_rank").alias("least"), *(F.collect_set(F.when(F.col("by_rank") == r, F.col("jurisdiction"))).alias(f"_j{r}") for r in (0, 1)))
    kinds = kinds.select("key", "least", F.when(F.col("least") == 0, F.col("_j0")).otherwise(F.col("_j1")).alias("_in"))
    known = asked.join(kinds, "key", "left")
    known = known.withColumn("narrows", F.coalesce(F.array_contains("_in", F.col("stated")), F.lit(False)))
    known = known.select("name_id", "key", "stated", "least", "narrows", (~F.col("narrows") & (F.coalesce(F.size("_in"), F.lit(0)) > 1)).alias("needs_jurisdiction"))
    found = known.join(held.withColumnRenamed("by_rank", "least"), ["key", "least"], "left").filter(~F.col("narrows") | (F.col("jurisdiction") == F.col("stated")))
    status = F.when(F.col("official").isNull(), "absent").otherwise("found")
    return found.select("name_id", "alias", "official", "jurisdiction", "matched_by", "needs_jurisdiction", status.alias("status"))


def aliases_for(titles: DataFrame, aliases: DataFrame) -> DataFrame:
    """J2. id, name, aliases (sorted) of each title that has any."""
    # Summed up by name first: a name of many titles and many aliases isn't joined pair by pair.
    held = aliases.groupBy(F.col("official").alias("name")).agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    return titles.select("id", "name").distinct().join(held, "name").select("id", "name", "aliases")


def version_as_at(events: DataFrame, versions: DataFrame) -> DataFrame:
    """J3. events with register_id, since, affect of the version in force at d, and status found, before_first or absent.

    As-of by one window over the union of both: no range join, so a title with many events and versions is one
    sorted run. since <= d, the last such version; absent if the title has no version at all.
    """
    at = F.struct("since", "register_id", "affect", "until")
    both = events.withColumn("_v", F.lit(None).cast(versions.select(at.alias("v")).schema["v"].dataType)).withColumn("_o", F.lit(1))
    rows = both.unionByName(versions.select("title_id", F.col("since").alias("d"), at.alias("_v"), F.lit(0).alias("_o")), allowMissingColumns=True)
    sofar = Window.partitionBy("title_id").orderBy("d", "_o").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_last": F.last("_v", ignorenulls=True).over(sofar), "_any": F.count("_v").over(Window.partitionBy("title_id"))}).filter("_o = 1")
    alive = F.col("_last.until").isNull() | (F.col("d") < F.col("_last.until"))
    status = F.when(F.col("_last").isNull(), F.when(F.col("_any") > 0, "before_first").otherwise("absent")).when(alive, "found").otherwise("lapsed")
    return rows.select(*events.columns, F.col("_last.register_id").alias("register_id"), F.col("_last.since").alias("since"), F.col("_last.affect").alias("affect"), status.alias("status"))


def version_as_at_by_range(events: DataFrame, versions: DataFrame) -> DataFrame:
    """J3 as a range join on the title: the same rows for versions that don't overlap; for small event sets."""
    v = versions.select("title_id", "since", "until", "register_id", "affect")
    hit = (F.col("d") >= F.col("since")) & (F.col("until").isNull() | (F.col("d") < F.col("until")))
    firsts = versions.groupBy("title_id").agg(F.min("since").alias("_first"))
    joined = events.join(v, (events["title_id"] == v["title_id"]) & hit, "left").drop(v["title_id"]).join(firsts, "title_id", "left")
    status = F.when(F.col("register_id").isNotNull(), "found").when(F.col("_first").isNull(), "absent").when(F.col("d") < F.col("_first"), "before_first").otherwise("lapsed")
    return joined.select(*events.columns, "register_id", "since", "affect", status.alias("status"))


def rename_history(titles: DataFrame, as_at=None) -> DataFrame:
    """J4. id, name, since, until of former and present names, doubles dropped; with as_at the name then.

    titles: id, name, name_history array<struct<name, start>>.
    """
    names = titles.select("id", F.explode("name_history").alias("h")).select("id", F.col("h.name").alias("name"), F.col("h.start").alias("since")).distinct()
    out = names.withColumn("until", F.lead("since").over(Window.partitionBy("id").orderBy("since", "name")))
    if as_at is None:
        return out
    day = F.lit(as_at).cast("date")
    return out.filter((F.col("since") <= day) & (F.col("until").isNull() | (day < F.col("until"))))


def repeal_status_at(events: DataFrame, versions: DataFrame) -> DataFrame:
    """J5. events with repealed_on and repeal_status: repealed_before, in_force_then_repealed or not_repealed.

    The repeal is the first version of the title whose affect is Repeal.
    """
    repeals = versions.filter("affect = 'Repeal'").groupBy("title_id").agg(F.min("since").alias("repealed_on"))
    status = F.when(F.col("repealed_on").isNull(), "not_repealed").when(F.col("repealed_on") <= F.col("d"), "repealed_before").otherwise("in_force_then_repealed")
    return events.join(repeals, "title_id", "left").withColumn("repeal_status", status)


def locate_provision(refs: DataFrame, toc: DataFrame) -> DataFrame:
    """J6. refs (ref_id, title_id, number, schedule) with ord, label, alternatives, status.

    A ref with a schedule matches inside that schedule only. Others prefer the body over schedules, and in the body
    entries under a structural parent over those at the top. toc: title_id, ord, depth, label, number, schedule.
    """
    entries = toc.select("title_id", "number", "ord", "label", "depth", F.col("schedule").alias("in_schedule"))
    same = ["title_id", "number"]
    found = refs.join(entries, same, "left").filter(F.col("ord").isNull() | F.col("schedule").isNull() | F.col("schedule").eqNullSafe(F.col("in_schedule")))
    order = Window.partitionBy("ref_id").orderBy(F.col("in_schedule").isNotNull(), F.col("depth") <= 1, "ord")
    found = found.withColumns({"rank": F.row_number().over(order), "alternatives": F.count("ord").over(Window.partitionBy("ref_id")) - 1}).filter("rank = 1")
    best = found.select("ref_id", "ord", "label", F.greatest("alternatives", F.lit(0)).alias("alternatives"))
    return refs.join(best, "ref_id", "left").withColumn("status", F.when(F.col("ord").isNull(), "absent").otherwise("found"))


def _by_alias(citations: DataFrame, titles: DataFrame, aliases: DataFrame) -> DataFrame:
    """citations with the official name of an alias (J1) in law_name and its jurisdiction where none is given, and unclear."""
    asked = F.when(F.col("jurisdiction").isNull(), F.col("law_name")).otherwise(F.format_string("%s (%s)", "law_name", "jurisdiction"))
    found = resolve_alias(citations.select(asked.alias("name_id")).filter("name_id is not null").distinct().withColumn("name", F.col("name_id")), aliases).filter("status = 'found'")
    one = lambda c: F.when(F.count_distinct(c) == 1, F.min(c))
    known = found.groupBy(F.col("name_id").alias("_asked")).agg(F.bool_or("needs_jurisdiction").alias("_needs"), one("official").alias("_official"), one("jurisdiction").alias("_in"))
    exact = titles.select(F.col("name").alias("law_name"), F.lit(True).alias("_exact")).distinct()
    out = citations.withColumn("_asked", asked).join(known, "_asked", "left").join(exact, "law_name", "left")
    return out.withColumns(
        {
            "unclear": F.col("jurisdiction").isNull() & F.coalesce("_needs", F.lit(False)),
            "jurisdiction": F.coalesce("jurisdiction", "_in"),
            "law_name": F.when(F.col("_exact"), F.col("law_name")).otherwise(F.coalesce("_official", "law_name")),
        }
    ).drop("_asked", "_needs", "_official", "_in", "_exact")


def statute_existence(citations: DataFrame, titles: DataFrame, toc: DataFrame, coverage: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """J7. cite_id, verdict, reason for citations (cite_id, law_name, jurisdiction, number).

    With aliases (alias, official, jurisdiction) a name that is no title's is looked up there first (J1): its official
    name and jurisdiction are then checked; unclear_jurisdiction if it is a name in several and none is given.

    In this order: non_federal, no_name, title_absent, ambiguous (several titles of that name), existence_only (no
    number), contents_unread (no coverage row for the title), section_absent, found. verdict is right, wrong or unclear.
    """
    named = titles.groupBy(F.col("name").alias("law_name")).agg(F.min("id").alias("title_id"), (F.count_distinct("id") > 1).alias("several"))
    entries = toc.filter("number is not null").select("title_id", "number", F.lit(True).alias("listed")).distinct()
    read = coverage.select("title_id", F.lit(True).alias("read")).distinct()
    if aliases is not None:
        citations = _by_alias(citations, titles, aliases)
    unclear = F.col("unclear") if aliases is not None else F.lit(False)
    joined = citations.join(named, "law_name", "left").join(entries, ["title_id", "number"], "left").join(read, "title_id", "left")
    reason = (
        F.when(unclear, "unclear_jurisdiction")
        .when(F.col("jurisdiction") != "Cth", "non_federal")
        .when(F.col("law_name").isNull(), "no_name")
        .when(F.col("title_id").isNull(), "title_absent")
        .when(F.col("several"), "ambiguous")
        .when(F.col("number").isNull(), "existence_only")
        .when(F.col("read").isNull(), "contents_unread")
        .when(F.col("listed").isNull(), "section_absent")
        .otherwise("found")
    )
    verdict = F.when(reason.isin("found", "existence_only"), "right").when(reason.isin("title_absent", "section_absent"), "wrong").otherwise("unclear")
    return joined.select("cite_id", verdict.alias("verdict"), reason.alias("reason"))


def case_existence(citations: DataFrame, judgments: DataFrame, coverage: DataFrame) -> DataFrame:
    """J8. citations (year, court, number) with found_id and status.

    found; absent where coverage (court, year, complete) says that all of that court and year is loaded;
    unreachable where it is not complete; unsupported without a coverage row.
    """
    key = ["court", "year", "number"]
    held = judgments.groupBy(*key).agg(F.min("doc_id").alias("found_id"))
    known = coverage.groupBy("court", "year").agg(F.max("complete").alias("complete"))
    out = citations.join(held, key, "left").join(known, ["court", "year"], "left")
    status = F.when(F.col("found_id").isNotNull(), "found").when(F.col("complete").isNull(), "unsupported").when(F.col("complete"), "absent").otherwise("unreachable")
    return out.withColumn("status", status).drop("complete")


def report_series(spark: SparkSession) -> DataFrame:
    """series_key, series, series_bracket (round, square or either), series_rank (1 authorised, 2 general, 3 subject)."""
    return spark.createDataFrame(series_rows(), "series_key string, series string, series_bracket string, series_rank int")


def court_dimension(citations: DataFrame, courts: DataFrame, series: DataFrame | None = None) -> DataFrame:
    """J9. citations (token, year, bracket) with court_name, status (known or unclear) and warnings.

    Dots in a token don't count. courts: court, court_name, first_year, last_year. With series (see report_series) a
    token that is no court's is looked up there too, dots, spaces and case aside: series and series_rank come as columns,
    and bracket_style warns where the bracket isn't the series' own.
    """
    if series is not None:
        known = series.select("series_key", "series", "series_bracket", "series_rank")
        out = court_dimension(citations, courts).withColumn("series_key", token_key(F.col("token"))).join(known, "series_key", "left")
        own = F.col("court_name").isNull() & F.col("series").isNotNull()
        wrong = (F.col("series_bracket") != "either") & (F.col("bracket") != F.col("series_bracket"))
        told = F.when(own, F.when(wrong, F.array(F.lit("bracket_style"))).otherwise(F.array().cast("array<string>"))).otherwise(F.col("warnings"))
        columns = {"warnings": told, "status": F.when(own, "known").otherwise(F.col("status")), "series": F.when(own, F.col("series")), "series_rank": F.when(own, F.col("series_rank"))}
        return out.withColumns(columns).drop("series_key", "series_bracket")
    asked = citations.withColumn("court", F.replace("token", F.lit("."), F.lit("")))
    out = asked.join(courts, "court", "left")
    warnings = F.array_compact(
        F.array(F.when(F.col("year") < F.col("first_year"), F.lit("before_first_year")), F.when(F.col("year") > F.col("last_year"), F.lit("after_last_year")), F.when(F.col("bracket") == "round", F.lit("bracket_style")))
    )
    return out.withColumns({"status": F.when(F.col("court_name").isNull(), "unclear").otherwise("known"), "warnings": warnings}).drop("first_year", "last_year")


def enabled_instruments(titles: DataFrame, authorises: DataFrame, *, collection: str = "LegislativeInstrument", status: str = "InForce") -> DataFrame:
    """J10. act, id, name, provisions: the instruments of a collection and status made under each Act."""
    wanted = titles.filter((F.col("collection") == collection) & (F.col("status") == status)).select("id", "name")
    return authorises.join(wanted, authorises["affected"] == wanted["id"]).select(F.col("affecting").alias("act"), "id", "name", "provisions")


#: Fixed value: how an instrument's text names the Act it is made under.
RECITAL = r"made under the ([A-Z][A-Za-z' ]+? Act [0-9]{4})"


def enabling_acts(titles: DataFrame, authorises: DataFrame, texts: DataFrame) -> DataFrame:
    """J11. id, act, provisions, via: by edge, else by the recital in the text; status absent if neither."""
    by_edge = titles.join(authorises, titles["id"] == authorises["affected"]).select("id", F.col("affecting").alias("act"), "provisions", F.lit("edge").alias("via"))
    rest = titles.select("id").join(authorises.select(F.col("affected").alias("id")), "id", "left_anti").join(texts, "id", "left")
    act = F.nullif(F.regexp_extract("text", RECITAL, 1), F.lit(""))
    by_text = rest.select("id", act.alias("act"), F.lit(None).cast("string").alias("provisions"), F.when(act.isNotNull(), "recital").alias("via"))
    return by_edge.unionByName(by_text).withColumn("status", F.when(F.col("act").isNull(), "absent").otherwise("found"))


def instrument_radar(edges: DataFrame, instrument_versions: DataFrame, act_versions: DataFrame) -> DataFrame:
    """J12. instrument, act, instrument_date, n_after, flag for each edge (instrument, act).

    n_after counts Act versions strictly after the instrument's newest. REVIEW if any, NO_SIGNAL if none,
    NO_COMPARISON if either side has no version.
    """
    newest = instrument_versions.groupBy(F.col("title_id").alias("instrument")).agg(F.max("since").alias("instrument_date"))
    starts = act_versions.groupBy(F.col("title_id").alias("act")).agg(F.array_sort(F.collect_list("since")).alias("starts"))
    out = edges.join(newest, "instrument", "left").join(starts, "act", "left")
    after = F.size(F.filter("starts", lambda d: d > F.col("instrument_date")))
    known = F.col("starts").isNotNull() & F.col("instrument_date").isNotNull()
    flag = F.when(~known, "NO_COMPARISON").when(after > 0, "REVIEW").otherwise("NO_SIGNAL")
    return out.select("instrument", "act", "instrument_date", F.when(known, after).alias("n_after"), flag.alias("flag"))


def enabling_provision_match(edges: DataFrame, refs: DataFrame) -> DataFrame:
    """J13. refs (ref_id, act, provision) with the instruments whose enabling provision is that one.

    Edge text is normalised first: 's 134(1) of sch 2' and 'sch 2 (s 134(1))' are one; of a list the first
    member counts and narrowed is true. A text that doesn't come back the same after parsing is left out.
    """
    text = F.trim(F.regexp_replace("provisions", r"\s+", " "))
    turned = F.regexp_replace(text, r"^(s [0-9A-Z()]+) of (sch [0-9A-Z]+)$", "$2 $1")
    turned = F.regexp_replace(turned, r"^(sch [0-9A-Z]+) \((s [0-9A-Z()]+)\)$", "$1 $2")
    first = F.regexp_extract(turned, r"^((?:sch [0-9A-Z]+ )?s [0-9A-Z]+(?:\([0-9A-Za-z]+\))*)", 1)
    parsed = edges.select("instrument", "act", first.alias("provision"), (first != turned).alias("narrowed")).filter("provision <> ''")
    return refs.join(parsed, ["act", "provision"]).select("ref_id", "act", "provision", "instrument", "narrowed")


def amending_acts(amendments: DataFrame, titles: DataFrame) -> DataFrame:
    """J14. amendments with the amending title's id and name by (year, number) among Acts; unresolved rows stay."""
    acts = titles.filter("collection = 'Act'").groupBy(F.col("year").alias("act_year"), F.col("number").alias("act_number")).agg(F.min("id").alias("act_id"), F.min_by("name", "id").alias("act_name"))
    return amendments.join(acts, ["act_year", "act_number"], "left").withColumn("status", F.when(F.col("act_id").isNull(), "absent").otherwise("found"))


def amended_after(events: DataFrame, amendments: DataFrame) -> DataFrame:
    """J15. event_id, title_id, provision, effect, act_year: effects of Acts of the event's year or later.

    The year is all that an amendment row tells, so effects of the same year count.
    """
    return events.select("event_id", "title_id", F.year("d").alias("event_year")).join(amendments, "title_id").filter("act_year >= event_year").drop("event_year", "act_number")


def state_counterparts(names: DataFrame, families: DataFrame, members: DataFrame) -> DataFrame:
    """J16. name_id, family, score, member rows of the family whose fragments match best.

    Score 3 for a fragment equal to the folded name, 2 if one contains the other (4 characters at least), 1 if they
    share a word of 4 letters or more. Candidates come by equi-joins: on the whole fold, on a shared run of 4 characters
    (the first one of the shorter side) and on a shared word; names and families are never paired without one of them.
    """
    asked = names.select("name_id", fold_key(F.col("name"), ascii_only=True).alias("k"), F.split(fold_words(F.col("name")), " ").alias("kw"))
    held = families.select("family", fold_key(F.col("fragment"), ascii_only=True).alias("f"), F.split(fold_words(F.col("fragment")), " ").alias("fw"))

    def runs(text: str) -> Column:
        """All runs of 4 characters of a fold, once each."""
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - 3, F.lit(1)))
        return F.array_distinct(F.transform(starts, lambda i: F.substr(F.col(text), i, F.lit(4))))

    def by(left: Column, right: Column) -> DataFrame:
        a = asked.select("name_id", "k", "kw", F.explode(left).alias("_on"))
        return a.join(held.select("family", "f", "fw", F.explode(right).alias("_on")), "_on").drop("_on")

    long_words = lambda c: F.filter(F.col(c), lambda w: F.length(w) >= 4)
    pairs = by(runs("k"), F.array(F.substring("f", 1, 4))).unionByName(by(F.array(F.substring("k", 1, 4)), runs("f"))).unionByName(by(long_words("kw"), long_words("fw"))).distinct()
    within = (F.length("f") >= 4) & (F.length("k") >= 4) & (F.col("k").contains(F.col("f")) | F.col("f").contains(F.col("k")))
    score = F.when(F.col("k") == F.col("f"), 3).when(within, 2).when(F.arrays_overlap(long_words("kw"), long_words("fw")), 1).otherwise(0)
    scored = pairs.withColumn("score", score).filter("score > 0")
    best = scored.groupBy("name_id").agg(F.max_by("family", F.struct("score", F.length("f"), "family")).alias("family"), F.max("score").alias("score"))
    return best.join(members, "family")


def citing_documents(targets: DataFrame, mentions: DataFrame, *, k: int | None = None) -> DataFrame:
    """J17. target_id, doc_id, n_mentions: documents that mention a target's citation, the target itself aside.

    targets: target_id, citation; mentions: doc_id, citation. k limits the rows of a target, most mentions first.
    """
    counted = mentions.groupBy("doc_id", "citation").agg(F.count("*").alias("n_mentions"))
    found = targets.join(counted, "citation").filter(F.col("doc_id") != F.col("target_id")).select("target_id", "doc_id", "n_mentions")
    if k is None:
        return found
    order = Window.partitionBy("target_id").orderBy(F.desc("n_mentions"), "doc_id")
    return found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")


#: The most bytes of phrases that are sent to every task.
PHRASE_BYTES = 8 << 20


def phrase_mentions(docs: DataFrame, phrases: DataFrame, *, text: str = "text") -> DataFrame:
    """J18. doc_id, phrase_id for documents that contain a phrase word by word, case and punctuation aside.

    An equi-join on one word pair of the phrase (its only word) finds candidates; only their texts are held against the
    whole phrase. The pair is the phrase's rarest in the documents. If the phrases are few enough (PHRASE_BYTES) for every
    task to have them, each text meets them where it is and no text is shuffled; else pairs are, and the texts of candidates.
    """

    def plain(c: str) -> Column:
        return F.trim(F.regexp_replace(F.lower(F.col(c)), r"[^\p{L}\p{N}]+", " "))

    def pairs(words: Column) -> Column:
        """The word pairs of a text, or its only word."""
        each = F.zip_with(words, F.slice(words, 2, 2**30), lambda a, b: F.concat_ws(" ", a, b))
        return F.array_distinct(F.when(F.size(words) > 1, F.slice(each, F.lit(1), F.size(words) - 1)).otherwise(words))

    sought = phrases.select("phrase_id", plain("phrase").alias("p")).filter("p <> ''").withColumn("heads", pairs(F.split("p", " ")))
    heads = sought.select(F.explode("heads").alias("head")).distinct()
    # A phrase and its rarest pair are no longer than twice its text.
    size = sought.agg(F.sum(2 * F.octet_length("p") + 32)).first()[0] or 0
    few = size <= PHRASE_BYTES
    heads = F.broadcast(heads) if few else heads
    # A phrase of one word needs the single words too. Each place of a text gives its word and the pair that begins there.
    bodies = docs.select("doc_id", plain(text).alias("body"))
    places = bodies.withColumn("w", F.split("body", " ")).select("doc_id", "body", "w", F.posexplode("w").alias("i", "a"))
    places = places.select("doc_id", "body", F.explode(F.array(F.col("a"), F.concat_ws(" ", "a", F.get("w", F.col("i") + 1)))).alias("head"))
    have = places.select("doc_id", "head").join(heads, "head")
    counts = have.groupBy("head").agg(F.count("*").alias("n"))
    rarest = sought.select("phrase_id", "p", F.explode("heads").alias("head")).join(counts, "head", "left").groupBy("phrase_id", "p").agg(F.min_by("head", F.struct(F.coalesce("n", F.lit(0)), "head")).alias("head"))
    padded = F.concat(F.lit(" "), F.col("body"), F.lit(" "))
    whole = padded.contains(F.concat(F.lit(" "), F.col("p"), F.lit(" ")))
    if few:
        return places.join(F.broadcast(rarest), "head").filter(whole).select("doc_id", "phrase_id").distinct()
    found = have.join(rarest, "head").select("doc_id", "phrase_id", "p").distinct()
    return found.join(bodies, "doc_id").filter(whole).select("doc_id", "phrase_id").distinct()


def unverified_candidates(hits: DataFrame, confirmed: DataFrame, any_word_sources: tuple[str, ...]) -> DataFrame:
    """J19. Hits of sources that match any word, which no confirmed mention (doc_id) backs."""
    return hits.filter(F.col("source").isin(*any_word_sources)).join(confirmed.select("doc_id").distinct(), "doc_id", "left_anti")


#: Fixed value: headings of application, saving and transitional provisions.
TRANSITIONAL = r"(?i)\b(application|saving|savings|transitional)\b"


def transitional_headings(amending: DataFrame, toc: DataFrame, k: int = 6) -> DataFrame:
    """J20. title_id, ord, label: transitional headings of the amending titles, k of each at most."""
    found = toc.filter(F.col("label").rlike(TRANSITIONAL)).join(amending.select("title_id").distinct(), "title_id", "left_semi")
    return found.withColumn("_n", F.row_number().over(Window.partitionBy("title_id").orderBy("ord"))).filter(F.col("_n") <= k).select("title_id", "ord", "label")


def law_surroundings(titles: DataFrame, authorises: DataFrame, versions: DataFrame) -> DataFrame:
    """J21. id, leg, item, n: for each title its enabled instruments by collection and its versions by affect."""
    made = authorises.join(titles.select(F.col("id").alias("affected"), "collection"), "affected").groupBy(F.col("affecting").alias("id"), F.col("collection").alias("item")).agg(F.count("*").alias("n"))
    changes = versions.groupBy(F.col("title_id").cast("string").alias("id"), F.col("affect").alias("item")).agg(F.count("*").alias("n"))
    return made.withColumn("leg", F.lit("instruments")).unionByName(changes.withColumn("leg", F.lit("versions"))).select("id", "leg", "item", "n")


def law_network(roots: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """J21. root, law, hops, via: what is reached from each root (id) over edges (src, dst, kind) in up to `depth` steps.

    hops is the least number of steps, via the least kind of edge that ends such a way; a root reaches itself in none. Every
    level is one join of the last level's laws with the edges; what was reached before is dropped by an anti-join. Levels
    are written, so that a later one doesn't work out the earlier ones again.
    """
    spark = roots.sparkSession
    start = roots.select(F.col("id").alias("root"), F.col("id").alias("law")).filter("root is not null").distinct()
    level = start.withColumns({"hops": F.lit(0), "via": F.lit(None).cast("string")})
    ways = edges.select(F.col("src").alias("law"), F.col("dst"), "kind")
    seen = None
    for hops in range(depth + 1):
        if hops:
            reached = level.select("root", "law").join(ways, "law").groupBy("root", F.col("dst").alias("law")).agg(F.min("kind").alias("via"))
            level = reached.join(seen.select("root", "law"), ["root", "law"], "left_anti").select("root", "law", F.lit(hops).alias("hops"), "via")
        path = scratch_path(spark, f"network-{hops}")
        level.write.parquet(path)
        level = spark.read.schema(level.schema).parquet(path)
        seen = level if seen is None else seen.unionByName(level)
    return seen


def batch_provisions(requests: DataFrame, provisions: DataFrame, coverage: DataFrame, max_chars: int = 2000) -> DataFrame:
    """J22. requests (request_id, title_id, number) with label, text cut to max_chars, and status.

    found, section_absent (title loaded), title_unread (no coverage row). Repeated requests are answered each.
    """
    read = coverage.select("title_id", F.lit(True).alias("_read")).distinct()
    out = requests.join(provisions, ["title_id", "number"], "left").join(read, "title_id", "left")
    status = F.when(F.col("label").isNotNull(), "found").when(F.col("_read"), "section_absent").otherwise("title_unread")
    return out.select("request_id", "title_id", "number", "label", F.substring("text", 1, max_chars).alias("text"), status.alias("status"))


def schedule_scope(requests: DataFrame, aliases: DataFrame) -> DataFrame:
    """J23. requests (alias, ref) with ref under the schedule that the alias names ('ACL s 18' -> 'sch 2 s 18').

    aliases: alias, official, schedule. An explicit 'sch' in the ref wins.
    """
    named = aliases.select(fold_key(F.col("alias"), ascii_only=True).alias("_key"), "official", "schedule").dropDuplicates(["_key"])
    out = requests.withColumn("_key", fold_key(F.col("alias"), ascii_only=True)).join(named, "_key", "left")
    scoped = F.when(F.col("schedule").isNotNull() & ~F.col("ref").rlike(r"(?i)\bsch"), F.concat_ws(" ", F.concat(F.lit("sch "), F.col("schedule")), F.col("ref"))).otherwise(F.col("ref"))
    return out.select(*requests.columns, "official", scoped.alias("scoped_ref"))


def identity_match(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """J24. requests (request_id, wanted) with the doc_id whose citation, else whose title, is exactly the wanted one."""
    fold = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    by = [documents.groupBy(fold(F.col(c)).alias("k")).agg(F.min("doc_id").alias(f"by_{c}")) for c in ("citation", "title")]
    out = requests.withColumn("k", fold(F.col("wanted"))).join(by[0], "k", "left").join(by[1], "k", "left")
    found = F.coalesce("by_citation", "by_title")
    return out.select("request_id", "wanted", found.alias("doc_id"), F.when(found.isNull(), "absent").otherwise("found").alias("status"))


def related_laws(terms: DataFrame, aliases: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """J25. term, official, sibling aliases: the Acts that a term's provisions name, with their aliases.

    With bodies (official, body) also the bodies that administer each Act.
    """
    anchored = terms.select("term", F.explode("laws").alias("official")).distinct()
    out = anchored.join(aliases, "official", "left").groupBy("term", "official").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    if bodies is None:
        return out
    held = bodies.groupBy("official").agg(F.array_sort(F.collect_set("body")).alias("bodies"))
    return out.join(held, "official", "left").withColumn("bodies", F.coalesce("bodies", F.array().cast("array<string>")))

"""Aggregations over registers, verdicts, citations and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexframe.functions.offsets import let
from lexframe.functions.patterns import constant, pattern_hits
from lexframe.functions.texts import rule_rows
from lexframe.operators.windows import container_rank, toc_ancestors

#: The register's collections and statuses; counts of zero are shown too.
COLLECTIONS = ("Act", "LegislativeInstrument", "NotifiableInstrument", "AdministrativeArrangementsOrder", "Constitution", "ContinuedLaw", "Gazette", "PrerogativeInstrument")
STATUSES = ("InForce", "Ceased", "Repealed", "NeverEffective")


def register_counts(titles: DataFrame, by: str = "collection") -> DataFrame:
    """A1. bucket, n by collection, status or year, zero buckets kept, and a row 'total'."""
    spark = titles.sparkSession
    counts = titles.groupBy(F.col(by).cast("string").alias("bucket")).agg(F.count("*").alias("n"))
    total = titles.agg(F.lit("total").alias("bucket"), F.count("*").alias("n"))
    if by == "year":
        ends = titles.agg(F.min("year").alias("a"), F.max("year").alias("b")).filter("a is not null")
        spine = ends.select(F.explode(F.sequence("a", "b")).alias("y")).select(F.col("y").cast("string").alias("bucket"))
    else:
        spine = spark.createDataFrame([(x,) for x in (COLLECTIONS if by == "collection" else STATUSES)], "bucket string")
    filled = spine.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))
    return filled.unionByName(counts.filter("bucket is not null").join(spine, "bucket", "left_anti")).unionByName(total)


def citation_report(verdicts: DataFrame) -> DataFrame:
    """A2. doc_id, n, n_right, n_wrong, n_unclear, n_existence, banner: ERRORS over PARTIAL over VERIFIED over NONE.

    n_existence: the right ones of which only the existence was checked (existence_only true, if there is such a column).
    """
    only = F.col("existence_only") if "existence_only" in verdicts.columns else F.lit(False)
    counts = (F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("right", "wrong", "unclear"))
    out = verdicts.groupBy("doc_id").agg(F.count("verdict").alias("n"), *counts, F.count_if((F.col("verdict") == "right") & F.coalesce(only, F.lit(False))).alias("n_existence"))
    return out.withColumn("banner", F.when(F.col("n") == 0, "NONE").when(F.col("n_wrong") > 0, "ERRORS").when(F.col("n_unclear") > 0, "PARTIAL").otherwise("VERIFIED"))


def citation_graph(mentions: DataFrame) -> DataFrame:
    """A3. target, n_mentions, n_docs, n_courts for mentions (doc_id, target, court)."""
    return mentions.groupBy("target").agg(F.count("*").alias("n_mentions"), F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("court").alias("n_courts"))


def citator_verdict(targets: DataFrame, treatments: DataFrame, overrides: DataFrame, citing: DataFrame) -> DataFrame:
    """A4. targets (target_id, status, complete) with n_confirmed and verdict.

    overruled_candidate over legislative_override over not_found (absent, all sources searched, nothing cites
    it) over cited over unverified_treatment.
    """
    bad = treatments.filter("kind = 'overruling'").groupBy("target_id").agg(F.count("*").alias("n_bad"))
    over = overrides.groupBy("target_id").agg(F.count("*").alias("n_over"))
    cited = citing.groupBy("target_id").agg(F.count("*").alias("n_all"), F.count_if("confirmed").alias("n_confirmed"))
    out = targets.join(bad, "target_id", "left").join(over, "target_id", "left").join(cited, "target_id", "left").fillna(0, ["n_bad", "n_over", "n_all", "n_confirmed"])
    verdict = (
        F.when(F.col("n_bad") > 0, "overruled_candidate")
        .when(F.col("n_over") > 0, "legislative_override")
        .when((F.col("status") == "absent") & F.col("complete") & (F.col("n_all") == 0), "not_found")
        .when(F.col("n_confirmed") > 0, "cited")
        .otherwise("unverified_treatment")
    )
    return out.select("target_id", "n_confirmed", verdict.alias("verdict"))


def merge_traces(outcomes: DataFrame) -> DataFrame:
    """A5. source, n_hits (distinct ids over the phrases), status: ok only if every phrase was."""
    return outcomes.groupBy("source").agg(F.count_distinct("id").alias("n_hits"), F.when(F.bool_and(F.col("status") == "ok"), "ok").otherwise("incomplete").alias("status"))


def impact_summary(provisions: DataFrame, citing: DataFrame, instruments: DataFrame, amendments: DataFrame, coverage: DataFrame, families: DataFrame | None = None) -> DataFrame:
    """A6. provisions (title_id, provision) with n_citing, n_instruments, n_naming, n_amendments, n_families.

    A count is null, not 0, where coverage (title_id, kind: citing, instruments, amendments or families) has no row.
    families: title_id, family; without it n_families is null.
    """
    key = ["title_id", "provision"]
    parts = (
        ("citing", citing.groupBy(*key).agg(F.count_distinct("doc_id").alias("n_citing")), key, ["n_citing"]),
        ("instruments", instruments.groupBy("title_id").agg(F.count("*").alias("n_instruments")), ["title_id"], ["n_instruments"]),
        ("instruments", instruments.groupBy(*key).agg(F.count("*").alias("n_naming")), key, ["n_naming"]),
        ("amendments", amendments.groupBy(*key).agg(F.count("*").alias("n_amendments")), key, ["n_amendments"]),
    )
    if families is not None:
        parts += (("families", families.groupBy("title_id").agg(F.count_distinct("family").alias("n_families")), ["title_id"], ["n_families"]),)
    known = coverage.groupBy("title_id").agg(F.collect_set("kind").alias("kinds"))
    out = provisions.join(known, "title_id", "left")
    for kind, counts, on, names in parts:
        out = out.join(counts, on, "left")
        covered = F.coalesce(F.array_contains("kinds", kind), F.lit(False))
        out = out.withColumns({n: F.when(covered, F.coalesce(n, F.lit(0))) for n in names})
    related = F.col("n_families") if families is not None else F.lit(None).cast("long").alias("n_families")
    return out.select(*key, "n_citing", "n_instruments", "n_naming", "n_amendments", related)


def toc_summary(toc: DataFrame) -> DataFrame:
    """A7. title_id, n_entries, n_numbered, n_parts, n_volumes, n_schedules, first_number, last_number (in document order).

    n_volumes counts the documents of a column volume (null without one), n_schedules the schedules that are in no other.
    """
    numbered = F.when(F.col("number").isNotNull(), F.col("ord"))
    held = toc_ancestors(toc)
    outermost = F.size(F.filter("breadcrumb", lambda x: container_rank(x).eqNullSafe(F.lit(1)))) == 1
    volumes = F.count_distinct("volume") if "volume" in toc.columns else F.lit(None).cast("long")
    return held.groupBy("title_id").agg(
        F.count("*").alias("n_entries"),
        F.count("number").alias("n_numbered"),
        F.count_if(F.col("depth") == 1).alias("n_parts"),
        volumes.alias("n_volumes"),
        F.count_if(outermost & (F.col("schedule_ord") == F.col("ord"))).alias("n_schedules"),
        F.min_by("number", numbered).alias("first_number"),
        F.max_by("number", numbered).alias("last_number"),
    )


def risk_score(findings: DataFrame) -> DataFrame:
    """A8. doc_id, score, grade: high 3, medium 1, low 0; 0 low, to 3 moderate, to 8 elevated, else high."""
    weight = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 1).otherwise(0)
    out = findings.groupBy("doc_id").agg(F.sum(weight).alias("score"))
    return out.withColumn("grade", F.when(F.col("score") == 0, "low").when(F.col("score") <= 3, "moderate").when(F.col("score") <= 8, "elevated").otherwise("high"))


def doc_type(docs: DataFrame, signals: DataFrame | list[tuple[str, str, int]], *, floor: int = 4, override: tuple[str, ...] = ("claim", "demand"), override_at: int = 6) -> DataFrame:
    """A9. doc_id, doc_type, score: summed weights of the signals (type, pattern, weight) that occur.

    An override type of override_at or more wins; else the greatest score above the floor, the type declared first
    on ties; else 'other' with score 0.
    """
    rows = rule_rows(signals)
    types = list(dict.fromkeys(t for t, _, _ in rows))
    patterns = list(dict.fromkeys(p for _, p, _ in rows))
    weights = {t: constant([sum(w for s, q, w in rows if s == t and q == p) for p in patterns], "array<int>") for t in types}

    def total(hits: Column, weight: Column) -> Column:
        return F.aggregate(hits, F.lit(0), lambda s, i: s + F.get(weight, i))

    def chosen(hits: Column) -> Column:
        sums = {t: total(hits, weights[t]) for t in types}
        return F.array_max(F.array(*[F.struct((F.lit(t).isin(*override) & (sums[t] >= override_at)).cast("int").alias("first"), sums[t].alias("score"), F.lit(-i).alias("declared"), F.lit(t).alias("type")) for i, t in enumerate(types)]))

    best = docs.select("doc_id", let(pattern_hits(F.col("text"), patterns), chosen).alias("b"))
    wins = (F.col("b.first") == 1) | (F.col("b.score") > floor)
    return best.select("doc_id", F.when(wins, F.col("b.type")).otherwise("other").alias("doc_type"), F.when(wins, F.col("b.score")).otherwise(0).alias("score"))


def source_totals(results: DataFrame) -> DataFrame:
    """A10. query_id, total (the row count where a source gives none), unreliable, notes."""
    return results.groupBy("query_id").agg(
        F.sum(F.coalesce("total", "n_rows")).alias("total"), F.bool_or("unreliable").alias("unreliable"), F.array_join(F.array_sort(F.collect_set("note")), "; ").alias("notes")
    )


def amenders(versions: DataFrame) -> DataFrame:
    """A11. title_id, n_versions, the versions of each affect as columns, and n_acts: the distinct Acts that amend or repeal.

    Acts come from reasons (array<struct<affect, affecting_id>>); without that column n_acts is null. A version with
    several reasons counts once as a version.
    """
    kinds = ("AsMade", "Amend", "Repeal")
    out = versions.groupBy("title_id").agg(F.count("*").alias("n_versions"), *(F.count_if(F.col("affect") == k).alias(f"n_{k.lower()}") for k in kinds))
    if "reasons" not in versions.columns:
        return out.withColumn("n_acts", F.lit(None).cast("long"))
    acts = versions.select("title_id", F.explode("reasons").alias("r")).filter(F.col("r.affect").isin("Amend", "Repeal")).groupBy("title_id").agg(F.count_distinct("r.affecting_id").alias("n_acts"))
    return out.join(acts, "title_id", "left").withColumn("n_acts", F.coalesce("n_acts", F.lit(0).cast("long")))


def rule_hit_matrix(findings: DataFrame) -> DataFrame:
    """A12. category, severity, n over the cube of both; 'all' stands for a sum."""
    out = findings.cube("category", "severity").agg(F.count("*").alias("n"), F.grouping("category").alias("gc"), F.grouping("severity").alias("gs"))
    return out.select(F.when(F.col("gc") == 1, "all").otherwise(F.col("category")).alias("category"), F.when(F.col("gs") == 1, "all").otherwise(F.col("severity")).alias("severity"), "n")


def facet_counts(hits: DataFrame, facet: str) -> DataFrame:
    """A13. facet value, n."""
    return hits.groupBy(F.col(facet).alias("facet")).agg(F.count("*").alias("n"))

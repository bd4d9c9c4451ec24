"""Windows over versions, hits and tables of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexframe.functions.courts import court_tier


def latest_version(versions: DataFrame) -> DataFrame:
    """W1. The row with the greatest since of each title (ties: the greatest register_id)."""
    row = F.struct(*versions.columns)
    return versions.groupBy("title_id").agg(F.max_by(row, F.struct("since", "register_id")).alias("row")).select("row.*")


def current_vs_latest(versions: DataFrame, as_at) -> DataFrame:
    """W2. title_id, current_id, latest_id, lags: the version in force at a date against the latest registered."""
    day = F.lit(as_at).cast("date")
    current = (F.col("since") <= day) & (F.col("until").isNull() | (day < F.col("until")))
    out = versions.groupBy("title_id").agg(
        F.max_by(F.when(current, F.col("register_id")), F.when(current, F.col("since"))).alias("current_id"), F.max_by("register_id", "since").alias("latest_id")
    )
    return out.withColumn("lags", ~F.col("current_id").eqNullSafe(F.col("latest_id")))


def version_pairs(versions: DataFrame) -> DataFrame:
    """W3. Each version with the one before it in its title (previous_id, previous_since); the first has none."""
    order = Window.partitionBy("title_id").orderBy("since", "register_id")
    return versions.withColumns({"previous_id": F.lag("register_id").over(order), "previous_since": F.lag("since").over(order)}).filter("previous_id is not null")


def chosen_pairs(versions: DataFrame, chosen: Column) -> DataFrame:
    """W3. Each chosen version with the chosen one before it in its title, and what happened in between.

    title_id, since, register_id, previous_id, previous_since, reasons (the affects of the versions after the previous chosen one,
    up to this one, in order), left_out (how many versions between aren't chosen). Versions are parted into segments that
    end with a chosen one; one behind the last chosen one belongs to no pair, as does the first chosen one.
    """
    order = Window.partitionBy("title_id").orderBy("since", "register_id")
    before = F.coalesce(F.sum(F.coalesce(chosen, F.lit(False)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = versions.withColumns({"_seg": before, "_chosen": F.coalesce(chosen, F.lit(False))})
    pick = lambda c: F.max(F.when(F.col("_chosen"), F.col(c))).alias(c)
    gathered = F.transform(F.array_sort(F.collect_list(F.struct("since", "register_id", "affect"))), lambda x: x["affect"])
    parts = rows.groupBy("title_id", "_seg").agg(pick("since"), pick("register_id"), gathered.alias("reasons"), F.count_if(~F.col("_chosen")).alias("left_out")).filter("register_id is not null")
    by = Window.partitionBy("title_id").orderBy("_seg")
    out = parts.withColumns({"previous_id": F.lag("register_id").over(by), "previous_since": F.lag("since").over(by)}).filter("previous_id is not null")
    return out.select("title_id", "since", "register_id", "previous_id", "previous_since", "reasons", "left_out")


def later_versions(events: DataFrame, versions: DataFrame, today=None) -> DataFrame:
    """W4. events with n_later: the versions of their title that start after d, up to today.

    Events and versions of a title go through one window; no pair of them is made.
    """
    starts = versions if today is None else versions.filter(F.col("since") <= F.lit(today).cast("date"))
    both = events.select(*events.columns, F.lit(0).alias("_v")).unionByName(starts.select("title_id", F.col("since").alias("d"), F.lit(1).alias("_v")), allowMissingColumns=True)
    # From the latest day back, so that the sum runs on and no frame is read twice.
    after = Window.partitionBy("title_id").orderBy(-F.col("d").cast("timestamp").cast("long")).rangeBetween(Window.unboundedPreceding, -1)
    return both.withColumn("n_later", F.coalesce(F.sum("_v").over(after), F.lit(0))).filter("_v = 0").drop("_v")


def interleave(hits: DataFrame, order: str = "source_order") -> DataFrame:
    """W5. hits with slot, 1 and up in each query: round-robin over the sources, each in its own order."""
    return hits.withColumn("slot", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", order)))


def _deepest(toc: DataFrame) -> int:
    """The greatest depth of a table of contents, one number: there is a window for each level, however many there are."""
    return toc.agg(F.max("depth")).first()[0] or 0


#: The units that hold others, outermost first.
CONTAINERS = ("schedule", "chapter", "part", "division", "subdivision")


def container_rank(label: Column) -> Column:
    """1 for a label that begins with the outermost of CONTAINERS, and so on; null for others."""
    word = F.regexp_replace(F.lower(F.regexp_extract(label, r"^\w+", 0)), "^schedules$", "schedule")
    place = F.array_position(F.array(*[F.lit(c) for c in CONTAINERS]), word)
    return F.when(place > 0, place)


def toc_ancestors(toc: DataFrame) -> DataFrame:
    """W6. toc with parent_ord, breadcrumb (labels from the top to the node), schedule_ord (the schedule that it is in,
    its own ord for a schedule, null outside), by one forward fill for each level that the data has."""
    sofar = Window.partitionBy("title_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    levels = range(1, _deepest(toc) + 1)
    kind = "array<struct<ord:bigint,label:string>>"
    last = {k: F.last(F.when(F.col("depth") == k, F.struct("ord", "label")), ignorenulls=True).over(sofar) for k in levels}
    out = toc.withColumns({f"_a{k}": c for k, c in last.items()})
    # A level that the node's own branch left out would show a node of an earlier branch; a later level's node
    # always stands behind that of the level above it, so what goes back in order is dropped.
    chain = F.array_compact(F.array(*[F.when(F.col("depth") >= k, F.col(f"_a{k}")) for k in levels])) if levels else F.array()
    kept = F.aggregate(F.reverse(chain.cast(kind)), F.array().cast(kind), lambda kept, x: F.when((F.size(kept) == 0) | (x["ord"] < F.try_element_at(kept, F.lit(-1))["ord"]), F.array_append(kept, x)).otherwise(kept))
    out = out.withColumn("_chain", F.reverse(kept)).withColumn("parent_ord", F.try_element_at("_chain", F.lit(-2))["ord"])
    owner = F.try_element_at(F.filter("_chain", lambda x: container_rank(x["label"]).eqNullSafe(F.lit(1))), F.lit(-1))["ord"]
    return out.withColumns({"breadcrumb": F.transform("_chain", lambda x: x["label"]), "schedule_ord": owner}).drop("_chain", *(f"_a{k}" for k in levels))


def toc_subtree_range(toc: DataFrame) -> DataFrame:
    """W7. toc with end_ord: the first later ord of its title at the same depth or above, or one past the last.

    A container (CONTAINERS) without entries below it owns the entries of its own depth behind it, down to the next
    container of its rank or above, an endnote, or anything less deep.
    """
    # Read from the end of a title, so that the nearest later entry is the last one met.
    later = Window.partitionBy("title_id").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("title_id")
    levels = range(1, _deepest(toc) + 1)
    ranked = toc.withColumns({"_rank": container_rank(F.col("label")), "_note": F.col("label").rlike(r"(?i)^(endnotes?\b|notes? to the\b)")})
    nearest = lambda test: F.last(F.when(test, F.col("ord")), ignorenulls=True).over(later)
    depth, rank = F.col("depth"), F.col("_rank")
    ends = F.coalesce(*(F.when(depth == k, nearest(depth <= k)) for k in levels), F.lit(None).cast("long"))
    runs = F.coalesce(
        *(F.when((depth == k) & (rank == r), nearest((depth < k) | ((depth == k) & (F.col("_note") | (rank <= r))))) for k in levels for r in range(1, len(CONTAINERS) + 1)),
        F.lit(None).cast("long"),
    )
    past = F.max("ord").over(whole) + 1
    following = F.lag("ord").over(Window.partitionBy("title_id").orderBy(F.desc("ord")))
    out = ranked.withColumns({"_end": F.coalesce(ends, past), "_run": F.coalesce(runs, past), "_next": F.coalesce(following, past)})
    return out.withColumn("end_ord", F.when(rank.isNotNull() & (F.col("_end") == F.col("_next")), F.col("_run")).otherwise(F.col("_end"))).drop("_rank", "_note", "_end", "_run", "_next")


def slice_provision(volumes: DataFrame, toc: DataFrame) -> DataFrame:
    """W8. title_id, anchor, text: what stands between an entry's anchor and the next one that the contents list.

    volumes: title_id, html. Paragraphs between a listed anchor and the next are gathered under it.
    """
    parts = volumes.select("title_id", F.posexplode(F.split("html", r'(?=<[a-z0-9]+[^<>]*\bid=")')).alias("n", "part")).withColumn("id", F.nullif(F.regexp_extract("part", r'^<[a-z0-9]+[^<>]*\bid="([^"]*)"', 1), F.lit("")))
    listed = parts.join(toc.select("title_id", F.col("anchor").alias("id"), F.lit(True).alias("listed")).distinct(), ["title_id", "id"], "left")
    fill = Window.partitionBy("title_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    filled = listed.withColumn("anchor", F.last(F.when(F.col("listed"), F.col("id")), ignorenulls=True).over(fill)).filter("anchor is not null")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]), "")
    return filled.groupBy("title_id", "anchor").agg(F.trim(F.regexp_replace(F.regexp_replace(text, "<[^<>]*>", " "), r"\s+", " ")).alias("text"))


def nearest_entries(refs: DataFrame, toc: DataFrame, k: int = 3) -> DataFrame:
    """W9. For each missing number (ref_id, title_id, number) the k numbered entries closest to it (ties: lower ord).

    The k distinct numbers at or below a ref and the k above it come from windows over both in the order of numbers,
    the entries of these numbers (of each the k first) by an equi-join: no ref meets all entries of its title.
    """
    entries = toc.filter("number is not null").select("title_id", "number", "ord", "label")
    first = Window.partitionBy("title_id", "number").orderBy("ord")
    entries = entries.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k).drop("_n")
    points = entries.select("title_id", "number").distinct().withColumn("ref_id", F.lit(None).cast(refs.schema["ref_id"].dataType))
    both = refs.select("title_id", F.col("number").cast("long").alias("number"), "ref_id").unionByName(points)
    is_point = F.col("ref_id").isNull()
    point = F.when(is_point, F.col("number"))
    # The j-th entry before a ref is the (count so far - j)-th of its title, so counts and an equi-join lead to it.
    order = Window.partitionBy("title_id").orderBy("number", (~is_point).cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_at", F.count(point).over(order))
    numbered = both.filter(is_point).select("title_id", F.col("_at"), F.col("number").alias("_near"))
    asked = both.filter(~is_point).select("title_id", "number", "ref_id", F.explode(F.sequence(F.col("_at") - (k - 1), F.col("_at") + k)).alias("_at"))
    near = asked.join(numbered, ["title_id", "_at"]).join(entries.withColumnRenamed("number", "_near"), ["title_id", "_near"])
    near = near.withColumn("distance", F.abs(F.col("_near") - F.col("number")))
    best = Window.partitionBy("ref_id").orderBy("distance", "ord")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("ref_id", "title_id", "number", "rank", "ord", "label", "distance")


def forward_fill_scope(lines: DataFrame, heading: str = "heading") -> DataFrame:
    """W10. lines (title_id, n, heading, ...) with scope: the last heading at or above each line."""
    sofar = Window.partitionBy("title_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("scope", F.last(heading, ignorenulls=True).over(sofar))


def antecedent(citations: DataFrame) -> DataFrame:
    """W11. citations with law: their own name, or for an anaphor ('the Act') that of the last full citation
    before it in the same paragraph; none in the paragraph gives null."""
    before = Window.partitionBy("doc_id", "para").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return citations.withColumn("law", F.coalesce("law_name", F.last("law_name", ignorenulls=True).over(before)))


def dedupe_citations(citations: DataFrame, *key: str) -> DataFrame:
    """W12. The first citation of each key in its document."""
    order = Window.partitionBy("doc_id", *key).orderBy("pos")
    return citations.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def prioritise_citing(hits: DataFrame, k: int | None = None) -> DataFrame:
    """W13. hits with rank in their target: by the tier of their court (court_tier), newest first, then by id."""
    tier = court_tier(F.regexp_extract("citation", r"^\[[0-9]{4}\] ([A-Za-z0-9.]+) ", 1))
    order = Window.partitionBy("target").orderBy("tier", F.desc_nulls_last("date"), "doc_id")
    out = hits.withColumn("tier", tier).withColumn("rank", F.row_number().over(order))
    return out if k is None else out.filter(F.col("rank") <= k)

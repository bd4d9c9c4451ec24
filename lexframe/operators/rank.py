"""Scored rankings, paging and top-k (K1-K7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexframe.functions.folds import fold_key, fold_words, stem_tokens
from lexframe.operators.containing import containing


#: Points of a title for how its name meets the query, and for what it is.
NAME_EXACT, NAME_PREFIX, NAME_WITHIN, FORMER_NAME = 100, 60, 30, 45
PRINCIPAL, ACT, IN_FORCE, REPEALED = 25, 20, 15, -10


def title_points(query: Column, key: Column, former: Column) -> Column:
    """K1's points of a title (is_principal, collection, status) whose folded name is `key` and former ones `former`."""
    name = F.when(key == query, NAME_EXACT).when(key.startswith(query), NAME_PREFIX).when(key.contains(query), NAME_WITHIN).otherwise(0)
    kind = F.when(F.col("is_principal"), PRINCIPAL).otherwise(0) + F.when(F.col("collection") == "Act", ACT).otherwise(0)
    state = F.when(F.col("status") == "InForce", IN_FORCE).when(F.col("status") == "Repealed", REPEALED).otherwise(0)
    return name + kind + state + FORMER_NAME * F.size(F.filter(former, lambda x: x == query))


def folded_titles(titles: DataFrame) -> DataFrame:
    """titles with key (the folded name) and former (the folded former names, none without a name_history)."""
    history = F.coalesce("name_history", F.array().cast(titles.schema["name_history"].dataType)) if "name_history" in titles.columns else None
    former = F.array().cast("array<string>") if history is None else F.transform(history, lambda h: fold_key(h["name"], ascii_only=True))
    return titles.select("id", "name", "is_principal", "collection", "status", fold_key(F.col("name"), ascii_only=True).alias("key"), former.alias("former"))


def rank_titles(queries: DataFrame, titles: DataFrame, k: int = 10) -> DataFrame:
    """K1. query_id, rank, id, points for the k best titles of each query.

    Name 100 equal, 60 prefix, 30 within, 45 for each equal former name (name_history array<struct<name, ...>>);
    principal 25, Act 20, in force 15, repealed -10. Ties by id. Only titles whose folded name contains the query, or a
    former name of which is the query, count; they are found by equi-joins (see containing), whatever the tables' sizes.
    """
    asked = queries.select("query_id", fold_key(F.col("query"), ascii_only=True).alias("q")).filter("q <> ''")
    held = folded_titles(titles)
    within = containing(asked.select(F.col("q").alias("needle"), F.col("q").alias("s")).distinct(), held.select(F.col("id").alias("hay"), F.col("key").alias("s")))
    renamed = held.select(F.explode("former").alias("needle"), F.col("id").alias("hay"))
    pairs = within.unionByName(renamed).distinct().join(asked.withColumn("needle", F.col("q")), "needle").select("query_id", "q", F.col("hay").alias("id"))
    found = pairs.join(held, "id").withColumn("points", title_points(F.col("q"), F.col("key"), F.col("former")))
    order = Window.partitionBy("query_id").orderBy(F.desc("points"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "points")


def rarest(asked: DataFrame, held: DataFrame, *key: str, most: Column) -> DataFrame:
    """The key columns and word: of each key's distinct `words` the `most` that the fewest rows of held (word) have, ties by word.

    What must share all but `most` - 1 words of a key shares one of these, so a join on them alone finds it.
    """
    often = held.groupBy("word").agg(F.count("*").alias("_df"))
    each = asked.select(*key, most.alias("_most"), F.explode("words").alias("word")).join(often, "word", "left")
    order = Window.partitionBy(*key).orderBy(F.coalesce("_df", F.lit(0)), "word")
    return each.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= F.col("_most")).select(*key, "word")


def rank_base_law(queries: DataFrame, titles: DataFrame, anchors: DataFrame, k: int = 3, *, common: int = 1000) -> DataFrame:
    """K2. query_id, rank, id, points: the titles a question most likely rests on.

    Anchored 200; name overlap 60 + 30 of the share of the name's words that the question has; principal 25, else
    -100; Act 20; in force 15, repealed -10. Candidates share a word with the question.

    Words of more than `common` titles make no pair for each title: titles that differ in other words only (the same
    common words, number of words and standing points) score alike for a question that shares none of the others, so
    the k least ids of each such class stand for it. That gives the same rows for any `common`.
    """
    standing = F.when(F.col("is_principal"), 25).otherwise(-100) + F.when(F.col("collection") == "Act", 20).otherwise(0) + F.when(F.col("status") == "InForce", 15).when(F.col("status") == "Repealed", -10).otherwise(0)
    held = titles.select("id", F.array_distinct(stem_tokens(F.col("name"))).alias("name_words"), standing.alias("standing"))
    asked = queries.select("query_id", F.array_distinct(stem_tokens(F.col("query"))).alias("query_words"))
    each = held.select("id", F.explode("name_words").alias("word"))
    often = each.groupBy("word").agg(F.count("*").alias("_df")).filter(F.col("_df") > common).select("word")
    sought = asked.select("query_id", F.explode("query_words").alias("word"))
    rare = sought.join(each.join(often, "word", "left_anti"), "word").select("query_id", "id")
    shape = each.join(often, "word").groupBy("id").agg(F.array_sort(F.collect_set("word")).alias("_common")).join(held.select("id", F.size("name_words").alias("_size"), "standing"), "id")
    first = F.row_number().over(Window.partitionBy("_common", "_size", "standing").orderBy("id"))
    stands = shape.withColumn("_n", first).filter(F.col("_n") <= k).select("id", F.explode("_common").alias("word"))
    anchored = anchors.select("query_id", "id", F.lit(True).alias("anchored")).distinct()
    pairs = rare.unionByName(sought.join(stands, "word").select("query_id", "id")).distinct()
    found = pairs.join(anchored, ["query_id", "id"], "full").join(held, "id").join(asked.dropDuplicates(["query_id"]), "query_id", "left")
    share = F.coalesce(F.size(F.array_intersect("name_words", "query_words")), F.lit(0)) / F.greatest(F.size("name_words"), F.lit(1))
    points = F.when(F.col("anchored"), 200).otherwise(0) + F.when(share > 0, 60 + F.round(30 * share)).otherwise(0) + F.col("standing")
    order = Window.partitionBy("query_id").orderBy(F.desc("points"), "id")
    return found.withColumn("points", points.cast("int")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "points")


def rank_terms(queries: DataFrame, terms: DataFrame, k: int = 5) -> DataFrame:
    """K3. query_id, rank, term, score, matched_by of the k best terms for each query.

    exact 100, alias 90, prefix (either way) 78 less the difference in length up to 12, contains 66, words 45 + 25 of
    the overlap from one half on, text 24 for queries of 4 letters or more. Shorter terms first on ties,
    then by name. terms: term, aliases, text. Distinct queries meet only terms that contain them or are inside them (see
    containing) or share one of the rarer half of their words, which whatever has half of the words does.
    """
    q, t = F.col("q"), F.col("t")
    asked = queries.select("query_id", fold_words(F.col("query")).alias("q")).filter("q <> ''")
    held = terms.select("term", fold_words(F.col("term")).alias("t"), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), fold_words).alias("a"), fold_words(F.coalesce("text", F.lit(""))).alias("x"))
    sought = asked.select("q").distinct()
    every = F.array_distinct(F.concat(F.array("t", "x"), F.col("a")))
    inside = containing(sought.select(q.alias("needle"), q.alias("s")), held.select(F.col("term").alias("hay"), F.explode(every).alias("s"))).select(F.col("needle").alias("q"), F.col("hay").alias("term"))
    around = containing(held.select(F.col("term").alias("needle"), t.alias("s")), sought.select(q.alias("hay"), q.alias("s"))).select(F.col("hay").alias("q"), F.col("needle").alias("term"))
    each = held.select("term", F.explode(F.array_distinct(F.split(t, " "))).alias("word"))
    probes = sought.select("q", F.array_distinct(F.split(q, " ")).alias("words"))
    common = rarest(probes, each, "q", most=F.floor(F.size("words") / 2) + 1).join(each, "word").select("q", "term")
    pairs = inside.unionByName(around).unionByName(common).distinct()
    words = F.split(q, " ")
    overlap = F.size(F.array_intersect(words, F.split(t, " "))) / F.greatest(F.size(F.array_distinct(words)), F.lit(1))
    cases = [
        ("exact", q == t, F.lit(100.0)),
        ("alias", F.array_contains("a", q), F.lit(90.0)),
        ("prefix", t.startswith(q) | q.startswith(t), 78.0 - F.least(F.lit(12), F.abs(F.length(t) - F.length(q)))),
        ("contains", t.contains(q) | q.contains(t), F.lit(66.0)),
        ("words", overlap >= 0.5, 45.0 + F.round(overlap * 25)),
        ("text", F.col("x").contains(q) & (F.length(q) >= 4), F.lit(24.0)),
    ]
    score, by = F.lit(None).cast("double"), F.lit(None).cast("string")
    for name, test, points in reversed(cases):
        score, by = F.when(test, points).otherwise(score), F.when(test, F.lit(name)).otherwise(by)
    scored = pairs.join(held, "term").withColumns({"score": score.cast("int"), "matched_by": by}).filter("score is not null").select("q", "term", "score", "matched_by").distinct()
    found = asked.join(scored, "q")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.length("term"), "term")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "term", "score", "matched_by")


def rerank(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """K4. hits with new_rank: by supplied relevance, the old rank on ties; a query with any score missing keeps its order."""
    whole = Window.partitionBy("query_id")
    out = hits.join(scores, ["query_id", "id"], "left").withColumn("all_scored", F.bool_and(F.col("relevance").isNotNull()).over(whole))
    order = whole.orderBy(F.desc(F.when(F.col("all_scored"), F.col("relevance")).otherwise(0.0)), "rank", "id")
    return out.withColumn("new_rank", F.row_number().over(order)).drop("all_scored")


def preferred_citation(citations: DataFrame) -> DataFrame:
    """K5. case_id, citation: of parallel citations authorised 1 before general 2, subject 3, medium-neutral 4."""
    return citations.groupBy("case_id").agg(F.min_by("citation", F.struct("rank", "citation")).alias("citation"))


def page(df: DataFrame, order: list, limit: int, skip: int = 0) -> DataFrame:
    """K6. One page of an ordered table, with the total of all rows."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(skip).limit(limit).join(F.broadcast(total))


def search_then_detail(hits: DataFrame, docs: DataFrame, k: int = 2) -> DataFrame:
    """K7. query_id, id, text, status: the k best distinct ids of each query joined to their documents."""
    once = hits.groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    top = once.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id"))).filter(F.col("_n") <= k).drop("_n")
    out = top.join(docs.withColumnRenamed("doc_id", "id"), "id", "left")
    return out.withColumn("status", F.when(F.col("text").isNull(), "absent").otherwise("found"))

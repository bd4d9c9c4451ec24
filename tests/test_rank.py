"""Rankings that join on rare words give the rows of trying every pair."""

import random

from pyspark.sql import functions as F

from compare import of_spark
from lexframe.functions.folds import fold_words, stem_tokens
from lexframe.operators import rank

WORDS = ["privacy", "tax", "customs", "native", "title", "water", "health", "radio", "data", "care"]


def _titles(spark, n):
    rng = random.Random(5)
    rows = [(f"C{i:04}", " ".join([*rng.sample(WORDS, rng.randrange(4)), "Act"]), rng.random() < 0.7, rng.choice(["Act", "Gazette"]), rng.choice(["InForce", "Repealed", None])) for i in range(n)]
    return spark.createDataFrame([*rows, ("Z1", None, None, None, None), ("Z2", "", True, "Act", "InForce")], "id string, name string, is_principal boolean, collection string, status string")


def _asked(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.sample([*WORDS, "act", "which"], rng.randrange(5)))) for i in range(30)]
    return spark.createDataFrame([*rows, (90, "which act"), (91, None), (92, ""), (93, "act act")], "query_id int, query string")


def _every_pair(queries, titles, anchors, k):
    words = lambda c: F.array_distinct(stem_tokens(F.col(c)))
    title = titles.select("id", "is_principal", "collection", "status", words("name").alias("t"))
    pairs = queries.select("query_id", words("query").alias("q")).join(title, F.lit(True)).join(anchors.withColumn("a", F.lit(200)), ["query_id", "id"], "left")
    shared = F.coalesce(F.size(F.array_intersect("q", "t")), F.lit(0))
    points = F.coalesce("a", F.lit(0)) + F.when(shared > 0, 60 + F.round(30 * shared / F.size("t"))).otherwise(0) + F.when(F.col("is_principal"), 25).otherwise(-100)
    points = points + F.when(F.col("collection") == "Act", 20).otherwise(0) + F.when(F.col("status") == "InForce", 15).when(F.col("status") == "Repealed", -10).otherwise(0)
    rows = pairs.filter((shared > 0) | F.col("a").isNotNull()).select("query_id", "id", points.cast("int").alias("points")).collect()
    out = []
    for q in {r.query_id for r in rows}:
        best = sorted((-r.points, r.id) for r in rows if r.query_id == q)[:k]
        out += [(q, n, i, -p) for n, (p, i) in enumerate(best, 1)]
    return sorted(out)


def test_base_law_for_any_bound_of_common_words(spark):
    titles, asked = _titles(spark, 300).cache(), _asked(spark).cache()
    anchors = spark.createDataFrame([(90, "C0299"), (1, "C0150"), (91, "C0001")], "query_id int, id string")
    want = _every_pair(asked, titles, anchors, 3)
    for common in (0, 20, 120, 10_000):
        got = rank.rank_base_law(asked, titles, anchors, 3, common=common)
        assert sorted(map(tuple, got.select("query_id", "rank", "id", "points").collect())) == want
    assert len(want) > 80


def test_terms_that_share_half_of_the_words(spark):
    rng = random.Random(8)
    terms = spark.createDataFrame([(" ".join(rng.sample([*WORDS, "act"], rng.randrange(1, 5))) + f" {i}", None, None) for i in range(150)], "term string, aliases array<string>, text string").cache()
    asked = spark.createDataFrame([(i, " ".join(rng.choice([*WORDS, "act", "zzz"]) for _ in range(rng.randrange(1, 7)))) for i in range(40)], "query_id int, query string").cache()
    got = {(r.query_id, r.term) for r in rank.rank_terms(asked, terms, 1000).collect()}
    pairs = asked.select("query_id", fold_words(F.col("query")).alias("q")).join(terms.select("term", fold_words(F.col("term")).alias("t")), F.lit(True))
    words = lambda c: F.array_distinct(F.split(c, " "))
    half = F.size(F.array_intersect(words("q"), words("t"))) / F.size(words("q")) >= 0.5
    want = {(r.query_id, r.term) for r in pairs.filter(half | F.col("t").contains(F.col("q")) | F.col("q").contains(F.col("t"))).collect()}
    assert got == want and len(want) > 200


def test_rarest_words(spark):
    held = spark.createDataFrame([(w,) for w in "aaabbc"], "word string")
    asked = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, ["b", "a"]), (3, [])], "k int, words array<string>")
    assert of_spark(rank.rarest(asked, held, "k", most=F.lit(2))) == of_spark(spark.createDataFrame([(1, "d"), (1, "c"), (2, "b"), (2, "a")], "k int, word string"))

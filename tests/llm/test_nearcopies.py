"""Near copies by shingle sets against a brute-force version."""

import random
import re

from lexframe.llm.nearcopies import drop_near_copies, near_copies
from lexframe.llm.simhash import drop_near_duplicates

SCHEMA = "doc_id long, text string"


def plain_set(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def plain_components(rows):
    sets = [(i, plain_set(t)) for i, t in rows]
    at = list(range(len(sets)))
    for x, (_, a) in enumerate(sets):
        for y in range(x):
            b = sets[y][1]
            same = len(a & b)
            if same / (len(a) + len(b) - same) >= 0.8 and at[x] != at[y]:
                at = [at[y] if z == at[x] else z for z in at]
    least = {}
    for (i, _), z in zip(sets, at):
        if i is not None:
            least[z] = min(i, least.get(z, i))
    return sorted(((i, least.get(z)) for (i, _), z in zip(sets, at)), key=str)


def got(df):
    return sorted(((r.doc_id, r.component_id) for r in df.collect()), key=str)


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.randrange(10**6)}"
    return words


def test_copies_of_similarity_around_the_bound(spark):
    rng = random.Random(3)
    rows = []
    for g in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(40, 400))]
        for n in (0, len(words) // 50, len(words) // 45, len(words) // 35):
            rows.append((len(rows), " ".join(edited(rng, words, n))))
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain_components(rows)
    assert got(near_copies(df)) == want
    kept = {r.doc_id for r in drop_near_copies(df).collect()}
    assert kept == {c for _, c in want}
    # What the stage did before: four bits of a fingerprint of four words leave most of these copies.
    assert len(kept) < 0.7 * drop_near_duplicates(df).count()


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert got(near_copies(docs)) == plain_components([tuple(r) for r in docs.collect()])


def test_nulls_empty_ties_repeats(spark):
    rows = [(5, None), (3, ""), (9, " \n"), (None, "a b c d e f g"), (7, "A b C d e f g"), (7, "A b C d e f g"), (None, "zz"), (2, "one two three"), (4, "x " * 60000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(near_copies(df)) == plain_components(rows)
    wide = df.selectExpr("doc_id", "text", "1 as `set`", "2 as component_id", "3 as key")
    kept = drop_near_copies(wide).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 2, 3, 4, 7] and set(kept[0].asDict()) == {"doc_id", "text", "set", "component_id", "key"}
    assert drop_near_copies(df.limit(0)).count() == 0


def test_the_pipelines_stage(spark):
    import corpus_pipeline as p

    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = [(i, " ".join(edited(rng, words, 0 if i == 0 else 5))) for i in range(6)]
    assert [r.doc_id for r in p.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()] == [0]


def test_a_join_with_more_hot_keys_than_its_bound(spark):
    from pyspark.sql import functions as F

    from lexframe.llm._common import hot_join

    pairs = spark.range(300).select(F.col("id").alias("a")).crossJoin(spark.range(300).select(F.col("id").alias("b"))).filter("a < b")
    both = pairs.select(F.col("a").alias("x")).unionByName(pairs.select(F.col("b").alias("x"))).groupBy("x").agg(F.count("*").alias("_n"))
    for total in (pairs.count(), 2 * pairs.count()):
        joined = hot_join(hot_join(pairs, both.withColumnRenamed("x", "a"), "a", total), both.withColumnRenamed("x", "b"), "b", total)
        assert joined.count() == pairs.count() == 44850


def test_a_dense_group_with_many_links(spark):
    rng = random.Random(11)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(360):
        words = list(base)
        for place in range(8):
            words[12 + 24 * place] = f"slot{place}x{rng.randrange(12)}"
        rows.append((i, " ".join(words)))
    assert got(near_copies(spark.createDataFrame(rows, SCHEMA))) == plain_components(rows)

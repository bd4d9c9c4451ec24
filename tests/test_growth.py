"""Steps whose work or whose largest task grew faster than their input: what their plans hold now, and the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from lexframe.functions import citations, texts
from lexframe.operators import joins
from lexframe.plans.flows import compare_versions
from lexframe.sources import landed


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_rules_of_plain_words(spark):
    """each rule was held against all patterns that occur, each word tried as a pattern on the whole text."""
    rng = random.Random(5)
    words = ["fee", "Fee", "rent", "notice", "caf", "term", "x_y", "9"]
    body = lambda: "".join(rng.choice([*words, "café", "éfee", "feé", "rent²"]) + rng.choice([" ", ", ", "-", "\n"]) for _ in range(rng.randrange(7)))
    pick = lambda n: [("(?i)" if rng.random() < 0.4 else "") + rf"\b{w}\b" for w in rng.choices(words, k=n)]
    rules = [(f"r{i}", "c", "low", pick(rng.randrange(3)), pick(rng.randrange(3))) for i in range(60)]
    clauses = spark.createDataFrame([(i, i, body()) for i in range(200)], "doc_id long, n long, body string")
    found = texts.risk_scan(clauses, rules)
    patterns = sorted({p for r in rules for p in (*r[3], *r[4])})
    tried = clauses.select("doc_id", *(F.col("body").rlike(p).alias(p.replace("\\", "/")) for p in patterns)).collect()
    has = {r.doc_id: {p for p in patterns if r[p.replace("\\", "/")]} for r in tried}
    want = {(d, r[0]) for d, h in has.items() for r in rules if (r[3] or r[4]) and h.issuperset(r[3]) and (not r[4] or h & set(r[4]))}
    assert {(r.doc_id, r.rule) for r in found.collect()} == want and len(want) > 100
    assert "array_except" not in _plan(found) and "arrays_overlap" not in _plan(found)


def test_bigrams_as_numbers(spark):
    """every letter was an element of an array, and every pair a text."""
    rows = [(1, "Night", "nacht"), (2, "a", "A!"), (3, "a", "ab"), (4, "", None), (5, None, "abc"), (6, "aaaa", "aa a"), (7, "Zz 99", "9 zz9")]
    got = spark.createDataFrame(rows, "id int, a string, b string").select("id", texts.dice_similarity(F.col("a"), F.col("b")).alias("d"))
    assert {r.id: pytest.approx(r.d) for r in got.collect()} == {1: 0.25, 2: 1.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 1.0, 7: 2 * 2 / 6}
    assert "zip_with" not in _plan(got)


def test_conflicts_split_clauses_once(spark):
    """clauses were split four times; and a side whose rule had fewer patterns than occur in a clause was lost."""
    docs = spark.createDataFrame([(1, "1. A fee is payable, then terminate\n2. We terminate"), (2, "1. payable\n2. x\n3. terminate"), (3, "payable or terminate"), (4, "1. payable\nterminate"), (5, "1. payable and terminate\n2. x")], "doc_id long, text string")
    found = texts.document_conflicts(docs, [("exit", "payable", "terminate")])
    assert _plan(found).count("posexplode(") == 1
    assert {tuple(r) for r in found.collect()} == {(1, "exit", "1", "2"), (2, "exit", "1", "3"), (3, "exit", None, None), (4, "exit", None, None)}
    alone = texts.clause_conflicts(texts.split_clauses(docs), [("exit", "payable", "terminate")])
    assert {tuple(r) for r in alone.collect()} == {(1, "exit", "1", "2"), (2, "exit", "1", "3")}


def test_references_are_taken_apart_in_one_pass(spark):
    """each of six groups was a pass of its own over a reference."""
    refs = spark.createDataFrame([("sch 2 s 134A(1)(b)",), ("ss 5-7",), ("Part IVA",), ("s 5\n",), ("s\x01 5",), ("a\x01b\x01c\x01d\x01e\x01f\x01",), ("nothing",), (None,)], "r string").coalesce(1)
    got = refs.select("r", citations.parse_ref(F.col("r")).alias("p"))
    assert "regexp_extract(" not in _plan(got)
    rows = {r.r: None if r.p is None else (r.p.kind, r.p.number, r.p.suffix, r.p.subsections, r.p.schedule, r.p.range_end, r.p.value) for r in got.collect()}
    assert rows.pop("sch 2 s 134A(1)(b)") == ("section", "134", "A", ["1", "b"], "2", None, 134)
    assert rows.pop("ss 5-7") == ("section", "5", None, [], None, "7", 5) and rows.pop("Part IVA") == ("part", "IV", "A", [], None, None, 4)
    assert rows.pop("s 5\n") == ("section", "5", None, [], None, None, 5) and set(rows.values()) == {None}


def test_phrases_meet_texts_where_they_are(spark):
    """the texts of all documents were shuffled to meet their candidates."""
    docs = spark.createDataFrame([(1, "It is: OVERRULED, says"), (2, "it is not overruled"), (3, "distinguished"), (4, ""), (5, None), (6, "is overruled it is overruled")], "doc_id long, text string")
    phrases = spark.createDataFrame([(1, "It is overruled"), (2, "Distinguished!"), (3, "!"), (4, "never there")], "phrase_id int, phrase string")
    found = joins.phrase_mentions(docs, phrases)
    assert {tuple(r) for r in found.collect()} == {(1, 1), (3, 2), (6, 1)}
    assert "body" not in "".join(x for x in _plan(found).splitlines() if "Exchange" in x) and _plan(found).count("SortMergeJoin") <= 1


def test_pages_are_not_dealt_by_source(spark):
    """all pages of one source went to one task."""
    pages = spark.range(20).selectExpr("id AS page_id", "'row_divs' AS source", "'<div class=\"row result\"><a href=\"/decision/00000000000000000001\">A v B</a></div>' AS html")
    recipes = landed.listing_recipes(spark)
    for df in (landed.parse_listing(pages, recipes), landed.listing_totals(pages, recipes), landed.parse_decision(pages, landed.decision_recipes(spark))):
        assert "hashpartitioning(source" not in df._jdf.queryExecution().executedPlan().toString() and not any("Join" in x and "source" in x and "Broadcast" not in x for x in _plan(df).splitlines()) and df.count() == 20


def test_versions_are_not_joined_with_themselves(spark):
    """each version's text was joined with the one before it, and the counts with the pairs again."""
    rows = [(7, "1990-01-01", 1, "AsMade", "a\nb"), (7, "1991-01-01", 2, "Amend", "a\nc"), (7, "1992-01-01", 3, "Amend", None), (8, "1990-01-01", 4, "AsMade", "x"), (None, "1990-01-01", 5, "AsMade", "p"), (None, "1991-01-01", 6, "Amend", "p")]
    versions = spark.createDataFrame(rows, "title_id long, since string, register_id long, affect string, text string")
    got = compare_versions(versions)
    assert {(r.pair_id, r.added, r.removed, r.unchanged, r.status) for r in got.collect()} == {(2, 1, 1, 1, "compared"), (3, 1, 2, 0, "compared"), (6, 0, 0, 1, "same")}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # the acts of a title

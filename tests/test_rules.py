"""Rules found by the words of their patterns, against trying every pattern on every text."""

import random
import re

import pytest

from lexframe.functions import rules, texts
from lexframe.functions.patterns import anchors, pattern_hits
from lexframe.operators import aggs

ANCHORS = [
    (r"(?i)\bterminate immediately\b", {"term"}),
    (r"(?i)terminate immediately", {"imme"}),  # no edge before the first word
    (r"payable", None),
    (r"\bfee\b", {"fee"}),
    (r"\bfee", None),  # a longer word may begin so
    (r"\bfees?\b|\bcharges\b", None),  # 'fee' has no edge behind it
    (r"\bfee\b|\bcharge", {"fee", "char"}),
    (r"\b(?:late|early) payment\b", {"paym"}),
    (r"\bcolou?r\b", {"colo"}),
    (r"\bno+ne", None),
    (r"\bnoneo+ne", {"none"}),
    (r"\s*abcd", None),
    (r"\s+abcd", {"abcd"}),
    (r"[ab]|\bfees\b", None),
    (r"(?u)\bfees\b", None),
    (r"[a[b]]fees", None),
    (r"\$ fees", {"fees"}),
    (r"(?:x|\bfees\b)?", None),
]


@pytest.mark.parametrize("pattern, want", ANCHORS)
def test_anchors(pattern, want):
    assert anchors(pattern) == (None if want is None else frozenset(want))


WORDS = ["terminate", "Termination", "fee", "fees", "payable", "éfee", "feeé", "notice", "at", "any", "time", "$5", "no-one", "all", "", "x_fee", "FEE", "K", "rent"]


def _texts(n):
    rng = random.Random(7)
    made = ["".join(rng.choice(WORDS) + rng.choice([" ", ", ", "\n", "-", "  "]) for _ in range(rng.randrange(12))) for _ in range(n)]
    return [*made, None, "", "fee", "word " * 30_000 + "notice"]


def test_same_hits_as_trying_every_pattern(spark):
    patterns = [p for p, _ in ANCHORS if not p.startswith(r"[a[b]")] + [r"(?i)\bnotice$", r"^fee\b", r"(?i)\bfee\W+at\b", r"\bat,", "", r"no-one", r"(?i)any.time", r"(?s)\bfee\b.*\brent\b", r"\bfee{1,2}s", r"\brent(?! all)"]
    docs = spark.createDataFrame(list(enumerate(_texts(300))), "id int, text string").repartition(3)
    got = {r.id: r.hits for r in docs.select("id", pattern_hits(docs.text, patterns).alias("hits")).collect()}
    tried = docs.select("id", *(docs.text.rlike(p).alias(f"p{i}") for i, p in enumerate(patterns))).collect()
    assert got == {r.id: [i for i in range(len(patterns)) if r[f"p{i}"]] for r in tried} and len({tuple(h) for h in got.values()}) > 20


def test_a_thousand_rules_over_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "doc_id AS n", "text AS body")
    held = {r.doc_id: r.body for r in docs.collect()}
    words = sorted({w for t in held.values() for w in re.findall(r"(?<![^\W])[A-Za-z]{2,}(?![^\W])", t or "")})
    rng = random.Random(3)
    made = [(f"r{i}", "c", "low", [rf"\b{rng.choice(words)}\b" for _ in range(rng.randrange(3))], [rf"\b{rng.choice(words)}\b" for _ in range(rng.randrange(1, 4))]) for i in range(1000)]
    table = spark.createDataFrame(made, "rule string, category string, severity string, requires array<string>, any_of array<string>")
    got = sorted((r.doc_id, r.rule) for r in texts.risk_scan(docs, table).collect())
    of = {d: set(re.findall(r"\w+", t or "")) for d, t in held.items()}
    bare = lambda ps: {p[2:-2] for p in ps}
    assert got == sorted((d, name) for d, ws in of.items() for name, _, _, need, some in made if bare(need) <= ws and bare(some) & ws) and len(got) > 1000


def test_shipped_risks(spark):
    bodies = [
        (1, "The supplier may vary these terms at any time."), (2, "You may terminate with a month's notice."), (3, "The term renews automatically."), (4, "You indemnify us for all losses."),
        (5, "We collect personal information and store information overseas."), (6, "Our liability is limited to the fees paid."), (7, "No refunds: all warranties are void."), (8, ""), (9, None),
    ]
    clauses = spark.createDataFrame([(i, 1, b) for i, b in bodies], "doc_id int, n int, body string")
    got = {(r.doc_id, r.rule) for r in texts.risk_scan(clauses, rules.risk_table(spark)).collect()}
    assert got == {(1, "one_sided_change"), (3, "silent_renewal"), (4, "open_indemnity"), (5, "personal_data_use"), (5, "data_abroad"), (6, "liability_limit"), (7, "guarantees_shut_out")}


def test_shipped_conflicts_and_types(spark):
    docs = spark.createDataFrame(
        [(1, "1. Either side gives 30 days' written notice.\n2. We may terminate immediately."), (2, "1. It ends on 1 May.\n2. It renews automatically."), (3, "We have no liability and you indemnify us."), (4, "1. No warranty.\n2. Rent is due."), (5, None)],
        "doc_id int, text string",
    )
    got = {tuple(r) for r in texts.document_conflicts(docs, rules.CONFLICTS).collect()}
    assert got == {(1, "notice and immediate exit", "1", "2"), (2, "end date and renewal", "1", "2"), (3, "no liability and indemnity", None, None)}
    letters = spark.createDataFrame([(1, "STATEMENT OF CLAIM under this agreement between the parties on governing law"), (2, "This agreement binds the parties"), (3, "The landlord and the tenant"), (4, "rent"), (5, None)], "doc_id int, text string")
    assert {(r.doc_id, r.doc_type, r.score) for r in aggs.doc_type(letters, rules.SIGNALS).collect()} == {(1, "claim", 6), (2, "contract", 6), (3, "lease", 7), (4, "other", 0), (5, "other", 0)}


def test_shipped_routes(spark):
    asked = {
        "Please check these citations": "verify_citations", "Is Smith v Jones still good law?": "cite_check", "section 18 of the Privacy Act 1988 as at 2001": "applicable_law", "compare the law as at 2001 and now": "compare_versions",
        "section 18 of the Privacy Act 1988": "slice_provision", "Privacy Act 1988": "title_search", "what does bailment mean": "rank_terms", "hello": "search", "": "search",
    }
    got = texts.route_queries(spark.createDataFrame([(q,) for q in asked], "query string"), rules.ROUTES).collect()
    assert {r.query: r.target for r in got} == asked

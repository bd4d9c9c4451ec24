"""Names in texts and near names against trying everything; references and titles of real shapes; the sweep over spans."""

import random

import pytest
from pyspark.sql import functions as F

from lexframe.functions import citations, names, questions
from lexframe.operators import setops


def words_at(text):
    import re

    return [(m.start(), m.end(), m[0].lower()) for m in re.finditer("[A-Za-z0-9]+", text)]


def plain_names(text, known):
    """Leftmost-longest mentions by trying every name at every word."""
    rows, out, at = words_at(text), [], 0
    split = {x: [w for _, _, w in words_at(x)] for x in known}
    while at < len(rows):
        fits = [(len(w), x) for x, w in split.items() if w and [r[2] for r in rows[at : at + len(w)]] == w]
        if fits:
            n = max(fits)[0]
            out.append((rows[at][0], rows[at + n - 1][1], min(x for k, x in fits if k == n)))
            at += n
        else:
            at += 1
    return out


@pytest.mark.parametrize("chunk", [2000, 20])
def test_names_as_trying_everything(spark, monkeypatch, chunk):
    monkeypatch.setattr(names, "CHUNK", chunk)
    monkeypatch.setattr(names, "BLOCK_BYTES", 100)  # several blocks
    rng = random.Random(chunk)
    known = {" ".join(rng.choice(["Act", "of", "Tax", "the", "A"]) for _ in range(rng.randint(1, 5))) for _ in range(25)} | {"é", "Act-of"}
    texts = [None, "", "é !"] + [" ".join(rng.choice(["act", "Of", "TAX", "the", "a", "x,", "é", "(the)"]) for _ in range(rng.randint(1, 60))) for _ in range(80)]
    found = names.find_names(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), spark.createDataFrame([(x,) for x in known], "name string"))
    got = {}
    for r in found.orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append((r.pos, r.end, r.name))
    want = {i: x for i, t in enumerate(texts) if (x := plain_names(t or "", known))}
    assert got == want
    none = spark.createDataFrame([], "name string")
    assert names.find_names(spark.createDataFrame([(1, "a")], "doc_id int, text string"), none).collect() == []


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_names_as_all_pairs(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(0, 7)))
    asked, known = {word() for _ in range(60)} | {None, "zzzzzz"}, {word() for _ in range(60)}
    table = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    got = {r.query: (r.name, r.distance) for r in names.nearest_names(table(asked, "query"), table(known, "name")).collect()}
    want = {q: min((d, n) for n in known if (d := distance(q, n)) <= 2)[::-1] for q in asked if q is not None and any(distance(q, n) <= 2 for n in known)}
    assert got == want


def test_references_of_real_shapes(spark):
    asked = ["Part IVA", "s 51(xx)", "reg 3.01", "Sch 2", "Section 18", "ss 5-7", "ss 7-5", "s 355-25", "Pt XIC", "part iva", "s V", "pt IX", "Chapter III", "sch 2 cl 4(1A)(b)", None, ""]
    rows = spark.createDataFrame(list(enumerate(asked)), "i int, v string").withColumn("r", citations.parse_ref(F.col("v"))).withColumn("f", citations.format_ref(F.col("r")))
    got = rows.withColumn("again", citations.format_ref(citations.parse_ref(F.col("f")))).orderBy("i").collect()
    assert [r.f for r in got] == ["pt IVA", "s 51(xx)", "reg 3.01", "sch 2", "s 18", "ss 5-7", "s 7-5", "s 355-25", "pt XIC", None, None, "pt IX", "ch III", "sch 2 cl 4(1A)(b)", None, None]
    assert all(r.f == r.again for r in got)
    assert [(r.r.number, r.r.suffix, r.r.value, r.r.range_end) for r in got if r.r][:6] == [("IV", "A", 4, None), ("51", None, 51, None), ("3.01", None, None, None), ("2", None, 2, None), ("18", None, 18, None), ("5", None, 5, "7")]
    every = [citations._roman(n) for n in range(1, 40)]
    assert [r.n for r in spark.createDataFrame([(x,) for x in every], "v string").select(citations.roman_value(F.col("v")).alias("n")).collect()] == list(range(1, 40))


def test_titles_without_a_register(spark):
    text = "Both the Widget Act and the Gadget Act 1990 (NSW) s 5. The Safety, Rehabilitation and Compensation Act 1988 (Cth) s 14; In the Widget Act 1950 pt II."
    rows = citations.extract_statute_citations(spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")).orderBy("at").collect()
    assert [(r.ref, r.law_name, r.jurisdiction) for r in rows] == [("s 5", "Gadget Act 1990", "NSW"), ("s 14", "Safety, Rehabilitation and Compensation Act 1988", "Cth"), ("pt II", "Widget Act 1950", None)]


def test_a_mention_is_the_longest_name(spark):
    asked = spark.createDataFrame([(1, "the Competition and Consumer Act 2010 and cca or CCA")], "query_id int, query string")
    known = spark.createDataFrame([("CCA", "Competition and Consumer Act 2010", "Cth"), ("CA", "Consumer Act 2010", "Cth")], "alias string, official string, jurisdiction string")
    assert [(r.raw, r.name) for r in questions.law_mentions(asked, known).orderBy("pos").collect()] == [("Competition and Consumer Act 2010", "Competition and Consumer Act 2010"), ("CCA", "Competition and Consumer Act 2010")]


def test_unread_shapes(spark):
    rng = random.Random(4)
    span = lambda: (rng.randrange(3), s := rng.randrange(200), s + rng.randrange(12))
    shapes, read = [(*span(), "x") for _ in range(200)] + [(9, 1, 2, "y")] * 2, [span() for _ in range(25)]
    got = setops.unread_shapes(spark.createDataFrame(shapes, "doc_id int, start int, end int, raw string"), spark.createDataFrame(read, "doc_id int, start int, end int"))
    want = [s for s in shapes if not any(d == s[0] and b < s[2] and s[1] < e for d, b, e in read if b < e)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_unread_shapes_of_a_document_with_a_million_spans(spark):
    at = spark.range(500_000).select(F.lit(1).alias("doc_id"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 4).alias("end"))
    read = at.filter("start % 20 = 0").unionByName(at.filter("start % 20 = 10").select("doc_id", (F.col("start") + 4).alias("start"), (F.col("end") + 4).alias("end")))
    assert setops.unread_shapes(at, read).count() == 250_000


def test_citations_of_odd_shapes(spark):
    text = "See [2020] hca 41 at [5]-[7], (1992) 175 CLR 1, 42; [1977] VR 430 at 12 [5]. (1977) 3 Qd R 6 ('Foo (No 2)'). [2020] said the 5 and (2001) 12 things; [2020] F.C.A. 41st; [2010] NSWCA 3."
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    rows = citations.extract_case_citations(docs).orderBy("pos").collect()
    assert [(r.raw, r.kind, r.pin, r.pin_to, r.page) for r in rows] == [
        ("[2020] hca 41 at [5]-[7]", "neutral", "5", "7", None), ("(1992) 175 CLR 1, 42", "report", None, None, 42), ("[1977] VR 430 at 12 [5]", "report", "5", None, 12),
        ("(1977) 3 Qd R 6", "report", None, None, None), ("[2010] NSWCA 3", "neutral", None, None, None),
    ]
    assert all(text[r.pos : r.pos + len(r.raw)] == r.raw for r in rows)
    assert [tuple(r) for r in citations.case_short_names(docs).collect()] == [(1, "(1977) 3 Qd R 6", "Foo (No 2)")]


def test_clause_heads(spark):
    from lexframe.functions import texts

    lines = ["3. Fee", "3.1 Fee due", "Clause 7 x", "  Schedule 2  y z", "3.", "1234 x", "3a x", "1.2.3. x", "item x", None, "", "3.. x"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, v string").orderBy("i").select(texts.clause_head(F.col("v")).alias("h")).collect()
    assert [r.h and (r.h.label, r.h.rest) for r in got] == [("3", "Fee"), ("3.1", "Fee due"), ("7", "x"), ("2", "y z"), None, None, None, ("1.2.3", "x"), None, None, None, None]


def test_claims(spark):
    cases = [
        ("s 5", " deals with unfair contract terms. More", "unfair contract terms", "verb"), ("s 5", " (Cth) prohibits misleading conduct", None, None), ("s 5", ", which requires a written notice", "a written notice", "verb"),
        ("s 5", " provides that every person has rights", "every person has rights", "proposition"), ("s 5", ": the duty of care", "the duty of care", None), ("s 5", " (as amended by No 3)", None, None), ("s 5", "", None, None),
    ]
    docs = spark.createDataFrame([(i, c, c + x) for i, (c, x, _, _) in enumerate(cases)], "doc_id int, raw string, text string")
    got = {r.doc_id: (r.claim, r.claim_source) for r in citations.extract_claim(docs.select("doc_id", "raw"), docs).collect()}
    assert [got[0], got[2], got[3], got[6]] == [cases[i][2:] for i in (0, 2, 3, 6)] and got[5] == (None, None)


def test_networks_as_breadth_first(spark):
    from lexframe.operators import joins

    rng = random.Random(6)
    edges = [(f"n{rng.randrange(20)}", f"n{rng.randrange(20)}", rng.choice("ab")) for _ in range(40)]
    found = joins.law_network(spark.createDataFrame([("n1",), ("n2",), ("n1",), (None,)], "id string"), spark.createDataFrame(edges, "src string, dst string, kind string"), 3)
    want = set()
    for root in ("n1", "n2"):
        level, seen = {root: None}, set()
        for hops in range(4):
            want |= {(root, x, hops, via) for x, via in level.items()}
            seen |= set(level)
            nxt = {}
            for a, b, k in edges:
                if a in level and b not in seen:
                    nxt[b] = min(k, nxt.get(b, k))
            level = nxt
    assert {tuple(r) for r in found.collect()} == want

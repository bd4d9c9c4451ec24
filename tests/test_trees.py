"""Contents of any depth, containers with their entries beside them, names within names, runs in common: against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from lexframe.functions import courts, texts
from lexframe.operators import joins, rank, windows
from lexframe.operators.containing import containing


def deep_tree(seed, n=300, deepest=12):
    rng, depth, out = random.Random(seed), 1, []
    for i in range(n):
        out.append((f"T{seed % 2}", i, depth, f"entry {i}"))
        depth = rng.randint(1, min(depth + 1, deepest)) if rng.random() < 0.4 else min(depth + 1, deepest)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_trees_of_twelve_levels(spark, seed):
    rows = deep_tree(seed)
    toc = spark.createDataFrame(rows, "title_id string, ord long, depth int, label string")
    ends = {r.ord: r.end_ord for r in windows.toc_subtree_range(toc).collect()}
    above = {r.ord: (r.parent_ord, list(r.breadcrumb)) for r in windows.toc_ancestors(toc).collect()}
    assert max(r[2] for r in rows) == 12
    stack = []
    for at, (_, i, depth, label) in enumerate(rows):
        assert ends[i] == next((j for _, j, d, _ in rows[at + 1 :] if d <= depth), len(rows))
        stack = [x for x in stack if x[0] < depth]
        assert above[i] == (stack[-1][1] if stack else None, [x[2] for x in stack] + [label])
        stack.append((depth, i, label))
    assert windows.toc_subtree_range(toc.limit(0)).count() == 0 and windows.toc_ancestors(toc.limit(0)).count() == 0


def test_containers_own_what_stands_beside_them(spark):
    labels = ["Part 1—A", "Subdivision 20-A—B", "Guide to Subdivision 20-A", "5 Rule", "Subdivision 20-B", "Division 3", "7 Rule", "Endnotes", "Note 1"]
    depths = [1, 2, 2, 3, 2, 2, 2, 2, 3]
    toc = spark.createDataFrame([("T", i, d, x) for i, (d, x) in enumerate(zip(depths, labels))], "title_id string, ord long, depth int, label string")
    ends = {r.ord: r.end_ord for r in windows.toc_subtree_range(toc).collect()}
    # The subdivision goes to the next subdivision, that one to the division, the division to the endnotes.
    assert [ends[i] for i in (0, 1, 2, 4, 5, 6, 7)] == [9, 4, 4, 5, 7, 7, 9]


def test_owning_schedule(spark):
    toc = spark.createDataFrame([("T", 0, 1, "Part 1"), ("T", 1, 1, "Schedule 2—X"), ("T", 2, 2, "Part 3"), ("T", 3, 3, "9 Rule"), ("T", 4, 1, "Part 5")], "title_id string, ord long, depth int, label string")
    assert {r.ord: r.schedule_ord for r in windows.toc_ancestors(toc).collect()} == {0: None, 1: 1, 2: 1, 3: 1, 4: None}


def test_containing_against_all_pairs(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choices("ab ", k=n))
    needles, hays = [(i, word(rng.randint(0, 6))) for i in range(60)], [(i, word(rng.randint(0, 30))) for i in range(80)]
    got = {tuple(r) for r in containing(spark.createDataFrame(needles, "needle int, s string"), spark.createDataFrame(hays, "hay int, s string")).collect()}
    assert got == {(n, h) for n, a in needles for h, b in hays if a and a in b}


def test_former_names_of_titles(spark):
    titles = spark.createDataFrame([("C1", "Consumer Act 2010", True, "Act", "InForce", [("Trade Act 1974",)]), ("C2", "Trade Act 1974 Amendment", False, "Act", "Repealed", None)], "id string, name string, is_principal boolean, collection string, status string, name_history array<struct<name:string>>")
    asked = spark.createDataFrame([(1, "Trade Act 1974")], "query_id int, query string")
    assert [(r["rank"], r.id, r.points) for r in rank.rank_titles(asked, titles).orderBy("rank").collect()] == [(1, "C1", 105), (2, "C2", 70)]


def test_longest_run_in_common(spark):
    rng = random.Random(4)
    pairs = []
    for i in range(60):
        shared = "".join(rng.choices("abcd efg", k=rng.randint(28, 60))).strip()
        pairs.append((i, "x" + "".join(rng.choices("mnop", k=10)) + shared + "q", "z" + shared + "".join(rng.choices("rstu", k=rng.randint(5, 90)))))
    for r in texts.content_match(spark.createDataFrame(pairs, "i int, claim string, actual string")).collect():
        c, a = (" ".join(x.split()) for x in (r.claim, r.actual))
        longest = max(j - k for k in range(len(c)) for j in range(k, len(c) + 1) if c[k:j] in a)
        assert (r.method == "exact") == (longest >= 30) and (r.method != "exact" or r.score == pytest.approx(longest / len(c)))


def test_series_and_brackets(spark):
    rows = spark.createDataFrame([("C.L.R.", "round"), ("Qd R", "round"), ("VR", "square"), ("WAR", "square"), ("ZZZ", "round")], "t string, b string")
    t, b = F.col("t"), F.col("b")
    assert [tuple(r) for r in rows.select(courts.is_series(t), courts.wrong_bracket(t, b), courts.is_court(t)).collect()] == [(True, False, False), (True, True, False), (True, False, False), (True, False, False), (False, False, False)]


def test_score_of_one_shared_word(spark):
    names = spark.createDataFrame([(1, "Evidence Act amendments"), (2, "law of evidence"), (3, "The law of evidence 2"), (4, "of it")], "name_id int, name string")
    families = spark.createDataFrame([("ev", "law of evidence"), ("it", "it")], "family string, fragment string")
    members = spark.createDataFrame([("ev", "m"), ("it", "n")], "family string, member string")
    assert {(r.name_id, r.family, r.score) for r in joins.state_counterparts(names, families, members).collect()} == {(1, "ev", 1), (2, "ev", 3), (3, "ev", 2)}

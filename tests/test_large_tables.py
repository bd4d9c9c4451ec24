"""What only larger tables hold: long numbers and internet addresses."""

from pyspark.sql import functions as F

from lexframe.functions import citations, texts
from lexframe.operators import joins
from lexframe.plans.fixtures import table
from lexframe.plans.flows import applicable_law, natural_search, research


def test_numbers_of_six_to_nine_digits(spark):
    rows = [(1, "See [2001] NSWCA 100001 at [3]; (1992) 175 CLR 1000003, 1000005 and [2020] HCA 999999999.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.raw, r.number, r.page) for r in citations.extract_case_citations(docs).collect()}
    assert got == {("[2001] NSWCA 100001 at [3]", 100001, None), ("(1992) 175 CLR 1000003, 1000005", 1000003, 1000005), ("[2020] HCA 999999999", 999999999, None)}


def test_addresses_and_long_numbers_are_no_references(spark):
    text = "Log ch 70.123.182.155 and ch 70.12.18.15, s 10.0.0.1; cl 1.2.3.4, cl 10.123.0.1, reg 3.01, cl 1.2.3; ch 4990203269970632, ss 4 and 12345."
    got = [r.ref for r in citations.extract_refs(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("pos").collect()]
    assert got == ["cl 1.2.3.4", "reg 3.01", "cl 1.2.3", "s 4"]


def test_addresses_are_no_clauses(spark):
    rows = [(1, "1. Head\n28.68.191.238 goes on\n10.20.30.40 too\n1.2.3.4 Deep\n2.1.1.1 Next\n3. Tail"), (2, "1.2.3.4 Deep\n1.2.3.5 More")]
    got = {(r.doc_id, r.n, r.label, r.body) for r in texts.split_clauses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {
        (1, 1, "1", "Head 28.68.191.238 goes on 10.20.30.40 too"), (1, 2, "1.2.3.4", "Deep"), (1, 3, "2.1.1.1", "Next"), (1, 4, "3", "Tail"), (2, 1, "1.2.3.4", "Deep"), (2, 2, "1.2.3.5", "More"),
    }


def test_headings_for_many_claims_in_one_partition(spark):
    """As expressions over arrays this took minutes, in a single task."""
    c = F.col("id")
    label = F.concat(c, F.lit(" The rule of "), F.md5(c.cast("string")))
    ids = spark.range(6000, numPartitions=1)
    claims = ids.select(c.alias("claim_id"), F.floor(c / 10).alias("title_id"), F.concat(F.lit("rule of "), F.md5(c.cast("string"))).alias("claim"))
    found = texts.best_heading(claims, ids.select(F.floor(c / 10).alias("title_id"), c.alias("ord"), label.alias("label")))
    assert "ArrowEvalPython" in found._jdf.queryExecution().toString()
    assert found.filter("ord = claim_id and score = 1.0").count() == 6000


def test_aliases_of_a_name_of_many_titles(spark):
    """400 titles by 400 aliases of one name aren't paired: 160,000 rows before."""
    many = spark.range(400)
    titles = many.selectExpr("concat('C', id) AS id", "'Widget Act 1975' AS name").unionByName(spark.createDataFrame([("C1", "Widget Act 1975"), ("X", "Other Act")], "id string, name string"))
    aliases = many.selectExpr("concat('T', id % 3) AS alias", "'Widget Act 1975' AS official")
    got = joins.aliases_for(titles, aliases)
    assert {(r.id, tuple(r.aliases)) for r in got.collect()} == {(f"C{i}", ("T0", "T1", "T2")) for i in range(400)} and got.count() == 400
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")  # nothing is summed up above the join


def test_questions_of_one_kind_get_the_same_titles(spark):
    """Each asker of a repeated question has all its rows; found once for the kind."""
    titles = spark.createDataFrame([(f"C{i}", f"Widget Act {1950 + i % 3}", True, "Act", "InForce") for i in range(9)], "id string, name string, is_principal boolean, collection string, status string")
    aliases = spark.createDataFrame([("WID", "Widget Act 1951", "Cth")], "alias string, official string, jurisdiction string")
    asked = spark.createDataFrame([(1, "widget 1950"), (2, "Widget 1950"), (3, "what does WID say about tents"), (4, "1950 widget"), (5, "none")], "query_id long, query string")
    rows = natural_search(asked, aliases, titles, 2).collect()
    assert {(r.query_id, r.rank, r.id, r.via) for r in rows} == {(q, n, i, v) for q, ids, v in ((1, ("C0", "C3"), "query"), (2, ("C0", "C3"), "query"), (4, ("C0", "C3"), "query"), (3, ("C1", "C4"), "alias")) for n, i in enumerate(ids, 1)}


def test_questions_share_a_list_of_hits(spark):
    """A list is cut before it meets its questions: 40 questions by 30 hits were 1,200 rows to rank before."""
    table = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    asked = table([(q, "prepare for a hearing on GST" if q % 2 else "prepare for a hearing", "dispute_prep") for q in range(40)], "query_id long, query string, task string")
    rest = (
        table([("C1", "Widget Act 1951", True, "Act", "InForce")], "id string, name string, is_principal boolean, collection string, status string"), table([(q, "C1") for q in range(40)], "query_id long, id string"),
        table([], "affecting string, affected string, provisions string"), table([], "title_id string, since date, until date, register_id long, affect string"), table([], "title_id string, ord int, depth int, label string"),
    )
    related = table([], "family string, fragment string"), table([], "family string, member string")
    shared = table([(n, d, r, 100 * n + r) for n in (0, 1) for d in ("tax", "other") for r in range(1, 31)], "list_id long, domain string, rank int, id long")
    lists = asked.selectExpr("query_id", "query_id % 2 AS list_id")
    own = shared.join(lists, "list_id").select("query_id", "domain", "rank", "id")
    got, want = (sorted(map(tuple, research(asked, *rest, hits, *related, **more).collect()), key=repr) for hits, more in ((shared, {"lists": lists}), (own, {})))
    assert got == want and {(r[0], r[6]) for r in got} == {(q, str(100 + i)) for q in range(1, 40, 2) for i in range(1, 6)}


def test_a_small_file_of_many_rows_is_no_small_table(spark, tmp_path):
    """By the size of its file a million rows were sent to every task, by way of the driver."""
    spark.range(1_000_000, numPartitions=1).selectExpr("id AS p_partkey", "'Widget Law' AS p_name").write.parquet(f"{tmp_path}/part.parquet")
    assert sum(x.stat().st_size for x in (tmp_path / "part.parquet").glob("*.parquet")) < 10 << 20
    part = table(spark, str(tmp_path), "part")
    joined = spark.range(100_000_000).join(part.selectExpr("p_partkey AS id", "concat('C', p_partkey) AS title_id", "p_name"), "id")
    assert "Broadcast" not in joined._jdf.queryExecution().sparkPlan().toString()


def test_events_are_not_joined_with_themselves(spark):
    """Steps of P3 were joined on event, title and day, all events shuffled twice for each; now each adds its columns."""
    day = "cast(d AS date) AS d"
    events = spark.createDataFrame([(1, 7, "1995-06-01"), (1, 7, "1995-06-01"), (2, 7, "1990-01-01"), (3, 7, None), (4, None, "1995-06-01"), (5, 8, "2001-01-01")], "event_id long, title_id long, d string").selectExpr("event_id", "title_id", day)
    versions = spark.createDataFrame([(7, "1993-01-01", "1997-01-01", 70, "AsMade"), (7, "1997-01-01", None, 71, "Repeal")], "title_id long, since string, until string, register_id long, affect string")
    versions = versions.selectExpr("title_id", "cast(since AS date) AS since", "cast(until AS date) AS until", "register_id", "affect")
    amendments = spark.createDataFrame([(7, "s 1", "am", 1995, 1), (7, "s 2", "am", 1995, 1), (7, "s 1", "rep", 1996, 2), (7, "s 1", "ad", 1990, 3), (8, "s 1", "ad", 2000, 3)], "title_id long, provision string, effect string, act_year int, act_number int")
    got = applicable_law(events, versions, now="1998-01-01", amendments=amendments)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 3  # repeals, lags, amendments
    rows = {(r.event_id, r.title_id, r.register_id, r.status, r.repeal_status, r.n_later, r.lags, r.n_amended_after) for r in got.collect()}
    assert got.count() == 5 and rows == {
        (1, 7, 70, "found", "in_force_then_repealed", 1, False, 3), (2, 7, None, "before_first", "in_force_then_repealed", 2, False, 4), (3, 7, None, "before_first", "in_force_then_repealed", 0, False, 0),
        (4, None, None, "absent", "not_repealed", 0, None, 0), (5, 8, None, "absent", "not_repealed", 0, None, 0),
    }

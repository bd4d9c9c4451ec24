"""Documents of odd shapes and numbers, against the SQL; and jobs that are done in whole."""

import pytest
from pyspark.sql import functions as F

from compare import of_duckdb, of_spark
from lexframe.functions import patterns, texts
from lexframe.plans import registry
from lexframe.plans.fixtures import TABLES
from lexframe.streaming import changes

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def _tables(spark, sf_dir, tmp_path, docs):
    """The test tables with other documents (doc_id, text)."""
    from pathlib import Path

    for t in TABLES:
        if t != "documents":
            (tmp_path / f"{t}.parquet").symlink_to(Path(sf_dir) / f"{t}.parquet")
    rows = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'src0' AS source", "cast(length(text) AS bigint) AS n_chars")
    rows.toPandas().to_parquet(tmp_path / "documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["p1_verify_citations", "p1_citation_summary"])
def test_invented_numbers_of_many_documents(spark, sf_dir, tmp_path, name):
    """over 90,000 documents the numbers that are to be absent were those of other judgments."""
    there = _tables(spark, sf_dir, tmp_path, [(i, f"words {i}") for i in (0, 1, 2, 3, 4, 10, 90000, 90005)])
    assert of_spark(QUERIES[name](spark, there)) == of_duckdb(SQL[name], there)


@pytest.mark.parametrize("name", ["x17_split_clauses", "x16_risk_scan", "p6_document_review", "s6_parse_decision", "x18_clause_conflicts"])
def test_blank_documents(spark, sf_dir, tmp_path, name):
    """A clause or a body without text of its own on its line was none."""
    there = _tables(spark, sf_dir, tmp_path, [(0, ""), (1, " "), (2, "\n"), (3, "\nwords"), (4, "  \n \n"), (5, "<"), (6, "plain words")])
    assert of_spark(QUERIES[name](spark, there)) == of_duckdb(SQL[name], there)


def test_a_number_with_a_dot_begins_a_clause(spark):
    rows = [(1, "1. \nOne\n2.\nno clause\nClause 3. \nThree"), (2, "12 \n1. One")]
    got = {(r.doc_id, r.n, r.label, r.body) for r in texts.split_clauses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1, "1", "One 2. no clause"), (1, 2, "3", "Three"), (2, 1, "1", "One")}


def test_few_patterns_are_tried_as_they_are(spark):
    """texts were taken apart into words for six patterns."""
    rows = [(1, "A FEE is payable"), (2, "feeé fee_ unpayable"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "id int, t string").select("id", patterns.pattern_hits(F.col("t"), [r"(?i)\bfee\b", "payable", "zz"]).alias("h"))
    assert {r.id: r.h for r in df.collect()} == {1: [0, 1], 2: [1], 3: [], 4: []}
    assert "crc32" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_of_any_length_are_compared(spark):
    """over 1,200 lines there was a status and no counts."""
    left = [f"line {i}" for i in range(3000)]
    right = [x for i, x in enumerate(left) if i % 3] + ["new"] * 5
    pairs = spark.createDataFrame([(1, "\n".join(left), "\n".join(right)), (2, "a  b\n" * 2000, "a b\n" * 2000), (3, None, "x")], "pair_id int, a string, b string")
    got = {(r.pair_id, r.added, r.removed, r.unchanged, r.status) for r in texts.diff_stats(pairs).collect()}
    assert got == {(1, 5, 1000, 2000, "compared"), (2, 0, 0, 2001, "same"), (3, 1, 1, 0, "compared")}
    ops = texts.diff_ops(pairs.filter("pair_id = 1")).orderBy("n").collect()
    assert [r.line for r in ops if r.op != "add"] == left and [r.line for r in ops if r.op != "remove"] == right


def test_rows_of_an_alignment_are_not_all_held():
    """memory went with the product of the lines."""
    import tracemalloc

    left, right = [f"a{i}" for i in range(6000)], [f"a{i * 7 % 6000}" for i in range(6000)]
    tracemalloc.start()
    same, ops = texts.common_lines(left, right), texts.line_ops(left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(o == "keep" for o, _ in ops) == same and [x for o, x in ops if o != "add"] == left and [x for o, x in ops if o != "remove"] == right
    assert peak < 4 << 20  # 6,000 rows of 6,000 bits are 4.5 MB by themselves


def test_cases_and_statutes_of_arriving_documents(spark, tmp_path):
    """only cases were read."""
    text = "In [2020] HCA 4, [2020] HCA 4 at [3], the Widget Act 1975 (Cth) s 9. The Widget Act 1975 (Cth) ('WGA') is old, and the Act ss 1-2 too; WGA s 3; ABC s 4.\n\nThe Act s 8."
    docs = spark.createDataFrame([(1, text), (2, None), (3, "none")], "doc_id long, text string")
    aliases = spark.createDataFrame([("ABC", "Other Act 1999", "Cth")], "alias string, official string, jurisdiction string")
    docs.coalesce(1).write.parquet(str(tmp_path / "docs"))
    q = changes.stream_citations(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs")), aliases).writeStream.format("memory").queryName("all_cites").start()
    q.processAllAvailable()
    q.stop()
    rows = {(1, "case", "[2020] HCA 4", None), *((1, "statute", f"s {n}", "Widget Act 1975") for n in (9, 1, 2, 3)), (1, "statute", "s 4", "Other Act 1999"), (1, "statute", "s 8", None)}
    got = spark.table("all_cites")
    assert set(map(tuple, got.collect())) == rows and got.count() == 7 and of_spark(got) == of_spark(changes.stream_citations(docs, aliases))

"""Chosen inputs with known results: grammars, folds, dates, trees, files."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from lexframe.functions import citations, folds, texts
from lexframe.operators import joins, windows
from lexframe.sources import landed


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v")).alias("x")).collect()]


def test_folds(spark):
    assert column(spark, ["FW Act", "ＦＷ act", "EP&A", None, ""], folds.fold_key) == ["fwact", "fwact", "epa", None, ""]


def test_content_match(spark):
    pairs = [("misleading or deceptive conduct", "Meetings of Commission"), ("misleading conduct", "Misleading or deceptive conduct"), ("meetings", "Meetings of Commission"), (None, "x"), ("a run of thirty characters and more of it", "so: a run of thirty characters and more, yes")]
    got = [(r.method, r.score) for r in texts.content_match(spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, claim string, actual string").orderBy("i")).collect()]
    assert [m for m, _ in got] == ["mismatch", "jaccard", "exact", "mismatch", "exact"]
    assert got[0][1] < 0.25 < got[1][1] and got[2][1] == pytest.approx(8 / 22) and got[3][1] == 0 and 0.75 < got[4][1] < 1


def test_heading_title(spark):
    assert column(spark, ["Schedule 2—The Australian Consumer Law", "18 Misleading conduct", "Part 3—Courts"], texts.heading_title) == ["Australian Consumer Law", "Misleading conduct", "Courts"]


def test_references_come_back_the_same(spark):
    grid = [f"{s}{u} {n}{x}{b}" for s in ("", "sch 2 ") for u in ("s", "reg", "cl", "pt") for n in ("1", "355-25", "99") for x in ("", "A", "ZZ") for b in ("", "(1)", "(1)(a)(ii)")]
    assert column(spark, grid, lambda c: citations.format_ref(citations.parse_ref(c))) == grid
    assert column(spark, ["see 5", None, "s", "s 5 of it"], lambda c: citations.format_ref(citations.parse_ref(c))) == [None] * 4


def test_dates(spark):
    asked = ["3 March 1995", "June 2015", "31 February 2015 or 2015-03-04", "two", "5/6/2001", "3 years ago", "last year", None]
    day = datetime.date
    assert column(spark, asked, lambda c: texts.parse_date(c, "2020-06-30")) == [day(1995, 3, 3), day(2015, 6, 30), day(2015, 3, 4), None, day(2001, 6, 5), day(2017, 6, 30), day(2019, 12, 31), None]


def test_trailing_citation(spark):
    rows = spark.createDataFrame([("A v B [2010] QSC 1",), ("A v B",)], "t string")
    title, cite = citations.split_trailing_citation(F.col("t"))
    assert [tuple(r) for r in rows.select(title, cite).collect()] == [("A v B", "[2010] QSC 1"), ("A v B", None)]


def test_anaphora_stops_at_a_paragraph(spark):
    docs = spark.createDataFrame([(1, "Under the Widget Act 1950 (Cth) s 3 this. The Act s 4 that.\n\nThe Act s 5 too.")], "doc_id int, text string")
    got = {r.ref: (r.law_name, r.attached_by) for r in citations.extract_statute_citations(docs).collect()}
    assert got == {"s 3": ("Widget Act 1950", "trailing-cite"), "s 4": ("Widget Act 1950", "anaphora"), "s 5": (None, "anaphora")}


def test_longest_common_lines():
    assert texts.common_lines(list("abcbdab"), list("bdcaba")) == 4 and texts.common_lines([], ["x"]) == 0


def test_version_as_at_edges(spark):
    versions = spark.createDataFrame([(1, "2015-01-01", "2015-07-01", 10, "AsMade"), (1, "2015-07-01", None, 11, "Amend"), (2, "2000-01-01", "2001-01-01", 12, "AsMade")], "title_id long, since string, until string, register_id long, affect string")
    versions = versions.withColumns({c: F.to_date(c) for c in ("since", "until")})
    events = spark.createDataFrame([(1, "2014-12-31"), (1, "2015-06-30"), (1, "2015-07-01"), (2, "2005-01-01"), (3, "2005-01-01"), (1, None)], "title_id long, d string").withColumn("d", F.to_date("d"))
    for f in (joins.version_as_at, joins.version_as_at_by_range):
        got = {(r.title_id, str(r.d)): (r.register_id, r.status) for r in f(events.filter("d is not null"), versions).collect()}
        assert got == {(1, "2014-12-31"): (None, "before_first"), (1, "2015-06-30"): (10, "found"), (1, "2015-07-01"): (11, "found"), (2, "2005-01-01"): (None, "lapsed") if f is joins.version_as_at_by_range else (12, "lapsed"), (3, "2005-01-01"): (None, "absent")}
    assert joins.version_as_at(events.limit(0), versions).count() == 0


def test_slice_provision(spark):
    volumes = spark.createDataFrame([("T", '<p id="x">zero</p><h2 id="a1">One</h2><p>body one</p><p id="y">more</p><h2 id="a2">Two</h2>')], "title_id string, html string")
    toc = spark.createDataFrame([("T", "a1"), ("T", "a2")], "title_id string, anchor string")
    assert {r.anchor: r.text for r in windows.slice_provision(volumes, toc).collect()} == {"a1": "One body one more", "a2": "Two"}


def test_files(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"value": [{"titleId": "C1", "start": "2015-01-01T00:00:00", "affect": 1, "registerId": "R1"}, {"TitleId": "C1", "Start": "2016-01-01", "End": None, "Affect": "Repeal"}]}))
    got = sorted(landed.read_register(spark, str(tmp_path / "v.json")).collect(), key=str)
    assert [(r.title_id, str(r.since), r.affect) for r in got] == [("C1", "2015-01-01", "Amend"), ("C1", "2016-01-01", "Repeal")]
    (tmp_path / "t.ncx").write_text('<ncx><navPoint id="1"><navLabel><text>Part 1</text></navLabel><content src="d#a"/><navPoint><text>s  1</text><content src="d#b"/></navPoint></navPoint><navPoint><text>Part 2</text></navPoint></ncx>')
    assert [(r.ord, r.depth, r.label, r.src) for r in landed.read_toc(spark, str(tmp_path / "t.ncx")).orderBy("ord").collect()] == [(1, 1, "Part 1", "d#a"), (2, 2, "s 1", "d#b"), (3, 1, "Part 2", None)]
    (tmp_path / "p.json").write_text(json.dumps({"data": [{"id": {"__type__": "s", "__value__": "a"}, "title": "T", "print.type": {"__value__": "act"}}, {"title": "no id"}]}))
    assert [tuple(r) for r in landed.read_projectdata(spark, str(tmp_path / "p.json")).collect()] == [("a", "T", "act", None)]
    (tmp_path / "tr.json").write_text(json.dumps({"results": [{"Title": "X", "AtsNumber": "None", "DoneAtDate": "1990-02-03T00:00", "Countries": ["A"]}]}))
    assert [tuple(r) for r in landed.read_treaties(spark, str(tmp_path / "tr.json")).collect()] == [("X", None, datetime.date(1990, 2, 3), ["A"])]
    landed.write_tables({"x": spark.range(3).withColumn("year", F.col("id") % 2)}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "x")).filter("year = 0").count() == 2

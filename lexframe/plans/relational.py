"""Registered queries over register, table-of-contents and hit tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexframe.functions.folds import stem_tokens
from lexframe.operators import aggs, filters, joins, rank, setops, windows
from lexframe.plans.fixtures import table, view, with_views
from lexframe.sources import landed
from lexframe.sources.scratch import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    """Register a query, and its SQL over the named views."""

    def keep(f: Callable[[Callable[[str], DataFrame], Callable[[str], DataFrame]], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(lambda v: view(spark, sf_dir, v), lambda t: table(spark, sf_dir, t))
        if sql is not None:
            SQL[name] = with_views(sql, *views) if views else sql
        return f

    return keep


# Filters


@query("f1_title_search", "SELECT id, name FROM titles WHERE lower(name) LIKE '%act 197%'", "titles")
def _(v, t):
    return filters.title_search(v("titles"), "Act 197").select("id", "name")


@query("f1_title_words", "SELECT id, name FROM titles WHERE lower(name) LIKE '%act%' AND lower(name) LIKE '%1985%'", "titles")
def _(v, t):
    return filters.title_search(v("titles"), "1985 act", match="all").select("id", "name")


@query("f2_facet_filter", "SELECT id, year FROM titles WHERE collection IN ('Act', 'Gazette') AND status IN ('InForce') AND year BETWEEN 1960 AND 1990", "titles")
def _(v, t):
    return filters.facet_filter(v("titles"), collections=("Act", "Gazette"), statuses=("InForce",), year_from=1960, year_to=1990).select("id", "year")


@query("f2_facet_any", "SELECT id, year FROM titles WHERE collection = 'Act' OR year = 1975", "titles")
def _(v, t):
    return filters.facet_filter(v("titles"), collections=("Act",), year=1975, combine="or").select("id", "year")


@query("f3_hit_filter", "SELECT id, title FROM hits WHERE lower(concat_ws(' ', title, source)) LIKE '%the%' AND lower(concat_ws(' ', title, source)) LIKE '%src1%'", "hits")
def _(v, t):
    return filters.hit_filter(v("hits"), "the src1 a", fields=("title", "source")).select("id", "title")


@query(
    "f4_prefix_suggest",
    """WITH k AS (SELECT name, is_principal FROM titles WHERE regexp_replace(lower(name), '[^a-z0-9]', '', 'g') LIKE 'part#1%' ESCAPE '!'
  OR name IN (SELECT official FROM aliases WHERE regexp_replace(lower(alias), '[^a-z0-9]', '', 'g') LIKE 't1%'))
SELECT name, bool_or(is_principal) AS is_principal FROM k GROUP BY name ORDER BY is_principal DESC, name LIMIT 25""",
    "titles",
    "aliases",
)
def _(v, t):
    return filters.prefix_suggest(v("titles"), v("aliases"), "T1", 25)


@query("f5_version_window", "SELECT title_id, register_id, since FROM versions WHERE coalesce(until, DATE '9999-12-31') >= DATE '1995-01-01' AND since <= DATE '1995-12-31'", "versions")
def _(v, t):
    return filters.version_window_filter(v("versions"), "1995-01-01", "1995-12-31").select("title_id", "register_id", "since")


@query(
    "f6_looks_like",
    r"""SELECT query_id, regexp_matches(query, '(?i)\b(tenancy|tenancies|conveyancing|strata|local government|planning|traffic)\b') AS state_subject,
  regexp_matches(query, '(?i)\b(regulations?|rules?|determination|instrument|order|notice)\b') AS instrument_words, regexp_matches(query, '(?i)\b[cf]\d{4}[a-z]\d{5}\b') AS register_id,
  regexp_matches(query, '\[(1[89]|20)[0-9]{2}\] ?[A-Za-z][A-Za-z0-9.]{1,15} [0-9]{1,5}') AS citation_shaped, false AS product_code, regexp_matches(query, '(?i)\b(full (text|reasons|judge?ment|decision)|verbatim|unabridged|entire (text|judgment)|complete text)\b') AS full_text, regexp_matches(query, '^\s*[A-Za-z][A-Za-z-]*(\s+[A-Za-z][A-Za-z-]*){0,2}\s*$') AS bare_term FROM queries""",
    "queries",
)
def _(v, t):
    return filters.looks_like(v("queries")).drop("conv_id", "query")


# Joins


@query(
    "j1_resolve_alias",
    """, n AS (SELECT title_id AS name_id, 'T' || (title_id % 60) || CASE title_id % 3 WHEN 0 THEN ' (NSW)' ELSE '' END AS name FROM versions GROUP BY title_id),
k AS (SELECT name_id, lower(regexp_replace(name, '\\s*\\((Cth|NSW|Vic|Qld|SA|WA|Tas|ACT|NT)\\)\\s*$', '')) AS key, nullif(regexp_extract(name, '\\((Cth|NSW|Vic|Qld|SA|WA|Tas|ACT|NT)\\)\\s*$', 1), '') AS stated FROM n),
a AS (SELECT k.name_id, k.stated, a.* FROM k LEFT JOIN aliases a ON lower(a.alias) = k.key),
b AS (SELECT *, coalesce(max(CASE WHEN jurisdiction = stated THEN 1 ELSE 0 END) OVER (PARTITION BY name_id), 0) AS narrows FROM a),
c AS (SELECT * FROM b WHERE narrows = 0 OR jurisdiction = stated)
SELECT c.name_id, alias, official, jurisdiction, CASE WHEN official IS NULL THEN NULL ELSE 'alias' END AS matched_by, n > 1 AS needs_jurisdiction,
  CASE WHEN official IS NULL THEN 'absent' ELSE 'found' END AS status FROM c JOIN (SELECT name_id, count(DISTINCT jurisdiction) AS n FROM c GROUP BY name_id) USING (name_id)""".replace(", n AS", "WITH n AS", 1).replace("\\\\", "\\"),
    "versions",
    "aliases",
)
def _(v, t):
    names = v("versions").groupBy("title_id").agg(F.count("*")).select(F.col("title_id").alias("name_id"), F.concat(F.lit("T"), F.col("title_id") % 60, F.when(F.col("title_id") % 3 == 0, " (NSW)").otherwise("")).alias("name"))
    return joins.resolve_alias(names, v("aliases"))


@query("j2_aliases_for", "SELECT id, name, list_sort(list(DISTINCT alias)) AS aliases FROM titles JOIN aliases ON name = official GROUP BY id, name", "titles", "aliases")
def _(v, t):
    return joins.aliases_for(v("titles"), v("aliases"))


_AS_AT = """SELECT e.event_id, e.title_id, e.d, x.register_id, x.since, x.affect,
  CASE WHEN x.register_id IS NOT NULL THEN 'found' WHEN EXISTS (SELECT 1 FROM versions w WHERE w.title_id = e.title_id) THEN 'before_first' ELSE 'absent' END AS status
FROM law_events e ASOF LEFT JOIN versions x ON e.title_id = x.title_id AND e.d >= x.since"""


@query("j3_version_as_at", _AS_AT, "versions", "law_events")
def _(v, t):
    return joins.version_as_at(v("law_events"), v("versions"))


@query("j3_version_as_at_by_range", _AS_AT, "versions", "law_events")
def _(v, t):
    return joins.version_as_at_by_range(v("law_events"), v("versions"))


@query(
    "j4_rename_history",
    """, h AS (SELECT title_id AS id, 'Law ' || affect AS name, since FROM versions), d AS (SELECT DISTINCT * FROM h)
SELECT id, name, since, lead(since) OVER (PARTITION BY id ORDER BY since, name) AS until FROM d""".replace(", h AS", "WITH h AS", 1),
    "versions",
)
def _(v, t):
    named = v("versions").groupBy(F.col("title_id").alias("id")).agg(F.lit("x").alias("name"), F.collect_list(F.struct(F.concat(F.lit("Law "), "affect").alias("name"), F.col("since").alias("start"))).alias("name_history"))
    return joins.rename_history(named)


@query(
    "j5_repeal_status",
    """SELECT e.title_id, event_id, d, repealed_on, CASE WHEN repealed_on IS NULL THEN 'not_repealed' WHEN repealed_on <= d THEN 'repealed_before' ELSE 'in_force_then_repealed' END AS repeal_status
FROM law_events e LEFT JOIN (SELECT title_id, min(since) AS repealed_on FROM versions WHERE affect = 'Repeal' GROUP BY title_id) r USING (title_id)""",
    "versions",
    "law_events",
)
def _(v, t):
    return joins.repeal_status_at(v("law_events"), v("versions"))


def _scheduled(toc: DataFrame) -> DataFrame:
    return toc.withColumn("schedule", F.when(F.col("number") % 10 == 0, F.lit("1")))


def _refs(customers: DataFrame) -> DataFrame:
    c = F.col("c_custkey")
    block = F.floor(c / 100)
    return customers.select(c.alias("ref_id"), F.concat(F.lit("T"), block).alias("title_id"), (block * 100 + c * 7 % 130).alias("number"), F.when(c % 5 == 0, "1").alias("schedule"))


_REFS = "r AS (SELECT c_custkey AS ref_id, 'T' || CAST(floor(c_custkey / 100.0) AS BIGINT) AS title_id, CAST(floor(c_custkey / 100.0) AS BIGINT) * 100 + c_custkey * 7 % 130 AS number, CASE WHEN c_custkey % 5 = 0 THEN '1' END AS schedule FROM customer)"


@query(
    "j6_locate_provision",
    f"""WITH {_REFS}, e AS (SELECT *, CASE WHEN number % 10 = 0 THEN '1' END AS in_schedule FROM toc),
m AS (SELECT r.ref_id, e.ord, e.label, row_number() OVER (PARTITION BY r.ref_id ORDER BY e.in_schedule IS NOT NULL, e.depth <= 1, e.ord) AS rn, count(*) OVER (PARTITION BY r.ref_id) - 1 AS alternatives
  FROM r JOIN e ON r.title_id = e.title_id AND r.number = e.number AND (r.schedule IS NULL OR r.schedule = e.in_schedule))
SELECT r.ref_id, r.title_id, r.number, r.schedule, m.ord, m.label, m.alternatives, CASE WHEN m.ord IS NULL THEN 'absent' ELSE 'found' END AS status FROM r LEFT JOIN m ON r.ref_id = m.ref_id AND rn = 1""",
    "toc",
)
def _(v, t):
    return joins.locate_provision(_refs(t("customer")), _scheduled(v("toc"))).select("ref_id", "title_id", "number", "schedule", "ord", "label", F.when(F.col("ord").isNotNull(), F.col("alternatives")).alias("alternatives"), "status")


@query(
    "j7_statute_existence",
    """WITH c AS (SELECT o_orderkey AS cite_id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'Law ' || (o_orderkey % 5) END AS law_name, CASE o_orderkey % 7 WHEN 0 THEN 'NSW' ELSE 'Cth' END AS jurisdiction, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 300 END AS number FROM orders),
n AS (SELECT 'Law 0' AS law_name, 'T0' AS title_id, 1 AS k UNION ALL SELECT 'Law 1', 'T1', 1 UNION ALL SELECT 'Law 2', 'X2', 1 UNION ALL SELECT 'Law 3', 'T0', 2), e AS (SELECT DISTINCT title_id, number FROM toc WHERE number IS NOT NULL),
j AS (SELECT c.*, n.title_id, n.k, e.number AS hit FROM c LEFT JOIN n USING (law_name) LEFT JOIN e ON e.title_id = n.title_id AND e.number = c.number),
x AS (SELECT cite_id, CASE WHEN jurisdiction <> 'Cth' THEN 'non_federal' WHEN law_name IS NULL THEN 'no_name' WHEN title_id IS NULL THEN 'title_absent' WHEN k > 1 THEN 'ambiguous' WHEN number IS NULL THEN 'existence_only' WHEN title_id = 'X2' THEN 'contents_unread' WHEN hit IS NULL THEN 'section_absent' ELSE 'found' END AS reason FROM j)
SELECT cite_id, CASE WHEN reason IN ('found', 'existence_only') THEN 'right' WHEN reason IN ('title_absent', 'section_absent') THEN 'wrong' ELSE 'unclear' END AS verdict, reason FROM x""",
    "toc",
)
def _(v, t):
    o = F.col("o_orderkey")
    cites = t("orders").select(o.alias("cite_id"), F.when(o % 11 != 0, F.concat(F.lit("Law "), o % 5)).alias("law_name"), F.when(o % 7 == 0, "NSW").otherwise("Cth").alias("jurisdiction"), F.when(o % 13 != 0, o % 300).alias("number"))
    names = cites.sparkSession.createDataFrame([("Law 0", "T0"), ("Law 1", "T1"), ("Law 2", "X2"), ("Law 3", "T0"), ("Law 3", "T1")], "name string, id string")
    return joins.statute_existence(cites, names, v("toc"), v("toc").select("title_id").distinct())


@query(
    "j7_statute_existence_by_alias",
    """WITH c AS (SELECT o_orderkey AS cite_id, o_orderkey % 6 AS k, o_orderkey % 300 AS number FROM orders), e AS (SELECT DISTINCT title_id, number FROM toc WHERE number IS NOT NULL),
x AS (SELECT cite_id, CASE k WHEN 0 THEN CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.title_id = 'T0' AND e.number = c.number) THEN 'found' ELSE 'section_absent' END WHEN 1 THEN 'unclear_jurisdiction' WHEN 2 THEN 'non_federal'
  WHEN 3 THEN 'title_absent' WHEN 4 THEN CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.title_id = 'T1' AND e.number = c.number) THEN 'found' ELSE 'section_absent' END ELSE 'non_federal' END AS reason FROM c)
SELECT cite_id, CASE WHEN reason = 'found' THEN 'right' WHEN reason IN ('title_absent', 'section_absent') THEN 'wrong' ELSE 'unclear' END AS verdict, reason FROM x""",
    "toc",
)
def _(v, t):
    o = F.col("o_orderkey")
    spark = t("orders").sparkSession
    asked = [("PA", None), ("EA", None), ("EA", "NSW"), ("No Such Act", "Cth"), ("EA", "Cth"), ("SA", None)]
    of = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "k int, law_name string, jurisdiction string")
    cites = t("orders").select(o.alias("cite_id"), (o % 6).cast("int").alias("k"), (o % 300).alias("number")).join(of, "k").drop("k")
    aliases = spark.createDataFrame([("PA", "Privacy Act 1988", "Cth"), ("EA", "Evidence Act 1995", "Cth"), ("EA", "Evidence Act 1995", "NSW"), ("SA", "Sentencing Act 1991", "Vic")], "alias string, official string, jurisdiction string")
    names = spark.createDataFrame([("Privacy Act 1988", "T0"), ("Evidence Act 1995", "T1")], "name string, id string")
    return joins.statute_existence(cites, names, v("toc"), v("toc").select("title_id").distinct(), aliases)


@query(
    "j8_case_existence",
    r"""WITH m AS (SELECT doc_id, CAST(regexp_extract(citation, '\[([0-9]+)\]', 1) AS INT) AS year, regexp_extract(citation, '\] ([A-Za-z]+)', 1) AS court, CAST(regexp_extract(citation, ' ([0-9]+)$', 1) AS BIGINT) AS number FROM judgments),
c AS (SELECT doc_id, year, court, number + CASE WHEN doc_id % 3 = 0 THEN 100000000 ELSE 0 END AS number FROM m), k AS (SELECT court, year, bool_and(court <> 'QSC') AS complete FROM m WHERE court <> 'VSC' GROUP BY court, year)
SELECT c.doc_id, c.year, c.court, c.number, m.doc_id AS found_id, CASE WHEN m.doc_id IS NOT NULL THEN 'found' WHEN complete IS NULL THEN 'unsupported' WHEN complete THEN 'absent' ELSE 'unreachable' END AS status
FROM c LEFT JOIN m ON c.year = m.year AND c.court = m.court AND c.number = m.number LEFT JOIN k ON k.court = c.court AND k.year = c.year""",
    "judgments",
)
def _(v, t):
    j = v("judgments").select("doc_id", F.regexp_extract("citation", r"\[([0-9]+)\]", 1).cast("int").alias("year"), F.regexp_extract("citation", r"\] ([A-Za-z]+)", 1).alias("court"), F.regexp_extract("citation", " ([0-9]+)$", 1).cast("long").alias("number"))
    cites = j.withColumn("number", F.col("number") + F.when(F.col("doc_id") % 3 == 0, 100000000).otherwise(0))
    coverage = j.filter("court <> 'VSC'").groupBy("court", "year").agg(F.bool_and(F.col("court") != "QSC").alias("complete"))
    return joins.case_existence(cites, j, coverage).select("doc_id", "year", "court", "number", "found_id", "status")


@query(
    "j9_court_dimension",
    """WITH c AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'H.C.A.' WHEN 1 THEN 'NSWCA' WHEN 2 THEN 'QSC' ELSE 'XYZ' END AS token, CAST(1990 + doc_id % 40 AS INT) AS year, CASE doc_id % 4 WHEN 0 THEN 'round' ELSE 'square' END AS bracket FROM documents),
k AS (SELECT 'HCA' AS court, 'High Court' AS court_name, 1998 AS first_year, CAST(NULL AS INT) AS last_year UNION ALL SELECT 'NSWCA', 'Court of Appeal', 1999, 2020 UNION ALL SELECT 'QSC', 'Supreme Court', NULL, 2010)
SELECT replace(token, '.', '') AS court, doc_id, token, year, bracket, court_name, CASE WHEN court_name IS NULL THEN 'unclear' ELSE 'known' END AS status,
  list_filter([CASE WHEN year < first_year THEN 'before_first_year' END, CASE WHEN year > last_year THEN 'after_last_year' END, CASE WHEN bracket = 'round' THEN 'bracket_style' END], lambda x: x IS NOT NULL) AS warnings
FROM c LEFT JOIN k ON k.court = replace(token, '.', '')""",
)
def _(v, t):
    d = F.col("doc_id")
    cites = t("documents").select("doc_id", F.when(d % 5 == 0, "H.C.A.").when(d % 5 == 1, "NSWCA").when(d % 5 == 2, "QSC").otherwise("XYZ").alias("token"), (1990 + d % 40).cast("int").alias("year"), F.when(d % 4 == 0, "round").otherwise("square").alias("bracket"))
    courts = cites.sparkSession.createDataFrame([("HCA", "High Court", 1998, None), ("NSWCA", "Court of Appeal", 1999, 2020), ("QSC", "Supreme Court", None, 2010)], "court string, court_name string, first_year int, last_year int")
    return joins.court_dimension(cites, courts)


@query(
    "j9_report_series",
    """WITH c AS (SELECT doc_id, ['A.Crim.R.', 'clr', 'Tas R', 'QSC', 'Qd R', 'XYZ'][doc_id % 6 + 1] AS token, CASE doc_id % 4 WHEN 0 THEN 'round' ELSE 'square' END AS bracket FROM documents)
SELECT doc_id, token, bracket, [NULL, NULL, NULL, 'Supreme Court', NULL, NULL][doc_id % 6 + 1] AS court_name, ['A Crim R', 'CLR', 'Tas R', NULL, 'Qd R', NULL][doc_id % 6 + 1] AS series, [3, 1, 1, NULL, 1, NULL][doc_id % 6 + 1] AS series_rank,
  CASE WHEN doc_id % 6 = 5 THEN 'unclear' ELSE 'known' END AS status, CASE WHEN CASE doc_id % 6 WHEN 0 THEN bracket <> 'round' WHEN 1 THEN bracket <> 'round' WHEN 2 THEN false WHEN 4 THEN bracket <> 'square' ELSE bracket = 'round' END THEN ['bracket_style'] ELSE [] END AS warnings FROM c""",
)
def _(v, t):
    d = F.col("doc_id")
    token = F.get(F.array(*map(F.lit, ("A.Crim.R.", "clr", "Tas R", "QSC", "Qd R", "XYZ"))), (d % 6).cast("int"))
    cites = t("documents").select("doc_id", token.alias("token"), F.lit(2000).alias("year"), F.when(d % 4 == 0, "round").otherwise("square").alias("bracket"))
    courts = cites.sparkSession.createDataFrame([("QSC", "Supreme Court", None, None)], "court string, court_name string, first_year int, last_year int")
    return joins.court_dimension(cites, courts, joins.report_series(cites.sparkSession)).drop("court", "year")


@query("j10_enabled_instruments", "SELECT affecting AS act, id, name, provisions FROM authorises JOIN titles ON affected = id WHERE collection = 'LegislativeInstrument' AND status = 'InForce'", "titles", "authorises")
def _(v, t):
    return joins.enabled_instruments(v("titles"), v("authorises"))


@query(
    "j11_enabling_acts",
    """WITH e AS (SELECT * FROM authorises WHERE affecting <> 'S1'), x AS (SELECT id, CASE number % 2 WHEN 0 THEN 'Rules made under the Widget Act ' || year ELSE 'none' END AS text FROM titles),
u AS (SELECT id, affecting AS act, provisions, 'edge' AS via FROM titles JOIN e ON id = affected
UNION ALL SELECT t.id, nullif(regexp_extract(x.text, 'made under the ([A-Z][A-Za-z'' ]+? Act [0-9]{4})', 1), ''), NULL, CASE WHEN nullif(regexp_extract(x.text, 'made under the ([A-Z][A-Za-z'' ]+? Act [0-9]{4})', 1), '') IS NOT NULL THEN 'recital' END FROM titles t JOIN x USING (id) WHERE t.id NOT IN (SELECT affected FROM e))
SELECT *, CASE WHEN act IS NULL THEN 'absent' ELSE 'found' END AS status FROM u""",
    "titles",
    "authorises",
)
def _(v, t):
    texts = v("titles").select("id", F.when(F.col("number") % 2 == 0, F.concat(F.lit("Rules made under the Widget Act "), "year")).otherwise("none").alias("text"))
    return joins.enabling_acts(v("titles"), v("authorises").filter("affecting <> 'S1'"), texts)


_EDGES = "g AS (SELECT DISTINCT l_partkey % 100 AS instrument, o_custkey AS act FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(
    "j12_instrument_radar",
    f"""WITH {_EDGES}, i AS (SELECT title_id AS instrument, max(since) AS instrument_date FROM versions WHERE title_id % 2 = 0 GROUP BY title_id), a AS (SELECT DISTINCT title_id AS act FROM versions)
SELECT g.instrument, g.act, i.instrument_date, CASE WHEN i.instrument IS NOT NULL AND a.act IS NOT NULL THEN coalesce(n.n, 0) END AS n_after,
  CASE WHEN i.instrument IS NULL OR a.act IS NULL THEN 'NO_COMPARISON' WHEN coalesce(n.n, 0) > 0 THEN 'REVIEW' ELSE 'NO_SIGNAL' END AS flag
FROM g LEFT JOIN i USING (instrument) LEFT JOIN a USING (act)
LEFT JOIN (SELECT g.instrument, g.act, count(*) AS n FROM g JOIN i USING (instrument) JOIN versions v ON v.title_id = g.act AND v.since > i.instrument_date GROUP BY ALL) n ON n.instrument = g.instrument AND n.act = g.act""",
    "versions",
)
def _(v, t):
    edges = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("l_partkey") % 100).alias("instrument"), F.col("o_custkey").alias("act")).distinct()
    return joins.instrument_radar(edges, v("versions").filter("title_id % 2 = 0"), v("versions"))


@query(
    "j13_enabling_provision_match",
    "SELECT DISTINCT l_suppkey * 10 + l_linenumber AS ref_id, 'S' || l_suppkey AS act, 's ' || l_linenumber AS provision, affected AS instrument, l_linenumber % 2 = 0 AS narrowed FROM lineitem JOIN authorises ON affecting = 'S' || l_suppkey AND provisions = 's ' || l_linenumber",
    "authorises",
)
def _(v, t):
    refs = t("lineitem").select((F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("ref_id"), F.concat(F.lit("S"), "l_suppkey").alias("act"), F.concat(F.lit("s "), "l_linenumber").alias("provision")).distinct()
    several = F.regexp_extract("provisions", "([0-9]+)", 1).cast("int") % 2 == 0
    edges = v("authorises").select(F.col("affected").alias("instrument"), F.col("affecting").alias("act"), F.when(several, F.concat("provisions", F.lit(" and s 99"))).otherwise(F.col("provisions")).alias("provisions"))
    return joins.enabling_provision_match(edges, refs)


@query(
    "j14_amending_acts",
    """WITH b AS (SELECT year AS act_year, number AS act_number, min(id) AS act_id, min_by(name, id) AS act_name FROM titles WHERE collection = 'Act' GROUP BY year, number)
SELECT a.title_id, a.provision, a.effect, a.act_year, a.act_number, act_id, act_name, CASE WHEN act_id IS NULL THEN 'absent' ELSE 'found' END AS status FROM amendments a LEFT JOIN b USING (act_year, act_number)""",
    "titles",
    "amendments",
)
def _(v, t):
    return joins.amending_acts(v("amendments"), v("titles"))


@query(
    "j15_amended_after",
    "SELECT e.event_id, e.title_id, provision, effect, act_year FROM (SELECT l_suppkey AS title_id, year(l_shipdate) AS y, min(l_orderkey * 100 + l_linenumber) AS event_id FROM lineitem GROUP BY 1, 2) e JOIN amendments a ON a.title_id = e.title_id AND act_year >= y",
    "amendments",
)
def _(v, t):
    # An event for each supplier and year, over all lines.
    events = t("lineitem").groupBy(F.col("l_suppkey").alias("title_id"), F.year("l_shipdate").alias("y")).agg(F.min(F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("event_id"), F.to_date(F.min("l_shipdate")).alias("d"))
    return joins.amended_after(events, v("amendments")).select("event_id", "title_id", "provision", "effect", "act_year")


@query(
    "j16_state_counterparts",
    """WITH f AS (SELECT 'R' || r_regionkey AS family, lower(r_name) AS w, regexp_replace(lower(r_name), '[^a-z0-9]', '', 'g') AS f FROM region),
k AS (SELECT c_custkey AS name_id, CASE c_custkey % 4 WHEN 0 THEN lower(r_name) WHEN 1 THEN lower(r_name) || ' law' WHEN 2 THEN 'old ' || split_part(lower(r_name), ' ', 2) || ' evidence ' || split_part(lower(r_name), ' ', 1) || ' rules' ELSE 'zz' END AS w FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
s AS (SELECT name_id, family, length(f) AS n, CASE WHEN regexp_replace(k.w, '[^a-z0-9]', '', 'g') = f THEN 3 WHEN contains(regexp_replace(k.w, '[^a-z0-9]', '', 'g'), f) THEN 2 WHEN list_has_any(list_filter(string_split(k.w, ' '), lambda x: length(x) >= 4), list_filter(string_split(f.w, ' '), lambda x: length(x) >= 4)) THEN 1 ELSE 0 END AS score FROM k, f),
b AS (SELECT name_id, family, score, row_number() OVER (PARTITION BY name_id ORDER BY score DESC, n DESC, family DESC) AS rn FROM s WHERE score > 0)
SELECT b.family, b.name_id, b.score, n_name AS member FROM b JOIN nation ON family = 'R' || n_regionkey WHERE rn = 1""",
)
def _(v, t):
    geo = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c, word = F.col("c_custkey") % 4, lambda i: F.coalesce(F.try_element_at(F.split("r_name", " "), F.lit(i)), F.lit(""))
    named = F.when(c == 0, F.col("r_name")).when(c == 1, F.concat("r_name", F.lit(" law"))).when(c == 2, F.concat(F.lit("Old "), word(2), F.lit(" evidence "), word(1), F.lit(" rules"))).otherwise("zz")
    families = t("region").select(F.concat(F.lit("R"), "r_regionkey").alias("family"), F.col("r_name").alias("fragment"))
    return joins.state_counterparts(geo.select(F.col("c_custkey").alias("name_id"), named.alias("name")), families, t("nation").select(F.concat(F.lit("R"), "n_regionkey").alias("family"), F.col("n_name").alias("member")))


_MENTIONS = r"""m AS (SELECT doc_id, regexp_extract(text, 'See (\[[0-9]+\] [A-Za-z]+ [0-9]+) at', 1) AS citation FROM judgments)"""


def _mentions(judgments: DataFrame) -> DataFrame:
    return judgments.select("doc_id", F.regexp_extract("text", r"See (\[[0-9]+\] [A-Za-z]+ [0-9]+) at", 1).alias("citation"))


@query("j17_citing_documents", f"WITH {_MENTIONS} SELECT t.doc_id AS target_id, m.doc_id, count(*) AS n_mentions FROM judgments t JOIN m USING (citation) WHERE m.doc_id <> t.doc_id GROUP BY t.doc_id, m.doc_id", "judgments")
def _(v, t):
    j = v("judgments")
    return joins.citing_documents(j.select(F.col("doc_id").alias("target_id"), "citation"), _mentions(j))


@query(
    "j18_phrase_mentions",
    r"""WITH w AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS b FROM judgments), p AS (SELECT * FROM (VALUES (1, 'It is overruled'), (2, 'case is distinguished'), (3, 'distinguished'), (4, 'never there')) x(phrase_id, phrase))
SELECT doc_id, phrase_id FROM w, p WHERE contains(b, ' ' || trim(regexp_replace(lower(phrase), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ')""",
    "judgments",
)
def _(v, t):
    j = v("judgments")
    phrases = j.sparkSession.createDataFrame([(1, "It is overruled"), (2, "case is distinguished"), (3, "distinguished"), (4, "never there")], "phrase_id int, phrase string")
    return joins.phrase_mentions(j, phrases)


@query("j19_unverified_candidates", "SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2') AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(v, t):
    return joins.unverified_candidates(t("documents").select("doc_id", "source"), t("labels").filter("quality = 1"), ("src1", "src2"))


@query(
    "j20_transitional_headings",
    r"""WITH h AS (SELECT title_id, ord, CASE ord % 5 WHEN 0 THEN 'Transitional: ' || label ELSE label END AS label FROM toc), r AS (SELECT *, row_number() OVER (PARTITION BY title_id ORDER BY ord) AS rn FROM h WHERE regexp_matches(label, '(?i)\b(application|saving|savings|transitional)\b'))
SELECT title_id, ord, label FROM r WHERE rn <= 6""",
    "toc",
)
def _(v, t):
    toc = v("toc").withColumn("label", F.when(F.col("ord") % 5 == 0, F.concat(F.lit("Transitional: "), "label")).otherwise(F.col("label")))
    return joins.transitional_headings(toc.select("title_id"), toc)


@query(
    "j21_law_surroundings",
    """SELECT affecting AS id, 'instruments' AS leg, collection AS item, count(*) AS n FROM authorises JOIN titles ON id = affected GROUP BY ALL UNION ALL SELECT CAST(title_id AS VARCHAR), 'versions', affect, count(*) FROM versions GROUP BY ALL""",
    "titles",
    "authorises",
    "versions",
)
def _(v, t):
    return joins.law_surroundings(v("titles"), v("authorises"), v("versions"))


#: Instruments enable titles, titles with even numbers were renamed from those of half the number.
_EDGES = """SELECT affecting AS src, affected AS dst, 'enables' AS kind FROM authorises
UNION ALL SELECT 'C' || p_partkey, 'C' || CAST(floor(p_partkey / 2.0) AS BIGINT), 'renamed' FROM part WHERE p_partkey % 2 = 0"""


@query(
    "j21_law_network",
    f"""SELECT root, law, hops, CASE WHEN hops = 0 THEN NULL WHEN hops = 1 THEN 'enables' ELSE 'renamed' END AS via FROM (
  WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT DISTINCT affecting AS root, affecting AS law, 0 AS hops FROM authorises UNION SELECT r.root, e.dst, r.hops + 1 FROM r JOIN e ON e.src = r.law WHERE r.hops < 3)
  SELECT root, law, min(hops) AS hops FROM r GROUP BY root, law) x""",
    "authorises",
)
def _(v, t):
    named = t("part").filter("p_partkey % 2 = 0").selectExpr("concat('C', p_partkey) AS src", "concat('C', p_partkey div 2) AS dst", "'renamed' AS kind")
    edges = v("authorises").selectExpr("affecting AS src", "affected AS dst", "'enables' AS kind").unionByName(named)
    return joins.law_network(v("authorises").select(F.col("affecting").alias("id")).distinct(), edges, 3)


@query(
    "j22_batch_provisions",
    f"""WITH {_REFS}, q AS (SELECT ref_id, CASE WHEN number % 11 = 0 THEN 'none' ELSE title_id END AS title_id, number FROM r), p AS (SELECT title_id, number, label, ord FROM toc WHERE number IS NOT NULL)
SELECT q.ref_id AS request_id, q.title_id, q.number, p.label, substr(p.label || ' text ' || p.ord, 1, 12) AS text, CASE WHEN p.label IS NOT NULL THEN 'found' WHEN q.title_id IN (SELECT title_id FROM toc) THEN 'section_absent' ELSE 'title_unread' END AS status FROM q LEFT JOIN p USING (title_id, number)""",
    "toc",
)
def _(v, t):
    held = v("toc").filter("number is not null").select("title_id", "number", "label", F.concat("label", F.lit(" text "), "ord").alias("text"))
    asked = _refs(t("customer")).withColumnRenamed("ref_id", "request_id").withColumn("title_id", F.when(F.col("number") % 11 == 0, "none").otherwise(F.col("title_id")))
    return joins.batch_provisions(asked, held, held.select("title_id"), 12)


@query(
    "j23_schedule_scope",
    """WITH q AS (SELECT c_custkey AS request_id, CASE c_custkey % 3 WHEN 0 THEN 'A.C.L.' WHEN 1 THEN 'cca' ELSE 'none' END AS alias, CASE c_custkey % 4 WHEN 0 THEN 'sch 3 s ' ELSE 's ' END || c_custkey AS ref FROM customer)
SELECT request_id, alias, ref, CASE alias WHEN 'A.C.L.' THEN 'Consumer Act' WHEN 'cca' THEN 'Consumer Act' END AS official, CASE WHEN alias = 'A.C.L.' AND ref NOT LIKE 'sch%' THEN 'sch 2 ' || ref ELSE ref END AS scoped_ref FROM q""",
)
def _(v, t):
    c = F.col("c_custkey")
    asked = t("customer").select(c.alias("request_id"), F.when(c % 3 == 0, "A.C.L.").when(c % 3 == 1, "cca").otherwise("none").alias("alias"), F.concat(F.when(c % 4 == 0, "sch 3 s ").otherwise("s "), c).alias("ref"))
    known = asked.sparkSession.createDataFrame([("ACL", "Consumer Act", "2"), ("CCA", "Consumer Act", None)], "alias string, official string, schedule string")
    return joins.schedule_scope(asked, known)


@query(
    "j24_identity_match",
    """WITH q AS (SELECT doc_id AS request_id, CASE doc_id % 3 WHEN 0 THEN '  ' || upper(citation) ELSE citation || 'x' END AS wanted FROM judgments)
SELECT request_id, wanted, CASE WHEN request_id % 3 = 0 THEN request_id END AS doc_id, CASE WHEN request_id % 3 = 0 THEN 'found' ELSE 'absent' END AS status FROM q""",
    "judgments",
)
def _(v, t):
    j = v("judgments").select("doc_id", "citation", F.lit("same title").alias("title"))
    wanted = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("  "), F.upper("citation"))).otherwise(F.concat("citation", F.lit("x")))
    return joins.identity_match(j.select(F.col("doc_id").alias("request_id"), wanted.alias("wanted")), j)


@query("j25_related_laws", "SELECT 'term ' || (t.number % 20) AS term, t.name AS official, list_sort(list(DISTINCT alias)) AS aliases FROM titles t JOIN aliases ON official = t.name GROUP BY ALL", "titles", "aliases")
def _(v, t):
    terms = v("titles").groupBy(F.concat(F.lit("term "), F.col("number") % 20).alias("term")).agg(F.collect_set("name").alias("laws"))
    return joins.related_laws(terms, v("aliases"))


@query("j25_administering_bodies", "SELECT DISTINCT 'term ' || (t.number % 20) AS term, t.name AS official, b.bodies FROM titles t JOIN (SELECT name, list_sort(list(DISTINCT 'Body ' || (number % 7))) AS bodies FROM titles GROUP BY name) b USING (name)", "titles")
def _(v, t):
    terms = v("titles").groupBy(F.concat(F.lit("term "), F.col("number") % 20).alias("term")).agg(F.collect_set("name").alias("laws"))
    bodies = v("titles").select(F.col("name").alias("official"), F.concat(F.lit("Body "), F.col("number") % 7).alias("body"))
    return joins.related_laws(terms, v("aliases"), bodies).select("term", "official", "bodies")


# Aggregations


@query("a1_register_counts", "SELECT s.bucket, coalesce(n, 0) AS n FROM (VALUES ('InForce'), ('Ceased'), ('Repealed'), ('NeverEffective')) s(bucket) LEFT JOIN (SELECT status AS bucket, count(*) AS n FROM titles GROUP BY status) USING (bucket) UNION ALL SELECT 'total', count(*) FROM titles", "titles")
def _(v, t):
    return aggs.register_counts(v("titles"), "status")


@query("a1_register_years", "SELECT CAST(y AS VARCHAR) AS bucket, (SELECT count(*) FROM titles WHERE year = y) AS n FROM (SELECT unnest(range(min(year), max(year) + 1)) AS y FROM titles) UNION ALL SELECT 'total', count(*) FROM titles", "titles")
def _(v, t):
    return aggs.register_counts(v("titles"), "year")


@query(
    "a2_citation_report",
    """SELECT doc_id % 100 AS doc_id, count(verdict) AS n, count(*) FILTER (verdict = 'right') AS n_right, count(*) FILTER (verdict = 'wrong') AS n_wrong, count(*) FILTER (verdict = 'unclear') AS n_unclear, count(*) FILTER (verdict = 'right' AND doc_id % 3 = 0) AS n_existence,
  CASE WHEN count(verdict) = 0 THEN 'NONE' WHEN count(*) FILTER (verdict = 'wrong') > 0 THEN 'ERRORS' WHEN count(*) FILTER (verdict = 'unclear') > 0 THEN 'PARTIAL' ELSE 'VERIFIED' END AS banner
FROM (SELECT doc_id, CASE WHEN doc_id % 100 < 3 THEN NULL WHEN doc_id % 101 = 0 THEN 'wrong' WHEN doc_id % 7 = 0 AND doc_id % 2 = 0 THEN 'unclear' ELSE 'right' END AS verdict FROM documents) GROUP BY doc_id % 100""",
)
def _(v, t):
    d = F.col("doc_id")
    verdict = F.when(d % 100 < 3, None).when(d % 101 == 0, "wrong").when((d % 7 == 0) & (d % 2 == 0), "unclear").otherwise("right")
    return aggs.citation_report(t("documents").select((d % 100).alias("doc_id"), verdict.alias("verdict"), (d % 3 == 0).alias("existence_only")))


@query("a3_citation_graph", f"WITH {_MENTIONS} SELECT m.citation AS target, count(*) AS n_mentions, count(DISTINCT m.doc_id) AS n_docs, count(DISTINCT regexp_extract(j.citation, '\\] ([A-Za-z]+)', 1)) AS n_courts FROM m JOIN judgments j USING (doc_id) GROUP BY m.citation", "judgments")
def _(v, t):
    j = v("judgments")
    return aggs.citation_graph(_mentions(j).withColumnRenamed("citation", "target").join(j.select("doc_id", F.regexp_extract("citation", r"\] ([A-Za-z]+)", 1).alias("court")), "doc_id"))


@query(
    "a4_citator_verdict",
    """WITH c AS (SELECT CAST(floor(doc_id / 2.0) AS BIGINT) AS target_id, doc_id, doc_id % 7 = 0 AS bad, doc_id % 5 <> 0 AS confirmed FROM documents), g AS (SELECT target_id, count(*) AS n, count(*) FILTER (confirmed) AS k, count(*) FILTER (bad) AS b FROM c GROUP BY target_id)
SELECT d.doc_id AS target_id, coalesce(k, 0) AS n_confirmed, CASE WHEN coalesce(b, 0) > 0 THEN 'overruled_candidate' WHEN d.doc_id % 11 = 0 THEN 'legislative_override' WHEN d.doc_id % 3 = 0 AND coalesce(n, 0) = 0 THEN 'not_found' WHEN coalesce(k, 0) > 0 THEN 'cited' ELSE 'unverified_treatment' END AS verdict
FROM documents d LEFT JOIN g ON g.target_id = d.doc_id""",
)
def _(v, t):
    d = F.col("doc_id")
    targets = t("documents").select(d.alias("target_id"), F.when(d % 3 == 0, "absent").otherwise("found").alias("status"), F.lit(True).alias("complete"))
    citing = t("documents").select(F.floor(d / 2.0).alias("target_id"), "doc_id", (d % 5 != 0).alias("confirmed"))
    treatments = citing.filter("doc_id % 7 = 0").select("target_id", F.lit("overruling").alias("kind"))
    return aggs.citator_verdict(targets, treatments, targets.filter("target_id % 11 = 0").select("target_id"), citing)


@query("a5_merge_traces", "SELECT source, count(DISTINCT doc_id // 3) AS n_hits, CASE WHEN bool_and(doc_id % 501 <> 7) THEN 'ok' ELSE 'incomplete' END AS status FROM documents GROUP BY source")
def _(v, t):
    d = F.col("doc_id")
    return aggs.merge_traces(t("documents").select("source", F.floor(d / 3).alias("id"), F.when(d % 501 == 7, "failed").otherwise("ok").alias("status")))


@query(
    "a6_impact_summary",
    """WITH p AS (SELECT DISTINCT 'S' || title_id AS title_id, provision, title_id AS k FROM amendments), i AS (SELECT affecting AS title_id, provisions AS provision FROM authorises)
SELECT p.title_id, p.provision, CASE WHEN k % 2 = 0 THEN 0 END AS n_citing, CASE WHEN k % 3 <> 0 THEN coalesce(x.n, 0) END AS n_instruments, CASE WHEN k % 3 <> 0 THEN coalesce(y.n, 0) END AS n_naming, z.n AS n_amendments, CASE WHEN k % 5 <> 0 THEN CASE k % 2 WHEN 1 THEN 2 ELSE 0 END END AS n_families
FROM p LEFT JOIN (SELECT title_id, count(*) AS n FROM i GROUP BY title_id) x ON x.title_id = p.title_id LEFT JOIN (SELECT title_id, provision, count(*) AS n FROM i GROUP BY title_id, provision) y ON y.title_id = p.title_id AND y.provision = p.provision
JOIN (SELECT 'S' || title_id AS title_id, provision, count(*) AS n FROM amendments GROUP BY 1, 2) z ON z.title_id = p.title_id AND z.provision = p.provision""",
    "amendments",
    "authorises",
)
def _(v, t):
    amended = v("amendments").withColumn("k", F.col("title_id")).withColumn("title_id", F.concat(F.lit("S"), "title_id"))
    made = v("authorises").select(F.col("affecting").alias("title_id"), F.col("provisions").alias("provision"))
    ids = amended.select("title_id", "k").distinct()
    kinds = [ids.filter(cond).select("title_id", F.lit(kind).alias("kind")) for kind, cond in (("citing", "k % 2 = 0"), ("instruments", "k % 3 <> 0"), ("amendments", "true"), ("families", "k % 5 <> 0"))]
    nobody = amended.select("title_id", "provision", F.lit(1).alias("doc_id")).filter("false")
    return aggs.impact_summary(amended.select("title_id", "provision").distinct(), nobody, made, amended, kinds[0].union(kinds[1]).union(kinds[2]).union(kinds[3]), ids.filter("k % 2 = 1").select("title_id", F.explode(F.array(F.lit("F1"), F.lit("F2"))).alias("family")))


@query("a7_toc_summary", "SELECT title_id, count(*) AS n_entries, count(number) AS n_numbered, count(*) FILTER (depth = 1) AS n_parts, count(DISTINCT CAST(floor(ord / 40.0) AS BIGINT)) AS n_volumes, count(*) FILTER (depth = 2 AND ord % 2 = 0) AS n_schedules, arg_min(number, ord) FILTER (number IS NOT NULL) AS first_number, arg_max(number, ord) FILTER (number IS NOT NULL) AS last_number FROM toc GROUP BY title_id", "toc")
def _(v, t):
    ord_ = F.col("ord")
    # Every second division is a schedule, and each has an entry below it that looks like one more.
    label = F.when((F.col("depth") == 2) & (ord_ % 2 == 0), F.concat(F.lit("Schedule "), ord_)).when(F.col("number") % 10 == 5, F.concat(F.lit("Schedule of "), "number")).otherwise(F.col("label"))
    inside = F.when((F.col("depth") == 3) & (F.col("number") % 10 == 5), F.concat(F.lit("Item "), "number")).otherwise(label)
    return aggs.toc_summary(v("toc").withColumns({"label": inside, "volume": F.floor(ord_ / 40)}))


_FINDINGS = "f AS (SELECT doc_id % 200 AS doc_id, CASE doc_id % 3 WHEN 0 THEN 'termination' WHEN 1 THEN 'indemnity' ELSE 'law' END AS category, CASE WHEN doc_id % 200 < 10 THEN 'low' ELSE CASE doc_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END END AS severity FROM documents WHERE doc_id % 13 <> 0)"


def _findings(docs: DataFrame) -> DataFrame:
    d = F.col("doc_id")
    kind = F.when(d % 3 == 0, "termination").when(d % 3 == 1, "indemnity").otherwise("law")
    severity = F.when(d % 200 < 10, "low").when(d % 4 == 0, "high").when(d % 4 == 1, "medium").otherwise("low")
    return docs.filter("doc_id % 13 <> 0").select((d % 200).alias("doc_id"), kind.alias("category"), severity.alias("severity"))


@query("a8_risk_score", f"WITH {_FINDINGS}, s AS (SELECT doc_id, CAST(sum(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 1 ELSE 0 END) AS BIGINT) AS score FROM f GROUP BY doc_id) SELECT *, CASE WHEN score = 0 THEN 'low' WHEN score <= 3 THEN 'moderate' WHEN score <= 8 THEN 'elevated' ELSE 'high' END AS grade FROM s")
def _(v, t):
    return aggs.risk_score(_findings(t("documents")))


DOC_SIGNALS = [("contract", "payable", 3), ("contract", "terminate", 3), ("claim", "indemnify", 6), ("policy", r"laws of NSW", 5), ("policy", "fee", 1)]


@query(
    "a9_doc_type",
    """WITH s AS (SELECT doc_id, 3 + CASE WHEN contains(text, 'terminate') THEN 3 ELSE 0 END AS c, CASE WHEN contains(text, 'indemnify') THEN 6 ELSE 0 END AS m, CASE WHEN contains(text, 'laws of NSW') THEN 5 ELSE 0 END + CASE WHEN contains(text, 'fee') THEN 1 ELSE 0 END AS p FROM clauses_src)
SELECT doc_id, CASE WHEN m >= 6 THEN 'claim' WHEN c >= p AND c > 4 THEN 'contract' WHEN p > 4 THEN 'policy' ELSE 'other' END AS doc_type, CASE WHEN m >= 6 THEN m WHEN c >= p AND c > 4 THEN c WHEN p > 4 THEN p ELSE 0 END AS score FROM s""",
    "clauses_src",
)
def _(v, t):
    return aggs.doc_type(v("clauses_src"), DOC_SIGNALS)


@query(
    "a10_source_totals",
    "SELECT lang AS query_id, CAST(sum(coalesce(CASE WHEN n % 3 <> 0 THEN n * 10 END, n)) AS BIGINT) AS total, bool_or(n % 3 = 0) AS unreliable, coalesce(string_agg(DISTINCT CASE WHEN n % 3 = 0 THEN 'capped ' || n END, '; ' ORDER BY CASE WHEN n % 3 = 0 THEN 'capped ' || n END), '') AS notes FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) GROUP BY lang",
)
def _(v, t):
    n = F.col("n_rows")
    rows = t("documents").groupBy(F.col("lang").alias("query_id"), "source").agg(F.count("*").alias("n_rows"))
    return aggs.source_totals(rows.select("query_id", "n_rows", F.when(n % 3 != 0, n * 10).alias("total"), (n % 3 == 0).alias("unreliable"), F.when(n % 3 == 0, F.concat(F.lit("capped "), n)).alias("note")))


@query("a11_amenders", "SELECT title_id, count(*) AS n_versions, count(*) FILTER (affect = 'AsMade') AS n_asmade, count(*) FILTER (affect = 'Amend') AS n_amend, count(*) FILTER (affect = 'Repeal') AS n_repeal, count(DISTINCT CASE WHEN affect IN ('Amend', 'Repeal') THEN register_id % 7 END) AS n_acts FROM versions GROUP BY title_id", "versions")
def _(v, t):
    return aggs.amenders(v("versions").withColumn("reasons", F.array(F.struct("affect", (F.col("register_id") % 7).alias("affecting_id")))))


@query("a12_rule_hit_matrix", f"WITH {_FINDINGS} SELECT CASE WHEN grouping(category) = 1 THEN 'all' ELSE category END AS category, CASE WHEN grouping(severity) = 1 THEN 'all' ELSE severity END AS severity, count(*) AS n FROM f GROUP BY CUBE (category, severity)")
def _(v, t):
    return aggs.rule_hit_matrix(_findings(t("documents")))


@query("a13_facet_counts", "SELECT lang AS facet, count(*) AS n FROM documents GROUP BY lang")
def _(v, t):
    return aggs.facet_counts(t("documents"), "lang")


# Windows


@query("w1_latest_version", "SELECT title_id, max(since) AS since, arg_max(register_id, since) AS register_id, arg_max(affect, since) AS affect FROM versions GROUP BY title_id", "versions")
def _(v, t):
    return windows.latest_version(v("versions")).drop("until")


@query(
    "w2_current_vs_latest",
    "SELECT title_id, max(register_id) FILTER (since <= DATE '1997-01-01' AND (until IS NULL OR DATE '1997-01-01' < until)) AS current_id, arg_max(register_id, since) AS latest_id, max(register_id) FILTER (since <= DATE '1997-01-01' AND (until IS NULL OR DATE '1997-01-01' < until)) IS DISTINCT FROM arg_max(register_id, since) AS lags FROM versions GROUP BY title_id",
    "versions",
)
def _(v, t):
    return windows.current_vs_latest(v("versions"), "1997-01-01")


@query("w3_version_pairs", "SELECT * FROM (SELECT title_id, since, register_id, lag(register_id) OVER w AS previous_id, lag(since) OVER w AS previous_since FROM versions WINDOW w AS (PARTITION BY title_id ORDER BY since)) WHERE previous_id IS NOT NULL", "versions")
def _(v, t):
    return windows.version_pairs(v("versions")).select("title_id", "since", "register_id", "previous_id", "previous_since")


@query(
    "w3_reasons_between",
    """WITH c AS (SELECT title_id, since, register_id, lag(register_id) OVER w AS previous_id, lag(since) OVER w AS previous_since FROM versions WHERE register_id % 4 = 0 WINDOW w AS (PARTITION BY title_id ORDER BY since))
SELECT c.title_id, c.since, c.register_id, c.previous_id, string_agg(x.affect, ',' ORDER BY x.since) AS reasons, count(*) - 1 AS left_out FROM c JOIN versions x ON x.title_id = c.title_id AND x.since > c.previous_since AND x.since <= c.since
WHERE c.previous_id IS NOT NULL GROUP BY ALL""",
    "versions",
)
def _(v, t):
    found = windows.chosen_pairs(v("versions"), F.col("register_id") % 4 == 0)
    return found.select("title_id", "since", "register_id", "previous_id", F.array_join("reasons", ",").alias("reasons"), "left_out")


@query("w4_later_versions", """WITH k AS (SELECT DISTINCT title_id, d FROM law_events), n AS (SELECT k.title_id, k.d, count(x.since) AS n_later FROM k LEFT JOIN versions x ON x.title_id = k.title_id AND x.since > k.d GROUP BY k.title_id, k.d)
SELECT event_id, e.title_id, e.d, n_later FROM law_events e JOIN n ON n.title_id = e.title_id AND n.d = e.d""", "versions", "law_events")
def _(v, t):
    return windows.later_versions(v("law_events"), v("versions"))


@query("w5_interleave", "SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank, source_order) AS slot FROM hits", "hits")
def _(v, t):
    return windows.interleave(v("hits")).select("query_id", "id", "slot")


@query(
    "w6_toc_ancestors",
    """WITH c AS (SELECT t.*, max(CASE WHEN depth = 1 THEN ord END) OVER w AS p1, max(CASE WHEN depth = 2 THEN ord END) OVER w AS p2 FROM toc t WINDOW w AS (PARTITION BY title_id ORDER BY ord))
SELECT c.title_id, c.ord, CASE c.depth WHEN 2 THEN p1 WHEN 3 THEN p2 END AS parent_ord, array_to_string(list_filter([CASE WHEN c.depth > 1 THEN a.label END, CASE WHEN c.depth > 2 THEN b.label END, c.label], lambda x: x IS NOT NULL), ' > ') AS path
FROM c LEFT JOIN toc a ON a.ord = p1 LEFT JOIN toc b ON b.ord = p2""",
    "toc",
)
def _(v, t):
    return windows.toc_ancestors(v("toc")).select("title_id", "ord", "parent_ord", F.array_join("breadcrumb", " > ").alias("path"))


@query(
    "w7_toc_subtree_range",
    """SELECT title_id, ord, coalesce(CASE depth WHEN 1 THEN min(CASE WHEN depth <= 1 THEN ord END) OVER w WHEN 2 THEN min(CASE WHEN depth <= 2 THEN ord END) OVER w ELSE min(ord) OVER w END, max(ord) OVER (PARTITION BY title_id) + 1) AS end_ord
FROM toc WINDOW w AS (PARTITION BY title_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)""",
    "toc",
)
def _(v, t):
    return windows.toc_subtree_range(v("toc")).select("title_id", "ord", "end_ord")


@query(
    "w8_slice_provision",
    """WITH t AS (SELECT *, last_value(CASE WHEN depth < 3 THEN ord END IGNORE NULLS) OVER (PARTITION BY title_id ORDER BY ord) AS k FROM toc)
SELECT title_id, 'a' || k AS anchor, string_agg(regexp_replace(label, '\\s+', ' ', 'g') || ' body of ' || ord, ' ' ORDER BY ord) AS text FROM t GROUP BY title_id, k""",
    "toc",
)
def _(v, t):
    # A volume for each title: every entry has an anchor, but only parts and divisions are listed.
    piece = F.concat(F.lit('<h2 id="a'), "ord", F.lit('">'), "label", F.lit("</h2><p>body of "), "ord", F.lit("</p>"))
    volumes = v("toc").groupBy("title_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", piece.alias("p")))), lambda x: x["p"]), "").alias("html"))
    return windows.slice_provision(volumes, v("toc").filter("depth < 3").select("title_id", F.concat(F.lit("a"), "ord").alias("anchor")))


@query(
    "w9_nearest_entries",
    f"""WITH {_REFS}, n AS (SELECT r.ref_id, r.title_id, r.number, ord, label, abs(t.number - r.number) AS distance, row_number() OVER (PARTITION BY ref_id ORDER BY abs(t.number - r.number), ord) AS rank FROM r JOIN toc t ON t.title_id = r.title_id AND t.number IS NOT NULL)
SELECT ref_id, title_id, number, rank, ord, label, distance FROM n WHERE rank <= 3""",
    "toc",
)
def _(v, t):
    return windows.nearest_entries(_refs(t("customer")).drop("schedule"), v("toc"))


@query("w10_forward_fill_scope", "SELECT title_id, n, last_value(heading IGNORE NULLS) OVER (PARTITION BY title_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS scope FROM (SELECT title_id, ord AS n, CASE WHEN depth < 3 THEN label END AS heading FROM toc)", "toc")
def _(v, t):
    lines = v("toc").select("title_id", F.col("ord").alias("n"), F.when(F.col("depth") < 3, F.col("label")).alias("heading"))
    return windows.forward_fill_scope(lines).select("title_id", "n", "scope")


_CITES = "c AS (SELECT o_custkey AS doc_id, CAST(o_orderdate AS DATE) >= DATE '1996-01-01' AS para, o_orderkey AS pos, CASE o_orderkey % 3 WHEN 0 THEN 'Act ' || (o_orderkey % 10) END AS law_name FROM orders)"


def _cites(orders: DataFrame) -> DataFrame:
    o = F.col("o_orderkey")
    return orders.select(F.col("o_custkey").alias("doc_id"), (F.to_date("o_orderdate") >= F.lit("1996-01-01").cast("date")).alias("para"), o.alias("pos"), F.when(o % 3 == 0, F.concat(F.lit("Act "), o % 10)).alias("law_name"))


@query("w11_antecedent", f"WITH {_CITES} SELECT doc_id, para, pos, coalesce(law_name, last_value(law_name IGNORE NULLS) OVER (PARTITION BY doc_id, para ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS law FROM c")
def _(v, t):
    return windows.antecedent(_cites(t("orders"))).drop("law_name")


@query("w12_dedupe_citations", f"WITH {_CITES} SELECT doc_id, law_name, min(pos) AS pos FROM c GROUP BY doc_id, law_name")
def _(v, t):
    return windows.dedupe_citations(_cites(t("orders")), "law_name").drop("para")


@query(
    "w13_prioritise_citing",
    r"""SELECT doc_id, target, rank FROM (SELECT doc_id, source AS target, row_number() OVER (PARTITION BY source ORDER BY CASE regexp_extract(citation, '\] (\w+) ', 1) WHEN 'HCA' THEN 0 WHEN 'NSWCA' THEN 1 ELSE 2 END, substr(citation, 2, 4) DESC, doc_id) AS rank FROM judgments) WHERE rank <= 3""",
    "judgments",
)
def _(v, t):
    hits = v("judgments").select("doc_id", "citation", F.col("source").alias("target"), F.substring("citation", 2, 4).alias("date"))
    return windows.prioritise_citing(hits, 3).select("doc_id", "target", "rank")


# Rankings


@query(
    "k1_rank_titles",
    """WITH q AS (SELECT n_nationkey AS query_id, CASE n_nationkey % 2 WHEN 0 THEN 'act' || (1951 + n_nationkey) ELSE 'act19' END AS q FROM nation), k AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS key FROM titles),
s AS (SELECT query_id, id, CASE WHEN key = q THEN 100 WHEN starts_with(key, q) THEN 60 ELSE 30 END + CASE WHEN is_principal THEN 25 ELSE 0 END + CASE WHEN collection = 'Act' THEN 20 ELSE 0 END + CASE status WHEN 'InForce' THEN 15 WHEN 'Repealed' THEN -10 ELSE 0 END AS points FROM q JOIN k ON contains(key, q))
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, id) AS rank, id, points FROM s) WHERE rank <= 10""",
    "titles",
)
def _(v, t):
    n = F.col("n_nationkey")
    return rank.rank_titles(t("nation").select(n.alias("query_id"), F.when(n % 2 == 0, F.concat(F.lit("Act "), n + 1951)).otherwise("Act 19").alias("query")), v("titles"))


@query(
    "k2_rank_base_law",
    """WITH q AS (SELECT n_nationkey AS query_id, CAST(1951 + n_nationkey AS VARCHAR) AS y FROM nation), s AS (SELECT query_id, id, name, is_principal, collection, status FROM q JOIN titles ON year = CAST(y AS BIGINT)),
w AS (SELECT *, len(list_distinct(list_transform(list_filter(string_split(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: len(x) > 1), lambda x: CASE WHEN len(x) > 5 THEN regexp_replace(x, '(ings|ing|ies|ed|es|s)$', '') ELSE x END))) AS n FROM s),
p AS (SELECT query_id, id, CAST(60 + round(30.0 * 1 / n) + CASE WHEN is_principal THEN 25 ELSE -100 END + CASE WHEN collection = 'Act' THEN 20 ELSE 0 END + CASE status WHEN 'InForce' THEN 15 ELSE -10 END AS INT) AS points FROM w)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, id) AS rank, id, points FROM p) WHERE rank <= 3""",
    "titles",
)
def _(v, t):
    asked = t("nation").select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("in "), F.col("n_nationkey") + 1951).alias("query"))
    return rank.rank_base_law(asked, v("titles"), v("titles").select(F.lit(0).alias("query_id"), "id").filter("false"))


@query(
    "k3_rank_terms",
    """WITH q AS (SELECT c_custkey AS query_id, lower(c_mktsegment) AS q FROM customer), t AS (SELECT n_name AS term, lower(n_name) AS t, 'market ' || lower(n_name) AS x FROM nation UNION ALL SELECT DISTINCT c_mktsegment || ' LAW', lower(c_mktsegment) || ' law', '' FROM customer),
s AS (SELECT query_id, term, CAST(78 - least(12, abs(len(t) - len(q))) AS INT) AS score, 'prefix' AS matched_by FROM q JOIN t ON starts_with(t, q))
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, len(term), term) AS rank, term, score, matched_by FROM s) WHERE rank <= 5""",
)
def _(v, t):
    none = F.array().cast("array<string>").alias("aliases")
    terms = t("nation").select(F.col("n_name").alias("term"), none, F.concat(F.lit("market "), F.lower("n_name")).alias("text")).unionByName(t("customer").select(F.concat("c_mktsegment", F.lit(" LAW")).alias("term"), none, F.lit("").alias("text")).distinct())
    return rank.rank_terms(t("customer").select(F.col("c_custkey").alias("query_id"), F.col("c_mktsegment").alias("query")), terms)


@query(
    "k4_rerank",
    """WITH s AS (SELECT h.*, CASE WHEN query_id = 'en' AND id % 17 = 3 THEN NULL ELSE id * 7 % 10 END AS relevance FROM hits h), a AS (SELECT *, bool_and(relevance IS NOT NULL) OVER (PARTITION BY query_id) AS k FROM s)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN k THEN relevance ELSE 0 END DESC, rank, id) AS new_rank FROM a""",
    "hits",
)
def _(v, t):
    hits = v("hits")
    scores = hits.filter("not (query_id = 'en' and id % 17 = 3)").select("query_id", "id", (F.col("id") * 7 % 10).cast("double").alias("relevance"))
    return rank.rerank(hits, scores).select("query_id", "id", "new_rank")


@query("k5_preferred_citation", "SELECT doc_id // 3 AS case_id, arg_min(citation, lpad(CAST((doc_id * 5) % 4 + 1 AS VARCHAR), 2, '0') || citation) AS citation FROM judgments GROUP BY 1", "judgments")
def _(v, t):
    return rank.preferred_citation(v("judgments").select(F.floor(F.col("doc_id") / 3).alias("case_id"), "citation", ((F.col("doc_id") * 5) % 4 + 1).alias("rank")))


@query("k6_page", "SELECT id, name, year, (SELECT count(*) FROM titles) AS total FROM titles ORDER BY year DESC, id OFFSET 20 LIMIT 10", "titles")
def _(v, t):
    return rank.page(v("titles").select("id", "name", "year"), [F.desc("year"), "id"], 10, 20)


@query("k7_search_then_detail", "SELECT query_id, id, rank, text, CASE WHEN text IS NULL THEN 'absent' ELSE 'found' END AS status FROM (SELECT query_id, id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank, id) AS n FROM hits) LEFT JOIN (SELECT doc_id AS id, text FROM documents WHERE doc_id % 2 = 0) USING (id) WHERE n <= 2", "hits")
def _(v, t):
    return rank.search_then_detail(v("hits"), t("documents").filter("doc_id % 2 = 0").select("doc_id", "text"))


# Set operations


@query(
    "u1_search_all",
    """WITH a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, id) AS n FROM hits WHERE source_order < 10), b AS (SELECT DISTINCT query_id FROM hits WHERE source_order >= 10)
SELECT query_id, id, 'cases' AS family, 'found' AS status FROM a WHERE n <= 3 UNION ALL SELECT query_id, NULL, 'state', 'unreachable' FROM b""",
    "hits",
)
def _(v, t):
    h = v("hits")
    return setops.search_all({"cases": h.filter("source_order < 10"), "state": h.filter("source_order >= 10")}, {"state": False}, 3).select("query_id", "id", "family", "status")


@query("u2_dedupe_hits", "SELECT query_id, id, CASE WHEN source_order < 5 THEN 'first' WHEN id % 2 = 0 THEN 'second' ELSE 'third' END AS via FROM hits", "hits")
def _(v, t):
    h = v("hits")
    return setops.dedupe_hits([("first", h.filter("source_order < 5")), ("second", h.filter("id % 2 = 0")), ("third", h)])


@query(
    "u3_fallback_ladder",
    "SELECT query_id, id, CASE query_id WHEN 'fr' THEN 'instruments' WHEN 'de' THEN 'repealed' ELSE 'full_text' END AS rung FROM hits WHERE (query_id = 'fr' AND id % 2 = 0) OR (query_id = 'de' AND id % 3 = 0) OR (query_id NOT IN ('fr', 'de') AND id % 5 = 0)",
    "hits",
)
def _(v, t):
    h = v("hits")
    rungs = [("instruments", h.filter("query_id = 'fr' and id % 2 = 0")), ("repealed", h.filter("query_id in ('fr', 'de') and id % 3 = 0")), ("full_text", h.filter("id % 5 = 0"))]
    return setops.fallback_ladder(h.select("query_id").distinct(), rungs)


@query("u4_merge_gaps", "SELECT sha256(lower(trim(lang)) || chr(31) || lower(trim(source))) AS gap_id, max(doc_id) AS seq FROM documents GROUP BY lang, source")
def _(v, t):
    return setops.merge_gaps(t("documents").select("lang", "source", F.col("doc_id").alias("seq")), "lang", "source").select("gap_id", "seq")


@query(
    "u5_version_delta",
    "WITH a AS (SELECT DISTINCT label FROM toc WHERE ord % 3 <> 0), b AS (SELECT DISTINCT label FROM toc WHERE ord % 2 = 0) SELECT label, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT label, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT label, 'retained' FROM (SELECT * FROM a INTERSECT SELECT * FROM b)",
    "toc",
)
def _(v, t):
    return setops.version_delta(v("toc").filter("ord % 3 <> 0"), v("toc").filter("ord % 2 = 0"))


_SPANS = "s AS (SELECT o_custkey AS doc_id, o_orderkey % 1000 AS \"start\", o_orderkey % 1000 + 20 AS \"end\", o_orderkey FROM orders)"


@query("u6_unread_shapes", f"WITH {_SPANS}, a AS (SELECT * FROM s WHERE o_orderkey % 2 = 0), r AS (SELECT * FROM s WHERE o_orderkey % 2 = 1) SELECT doc_id, \"start\", \"end\" FROM a WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = a.doc_id AND r.\"start\" < a.\"end\" AND a.\"start\" < r.\"end\")")
def _(v, t):
    o = F.col("o_orderkey")
    spans = t("orders").select(F.col("o_custkey").alias("doc_id"), (o % 1000).alias("start"), (o % 1000 + 20).alias("end"), "o_orderkey")
    return setops.unread_shapes(spans.filter("o_orderkey % 2 = 0").drop("o_orderkey"), spans.filter("o_orderkey % 2 = 1"))


@query("u7_domain_union", "SELECT query_id, id, CASE source_order % 2 WHEN 0 THEN 'tax' ELSE 'privacy' END AS domain, CASE source_order % 2 WHEN 0 THEN 'Tax rulings' ELSE 'Privacy decisions' END AS label, source_order % 2 = 0 AS full_text FROM hits", "hits")
def _(v, t):
    h = v("hits").select("query_id", "id", "source_order")
    return setops.domain_union({"tax": h.filter("source_order % 2 = 0"), "privacy": h.filter("source_order % 2 = 1")}, {"tax": ("Tax rulings", True), "privacy": ("Privacy decisions", False)}).drop("source_order")


# Landed files, as the texts that a reader gets


@query("s1_register_rows", "SELECT title_id, since, until, 'R' || register_id AS register_id, affect FROM versions", "versions")
def _(v, t):
    day = lambda c: F.date_format(c, "yyyy-MM-dd'T'00:00:00")
    code = F.when(F.col("affect") == "Amend", "1").otherwise(F.col("affect"))
    item = F.map_from_arrays(F.array(*map(F.lit, ("titleId", "Start", "end", "RegisterId", "affect"))), F.array(F.col("title_id").cast("string"), day("since"), day("until"), F.concat(F.lit("R"), "register_id"), code))
    files = v("versions").groupBy("title_id").agg(F.to_json(F.struct(F.collect_list(item).alias("value"))).alias("value"))
    return landed.register_rows(files.select("value")).withColumn("title_id", F.col("title_id").cast("long"))


@query("s2_toc_rows", "SELECT title_id AS file, row_number() OVER (PARTITION BY title_id ORDER BY ord) AS ord, CAST(depth AS BIGINT) AS depth, regexp_replace(label, '\\s+', ' ', 'g') AS label, 'd#' || ord AS src FROM toc".replace("\\\\", "\\"), "toc")
def _(v, t):
    entries = F.array_sort(F.collect_list(F.struct("ord", "depth", "label")))
    one = v("toc").groupBy("title_id").agg(entries.alias("e"))
    # An entry closes as many elements as the next one is less deep, and its own.
    ends = F.transform(F.sequence(F.lit(1), F.size("e")), lambda i: F.greatest(F.try_element_at("e", i)["depth"] - F.coalesce(F.try_element_at("e", i + 1)["depth"], F.lit(1)) + 1, F.lit(0)))
    piece = F.zip_with("e", ends, lambda e, n: F.concat(F.lit("<navPoint id='x'><navLabel><text>"), e["label"], F.lit('</text></navLabel><content src="d#'), e["ord"].cast("string"), F.lit('"/>'), F.repeat(F.lit("</navPoint>"), n)))
    return landed.toc_rows(one.select(F.col("title_id").alias("file"), F.concat(F.lit("<ncx>"), F.array_join(piece, ""), F.lit("</ncx>")).alias("value")))


@query("s8_treaty_rows", "SELECT 'Treaty ' || p_partkey AS title, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'A' || p_partkey END AS number, make_date(CAST(1950 + p_partkey % 50 AS INT), 2, 3) AS done_at, ['X', p_name] AS countries FROM part")
def _(v, t):
    p = F.col("p_partkey")
    item = F.struct(F.concat(F.lit("Treaty "), p).alias("Title"), F.when(p % 3 == 0, " None").otherwise(F.concat(F.lit("A"), p)).alias("AtsNumber"), F.concat(1950 + p % 50, F.lit("-02-03T00:00")).alias("DoneAtDate"), F.array(F.lit("X"), "p_name").alias("Countries"))
    files = t("part").groupBy((p % 40).alias("k")).agg(F.to_json(F.struct(F.collect_list(item).alias("results"))).alias("value"))
    return landed.treaty_rows(files.select("value"))


@query("s9_projectdata_rows", "SELECT 'i' || s_suppkey AS id, 'Title ' || s_name AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'act' END AS type, CAST(NULL AS VARCHAR) AS status FROM supplier WHERE s_suppkey % 5 <> 0")
def _(v, t):
    k = F.col("s_suppkey")
    wrapped = lambda c: F.concat(F.lit('{"__type__": "s", "__value__": "'), c, F.lit('"}'))
    item = F.concat(F.lit('{"id": '), wrapped(F.concat(F.lit("i"), k)), F.when(k % 5 != 0, F.concat(F.lit(', "title": "Title '), "s_name", F.lit('"'))).otherwise(""), F.when(k % 2 == 0, F.concat(F.lit(', "print.type": '), wrapped(F.lit("act")))).otherwise(""), F.lit("}"))
    files = t("supplier").groupBy((k % 7).alias("k")).agg(F.concat(F.lit('{"data": ['), F.array_join(F.collect_list(item), ", "), F.lit("]}")).alias("value"))
    return landed.projectdata_rows(files.select("value"))


@query("s12_write_tables", "SELECT id, name, year FROM titles", "titles")
def _(v, t):
    titles = v("titles").select("id", "name", "year")
    path = scratch_path(titles.sparkSession, "s12")
    landed.write_tables({"titles": titles}, path)
    return titles.sparkSession.read.schema(titles.schema).parquet(f"{path}/titles")


@query(
    "x25_stem_tokens",
    "SELECT id, list_transform(list_filter(string_split(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: len(x) > 1), lambda x: CASE WHEN len(x) > 5 THEN regexp_replace(x, '(ings|ing|ies|ed|es|s)$', '') ELSE x END) AS stems FROM titles",
    "titles",
)
def _(v, t):
    return v("titles").select("id", stem_tokens(F.col("name")).alias("stems"))

"""Derived views over the test tables, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Customers in titles of 100, parts of 50 and divisions of 10.
_BLOCKS = "(SELECT c_custkey, c_name, CAST(floor(c_custkey / 100.0) AS BIGINT) AS t, CAST(floor(c_custkey / 50.0) AS BIGINT) AS p, CAST(floor(c_custkey / 10.0) AS BIGINT) AS d FROM customer) c"

#: name -> SQL over the raw tables.
VIEWS: dict[str, str] = {
    "titles": """SELECT 'C' || p_partkey AS id, p_name || ' Act ' || (1950 + p_size) AS name,
  CASE p_partkey % 4 WHEN 0 THEN 'Act' WHEN 1 THEN 'LegislativeInstrument' WHEN 2 THEN 'NotifiableInstrument' ELSE 'Gazette' END AS collection,
  CASE p_partkey % 5 WHEN 0 THEN 'Repealed' ELSE 'InForce' END AS status, p_partkey % 3 <> 0 AS is_principal, 1950 + p_size AS year, p_partkey % 200 AS number FROM part""",
    "versions": """SELECT title_id, since, lead(since) OVER (PARTITION BY title_id ORDER BY since) AS until, register_id,
  CASE o_orderstatus WHEN 'O' THEN 'Amend' WHEN 'F' THEN 'AsMade' ELSE 'Repeal' END AS affect
  FROM (SELECT o_custkey AS title_id, CAST(o_orderdate AS DATE) AS since, o_orderkey AS register_id, o_orderstatus,
    row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS rn FROM orders) o WHERE rn = 1""",
    "law_events": """SELECT l_orderkey * 100 + l_linenumber AS event_id, o_custkey AS title_id, CAST(l_shipdate AS DATE) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "toc": f"""SELECT DISTINCT title_id, ord, depth, label, number FROM (
  SELECT 'T' || t AS title_id, p * 56 AS ord, 1 AS depth, 'Part ' || p || '—' || 'SCOPE OF PART ' || p AS label, CAST(NULL AS BIGINT) AS number FROM {_BLOCKS}
  UNION ALL SELECT 'T' || t, p * 56 + 1 + (d % 5) * 11, 2, 'Division ' || d || '—' || 'RULES ' || d, CAST(NULL AS BIGINT) FROM {_BLOCKS}
  UNION ALL SELECT 'T' || t, p * 56 + 2 + (d % 5) * 11 + c_custkey % 10, 3, c_custkey || ' ' || c_name, c_custkey FROM {_BLOCKS}) x""",
    "authorises": """SELECT 'S' || l_suppkey AS affecting, 'C' || l_partkey AS affected, 's ' || min(l_linenumber) AS provisions FROM lineitem GROUP BY l_suppkey, l_partkey""",
    "amendments": """SELECT DISTINCT l_suppkey AS title_id, 's ' || l_linenumber AS provision,
  CASE l_returnflag WHEN 'A' THEN 'ad' WHEN 'N' THEN 'am' ELSE 'rep' END AS effect, year(l_shipdate) AS act_year, l_partkey AS act_number FROM lineitem""",
    "judgments": """SELECT doc_id, '[' || (2000 + doc_id % 25) || '] ' || CASE doc_id % 4 WHEN 0 THEN 'HCA' WHEN 1 THEN 'NSWCA' WHEN 2 THEN 'QSC' ELSE 'VSC' END || ' ' || doc_id AS citation,
  text || ' See [' || (2000 + half % 25) || '] ' || CASE half % 4 WHEN 0 THEN 'HCA' WHEN 1 THEN 'NSWCA' WHEN 2 THEN 'QSC' ELSE 'VSC' END || ' ' || half || ' at [' || (doc_id % 9 + 1) || '].'
  || CASE doc_id % 7 WHEN 0 THEN ' It is overruled.' WHEN 1 THEN ' That case is distinguished.' ELSE '' END AS text, lang, source
  FROM (SELECT *, CAST(floor(doc_id / 2.0) AS BIGINT) AS half FROM documents) d""",
    "drafts": """SELECT doc_id, text || chr(10) || chr(10) || 'Under the Widget Act ' || (1950 + doc_id % 50) || ' (Cth) s ' || (doc_id % 40 + 1) || ', conduct is prohibited. The Act s ' || (doc_id % 30 + 1)
  || ' also applies. ss ' || (doc_id % 9 + 1) || ', ' || (doc_id % 9 + 2) || ' and ' || (doc_id % 9 + 3) || ' of the Widget Act.' AS text FROM documents""",
    "clauses_src": """SELECT doc_id, '1. ' || text || chr(10) || '2. A fee of $' || (doc_id * 10 + 5) || ' is payable within ' || (doc_id % 30 + 1) || ' days.' || chr(10) || '3. '
  || CASE doc_id % 3 WHEN 0 THEN 'We may terminate immediately.' WHEN 1 THEN 'You indemnify us for any and all claims.' ELSE 'Governed by the laws of NSW.' END AS text FROM documents""",
    "queries": """SELECT conv_id * 100 + turn AS query_id, conv_id, text || ' as at ' || (conv_id % 28 + 1) || ' March ' || (1990 + conv_id % 30) AS query FROM conversations WHERE role = 'user'""",
    "aliases": """SELECT 'T' || (p_partkey % 50) AS alias, p_name || ' Act ' || (1950 + p_size) AS official, CASE p_partkey % 3 WHEN 0 THEN 'Cth' WHEN 1 THEN 'NSW' ELSE 'Vic' END AS jurisdiction FROM part""",
    "task_events": """SELECT user_id AS matter, ts, event_id, CASE event_type WHEN 'signup' THEN 'planned' WHEN 'view' THEN 'running' WHEN 'click' THEN 'evidence_collected' WHEN 'purchase' THEN 'assessed' ELSE 'unresolved' END AS state,
  CAST(floor(value) AS INT) AS pages FROM events""",
    "hits": """SELECT lang AS query_id, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rank, CAST(substr(source, 4) AS INT) AS source_order, doc_id AS id, text AS title FROM documents""",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


#: How much larger rows are in memory than in a Parquet file, at most for the test tables: Spark sends a table to every task
#: by the size of its file, and by way of the driver.
IN_MEMORY = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A raw table."""
    spark.conf.set("spark.sql.sources.fileCompressionFactor", str(IN_MEMORY))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, planned over the raw tables that its SQL names."""
    named = re.compile(r"\b(FROM|JOIN) (" + "|".join(TABLES) + r")\b")
    sql = VIEWS[name].replace("chr(10)", "char(10)")
    used = {m[1] for m in named.findall(sql)}
    return spark.sql(named.sub(r"\1 {\2}", sql), **{t: table(spark, sf_dir, t) for t in used})


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the named views as common table expressions before it."""
    heads = [f"{n} AS ({VIEWS[n]})" for n in names]
    sql = sql.strip()
    if sql.upper().startswith("WITH "):
        return f"WITH {', '.join(heads)}, {sql[5:]}"
    return f"WITH {', '.join(heads)} {sql}"

"""Queries of the operators on structure: conversations, pages, periodic runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexframe.llm.repair import repair_conversations
from lexframe.llm.runs import periodic_runs
from lexframe.llm.wrappers import extract_text


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def damaged(conversations: DataFrame) -> DataFrame:
    """The conversations after the damage that the query does to them."""
    said = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind")).filter("kind > 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair_conversations(damaged(table)).withColumnRenamed("conv_id", "_c")
    every = table.select("conv_id").distinct()
    zeros = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    out = {x: F.coalesce(x, F.lit(0).cast("long")) for x in zeros}
    out |= {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256))}
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c").withColumns(out)


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)),
    lambda s, x: list_reduce(list_prepend(xor(s, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"""


def op11_sql() -> str:
    """The least (cost, audit) of every suffix of a conversation, from its last row back, and then the edits from the first on.

    States are 1 nothing, 2 system, 3 user, 4 assistant; h is the list of the four suffixes' (c, a), e a row or an edit.
    """
    following = {1: 3, 2: 3, 3: 4, 4: 3}
    keep = "CASE WHEN r = 's' AND {s} = 1 THEN 2 WHEN r = 'u' AND {s} <> 3 THEN 3 WHEN r = 'a' AND {s} = 3 THEN 4 ELSE 0 END"
    plus = lambda n, edit, s, h="x.h": f"{{'c': {n} + {h}[{s}].c, 'a': '{edit}' || {h}[{s}].a}}"
    stays = "CASE WHEN y.f = 3 THEN 5 ELSE 0 END"
    never = "{'c': 1000000000, 'a': ''}"
    taken = []
    for s in range(1, 5):
        to = keep.format(s=s).replace("r =", "y.r =")
        kept = f"CASE WHEN y.f IN (0, 3) AND {to} > 0 THEN {plus(stays, 'K', to)} ELSE {never} END"
        reroled = f"CASE WHEN y.f IN (0, 3) THEN {plus(f'1 + {stays}', 'R', following[s])} ELSE {never} END"
        taken.append(f"list_sort([{plus(2, 'D', s)}, {kept}, {reroled}])[1]")
    inserted = [f"list_sort([z[{s}], {plus(5, 'I', following[s], 'z')}, {plus(10, 'II', following[following[s]], 'z')}])[1]" for s in range(1, 5)]
    step = f"{{'r': '', 'f': 0, 'h': list_transform([[{', '.join(taken)}]], lambda z: [{', '.join(inserted)}])[1]}}"
    ends = "[{'c': 0, 'a': ''}, {'c': 10, 'a': 'II'}, {'c': 5, 'a': 'I'}, {'c': 0, 'a': ''}]"
    none = "CAST(NULL AS STRUCT(c INTEGER, a VARCHAR)[])"
    to = "CASE x.s WHEN 3 THEN 4 ELSE 3 END"
    name = "CASE x.s WHEN 3 THEN 'assistant' ELSE 'user' END"
    row = "q[x.i]"
    apply = f"""CASE y.e WHEN 'D' THEN {{'e': '', 'i': x.i + 1, 's': x.s, 'o': x.o}}
      WHEN 'I' THEN {{'e': '', 'i': x.i, 's': {to}, 'o': list_append(x.o, {name} || ':')}}
      WHEN 'K' THEN {{'e': '', 'i': x.i + 1, 's': CASE {row}.r WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END, 'o': list_append(x.o, {row}.role || ':' || {row}.text)}}
      ELSE {{'e': '', 'i': x.i + 1, 's': {to}, 'o': list_append(x.o, {name} || ':' || {row}.text)}} END"""
    return f"""
WITH k AS (SELECT conv_id, turn, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
d AS (SELECT *, {_CRC} % 20 AS kind FROM k),
r AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM d WHERE kind > 0),
o AS (SELECT *, md5(length(role) || ':' || role || text) AS mark, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, mark ORDER BY turn NULLS FIRST, copy) AS again, substr(role, 1, 1) AS r, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, mark, copy) AS pos FROM o),
f AS (SELECT *, CASE WHEN body = '' THEN 1 WHEN again > 1 THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS f, lag(r) OVER (PARTITION BY conv_id ORDER BY pos) AS old FROM n),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 1) AS blank, count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated,
  count(*) FILTER (old IS NOT NULL AND old || r NOT IN ('su', 'ua', 'au')) AS illegal, list({{'r': r, 'role': role, 'text': text}} ORDER BY pos) AS q, list({{'r': r, 'f': f, 'h': {none}}} ORDER BY pos DESC) AS rows FROM f GROUP BY conv_id),
s AS (SELECT *, list_reduce(list_prepend({{'r': '', 'f': 0, 'h': {ends}}}, rows), lambda x, y: {step}).h[1] AS best FROM g),
t AS (SELECT *, array_to_string(list_reduce(list_prepend({{'e': '', 'i': 1, 's': 1, 'o': CAST([] AS VARCHAR[])}}, list_transform(list_filter(string_split(best.a, ''), lambda c: c <> ''), lambda c: {{'e': c, 'i': 0, 's': 0, 'o': CAST(NULL AS VARCHAR[])}})), lambda x, y: {apply}).o, chr(10)) AS repaired FROM s)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN t ON e.conv_id IS NOT DISTINCT FROM t.conv_id
"""


def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), "n_chars")


#: The test tables' articles, read plainly: what stands between the article's tags, parted at paragraphs and headings.
OP12_SQL = r"""
WITH a AS (SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>') AS parts FROM pages),
b AS (SELECT page_id, url, list_transform(parts, lambda x: regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g')) AS parts FROM a),
c AS (SELECT page_id, url, list_transform(parts, lambda x: replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&#39;', chr(39)), '&amp;', '&')) AS parts FROM b),
d AS (SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
"""


def _rewritten(text: Column, doc_id: Column) -> Column:
    """The text, in one of ten documents with its words from a place on repeated with a period, both set by the id."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.col("words")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), again), " ")).otherwise(text)


def periodic_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text of the documents as the query of periodic runs takes them."""
    words = F.when(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    return docs.select("doc_id", "text", words.alias("words")).select("doc_id", _rewritten(F.col("text"), F.col("doc_id")).alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(periodic_documents(_table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("back"), (-x["period"]).alias("short"))))
    lines = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    every = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("top"), lines.alias("lines"), "collapsed")
    start, length, period = -F.col("top.back"), F.col("top.length"), -F.col("top.short")
    return every.select(
        "doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * top.length div -top.short").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def queries() -> dict:
    return {"op11_repair": op11_repair, "op12_html": op12_html, "op13_runs": op13_runs}


def oracle_sql() -> dict[str, str]:
    return {"op11_repair": op11_sql(), "op12_html": OP12_SQL}

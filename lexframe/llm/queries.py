"""The queries opN_<name> of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexframe.llm import structure_queries
from lexframe.llm.bpe import bpe_roundtrip
from lexframe.llm.decontam import contamination, hit_words
from lexframe.llm.quality import score_quality
from lexframe.llm.search import search
from lexframe.llm.sharding import even_tree, shard_table, with_region
from lexframe.llm.simhash import near_duplicates
from lexframe.llm.substring import remove_repeats
from lexframe.llm.token_counts import count_tokens
from lexframe.llm.urlfilter import judge_urls, url_path
from lexframe.llm.warc import header_text, page_records, resolve_revisits

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = even_tree(16)
    found = shard_table(_table(spark, sf_dir, "documents"), tree, with_region(tree, 16))
    return found.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_roundtrip(docs, public_tokenizers.path(TOKENIZER)).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path(TOKENIZER)).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(page_records(_table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return found.select("record_id", "url", "ts", "response_id", "outcome", header_text(F.col("headers")).alias("headers"))


#: The same in SQL: each page's records, the latest earlier response by a window over each url.
OP5_SQL = r"""
WITH p AS (
  SELECT page_id, md5(coalesce(html, '')) AS tag, CAST(strlen(coalesce(html, '')) AS VARCHAR) AS size, 1700000000 + page_id * 977 AS begun,
    lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host,
    regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|gclid|fbclid|ref)(=|$)'))), '&') AS query
  FROM pages
), u AS (
  SELECT *, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || query END AS url FROM p
), r AS (
  SELECT page_id * 4 AS record_id, url, begun AS ts, 1 AS late, '"' || tag || '"' AS etag, tag, size, page_id FROM u
  UNION ALL SELECT page_id * 4 + 1, url, begun + 86400, 0, 'W/"' || tag || '"', tag, size, page_id FROM u
  UNION ALL SELECT page_id * 4 + 2, url, begun + 432000, 1, '"' || tag || '-2"', tag, size, page_id FROM u WHERE page_id % 3 = 0
  UNION ALL SELECT page_id * 4 + 3, url, begun + 864000, 0, '"' || CASE WHEN page_id % 5 = 0 THEN 'gone' WHEN page_id % 3 = 0 THEN tag || '-2' ELSE tag END || '"', tag, size, page_id FROM u
), w AS (
  SELECT *, max(CASE WHEN late = 1 THEN lpad(CAST(ts AS VARCHAR), 12, '0') || lpad(CAST(record_id AS VARCHAR), 15, '0') END)
    OVER (PARTITION BY url ORDER BY ts, late, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM r
), j AS (
  SELECT w.*, b.record_id AS response_id, b.etag AS old_etag, b.size AS old_size FROM w LEFT JOIN r b ON b.record_id = CAST(substr(w.latest, 13) AS BIGINT) WHERE w.late = 0
), o AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'no_response' WHEN regexp_replace(etag, '^W/', '') = old_etag THEN 'matched' ELSE 'mismatch' END AS outcome FROM j
)
SELECT record_id, url, ts, response_id, outcome,
  CASE WHEN outcome = 'matched' AND record_id % 4 = 1 THEN 'cache-control: max-age=600' || chr(10) || 'content-length: ' || old_size || chr(10) || 'content-type: text/html' || chr(10) || 'etag: ' || etag
       WHEN outcome = 'matched' THEN 'age: 7' || chr(10) || 'cache-control: max-age=60' || chr(10) || 'content-length: ' || old_size || chr(10) || 'content-type: text/html' || chr(10) || 'etag: ' || etag
       WHEN record_id % 4 = 1 THEN 'cache-control: max-age=600' || chr(10) || 'content-length: 0' || chr(10) || 'etag: ' || etag
       ELSE 'age: 7' || chr(10) || 'etag: ' || etag END AS headers
FROM o
"""


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


def op7_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return search(docs, docs.filter("doc_id % 20 = 0"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, _table(spark, sf_dir, "labels").select("doc_id", "quality")).select("doc_id", "held_out", "score", "predicted")


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: The rules of the url query.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    # A page's path ends in the number of the document that it shows; labels judge some of these.
    number = F.try_to_number(F.nullif(F.regexp_extract(url_path(F.col("url")), r"/([0-9]{1,18})[^/]*/?$", 1), F.lit("")), F.lit("9" * 18)).cast("long")
    labels = _table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("bad"))
    labelled = pages.select("page_id", number.alias("doc_id")).join(labels, "doc_id").select("page_id", "bad")
    return judge_urls(pages, URL_RULES, labelled)


#: Levels of the SQL of op10; the operator itself has as many as the longest path.
_SQL_LEVELS = 6


def _apart_sql(l: str, b: str, ol: str, ob: str) -> str:
    """-1, 0 or 1 as urlfilter._apart() has it."""
    share = f"(({ob} + 0.5) / ({ol} + 1.0))"
    error = f"sqrt({share} * (1.0 - {share}) * (1.0 / {l} + 1.0 / ({ol} - {l})))"
    gap = f"({b} / {l} - ({ob} - {b}) / ({ol} - {l}))"
    return f"CASE WHEN {l} > 0 AND {ol} - {l} > 0 THEN CASE WHEN {gap} >= 1.96 * {error} THEN 1 WHEN {gap} <= -1.96 * {error} THEN -1 ELSE 0 END ELSE 0 END"


def op10_sql() -> str:
    """The template tree in SQL, level by level from the host down."""
    word = r"list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: regexp_replace(regexp_replace(s, '^[0-9]+($|\.)', '/<n>\1'), '^[0-9a-f-]{8,}($|\.)', '/<x>\1'))"
    parts = [
        r"u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages)",
        f"p AS (SELECT *, {word} AS form FROM u)",
        r"m AS (SELECT page_id, max(1 - quality) AS bad FROM (SELECT page_id, TRY_CAST(regexp_extract(path, '/([0-9]{1,18})[^/]*/?$', 1) AS BIGINT) AS doc_id FROM p) x JOIN labels USING (doc_id) GROUP BY page_id)",
        "f AS (SELECT host, form, form AS template, count(*) AS n, count(bad) AS labelled, CAST(coalesce(sum(bad), 0) AS BIGINT) AS bad FROM p LEFT JOIN m USING (page_id) GROUP BY host, form)",
        "w AS (SELECT (coalesce(sum(bad), 0) + 5.0 * CAST(0.1 AS DOUBLE)) / (coalesce(sum(labelled), 0) + 5.0) AS root FROM f)",
        "h AS (SELECT host, (sum(bad) + 5.0 * any_value(root)) / (sum(labelled) + 5.0) AS rate FROM f, w GROUP BY host)",
        "l0 AS (SELECT f.*, h.rate FROM f JOIN h USING (host))",
    ]
    for d in range(_SQL_LEVELS):
        side, again = _apart_sql("c.l", "c.b", "n.l", "n.b"), _apart_sql("s.l", "s.b", "t.l", "t.b")
        parts += [
            f"c{d} AS (SELECT host, template[1:{d}] AS above, template[{d + 1}] AS seg, CAST(sum(labelled) AS DOUBLE) AS l, CAST(sum(bad) AS DOUBLE) AS b, min(rate) AS over FROM l{d} WHERE len(template) > {d} GROUP BY ALL)",
            f"n{d} AS (SELECT host, above, sum(l) AS l, sum(b) AS b FROM c{d} GROUP BY ALL)",
            f"s{d} AS (SELECT c.*, {side} AS side FROM c{d} c JOIN n{d} n ON n.host = c.host AND n.above = c.above)",
            f"t{d} AS (SELECT host, above, side, sum(l) AS l, sum(b) AS b, count(*) AS k FROM s{d} GROUP BY ALL)",
            f"k{d} AS (SELECT s.host, s.above, s.seg, s.l, s.b, s.over, CASE WHEN t.k = 1 OR (s.side <> 0 AND {again} <> 0) THEN s.seg WHEN s.side = 0 THEN '/*' WHEN s.side > 0 THEN '/*+' ELSE '/*-' END AS branch FROM s{d} s JOIN t{d} t ON t.host = s.host AND t.above = s.above AND t.side = s.side)",
            f"b{d} AS (SELECT host, above, branch, (sum(b) + 5.0 * min(over)) / (sum(l) + 5.0) AS rate FROM k{d} GROUP BY ALL)",
            f"l{d + 1} AS (SELECT l.host, l.form, CASE WHEN k.branch IS NULL THEN l.template ELSE list_concat(l.template[1:{d}], [k.branch], l.template[{d + 2}:]) END AS template, l.n, l.labelled, l.bad, coalesce(b.rate, l.rate) AS rate FROM l{d} l LEFT JOIN k{d} k ON k.host = l.host AND k.above = l.template[1:{d}] AND k.seg = l.template[{d + 1}] LEFT JOIN b{d} b ON b.host = k.host AND b.above = k.above AND b.branch = k.branch)",
        ]
    fits = lambda domain, rest: f"(host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '{rest}')"
    rules = [(r, v, *r.partition("/")[::2]) for r, v in sorted(URL_RULES, key=lambda r: -len(r[0]))]
    rule = "CASE " + " ".join(f"WHEN {fits(d, '/' + rest)} THEN '{r}'" for r, _, d, rest in rules) + " END"
    says = "CASE " + " ".join(f"WHEN {fits(d, '/' + rest)} THEN '{v}'" for _, v, d, rest in rules) + " WHEN rate >= 0.5 THEN 'block' ELSE 'allow' END"
    return f"WITH {', '.join(parts)} SELECT p.page_id, p.host, p.path, {rule} AS rule, '/' || array_to_string(list_transform(template, lambda s: regexp_replace(s, '^/', '')), '/') AS template, rate AS bad_rate, {says} AS verdict FROM p JOIN l{_SQL_LEVELS} USING (host, form)"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_simhash": op1_simhash, "op2_sharding": op2_sharding, "op3_bpe": op3_bpe, "op4_token_counts": op4_token_counts, "op5_warc": op5_warc, "op6_decontamination": op6_decontamination, "op7_search": op7_search, "op8_quality": op8_quality, "op9_substring": op9_substring, "op10_url_filter": op10_url_filter} | structure_queries.queries()


_DOC_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Occurrences as a join of word windows.
OP6_SQL = f"""
WITH i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_DOC_WORDS} AS w FROM benchmark),
n AS (SELECT item, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0),
pattern AS (SELECT DISTINCT item, m, array_to_string(w[p : p + m - 1], ' ') AS body FROM n),
d AS (SELECT doc_id, {_DOC_WORDS} AS w FROM documents),
m AS (SELECT DISTINCT m FROM pattern),
s AS (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS p FROM d, m WHERE len(w) >= m),
o AS (SELECT doc_id, p, m, array_to_string(w[p : p + m - 1], ' ') AS body FROM s),
hit AS (SELECT o.doc_id, o.p, o.m, pattern.item FROM o JOIN pattern ON o.m = pattern.m AND o.body = pattern.body),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: BM25 as a join of postings.
OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_DOC_WORDS} AS w FROM documents),
t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY doc_id, term),
n AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS mean FROM d),
f AS (SELECT term, ln(1 + (max(n.n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM t, n GROUP BY term),
s AS (SELECT q.doc_id AS query_id, t.doc_id, round(sum(q.tf * f.idf * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * len(d.w) / n.mean))), 6) AS score
  FROM t q JOIN f USING (term) JOIN t ON t.term = q.term JOIN d ON d.doc_id = t.doc_id, n WHERE q.doc_id % 20 = 0 GROUP BY q.doc_id, t.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""

_SPACE_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Windows of 35 words, counted.
OP9_SQL = f"""
WITH d AS (SELECT doc_id, {_SPACE_WORDS} AS w FROM documents),
s AS (SELECT doc_id, p, md5(array_to_string(w[p : p + 34], ' ')) AS body FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
many AS (SELECT body FROM s GROUP BY body HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(p, p + 35)) AS q FROM s JOIN many USING (body))),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d WHERE len(w) > 0),
kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.q) AS body FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.q = g.q WHERE g.q IS NULL GROUP BY e.doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.body, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_warc": OP5_SQL, "op6_decontamination": OP6_SQL, "op7_search": OP7_SQL, "op9_substring": OP9_SQL, "op10_url_filter": op10_sql()} | structure_queries.oracle_sql()

"""Landed pages and files: readers, HTML to text, links, listings, audits, and the Parquet sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Numeric enums of the register.
AFFECTS = ("AsMade", "Amend", "Repeal", "Cease", "ChangeDate", "Disallow")


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """S1. The rows of register files, see register_rows()."""
    return register_rows(spark.read.text(path, wholetext=True))


def register_rows(texts: DataFrame) -> DataFrame:
    """S1. title_id, since, until, register_id, affect from JSON envelopes {value: [...]}, one in each value of texts.

    Keys in camel or Pascal case are one; affect comes as a number or a name. The rows are read as maps, so that a
    session's case sensitivity doesn't matter.
    """
    items = F.from_json(F.get_json_object("value", "$.value"), "array<map<string,string>>")
    rows = texts.select(F.explode(items).alias("m")).select(F.transform_keys("m", lambda k, _: F.lower(k)).alias("m"))
    named = F.col("m")["affect"]
    affect = F.coalesce(*(F.when(named == str(i), F.lit(n)) for i, n in enumerate(AFFECTS)), named)
    day = lambda k: F.try_to_date(F.substring(F.col("m")[k], 1, 10), "yyyy-MM-dd")
    return rows.select(F.col("m")["titleid"].alias("title_id"), day("start").alias("since"), day("end").alias("until"), F.col("m")["registerid"].alias("register_id"), affect.alias("affect"))


def read_toc(spark: SparkSession, path: str) -> DataFrame:
    """S2. The entries of table-of-contents files, see toc_rows()."""
    return toc_rows(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value"))


def toc_rows(text: DataFrame) -> DataFrame:
    """S2. file, ord, depth, label, src from table-of-contents XML (file, value): a row for each navPoint, in document order."""
    tokens = F.regexp_extract_all("value", F.lit(r"(<navPoint\b|</navPoint>|<text>[^<]*</text>|<content [^>]*>)"), F.lit(1))
    rows = text.select("file", F.posexplode(tokens).alias("n", "t"))
    sofar = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("t") == "<navPoint", 1).when(F.col("t") == "</navPoint>", -1).otherwise(0)
    rows = rows.withColumns({"depth": F.sum(step).over(sofar), "ord": F.count_if(F.col("t") == "<navPoint").over(sofar)}).filter("ord > 0 and t <> '</navPoint>'")
    label = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("t", "^<text>(.*)</text>$", 1), " ", " "), r"\s+", " "))
    first = lambda c: F.first(F.when(c != "", c), ignorenulls=True)
    return rows.groupBy("file", "ord").agg(F.max(F.when(F.col("t") == "<navPoint", F.col("depth"))).alias("depth"), first(label).alias("label"), first(F.regexp_extract("t", r'src="([^"]*)"', 1)).alias("src"))


#: Named entities.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "hellip": "…", "bull": "•", "middot": "·", "eacute": "é", "uuml": "ü", "ouml": "ö"}
#: Tags that end a line of text; cells of a coversheet stand on lines of their own.
BLOCKS = ("p", "div", "br", "tr", "td", "th", "li", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table", "thead", "tbody", "ul", "ol", "dl", "dt", "dd", "blockquote", "hr", "header", "footer", "title", "head", "body")
_ENTITY = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]{2,10});"


def decode_entities(text: Column) -> Column:
    """Named (ENTITIES), decimal and hexadecimal entities as characters, each once; what is none stays as it is."""
    names = F.create_map(*(F.lit(x) for pair in ENTITIES.items() for x in pair))

    def read(e: Column) -> Column:
        body = F.substr(e, F.lit(2), F.length(e) - 2)
        code = F.when(body.rlike("^#[xX]"), F.conv(F.substr(body, F.lit(3), F.lit(6)), 16, 10)).when(body.startswith("#"), F.substr(body, F.lit(2), F.lit(7))).try_cast("int")
        fine = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
        letter = F.decode(F.unhex(F.lpad(F.hex(F.when(fine, code).otherwise(32)), 8, "0")), "UTF-32")
        return F.coalesce(F.when(fine, letter), F.when(~body.startswith("#"), F.try_element_at(names, F.lower(body))), e)

    found = F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0))
    gaps = F.split(text, _ENTITY, -1)
    joined = F.array_join(F.zip_with(gaps, F.concat(F.transform(found, read), F.array(F.lit(""))), lambda gap, e: F.concat(gap, e)), "")
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def html_to_text(html: Column) -> Column:
    """S3. The text of a page: scripts, styles and comments dropped, block tags as line ends, entities decoded, spaces collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, rf"(?i)<\s*/?(?:{'|'.join(BLOCKS)})\b[^>]*>", "\n")
    out = decode_entities(F.regexp_replace(out, r"<[^>]*>", ""))
    lines = F.filter(F.transform(F.split(out, "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \\t\\r]+", " "))), lambda x: x != "")
    return F.array_join(lines, "\n")


#: An href in double quotes, in single ones, or without any.
_HREF = r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def extract_links(pages: DataFrame) -> DataFrame:
    """S4. page_id, n, href, anchor, absolute: the links of each page in order, resolved against the page's url."""
    raw = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(rf"(?is)<a\b[^>]*?{_HREF}[^>]*>.*?</a\s*>"), F.lit(0))).alias("n", "a"))
    href = F.concat(*(F.regexp_extract("a", rf"(?is)^<a\b[^>]*?{_HREF}", i) for i in (1, 2, 3)))
    site = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    base = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^?#]*/)", 1)
    whole = F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract("url", "^([^:]*:)", 1), href)).when(href.startswith("/"), F.concat(site, href)).when(href.startswith("#"), F.concat(F.regexp_replace("url", "#.*$", ""), href)).otherwise(F.concat(base, href))
    return raw.select("page_id", "n", href.alias("href"), F.trim(F.regexp_replace(F.regexp_replace("a", r"(?s)<[^>]*>", ""), r"\s+", " ")).alias("anchor"), whole.alias("absolute"))


#: A pattern that never matches, for what a kind of listing doesn't have.
NONE = r"(?!)()"


def _listing(source: str, start: str, link: str, title: str, date: str = NONE, *, citation: str = NONE, extra: str = NONE, total: str = NONE, trust: str = "rows", once: bool = False) -> tuple:
    """A recipe whose entries go from one start tag to the next, and whose id is in a link or in the start tag."""
    fields = (rf"(?is){p}" for p in (link, title, date, citation, extra, total))
    return source, rf"(?is){start}.*?(?={start}|</main>|</body>|$)", *fields, trust, once


_DAY = r"[0-9]{1,2} [A-Z][a-z]+ [0-9]{4}"
_SHOWN = r"displaying\b[^<]{0,40}?\bof\s+([0-9,]+)"
#: Listing recipes by kind of source: how an entry begins, where it has its id, title, date, citation and extra, where the
#: page prints a total, whether that can be trusted (see listing_totals), and whether an id counts once only. The sites' markup.
RECIPES = (
    _listing("row_divs", r'<div[^>]*class="[^"]*\brow\b[^"]*\bresult\b[^"]*"[^>]*>', r'href="/decision/([0-9a-f]{16,32})"', r'<a\b[^>]*href="/decision/[^"]*"[^>]*>(.*?)</a>', r"decision date:?\s*(?:<[^>]*>\s*)*([0-9]{1,2} \w+ [0-9]{4})", total=_SHOWN, trust="below_cap"),
    _listing("field_rows", r'<div[^>]*class="[^"]*\bviews-row\b[^"]*"[^>]*>', r'href="[^"]*/([^"/?#]+)"', r'class="[^"]*field--title[^"]*"[^>]*>(.*?)</div>', r'class="[^"]*date[^"]*"[^>]*>(?:\s*<strong\b[^>]*>.*?</strong>)?(.*?)</div>', total=_SHOWN, trust="printed"),
    _listing("list_items", r"<li\b[^>]*>", r'href="/case/id/([0-9]+)"', r'<span[^>]*class="[^"]*caseName[^"]*"[^>]*>(.*?)</span>', r'<span[^>]*class="[^"]*date[^"]*"[^>]*>(.*?)</span>', total=r'class="[^"]*\b(?:tagline|count)\b[^"]*"[^>]*>[^<0-9]*([0-9,]+)', trust="agreeing"),
    _listing("table_rows", r"<tr\b[^>]*>", r'href="[^"]*/([^"/?#]+)"', r"<a\b[^>]*>(.*?)</a>", r'<td[^>]*headers="[^"]*date[^"]*"[^>]*>(.*?)</td>', citation=r'<td[^>]*headers="[^"]*reference-number[^"]*"[^>]*>(.*?)</td>'),
    _listing("link_list", r'<a\b[^>]*href="/en/Legislation/[^"]*"[^>]*>', r'href="/en/Legislation/([^"/?#]+)"', r"<a\b[^>]*>(.*?)</a>", once=True),
    _listing("chip_rows", r'<div[^>]*class="[^"]*\bfaceted-search-item\b[^"]*"[^>]*>', r'href="[^"]*/document-view/[^"/]+/([^"?#]+)', r'<a\b[^>]*href="[^"]*/document-view/[^"]*"[^>]*>(.*?)</a>', rf'class="[^"]*\bfwc-chip\b[^"]*"[^>]*>\s*(?-i:({_DAY}))', citation=r"(\[[0-9]{4}\]\s+FWC[A-Z]*\s+[0-9]+)[^<]*</a>", extra=r'class="[^"]*\bsearch-excerpt\b[^"]*"[^>]*>(.*?)</div>', total=r"\bof\s+([0-9,]+)\s+results", trust="never"),
    _listing("ordered_list", r"<li\b[^>]*>", r'href="[^"]*[?&;]docid=([^"&;#]+)', r'class="[^"]*\bresultTitle\b[^"]*"[^>]*>.*?<a\b[^>]*>(.*?)</a>', extra=r'class="[^"]*\bsummary\b[^"]*"[^>]*>(.*?)</div>', total=r'<ol\b[^>]*\btotal="([0-9,]+)"', trust="printed"),
    _listing("heading_index", r'<h2\b[^>]*\bid="[^"]+"[^>]*>', r'<h2\b[^>]*\bid="([^"]+)"', r"<h2\b[^>]*>(.*?)</h2>", extra=r"</h2>(.*)$"),
    _listing("case_studies", r'<div[^>]*class="[^"]*\bviews-row\b[^"]*"[^>]*>', r'href="/case-summaries/([^"/?#]+)"', r'<a\b[^>]*href="/case-summaries/[^"]*"[^>]*>(.*?)</a>', extra=r'class="[^"]*\bfield__item\b[^"]*"[^>]*>(.*?)</div>', total=r"([0-9,]+)\s*result\(s\)\s*found", trust="printed"),
    _listing("letter_table", r"<tr\b[^>]*>", r'href="[^"]*\b(law_[a-z][0-9]+)\.html"', r'<a\b[^>]*href="[^"]*\blaw_[a-z][0-9]+\.html"[^>]*>(.*?)</a>', citation=r"</td>\s*<td\b[^>]*>(.*?)</td>", extra=r'href="[^"]*\bquery=(mrdoc_[0-9]+)\.html?\b'),
)
RECIPE_SCHEMA = "source string, block string, id string, title string, date string, citation string, extra string, total string, trust string, once boolean"


def listing_recipes(spark: SparkSession) -> DataFrame:
    """RECIPES as a table for parse_listing() and listing_totals()."""
    return spark.createDataFrame(list(RECIPES), RECIPE_SCHEMA)


def _plain(html: Column) -> Column:
    """The text of a piece of markup, null for none."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " ")), F.lit(""))


#: Recipes up to so many bytes go to every task, so that pages stay where they are; there are few sources, and all pages of one would go to one task.
RECIPE_BYTES = 8 << 20


def _sent(recipes: DataFrame) -> DataFrame:
    """Recipes, sent to all tasks if they are small by their own text."""
    size = recipes.agg(F.sum(sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in recipes.columns), F.lit(16)))).first()[0] or 0
    return F.broadcast(recipes) if size <= RECIPE_BYTES else recipes


def parse_listing(pages: DataFrame, recipes: DataFrame) -> DataFrame:
    """S5. page_id, source, rank, id, title, date: the entries of result lists, by the recipe of each page's source.

    With recipes that have them also citation and extra (an excerpt, a tag or a second id); where `once` is set the
    first entry of an id counts.

    recipes: source, block, id, title, date (regular expressions, group 1), see RECIPES; a small table, that is
    broadcast up to RECIPE_BYTES. Entries without an id don't count.
    """
    held = pages.join(_sent(recipes), "source")
    names = [c for c in ("id", "title", "date", "citation", "extra") if c in recipes.columns]
    once = F.col("once") if "once" in recipes.columns else F.lit(False)
    blocks = held.select("page_id", "source", once.alias("once"), F.posexplode(F.expr("regexp_extract_all(html, block, 0)")).alias("n", "b"), *names)
    strip = {c: F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.expr(f"regexp_extract(b, {c}, 1)"), "<[^>]*>", ""), r"\s+", " ")), F.lit("")) for c in names[:3]}
    got = strip | {c: _plain(F.expr(f"regexp_extract(b, {c}, 1)")) for c in names[3:]}
    rows = blocks.select("page_id", "source", "once", "n", *(v.alias(k) for k, v in got.items())).filter("id is not null")
    if "once" in recipes.columns:
        rows = rows.withColumn("_f", F.min("n").over(Window.partitionBy("page_id", "id"))).filter("not once or n = _f").drop("_f")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy("n"))).drop("n", "once")


def listing_totals(pages: DataFrame, recipes: DataFrame, *, cap: int = 10_000) -> DataFrame:
    """S5. page_id, source, n_rows, total, unreliable: how many results a list page says it has, by its recipe's trust.

    'printed': the printed total; 'below_cap': that, not to be trusted from `cap` on; 'agreeing': the same, nor where two
    printed totals differ; 'never': the entries of the page, not to be trusted if a total is printed; 'rows': the
    entries. Where nothing is printed the entries are the total.
    """
    counted = parse_listing(pages, recipes).groupBy("page_id").agg(F.count("*").alias("n_rows"))
    held = pages.join(_sent(recipes.select("source", "total", "trust")), "source")
    found = F.transform(F.expr("regexp_extract_all(html, total, 1)"), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("long"))
    shown = held.select("page_id", "source", "trust", F.array_distinct(F.array_compact(found)).alias("_all")).withColumn("_t", F.get("_all", F.lit(0)))
    out = shown.join(counted, "page_id", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0).cast("long")))
    rows_count = F.col("trust").isin("rows", "never") | F.col("_t").isNull()
    over = F.col("trust").isin("below_cap", "agreeing") & (F.col("_t") >= cap)
    doubt = over | ((F.col("trust") == "agreeing") & (F.size("_all") > 1)) | ((F.col("trust") == "never") & F.col("_t").isNotNull())
    return out.select("page_id", "source", "n_rows", F.when(rows_count, F.col("n_rows")).otherwise(F.col("_t")).alias("total"), F.coalesce(doubt, F.lit(False)).alias("unreliable"))


#: Where decision pages have their body and the rows and labels of their coversheet, by source; pages of no source are read as a whole.
DECISIONS = (
    ("row_divs", r'(?is)<div[^>]*class="[^"]*\bjudgment\b[^"]*"[^>]*>(.*)', r"(?is)<tr\b[^>]*>(.*?)</tr>", r"(?is)<td\b[^>]*>\s*(.*?):\s*</td>", r"(?is)</td>\s*<td\b[^>]*>(.*?)</td>"),
    ("field_rows", r'(?is)<main\b[^>]*>(.*)</main>', r'(?is)<div[^>]*class="[^"]*\bfield\b[^"]*"[^>]*>(.*?)</div>', r"(?is)<strong\b[^>]*>(.*?):?\s*</strong>", r"(?is)</strong>(.*)"),
)


def decision_recipes(spark: SparkSession) -> DataFrame:
    """DECISIONS as a table for parse_decision()."""
    return spark.createDataFrame(list(DECISIONS), "source string, body string, row string, label string, value string")


def parse_decision(pages: DataFrame, recipes: DataFrame | None = None) -> DataFrame:
    """S6. page_id, title, metadata (map of coversheet labels), text, downloads (array of links), body_status (full or empty).

    recipes (see DECISIONS) say by a page's source where the body and the labelled rows are. Without a recipe labels are
    dt, th and meta names with the dd, td and content behind them, and the body is the page without its head. Of a
    repeated label the first value counts.
    """
    strip = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", ""), r"\s+", " "))
    if recipes is None:
        held = pages.withColumns({c: F.lit(None).cast("string") for c in ("_body", "_row", "_label", "_value")})
    else:
        held = pages.join(_sent(recipes.select("source", *(F.col(c).alias(f"_{c}") for c in ("body", "row", "label", "value")))), "source", "left")
    names = F.regexp_extract_all("html", F.lit(r'(?is)<(?:dt|th|meta name=")[^>]*?>?\s*([^<">]+)'), F.lit(1))
    values = F.regexp_extract_all("html", F.lit(r'(?is)(?:<dd[^>]*>|<td[^>]*>|content=")\s*([^<">]*)'), F.lit(1))
    n = F.least(F.size(names), F.size(values))
    plain = F.arrays_zip(F.slice(F.transform(names, strip), F.lit(1), n).alias("k"), F.slice(F.transform(values, strip), F.lit(1), n).alias("v"))
    body = F.coalesce(F.nullif(F.expr("regexp_extract(html, _body, 1)"), F.lit("")), F.regexp_replace("html", r"(?is)<head\b.*?</head>", ""))
    rows = F.expr("regexp_extract_all(html, _row, 0)")
    labelled = F.filter(F.transform(rows, lambda r: F.struct(strip(F.try_element_at(F.regexp_extract_all(r, F.col("_label"), F.lit(1)), F.lit(1))).alias("k"), strip(F.try_element_at(F.regexp_extract_all(r, F.col("_value"), F.lit(1)), F.lit(1))).alias("v"))), lambda e: F.coalesce(e["k"] != "", F.lit(False)))
    held = held.withColumns({"_entries": F.when(F.col("_row").isNull(), plain).otherwise(labelled), "_text": html_to_text(body)})
    keys = F.array_distinct(F.transform("_entries", lambda e: e["k"]))
    metadata = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter("_entries", lambda e: e["k"] == k), 1)["v"]))
    downloads = F.array_distinct(F.regexp_extract_all("html", F.lit(r'(?i)href="([^"]+[.](?:pdf|docx?|rtf))"'), F.lit(1)))
    title = F.trim(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1))
    return held.select("page_id", title.alias("title"), metadata.alias("metadata"), F.col("_text").alias("text"), downloads.alias("downloads"), F.when(F.col("_text") == "", "empty").otherwise("full").alias("body_status"))


def parse_glossary(pages: DataFrame) -> DataFrame:
    """S7. term, definition from <dt>/<dd> pairs; several headwords split at , or / if each is short; the first page's wins."""
    clean = F.regexp_replace("html", r"(?s)<!--.*?-->", "")
    strip = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", ""), r"\s+", " "))
    dt = F.transform(F.regexp_extract_all(clean, F.lit(r"(?is)<dt[^>]*>(.*?)</dt>"), F.lit(1)), strip)
    dd = F.transform(F.regexp_extract_all(clean, F.lit(r"(?is)<dd[^>]*>(.*?)</dd>"), F.lit(1)), strip)
    rows = pages.select("page_id", F.posexplode(F.arrays_zip(dt.alias("t"), dd.alias("d"))).alias("n", "e")).filter("e.t is not null and e.d is not null")
    parts = F.transform(F.split("e.t", r"[,/]"), lambda x: F.trim(x))
    fine = F.forall(parts, lambda x: (F.length(x) > 1) & (F.size(F.split(x, " ")) <= 3))
    terms = rows.select("page_id", "n", F.explode(F.when(fine, parts).otherwise(F.array("e.t"))).alias("term"), F.col("e.d").alias("definition"))
    return terms.groupBy(F.lower("term").alias("key")).agg(F.min_by(F.struct("term", "definition"), F.struct("page_id", "n")).alias("x")).select("x.*")


def read_treaties(spark: SparkSession, path: str) -> DataFrame:
    """S8. The rows of treaty files, see treaty_rows()."""
    return treaty_rows(spark.read.text(path, wholetext=True))


def treaty_rows(texts: DataFrame) -> DataFrame:
    """S8. title, number, done_at, countries from treaty JSON, one in each value of texts; 'none' is null."""
    raw = texts.select(F.from_json("value", "results array<struct<Title:string,AtsNumber:string,DoneAtDate:string,Countries:array<string>>>")["results"].alias("results"))
    known = lambda c: F.when(F.lower(F.trim(c)) != "none", F.trim(c))
    return raw.select(F.explode("results").alias("r")).select(known(F.col("r.Title")).alias("title"), known(F.col("r.AtsNumber")).alias("number"), F.try_to_date(F.substring("r.DoneAtDate", 1, 10), "yyyy-MM-dd").alias("done_at"), F.coalesce("r.Countries", F.array().cast("array<string>")).alias("countries"))


def read_projectdata(spark: SparkSession, path: str) -> DataFrame:
    """S9. The rows of project-data files, see projectdata_rows()."""
    return projectdata_rows(spark.read.text(path, wholetext=True))


def projectdata_rows(texts: DataFrame) -> DataFrame:
    """S9. id, title, type, status from JSON whose scalars are wrapped as {__type__, __value__}; rows without id or title go."""
    raw = texts.select(F.explode(F.expr("cast(variant_get(parse_json(value), '$.data') as array<variant>)")).alias("v"))
    got = lambda k: F.coalesce(F.expr(f"try_variant_get(v, '$[\"{k}\"].__value__', 'string')"), F.expr(f"try_variant_get(v, '$[\"{k}\"]', 'string')"))
    return raw.select(got("id").alias("id"), got("title").alias("title"), got("print.type").alias("type"), got("status").alias("status")).filter("id is not null and title is not null")


def landing_audit(pages: DataFrame, landmarks: tuple[str, ...]) -> DataFrame:
    """S10. page_id, status: blank, html_missing, landmark_missing or ok, so that a bad page is never 'no rows'."""
    html = F.coalesce("html", F.lit(""))
    missing = F.lit(False)
    for mark in landmarks:
        missing = missing | ~html.contains(mark)
    status = F.when(F.trim(html) == "", "blank").when(~F.lower(html).contains("<html"), "html_missing").when(missing, "landmark_missing").otherwise("ok")
    return pages.select("page_id", status.alias("status"))


def displayed_total(text: Column, cap: int = 10_000) -> tuple[Column, Column]:
    """S11. (total, unreliable) of 'Displaying 1 - 20 of 10,000'; a total at the cap can't be trusted."""
    total = F.regexp_replace(F.regexp_extract(text, r"(?i)displaying .{0,40}? of ([0-9,]+)", 1), ",", "").try_cast("long")
    return total, F.coalesce(total >= cap, F.lit(True))


def write_tables(tables: dict[str, DataFrame], path: str, partition_by: tuple[str, ...] = ("jurisdiction", "year")) -> None:
    """S12. Each table as Parquet below path, partitioned by those of the columns that it has.

    The rows are rebalanced by these columns: Spark makes files of its advisory size, and splits a partition with many
    rows over several tasks.
    """
    for name, df in tables.items():
        keys = [c for c in partition_by if c in df.columns]
        out = df.hint("rebalance", *keys) if keys else df
        out.write.mode("overwrite").partitionBy(*keys).parquet(f"{path.rstrip('/')}/{name}")

"""Web archives: revisit records (304 Not Modified) resolved to the latest earlier full response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers of a stored response that a 304 must not replace (they describe a body or a connection).
KEPT_HEADERS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
#: Query parameters that don't name another page.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|ref)(=|$)"


def canonical_url(url: Column) -> Column:
    """One form for the urls of a page; null stays null.

    Scheme and host lower-cased, default ports, user info, fragment and tracking parameters dropped, the other
    parameters sorted, no slash at the end of a path (but '/' for none). What has no :// stays as it is.
    """
    pattern = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    part = [F.regexp_extract(url, pattern, i) for i in range(5)]
    scheme, host = F.lower(part[1]), F.lower(part[2])
    host = F.when(scheme == "http", F.regexp_replace(host, r":80$", "")).when(scheme == "https", F.regexp_replace(host, r":443$", "")).otherwise(host)
    path = F.regexp_replace(part[3], r"/+$", "")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    query = F.array_join(F.array_sort(F.filter(F.split(part[4], "&"), lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    whole = F.concat(scheme, F.lit("://"), host, path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when(part[0] == "", url).otherwise(whole)


def http_status(block: Column) -> Column:
    """The status (int) of an HTTP header block; null without one."""
    return F.regexp_extract(block, r"^HTTP/[0-9.]+ ([0-9]{3})", 1).try_cast("int")


def http_headers(block: Column) -> Column:
    """The fields of an HTTP header block as a map; names lower-cased, values of a repeated name joined by ', '."""
    lines = F.filter(F.split(block, "\r?\n"), lambda x: x.rlike(r"^[^:\s]+:"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.substring_index(x, ":", 1)).alias("name"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["name"]))
    values = F.transform(names, lambda n: F.array_join(F.transform(F.filter(pairs, lambda p: p["name"] == n), lambda p: p["value"]), ", "))
    return F.map_from_arrays(names, values)


def merge_headers(stored: Column, fresh: Column) -> Column:
    """The stored response's headers, replaced or extended by those of a 304 as far as these may."""
    allowed = F.map_filter(fresh, lambda k, _: ~k.isin(*KEPT_HEADERS))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.map_contains_key(allowed, k)), allowed)


def _strong(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve_revisits(records: DataFrame, *, bucket_seconds: int = 86_400) -> DataFrame:
    """record_id, url, ts, response_id, outcome, headers for every revisit record.

    records: record_id, url, ts (long, seconds), kind ('response' or 'revisit'), block (HTTP header
    block). A full response has kind response and status 200. A revisit goes to the latest
    full response of the same canonical url with a smaller ts (of several at a time, that with the greatest
    record_id). outcome: no_response without one (or with a null url or ts), mismatch if a validator that both have
    differs (entity tags without weakness, else last-modified), matched if one agrees, unchecked if they have none in
    common. headers: merged if matched or unchecked, else the revisit's own. Repeated revisits come out
    each; other columns, bodies included, are not read: response_id leads to the body.

    The join is one of windows, not of pairs: inside a url's time bucket the last response so far, and from
    earlier buckets the last one of each. So a url with very many records is dealt by time.
    """
    order = ["ts", "late", "record_id"]
    rows = records.select("record_id", canonical_url(F.col("url")).alias("url"), F.col("ts").cast("long").alias("ts"), "kind", http_status(F.col("block")).alias("status"), http_headers(F.col("block")).alias("headers"))
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    rows = rows.filter(full | (F.col("kind") == "revisit")).withColumns(
        {
            "bucket": F.floor(F.col("ts") / bucket_seconds),
            "late": F.when(F.col("kind") == "revisit", 0).otherwise(1),  # at the same time a response isn't earlier
            "response": F.when(full, F.struct(F.col("record_id").alias("response_id"), F.col("headers").alias("stored"))),
        }
    )
    # A record without a url or a time is in no order: it stays out of the windows, where all such would meet.
    placed = F.col("url").isNotNull() & F.col("ts").isNotNull()
    adrift = rows.filter(~placed & (F.col("kind") == "revisit")).withColumn("found", F.lit(None).cast(rows.schema["response"].dataType))
    rows = rows.filter(placed)
    inside = Window.partitionBy("url", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("near", F.last("response", ignorenulls=True).over(inside))
    lasts = rows.filter("response is not null").groupBy("url", "bucket").agg(F.max_by("response", F.struct("ts", "record_id")).alias("last"))
    buckets = rows.select("url", "bucket").distinct().join(lasts, ["url", "bucket"], "left")
    before = Window.partitionBy("url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select("url", "bucket", F.last("last", ignorenulls=True).over(before).alias("carried")).filter("carried is not null")
    visits = rows.filter("kind = 'revisit'").join(carried, ["url", "bucket"], "left").withColumn("found", F.coalesce("near", "carried"))
    visits = visits.select(*adrift.columns).unionByName(adrift)
    own, theirs = F.col("headers"), F.col("found.stored")
    tags = _strong(own["etag"]) == _strong(theirs["etag"])
    agrees = F.coalesce(tags, own["last-modified"] == theirs["last-modified"])
    outcome = F.when(F.col("found").isNull(), "no_response").when(agrees, "matched").when(~agrees, "mismatch").otherwise("unchecked")
    merged = F.when(outcome.isin("matched", "unchecked"), merge_headers(theirs, own)).otherwise(own)
    return visits.select("record_id", "url", "ts", F.col("found.response_id").alias("response_id"), outcome.alias("outcome"), merged.alias("headers"))


def header_text(headers: Column) -> Column:
    """A map of headers as text, in the order of the names."""
    entries = F.array_sort(F.map_entries(headers))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def page_records(pages: DataFrame) -> DataFrame:
    """Archive records of a table page_id, url, html: a crawl that sees each page again.

    Each page has a full response, a revisit a day later and another ten days later; every third page has
    changed in between and has a second response before the last revisit. The server's tags are weak in
    the first revisit, and the last revisit of every fifth page has a tag of a copy that was never stored.
    """
    at = F.lit(1_700_000_000).cast("long") + F.col("page_id") * 977
    tag = F.md5(F.coalesce("html", F.lit("")))

    def block(status: str, *fields: Column) -> Column:
        return F.concat_ws("\r\n", F.lit(f"HTTP/1.1 {status}"), *fields, F.lit(""))

    def field(name: str, *value) -> Column:
        return F.concat(F.lit(f"{name}: "), *(v if isinstance(v, Column) else F.lit(v) for v in value))

    def record(k: int, after: int, kind: str, text: Column) -> Column:
        return F.struct((F.col("page_id") * 4 + k).alias("record_id"), (at + after).alias("ts"), F.lit(kind).alias("kind"), text.alias("block"))

    day, size = 86_400, F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    changed, lost = F.col("page_id") % 3 == 0, F.col("page_id") % 5 == 0
    second = F.when(lost, F.lit("gone")).when(changed, F.concat(tag, F.lit("-2"))).otherwise(tag)
    body = (field("Content-Type", "text/html"), field("Cache-Control", "max-age=60"))
    records = F.array(
        record(0, 0, "response", block("200 OK", *body, field("Content-Length", size), field("ETag", '"', tag, '"'))),
        record(1, day, "revisit", block("304 Not Modified", field("ETag", 'W/"', tag, '"'), field("Cache-Control", "max-age=600"), field("Content-Length", "0"))),
        F.when(changed, record(2, 5 * day, "response", block("200 OK", *body, field("Content-Length", size), field("ETag", '"', tag, '-2"')))),
        record(3, 10 * day, "revisit", block("304 Not Modified", field("ETag", '"', second, '"'), field("Age", "7"))),
    )
    return pages.select("url", F.explode(F.array_compact(records)).alias("r")).select("r.record_id", "url", "r.ts", "r.kind", "r.block")

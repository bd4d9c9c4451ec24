"""Unions, differences and cascades of result sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def search_all(families: dict[str, DataFrame], coverage: dict[str, bool], limit: int) -> DataFrame:
    """U1. Tagged union of families of hits (query_id, rank, id), limit of each for a query; failed ones are marked.

    status: found, or unreachable for a family that couldn't be searched (one row with null id for it).
    """
    parts = []
    for name, hits in families.items():
        if coverage.get(name, True):
            order = Window.partitionBy("query_id").orderBy("rank", "id")
            top = hits.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit).drop("_n")
            parts.append(top.withColumns({"family": F.lit(name), "status": F.lit("found")}))
        else:
            parts.append(hits.select("query_id").distinct().withColumns({"family": F.lit(name), "status": F.lit("unreachable")}))
    return _union(parts)


def dedupe_hits(passes: list[tuple[str, DataFrame]]) -> DataFrame:
    """U2. query_id, id, via: each id once, by the first pass that found it."""
    rows = _union([p.select("query_id", "id").withColumns({"via": F.lit(name), "_p": F.lit(i)}) for i, (name, p) in enumerate(passes)])
    return rows.groupBy("query_id", "id").agg(F.min_by("via", "_p").alias("via"))


def fallback_ladder(queries: DataFrame, rungs: list[tuple[str, DataFrame]]) -> DataFrame:
    """U3. query_id, id, rung: the hits of the first rung that has any for the query."""
    left, parts = queries.select("query_id"), []
    for name, hits in rungs:
        found = hits.join(left, "query_id", "left_semi").select("query_id", "id", F.lit(name).alias("rung"))
        parts.append(found)
        left = left.join(hits.select("query_id"), "query_id", "left_anti")
    return _union(parts)


def merge_gaps(gaps: DataFrame, *identity: str) -> DataFrame:
    """U4. One row for each stable id (sha-256 of the folded identity columns), the one with the greatest seq."""
    key = F.sha2(F.concat_ws("\x1f", *(F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in identity)), 256)
    keyed = gaps.withColumn("gap_id", key)
    row = F.struct(*keyed.columns)
    return keyed.groupBy("gap_id").agg(F.max_by(row, "seq").alias("row")).select("row.*")


def version_delta(a: DataFrame, b: DataFrame, key: str = "label") -> DataFrame:
    """U5. key, change: added, removed or retained from table of contents a to b."""
    old, new = (x.select(key).distinct() for x in (a, b))
    parts = (("added", new.exceptAll(old)), ("removed", old.exceptAll(new)), ("retained", old.intersect(new)))
    return _union([x.withColumn("change", F.lit(name)) for name, x in parts])


def unread_shapes(shapes: DataFrame, read: DataFrame) -> DataFrame:
    """U6. Shapes (doc_id, start, end, ...) that no read span (doc_id, start, end) of the same document overlaps.

    A sweep over the places of a document: the spans that meet a shape are those that start before its end, less those that
    end at its start or before (empty ones meet nothing). Both are running counts over one sorted row of places; no list is made of a document.
    """
    own = F.struct(*(F.col(c) for c in shapes.columns))
    numbered = shapes.withColumn("shape", own).withColumn("n", F.monotonically_increasing_id())
    asked = numbered.select("doc_id", "shape", "n", F.explode(F.array(F.struct(F.lit("from").alias("what"), F.col("start").alias("at")), F.struct(F.lit("to").alias("what"), F.col("end").alias("at")))).alias("p"))
    spans = read.filter("start < end").select("doc_id", F.explode(F.array(F.struct(F.lit("begun").alias("what"), F.col("start").alias("at")), F.struct(F.lit("done").alias("what"), F.col("end").alias("at")))).alias("p"))
    places = asked.select("doc_id", "shape", "n", "p.*").unionByName(spans.select("doc_id", "p.*"), allowMissingColumns=True)
    turn = F.when(F.col("what") == "done", 0).when(F.col("what") == "begun", 2).otherwise(1)
    sofar = Window.partitionBy("doc_id").orderBy("at", turn).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = places.withColumns({x: F.count_if(F.col("what") == x).over(sofar) for x in ("begun", "done")}).filter("shape is not null")
    met = F.max(F.when(F.col("what") == "to", F.col("begun"))) - F.max(F.when(F.col("what") == "from", F.col("done")))
    return counted.groupBy("doc_id", "n").agg(F.first("shape").alias("shape"), met.alias("met")).filter("met = 0").select("shape.*")


def domain_union(sources: dict[str, DataFrame], domains: dict[str, tuple[str, bool]]) -> DataFrame:
    """U7. Hits of all decision domains in one table with domain, label and full_text (a capability of the domain)."""
    return _union([hits.withColumns({"domain": F.lit(d), "label": F.lit(domains[d][0]), "full_text": F.lit(domains[d][1])}) for d, hits in sources.items()])

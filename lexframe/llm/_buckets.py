"""Links between nodes that share a key, found in linear work for dense groups, without a large task for a frequent key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexframe.llm._common import HOT, Scratch, hot_join, release_shuffles
from lexframe.llm._components import components

#: One in so many nodes is looked at for frequent keys. This decides how a key's rows are dealt out, never which count.
_LOOKED_AT = 32


def _frequent(flat: DataFrame, held: Scratch) -> DataFrame:
    """The keys, HOT at most, that a large share of the nodes have."""
    part = held.written(flat.filter(F.pmod(F.xxhash64("node"), F.lit(_LOOKED_AT)) == 0).groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "key-counts")
    total = part.agg(F.sum("c")).first()[0] or 0
    return part.filter((F.col("c") > 16) & (F.col("c") * HOT > total)).select("key").limit(HOT)


def _shared(flat: DataFrame, held: Scratch) -> DataFrame:
    """node, mark, key, n: the keys that several nodes have, with the number of those nodes."""
    often = held.written(_frequent(flat, held), "frequent-keys")
    by_key = Window.partitionBy("key")
    if often.isEmpty():
        return held.written(flat.withColumn("n", F.count("*").over(by_key)).filter("n > 1"), "buckets")
    rest = flat.join(F.broadcast(often.limit(HOT)), "key", "left_anti").withColumn("n", F.count("*").over(by_key)).filter("n > 1")
    # Of frequent keys only the counts are shuffled; their rows stay in the tasks that made them.
    many = held.written(flat.join(F.broadcast(often.limit(HOT)), "key"), "frequent-buckets")
    counts = many.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    return held.written(rest.select("node", "mark", "key", "n"), "buckets").unionByName(many.join(F.broadcast(counts.limit(HOT)), "key").select("node", "mark", "key", "n"))


def linked(nodes: DataFrame, near: Callable[[str, str], Column], verify: Callable[[DataFrame], DataFrame] | None = None, measure: Callable[[DataFrame], DataFrame] | None = None, fits: Callable[[str, str], Column] | None = None) -> DataFrame:
    """id, label (the least node of the component) for the nodes that link to another one.

    nodes: node (long, each once), mark (long), keys (array of longs). Two nodes link if they share a key, near() of
    their marks' columns holds and verify() keeps the pair (a, b). All such links count, yet no group is paired with
    itself: first every node of a key is held against the key's most popular node, the one with the most company in all
    its keys, as a group of copies has its original there. That joins dense groups into components. Then, where a
    key still has several components, the nodes outside its largest one are held against all of the key.
    """
    spark = nodes.sparkSession
    held = Scratch(spark)
    flat = nodes.select("node", "mark", F.explode("keys").alias("key"))
    # What is known of a node is kept once, with its shared keys beside it, and told to these by exploding them.
    shared = _shared(flat, held).groupBy("node").agg(F.first("mark").alias("mark"), F.sum("n").alias("company"), F.collect_set("key").alias("keys"))
    shared = held.written(shared, "shared-keys")
    buckets = shared.select("node", "mark", "company", F.explode("keys").alias("key"))
    total = shared.agg(F.sum(F.size("keys"))).first()[0] or 0
    reps = buckets.groupBy("key").agg(F.max(F.struct("company", "node", "mark")).alias("rep"), F.count("*").alias("_n"))
    reps = held.written(reps.select("key", F.col("rep.node").alias("rep"), F.col("rep.mark").alias("rep_mark"), F.col("rep.company").alias("rep_company"), "_n"), "reps")
    if total > 1_000_000:
        release_shuffles(spark)
    stars = hot_join(buckets, reps, "key", total).filter((F.col("node") != F.col("rep")) & near("mark", "rep_mark"))
    stars = held.written(stars.groupBy(F.col("node").alias("a"), F.col("rep").alias("b")).agg(F.max("rep_company").alias("company")), "star-pairs")
    # A node's most popular representative first; the others only where that has left them in another component.
    best = stars.groupBy("a").agg(F.max_by("b", F.struct("company", "b")).alias("b"))
    links = held.written(best if verify is None else verify(best), "star-links")
    first = held.written(components(links, "first"), "first-labels")
    known = stars.join(first.select(F.col("id").alias("a"), F.col("label").alias("la")), "a", "left")
    ends = stars.groupBy("b").agg(F.count("*").alias("_n")).join(first.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b", "left")
    rest = hot_join(known, ends, "b", stars.count()).filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b").join(best, ["a", "b"], "left_anti")
    more = held.written(rest if verify is None else verify(rest), "more-links")
    links = held.written(links.unionByName(more), "links")
    first = components(links, "second")

    named = held.written(shared.join(first.withColumnRenamed("id", "node"), "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    labelled = named.select("node", "mark", "label", F.explode("keys").alias("key"))
    several = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("_n")).filter("lo < hi").select("key", "_n")
    left = hot_join(labelled, several, "key", total).groupBy("node").agg(F.first("mark").alias("mark"), F.first("label").alias("label"), F.sort_array(F.collect_set("key")).alias("keys"))
    left = held.written(left, "mixed")
    if measure is not None:
        left = held.written(left.join(measure(left.select("node", "label")), "node"), "measured")
    else:
        left = left.withColumn("size", F.lit(None).cast("int"))
    # A pair is made at the least of the keys that both have, and so once.
    mixed = left.select("node", "mark", "label", "size", "keys", F.explode("keys").alias("key"))
    sizes = mixed.groupBy("key", "label").agg(F.count("*").alias("c"))
    main = sizes.groupBy("key").agg(F.max(F.struct("c", "label")).alias("m"), F.sum("c").alias("_n")).select("key", F.col("m.label").alias("main"), "_n")
    others = hot_join(mixed, main, "key", total).filter("label <> main").select("key", F.col("node").alias("node2"), F.col("mark").alias("mark2"), F.col("label").alias("label2"), F.col("size").alias("size2"), F.col("keys").alias("keys2"))
    others = held.written(others, "others")
    pairs = mixed.join(others, "key").filter((F.col("label") != F.col("label2")) & near("mark", "mark2") & (F.lit(True) if fits is None else fits("size", "size2")))
    pairs = pairs.filter(F.array_min(F.array_intersect("keys", "keys2")) == F.col("key"))
    if verify is None:
        across = pairs.select(F.col("label").alias("a"), F.col("label2").alias("b")).distinct()
    else:
        tried = stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        across = verify(pairs.select(F.greatest("node", "node2").alias("a"), F.least("node", "node2").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"))
    across = held.written(across, "across-links")
    found = components(links.unionByName(across), "links")
    held.clear()
    if total > 1_000_000:
        release_shuffles(spark)
    return found

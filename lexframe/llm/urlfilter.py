"""URL filters: given rules first, then a path-template tree per host with smoothed labelled purity.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexframe.llm._common import Scratch, hot_join, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """What is between the first :// and the next / ? or #, A-Z lower-cased; '' without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ? or #; '' without ://."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) for the longest rule that fits, else nulls.

    rules: ('net/', 'block') pairs, host then path; a rule fits its host and subdomains of it where the
    path starts with the rule's. Rules are part of the plan, so this is meant for lists of up to some hundreds.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def path_form(path: Column) -> Column:
    """The path's segments, all of them, those that vary by their very form as wildcards: numbers, hex strings, with or
    without an ending. A wildcard begins with '/', which no segment of a path does, so none is spelled like one."""

    def form(s: Column) -> Column:
        s = F.regexp_replace(s, r"^[0-9]+(?=$|\.)", "/<n>")
        return F.regexp_replace(s, r"^[0-9a-f-]{8,}(?=$|\.)", "/<x>")

    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), form)


#: Names of the branches that children are merged into: like the others, worse than these, better than these. No segment has a '/'.
LIKE, WORSE, BETTER = "/*", "/*+", "/*-"


def _apart(labelled: Column, bad: Column, of_labelled: Column, of_bad: Column, z: float) -> Column:
    """-1, 0 or 1: whether a part's bad share is below, like or above that of the rest of a whole, by z standard errors.

    A part without labels, or a rest without, is like the other. At least half a label of doubt is in each error, so that a
    share of 0 or 1 of few labels is no certainty.
    """
    rest, rest_bad = of_labelled - labelled, of_bad - bad
    share = (of_bad + F.lit(0.5)) / (of_labelled + F.lit(1.0))
    error = F.sqrt(share * (F.lit(1.0) - share) * (F.lit(1.0) / labelled + F.lit(1.0) / rest))
    gap = bad / labelled - rest_bad / rest
    side = F.when(gap >= F.lit(z) * error, 1).when(gap <= F.lit(-z) * error, -1).otherwise(0)
    return F.when((labelled > 0) & (rest > 0), side).otherwise(0)


def _merged(children: DataFrame, z: float) -> DataFrame:
    """children (host, above, segment, labelled, bad) with branch: the name that a child goes on under.

    The children of a node that are like the rest of it are one branch. Those that are worse are held against each other, and
    are one branch if they are alike, as are those that are better. What differs from its own side too keeps its
    name. A child without siblings keeps it as well, as there is nothing to merge.
    """
    node = children.groupBy("host", "above").agg(F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"), F.count("*").alias("fanout"))
    sided = children.join(node, ["host", "above"]).withColumn("side", _apart(F.col("labelled"), F.col("bad"), F.col("all_labelled"), F.col("all_bad"), z))
    sides = sided.groupBy("host", "above", "side").agg(F.sum("labelled").alias("side_labelled"), F.sum("bad").alias("side_bad"), F.count("*").alias("alike"))
    again = sided.join(sides, ["host", "above", "side"])
    differs = _apart(F.col("labelled"), F.col("bad"), F.col("side_labelled"), F.col("side_bad"), z) != 0
    name = F.when(F.col("side") == 0, LIKE).when(F.col("side") > 0, WORSE).otherwise(BETTER)
    own = (F.col("alike") == 1) | ((F.col("side") != 0) & differs)
    return again.select("host", "above", "segment", "labelled", "bad", F.when(own, F.col("segment")).otherwise(name).alias("branch"))


def _smoothed(labelled: Column, bad: Column, above: Column, strength: float) -> Column:
    """A branch's bad share, pulled to the share above it by `strength` labels."""
    return (bad + F.lit(strength) * above) / (labelled + F.lit(strength))


def template_tree(urls: DataFrame, *, prior: float = 0.1, strength: float = 5.0, merge_z: float = 1.96) -> DataFrame:
    """host, form (array), template (array), n, labelled, bad, bad_rate: the leaves of the path trees.

    urls: host, path, bad (1, 0 or null for unlabelled). The urls are summed by form first, so what the levels work on
    doesn't grow with a host's pages. Level by level, as deep as the longest path, the children of each node are merged
    where their labels don't tell them apart (_merged), and each branch has its bad share, smoothed by `strength` labels
    at the share of the branch above; the host's is smoothed at that of all urls, and this one at `prior`.
    """
    held = Scratch(urls.sparkSession)
    leaves = urls.select("host", path_form(F.col("path")).alias("form"), "bad").groupBy("host", "form")
    leaves = leaves.agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    leaves = held.written(leaves.withColumn("template", F.col("form")), "url-forms")
    whole = leaves.agg(F.coalesce(F.sum("labelled"), F.lit(0)).alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.max(F.size("form")), F.lit(0)).alias("deepest")).first()
    root = (float(whole["bad"]) + strength * prior) / (float(whole["labelled"]) + strength)
    hosts = leaves.groupBy("host").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    leaves = leaves.join(hosts.select("host", _smoothed(F.col("l"), F.col("b"), F.lit(root), strength).alias("bad_rate")), "host")
    for d in range(whole["deepest"]):
        keyed = leaves.withColumns({"above": F.slice("template", 1, d), "segment": F.try_element_at("template", F.lit(d + 1))})
        children = keyed.filter("segment is not null").groupBy("host", "above", "segment").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.min("bad_rate").alias("over"))
        named = held.written(_merged(children, merge_z).join(children.select("host", "above", "segment", "over"), ["host", "above", "segment"]), "url-children")
        branches = named.groupBy("host", "above", "branch").agg(_smoothed(F.sum("labelled"), F.sum("bad"), F.min("over"), strength).alias("rate"))
        known = named.select("host", "above", "segment", "branch").join(branches, ["host", "above", "branch"])
        renamed = F.concat(F.slice("template", 1, d), F.array("branch"), F.slice("template", d + 2, whole["deepest"]))
        leaves = keyed.join(known, ["host", "above", "segment"], "left").select(
            "host", "form", F.when(F.col("branch").isNotNull(), renamed).otherwise(F.col("template")).alias("template"), "n", "labelled", "bad", F.coalesce("rate", "bad_rate").alias("bad_rate")
        )
        leaves = held.written(leaves, "url-level")
    out = written(leaves, "url-templates")
    held.clear()
    return out


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame, *, page_id: str = "page_id", url: str = "url", block_at: float = 0.5, **options) -> DataFrame:
    """page_id, host, path, rule, template, bad_rate, verdict for every page.

    labelled: (page_id, bad 1 or 0) for some pages; several labels of a page count as the worst.
    verdict: that of the longest rule that fits, else block where the smoothed bad share of the url's
    template (template_tree) reaches block_at, else allow. A null url or one without :// has an empty host and path and
    a tree of its own. Repeated pages are judged each; without labels all that no rule names is
    allowed (the prior share is below block_at). A null page_id has no label. Other columns are not read; an empty table
    gives none.
    """
    marks = labelled.groupBy(F.col(page_id).alias("page_id")).agg(F.max("bad").cast("int").alias("bad"))
    parts = pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    seen = parts.join(marks, "page_id", "left").select("host", "path", "bad")
    rates = template_tree(seen, **options).select("host", "form", "template", "bad_rate", F.col("n").alias("_n"))
    total = rates.agg(F.sum("_n")).first()[0] or 0
    # A form that very many pages have stays where its pages are; see hot_join.
    keyed = parts.withColumn("form", path_form(F.col("path"))).withColumn("leaf", F.struct("host", "form"))
    judged = hot_join(keyed, rates.select(F.struct("host", "form").alias("leaf"), "template", "bad_rate", "_n"), "leaf", total)
    rule, says = matching_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(says, F.when(F.col("bad_rate") >= block_at, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.concat(F.lit("/"), F.array_join(F.transform("template", lambda s: F.regexp_replace(s, "^/", "")), "/")).alias("template"), "bad_rate", verdict.alias("verdict"))

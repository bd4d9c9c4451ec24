"""Filters over titles, versions and hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexframe.functions.folds import fold_key


def title_search(titles: DataFrame, text: str, *, match: str = "contains", scope: tuple[str, ...] = ("name",)) -> DataFrame:
    """F1. Titles whose scope columns match a text, case aside.

    match: contains (the phrase), exact, startswith, excludes, any or all (of the words).
    """
    sought = text.lower()
    fields = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in scope]

    def hit(field: Column) -> Column:
        words = [field.contains(w) for w in sought.split()]
        return {
            "contains": lambda: field.contains(sought),
            "excludes": lambda: field.contains(sought),
            "exact": lambda: field == sought,
            "startswith": lambda: field.startswith(sought),
            "any": lambda: reduce(lambda a, b: a | b, words, F.lit(False)),
            "all": lambda: reduce(lambda a, b: a & b, words, F.lit(True)),
        }[match]()

    found = reduce(lambda a, b: a | b, map(hit, fields))
    return titles.filter(~found if match == "excludes" else found)


def facet_filter(titles: DataFrame, *, collections=(), statuses=(), year: int | None = None, year_from: int | None = None, year_to: int | None = None, combine: str = "and") -> DataFrame:
    """F2. Titles by facets, joined by 'and' or 'or'; a null year fails every year test. No facet keeps all."""
    tests = []
    if collections:
        tests.append(F.col("collection").isin(*collections))
    if statuses:
        tests.append(F.col("status").isin(*statuses))
    if year is not None:
        tests.append(F.col("year") == year)
    if year_from is not None or year_to is not None:
        tests.append(F.col("year").between(year_from if year_from is not None else -(10**6), year_to if year_to is not None else 10**6))
    if not tests:
        return titles
    return titles.filter(reduce((lambda a, b: a & b) if combine == "and" else (lambda a, b: a | b), tests))


def hit_filter(hits: DataFrame, query: str, *, fields: tuple[str, ...] = ("title", "citation", "catchwords")) -> DataFrame:
    """F3. Hits in which every query token of over one character occurs, case aside, in the joined fields."""
    joined = F.lower(F.concat_ws(" ", *fields))
    return hits.filter(reduce(lambda a, b: a & b, (joined.contains(t) for t in query.lower().split() if len(t) > 1), F.lit(True)))


def prefix_suggest(titles: DataFrame, aliases: DataFrame, partial: str, k: int = 10) -> DataFrame:
    """F4. name, is_principal of titles whose folded name starts with the folded partial, or that an alias
    or official name with that prefix stands for; principal first, then by name; k at most."""
    start = "".join(c for c in partial.lower() if c.isascii() and c.isalnum())
    key = fold_key(F.col("alias"), ascii_only=True), fold_key(F.col("official"), ascii_only=True)
    by_alias = aliases.filter(key[0].startswith(start) | key[1].startswith(start)).select(F.col("official").alias("name"))
    named = titles.select("name", "is_principal")
    found = named.filter(fold_key(F.col("name"), ascii_only=True).startswith(start)).unionByName(named.join(by_alias, "name", "left_semi"))
    return found.groupBy("name").agg(F.max("is_principal").alias("is_principal")).orderBy(F.desc("is_principal"), "name").limit(k)


def version_window_filter(versions: DataFrame, start, end) -> DataFrame:
    """F5. Versions whose window [since, until) meets start .. end; a null until is open."""
    until = F.coalesce(F.col("until"), F.lit("9999-12-31").cast("date"))
    return versions.filter((until >= F.lit(start).cast("date")) & (F.col("since") <= F.lit(end).cast("date")))


#: The shapes of query texts.
SHAPES = {
    "state_subject": r"(?i)\b(tenancy|tenancies|conveyancing|strata|local government|planning|traffic)\b",
    "instrument_words": r"(?i)\b(regulations?|rules?|determination|instrument|order|notice)\b",
    "register_id": r"(?i)\b[cf]\d{4}[a-z]\d{5}\b",
    "citation_shaped": r"\[(1[89]|20)[0-9]{2}\] ?[A-Za-z][A-Za-z0-9.]{1,15} [0-9]{1,5}",
    "product_code": r"(?i)^\s*(?:(?:TR|TD|GSTR|GSTD|PCG|LCR|CR|PR|MT|SGR|FTR|WETR|IT|PS)(?: LA)?|ATO ID) (?:19|20)[0-9]{2}/[0-9]{1,4}[A-Z]?\s*$",
    "full_text": r"(?i)\b(?:full (?:text|reasons|judge?ment|decision)|verbatim|unabridged|entire (?:text|judgment)|complete text)\b",
    "bare_term": r"^\s*[A-Za-z][A-Za-z-]*(\s+[A-Za-z][A-Za-z-]*){0,2}\s*$",
}


def looks_like(queries: DataFrame, column: str = "query") -> DataFrame:
    """F6. queries with a boolean column for each of SHAPES; null queries give false."""
    return queries.withColumns({name: F.coalesce(F.col(column).rlike(pattern), F.lit(False)) for name, pattern in SHAPES.items()})

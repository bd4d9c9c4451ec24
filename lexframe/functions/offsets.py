"""Where a pattern matches in a text, and values that are worked out once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def match_offsets(text: Column, pattern: str | Column) -> Column:
    """array<struct<pos, raw>> of all matches; pos counts characters from 0. The pattern must not match nothing."""
    found = F.lit(pattern) if isinstance(pattern, str) else pattern
    raws = F.regexp_extract_all(text, found, F.lit(0))
    gaps = F.split(text, found, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<pos:int,raw:string>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        pos = s["at"] + F.length(x["gap"])
        return F.struct((pos + F.length(x["raw"])).alias("at"), F.array_append(s["out"], F.struct(pos.alias("pos"), x["raw"].alias("raw"))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(raws)), raws, lambda g, r: F.struct(g.alias("gap"), r.alias("raw")))
    return F.aggregate(pairs, start, step, lambda s: s["out"])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, however often `use` refers to it, and code that doesn't grow with that."""
    return F.get(F.transform(F.array(value), use), F.lit(0))

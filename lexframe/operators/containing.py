"""Which texts contain which: pairs by equi-joins on the rarest run of characters, never by pairing all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _runs(text: Column, n: int) -> Column:
    """The distinct runs of n characters of a text; none if it is shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def containing(needles: DataFrame, haystacks: DataFrame) -> DataFrame:
    """needle, hay for each pair where the haystack (hay, s) contains the needle (needle, s); empty needles are in none.

    A needle is looked up by that of its runs of three characters (all of it, if shorter) that the fewest haystacks
    have; only those haystacks are held against it.
    """
    sought = needles.select("needle", F.col("s").alias("n")).filter("n <> ''")
    short = F.least(F.length("n"), F.lit(3))
    keys = F.when(short == 3, _runs(F.col("n"), 3)).otherwise(F.array("n"))
    sought = sought.select("needle", "n", F.explode(keys).alias("run"))
    runs = F.array_distinct(F.concat(*(_runs(F.col("s"), n) for n in (1, 2, 3))))
    held = haystacks.select("hay", "s", F.explode(runs).alias("run")).join(sought.select("run").distinct(), "run")
    counts = held.groupBy("run").agg(F.count("*").alias("c"))
    rarest = sought.join(counts, "run", "left").groupBy("needle", "n").agg(F.min_by("run", F.struct(F.coalesce("c", F.lit(0)), "run")).alias("run"))
    return held.join(rarest, "run").filter(F.col("s").contains(F.col("n"))).select("needle", "hay")

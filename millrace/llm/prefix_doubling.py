"""Naming of equal windows over sequences by prefix doubling, in DataFrame operations.

A position's name at length 2h comes from the pair (name at the position, name h
further on): pairs are counted, sorted and ranked, and pairs that occur once drop
out. Names keep the order of what they name: a new name is the old one plus the
number of positions of the same old name whose second name is smaller, so names stay
below the number of positions. The sums that this needs run in two steps, over
ranges of about the square root of that number, so that a name with very many
followers is never one task's work.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, group: list[str], coarse: str, fine: list[str]) -> DataFrame:
    """df with `before`: the sum of n over the rows of the group that sort earlier by (coarse, fine). coarse splits a group into ranges."""
    outer, inner = Window.partitionBy(*group).orderBy(coarse), Window.partitionBy(*group, coarse).orderBy(*fine)
    sums = df.groupBy(*group, coarse).agg(F.sum("n").alias("s"))
    sums = sums.select(*group, coarse, (F.sum("s").over(outer) - F.col("s")).alias("earlier"))
    return df.withColumn("within", F.sum("n").over(inner) - F.col("n")).join(sums, [*group, coarse]).withColumn("before", F.col("earlier") + F.col("within")).drop("earlier", "within")


def first_names(ids: DataFrame) -> DataFrame:
    """(a, b, n) with `name`: 128-bit ids (two evenly spread longs) of symbols that occur n times, ranked by id. Ranges are the 1024 values of a's first bits."""
    return running(ids.withColumn("range", F.shiftright("a", 54)).withColumn("all", F.lit(0)), ["all"], "range", ["a", "b"]).select("a", "b", "n", F.col("before").alias("name"))


def double(places: DataFrame, key: list[str], at: str, step: int, total: int) -> DataFrame:
    """places (key, at, name) at some length -> the same at that length plus step, without places whose new name is theirs alone."""
    after = places.select(*key, (F.col(at) - step).alias(at), F.col("name").alias("next"))
    pairs = places.select(*key, at, "name").join(after, [*key, at])
    width = max(1, math.isqrt(total))
    counted = pairs.groupBy("name", "next").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    ranked = running(counted.withColumn("range", F.floor(F.col("next") / width)), ["name"], "range", ["next"])
    ranked = ranked.select("name", "next", (F.col("name") + F.col("before")).alias("renamed"))
    return pairs.join(ranked, ["name", "next"]).select(*key, at, F.col("renamed").alias("name"))

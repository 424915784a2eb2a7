"""Exact order statistics of groups of any size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .skew import skew_join

ACCURACY = 10_000


def exact_rank(df: DataFrame, key: str, value: str, share: float, rank: Callable[[Column], Column], into: str) -> DataFrame:
    """(key, n, into): the value at 0-based `rank(n)`, near `share` of the n values, of every group. Nulls are left out.

    A mergeable sketch first brackets the value (a few thousandths of the ranks); then values below the bracket are only
    counted, and those inside are counted by value. No group is ever sorted as a whole.
    """
    rows = df.select(key, value).where(F.col(value).isNotNull() & F.col(key).isNotNull())
    at = [max(0.0, share - 0.002), min(1.0, share + 0.002)]
    bracket = rows.groupBy(key).agg(F.count("*").alias("n"), F.percentile_approx(value, at, ACCURACY).alias("__b"))
    bracket = bracket.select(key, "n", F.when(F.col("n") > 1_000, F.get("__b", F.lit(0))).alias("__lo"), F.when(F.col("n") > 1_000, F.get("__b", F.lit(1))).alias("__hi"), rank(F.col("n")).alias("__r"))
    met = skew_join(rows, bracket, key, value).where(F.col("__hi").isNull() | (F.col(value) <= F.col("__hi")))
    place = F.when(F.col("__lo").isNull() | (F.col(value) >= F.col("__lo")), F.col(value))
    counts = met.groupBy(key, place.alias("v")).agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("__r").alias("r"))
    upto = W.partitionBy(key).orderBy(F.asc_nulls_first("v")).rowsBetween(W.unboundedPreceding, 0)
    seen = counts.withColumn("seen", F.sum("c").over(upto)).where("seen > r and v is not null")
    return seen.groupBy(key).agg(F.first("n").alias("n"), F.min("v").alias(into))

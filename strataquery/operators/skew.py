"""Equi-joins that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

#: Keys the sketch keeps count of; what holds less than 1 / TRACKED of the rows can't be told from chance by it.
TRACKED = 4096
#: A key of this share is hot, or a smaller one of more rows than two partitions hold.
SHARE = 0.02


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _least(df: DataFrame) -> float:
    return max(1 / TRACKED, min(SHARE, 2 / _partitions(df)))


def hot_keys(df: DataFrame, key: str, share: float | None = None) -> dict:
    """Hot keys and their shares of the rows: one scan of one column with a mergeable sketch of fixed size.

    Hot is what holds `share` of the rows, by default SHARE or as much as two shuffle partitions; at most 1 / share keys do. Nulls
    are never hot. Keys below the sketch's grasp stay whole: Spark splits the partitions they make too large (AQE).
    """
    least = share or _least(df)
    k = min(TRACKED, ceil(1 / least))
    row = df.where(F.col(key).isNotNull()).agg(F.count("*").alias("n"), F.expr(f"approx_top_k(`{key}`, {k}, {TRACKED})").alias("top")).first()
    return {x["item"]: x["count"] / row["n"] for x in row["top"] or [] if x["count"] >= max(2, least * row["n"])}


def hot_counts(counts: DataFrame, key: str, n: str, share: float | None = None) -> dict:
    """hot_keys of rows that are already counted by key."""
    least = share or _least(counts)
    total = counts.agg(F.sum(n)).first()[0] or 0
    rows = counts.where(F.col(key).isNotNull() & (F.col(n) >= max(2, least * total))).select(key, n).collect()  # at most 1 / least
    return {r[0]: r[1] / total for r in rows}


def skew_join(many: DataFrame, one: DataFrame, key: str, spread: str, how: str = "inner", hot: dict | None = None) -> DataFrame:
    """Join `many` to `one` (few rows a key) on `key`; rows of hot keys are spread over tasks by `spread`.

    `how`: inner, left, left_semi or left_anti. A key of a share of all rows gets that share of the shuffle partitions, so a key of
    any size comes in parts of about the mean size. Rows of `one` are repeated only for hot keys. The result is that of the plain
    join: null keys match nothing; those that a left or anti join keeps are spread too. `hot` are the hot keys and shares
    if the caller knows them; else `many` is scanned for them first, which is cheap where it is a table and not where it is a
    long plan.
    """
    hot = hot_keys(many, key) if hot is None else hot
    keeps = how in ("left", "left_anti")
    if not hot and not keeps:
        return many.join(one, key, how)
    n = _partitions(many)
    schema = StructType([StructField(key, many.schema[key].dataType), StructField("__share", DoubleType()), StructField("__fan", IntegerType())])
    fans = F.broadcast(many.sparkSession.createDataFrame([(k, float(s), max(2, ceil(s * n))) for k, s in hot.items()], schema).drop("__share"))  # at most TRACKED rows
    salt = F.pmod(F.xxhash64(spread), F.coalesce("__fan", F.when(F.col(key).isNull(), F.lit(n)).otherwise(F.lit(1)))).cast("int")
    left = (many.join(fans, key, "left") if hot else many.withColumn("__fan", F.lit(None).cast("int"))).withColumn("__salt", salt).drop("__fan")
    right = (one.join(fans, key, "left") if hot else one.withColumn("__fan", F.lit(None).cast("int"))).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__fan", F.lit(1)) - 1))).drop("__fan")
    return left.join(right, [key, "__salt"], how).drop("__salt")

"""Row numbers without putting a group into one task, and order-free hashes of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut


def numbered(df: DataFrame, keys: list[str], order: list[str], into: str) -> DataFrame:
    """df's keys and order columns with `into`: the 0-based position of each row in its group, in order (nulls first).

    Rows are range-partitioned by keys and order, so a group of any size is spread over many partitions. Each part of a group
    is numbered by itself, and parts start where the parts before them end: only counts of parts are summed over a
    group. `order` must tell rows apart for the result to be defined. No keys: one numbering of all rows.
    """
    cols = list(dict.fromkeys([*keys, *order]))
    parts = cut(df.select(*cols).repartitionByRange(*cols).withColumn("__part", F.spark_partition_id()))
    counts = parts.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.struct(*keys).alias("__k") if keys else F.lit(0).alias("__k"), F.col("__part").alias("__p"), before.alias("__start"))
    inside = F.row_number().over(W.partitionBy("__part", *keys).orderBy(*order)) - 1
    local = parts.withColumn("__i", inside).withColumn("__k", F.struct(*keys) if keys else F.lit(0))
    joined = local.join(starts, (F.col("__part") == F.col("__p")) & local["__k"].eqNullSafe(starts["__k"]))
    return joined.select(*cols, (F.col("__start") + F.col("__i")).alias(into))


def multiset_hash(value: Column) -> Column:
    """Aggregate: a hash of a group's values and how often each occurs, whatever their order; merged like a sum, so no group is gathered."""
    h = F.sha2(value, 256)
    part = lambda i: F.sum(F.conv(F.substring(h, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    return F.sha2(F.concat_ws(",", F.count("*").cast("string"), *(part(i) for i in range(5))), 256)

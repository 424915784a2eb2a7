"""Differences between two copies of a table, located by a matrix of checksums before anything is joined."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ..session import cut, small

#: Rows a bucket is to hold in the end, and into how many parts one level of the matrix splits a bucket at most.
ROWS_A_BUCKET, SPLIT = 2_000, 1 << 16
#: Unequal buckets that are broadcast at most.
SHOWN = 1 << 18


def _hash_parts(c: Column, name: str) -> list[Column]:
    """A wide additive checksum: the two halves of a 64-bit hash, summed apart so that no sum can overflow."""
    h = F.xxhash64(F.isnull(c), c)
    return [F.sum(F.shiftrightunsigned(h, 32)).alias(f"{name}__hi"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"{name}__lo")]


def checksum_matrix(df: DataFrame, keys: list[str], fields: list[str], buckets: int) -> DataFrame:
    """One row a key bucket: row count and an additive checksum for each field (bound to its key, so swaps show).

    Partial sums are made before the shuffle: it carries at most `buckets` rows a task.
    """
    k = F.xxhash64(*keys)
    # the hash passes over nulls and empty arrays alike: nulls are hashed as such, and nested values as text that tells them apart
    nested = lambda f: isinstance(df.schema[f].dataType, (ArrayType, MapType, StructType))
    value = lambda f: F.to_json(F.struct(F.col(f).alias("v")), {"ignoreNullFields": "false"}) if nested(f) else F.col(f)
    bound = [p for f in fields for p in _hash_parts(F.struct(k.alias("k"), F.isnull(f).alias("n"), value(f).alias("v")), f)]
    return df.groupBy(F.pmod(k, F.lit(buckets)).cast("long").alias("bucket")).agg(F.count("*").alias("rows"), *_hash_parts(F.struct(*(x for c in keys for x in (F.isnull(c).alias(f"n_{c}"), F.col(c)))), "key"), *bound)


def unequal_buckets(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], buckets: int) -> DataFrame:
    """(bucket, key_differs, fields): where the two matrices differ, and in which fields."""
    a = checksum_matrix(left, keys, fields, buckets)
    b = checksum_matrix(right, keys, fields, buckets)
    names = [c for c in a.columns if c != "bucket"]
    both = a.select("bucket", *(F.col(c).alias(f"a_{c}") for c in names)).join(b.select("bucket", *(F.col(c).alias(f"b_{c}") for c in names)), "bucket", "full_outer")
    differ = lambda *cs: ~(sum((F.when(F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), 0).otherwise(1) for c in cs), F.lit(0)) == 0)
    out = both.select("bucket", differ("rows", "key__hi", "key__lo").alias("key_differs"), F.array_compact(F.array(*(F.when(differ(f"{f}__hi", f"{f}__lo"), F.lit(f)) for f in fields))).alias("fields"))
    return out.where(F.col("key_differs") | (F.size("fields") > 0))


def _inside(df: DataFrame, keys: list[str], found: DataFrame, buckets: int) -> DataFrame:
    """df's rows in the given buckets, with their bucket."""
    placed = df.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("long"))
    return placed.join(small(found.select(F.col("bucket").alias("__bucket")), SHOWN), "__bucket", "left_semi")


def locate(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], buckets: int, split: int = SPLIT) -> tuple[DataFrame, int]:
    """The unequal ones of at least `buckets` buckets, (bucket, key_differs, fields), and how many buckets there are.

    The matrix is refined level by level: each splits every unequal bucket of the level before into up to `split` parts, and reads
    only what lies in those. A task sends at most `split` rows at the first level, and no level gathers anything on the driver.
    """
    n = min(split, buckets)
    found = cut(unequal_buckets(left, right, keys, fields, n))
    while n < buckets and not found.isEmpty():
        finer = n * min(split, ceil(buckets / n))
        found, n = cut(unequal_buckets(_inside(left, keys, found, n), _inside(right, keys, found, n), keys, fields, finer)), finer
    return found, n


def diff(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], buckets: int | None = None, missing_right: str = "missing_in_right", missing_left: str = "missing_in_left", split: int = SPLIT) -> DataFrame:
    """(*keys, issue, field): rows missing on either side, and one row for each field whose values differ.

    Both inputs hold the same key and field names and types. Values are compared null-safe; null keys equal
    each other. Exact repeats of a row count once; if a key has several different rows on a side, the one with the
    greatest values stands for it. First the checksum matrices are compared (`buckets` buckets, by default as many as ROWS_A_BUCKET
    asks for); only rows of unequal buckets, and only fields unequal somewhere, are read again and joined.
    """
    found, n = locate(left.select(*keys, *fields), right.select(*keys, *fields), keys, fields, buckets or max(64, ceil(left.count() / ROWS_A_BUCKET)), split)
    unequal = {r[0] for r in found.select(F.explode("fields")).distinct().collect()}  # names of columns
    read = [f for f in fields if f in unequal]

    def side(df: DataFrame, name: str) -> DataFrame:
        rows = _inside(df.select(*keys, *read), keys, found, n)
        return rows.groupBy("__bucket", *keys).agg(F.max(F.struct(*([F.lit(1).alias("__one")] + [F.col(f) for f in read]))).alias(name))

    a, b = side(left, "__a"), side(right, "__b").withColumnsRenamed({k: f"__k_{k}" for k in keys} | {"__bucket": "__bb"})
    on = F.col("__bucket") == F.col("__bb")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    both = a.join(b, on, "full_outer")
    issue = lambda what, field: F.struct(F.lit(what).alias("issue"), F.lit(field).alias("field"))
    changed = F.array_compact(F.array(*(F.when(~F.col("__a")[f].eqNullSafe(F.col("__b")[f]), issue("changed", f)) for f in read))) if read else F.array().cast("array<struct<issue:string,field:string>>")
    issues = F.when(F.col("__b").isNull(), F.array(issue(missing_right, ""))).when(F.col("__a").isNull(), F.array(issue(missing_left, ""))).otherwise(changed)
    picked = [F.when(F.col("__a").isNull(), F.col(f"__k_{k}")).otherwise(F.col(k)).alias(k) for k in keys]
    return both.select(*picked, F.explode(issues).alias("x")).select(*keys, "x.issue", "x.field")

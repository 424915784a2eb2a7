"""One ranking from several differently scaled scores (problem 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import skew_join
from ..session import at_most, cut

SCORES = ("score", "rrf_score", "rerank_score")
#: Bounds of standardised values, and what a missing score gets; it lies below any real one.
LIMIT, MISSING = 12.0, 1e-7
ACCURACY = 10_000
#: Queries whose statistics are broadcast at most.
QUERIES = 200_000


def _median(x: Column) -> Column:
    """Lower median by a mergeable sketch of bounded size: exact for groups of under ACCURACY / 2 rows, else off by at most 1 / ACCURACY of the ranks."""
    return F.percentile_approx(x, F.lit(0.5), F.lit(ACCURACY))


def fused_scores(hits: DataFrame, scores: tuple[str, ...] = SCORES, weights: tuple[float, ...] | None = None) -> DataFrame:
    """(query_id, hit_id, chunk_id, fused) for every distinct hit.

    Within a query each score is centred at its median and scaled by 1.4826 x the median absolute
    deviation (if that is 0: 1.2533 x the mean absolute deviation; if that is 0 too, every value is
    average), squashed by the logistic function, and the bounded values are combined by their weighted geometric
    mean. Null and NaN count as missing and get a value below every real one, so a missing score never
    helps; infinite scores are squashed as the largest or least. Rows equal in all but arrival count once; rows
    without query_id are left out. A query of any size is spread: statistics merge sketches, and rows stay where they are
    when they meet them: statistics of up to QUERIES queries are broadcast, of more they are joined with hot queries salted.
    """
    w = weights or (1.0,) * len(scores)
    clean = [F.when(~F.isnan(s), F.col(s)).alias(s) for s in scores]
    rows = cut(hits.where(F.col("query_id").isNotNull()).select("query_id", "hit_id", "chunk_id", *clean).distinct())

    def meet(stats: DataFrame) -> DataFrame:
        few = cut(stats)
        return rows.join(F.broadcast(few), "query_id") if at_most(few, QUERIES) else skew_join(rows, few, "query_id", "hit_id")

    finite = lambda s: F.when(F.abs(F.col(s)) < F.lit(float("inf")), F.col(s))
    centre = rows.groupBy("query_id").agg(F.struct(*(_median(finite(s)).alias(s) for s in scores)).alias("__mid"))
    centred = meet(centre)
    away = lambda s: F.abs(finite(s) - F.col("__mid")[s])
    spread = centred.groupBy("query_id").agg(F.first("__mid").alias("__mid"), F.struct(*(F.when(_median(away(s)) > 0, _median(away(s)) * 1.4826).otherwise(F.avg(away(s)) * 1.2533).alias(s) for s in scores)).alias("__dev"))
    both = meet(spread)

    def log_bounded(s: str) -> Column:
        z = F.when(F.col("__dev")[s] > 0, (F.col(s) - F.col("__mid")[s]) / F.col("__dev")[s]).otherwise(F.lit(0.0))
        z = F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), z))
        return F.when(F.col(s).isNull(), F.ln(F.lit(MISSING))).otherwise(-F.log1p(F.exp(-z)))

    total = sum((F.lit(float(x)) * log_bounded(s) for s, x in zip(scores, w)), F.lit(0.0)) / F.lit(float(sum(w)))
    return both.select("query_id", "hit_id", "chunk_id", F.exp(total).alias("fused"))


def first_places(fused: DataFrame) -> DataFrame:
    """(query_id, chunk_id) of the best hit of each query; ties go to the lesser hit_id. Merged before the shuffle."""
    best = F.max_by("chunk_id", F.struct("fused", F.expr("-hit_id")))
    return fused.groupBy("query_id").agg(best.alias("chunk_id"))

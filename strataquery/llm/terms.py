"""Frequencies of terms, and how distinctive a term is of its record (problems 3 and 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import joined, tokenize
from ..operators.skew import hot_keys, skew_join
from ..session import cut


def net_frequencies(deltas: DataFrame) -> DataFrame:
    """Collection-wide (token, df_any, df_nonbody, df_body): sums of signed changes over distinct rows.

    A duplicate (equal in all but ``arrived_at``) counts once. Null changes count as 0, rows without
    a token are left out, tokens whose counts all cancel stay with zeros. Rows are placed by all their values to drop repeats, so
    those of a hot token are spread; then each task sums by token before the sums are shuffled.
    """
    counts = ["df_any", "df_nonbody", "df_body"]
    distinct = deltas.where(F.col("token").isNotNull()).select("layer_id", "token", *counts).distinct()
    return distinct.groupBy("token").agg(*(F.sum(F.coalesce(F.col(c), F.lit(0))).cast("bigint").alias(c) for c in counts))


def marks(frequencies: DataFrame, recipes: DataFrame, total_chunks: DataFrame) -> DataFrame:
    """(recipe_id, token, mark) with mark ``rare`` or ``common`` under each recipe.

    `total_chunks` is one row (n). Recipes are configuration rows of a fixed number; each token is
    expanded over them by an array, not by a join. A token can carry both marks. Null bounds mark nothing.
    """
    r = F.col("r")
    bounds = recipes.select("recipe_id", "body_df_min", "body_df_ratio", "df_any_min").distinct()
    rules = bounds.agg(F.collect_list(F.struct(*bounds.columns)).alias("rules"))
    both = frequencies.join(F.broadcast(rules.join(total_chunks)))  # one row on this side: rules and the number of records
    labelled = both.select("token", "df_any", "df_body", "n", F.explode("rules").alias("r")).select(
        r["recipe_id"].alias("recipe_id"),
        "token",
        F.array_compact(
            F.array(
                F.when((F.col("df_any") > 0) & (F.col("df_any") < r["df_any_min"]), F.lit("rare")),
                F.when((F.col("df_body") >= r["body_df_min"]) & (F.col("df_body") >= r["body_df_ratio"] * F.col("n")), F.lit("common")),
            )
        ).alias("m"),
    )
    return labelled.select("recipe_id", "token", F.explode("m").alias("mark"))


def term_frequencies(records: DataFrame, key: str, text: str) -> DataFrame:
    """(token, occurrences, records) over all rows; a repeated record key counts once, null text has no terms.

    Per-record counts come first, then sums by token; both steps combine before they shuffle.
    """
    once = records.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(text).alias("t"))
    each = once.select(key, F.explode(tokenize(F.col("t"))).alias("token"))
    per_record = each.groupBy(key, "token").agg(F.count("*").alias("tf"))
    return per_record.groupBy("token").agg(F.sum("tf").alias("occurrences"), F.count("*").alias("records"))


def bounded(frequencies: DataFrame, total: DataFrame, least: int = 2, ratio: float = 0.1) -> DataFrame:
    """term_frequencies with `mark`: `rare` in fewer than `least` records, `common` in at least `ratio` of all (total: one row n), else null."""
    return frequencies.join(F.broadcast(total)).withColumn("mark", F.when(F.col("records") < least, "rare").when(F.col("records") >= ratio * F.col("n"), "common")).drop("n")


def chunk_terms(chunks: DataFrame) -> DataFrame:
    """(chunk_id, dl, tf map<token, count>): one row a chunk, from title, breadcrumb and body.

    The text crosses the network once: rows are placed by chunk_id, and dropping repeats and counting
    tokens both reuse that placement. Chunks without any token are left out.
    """
    fields = F.concat_ws("\n", "title", joined(F.col("breadcrumb")), "body")
    rows = chunks.where(F.col("chunk_id").isNotNull()).select("chunk_id", fields.alias("t")).repartition("chunk_id").groupBy("chunk_id").agg(F.min("t").alias("t"))
    tokens = rows.select("chunk_id", F.explode(tokenize(F.col("t"))).alias("token"))
    tf = tokens.groupBy("chunk_id", "token").agg(F.count("*").alias("n"))
    return tf.groupBy("chunk_id").agg(F.sum("n").alias("dl"), F.map_from_entries(F.collect_list(F.struct("token", "n"))).alias("tf"))


def distinctiveness(hits: DataFrame, chunks: DataFrame, totals: DataFrame, df_min: int = 2, mu: float | None = None) -> DataFrame:
    """(hit_id, chunk_id, token, tf, df, score) of the distinct tokens of every hit.

    score = p_d ln(p_d / p_c), the term's part of the relative entropy between the record's
    Dirichlet-smoothed distribution p_d = (tf + mu p_c) / (dl + mu) and the collection's
    p_c = cf / (sum of lengths of `totals`). mu defaults to six mean record lengths: with much less
    smoothing a common word that is frequent in a short record outweighs a rare repeated one. Terms in fewer than
    `df_min` records (misreadings, typing errors) and terms that occur nowhere get a null score. Hits whose
    chunk is missing, and null tokens, are left out. A repeated hit counts once.
    """
    terms = cut(chunk_terms(chunks))
    each = terms.select(F.explode("tf").alias("token", "n"))
    stats = each.groupBy("token").agg(F.sum("n").alias("cf"), F.count("*").alias("df"))
    length = F.col("title_length_sum") + F.col("breadcrumb_length_sum") + F.col("body_length_sum")
    sums = totals.distinct().agg(F.sum(length).cast("double").alias("len"), F.sum("total_chunks").cast("double").alias("docs"))
    once = hits.where(F.col("hit_id").isNotNull()).groupBy("hit_id", "chunk_id").agg(F.max("tokens").alias("tokens"))
    hot = hot_keys(hits.select(F.explode("tokens").alias("token")), "token")
    found = skew_join(once, terms, "chunk_id", "hit_id", hot=hot_keys(hits, "chunk_id"))
    asked = found.select("hit_id", "chunk_id", "dl", F.explode(F.transform(F.array_distinct(F.array_compact("tokens")), lambda t: F.struct(t.alias("token"), F.coalesce(F.col("tf")[t], F.lit(0)).alias("tf")))).alias("x")).select("hit_id", "chunk_id", "dl", "x.token", "x.tf")
    scored = skew_join(asked, stats, "token", "hit_id", "left", hot=hot).join(F.broadcast(sums))  # one row of sums
    pc = F.col("cf") / F.col("len")
    m = F.lit(float(mu)) if mu is not None else F.col("len") / F.greatest(F.col("docs"), F.lit(1.0)) * 6
    pd = (F.col("tf") + m * pc) / (F.col("dl") + m)
    return scored.select("hit_id", "chunk_id", "token", "tf", "df", F.when(F.col("df") >= df_min, pd * F.ln(pd / pc)).alias("score"))


def most_characteristic(scores: DataFrame) -> DataFrame:
    """(hit_id, token): the token with the highest score of each hit; ties go to the more frequent, then lesser token."""
    best = F.max_by("token", F.struct("score", F.col("tf"), F.expr("-df")))
    return scores.where(F.col("score").isNotNull()).groupBy("hit_id").agg(best.alias("token"))

"""Queries of the text problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load
from . import encoding, markup, packing, ranking, scan, terms


def _total_chunks(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "corpus_totals").distinct().agg(F.sum("total_chunks").alias("n"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return scan.found_noise(load(spark, d, "chunks"))


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scan.repaired(load(spark, d, "chunks"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.found_markup(load(spark, d, "chunks"))


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean(load(spark, d, "chunks"))


def p2_path_ratios(spark: SparkSession, d: str) -> DataFrame:
    return markup.path_ratios(markup.measured(load(spark, d, "chunks")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    net = terms.net_frequencies(load(spark, d, "token_df_deltas"))
    return terms.marks(net, load(spark, d, "compiler_recipes"), _total_chunks(spark, d))


def p3_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return terms.net_frequencies(load(spark, d, "token_df_deltas"))


def p3_text_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_frequencies(load(spark, d, "documents"), "doc_id", "text")


def p3_text_marks(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    return terms.bounded(terms.term_frequencies(docs, "doc_id", "text"), docs.where("doc_id is not null").agg(F.count_distinct("doc_id").alias("n")))


def p4_ranking(spark: SparkSession, d: str) -> DataFrame:
    fused = ranking.fused_scores(load(spark, d, "hits"))
    return fused.select("query_id", "hit_id", "chunk_id", F.round("fused", 6).alias("fused"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    judged = load(spark, d, "judged_queries").select("query_id").distinct()
    hits = load(spark, d, "hits").join(judged, "query_id", "left_semi")
    return ranking.first_places(ranking.fused_scores(hits))


def p7_scores(spark: SparkSession, d: str) -> DataFrame:
    scores = terms.distinctiveness(load(spark, d, "hits"), load(spark, d, "chunks"), load(spark, d, "corpus_totals"))
    return scores.withColumn("score", F.round("score", 9))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    probes = load(spark, d, "term_probes").select("hit_id").distinct()
    hits = load(spark, d, "hits").join(probes, "hit_id", "left_semi")
    return terms.most_characteristic(terms.distinctiveness(hits, load(spark, d, "chunks"), load(spark, d, "corpus_totals")))


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(load(spark, d, "documents"), load(spark, d, "pack_sizes"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_pack(spark, d).groupBy("doc_id").agg(F.max("piece").alias("last")).where("last > 0").select("doc_id")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    bins = p8_pack(spark, d).groupBy("container", "capacity_tokens", "bin").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    return bins.groupBy("container", "capacity_tokens").agg(F.count("*").alias("bins"), F.sum("used").alias("tokens"), (F.sum("used") / (F.count("*") * F.first("capacity_tokens"))).alias("fill"))


def p8_holds(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers: every text is in them, whole unless it is longer than one; none is over its capacity; little room is left."""
    rows = p8_pack(spark, d)
    bins = rows.groupBy("container", "capacity_tokens", "bin").agg(F.sum("n_tokens").alias("used"))
    room = bins.groupBy("container", "capacity_tokens").agg((F.max("used") <= F.col("capacity_tokens")).alias("within"), (F.sum("used") >= 0.98 * F.count("*") * F.col("capacity_tokens")).alias("well_filled"))
    once = rows.groupBy("container", "doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("n"), F.first("capacity_tokens").alias("c"))
    texts = once.groupBy("container").agg(F.count("*").alias("documents"), F.bool_and(F.col("pieces") == F.ceil(F.col("n") / F.col("c"))).alias("whole"))
    return room.join(texts, "container").select("container", "documents", "whole", "within", "well_filled")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return packing.mix(load(spark, d, "documents"), load(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return packing.mix(load(spark, d, "documents"), load(spark, d, "mix_targets"))[1]


def p9_holds(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the mixture: each source is within a thousandth of its share, and no text is used too often."""
    goal = load(spark, d, "mix_targets").select(F.lower(F.trim("source")).alias("source"), "max_repeats")
    s = p9_shares(spark, d).join(goal, "source")
    return s.select("source", (F.abs(F.col("actual_share") - F.col("target_share")) < 0.001).alias("reached"), (F.col("max_copies") <= F.col("max_repeats")).alias("within_repeats"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.damaged(load(spark, d, "documents")).select("doc_id").distinct()


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restored(load(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_repaired, p2_found, p2_clean, p2_path_ratios, p3_found, p3_frequencies, p3_text_frequencies, p3_text_marks, p4_found, p4_ranking, p7_found, p7_scores, p8_found, p8_pack, p8_fill, p8_holds, p9_mix, p9_shares, p9_holds, p10_found, p10_restored)}
# SQL counterparts; where none is given, SQL can't express the operator and tests hold it against brute force.
_NET = "select token, sum(coalesce(df_any, 0))::bigint as df_any, sum(coalesce(df_nonbody, 0))::bigint as df_nonbody, sum(coalesce(df_body, 0))::bigint as df_body from (select distinct layer_id, token, df_any, df_nonbody, df_body from token_df_deltas where token is not null) group by token"
_SCORES = ranking.SCORES


def _tokens(x: str) -> str:
    return rf"list_concat(list_concat(list_transform(regexp_extract_all({x}, '[a-zA-Z][a-zA-Z0-9]+'), lambda w: lower(w)), regexp_extract_all({x}, '\p{{Nd}}{{2,}}')), flatten(list_transform(regexp_extract_all({x}, '[一-鿿]+'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))))"


def _fused(rows: str) -> str:
    """Median and MAD (lower medians), logistic squash, geometric mean; missing scores lie below all others."""
    mids = ", ".join(f"quantile_disc({s}, 0.5) filter (isfinite({s})) as mid_{s}" for s in _SCORES)
    devs = ", ".join(f"case when quantile_disc(abs({s} - mid_{s}), 0.5) filter (isfinite({s})) > 0 then quantile_disc(abs({s} - mid_{s}), 0.5) filter (isfinite({s})) * 1.4826 else avg(abs({s} - mid_{s})) filter (isfinite({s})) * 1.2533 end as dev_{s}" for s in _SCORES)
    parts = " + ".join(f"case when {s} is null then ln({ranking.MISSING}) else -ln(1 + exp(-greatest(-{ranking.LIMIT}, least({ranking.LIMIT}, case when dev_{s} > 0 then ({s} - mid_{s}) / dev_{s} else 0 end)))) end" for s in _SCORES)
    clean = ", ".join(f"case when not isnan({s}) then {s} end as {s}" for s in _SCORES)
    return f"""with r as materialized (select distinct query_id, hit_id, chunk_id, {clean} from {rows} where query_id is not null), m as (select query_id, {mids} from r group by query_id), v as (select query_id, {devs} from r join m using (query_id) group by query_id)
select query_id, hit_id, chunk_id, exp(({parts}) / 3) as fused from r join m using (query_id) join v using (query_id)"""


def _distinctive(hits: str) -> str:
    return rf"""with c as materialized (select chunk_id, {_tokens("concat_ws(chr(10), title, array_to_string(breadcrumb, ' '), body)")} as ts from (select distinct on (chunk_id) * from chunks where chunk_id is not null order by chunk_id)),
t as materialized (select chunk_id, token, count(*) as tf from (select chunk_id, unnest(ts) as token from c) group by all), s as materialized (select token, sum(tf) as cf, count(*) as df from t group by token),
tot as (select sum(title_length_sum + breadcrumb_length_sum + body_length_sum)::double as len, sum(total_chunks)::double as docs from (select distinct * from corpus_totals)),
h as (select hit_id, chunk_id, unnest(list_distinct(tokens)) as token from (select distinct hit_id, chunk_id, tokens from {hits})),
x as (select hit_id, chunk_id, token, coalesce(tf, 0) as tf, df, cf / tot.len as pc, 6 * tot.len / greatest(docs, 1) as mu, len(ts) as dl from h join c using (chunk_id) left join t using (chunk_id, token) left join s using (token), tot where len(ts) > 0)
select hit_id, chunk_id, token, tf, df, case when df >= 2 then (tf + mu * pc) / (dl + mu) * ln((tf + mu * pc) / (dl + mu) / pc) end as score from x"""


SQL: dict[str, str] = {
    "p3_found": f"with f as ({_NET}), n as (select sum(total_chunks) as n from (select distinct * from corpus_totals)), r as (select distinct recipe_id, body_df_min, body_df_ratio, df_any_min from compiler_recipes) select recipe_id, token, 'rare' as mark from f, r where df_any > 0 and df_any < df_any_min union all select recipe_id, token, 'common' from f, r, n where df_body >= body_df_min and df_body >= body_df_ratio * n",
    "p3_frequencies": _NET,
    "p3_text_frequencies": f"select token, sum(tf)::bigint as occurrences, count(*) as records from (select doc_id, token, count(*) as tf from (select doc_id, unnest({_tokens('text')}) as token from (select doc_id, min(text) as text from documents where doc_id is not null group by doc_id)) group by all) group by token",
    "p3_text_marks": f"with f as (select token, sum(tf)::bigint as occurrences, count(*) as records from (select doc_id, token, count(*) as tf from (select doc_id, unnest({_tokens('text')}) as token from (select doc_id, min(text) as text from documents where doc_id is not null group by doc_id)) group by all) group by token), n as (select count(distinct doc_id) as n from documents) select token, occurrences, records, case when records < 2 then 'rare' when records >= 0.1 * n then 'common' end as mark from f, n",
    "p8_holds": "select container, count(*) as documents, true as whole, true as within, true as well_filled from (select distinct doc_id from documents where doc_id is not null and text <> ''), pack_sizes group by container",
    "p9_holds": "select lower(trim(source)) as source, true as reached, true as within_repeats from mix_targets",
    "p4_ranking": f"select query_id, hit_id, chunk_id, round(fused, 6) as fused from ({_fused('hits')})",
    "p4_found": f"select query_id, arg_max(chunk_id, {{'f': fused, 'h': -hit_id}}) as chunk_id from ({_fused('(select * from hits where query_id in (select query_id from judged_queries))')}) group by query_id",
    "p7_scores": f"select hit_id, chunk_id, token, tf, df, round(score, 9) as score from ({_distinctive('hits')})",
    "p7_found": f"select hit_id, arg_max(token, {{'s': score, 't': tf, 'd': -df}}) as token from ({_distinctive('(select * from hits where hit_id in (select hit_id from term_probes))')}) where score is not null group by hit_id",
}

"""Queries of the retrieval engine's operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import index as ix
from ..operators import retrieval as rt
from ..session import load, small
from .sql_parts import sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, statement: str | None = None):
    """Register a query under a name, with its SQL."""

    def add(f):
        QUERIES[name] = f
        if statement:
            SQL[name] = statement
        return f

    return add


def judged(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "judged_queries")


def met(spark: SparkSession, d: str) -> DataFrame:
    return rt.matches(rt.query_tokens(judged(spark, d)), ix.index_of(spark, d))


def asked(spark: SparkSession, d: str) -> DataFrame:
    return rt.asked(judged(spark, d), ix.index_of(spark, d))


@query("ret_12_multi_path_search", sql("select query_id, rank, doc_key, node_key, chunk_id, local_id, score, rrf_score from hitlist", "hitlist"))
def _(spark, d):
    return rt.multi_path(judged(spark, d), ix.index_of(spark, d))


@query("ret_01_tokenize", sql("select chunk_id, array_to_string(tt, ' ') as title_tokens, array_to_string(bt, ' ') as breadcrumb_tokens, array_to_string(dt, ' ') as body_tokens from ct", "ct"))
def _(spark, d):
    t = ix.with_tokens(ix.distinct_chunks(load(spark, d, "chunks")))
    return t.select("chunk_id", F.array_join("tt", " ").alias("title_tokens"), F.array_join("bt", " ").alias("breadcrumb_tokens"), F.array_join("dt", " ").alias("body_tokens"))


@query("ret_03_synonym_expansion", sql("select query_id, row_number() over (partition by query_id order by ord) - 1 as ord, token, cast(weight as double) as weight from qt", "qt"))
def _(spark, d):
    return rt.query_tokens(judged(spark, d)).select("query_id", "ord", "token", "weight")


@query("agg_01_postings", sql("select token, chunk_id, title_tf, breadcrumb_tf, body_tf from p", "p"))
def _(spark, d):
    return ix.index_of(spark, d).postings.select("token", "chunk_id", "title_tf", "breadcrumb_tf", "body_tf")


@query("agg_05_df_triple", sql("select * from st", "st"))
def _(spark, d):
    return ix.index_of(spark, d).stats


@query("ret_05_chunk_bm25f", sql("select query_id, chunk_id, doc_key, score from scored", "scored"))
def _(spark, d):
    return rt.bm25f(met(spark, d), ix.index_of(spark, d)).select("query_id", "chunk_id", "doc_key", "score")


@query("ret_07_inverted_search", sql("select query_id, rank, chunk_id, doc_key, score from pb", "pb"))
def _(spark, d):
    return rt.capped(rt.bm25f(met(spark, d), ix.index_of(spark, d)), 50).select("query_id", "rank", "chunk_id", "doc_key", "score")


@query("ret_08_title_phrase", sql("select query_id, rank, chunk_id, doc_key, score from pa", "pa"))
def _(spark, d):
    i = ix.index_of(spark, d)
    return rt.phrase_path(ix.cut(rt.ranked(asked(spark, d), i, 60)), judged(spark, d), i).select("query_id", "rank", "chunk_id", "doc_key", "score")


@query("ret_10_doc_route", sql("select * from docs5", "docs5"))
def _(spark, d):
    return rt.routed_documents(met(spark, d))


# Text analysis and token statistics ------------------------------------------------------------------------------

from pyspark.sql import Window as W  # noqa: E402

from ..functions import normalize as nz  # noqa: E402
from ..operators import nodes as nds  # noqa: E402
from ..operators.quantiles import exact_rank  # noqa: E402
from ..operators.skew import skew_join  # noqa: E402
from .sql_parts import bc, first_seen, half_up, norm, tok  # noqa: E402


def once(spark: SparkSession, d: str) -> DataFrame:
    return ix.index_of(spark, d).chunks


def hitlist(spark: SparkSession, d: str) -> DataFrame:
    """Fused hits of all judged queries, computed once a session and state of the tables."""
    key = ix.stamp(spark, d, "chunks", "judged_queries")
    if key not in _HITS:
        _HITS.clear()
        _HITS[key] = ix.cut(rt.multi_path(judged(spark, d), ix.index_of(spark, d)))
    return _HITS[key]


_HITS: dict = {}


@query("ret_02_tokenize_unique", sql(f"select chunk_id, array_to_string({first_seen(tok('body'))}, ' ') as tokens from c", "c"))
def _(spark, d):
    return once(spark, d).select("chunk_id", F.array_join(T.tokenize_unique(F.col("body")), " ").alias("tokens"))


@query("agg_02_field_lengths", sql("select chunk_id, len(tt) as len_title, len(bt) as len_breadcrumb, len(dt) as len_body from ct", "ct"))
def _(spark, d):
    t = ix.with_tokens(once(spark, d))
    return t.select("chunk_id", F.size("tt").alias("len_title"), F.size("bt").alias("len_breadcrumb"), F.size("dt").alias("len_body"))


@query("agg_03_node_df", sql("select * from ndf", "ndf"))
def _(spark, d):
    return nds.node_df(nds.node_postings(nds.nodes(once(spark, d))))


@query("agg_04_chunk_df", sql("select token, count(*) as df from p group by token", "p"))
def _(spark, d):
    return ix.index_of(spark, d).postings.groupBy("token").agg(F.count("*").alias("df"))


@query("agg_06_field_averages", sql("select lt / greatest(n, 1) as avg_title, lb / greatest(n, 1) as avg_breadcrumb, ld / greatest(n, 1) as avg_body, n from tot", "tot"))
def _(spark, d):
    t = ix.corpus_totals(once(spark, d), ix.index_of(spark, d).postings)
    avg = lambda f: (F.col(f"{f}_length_sum") / F.greatest("total_chunks", F.lit(1))).alias(f"avg_{f}")
    return t.select(avg("title"), avg("breadcrumb"), avg("body"), F.col("total_chunks").alias("n"))


@query("agg_07_node_lengths", sql("select * from nl", "nl"))
def _(spark, d):
    return nds.node_lengths(nds.nodes(once(spark, d)))


@query("agg_08_corpus_totals", sql("select documents, n as total_chunks, lt as title_length_sum, lb as breadcrumb_length_sum, ld as body_length_sum from tot", "tot"))
def _(spark, d):
    return ix.corpus_totals(once(spark, d), ix.index_of(spark, d).postings)


@query("agg_09_incremental_totals", "select sum(documents) as documents, sum(total_chunks) as total_chunks, sum(title_length_sum) as title_length_sum, sum(breadcrumb_length_sum) as breadcrumb_length_sum, sum(body_length_sum) as body_length_sum, sum(posting_count) as posting_count, count(*) filter (total_chunks < 0) as removals from (select distinct * from corpus_totals)")
def _(spark, d):
    t = load(spark, d, "corpus_totals").distinct()
    cols = ["documents", "total_chunks", "title_length_sum", "breadcrumb_length_sum", "body_length_sum", "posting_count"]
    return t.agg(*(F.sum(c).alias(c) for c in cols), F.count_if(F.col("total_chunks") < 0).alias("removals"))


NET = "select distinct layer_id, token, df_any, df_nonbody, df_body from token_df_deltas where token is not null"


def net_rows(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "token_df_deltas").where("token is not null").select("layer_id", "token", "df_any", "df_nonbody", "df_body").distinct()


@query("agg_10_token_df_deltas", f"select token, sum(df_any) as df_any, sum(df_nonbody) as df_nonbody, sum(df_body) as df_body from ({NET}) where layer_id not like 'base%' group by token having sum(df_any) <> 0 or sum(df_nonbody) <> 0 or sum(df_body) <> 0")
def _(spark, d):
    t = net_rows(spark, d).where(~F.col("layer_id").startswith("base"))
    out = t.groupBy("token").agg(*(F.sum(c).alias(c) for c in ("df_any", "df_nonbody", "df_body")))
    return out.where("df_any <> 0 or df_nonbody <> 0 or df_body <> 0")


@query("agg_11_zero_crossing", f"select layer_id, sum(cast(after > 0 as int) - cast(before > 0 as int)) as vocabulary_change, sum(cast(after > 0 as int)) as touched_alive, count(*) as touched from (select layer_id, token, sum(df_any) over w as after, sum(df_any) over w - df_any as before from ({NET}) window w as (partition by token order by layer_id rows unbounded preceding)) group by layer_id")
def _(spark, d):
    w = W.partitionBy("token").orderBy("layer_id").rowsBetween(W.unboundedPreceding, 0)
    t = net_rows(spark, d).withColumn("after", F.sum("df_any").over(w)).withColumn("before", F.col("after") - F.col("df_any"))
    alive = lambda c: (F.col(c) > 0).cast("int")
    return t.groupBy("layer_id").agg(F.sum(alive("after") - alive("before")).alias("vocabulary_change"), F.sum(alive("after")).alias("touched_alive"), F.count("*").alias("touched"))


@query("agg_12_view_df", f"select token, sum(df_any) as df_any, sum(df_nonbody) as df_nonbody, sum(df_body) as df_body from ({NET}) group by token")
def _(spark, d):
    return net_rows(spark, d).groupBy("token").agg(*(F.sum(c).alias(c) for c in ("df_any", "df_nonbody", "df_body")))


@query("agg_13_body_pruning", sql("select token, df_body, (df_body >= 256 and df_body * 10 >= n * 9) as pruned from st, tot", "st", "tot"))
def _(spark, d):
    i = ix.index_of(spark, d)
    return i.stats.select("token", "df_body", ix.is_pruned(i.n).alias("pruned"))


@query("agg_14_effective_df", sql("select token, case when df_body >= 256 and df_body * 10 >= n * 9 then df_nonbody else df_any end as df from st, tot", "st", "tot"))
def _(spark, d):
    i = ix.index_of(spark, d)
    return i.stats.select("token", ix.effective_df(i.n).alias("df"))


def dropped_by_document_df(posts: DataFrame, documents: int, chunks: int, ratio: float = 0.35) -> DataFrame:
    """(token, documents, chunks) of tokens that are in over `ratio` of the documents; with one document, in more than int(chunks x ratio) chunks."""
    t = posts.groupBy("token").agg(F.count_distinct("doc_key").alias("documents"), F.count("*").alias("chunks"))
    return t.where(F.col("documents") / documents > ratio) if documents > 1 else t.where(F.col("chunks") > int(chunks * ratio))


@query("agg_15_document_df_filter", sql("select token, count(distinct doc_key) as documents, count(*) as chunks from p group by token having count(distinct doc_key) / (select documents from tot) > 0.35", "p", "tot"))
def _(spark, d):
    i = ix.index_of(spark, d)
    return dropped_by_document_df(i.postings, int(i.totals["documents"]), i.n)


@query("agg_16_pruning_report", sql("select count(distinct token) as tokens_before, count(distinct token) filter (not h or title_tf + breadcrumb_tf > 0) as tokens_after, count(*) as postings_before, count(*) filter (not h or title_tf + breadcrumb_tf > 0) as postings_after, count(distinct token) filter (h) as body_tokens_pruned, count(*) filter (h and body_tf > 0) as body_postings_pruned, coalesce(sum(body_tf) filter (h), 0) as body_tf_pruned from (select p.*, (df_body >= 64 and df_body * 4 >= n) as h from p join st using (token), tot)", "p", "st", "tot"))
def _(spark, d):
    i = ix.index_of(spark, d)  # under the second recipe, which prunes at this size
    h = i.stats.select("token", ((F.col("df_body") >= 64) & (F.col("df_body") * 4 >= i.n)).alias("h"))
    per = i.postings.groupBy("token").agg(F.count("*").alias("n"), F.count_if(F.col("title_tf") + F.col("breadcrumb_tf") > 0).alias("nonbody"), F.count_if(F.col("body_tf") > 0).alias("body"), F.sum("body_tf").alias("tf")).join(h, "token")
    pruned = lambda c: F.coalesce(F.sum(F.when(F.col("h"), c)), F.lit(0))
    return per.agg(F.count("*").alias("tokens_before"), F.count_if(~F.col("h") | (F.col("nonbody") > 0)).alias("tokens_after"), F.sum("n").alias("postings_before"), F.sum(F.when(F.col("h"), F.col("nonbody")).otherwise(F.col("n"))).alias("postings_after"), F.count_if("h").alias("body_tokens_pruned"), pruned(F.col("body")).alias("body_postings_pruned"), pruned(F.col("tf")).alias("body_tf_pruned"))


@query("agg_17_generation_stats", sql("select (select documents from tot) as documents, (select count(*) from nd) as nodes, (select n from tot) as chunks, (select count(*) from st) as tokens, (select count(*) from p) as postings", "nd", "st", "tot"))
def _(spark, d):
    i = ix.index_of(spark, d)
    a = i.chunks.agg(F.count_distinct("doc_key").alias("documents"), F.count_distinct("doc_key", "node_key").alias("nodes"), F.count("*").alias("chunks"))
    return a.join(i.stats.agg(F.count("*").alias("tokens"), F.sum("df_any").alias("postings")))  # one row each


@query("agg_18_compaction_metrics", "select count(distinct run_id) as layers, sum(byte_size) filter (run_id > 1) as delta_bytes, sum(byte_size) filter (run_id = 1) as base_bytes, (count(distinct run_id) >= 32 or coalesce(sum(byte_size) filter (run_id > 1), 0) * 5 >= coalesce(sum(byte_size) filter (run_id = 1), 0)) as compact from (select distinct segment_hash, run_id, byte_size from segment_refs)")
def _(spark, d):
    t = load(spark, d, "segment_refs").select("segment_hash", "run_id", "byte_size").distinct()
    a = t.agg(F.count_distinct("run_id").alias("layers"), F.sum(F.when(F.col("run_id") > 1, F.col("byte_size"))).alias("delta_bytes"), F.sum(F.when(F.col("run_id") == 1, F.col("byte_size"))).alias("base_bytes"))
    return a.withColumn("compact", (F.col("layers") >= 32) | (F.coalesce("delta_bytes", F.lit(0)) * 5 >= F.coalesce("base_bytes", F.lit(0))))


@query("agg_20_nearest_rank_percentile", "select view_id, quantile_disc(score, 0.5) as p50, quantile_disc(score, 0.95) as p95, max(score) as most from (select distinct hit_id, view_id, score from hits where score is not null and isfinite(score)) group by view_id")
def _(spark, d):
    t = load(spark, d, "hits").where(F.abs("score") < float("inf")).select("hit_id", "view_id", "score").distinct()
    at = lambda p, name: exact_rank(t, "view_id", "score", p, lambda n: F.ceil(n * p) - 1, name).drop("n")
    return at(0.5, "p50").join(at(0.95, "p95"), "view_id").join(t.groupBy("view_id").agg(F.max("score").alias("most")), "view_id")


@query("agg_21_rounded_index_percentile", "select view_id, max(case when i = cast(floor((n - 1) * 0.95 + 0.5) as bigint) then score end) as p95 from (select view_id, score, row_number() over (partition by view_id order by score, hit_id) - 1 as i, count(*) over (partition by view_id) as n from (select distinct hit_id, view_id, score from hits where score is not null and isfinite(score))) group by view_id")
def _(spark, d):
    t = load(spark, d, "hits").where(F.abs("score") < float("inf")).select("hit_id", "view_id", "score").distinct()
    return exact_rank(t, "view_id", "score", 0.95, lambda n: F.floor((n - 1) * 0.95 + 0.5), "p95").drop("n")


@query("agg_22_source_count", sql("select query_id, count(distinct doc_key) as sources from hitlist where rank <= 10 group by query_id", "hitlist"))
def _(spark, d):
    return hitlist(spark, d).where("rank <= 10").groupBy("query_id").agg(F.count_distinct("doc_key").alias("sources"))


@query("agg_23_normalization_stats", r"select doc_id, len(regexp_extract_all(t, '[ﬀ-ﬆ]')) as ligatures_expanded, length(t) - length(replace(t, chr(173), '')) as soft_hyphens_removed, length(t) - length(replace(t, chr(160), '')) as nonbreaking_spaces_replaced, len(regexp_extract_all(t, '[A-Za-z]\s*¨\s*[A-Za-z]')) as spacing_accents_repaired from (select doc_id, coalesce(text, '') as t from documents)")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", *(c.alias(n) for n, c in nz.normalization_counts(F.col("text")).items()))


@query("agg_24_duplicates", "select 'hits' as source, count(*) as keys, sum(n) as total_rows from (select hit_id, count(*) as n from hits group by hit_id having count(*) > 1) union all select 'chunks', count(*), sum(n) from (select chunk_id, count(*) as n from chunks group by chunk_id having count(*) > 1) union all select 'segment_refs', count(*), sum(n) from (select segment_hash, count(*) as n from segment_refs group by segment_hash having count(*) > 1)")
def _(spark, d):
    out = None
    for t, k in (("hits", "hit_id"), ("chunks", "chunk_id"), ("segment_refs", "segment_hash")):
        part = load(spark, d, t).groupBy(k).agg(F.count("*").alias("n")).where("n > 1").agg(F.lit(t).alias("source"), F.count("*").alias("keys"), F.sum("n").alias("total_rows"))
        out = part if out is None else out.unionByName(part)
    return out


@query("agg_25_issue_counts", "select case when status = 'failed' then 'ERR' when strategy is null or stages is null then 'WARN' when title = '' then 'REVIEW' else 'OK' end as level, count(*) as n from (select distinct * from ingest_jobs) group by 1")
def _(spark, d):
    t = load(spark, d, "ingest_jobs").distinct()
    level = F.when(F.col("status") == "failed", "ERR").when(F.col("strategy").isNull() | F.col("stages").isNull(), "WARN").when(F.col("title") == "", "REVIEW").otherwise("OK")
    return t.groupBy(level.alias("level")).agg(F.count("*").alias("n"))


@query("agg_26_queue_counts", "select status, current_stage, count(*) as n from (select arg_max({'s': status, 'c': current_stage}, {'u': updated_at, 's': status}) as j from ingest_jobs group by job_id) cross join lateral (select j.s as status, j.c as current_stage) group by status, current_stage")
def _(spark, d):
    t = load(spark, d, "ingest_jobs").groupBy("job_id").agg(F.max_by(F.struct("status", "current_stage"), F.struct("updated_at", "status")).alias("j"))
    return t.groupBy("j.status", "j.current_stage").agg(F.count("*").alias("n"))


@query("agg_27_two_pass_group_by", sql("select token, chunk_id, title_tf, breadcrumb_tf, case when df_body >= 64 and df_body * 4 >= n then 0 else body_tf end as body_tf from p join st using (token), tot", "p", "st", "tot"))
def _(spark, d):
    """Postings replayed with a decision that needs their whole group (pruning under the second recipe)."""
    i = ix.index_of(spark, d)
    hide = i.stats.select("token", ((F.col("df_body") >= 64) & (F.col("df_body") * 4 >= i.n)).alias("h"))
    return skew_join(i.postings, hide, "token", "chunk_id").select("token", "chunk_id", "title_tf", "breadcrumb_tf", F.when(F.col("h"), 0).otherwise(F.col("body_tf")).alias("body_tf"))


# Retrieval ----------------------------------------------------------------------------------------------------------


@query("ret_04_node_bm25f", sql("select * from nscore", "nscore"))
def _(spark, d):
    n = nds.nodes(once(spark, d))
    return nds.node_scores(nds.expanded_queries(judged(spark, d)), nds.node_postings(n), nds.node_lengths(n).first())


@query("ret_06_node_search", sql("select query_id, doc_key, node_key, score, rank from (select *, row_number() over (partition by query_id order by score desc, doc_key, node_key) as rank from (select *, row_number() over (partition by query_id, doc_key order by score desc, node_key) as n from nscore) where n <= 3) where rank <= 50", "nscore"))
def _(spark, d):
    return nds.node_search(QUERIES["ret_04_node_bm25f"](spark, d))


def titled_documents(spark: SparkSession, d: str) -> DataFrame:
    """(doc_key, title, description): the document's title heads the breadcrumbs; the first body's start describes it."""
    c = once(spark, d)
    return c.groupBy("doc_key").agg(F.min_by(F.coalesce(F.get("breadcrumb", F.lit(0)), F.lit("")), F.struct("local_id", "chunk_id")).alias("title"), F.min_by(F.coalesce(F.substring("body", 1, 200), F.lit("")), F.struct("local_id", "chunk_id")).alias("description"))


@query("ret_09_legacy_doc_route", sql(f"select query_id, doc_key, s as route_score from (select query_id, doc_key, s, row_number() over (partition by query_id order by s desc, doc_key) as n from (select query_id, doc_key, len(list_filter(ts, lambda t: list_contains(dts, t))) + case when len(list_filter(regexp_extract_all(raw, '[一-鿿]+'), lambda x: contains(tt, x))) > 0 then 2 else 0 end + case when len(list_filter(regexp_extract_all(raw, '[a-z][a-z0-9]+'), lambda x: contains(tt, x))) > 0 then 2 else 0 end + case when contains(dd, raw) then 1 else 0 end as s from (select distinct query_id, lower(query) as raw, list_distinct({tok('query')}) as ts from judged_queries), (select doc_key, lower(t) as tt, lower(s) as dd, list_distinct({tok('t')}) as dts from (select doc_key, arg_min(coalesce(breadcrumb[1], ''), {{'l': local_id, 'c': chunk_id}}) as t, arg_min(coalesce(substr(body, 1, 200), ''), {{'l': local_id, 'c': chunk_id}}) as s from c group by doc_key))) where s > 0) where n <= 5", "c"))
def _(spark, d):
    return nds.legacy_route(judged(spark, d), titled_documents(spark, d))


@query("ret_11_rrf", sql("select query_id, doc_key, node_key, i.chunk_id as chunk_id, rrf_score from fused", "fused"))
def _(spark, d):
    i, known = ix.index_of(spark, d), asked(spark, d)
    few = ix.cut(rt.ranked(known, i, 60))
    return rt.rrf([rt.phrase_path(few, judged(spark, d), i), few.where("rank <= 50"), rt.route_path(known, i)]).select("query_id", "doc_key", "node_key", "chunk_id", "rrf_score")


@query("ret_13_rm3", sql(f"select query_id, ord, token from (select query_id, unnest(ts) as token, generate_subscripts(ts, 1) - 1 as ord from (select q0.query_id, {first_seen('list_concat(q0.ts, coalesce(e, []))')} as ts from (select distinct query_id, {tok('query')} as ts from judged_queries) q0 left join (select query_id, list(token order by n) as e from (select query_id, token, row_number() over (partition by query_id order by s desc, f) as n from (select query_id, token, round(sum(score), 6) as s, min({{'r': rank, 'p': p}}) as f from (select query_id, rank, score, unnest(ts) as token, generate_subscripts(ts, 1) as p from (select query_id, rank, score, {tok('coalesce(c.title, chr(32)) || chr(32) || chr(32) || coalesce(substr(c.body, 1, 200), chr(32))')} as ts from hitlist join c using (chunk_id) where rank <= 10)) group by query_id, token)) where n <= 15 group by query_id) x on q0.query_id = x.query_id))", "hitlist", "c"))
def _(spark, d):
    return rt.rm3(judged(spark, d), hitlist(spark, d), ix.index_of(spark, d))


POS = sql(f"select query_id, chunk_id, token, field, pos from (select query_id, h.chunk_id, token, field, list_position(ts, token) - 1 as pos from (select query_id, chunk_id from hitlist) h join (select chunk_id, unnest([{{'f': 'title', 'ts': tt}}, {{'f': 'breadcrumb', 'ts': bt}}, {{'f': 'summary', 'ts': dt}}]) as x from ct) y on h.chunk_id = y.chunk_id cross join lateral (select x.f as field, x.ts as ts) join (select query_id, token from qt) using (query_id)) where pos >= 0", "hitlist", "ct", "qt")


@query("ret_15_positions", POS)
def _(spark, d):
    return rt.positions(hitlist(spark, d), judged(spark, d), ix.index_of(spark, d))


RERANK_SUB = f"""select query_id, rank, chunk_id, score,
 case when greatest(pt, pb, pd) > 0 then greatest(pt, pb, pd) when anyhit then 0.2 else 0 end as prox,
 least(1.0, case when len(pairs) > 0 then len(list_filter(pairs, lambda g: contains(ttl, g))) / len(pairs) else 0 end) as phrase,
 case when len(qts) > 0 then len(list_distinct(list_filter(qts, lambda t: list_contains(tt, t) or list_contains(bt, t) or list_contains(dt, t)))) / len(qts) else 0 end as cov
 from (select *, @@ from (select h.query_id, h.rank, h.chunk_id, h.score, ct.tt, ct.bt, ct.dt, lower(coalesce(ct.title, '') || ' ' || {bc('ct.breadcrumb')}) as ttl, qq.qts,
   list_concat(list_transform(range(1, length(cj)), lambda i: substr(cj, i, 2)), list_transform(range(1, len(en)), lambda i: en[i] || ' ' || en[i + 1])) as pairs,
   len(list_filter(alltok, lambda t: list_contains(tt, t) or list_contains(bt, t) or list_contains(dt, t))) > 0 as anyhit
   from hitlist h join ct using (chunk_id) join (select query_id, qts, cj, en from (select distinct query_id, {tok('query')} as qts, array_to_string(regexp_extract_all(query, '[一-鿿]+'), '') as cj, regexp_extract_all(lower(query), '[a-z][a-z0-9]+') as en from judged_queries)) qq on h.query_id = qq.query_id join (select query_id, list(token) as alltok from eq group by query_id) a on h.query_id = a.query_id))"""
_prox = lambda f, n: f"case when len(list_filter(list_transform(qts, lambda t: list_position({f}, t)), lambda p: p > 0)) >= 2 then 1.0 / (list_max(list_filter(list_transform(qts, lambda t: list_position({f}, t)), lambda p: p > 0)) - list_min(list_filter(list_transform(qts, lambda t: list_position({f}, t)), lambda p: p > 0)) + 1) else 0 end as {n}"
RERANK_SUB = RERANK_SUB.replace("@@", ", ".join((_prox("tt", "pt"), _prox("bt", "pb"), _prox("dt", "pd"))))


@query("ret_14_lexical_rerank", sql(f"select query_id, chunk_id, rank, round(0.5 * (score - min(score) over w) / coalesce(nullif(max(score) over w - min(score) over w, 0), 1) + 0.2 * (prox - min(prox) over w) / coalesce(nullif(max(prox) over w - min(prox) over w, 0), 1) + 0.2 * (phrase - min(phrase) over w) / coalesce(nullif(max(phrase) over w - min(phrase) over w, 0), 1) + 0.1 * cov, 9) as rerank_score from ({RERANK_SUB}) window w as (partition by query_id)", "hitlist", "ct", "eq"))
def _(spark, d):
    return rt.reranked(hitlist(spark, d), judged(spark, d), ix.index_of(spark, d)).select("query_id", "chunk_id", "rank", "rerank_score")


@query("ret_16_proximity", sql(f"select query_id, chunk_id, prox from ({RERANK_SUB})", "hitlist", "ct", "eq"))
def _(spark, d):
    return rt.reranked(hitlist(spark, d), judged(spark, d), ix.index_of(spark, d)).select("query_id", "chunk_id", "prox")


SH = lambda ts: f"list_distinct(case when len({ts}) >= 4 then list_transform(range(1, len({ts}) - 2), lambda i: array_to_string(list_slice({ts}, i, i + 3), ' ')) else {ts} end)"


@query("ret_17_shingles", sql(f"select chunk_id, unnest({SH('dt')}) as shingle from ct", "ct"))
def _(spark, d):
    return once(spark, d).select("chunk_id", F.explode(rt.shingles(F.col("body"))).alias("shingle"))


@query("ret_18_jaccard", sql(f"select a.query_id, a.chunk_id as left_id, b.chunk_id as right_id, case when len(a.sh) > 0 and len(b.sh) > 0 then len(list_intersect(a.sh, b.sh)) / (len(a.sh) + len(b.sh) - len(list_intersect(a.sh, b.sh))) else 0 end as similarity from (select query_id, rank, chunk_id, {SH('dt')} as sh from hitlist join ct using (chunk_id)) a join (select query_id, rank, chunk_id, {SH('dt')} as sh from hitlist join ct using (chunk_id)) b on a.query_id = b.query_id and b.rank = a.rank + 1", "hitlist", "ct"))
def _(spark, d):
    return rt.neighbor_similarity(hitlist(spark, d), ix.index_of(spark, d))


@query("ret_19_mmr")
def _(spark, d):
    i = ix.index_of(spark, d)
    r = rt.reranked(hitlist(spark, d), judged(spark, d), i).withColumn("ord", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")))
    return rt.mmr(rt.payload(ix.cut(r.select("query_id", "chunk_id", "ord", "rerank_score")), i, "body"))


EST = "cast(ceil(len(regexp_extract_all(coalesce({0}, ''), '[一-鿿]')) / 1.5 + (length(coalesce({0}, '')) - len(regexp_extract_all(coalesce({0}, ''), '[一-鿿]'))) / 4.0) as bigint)"


@query("ret_20_token_estimate", f"select doc_id, {EST.format('text')} as tokens, greatest(1, cast(ceil(length(coalesce(text, '')) * 0.7::double) as bigint)) as chat_tokens from documents")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"), T.estimate_tokens_chat(F.col("text")).alias("chat_tokens"))


SIG = sql(f"""select query_id, round(case when len(qts) > 0 and seen is not null then len(list_filter(qts, lambda t: list_contains(seen, t))) / len(qts) else 0 end, 9) as coverage, coalesce(r1, 0) as rrf_score, coalesce(len(list_filter(qts, lambda t: contains(tt, t))) > 0, false) as title_hit, case when r2 is not null then round(r1 - r2, 12) else 0 end as margin, coalesce(sc, 0) as source_count
from (select distinct query_id, list_distinct({tok('query')}) as qts from judged_queries) q0 left join
(select query_id, flatten(list(list_concat(list_concat(ct.tt, bt), dt)) filter (rank <= 5)) as seen, max(rrf_score) filter (rank = 1) as r1, max(rrf_score) filter (rank = 2) as r2, max(lower(coalesce(title, '') || ' ' || {bc('breadcrumb')})) filter (rank = 1) as tt, count(distinct hitlist.doc_key) as sc from hitlist join ct using (chunk_id) where rank <= 10 group by query_id) a using (query_id)""", "hitlist", "ct")
CLASS = "case when coverage < 0.5 then 'low' when coverage >= 0.7 and rrf_score >= 0.05 and (title_hit or source_count >= 2 or margin >= 0.01) then 'high' when coverage >= 0.5 or rrf_score >= 0.04 then 'medium' else 'low' end"


@query("ret_21_confidence_signals", SIG)
def _(spark, d):
    return rt.confidence(judged(spark, d), hitlist(spark, d), ix.index_of(spark, d)).drop("confidence")


@query("ret_22_confidence_class", f"select query_id, {CLASS} as confidence from ({SIG})")
def _(spark, d):
    return rt.confidence(judged(spark, d), hitlist(spark, d), ix.index_of(spark, d)).select("query_id", "confidence")


@query("ret_23_confidence_by_rerank", "select query_id, case when (top >= 0.6 and sources >= 2) then 'high' when top >= 0.3 or (top >= 0.15 and sources >= 2) then 'medium' else 'low' end as confidence from (select query_id, coalesce(max(rerank_score), 0) as top, count(distinct doc_key) as sources from hits where not coalesce(isnan(rerank_score), false) group by query_id)")
def _(spark, d):
    t = load(spark, d, "hits").where(F.col("rerank_score").isNull() | ~F.isnan("rerank_score")).groupBy("query_id").agg(F.coalesce(F.max("rerank_score"), F.lit(0.0)).alias("top"), F.count_distinct("doc_key").alias("sources"))
    return t.select("query_id", rt.confidence_class_by_rerank(F.col("top"), F.col("sources")).alias("confidence"))


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Search, feedback, scores of the hits' nodes for the expanded tokens, reranking: (query_id, rank, chunk_id, doc_key, score, rrf_score, rerank_score)."""
    i = ix.index_of(spark, d)
    n = ix.cut(nds.nodes(i.chunks).select("title", "breadcrumb", "terms", "summary"))
    toks = rt.rm3(judged(spark, d), hitlist(spark, d), i).select("query_id", "token").join(nds.node_df_of(n), "token")
    # the hit as a node has no terms: its fields are those of its own chunk
    scored = ix.cut(nds.chunk_scores(hitlist(spark, d).drop("score"), toks, i.chunks, nds.node_lengths(n).first()))
    r = rt.reranked(scored.withColumnRenamed("rank", "first_rank"), judged(spark, d), i)
    by = [F.desc("rerank_score"), F.desc("score"), F.asc("first_rank")]
    return r.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*by))).select("query_id", "rank", "chunk_id", "doc_key", "score", "rrf_score", "rerank_score")


@query("ret_24_evaluation_pipeline")
def _(spark, d):
    return pipeline(spark, d)


GOLD = "select query_id, case when regexp_matches(query, '[一-鿿]') then 'cjk' else 'latin' end as category, coalesce((select list(distinct doc_key) from (select doc_key, rank() over (order by rerank_score desc) as r from hits h where h.query_id = j.query_id and rerank_score is not null) where r = 1), []) as docs from (select distinct query_id, query from judged_queries) j"


def golden(spark: SparkSession, d: str) -> DataFrame:
    """Questions from the logged hits: the documents of the best reranked hit are what a query expects; queries without hits expect none."""
    h = load(spark, d, "hits").where(F.col("rerank_score").isNotNull())
    best = small(ix.cut(h.groupBy("query_id").agg(F.max("rerank_score").alias("m"))), rt.BATCH)
    exp = h.join(best, "query_id").where("rerank_score = m").groupBy("query_id").agg(F.collect_set("doc_key").alias("expect_doc_ids"))
    return judged(spark, d).select("query_id", F.when(F.col("query").rlike("[一-鿿]"), "cjk").otherwise("latin").alias("category")).distinct().join(exp, "query_id", "left").withColumn("expect_doc_ids", F.coalesce("expect_doc_ids", F.array().cast("array<string>")))


EVAL = sql(f"select g.query_id, category, case when len(docs) = 0 then 'no_answer' else 'answerable' end as kind, cast(case when len(docs) = 0 then (h.query_id is null or {CLASS} = 'low') else f is not null end as int) as recall, case when len(docs) > 0 and f is not null then 1.0 / f else 0 end as mrr, case when len(docs) = 0 then (h.query_id is null or {CLASS} = 'low') else f is not null end as correct from ({GOLD}) g left join (select distinct query_id from hitlist) h using (query_id) left join ({SIG}) s using (query_id) left join (select hitlist.query_id, min(rank) as f from hitlist join ({GOLD}) g2 on hitlist.query_id = g2.query_id and list_contains(g2.docs, hitlist.doc_key) where rank <= 10 group by hitlist.query_id) m using (query_id)", "hitlist")


def evals(spark: SparkSession, d: str) -> DataFrame:
    return rt.evaluated(golden(spark, d), hitlist(spark, d), rt.confidence(judged(spark, d), hitlist(spark, d), ix.index_of(spark, d)))


@query("ret_25_recall_mrr", EVAL)
def _(spark, d):
    return evals(spark, d)


@query("agg_19_evaluation_buckets", f"select case when grouping(category) = 0 then 'category' when grouping(kind) = 0 then 'kind' else 'overall' end as bucket, coalesce(category, kind, '') as value, count(*) as n, round(avg(recall), 6) as recall, round(avg(mrr), 6) as mrr, sum(cast(correct as int)) as correct from ({EVAL}) group by grouping sets ((), (category), (kind))")
def _(spark, d):
    return rt.evaluation_buckets(evals(spark, d))


CTX = sql("select query_id, ord, chunk_id, doc_key, node_key, body from (select *, row_number() over (partition by query_id order by rank) as ord from (select h.*, body, row_number() over (partition by h.query_id, h.doc_key, h.node_key order by rank) as n from hitlist h join (select chunk_id, body from c) using (chunk_id) where rank <= 12) where n = 1 and coalesce(body, '') <> '') where ord <= 8", "hitlist", "c")


@query("ret_26_context_assembly", CTX)
def _(spark, d):
    return rt.contexts(hitlist(spark, d), ix.index_of(spark, d))


@query("ret_27_budget_packing", f"with recursive x as materialized (select query_id, ord, chunk_id, {EST.format('body')} as cost from ({CTX})), r(query_id, ord, used, kept) as (select query_id, 0::bigint, 0::bigint, []::bigint[] from x group by query_id union all select r.query_id, x.ord, case when used + cost <= 300 then used + cost else used end, case when used + cost <= 300 then list_append(kept, x.ord) else kept end from r join x on x.query_id = r.query_id and x.ord = r.ord + 1), f as (select query_id, arg_max(kept, ord) as kept from r group by query_id) select x.query_id, x.ord, x.chunk_id from x join f using (query_id) where case when len(kept) > 0 then list_contains(kept, x.ord) else x.ord <= 2 end")
def _(spark, d):
    return rt.packed(rt.contexts(hitlist(spark, d), ix.index_of(spark, d)), T.estimate_tokens(F.col("body")), 300)

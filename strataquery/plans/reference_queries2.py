"""Queries of joins, windows, projections, incremental views and links, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.normalize import normalize_for_search
from ..operators import chunking as ck
from ..operators import incremental as inc
from ..operators import index as ix
from ..operators import layers as ly
from ..operators import links as lk
from ..operators import nodes as nds
from ..operators import retrieval as rt
from ..operators.numbering import numbered
from ..operators.skew import skew_join
from ..session import load, small
from ..sources import files as fs
from .reference_queries import asked, hitlist, judged, met, once, query
from .sql_parts import bc, norm, sql

# Joins --------------------------------------------------------------------------------------------------------------


@query("join_01_tokens_postings", sql("select query_id, token, chunk_id, df, title_tf, breadcrumb_tf, body_tf from met", "met"))
def _(spark, d):
    return met(spark, d).select("query_id", "token", "chunk_id", "df", "title_tf", "breadcrumb_tf", "body_tf")


@query("join_02_chunk_metrics", sql("select distinct query_id, chunk_id, len_title, len_breadcrumb, len_body from met", "met"))
def _(spark, d):
    return met(spark, d).select("query_id", "chunk_id", "len_title", "len_breadcrumb", "len_body").distinct()


@query("join_03_late_materialization", sql("select h.query_id, h.rank, h.chunk_id, title, body from hitlist h join c using (chunk_id)", "hitlist", "c"))
def _(spark, d):
    return rt.payload(hitlist(spark, d).select("query_id", "rank", "chunk_id"), ix.index_of(spark, d), "title", "body")


@query("join_05_change_set", "select coalesce(a.doc_key, b.doc_key) as doc_key, case when a.doc_key is null then 'added' when b.doc_key is null then 'deleted' when a.h = b.h then 'unchanged' else 'changed' end as change from (select doc_key, sum(hash_part) as h from (select distinct doc_key, node_key, node_local_ordinal, legacy_body_sha256, cast('0x' || substr(coalesce(legacy_body_sha256, '0'), 1, 12) as bigint) as hash_part from legacy_chunks) group by doc_key) a full join (select doc_key, sum(hash_part) as h from (select distinct doc_key, node_key, node_local_ordinal, generation_body_sha256, cast('0x' || substr(coalesce(generation_body_sha256, '0'), 1, 12) as bigint) as hash_part from generation_chunks) group by doc_key) b on a.doc_key = b.doc_key")
def _(spark, d):
    def side(t: str, h: str) -> DataFrame:
        part = F.conv(F.substring(F.coalesce(F.col(h), F.lit("0")), 1, 12), 16, 10).cast("bigint")
        return load(spark, d, t).select("doc_key", "node_key", "node_local_ordinal", h).distinct().groupBy("doc_key").agg(F.sum(part).cast("string").alias("content_hash")).withColumn("recipe_hash", F.lit(""))

    return ly.change_set(side("legacy_chunks", "legacy_body_sha256"), side("generation_chunks", "generation_body_sha256"))


OWN = "select doc_key, max(run_id) as layer from (select distinct doc_key, run_id from segment_refs where run_id in (select run_id from build_runs where status = 'succeeded')) group by doc_key"


def run_layers(spark: SparkSession, d: str) -> DataFrame:
    good = load(spark, d, "build_runs").where("status = 'succeeded'").select("run_id").distinct()
    return load(spark, d, "segment_refs").join(good, "run_id", "left_semi").select("doc_key", F.col("run_id").alias("layer"), F.lit(False).alias("deleted")).distinct()


@query("join_06_newest_layer_wins", OWN)
def _(spark, d):
    return ly.owners(run_layers(spark, d))


@query("join_07_chunk_node_violations", sql("select c.chunk_id from c anti join nd on c.doc_key = nd.doc_key and c.node_key = nd.node_key", "c", "nd"))
def _(spark, d):
    return once(spark, d).join(nds.nodes(once(spark, d)), ["doc_key", "node_key"], "left_anti").select("chunk_id")


@query("join_11_golden_hits", sql("select query_id, min(rank) as first_rank from hitlist join (select distinct query_id, doc_key from hits where rerank_score is not null and not isnan(rerank_score)) x using (query_id, doc_key) where rank <= 10 group by query_id", "hitlist"))
def _(spark, d):
    x = load(spark, d, "hits").where(F.col("rerank_score").isNotNull() & ~F.isnan("rerank_score")).select("query_id", "doc_key")
    top = hitlist(spark, d).where("rank <= 10").select("query_id", "doc_key", "rank")
    return x.join(small(top, rt.BATCH), ["query_id", "doc_key"]).groupBy("query_id").agg(F.min("rank").alias("first_rank"))  # repeats don't change the least


@query("join_12_merge_field_postings", sql("select token, chunk_id, title_tf + breadcrumb_tf as nonbody_tf, body_tf from p", "p"))
def _(spark, d):
    p = ix.index_of(spark, d).postings
    a = p.where("title_tf + breadcrumb_tf > 0").select("token", "chunk_id", (F.col("title_tf") + F.col("breadcrumb_tf")).alias("nonbody_tf"))
    b = p.where("body_tf > 0").select("token", "chunk_id", "body_tf")
    return a.join(b, ["token", "chunk_id"], "full_outer").select("token", "chunk_id", F.coalesce("nonbody_tf", F.lit(0)).alias("nonbody_tf"), F.coalesce("body_tf", F.lit(0)).alias("body_tf"))


@query("join_13_manifest_proof", "select coalesce(a.doc_key, b.doc_key) as doc_key, a.doc_key is null as lacks_source, b.doc_key is null as lacks_segment from (select distinct doc_key from source_docs) a full join (select distinct doc_key from segment_refs) b on a.doc_key = b.doc_key where a.doc_key is null or b.doc_key is null")
def _(spark, d):
    a = load(spark, d, "source_docs").select("doc_key", F.lit(True).alias("s")).distinct()
    b = load(spark, d, "segment_refs").select("doc_key", F.lit(True).alias("g")).distinct()
    return a.join(b, "doc_key", "full_outer").select("doc_key", F.col("s").isNull().alias("lacks_source"), F.col("g").isNull().alias("lacks_segment")).where("lacks_source or lacks_segment")


@query("join_14_owner_overlay", f"select doc_key, layer from ({OWN.replace('segment_refs', '(select * from segment_refs where run_id <= 5)')}) o where doc_key not in (select doc_key from segment_refs where run_id > 5 and run_id in (select run_id from build_runs where status = 'succeeded')) union all select doc_key, max(run_id) from segment_refs where run_id > 5 and run_id in (select run_id from build_runs where status = 'succeeded') group by doc_key")
def _(spark, d):
    layers = run_layers(spark, d)
    parent = ly.owners(layers.where("layer <= 5"))
    delta = ly.owners(layers.where("layer > 5"))
    return parent.join(delta.select("doc_key"), "doc_key", "left_anti").unionByName(delta)


@query("join_15_view_chain", "select layer_id, lag(layer_id) over (order by layer_id) as parent, row_number() over (order by layer_id) - 1 as position from (select distinct layer_id from corpus_totals)")
def _(spark, d):
    """The chain of layers; one small row a layer."""
    w = W.orderBy("layer_id")
    return load(spark, d, "corpus_totals").select("layer_id").distinct().select("layer_id", F.lag("layer_id").over(w).alias("parent"), (F.row_number().over(w) - 1).alias("position"))


# Windows, sorts, limits, sets ----------------------------------------------------------------------------------------


@query("win_01_per_document_cap", sql("select query_id, rank, chunk_id, doc_key from few where rank <= 60", "few"))
def _(spark, d):
    return rt.ranked(asked(spark, d), ix.index_of(spark, d), 60).select("query_id", "rank", "chunk_id", "doc_key")


@query("win_02_path_rank", sql("select query_id, path, rank - 1 as position, chunk_id from paths", "paths"))
def _(spark, d):
    i, known = ix.index_of(spark, d), asked(spark, d)
    few = ix.cut(rt.ranked(known, i, 60))
    parts = [rt.phrase_path(few, judged(spark, d), i), few.where("rank <= 50"), rt.route_path(known, i)]
    rows = [p.select("query_id", F.lit(n).alias("path"), (F.col("rank") - 1).alias("position"), "chunk_id") for n, p in enumerate(parts)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


MM = "round((score - min(score) over w) / coalesce(nullif(max(score) over w - min(score) over w, 0), 1), 9)"


@query("win_03_min_max", f"select hit_id, round((score - lo) / coalesce(nullif(hi - lo, 0), 1), 9) as score_01 from (select distinct hit_id, query_id, score from hits where score is not null and isfinite(score)) join (select query_id, min(score) as lo, max(score) as hi from hits where score is not null and isfinite(score) group by query_id) using (query_id)")
def _(spark, d):
    """Bounds are merged before the shuffle and joined back, so a query with very many hits is spread."""
    t = load(spark, d, "hits").where(F.abs("score") < float("inf")).select("hit_id", "query_id", "score").distinct()
    lim = t.groupBy("query_id").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    return skew_join(t, lim, "query_id", "hit_id").select("hit_id", F.round((F.col("score") - F.col("lo")) / F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(F.col("hi") - F.col("lo")), 9).alias("score_01"))


@query("win_04_margin", sql("select query_id, round(max(rrf_score) filter (rank = 1) - coalesce(max(rrf_score) filter (rank = 2), max(rrf_score) filter (rank = 1)), 12) as margin from hitlist where rank <= 2 group by query_id", "hitlist"))
def _(spark, d):
    w = W.partitionBy("query_id").orderBy("rank")
    h = hitlist(spark, d).where("rank <= 2").withColumn("next", F.lead("rrf_score").over(w)).where("rank = 1")
    return h.select("query_id", F.round(F.coalesce(F.col("rrf_score") - F.col("next"), F.lit(0.0)), 12).alias("margin"))


@query("win_05_duplicate_ordinal", sql("select chunk_id, row_number() over (partition by doc_key, title order by local_id, chunk_id) - 1 as duplicate_ordinal from c", "c"))
def _(spark, d):
    return numbered(once(spark, d), ["doc_key", "title"], ["local_id", "chunk_id"], "duplicate_ordinal").select("chunk_id", "duplicate_ordinal")


@query("win_06_newest_state", "select job_id, max(updated_at) as updated_at, arg_max(status, {'u': updated_at, 's': status}) as status from ingest_jobs group by job_id")
def _(spark, d):
    return load(spark, d, "ingest_jobs").groupBy("job_id").agg(F.max("updated_at").alias("updated_at"), F.max_by("status", F.struct("updated_at", "status")).alias("status"))


LINES = r"select chunk_id, unnest(string_split(coalesce(body, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(body, ''), chr(10)), 1) - 1 as pos from c"


@query("win_07_nearest_heading", sql(rf"select chunk_id, pos, last_value(case when ltrim(line) like '#%' then nullif(trim(ltrim(line, '# ')), '') end ignore nulls) over (partition by chunk_id order by pos rows unbounded preceding) as heading from ({LINES})", "c"))
def _(spark, d):
    rows = once(spark, d).select("chunk_id", F.posexplode(F.split(F.coalesce("body", F.lit("")), "\n")).alias("pos", "line"))
    title = F.when(F.ltrim("line").startswith("#"), F.nullif(F.trim(F.regexp_replace("line", "^[# ]+", "")), F.lit("")))
    w = W.partitionBy("chunk_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return rows.select("chunk_id", "pos", F.last(title, ignorenulls=True).over(w).alias("heading"))


@query("win_08_excerpt", sql(rf"select chunk_id, pos, substr(trim(concat_ws(' ', nullif(trim(a), ''), nullif(trim(line), ''), nullif(trim(b), ''), nullif(trim(e), ''))), 1, 240) as excerpt from (select chunk_id, pos, line, lag(line) over w as a, lead(line) over w as b, case when pos = 0 then lead(line, 2) over w end as e from ({LINES}) window w as (partition by chunk_id order by pos))", "c"))
def _(spark, d):
    rows = once(spark, d).select("chunk_id", F.posexplode(F.split(F.coalesce("body", F.lit("")), "\n")).alias("pos", "line"))
    w = W.partitionBy("chunk_id").orderBy("pos")
    part = lambda c: F.nullif(F.trim(c), F.lit(""))
    third = F.when(F.col("pos") == 0, F.lead("line", 2).over(w))
    return rows.select("chunk_id", "pos", F.substring(F.trim(F.concat_ws(" ", part(F.lag("line").over(w)), part(F.col("line")), part(F.lead("line").over(w)), part(third))), 1, 240).alias("excerpt"))


@query("win_09_sliding_pairs", sql("select chunk_id, unnest(list_transform(range(1, len(dt)), lambda i: dt[i] || ' ' || dt[i + 1])) as pair from ct", "ct"))
def _(spark, d):
    t = once(spark, d).select("chunk_id", T.tokenize(F.col("body")).alias("ts")).where("size(ts) > 1")
    return t.select("chunk_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("ts") - 1), lambda i: F.concat_ws(" ", F.element_at("ts", i), F.element_at("ts", i + 1)))).alias("pair"))


@query("srt_03_utf8_order", sql("select token, row_number() over (order by token) as position from st", "st"))
def _(spark, d):
    """Positions in byte order; no task holds all tokens."""
    return numbered(ix.index_of(spark, d).stats, [], ["token"], "i").select("token", (F.col("i") + 1).alias("position"))


@query("srt_05_compiler_order", sql("select chunk_id, row_number() over (partition by doc_key order by local_id, chunk_id) as position from c", "c"))
def _(spark, d):
    return numbered(once(spark, d), ["doc_key"], ["local_id", "chunk_id"], "i").select("chunk_id", (F.col("i") + 1).alias("position"))


@query("lim_01_top_k", sql("select query_id, rank, chunk_id from hitlist where rank <= 20", "hitlist"))
def _(spark, d):
    return rt.multi_path(judged(spark, d), ix.index_of(spark, d), 20).select("query_id", "rank", "chunk_id")


@query("set_01_candidate_union", sql("select query_id, count(distinct chunk_id) as candidates from met group by query_id", "met"))
def _(spark, d):
    return met(spark, d).select("query_id", "chunk_id").distinct().groupBy("query_id").agg(F.count("*").alias("candidates"))


@query("set_02_document_sets", "select (select count(*) from (select doc_key from source_docs intersect select doc_key from segment_refs)) as shared, (select count(*) from (select doc_key from source_docs except select doc_key from segment_refs)) as only_source, (select count(*) from (select doc_key from segment_refs except select doc_key from source_docs)) as only_segment")
def _(spark, d):
    a, b = load(spark, d, "source_docs").select("doc_key"), load(spark, d, "segment_refs").select("doc_key")
    both = a.select("doc_key", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select("doc_key", F.lit(0).alias("x"), F.lit(1).alias("y"))).groupBy("doc_key").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    return both.agg(F.count_if(F.expr("x = 1 and y = 1")).alias("shared"), F.count_if(F.expr("x = 1 and y = 0")).alias("only_source"), F.count_if(F.expr("x = 0 and y = 1")).alias("only_segment"))


@query("set_04_array_sets", sql("select chunk_id, len(list_intersect(list_distinct(tt), list_distinct(dt))) as shared, len(list_distinct(list_concat(tt, dt))) as either from ct", "ct"))
def _(spark, d):
    t = ix.with_tokens(once(spark, d))
    return t.select("chunk_id", F.size(F.array_intersect("tt", "dt")).alias("shared"), F.size(F.array_union("tt", "dt")).alias("either"))


# Projections and filters ----------------------------------------------------------------------------------------------


@query("prj_01_node_fields", sql(f"select doc_key, node_key, coalesce(title, '') as title, {bc('breadcrumb')} as breadcrumb, {bc('terms')} as terms, summary from nd", "nd"))
def _(spark, d):
    n = nds.nodes(once(spark, d))
    return n.select("doc_key", "node_key", *(text().alias(f) for f, text in nds.FIELDS.items()))


@query("prj_02_synthesized_node", sql("select chunk_id, doc_key, title, coalesce(substr(body, 1, 200), '') as summary from c", "c"))
def _(spark, d):
    return once(spark, d).select("chunk_id", "doc_key", "title", F.coalesce(F.substring("body", 1, 200), F.lit("")).alias("summary"))


@query("prj_03_stable_ids", sql("select chunk_id, sha256(doc_key) as doc_uid, split_part(doc_key, ':', 1) as doc_type, substr(doc_key, instr(doc_key, ':') + 1) as slug from c", "c"))
def _(spark, d):
    return nds.split_doc_key(once(spark, d)).select("chunk_id", F.sha2("doc_key", 256).alias("doc_uid"), "doc_type", "slug")


@query("prj_04_result_projection", sql("select query_id, rank, chunk_id, coalesce(array_to_string(breadcrumb, ' > '), '') as breadcrumb, body as text from hitlist join c using (chunk_id)", "hitlist", "c"))
def _(spark, d):
    return rt.payload(hitlist(spark, d).select("query_id", "rank", "chunk_id"), ix.index_of(spark, d), F.coalesce(F.concat_ws(" > ", "breadcrumb"), F.lit("")).alias("breadcrumb"), F.col("body").alias("text"))


DOCS = "select doc_key, split_part(doc_key, ':', 1) as doc_type, arg_min(coalesce(breadcrumb[1], ''), {'l': local_id, 'c': chunk_id}) as title, count(*) as chunks from c group by doc_key"


@query("prj_05_library_list", sql(DOCS, "c"))
def _(spark, d):
    docs = once(spark, d).groupBy("doc_key").agg(F.min_by(F.coalesce(F.get("breadcrumb", F.lit(0)), F.lit("")), F.struct("local_id", "chunk_id")).alias("title"), F.count("*").alias("chunks"))
    return nds.split_doc_key(docs).select("doc_key", "doc_type", "title", "chunks").orderBy("doc_type", F.lower("title"), "doc_key")


@query("prj_06_find_by_key", "select distinct j.slug, s.doc_key from ingest_jobs j join source_docs s on s.doc_key = j.doc_type || ':' || j.slug")
def _(spark, d):
    j = load(spark, d, "ingest_jobs").select("slug", F.concat_ws(":", "doc_type", "slug").alias("doc_key")).where("slug is not null").distinct()
    return j.join(load(spark, d, "source_docs").select("doc_key").distinct(), "doc_key").select("slug", "doc_key")


@query("prj_07_source_authorization", "select c.chunk_id, coalesce(bool_or(list_contains(s.files, c.source_md)), false) as allowed from (select distinct chunk_id, doc_key, source_md from chunks) c left join source_docs s using (doc_key) group by c.chunk_id")
def _(spark, d):
    allowed = load(spark, d, "source_docs").select("doc_key", F.explode("files").alias("source_md")).distinct().withColumn("ok", F.lit(True))
    return once(spark, d).select("chunk_id", "doc_key", "source_md").join(allowed, ["doc_key", "source_md"], "left").groupBy("chunk_id").agg(F.coalesce(F.max("ok"), F.lit(False)).alias("allowed"))


@query("prj_08_node_url", sql(r"select doc_key, node_key, case t when 'book' then '/books/' || slug || '/' || case when stem <> '' and stem <> '_index' then stem || '.html' else 'index.html' end when 'paper' then '/papers/' || slug || '/index.html' else '/notes/' || slug || '.html' end || '#pi-node-' || coalesce(node_id, '') as url from (select doc_key, node_key, node_id, split_part(doc_key, ':', 1) as t, substr(doc_key, instr(doc_key, ':') + 1) as slug, regexp_replace(regexp_replace(coalesce(source_md, ''), '^.*[/\\]', ''), '\.[^.]*$', '') as stem from nd)", "nd"))
def _(spark, d):
    return nds.nodes(once(spark, d)).select("doc_key", "node_key", "url")


@query("prj_09_title_terms", sql("select doc_key, node_key, array_to_string(terms, '|') as terms from nd", "nd"))
def _(spark, d):
    return nds.nodes(once(spark, d)).select("doc_key", "node_key", F.concat_ws("|", "terms").alias("terms"))


@query("flt_03_active_documents", f"select s.segment_hash, s.doc_key from (select distinct segment_hash, doc_key, run_id from segment_refs) s join ({OWN}) o on s.doc_key = o.doc_key and s.run_id = o.layer")
def _(spark, d):
    s = load(spark, d, "segment_refs").select("segment_hash", "doc_key", F.col("run_id").alias("layer")).distinct()
    return s.join(ly.owners(run_layers(spark, d)), ["doc_key", "layer"], "left_semi").select("segment_hash", "doc_key")


@query("flt_04_id_validation", r"select distinct doc_key, coalesce(regexp_matches(doc_key, '^(?:book|paper|note):[^/\\:\x00]+$'), false) as valid from source_docs")
def _(spark, d):
    return load(spark, d, "source_docs").select("doc_key", fs.is_doc_key(F.col("doc_key")).alias("valid")).distinct()


@query("flt_05_preflight", "select job_id, updated_at, case when slug is null or slug = '' then 'slug' when input_pdf <> '' and lower(input_pdf) not like '%.pdf' then 'filename' when network_policy = 'local_only' and list_contains(stages, 'translate') then 'policy' else 'ok' end as verdict from (select distinct * from ingest_jobs)")
def _(spark, d):
    t = load(spark, d, "ingest_jobs").distinct()
    v = F.when(F.coalesce("slug", F.lit("")) == "", "slug").when((F.col("input_pdf") != "") & ~F.lower("input_pdf").like("%.pdf"), "filename").when((F.col("network_policy") == "local_only") & F.array_contains("stages", "translate"), "policy").otherwise("ok")
    return t.select("job_id", "updated_at", v.alias("verdict"))



def QUERIES_PRJ5(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d).groupBy("doc_key").agg(F.min_by(F.coalesce(F.get("breadcrumb", F.lit(0)), F.lit("")), F.struct("local_id", "chunk_id")).alias("title"))


# Index building and incremental views -------------------------------------------------------------------------------


@query("idx_03_chunking", "select doc_id, unnest(parts) as body, generate_subscripts(parts, 1) - 1 as ordinal from (select doc_id, case when trim(regexp_replace(t, '\\s+', ' ', 'g')) = '' then [] when length(t) <= 500 then [t] else list_transform(range(0, greatest(0, length(t) - 101) + 1, 400), lambda s: substr(t, s + 1, 500)) end as parts from (select doc_id, coalesce(text, '') as t from documents))")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", F.posexplode(ck.windows(F.col("text"))).alias("ordinal", "body"))


@query("idx_04_local_ids", sql("select chunk_id, row_number() over (partition by doc_key order by node_key, node_local_ordinal, sha256(coalesce(body, '')), chunk_id) - 1 as local_id from c", "c"))
def _(spark, d):
    return ck.local_ids(once(spark, d).drop("local_id")).select("chunk_id", "local_id")


@query("idx_06_compiled_ids", sql("select chunk_id, 'c' || lpad(cast(row_number() over (order by doc_key, local_id, chunk_id) - 1 as varchar), 6, '0') as global_id from c", "c"))
def _(spark, d):
    n = numbered(once(spark, d), [], ["doc_key", "local_id", "chunk_id"], "i")
    return n.select("chunk_id", F.concat(F.lit("c"), F.lpad(F.col("i").cast("string"), 6, "0")).alias("global_id"))


@query("idx_07_document_token_stats", sql("select doc_key, token, count(*) as df_any, count(*) filter (title_tf > 0 or breadcrumb_tf > 0) as df_nonbody, count(*) filter (body_tf > 0) as df_body from p group by doc_key, token", "p"))
def _(spark, d):
    return ix.token_stats(ix.index_of(spark, d).postings, "doc_key")


@query("idx_09_change_set", None)
def _(spark, d):
    now = inc.listing(load(spark, d, "source_docs")).where("not deleted").select("doc_key", "content_hash", F.col("segment_recipe_hash").alias("recipe_hash"))
    built = inc.manifest_of_runs(load(spark, d, "segment_refs"), load(spark, d, "build_runs")).select("doc_key", "content_hash", F.col("segment_recipe_hash").alias("recipe_hash"))
    return ly.change_set(built, now)


def layered(spark: SparkSession, d: str) -> ly.View:
    """The chunks in three layers, by the run that last built their documents (none or up to 5: base; up to 9; later)."""
    own = ly.owners(run_layers(spark, d)).select("doc_key", F.when(F.col("layer") <= 5, 0).when(F.col("layer") <= 9, 1).otherwise(2).alias("l"))
    c = ix.cut(once(spark, d).join(own, "doc_key", "left").withColumn("l", F.coalesce("l", F.lit(0))))
    none = spark.createDataFrame([], "doc_key string")
    view = ly.base_view(c.where("l = 0").drop("l"))
    for n in (1, 2):
        view = ly.add_delta(view, c.where(F.col("l") == n).drop("l"), none, n)
    return view


@query("idx_11_delta_statistics", sql("select * from st", "st"))
def _(spark, d):
    return layered(spark, d).token_stats()


@query("idx_12_compaction", sql("select token, chunk_id, title_tf, breadcrumb_tf, body_tf from p", "p"))
def _(spark, d):
    return ly.compact(layered(spark, d)).postings.select("token", "chunk_id", "title_tf", "breadcrumb_tf", "body_tf")


@query("idx_14_input_proof", "select doc_key, sha256(concat_ws(chr(10), doc_key, coalesce(lower(max(content_hash)), ''), coalesce(lower(max(segment_recipe_hash)), ''))) as proof from segment_refs group by doc_key")
def _(spark, d):
    low = lambda c: F.coalesce(F.lower(F.max(c)), F.lit(""))
    return load(spark, d, "segment_refs").groupBy("doc_key").agg(F.sha2(F.concat_ws("\n", F.col("doc_key"), low("content_hash"), low("segment_recipe_hash")), 256).alias("proof"))


@query("idx_16_shadow_diff", "select doc_key, count(*) filter (a.k is null) as only_generation, count(*) filter (b.k is null) as only_legacy, count(*) filter (a.k is not null and b.k is not null and a.chunk_id is distinct from b.chunk_id) as id_only from (select distinct doc_key, node_key || ':' || node_local_ordinal as k, min(chunk_id) as chunk_id from legacy_chunks group by all) a full join (select distinct doc_key, node_key || ':' || node_local_ordinal as k, min(chunk_id) as chunk_id from generation_chunks group by all) b using (doc_key, k) group by doc_key".replace("a.k is null", "a.chunk_id is null").replace("b.k is null", "b.chunk_id is null").replace("a.k is not null", "a.chunk_id is not null").replace("b.k is not null", "b.chunk_id is not null"))
def _(spark, d):
    side = lambda t, n: load(spark, d, t).groupBy("doc_key", "node_key", "node_local_ordinal").agg(F.min("chunk_id").alias(n))
    j = side("legacy_chunks", "a").join(side("generation_chunks", "b"), ["doc_key", "node_key", "node_local_ordinal"], "full_outer")
    return j.groupBy("doc_key").agg(F.count_if(F.col("a").isNull()).alias("only_generation"), F.count_if(F.col("b").isNull()).alias("only_legacy"), F.count_if(F.col("a") != F.col("b")).alias("id_only"))


@query("idx_17_read_view", sql("select token, count(*) as active_postings from p group by token", "p"))
def _(spark, d):
    return layered(spark, d).active().groupBy("token").agg(F.count("*").alias("active_postings"))


@query("idx_18_document_chunk_refs", sql("select doc_key, unnest(range(count(*))) as local_id from c group by doc_key", "c"))
def _(spark, d):
    n = once(spark, d).groupBy("doc_key").agg(F.count("*").alias("n"))
    return n.select("doc_key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("local_id"))


@query("idx_20_pseudo_headings", sql(rf"select chunk_id, pos, regexp_extract(line, '^(\d+(?:\.\d+)*)\s+(\S.*)$', 1) as number, len(string_split(regexp_extract(line, '^(\d+(?:\.\d+)*)\s+(\S.*)$', 1), '.')) as depth from (select *, sum(cast(f as int)) over (partition by chunk_id order by pos rows unbounded preceding) as k from (select *, regexp_matches(line, '^\s*(```|~~~)') as f from ({LINES}))) where k % 2 = 0 and not f and regexp_matches(line, '^(\d+(?:\.\d+)*)\s+(\S.*)$')", "c"))
def _(spark, d):
    return ck.pseudo_headings(ck.lines_of(once(spark, d), "chunk_id", "body")).select("chunk_id", "pos", "number", "depth")


@query("idx_23_numeric_chunk_ids", sql("select chunk_id, try_cast(substr(chunk_id, 2) as bigint) as number from c", "c"))
def _(spark, d):
    return once(spark, d).select("chunk_id", F.substring("chunk_id", 2, 20).try_cast("bigint").alias("number"))


@query("idx_21_synthetic_corpus", "select 'note:synthetic-' || lpad(cast(id // 50 as varchar), 5, '0') as doc_key, 'c' || lpad(cast(id as varchar), 6, '0') as chunk_id, 'Section ' || (id % 50) as title, array_to_string(list_transform(range(1, 49), lambda i: 'term' || lpad(cast(cast('0x' || substr(md5(id || ':' || i || ':42'), 1, 8) as bigint) % 4096 as varchar), 5, '0')), ' ') as body from (select range as id from range(10000))")
def _(spark, d):
    return synthetic(spark, 200, 50, 48)


def synthetic(spark: SparkSession, documents: int, sections: int, words: int, vocabulary: int = 4096, seed: int = 42) -> DataFrame:
    """(doc_key, chunk_id, title, body): a generated corpus; words come from hashes, so any partitioning gives the same rows."""
    rows = spark.range(documents * sections).withColumn("doc", (F.col("id") / sections).cast("bigint")).withColumn("sec", F.col("id") % sections)
    word = lambda i: F.concat(F.lit("term"), F.lpad((F.conv(F.substring(F.md5(F.concat_ws(":", "id", i, F.lit(seed))), 1, 8), 16, 10).cast("bigint") % vocabulary).cast("string"), 5, "0"))
    return rows.select(F.concat(F.lit("note:synthetic-"), F.lpad(F.col("doc").cast("string"), 5, "0")).alias("doc_key"), F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("chunk_id"), F.concat(F.lit("Section "), F.col("sec").cast("string")).alias("title"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), word), " ").alias("body"))


# Sources and sinks ----------------------------------------------------------------------------------------------------


@query("src_01_discovery", "select doc_type || ':' || slug as doc_key, doc_type, slug, count(distinct f) as file_count from (select case when regexp_matches(f, '^books/[^/_][^/]*/[^/]+[.]md$') then 'book' when regexp_matches(f, '^papers/[^/_][^/]*/_index[.]md$') then 'paper' when regexp_matches(f, '^notes/[^/_][^/]*[.]md$') then 'note' end as doc_type, regexp_replace(regexp_replace(f, '^[a-z]+/', ''), '(/.*|[.]md)$', '') as slug, f from (select distinct unnest(files) as f from source_docs)) where doc_type is not null group by doc_type, slug having doc_type <> 'book' or (bool_or(f like '%/_index.md') and count(distinct f) >= 2)")
def _(spark, d):
    paths = load(spark, d, "source_docs").select(F.explode("files").alias("f")).distinct().select(F.concat(F.lit("/"), F.col("f")).alias("path"))
    return fs.discover(paths).select("doc_key", "doc_type", "slug", F.size("files").alias("file_count"))


@query("src_06_section_lines", sql("select chunk_id, trim(array_to_string(list_slice(string_split(coalesce(body, ''), chr(10)), 2, 4), chr(10)), ' ' || chr(9) || chr(10) || chr(13)) as section from c", "c"))
def _(spark, d):
    return once(spark, d).select("chunk_id", ck.section(F.col("body"), F.lit(1), F.lit(4)).alias("section"))


@query("src_08_page_ranges", None)
def _(spark, d):
    return load(spark, d, "ingest_jobs").select("job_id", "updated_at", fs.page_list(F.col("pages"), F.lit(400)).alias("l")).select("job_id", "updated_at", F.size("l").alias("n_pages"), F.get("l", F.lit(0)).alias("first_page")).distinct()


@query("src_13_token_seek", sql("select q.token, count(*) as postings from (select distinct token from qt) q join p using (token) group by q.token", "qt", "p"))
def _(spark, d):
    """Postings are sorted by token: few tokens are sought page by page, more of them are sent to the postings; either way only tokens are read."""
    q = ix.cut(rt.query_tokens(judged(spark, d)).select("token").distinct())
    return ix.seek(ix.index_of(spark, d).postings, "token", q).select("token").join(small(q, rt.BATCH), "token", "left_semi").groupBy("token").agg(F.count("*").alias("postings"))


@query("src_14_nonbody_scan", sql("select token, sum(title_tf) as title_tf, sum(breadcrumb_tf) as breadcrumb_tf from p where title_tf + breadcrumb_tf > 0 group by token", "p"))
def _(spark, d):
    return ix.index_of(spark, d).postings.select("token", "title_tf", "breadcrumb_tf").where("title_tf + breadcrumb_tf > 0").groupBy("token").agg(F.sum("title_tf").alias("title_tf"), F.sum("breadcrumb_tf").alias("breadcrumb_tf"))



# Scalar functions -----------------------------------------------------------------------------------------------------


@query("fn_03_normalization", f"select doc_id, sha256({norm('text')}) as normalized_hash from documents")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", F.sha2(normalize_for_search(F.col("text")), 256).alias("normalized_hash"))


@query("fn_04_rounding", "select distinct hit_id, floor(score * 100 + 0.5) / 100.0::double as r2, floor(rrf_score * 1000 + 0.5) / 1000.0::double as r3 from hits where score is not null and rrf_score is not null and isfinite(score) and isfinite(rrf_score)")
def _(spark, d):
    t = load(spark, d, "hits").where((F.abs("score") < float("inf")) & (F.abs("rrf_score") < float("inf")))
    return t.select("hit_id", T.round_half_up(F.col("score"), 2).alias("r2"), T.round_half_up(F.col("rrf_score"), 3).alias("r3")).distinct()


@query("fn_08_sha256", "select doc_id, sha256(coalesce(text, '')) as text_hash from documents")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"))


# Links ----------------------------------------------------------------------------------------------------------------


def texts(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as source texts of their documents; a chunk is one text, named by its id."""
    return once(spark, d).select(F.col("doc_key").alias("source_id"), F.col("chunk_id").alias("source_md"), F.col("body").alias("text"))


def catalog(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, doc_type, slug, title, aliases, status, preview): titles head breadcrumbs; aliases are the slug without its number and `type:` with it; failed jobs count as archived."""
    c = once(spark, d)
    head = c.groupBy("doc_key").agg(F.min_by(F.struct(F.coalesce(F.get("breadcrumb", F.lit(0)), F.lit("")).alias("title"), "body"), F.struct("local_id", "chunk_id")).alias("h"))
    rows = nds.split_doc_key(head.select("doc_key", "h.*"))
    status = load(spark, d, "ingest_jobs").groupBy("doc_type", "slug").agg(F.max_by("status", F.struct("updated_at", "status")).alias("job"))
    stem = F.regexp_replace("slug", r"-\d+$", "")
    j = rows.join(status, ["doc_type", "slug"], "left")
    return j.select(F.col("doc_key").alias("doc_id"), "doc_type", "slug", "title", F.array(stem, F.concat_ws(":", "doc_type", stem)).alias("aliases"), F.when(F.col("job") == "failed", "archived").when(F.col("job") == "done", "reviewed").otherwise("draft").alias("status"), lk.preview(F.col("body")).alias("preview"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    key = ix.stamp(spark, d, "chunks", "ingest_jobs")
    if key not in _EDGES:
        _EDGES.clear()
        _EDGES[key] = ix.cut(lk.resolve(lk.parse_links(texts(spark, d)), catalog(spark, d), lk.heading_map(once(spark, d))))
    return _EDGES[key]


_EDGES: dict = {}
KEY_OF = r"replace(lower(trim(regexp_replace(title, '\s+', ' ', 'g'))), 'ß', 'ss')"
WIKI = r"(?:^|[^!])(\[\[[^\[\]\n]+\]\])"
PARSED = sql(rf"select doc_key as source_id, chunk_id as source_md, pos + 1 as line, m as raw from (select c.doc_key, c.chunk_id, pos, unnest(regexp_extract_all(regexp_replace(line, '`[^`]*`', '', 'g'), '{WIKI}', 1)) as m from (select *, sum(cast(f as int)) over (partition by chunk_id order by pos rows unbounded preceding) as k from (select *, regexp_matches(line, '^\s*(```|~~~)') as f from ({LINES}))) l join c using (chunk_id) where k % 2 = 0 and not f) union all select doc_key, chunk_id, pos + 1, m from (select c.doc_key, c.chunk_id, pos, unnest(regexp_extract_all(regexp_replace(line, '`[^`]*`', '', 'g'), '(?:^|[^!])(\[[^\]\n]+\]\([^)\s]+\))', 1)) as m from (select *, sum(cast(f as int)) over (partition by chunk_id order by pos rows unbounded preceding) as k from (select *, regexp_matches(line, '^\s*(```|~~~)') as f from ({LINES}))) l join c using (chunk_id) where k % 2 = 0 and not f) where not regexp_matches(m, '\((?:https?://|mailto:|tel:|data:|javascript:|#)')", "c")


@query("lnk_01_parse_links", PARSED)
def _(spark, d):
    return lk.parse_links(texts(spark, d)).select("source_id", "source_md", "line", "raw")


@query("lnk_04_resolve", None)
def _(spark, d):
    return edges(spark, d).select("source_id", "source_md", "line", "raw", "target_id", "status", "candidates")


@query("lnk_05_catalog", None)
def _(spark, d):
    return catalog(spark, d)


@query("lnk_09_link_index", None)
def _(spark, d):
    return edges(spark, d).groupBy("source_id").agg(F.count("*").alias("links"), F.count_if(F.col("status") == "resolved").alias("outgoing"))


@query("lnk_11_backlinks", None)
def _(spark, d):
    return lk.backlinks(edges(spark, d), catalog(spark, d))


@query("lnk_12_neighborhood", None)
def _(spark, d):
    return lk.neighborhood(edges(spark, d), catalog(spark, d))


@query("lnk_12_shown_edges", None)
def _(spark, d):
    return lk.shown_edges(edges(spark, d), lk.neighborhood(edges(spark, d), catalog(spark, d)))


@query("lnk_15_diagnostics", f"select syntax, count(*) as links from (select case when raw like '[[%' then 'wikilink' else 'markdown' end as syntax from ({PARSED})) group by syntax")
def _(spark, d):
    return lk.diagnostics(edges(spark, d)).groupBy("syntax").agg(F.sum("n").alias("links"))


@query("lnk_16_heading_map", None)
def _(spark, d):
    return lk.heading_map(once(spark, d))


@query("stream_windowed_counts", "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, sum(value) as total from events group by all")
def _(spark, d):
    from ..streaming.incremental import windowed_counts

    return windowed_counts(load(spark, d, "events"))

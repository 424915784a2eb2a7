"""Further queries: sources and sinks, filters, link resolution, small operators; each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as ck
from ..operators import incremental as inc
from ..operators import index as ix
from ..operators import layers as ly
from ..operators import links as lk
from ..operators import retrieval as rt
from ..operators.numbering import numbered
from ..operators.table_diff import checksum_matrix
from ..session import load, scratch
from ..sources import files as fs
from ..sources.snapshots import SnapshotStore, export_json
from .reference_queries import asked, judged, met, once, query
from .reference_queries2 import KEY_OF, LINES, OWN, PARSED, catalog, edges, layered, texts
from .sql_parts import first_seen, sql

# Sources and sinks ----------------------------------------------------------------------------------------------------


@query("src_07_frontmatter", "select distinct job_id || '@' || strftime(updated_at, '%Y%m%d%H%M%S') as path, coalesce(title, '') as title, coalesce(strategy, '') as strategy, 5 as body_offset from ingest_jobs")
def _(spark, d):
    """Job records written as Markdown heads and parsed again."""
    j = load(spark, d, "ingest_jobs").distinct()
    head = F.concat(F.lit("---\ntitle: '"), F.coalesce("title", F.lit("")), F.lit("'\nstrategy: "), F.coalesce("strategy", F.lit("")), F.lit("\ntags: [a, b]\n---\nbody"))
    parsed = fs.parse_frontmatter(j.select(F.concat("job_id", F.lit("@"), F.date_format("updated_at", "yyyyMMddHHmmss")).alias("path"), head.alias("text")))
    return parsed.select("path", F.element_at("meta", "title").alias("title"), F.element_at("meta", "strategy").alias("strategy"), "body_offset").distinct()


@query("src_11_json_load", sql("select chunk_id, doc_key, title, body, local_id from c", "c"))
def _(spark, d):
    schema = "chunk_id string, doc_key string, title string, body string, local_id int"
    rows = once(spark, d).select(F.to_json(F.struct("chunk_id", "doc_key", "title", "body", "local_id")).alias("j"))
    return rows.select(F.from_json("j", schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")


def store(spark: SparkSession) -> SnapshotStore:
    return SnapshotStore(spark, scratch(spark, "store"))


@query("snk_01_publish", sql("select * from st", "st"))
def _(spark, d):
    """Statistics written as a snapshot, published, and read through the pointer."""
    s = store(spark)
    s.publish(s.put({"stats": ix.index_of(spark, d).stats}))
    return s.table("stats")


@query("snk_02_verified_write", sql("select count(*) as written, 0 as unequal_buckets from st", "st"))
def _(spark, d):
    """What was written is read back and compared by checksums for each bucket of keys."""
    stats = ix.index_of(spark, d).stats
    s = store(spark)
    back = s.table("stats", s.put({"stats": stats}))
    fields = ["df_any", "df_nonbody", "df_body"]
    m = lambda df: checksum_matrix(df, ["token"], fields, 64)
    bad = m(stats).exceptAll(m(back)).agg(F.count("*").alias("unequal_buckets"))
    return back.agg(F.count("*").alias("written")).join(bad)  # one row each


@query("snk_03_json_export", sql("select chunk_id, doc_key, title, breadcrumb, body from c", "c"))
def _(spark, d):
    at = scratch(spark, "export")
    export_json(once(spark, d).select("chunk_id", "doc_key", "title", "breadcrumb", "body"), at)
    return spark.read.schema("chunk_id string, doc_key string, title string, breadcrumb array<string>, body string").json(at)


@query("snk_04_link_index", f"select case when raw like '[[%' then 'wikilink' else 'markdown' end as syntax, count(*) as n from ({PARSED}) group by 1")
def _(spark, d):
    """Documents, edges and diagnostics as three tables of one published snapshot."""
    s, e = store(spark), edges(spark, d)
    s.publish(s.put({"documents": catalog(spark, d), "edges": e, "diagnostics": e.where("status <> 'resolved'")}))
    return s.table("edges").groupBy("syntax").agg(F.count("*").alias("n"))


# Filters ------------------------------------------------------------------------------------------------------------------


@query("flt_01_positive_scores", sql("select query_id, count(*) as n, min(score) as least from scored group by query_id", "scored"))
def _(spark, d):
    return rt.bm25f(met(spark, d), ix.index_of(spark, d)).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))


@query("flt_02_phrase_threshold", sql("select query_id, chunk_id, len(list_filter(grams, lambda g: contains(tt, g))) / len(grams) as share from few join ctitle using (chunk_id) join qg using (query_id) where rank <= 60 and len(grams) > 0 and len(list_filter(grams, lambda g: contains(tt, g))) / len(grams) > 0.3", "few", "ctitle", "qg"))
def _(spark, d):
    i = ix.index_of(spark, d)
    few = ix.cut(rt.ranked(asked(spark, d), i, 60))
    j = rt.payload(few, i, rt.title_text(F.col("title"), F.col("breadcrumb")).alias("tt")).join(rt.analyzed(judged(spark, d)).select("query_id", "norm"), "query_id")
    return j.select("query_id", "chunk_id", rt.phrase_share(F.col("norm"), F.col("tt")).alias("share")).where("share > 0.3")


@query("flt_06_archived", "select doc_type || ':' || slug as doc_id from ingest_jobs where slug is not null group by doc_type, slug having arg_max(status, {'u': updated_at, 's': status}) <> 'failed'")
def _(spark, d):
    s = load(spark, d, "ingest_jobs").where("slug is not null").groupBy("doc_type", "slug").agg(F.max_by("status", F.struct("updated_at", "status")).alias("s"))
    return s.where("s <> 'failed'").select(F.concat_ws(":", "doc_type", "slug").alias("doc_id"))


# Joins, aggregates, sets ----------------------------------------------------------------------------------------------


@query("join_04_synonym_terms", sql("select q.query_id, k as term from q, syn where len(tokens) > 0 and (instr(lower(norm), k) > 0 or list_contains(tokens, k))", "q", "syn"))
def _(spark, d):
    from ..functions.synonyms import table

    a = rt.analyzed(judged(spark, d))
    terms = F.array(*(F.lit(k) for k, _ in table()))
    return a.select("query_id", F.explode(F.filter(terms, lambda k: (F.instr(F.lower("norm"), k) > 0) | F.array_contains("tokens", k))).alias("term"))


def resolved(parsed: str, columns: str, joins: str = "") -> str:
    """SQL of resolved links over parsed ones (source_id, source_md, line, raw)."""
    return _RESOLVED.replace("__PARSED__", parsed).replace("__COLUMNS__", columns).replace("__JOINS__", joins)


_RESOLVED = sql(
    rf"""select __COLUMNS__ l.source_id, l.source_md, l.line, l.raw, case when i.doc_id is not null then l.path when t.n = 1 then t.least when a.n = 1 then a.least end as target_id,
 case when i.doc_id is not null or t.n = 1 or a.n = 1 then 'resolved' when a.n > 0 then 'ambiguous' else 'broken' end as status,
 case when i.doc_id is not null or t.n = 1 or a.n = 1 then 1 else coalesce(a.n, 0) end as candidates
from (select *, lower(trim(regexp_replace(path, '\s+', ' ', 'g'))) as key, split_part(source_id, ':', 1) as st from (select *, case when len(parts) >= 2 and parts[1] in ('books', 'papers', 'notes') and parts[2] <> '_index' then substr(parts[1], 1, length(parts[1]) - 1) || ':' || parts[2] else v end as path from (select *, list_filter(string_split(v, '/'), lambda p: p not in ('', '.', '..')) as parts from (select *, regexp_replace(regexp_replace(regexp_replace(trim(split_part(replace(tgt, '\', '/'), '?', 1)), '^content/', ''), '^/+', ''), '\.md$', '') as v from (select *, case when raw like '[[%' then trim(split_part(split_part(substr(raw, 3, length(raw) - 4), '|', 1), '#', 1)) else regexp_extract(raw, '\]\(([^)#\s]*)', 1) end as tgt from (__PARSED__)))))) l
left join ids i on l.path = i.doc_id left join (select key, doc_type, count(*) as n, min(doc_id) as least from nm group by key, doc_type) t on t.key = l.key and t.doc_type = l.st left join (select key, count(*) as n, min(doc_id) as least from nm group by key) a on a.key = l.key __JOINS__""",
    "c",
)
_CAT = r"ids as (select distinct doc_key as doc_id, split_part(doc_key, ':', 1) as doc_type, substr(doc_key, instr(doc_key, ':') + 1) as slug from c), ttl as (select doc_key, arg_min(coalesce(breadcrumb[1], ''), {'l': local_id, 'c': chunk_id}) as title from c group by doc_key), nm as (select distinct lower(trim(regexp_replace(name, '\s+', ' ', 'g'))) as key, doc_type, doc_id from (select doc_id, doc_type, unnest([title, regexp_replace(slug, '-\d+$', ''), doc_type || ':' || regexp_replace(slug, '-\d+$', '')]) as name from ids join ttl on ids.doc_id = ttl.doc_key))"
_RESOLVED = _RESOLVED.replace("\nselect __COLUMNS__", f",\n{_CAT}\nselect __COLUMNS__", 1)
RESOLVED = resolved(PARSED, "")


@query("join_08_link_catalog", RESOLVED)
def _(spark, d):
    return edges(spark, d).select("source_id", "source_md", "line", "raw", "target_id", "status", "candidates")


BACK = f"select target_id as doc_id, source_id, count(*) as occurrences from ({RESOLVED}) where status = 'resolved' group by all"


@query("lnk_11_backlink_counts", BACK)
def _(spark, d):
    return lk.backlinks(edges(spark, d), catalog(spark, d)).drop("archived")


@query("set_05_neighbor_union", f"select doc_id, neighbor, min(p) as priority from (select a.doc_id, a.neighbor, case when a.o and a.i then 0 when a.o then 1 else 2 end as p from (select doc_id, neighbor, bool_or(o) as o, bool_or(i) as i from (select source_id as doc_id, doc_id as neighbor, true as o, false as i from ({BACK}) union all select doc_id, source_id, false, true from ({BACK})) group by all) a) group by all")
def _(spark, d):
    return lk.neighborhood(edges(spark, d), catalog(spark, d).withColumn("status", F.lit("draft")), 200).select("doc_id", "neighbor", "priority")


@query("srt_04_edge_order", f"select source_id, source_md, line, raw, row_number() over (partition by source_id order by coalesce(target_id, ''), source_md, line, raw) as position from ({RESOLVED})")
def _(spark, d):
    rows = edges(spark, d).withColumn("t", F.coalesce("target_id", F.lit("")))
    return numbered(rows, ["source_id"], ["t", "relation", "source_md", "line", "raw"], "i").select("source_id", "source_md", "line", "raw", (F.col("i") + 1).alias("position"))


@query("join_10_full_diff", "select coalesce(a.doc_key, b.doc_key) as doc_key, coalesce(a.k, b.k) as k, case when b.k is null then 'missing' when a.k is null then 'added' when a.h is distinct from b.h or a.t is distinct from b.t then 'changed' when a.i is distinct from b.i then 'id-only' else 'same' end as verdict from (select doc_key, node_key || ':' || node_local_ordinal as k, max(legacy_body_sha256) as h, max(title) as t, min(chunk_id) as i from legacy_chunks group by all) a full join (select doc_key, node_key || ':' || node_local_ordinal as k, max(generation_body_sha256) as h, max(title) as t, min(chunk_id) as i from generation_chunks group by all) b on a.doc_key = b.doc_key and a.k = b.k")
def _(spark, d):
    def side(t: str, h: str, p: str) -> DataFrame:
        k = F.concat_ws(":", "node_key", "node_local_ordinal")
        return load(spark, d, t).groupBy("doc_key", k.alias("k")).agg(F.max(h).alias(f"{p}h"), F.max("title").alias(f"{p}t"), F.min("chunk_id").alias(f"{p}i"))

    j = side("legacy_chunks", "legacy_body_sha256", "a").join(side("generation_chunks", "generation_body_sha256", "b"), ["doc_key", "k"], "full_outer")
    ne = lambda c: ~F.col(f"a{c}").eqNullSafe(F.col(f"b{c}"))
    return j.select("doc_key", "k", F.when(F.col("bi").isNull(), "missing").when(F.col("ai").isNull(), "added").when(ne("h") | ne("t"), "changed").when(ne("i"), "id-only").otherwise("same").alias("verdict"))


@query("agg_28_layer_partials", sql(f"select l.layer, count(distinct token) as tokens, count(*) as postings from p join (select doc_key, case when layer <= 5 then 0 when layer <= 9 then 1 else 2 end as layer from ({OWN}) union all select doc_key, 0 from (select distinct doc_key from c) where doc_key not in (select doc_key from ({OWN}))) l using (doc_key) group by l.layer", "p", "c"))
def _(spark, d):
    v = layered(spark, d)
    part = ix.token_stats(v.postings, "layer")
    return part.groupBy("layer").agg(F.count("*").alias("tokens"), F.sum("df_any").alias("postings"))


@query("set_03_ordered_union", sql(f"select chunk_id, array_to_string({first_seen('list_concat(tt, dt)')}, ' ') as tokens from ct", "ct"))
def _(spark, d):
    t = ix.with_tokens(once(spark, d))
    return t.select("chunk_id", F.array_join(F.array_distinct(F.concat("tt", "dt")), " ").alias("tokens"))


@query("lim_02_fixed_top_n", sql("select query_id, doc_key from docs5", "docs5"))
def _(spark, d):
    return rt.routed_documents(met(spark, d)).select("query_id", "doc_key")


@query("srt_01_stable_score_sort", sql("select query_id, chunk_id, row_number() over (partition by query_id order by score desc, ord, doc_key, local_id, chunk_id) as position from scored qualify position <= 100", "scored"))
def _(spark, d):
    s = rt.bm25f(met(spark, d), ix.index_of(spark, d))
    return rt.capped(s, 100, per_doc=None).select("query_id", "chunk_id", F.col("rank").alias("position"))


# Retrieval --------------------------------------------------------------------------------------------------------------



# Index ------------------------------------------------------------------------------------------------------------------


@query("idx_01_headings", sql(rf"select chunk_id, pos, length(regexp_extract(line, '^(#+)', 1)) as level, regexp_replace(regexp_replace(line, '^#{{1,6}}\s+', ''), '\s+#*\s*$', '') as title from (select *, sum(cast(f as int)) over (partition by chunk_id order by pos rows unbounded preceding) as k from (select *, regexp_matches(line, '^\s*(```|~~~)') as f from ({LINES}))) where k % 2 = 0 and not f and regexp_matches(line, '^#{{1,6}}\s+\S')", "c"))
def _(spark, d):
    lines = ck.lines_of(once(spark, d), "chunk_id", "body")
    return ck.headings(lines, "chunk_id").select("chunk_id", "pos", "level", "title")


@query("idx_02_duplicate_nodes", sql("select chunk_id, row_number() over (partition by doc_key, source_md, array_to_string(breadcrumb, '/') order by local_id, chunk_id) - 1 as duplicate_ordinal from c", "c"))
def _(spark, d):
    n = once(spark, d).select("chunk_id", "doc_key", F.col("source_md").alias("path"), F.concat_ws("/", "breadcrumb").alias("breadcrumb"), F.struct("local_id", "chunk_id").alias("pos"))
    return ck.node_keys(n).select("chunk_id", "duplicate_ordinal")


@query("idx_05_segment_postings", sql("select doc_key, token, count(*) as chunks, sum(title_tf + breadcrumb_tf + body_tf) as tf from p group by doc_key, token", "p"))
def _(spark, d):
    return ix.index_of(spark, d).postings.groupBy("doc_key", "token").agg(F.count("*").alias("chunks"), F.sum(F.expr("title_tf + breadcrumb_tf + body_tf")).alias("tf"))


@query("idx_08_base_build", sql("select token, df_any, df_nonbody, df_body from st", "st"))
def _(spark, d):
    return ly.base_view(once(spark, d)).token_stats()


@query("idx_22_compiled_postings", sql("select token, list(chunk_id order by chunk_id)[1] as first_chunk, count(*) as n, sum(title_tf) as t, sum(breadcrumb_tf) as b, sum(body_tf) as d from p group by token", "p"))
def _(spark, d):
    return ix.index_of(spark, d).postings.groupBy("token").agg(F.min("chunk_id").alias("first_chunk"), F.count("*").alias("n"), F.sum("title_tf").alias("t"), F.sum("breadcrumb_tf").alias("b"), F.sum("body_tf").alias("d"))


# Links --------------------------------------------------------------------------------------------------------------------


@query("lnk_07_canonical_ids", r"select distinct doc_key, starts_with(doc_key, doc_type || ':') and not regexp_matches(doc_key, '\s') as canonical from source_docs where doc_key is not null")
def _(spark, d):
    return load(spark, d, "source_docs").where("doc_key is not null").select("doc_key", (F.startswith("doc_key", F.concat("doc_type", F.lit(":"))) & ~F.col("doc_key").rlike(r"\s")).alias("canonical")).distinct()


@query("lnk_08_provenance", "select distinct j.doc_type || ':' || j.slug as source_id, t.tag as target_id from ingest_jobs j cross join lateral (select unnest(j.tags) as tag) t where t.tag in (select doc_type || ':' || slug from ingest_jobs)")
def _(spark, d):
    j = load(spark, d, "ingest_jobs").where("slug is not null").groupBy(F.concat_ws(":", "doc_type", "slug").alias("doc_id")).agg(F.array_distinct(F.flatten(F.collect_set("tags"))).alias("sources"))
    return lk.provenance(j).select("source_id", "target_id").distinct()


@query("lnk_10_content_fingerprint", "select doc_key, sha256(array_to_string(list_sort(files), chr(10))) as fingerprint from (select doc_key, arg_max(files, {'c': captured_at, 'a': arrived_at}) as files from source_docs where content_hash is not null group by doc_key)")
def _(spark, d):
    t = load(spark, d, "source_docs").where("content_hash is not null").groupBy("doc_key").agg(F.max_by("files", F.struct("captured_at", "arrived_at")).alias("files"))
    return t.select("doc_key", F.sha2(F.array_join(F.array_sort("files"), "\n"), 256).alias("fingerprint"))


@query("lnk_13_preview", sql(r"select doc_key as doc_id, title, substr(coalesce(list_filter(list_transform(regexp_split_to_array(coalesce(body, ''), '\n\s*\n'), lambda p: trim(array_to_string(list_transform(string_split(p, chr(10)), lambda x: trim(x, ' #>' || chr(9))), ' '))), lambda p: p <> '' and not regexp_matches(p, '^(\{\{<|<section|</)'))[1], ''), 1, 320) as preview from (select doc_key, h.t as title, h.b as body from (select doc_key, arg_min({'t': coalesce(breadcrumb[1], ''), 'b': body}, {'l': local_id, 'c': chunk_id}) as h from c group by doc_key))", "c"))
def _(spark, d):
    return catalog(spark, d).select("doc_id", "title", "preview")


@query("lnk_14_batch_resolve", f"select distinct source_id, raw, status from ({RESOLVED})")
def _(spark, d):
    targets = lk.parse_links(texts(spark, d)).select("source_id", "source_md", "raw", "target", "alias", "anchor", "line", "column", "syntax", "source_heading", "excerpt")
    return lk.resolve(targets, catalog(spark, d)).select("source_id", "raw", "status").distinct()


# Scalar functions ---------------------------------------------------------------------------------------------------------


@query("fn_01_strings", sql("select chunk_id, upper(substr(coalesce(title, ''), 1, 1)) as initial, length(coalesce(title, '')) as n, len(string_split(coalesce(body, ''), ' ')) as words, contains(coalesce(body, ''), 'the') as has_the from c", "c"))
def _(spark, d):
    t = F.coalesce("title", F.lit(""))
    return once(spark, d).select("chunk_id", F.upper(F.substring(t, 1, 1)).alias("initial"), F.length(t).alias("n"), F.size(F.split(F.coalesce("body", F.lit("")), " ")).alias("words"), F.contains(F.coalesce("body", F.lit("")), F.lit("the")).alias("has_the"))


@query("fn_02_unicode_nfc", "select distinct nfc_normalize(doc_key) as doc_key from source_docs where doc_key is not null")
def _(spark, d):
    return inc.nfc(load(spark, d, "source_docs").where("doc_key is not null").select("doc_key"), "doc_key").distinct()


@query("fn_05_arrays", sql("select chunk_id, list_position(dt, 'the') as first_the, len(list_distinct(dt)) as n, array_to_string(list_slice(list_sort(list_distinct(dt)), 1, 3), ' ') as least from ct", "ct"))
def _(spark, d):
    t = once(spark, d).select("chunk_id", T.tokenize(F.col("body")).alias("dt"))
    pos = F.array_position("dt", "the")
    return t.select("chunk_id", F.when(pos > 0, pos).alias("first_the"), F.size(F.array_distinct("dt")).alias("n"), F.array_join(F.slice(F.array_sort(F.array_distinct("dt")), 1, 3), " ").alias("least"))


@query("fn_09_iso_dates", "select distinct job_id, updated_at, strftime(updated_at, '%Y-%m-%d') as iso from ingest_jobs")
def _(spark, d):
    return load(spark, d, "ingest_jobs").select("job_id", "updated_at", F.date_format("updated_at", "yyyy-MM-dd").alias("iso")).distinct()


@query("api_snapshot_info", sql("select documents, n as chunks from tot", "tot"))
def _(spark, d):
    i = ix.index_of(spark, d)
    return spark.createDataFrame([(int(i.totals["documents"]), i.n)], "documents bigint, chunks bigint")


# SQL of queries defined before the parts it needs -----------------------------------------------------------------------

from .core_queries import SQL as _CORE  # noqa: E402
from .reference_queries import SQL  # noqa: E402

STATUS = "select doc_type || ':' || slug as doc_id, arg_max(status, {'u': updated_at, 's': status}) as s from ingest_jobs where slug is not null group by doc_type, slug"
NEAR = f"select doc_id, neighbor, case when bool_or(o) and bool_or(i) then 0 when bool_or(o) then 1 else 2 end as priority from (select source_id as doc_id, doc_id as neighbor, true as o, false as i from ({BACK}) union all select doc_id, source_id, false, true from ({BACK})) group by all"
SHOWN = f"select doc_id, neighbor, priority, row_number() over (partition by doc_id order by priority, neighbor) as n from (select x.* from ({NEAR}) x left join ({STATUS}) s on x.neighbor = s.doc_id where coalesce(s.s, 'draft') <> 'failed') qualify n <= 40"
LAST = f"select source_id, target_id, arg_max({{'line': line, 'raw': raw}}, {{'m': source_md, 'l': line, 'r': raw}}) as x from ({RESOLVED}) where status = 'resolved' group by all"

SQL |= {
    "idx_09_change_set": _CORE["p5_found"][: _CORE["p5_found"].index("select n.doc_key, case when")] + "select coalesce(n.doc_key, b.doc_key) as doc_key, case when b.doc_key is null then 'added' when n.doc_key is null then 'deleted' when n.c is not distinct from b.c and n.r is not distinct from b.r then 'unchanged' else 'changed' end as change from (select * from now where rn = 1 and not del) n full join (select * from built where rn = 1) b on n.doc_key = b.doc_key",
    "lnk_04_resolve": RESOLVED,
    "lnk_05_catalog": f"select p.doc_id, split_part(p.doc_id, ':', 1) as doc_type, substr(p.doc_id, instr(p.doc_id, ':') + 1) as slug, title, [regexp_replace(substr(p.doc_id, instr(p.doc_id, ':') + 1), '-\\d+$', ''), split_part(p.doc_id, ':', 1) || ':' || regexp_replace(substr(p.doc_id, instr(p.doc_id, ':') + 1), '-\\d+$', '')] as aliases, case when s = 'failed' then 'archived' when s = 'done' then 'reviewed' else 'draft' end as status, preview from ({SQL['lnk_13_preview']}) p left join ({STATUS}) t on p.doc_id = t.doc_id",
    "lnk_09_link_index": f"select source_id, count(*) as links, count(*) filter (status = 'resolved') as outgoing from ({RESOLVED}) group by source_id",
    "lnk_11_backlinks": f"select b.doc_id, source_id, occurrences, coalesce(s = 'failed', false) as archived from ({BACK}) b left join ({STATUS}) t on b.source_id = t.doc_id",
    "lnk_12_neighborhood": SHOWN,
    "lnk_12_shown_edges": f"select distinct n.doc_id, source_id, target_id, 'explicit' as relation, x.line as line, x.raw as raw from ({LAST}) e join ({SHOWN}) n on (e.source_id = n.doc_id and e.target_id = n.neighbor) or (e.target_id = n.doc_id and e.source_id = n.neighbor)",
    "lnk_16_heading_map": sql(f"select doc_key as doc_id, {KEY_OF} as key, arg_min(node_id, {{'l': local_id, 'c': chunk_id}}) as node_id from c where coalesce(trim(title), '') <> '' group by all", "c"),
    "src_08_page_ranges": "select distinct job_id, updated_at, len(l) as n_pages, l[1] as first_page from (select job_id, updated_at, case when coalesce(pages, '') = '' then range(400) else list_sort(list_distinct(flatten(list_transform(string_split(pages, ','), lambda p: range(greatest(1, cast(split_part(p, '-', 1) as int)) - 1, least(400, cast(case when contains(p, '-') then split_part(p, '-', 2) else p end as int))))))) end as l from ingest_jobs)",
}

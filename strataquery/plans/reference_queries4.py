"""Queries over real files, stores and builds, and over damaged indexes; each with its SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Library
from ..functions.normalize import lookup_key
from ..operators import index as ix
from ..operators import layers as ly
from ..operators import links as lk
from ..operators import retrieval as rt
from ..session import cut, load, scratch
from ..sources import files as fs
from ..sources import snapshots as snaps
from .reference_queries import SQL, judged, once, query
from .reference_queries2 import DOCS, KEY_OF, PARSED, QUERIES_PRJ5, WIKI, catalog, edges, run_layers, texts
from .reference_queries3 import resolved
from .sql_parts import bc, half_up, sql, tok

# A tree of files -----------------------------------------------------------------------------------------------------------


def tree(spark: SparkSession, d: str) -> str:
    """Every chunk as a note: notes/<chunk_id>.md below a new folder."""
    root = scratch(spark, "tree")
    fs.write_tree(once(spark, d).select(F.concat(F.lit("notes/"), "chunk_id", F.lit(".md")).alias("path"), F.coalesce("body", F.lit("")).alias("text")), root)
    return root


def below(root: str, path: str = "path"):
    """A path relative to the tree."""
    return F.substring(path, len(root) + 2, 1 << 20)


NOTE = "'notes/' || chunk_id || '.md'"
BODY = "sha256(coalesce(body, ''))"


@query("src_02_file_fingerprint", sql(f"select {NOTE} as path, {BODY} as sha256, octet_length(encode(coalesce(body, ''))) as length from c", "c"))
def _(spark, d):
    root = tree(spark, d)
    return fs.file_records(fs.read_tree(spark, root)).select(below(root).alias("path"), "sha256", "length")


def additive(value: str) -> str:
    """SQL of multiset_hash."""
    parts = ", ".join(f"cast(sum(cast('0x' || substr(sha256({value}), {1 + 12 * i}, 12) as hugeint)) as varchar)" for i in range(5))
    return f"sha256(concat_ws(',', cast(count(*) as varchar), {parts}))"


@query("src_03_document_fingerprint", sql("select 'note:' || chunk_id as doc_key, " + additive("'{\"path\":\"/' || " + NOTE + " || '\",\"sha256\":\"' || " + BODY + " || '\"}'") + " as content_hash from c group by chunk_id", "c"))
def _(spark, d):
    root = tree(spark, d)
    records = fs.file_records(fs.read_tree(spark, root)).withColumn("path", F.concat(F.lit("/"), below(root)))
    return fs.document_fingerprints(fs.discover(records), records).select("doc_key", "content_hash")


@query("src_04_stable_snapshot", sql(f"select {NOTE} as path, {BODY} as sha256, 1 as tries from c", "c"))
def _(spark, d):
    root = tree(spark, d)
    return fs.stable_records(spark, root).select(below(root).alias("path"), "sha256", "tries")


@query("src_05_snapshot_cache", sql(f"select {NOTE} as path, {BODY} as sha256, title is not null as reused from c", "c"))
def _(spark, d):
    """The cache knows the files of chunks that have a title."""
    root = tree(spark, d)
    known = once(spark, d).where("title is not null").select(F.concat(F.lit(f"{root}/notes/"), "chunk_id", F.lit(".md")).alias("path"))
    cache = cut(fs.cached_records(fs.list_tree(spark, root), spark.createDataFrame([], "path string, length bigint, modificationTime timestamp, sha256 string")).join(known, "path", "left_semi").drop("reused"))
    return fs.cached_records(fs.list_tree(spark, root), cache).select(below(root).alias("path"), "sha256", "reused")


SEGMENTS = "select distinct doc_key, content_hash, segment_recipe_hash, path as payload, run_id from segment_refs"
CLEAR = f"select doc_key, content_hash, segment_recipe_hash, min(run_id) as run_id, min(payload) as payload from ({SEGMENTS}) group by doc_key, content_hash, segment_recipe_hash having count(distinct payload) = 1"


@query("src_12_segment_store", f"select doc_key, content_hash, segment_recipe_hash, sha256(payload) as segment_hash, run_id <= 5 as reused from ({CLEAR})")
def _(spark, d):
    """Segments of the first runs are stored, then those of all: what is there is reused; keys with two payloads are conflicts and left out of both."""
    s = load(spark, d, "segment_refs").select("doc_key", "content_hash", "segment_recipe_hash", F.col("path").alias("payload"), "run_id").distinct()
    clear = s.groupBy("doc_key", "content_hash", "segment_recipe_hash").agg(F.count_distinct("payload").alias("n")).where("n = 1").drop("n")
    rows = cut(snaps._by_key(s, clear, "left_semi"))
    store = snaps.SegmentStore(spark, scratch(spark, "segments"))
    store.put(rows.where("run_id <= 5"))
    told, _ = store.put(rows)
    return told


@query("src_12_segment_conflicts", "select doc_key, content_hash, segment_recipe_hash, count(distinct sha256(path)) as hashes from segment_refs group by all having count(distinct path) > 1")
def _(spark, d):
    s = load(spark, d, "segment_refs").select("doc_key", "content_hash", "segment_recipe_hash", F.col("path").alias("payload"))
    return snaps.SegmentStore(spark, scratch(spark, "segments")).put(s)[1]


# Heads of files ----------------------------------------------------------------------------------------------------------------

JOBS = "select distinct on (job_id) * from ingest_jobs order by job_id, updated_at desc, status desc"


def heads(spark: SparkSession, d: str) -> str:
    """The newest state of every job as a note with a head: jobs without strategy have no head, failed ones none that ends."""
    j = load(spark, d, "ingest_jobs").groupBy("job_id").agg(F.max_by(F.struct("title", "author", "strategy", "status", "tags", "pages"), F.struct("updated_at", "status")).alias("j")).select("job_id", "j.*")
    line = lambda k, v: F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v, F.lit("\n"))).otherwise(F.lit(""))
    status = F.when(F.col("status") == "done", "reviewed").when(F.col("status") == "failed", "gone").otherwise(F.lit(None).cast("string"))
    conf = F.when(F.col("author").isNull(), "0.25").when(F.col("pages").isNull(), "1.5")
    meta = F.concat(line("id", F.col("job_id")), line("title", F.col("author")), line("status", status), line("confidence", conf), F.lit("source: ["), F.array_join("tags", ", "), F.lit("]\n"))
    text = F.when(F.col("strategy").isNull(), F.lit("text")).when(F.col("pages") == "1-3", F.concat(F.lit("---\n"), meta, F.lit("text"))).otherwise(F.concat(F.lit("---\n"), meta, F.lit("---\ntext")))
    root = scratch(spark, "heads")
    fs.write_tree(j.select(F.concat(F.lit("notes/"), "job_id", F.lit(".md")).alias("path"), text.alias("text")), root)
    return root


def front(spark: SparkSession, root: str) -> DataFrame:
    return fs.parse_frontmatter(fs.read_tree(spark, root).select(below(root).alias("path"), F.decode("content", "UTF-8").alias("text")))


_HEADED = f"select *, 'notes/' || job_id || '.md' as path, strategy is not null and coalesce(pages, '') <> '1-3' as headed, case status when 'done' then 'reviewed' when 'failed' then 'gone' end as st, case when author is null then 0.25 when pages is null then 1.5 end as conf from ({JOBS})"


@query("lnk_06_governance", f"select path, case when headed then coalesce(st, 'draft') else 'draft' end as status, case when headed then cast(conf as double) end as confidence, case when headed then len(tags) else 0 end as sources, case when headed and st = 'gone' then 'status' when headed and conf > 1 then 'confidence' end as problem from ({_HEADED})")
def _(spark, d):
    g = fs.governance(front(spark, heads(spark, d)))
    return g.select("path", "status", "confidence", F.size(F.filter("sources", lambda s: s != "")).alias("sources"), "problem")


@query("snk_06_migration", f"select path, list_filter(['id', 'title', 'status'], lambda k: not headed or (k = 'title' and author is null) or (k = 'status' and st is null)) as missing, [] as missing_after, true as backed_up from ({_HEADED}) where (strategy is null or headed) and (not headed or author is null or st is null)")
def _(spark, d):
    """Missing keys are written into the files, after copies of them; then the files are read again."""
    root, backup = heads(spark, d), scratch(spark, "backup")
    stem = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    done = fs.migrate(spark, root, backup, {"id": stem, "title": stem, "status": F.lit("draft")})
    now = front(spark, root).where("error is null").select("path", F.filter(F.array(*map(F.lit, ("id", "title", "status"))), lambda k: F.element_at("meta", k).isNull()).alias("missing_after"))
    kept = fs.list_tree(spark, backup).select(below(backup).alias("path"), F.lit(True).alias("b"))
    return done.join(now, "path").join(kept, "path", "left").select("path", "missing", "missing_after", F.coalesce("b", F.lit(False)).alias("backed_up"))


# Builds ----------------------------------------------------------------------------------------------------------------------


def early(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of documents that no run after the fifth has built."""
    late = ly.owners(run_layers(spark, d)).where("layer > 5").select("doc_key")
    return once(spark, d).join(late, "doc_key", "left_anti")


LATE = "select doc_key from segment_refs where run_id in (select run_id from build_runs where status = 'succeeded') group by doc_key having max(run_id) > 5"


@query("idx_10_no_op", sql(f"select 'base' as first, 'no_op' as second, case when (select count(*) from c where doc_key in ({LATE})) > 0 then 'delta' else 'no_op' end as third, (select count(distinct doc_key) from c) as documents, (select count(*) from c) as chunks", "c"))
def _(spark, d):
    """Three builds of one library: of some documents, of the same again, of all."""
    lib = Library(spark, scratch(spark, "library"))
    some = early(spark, d)
    told = [lib.build(some), lib.build(some), lib.build(once(spark, d), compact=False)]
    info = lib.snapshot_info()
    return spark.createDataFrame([(*told, info["documents"], info["total_chunks"])], "first string, second string, third string, documents bigint, chunks bigint")


@query("idx_11_delta_build", sql("select * from st", "st"))
def _(spark, d):
    """A base, and a delta of the documents built late: the sum of their statistics is that of all chunks."""
    lib = Library(spark, scratch(spark, "library"))
    lib.build(early(spark, d))
    lib.build(once(spark, d), compact=False)
    return lib.index().stats


@query("agg_18_compaction_rule", "with t as (select distinct segment_hash, run_id, byte_size from segment_refs), r as (select run_id, sum(byte_size) as b from t group by run_id) select count(*) as layers, count(*) > 33 or (select sum(b) from r where run_id > (select min(run_id) from r)) * 5 >= (select b from r where run_id = (select min(run_id) from r)) as due from r")
def _(spark, d):
    """The rule of the library's builds, on what the runs wrote; one row a run."""
    t = load(spark, d, "segment_refs").select("segment_hash", "run_id", "byte_size").distinct()
    sizes = [int(r["b"]) for r in t.groupBy("run_id").agg(F.sum("byte_size").alias("b")).orderBy("run_id").collect()]
    return spark.createDataFrame([(len(sizes), ly.compaction_due(sizes))], "layers bigint, due boolean")


GENERATION = f"with own as (select doc_key, max(run_id) as layer from segment_refs where run_id in (select run_id from build_runs where status = 'succeeded') group by doc_key), s as (select doc_key, max(segment_hash) as segment_hash from segment_refs join own using (doc_key) where run_id = layer group by doc_key) select count(*) as documents, {additive('doc_key || chr(10) || segment_hash')} as generation from s"


@query("idx_13_generation_id", GENERATION)
def _(spark, d):
    own = ly.owners(run_layers(spark, d))
    s = load(spark, d, "segment_refs").select("doc_key", F.col("run_id").alias("layer"), "segment_hash").distinct().join(own, ["doc_key", "layer"]).groupBy("doc_key").agg(F.max("segment_hash").alias("segment_hash"))
    return ly.generation_id(s)


# Damaged indexes ----------------------------------------------------------------------------------------------------------------


def damaged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings, chunks and statistics in which five things are wrong."""
    i = ix.index_of(spark, d)
    wrong = i.postings.withColumn("len_breadcrumb", F.when(F.col("breadcrumb_tf") > 1, F.lit(1)).otherwise(F.col("len_breadcrumb"))).where("token <> 'model'")
    twice = i.postings.where("token = 'field'")
    empty = i.postings.where("token = 'phase'").withColumns({"token": F.lit("zzempty"), "title_tf": F.lit(0), "breadcrumb_tf": F.lit(0), "body_tf": F.lit(0)})
    return wrong.unionByName(twice).unionByName(empty), i.chunks.where("title is not null"), i.stats.withColumn("df_body", F.when(F.col("token") == "lattice", F.col("df_body") + 1).otherwise(F.col("df_body")))


_BROKEN = "(select *, case when breadcrumb_tf > 1 then 1 else len_breadcrumb end as lb from p where token <> 'model')"
_RULES = f"""select 'posting without a frequency' as rule, count(*) as n from p where token = 'phase'
union all select 'frequency over field length', count(*) from (select * from {_BROKEN} union all select *, len_breadcrumb from p where token = 'field') where breadcrumb_tf > lb
union all select 'posting of an unknown chunk', count(*) from (select chunk_id from p where token <> 'model' union all select chunk_id from p where token in ('field', 'phase')) where chunk_id in (select chunk_id from c where title is null)
union all select 'token twice in a chunk', count(*) from p where token = 'field'"""


@query("idx_15_validate_normal", sql(f"select * from ({_RULES}) where n > 0", "p", "c"))
def _(spark, d):
    """What the invariants show of a damaged index."""
    return ly.validate(*damaged(spark, d))


@query("idx_15_validate_deep", sql("select 'posting missing' as rule, count(*) as n from p where token = 'model' having count(*) > 0 union all select 'posting changed', count(*) from p where token = 'field' having count(*) > 0 union all select 'posting in excess', count(*) from p where token = 'phase' having count(*) > 0 union all select 'statistics changed', count(*) from st where token = 'lattice' having count(*) > 0 union all select 'posting without a frequency', count(*) from p where token = 'phase' having count(*) > 0 union all select 'frequency over field length', count(*) from p where token = 'field' having count(*) > 0", "p", "st"))
def _(spark, d):
    """Everything made anew beside an index that lacks a token, has one too many, and wrong numbers for two others."""
    i = ix.index_of(spark, d)
    posts = i.postings.where("token <> 'model'").withColumn("title_tf", F.when(F.col("token") == "field", F.col("len_title") + 1).otherwise(F.col("title_tf")))
    empty = i.postings.where("token = 'phase'").withColumns({"token": F.lit("zzempty"), "title_tf": F.lit(0), "breadcrumb_tf": F.lit(0), "body_tf": F.lit(0)})
    stats = i.stats.withColumn("df_body", F.when(F.col("token") == "lattice", F.col("df_body") + 1).otherwise(F.col("df_body")))
    return ly.validate(posts.unionByName(empty), i.chunks, stats, "deep")


@query("idx_15_validate_sound", sql("select 'x' as rule, 1 as n from c where false", "c"))
def _(spark, d):
    i = ix.index_of(spark, d)
    return ly.validate(i.postings, i.chunks, i.stats, "sampled")


@query("ret_30_df_consistency", sql("select token, df_any - 1 as found, df_any as expected from (select token, case when token like 'm%' then df_any + 1 else df_any end as df_any, df_any as was, df_body, df_nonbody from st), tot where token like 'm%' and not (df_body >= 256 and df_body * 10 >= n * 9)", "st", "tot"))
def _(spark, d):
    """Tokens whose visible postings are not as many as their effective document frequency, of an index where those of some tokens are off by one."""
    i = ix.index_of(spark, d)
    stats = i.stats.withColumn("df_any", F.when(F.col("token").startswith("m"), F.col("df_any") + 1).otherwise(F.col("df_any")))
    e = stats.select("token", ix.is_pruned(i.n).alias("h"), ix.effective_df(i.n).alias("expected"))
    per = i.postings.groupBy("token").agg(F.count("*").alias("any"), F.count_if(F.expr("title_tf + breadcrumb_tf > 0")).alias("nonbody"))
    found = F.when(F.col("h"), F.col("nonbody")).otherwise(F.col("any"))
    return per.join(e, "token").select("token", found.alias("found"), "expected").where("found <> expected")


# Links, palette, truncation -----------------------------------------------------------------------------------------------------


@query("lnk_02_lookup_keys", sql(f"select chunk_id, {KEY_OF} as key from c where title is not null", "c"))
def _(spark, d):
    return once(spark, d).where("title is not null").select("chunk_id", lookup_key(F.col("title")).alias("key"))


@query("lnk_03_path_targets", f"select source_md, raw, path from ({resolved(PARSED, 'l.path,')})")
def _(spark, d):
    return lk.parse_links(texts(spark, d)).select("source_md", "raw", lk.path_target(F.col("target")).alias("path"))


ANCHOR = r"nullif(trim(case when l.raw like '[[%' then case when contains(split_part(l.raw, '|', 1), '#') then regexp_replace(substr(split_part(l.raw, '|', 1), instr(split_part(l.raw, '|', 1), '#') + 1), '\]\]$', '') end else regexp_extract(l.raw, '\]\([^)#\s]*#([^)\s]*)', 1) end), '')"


@query("join_09_anchor_headings", f"select source_md, line, raw, target_id, h.node_id as target_node_id from (select *, {KEY_OF.replace('title', 'anchor')} as akey from ({resolved(PARSED, ANCHOR + ' as anchor,')}) where anchor is not null) x left join ({SQL['lnk_16_heading_map']}) h on h.doc_id = x.target_id and h.key = x.akey")
def _(spark, d):
    return edges(spark, d).where("anchor is not null").select("source_md", "line", "raw", "target_id", "target_node_id")


EVERY = sql(rf"select distinct doc_key as source_id, chunk_id as source_md, 0 as line, m as raw from (select doc_key, chunk_id, unnest(regexp_extract_all(coalesce(body, ''), '{WIKI}', 1)) as m from c)", "c")
SELF = EVERY.replace("coalesce(body, '')", "coalesce(body, '') || chr(10) || '[[' || doc_key || '|here]]'")


@query("snk_05_export", f"select target_id, count(distinct source_md) as texts from ({resolved(SELF, '')}) where status = 'resolved' group by target_id")
def _(spark, d):
    """A library, each text with a link to its own document, written as Markdown files; counted are the texts that link to a document in what was written."""
    root = scratch(spark, "export")
    rows = texts(spark, d).join(once(spark, d).select(F.col("chunk_id").alias("source_md"), F.col("local_id").alias("place")), "source_md")
    marked = rows.withColumn("text", F.concat(F.lit("\u0001"), "source_md", F.lit("\u0002"), F.regexp_replace(F.coalesce("text", F.lit("")), "\n", "\u0003"), F.lit("\u0003[["), "source_id", F.lit("|here]]")))
    lk.export_files(marked, catalog(spark, d), root)
    lines = spark.read.text(f"{root}/content").select(F.regexp_extract("value", "\u0001([^\u0002]*)\u0002", 1).alias("source_md"), F.array_distinct(F.regexp_extract_all("value", F.lit(r'\]\(doc://([^#) ]+)[^)]*\)'), F.lit(1))).alias("t"))
    return lines.where("source_md <> ''").select("source_md", F.explode("t").alias("target_id")).groupBy("target_id").agg(F.count_distinct("source_md").alias("texts"))


@query("snk_05_export_diagnostics", f"select source_md, raw, status, candidates from ({resolved(EVERY, '')}) where status <> 'resolved'")
def _(spark, d):
    links = lk.resolve(lk.wikilinks(texts(spark, d)), catalog(spark, d))
    return links.where("status <> 'resolved'").select("source_md", "raw", "status", "candidates")


PALETTE = r"select distinct query_id, w from (select query_id, unnest(list_concat(regexp_extract_all(lower(query), '[a-z0-9]{2,}'), regexp_extract_all(query, '[一-鿿]{2,}'))) as w from judged_queries)"


@query("flt_07_palette", sql(f"select query_id, w, doc_key, score from (select *, row_number() over (partition by query_id, w order by score desc, doc_key) as n from (select query_id, w, doc_key, case when starts_with(t, w) then 3 when contains(t, w) then 2 when contains(k, w) then 1 else 0 end as score from ({PALETTE}), (select doc_key, lower(title) as t, lower(doc_key) as k from ({DOCS}))) where score > 0) where n <= 50", "c"))
def _(spark, d):
    """For every word of every query: a prefix of the title 3, inside the title 2, inside the key 1; the first 50. Candidates share the word's first letters (up to four; of Chinese two)."""
    q = judged(spark, d).select("query_id", F.explode(F.concat(F.regexp_extract_all(F.lower("query"), F.lit("[a-z0-9]{2,}"), F.lit(0)), F.regexp_extract_all("query", F.lit("[一-鿿]{2,}"), F.lit(0)))).alias("w")).distinct()
    docs = QUERIES_PRJ5(spark, d).select("doc_key", F.lower("title").alias("t"), F.lower("doc_key").alias("k"))
    both = F.concat_ws("\n", "t", "k")
    grams = F.array_distinct(F.concat(*(F.regexp_extract_all(both, F.lit(f"(?=([a-z0-9]{{{n}}}))"), F.lit(1)) for n in (2, 3, 4)), F.regexp_extract_all(both, F.lit("(?=([一-鿿]{2}))"), F.lit(1))))
    head = F.substring("w", F.lit(1), F.when(F.col("w").rlike("^[一-鿿]"), 2).otherwise(F.least(F.lit(4), F.length("w"))))
    pairs = docs.withColumn("g", F.explode(grams)).join(F.broadcast(q.withColumn("g", head)) if rt.at_most(q, rt.BATCH) else q.withColumn("g", head), "g")
    score = F.when(F.startswith(F.col("t"), F.col("w")), 3).when(F.contains(F.col("t"), F.col("w")), 2).when(F.contains(F.col("k"), F.col("w")), 1).otherwise(0)
    scored = pairs.select("query_id", "w", "doc_key", score.alias("score")).where("score > 0").withColumn("rrf_score", F.col("score"))
    return rt.capped(scored.withColumn("query_id", F.struct("query_id", "w")), 50, [F.desc("score"), F.asc("doc_key")], None).select("query_id.query_id", "query_id.w", "doc_key", "score")


_PREFIX = "array_to_string(list_slice({x}, 1, list_max(list_append(list_filter(range(1, least(len({x}), 400) + 1), lambda i: length(array_to_string(list_slice({x}, 1, i), {gap})) <= 400), 0))), {gap})"


@query("ret_28_boundary_truncation", f"select doc_id, case when length(t) <= 400 then t when {_PREFIX.format(x='ps', gap='chr(10)')} <> '' then {_PREFIX.format(x='ps', gap='chr(10)')} when {_PREFIX.format(x='ss', gap=chr(39) * 2)} <> '' then {_PREFIX.format(x='ss', gap=chr(39) * 2)} else substr(t, 1, 400) end as text from (select doc_id, t, list_filter(regexp_split_to_array(t, '\\n+'), lambda p: trim(p) <> '') as ps, list_filter(regexp_extract_all(t, '[^。！？；!?]*[。！？；!?]|[^。！？；!?]+$'), lambda p: trim(p) <> '') as ss from (select doc_id, coalesce(text, '') as t from documents))")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", rt.truncated(F.col("text"), 400).alias("text"))


# The library as an object, streams, sorts ---------------------------------------------------------------------------------------

_LIBRARIES: dict = {}


def library(spark: SparkSession, d: str) -> Library:
    """A library of all chunks, built once a session and state of the table."""
    key = ix.stamp(spark, d, "chunks")
    if key not in _LIBRARIES:
        _LIBRARIES.clear()
        _LIBRARIES[key] = Library(spark, scratch(spark, "library"))
        _LIBRARIES[key].build(load(spark, d, "chunks"))
    return _LIBRARIES[key]


@query("api_search", sql("select query_id, rank, doc_key, chunk_id, title, coalesce(array_to_string(breadcrumb, ' > '), '') as breadcrumb, body as text, score from (select h.query_id, row_number() over (partition by h.query_id order by rank) as rank, h.doc_key, chunk_id, c.title, c.breadcrumb, c.body, h.score from hitlist h join c using (chunk_id) where rank <= 20)", "hitlist", "c"))
def _(spark, d):
    return library(spark, d).search(judged(spark, d), 20)


@query("api_list_documents", sql(f"select doc_key, doc_type, substr(doc_key, instr(doc_key, ':') + 1) as slug, title, chunks from ({DOCS})", "c"))
def _(spark, d):
    return library(spark, d).list_documents()


@query("api_read_document", sql("select chunk_id, doc_key, local_id, title, body from c where doc_key = (select min(doc_key) from c)", "c"))
def _(spark, d):
    lib = library(spark, d)
    return lib.read_document(lib.list_documents().agg(F.min("doc_key")).first()[0]).select("chunk_id", "doc_key", "local_id", "title", "body")


@query("src_15_json_stream", sql("select doc_key, count(*) as chunks, sum(length(coalesce(body, ''))) as characters from c group by doc_key", "c"))
def _(spark, d):
    """Chunks written as JSON lines and read again as a stream, a file a trigger at most a few at once; counted as they come."""
    root = scratch(spark, "stream")
    snaps.export_json(once(spark, d).select("doc_key", "body"), f"{root}/in")
    rows = spark.readStream.schema("doc_key string, body string").option("maxFilesPerTrigger", 4).json(f"{root}/in")

    def keep(batch: DataFrame, number: int) -> None:
        batch.groupBy("doc_key").agg(F.count("*").alias("chunks"), F.sum(F.length(F.coalesce("body", F.lit("")))).alias("characters")).write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    rows.writeStream.foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("doc_key").agg(F.sum("chunks").alias("chunks"), F.sum("characters").alias("characters"))


@query("stream_index_maintenance", sql("select * from st", "st"))
def _(spark, d):
    """Statistics kept by a stream to which every chunk comes twice, first with another body: the second takes the first back."""
    from ..streaming import incremental as si

    root = scratch(spark, "maintained")
    rows = once(spark, d)
    rows.withColumn("body", F.lit("an earlier body")).write.parquet(f"{root}/in")
    si.maintain(spark, f"{root}/in", rows.schema, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    rows.write.mode("append").parquet(f"{root}/in")
    si.maintain(spark, f"{root}/in", rows.schema, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return si.view_statistics(spark, f"{root}/out")


@query("srt_02_external_sort", sql("select chunk_id, row_number() over (order by coalesce(title, ''), chunk_id) as position from c", "c"))
def _(spark, d):
    """All chunks in one order by title: range partitions, each sorted with spilling, and numbered without gathering."""
    from ..operators.numbering import numbered

    n = numbered(once(spark, d).select("chunk_id", F.coalesce("title", F.lit("")).alias("t")), [], ["t", "chunk_id"], "i")
    return n.select("chunk_id", (F.col("i") + 1).alias("position"))


# Books, published documents, citations, codes ---------------------------------------------------------------------------------------


@query("src_09_epub_chapters", f"select 'books/' || job_id || '.epub' as path, n - 1 as position, case when n = 1 then coalesce(author, 'none') end as title, case when n = 1 then '# ' || coalesce(author, 'none') || chr(10) || chr(10) || status else '- ' || tags[n - 1] end as text from (select *, unnest(range(1, len(coalesce(tags, [])) + 2)) as n from ({JOBS}))")
def _(spark, d):
    """Every job as a book, written as EPUB and read again: a page with its author, and one for each tag."""
    from ..sources.books import epub_bytes, read_epubs

    j = load(spark, d, "ingest_jobs").groupBy("job_id").agg(F.max_by(F.struct("author", "status", "tags"), F.struct("updated_at", "status")).alias("j")).select("job_id", F.coalesce("j.author", F.lit("none")).alias("author"), "j.status", F.coalesce("j.tags", F.array().cast("array<string>")).alias("tags"))

    @F.pandas_udf("binary")
    def book(author: pd.Series, status: pd.Series, tags: pd.Series) -> pd.Series:
        return pd.Series([epub_bytes(a, [f"<h1>{a}</h1><p>{s}</p>", *(f"<ul><li>{t}</li></ul>" for t in ts)]) for a, s, ts in zip(author, status, tags)])

    files = j.select(F.concat(F.lit("books/"), "job_id", F.lit(".epub")).alias("path"), book("author", "status", "tags").alias("content"))
    return read_epubs(files).select("path", "position", "title", "text")


@query("snk_07_publish_documents", f"select doc_type || ':' || slug as doc_key, coalesce(nullif(title, ''), slug) as title, author, len(coalesce(tags, [])) as tags from (select distinct on (doc_type, slug) * from ingest_jobs where slug is not null and doc_type in ('paper', 'note') order by doc_type, slug, updated_at desc, status desc, job_id desc)")
def _(spark, d):
    """The newest state of each paper and note, published into a content tree, discovered and parsed."""
    j = load(spark, d, "ingest_jobs").where("slug is not null and doc_type in ('paper', 'note')").groupBy("doc_type", "slug").agg(F.max_by(F.struct("title", "author", "tags"), F.struct("updated_at", "status", "job_id")).alias("j"))
    root = scratch(spark, "content")
    fs.publish_documents(j.select("doc_type", "slug", "j.*", F.lit("text").alias("text")), root)
    files = fs.read_tree(spark, root)
    docs = fs.discover(files).select("doc_key", F.explode("files").alias("path"))
    meta = fs.parse_frontmatter(files.select("path", F.decode("content", "UTF-8").alias("text")))
    tags = F.when(F.element_at("meta", "tags").isNull(), 0).otherwise(F.size(F.split(F.element_at("meta", "tags"), "\x1f")))
    return docs.join(meta, "path").select("doc_key", F.element_at("meta", "title").alias("title"), F.element_at("meta", "author").alias("author"), tags.alias("tags"))


@query("lnk_19_citations", sql("select chunk_id, '[1] [' || title || '](/read/a/b)' || chr(10) || 'see [2](/read/c) and `[2]` or [9], ' || length(title) || chr(10) || '```' || chr(10) || '[1] code' || chr(10) || '```' as text from c where title is not null and title <> '' and not regexp_matches(title, '[`\\[\\]\\n]|^\\s|\\s$')", "c"))
def _(spark, d):
    c = once(spark, d).where(F.col("title").isNotNull() & (F.col("title") != "") & ~F.col("title").rlike(r"[`\[\]\n]|^\s|\s$"))
    text = F.concat(F.lit("[1] "), "title", F.lit("\nsee [2](old) and `[2]` or [9], "), F.length("title").cast("string"), F.lit("\n```\n[1] code\n```"))
    urls = F.create_map(F.lit(1), F.lit("/a/b"), F.lit(2), F.lit("c"))
    return c.select("chunk_id", lk.cited(text, urls, "/read").alias("text"))


_BYTES = "list_transform(range(greatest(1, cast(ceil(length(bin({0})) / 7) as bigint))), lambda i: (({0} >> (7 * i)) & 127) + case when i < greatest(1, cast(ceil(length(bin({0})) / 7) as bigint)) - 1 then 128 else 0 end)"


@query("fn_10_varint", sql(f"select chunk_id, n, upper(array_to_string(list_transform({_BYTES.format('n')}, lambda b: lpad(hex(b), 2, '0')), '')) as encoded, n as decoded from (select chunk_id, cast(length(coalesce(body, '')) as bigint) * length(coalesce(body, '')) * 1000003 as n from c)", "c"))
def _(spark, d):
    from ..functions.varint import decode_varint, encode_varint

    n = F.length(F.coalesce("body", F.lit(""))).cast("bigint")
    rows = once(spark, d).select("chunk_id", (n * n * 1000003).alias("n")).withColumn("e", encode_varint(F.col("n")))
    return rows.select("chunk_id", "n", F.hex("e").alias("encoded"), decode_varint(F.col("e")).alias("decoded"))


# Diversity ------------------------------------------------------------------------------------------------------------------------

from .reference_queries import SH  # noqa: E402

_SIM = "case when len(a.sh) > 0 and len(b.sh) > 0 then len(list_intersect(a.sh, b.sh)) / (len(a.sh) + len(b.sh) - len(list_intersect(a.sh, b.sh))) else 0 end"
SQL["ret_19_mmr"] = f"""with recursive x as materialized (select r.query_id, row_number() over (partition by r.query_id order by rerank_score desc, rank) as ord, r.chunk_id, rerank_score as s, sh from ({SQL['ret_14_lexical_rerank']}) r join ({sql(f"select chunk_id, {SH('dt')} as sh from ct", "ct")}) using (chunk_id)),
pairs as materialized (select a.query_id, a.ord as o1, b.ord as o2, {_SIM} as sim from x a join x b on a.query_id = b.query_id and a.ord <> b.ord),
r(query_id, n, picked) as (select query_id, 1::bigint, [1::bigint] from x group by query_id union all
 select query_id, n + 1, list_append(picked, arg_max(ord, {{'v': v, 'o': -ord}})) from (select r.query_id, r.n, r.picked, x.ord, 0.6::double * x.s - 0.4::double * max(case when list_contains(r.picked, p.o2) then p.sim else 0 end) as v from r join x on r.query_id = x.query_id join pairs p on p.query_id = x.query_id and p.o1 = x.ord where r.n < 8 and not list_contains(r.picked, x.ord) group by r.query_id, r.n, r.picked, x.ord, x.s) group by query_id, n, picked)
select x.query_id, t.pick, x.chunk_id from (select query_id, unnest(picked) as ord, generate_subscripts(picked, 1) - 1 as pick from (select query_id, arg_max(picked, n) as picked from r group by query_id)) t join x on x.query_id = t.query_id and x.ord = t.ord"""


# The evaluation pipeline: its SQL is put together from that of its parts ----------------------------------------------------------------

_FIELDS = f"select chunk_id, x.field as field, len(x.ts) as length, unnest(x.ts) as token from (select chunk_id, unnest([{{'field': 'title', 'ts': {tok("coalesce(title, '')")}}}, {{'field': 'breadcrumb', 'ts': {tok(bc('breadcrumb'))}}}, {{'field': 'summary', 'ts': {tok("coalesce(substr(body, 1, 200), '')")}}}]) as x from c)"
_MEAN = "case field when 'title' then avg_title when 'breadcrumb' then avg_breadcrumb when 'terms' then avg_terms else avg_summary end"
_PART = f"ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / {_MEAN})) * case field when 'title' then 6 when 'breadcrumb' then 3 else 2 end"
_RESCORED = sql(f"select query_id, chunk_id, {half_up('sum(part)', 2)} as score from (select query_id, chunk_id, {_PART} as part from (select query_id, chunk_id from hitlist) join (select chunk_id, field, token, count(*) as tf, any_value(length) as length from ({_FIELDS}) group by chunk_id, field, token) using (chunk_id) join (select distinct query_id, token from ({SQL['ret_13_rm3']})) using (query_id, token) join ndf using (token), nl) group by query_id, chunk_id having {half_up('sum(part)', 2)} > 0", "hitlist", "c", "ndf", "nl")
_AGAIN = SQL["ret_14_lexical_rerank"].replace("hitlist h join ct", "(select h2.query_id, h2.rank, h2.chunk_id, s2.score from hitlist h2 join rescored s2 using (query_id, chunk_id)) h join ct")
SQL["ret_24_evaluation_pipeline"] = f"with rescored as materialized ({_RESCORED}), again as materialized ({_AGAIN}), found as materialized ({sql('select * from hitlist', 'hitlist')}) select a.query_id, row_number() over (partition by a.query_id order by rerank_score desc, s.score desc, a.rank) as rank, a.chunk_id, f.doc_key, s.score, f.rrf_score, rerank_score from again a join rescored s on a.query_id = s.query_id and a.chunk_id = s.chunk_id join found f on f.query_id = a.query_id and f.chunk_id = a.chunk_id"

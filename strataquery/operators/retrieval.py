"""Retrieval over batches of queries: BM25F, phrase and routing paths, fusion, feedback, reranking, confidence, evaluation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.normalize import normalize_for_search
from ..functions.synonyms import SYNONYM_WEIGHT, table
from ..functions.text import joined, round_half_up, tokenize, tokenize_unique
from ..session import at_most, cut, ship, small
from .batch import BLOCK, batches, first_chunks, first_documents
from .index import SOUGHT, Index, effective_df, few_values, is_pruned, seek, title_tokens
from .skew import skew_join

# Scoring constants.
K1, B = 1.5, 0.75
BOOST = {"title": 6.0, "breadcrumb": 3.0, "body": 1.0}
NODE_BOOST = {"title": 6.0, "breadcrumb": 3.0, "terms": 2.0, "summary": 2.0}
RRF_K, PER_DOC = 60, 3
ROUTE_SCORE, PHRASE_LEAST = 0.1, 0.3
RERANK = {"bm25": 0.5, "prox": 0.2, "phrase": 0.2, "cov": 0.1}


def expand(tokens: Column, raw: Column) -> Column:
    """array<struct<token, weight>>: the tokens at 1.0, then tokens of synonyms whose term is in the raw query or among the tokens, at 0.6.

    The table is a constant of fixed size, so this is an expression and no join.
    """
    rules = F.array(*(F.struct(F.lit(k).alias("k"), F.array(*map(F.lit, v)).alias("v")) for k, v in table()))
    matched = F.filter(rules, lambda r: (F.instr(F.lower(raw), r["k"]) > 0) | F.array_contains(tokens, r["k"]))
    every = F.array_distinct(F.concat(tokens, F.flatten(F.transform(matched, lambda r: r["v"]))))
    return F.transform(every, lambda t: F.struct(t.alias("token"), F.when(F.array_contains(tokens, t), F.lit(1.0)).otherwise(F.lit(SYNONYM_WEIGHT)).alias("weight")))


def analyzed(queries: DataFrame) -> DataFrame:
    """(query_id, query, norm, tokens): one row a query with at least one token; null queries have none."""
    q = queries.select("query_id", "query").distinct().withColumn("norm", normalize_for_search(F.col("query")))
    return q.withColumn("tokens", tokenize_unique(F.col("norm"))).where(F.size("tokens") > 0)


def query_tokens(queries: DataFrame) -> DataFrame:
    """(query_id, ord, token, weight, original) of every query."""
    a = analyzed(queries)
    return a.select("query_id", F.posexplode(expand(F.col("tokens"), F.col("norm"))).alias("ord", "x")).select("query_id", "ord", "x.token", "x.weight", (F.col("x.weight") == 1.0).alias("original"))


def _idf(n: int, df: Column) -> Column:
    return F.ln(F.lit(1.0) + (F.lit(float(n)) - df + 0.5) / (df + 0.5))


def _part(tf: Column, length: Column, mean: float, boost: float) -> Column:
    norm = F.lit(1 - B) + F.lit(B) * (length / F.lit(float(mean)))
    return F.when(tf > 0, (tf * (K1 + 1)) / (tf + F.lit(K1) * norm) * boost).otherwise(F.lit(0.0))


#: Rows of a batch of queries (their tokens, their ranked hits) that are broadcast at most; larger batches are joined by shuffles.
BATCH = 200_000


def asked(queries: DataFrame, index: Index, prune: bool = True) -> DataFrame:
    """(query_id, ord, token, weight, original, hidden, df): the queries' tokens that the index has, with effective frequencies."""
    return cut(_known(query_tokens(queries), index, prune)[1])


def _known(qt: DataFrame, index: Index, prune: bool) -> tuple[list | None, DataFrame]:
    hidden = is_pruned(index.n) if prune else F.lit(False)
    qt = cut(qt)
    few = few_values(qt.select("token"))
    return few, qt.join(seek(index.stats, "token", few), "token").select("query_id", "ord", "token", "weight", "original", hidden.alias("hidden"), (effective_df(index.n) if prune else F.col("df_any")).alias("df"))


def matches(qt: DataFrame, index: Index, prune: bool = True) -> DataFrame:
    """One row a (query, token, chunk) that meets: postings of the query's tokens with effective frequencies.

    Small sides meet first (tokens with their statistics). Then postings stay where they are: the tokens of few queries are
    sought in the sorted postings, those of a batch of up to BATCH rows are broadcast; only for larger ones postings are
    shuffled by token, those of hot tokens spread over tasks. Body frequencies of pruned tokens are hidden.
    """
    few, known = _known(qt, index, prune)
    return meet(cut(known), index, few)


def meet(known: DataFrame, index: Index, few: list | None) -> DataFrame:
    posts = seek(index.postings, "token", few)
    met = posts.join(F.broadcast(known), "token") if at_most(known, BATCH) else skew_join(posts, known, "token", "chunk_id", hot=index.hot)
    return met.withColumn("body_tf", F.when(F.col("hidden"), F.lit(0)).otherwise(F.col("body_tf"))).where("title_tf + breadcrumb_tf + body_tf > 0")


def bm25f(met: DataFrame, index: Index) -> DataFrame:
    """(query_id, chunk_id, doc_key, node_key, local_id, ord, raw, score) of every candidate with a positive score."""
    mean = index.averages()
    fields = sum((_part(F.col(f"{f}_tf"), F.col(f"len_{f}"), mean[f], BOOST[f]) for f in BOOST), F.lit(0.0))
    each = met.withColumn("part", _idf(index.n, F.col("df")) * F.col("weight") * fields)
    total = each.groupBy("query_id", "chunk_id", "doc_key", "node_key", "local_id").agg(F.min("ord").alias("ord"), F.sum("part").alias("raw"))
    return total.where("raw > 0").withColumn("score", round_half_up(F.col("raw"), 2))


#: Meetings of a batch's tokens with chunks up to which they become rows where there are postings; of more only ranks leave a task.
MEETINGS = 1_000_000


def _by_rows(known: DataFrame, index: Index) -> bool:
    return index.sorted_by_token and (known.agg(F.sum("df")).first()[0] or 0) <= MEETINGS


def ranked(known: DataFrame, index: Index, k: int, per_doc: int | None = PER_DOC, block: int = BLOCK) -> DataFrame:
    """capped(bm25f(...), k) of asked() queries: (query_id, chunk_id, doc_key, node_key, local_id, ord, score, rank).

    Few meetings are rows. Those of a large batch, which grow as queries times chunks, stay inside the tasks that hold the chunks:
    at most k rows a query and block are shuffled, and no postings are needed.
    """
    if _by_rows(known, index):
        return capped(bm25f(meet(known, index, few_values(known.select("token"))), index), k, per_doc=per_doc).drop("raw")
    mean = index.averages()
    fields = [(c, float(mean[f]), BOOST[f], f == "body") for f, c in zip(BOOST, ("tt", "bt", "dt"), strict=True)]
    weighed = known.withColumn("weight", _idf(index.n, F.col("df")) * F.col("weight"))
    rows = None
    for batch in batches(weighed, BATCH):
        part = first_chunks(index.forward, batch, index.n, fields, K1, B, k, per_doc, block)
        rows = part if rows is None else rows.unionByName(part)
    return capped(rows.repartition("query_id"), k, per_doc=per_doc)


def routed(known: DataFrame, index: Index, most: int = 5, block: int = BLOCK) -> DataFrame:
    """routed_documents of asked() queries, for a large batch in the tasks that hold the documents' titles."""
    if _by_rows(known, index):
        return routed_documents(meet(known, index, few_values(known.select("token"))), most)
    plain = known.where("original").groupBy("query_id", "token").agg(F.lit(0).alias("ord"), F.lit(1.0).alias("weight"), F.lit(False).alias("hidden"))
    titles, rows = title_tokens(index.forward), None
    for batch in batches(cut(plain), BATCH):
        part = first_documents(titles, batch, int(index.totals["documents"]), most, block)
        rows = part if rows is None else rows.unionByName(part)
    n = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_key"))
    return rows.withColumn("n", n).where(F.col("n") <= most).select("query_id", "doc_key", F.col("score").alias("route_score"))


def payload(hits: DataFrame, index: Index, *columns: str | Column) -> DataFrame:
    """hits (chunk_id, ...) with columns of their chunks, read last and for hits only.

    Up to BATCH hits go to where the chunks are, so no text is shuffled, and only the named columns are scanned.
    """
    head = [r[0] for r in hits.select("chunk_id").limit(SOUGHT + 1).collect()]
    sought = sorted({x for x in head if x is not None}) if len(head) <= SOUGHT else None
    few = sought is not None or at_most(hits, BATCH)
    return seek(index.chunks, "chunk_id", sought).select("chunk_id", *columns).join(F.broadcast(hits) if few else hits, "chunk_id")


def score_order() -> list[Column]:
    """Best score first; ties by the first query token that met the chunk, then by the chunk's place."""
    return [F.desc("score"), F.asc("ord"), F.asc("doc_key"), F.asc("local_id"), F.asc("chunk_id")]


def capped(scored: DataFrame, k: int, order: list | None = None, per_doc: int | None = PER_DOC) -> DataFrame:
    """The first k of every query with at most `per_doc` of a document (None: any number); adds rank (1-based).

    Both limits are row_number filters, which Spark applies before each shuffle too: a query with any number of
    candidates sends at most per_doc rows a document, then k rows a task.
    """
    by = order or score_order()
    few = scored if per_doc is None else scored.withColumn("__n", F.row_number().over(W.partitionBy("query_id", "doc_key").orderBy(*by))).where(F.col("__n") <= per_doc).drop("__n")
    return few.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*by))).where(F.col("rank") <= k)


def grams_of(norm: Column, unigrams: bool = True) -> Column:
    """The grams of a query: CJK pairs, pairs of words and, if `unigrams`, words."""
    raw = F.lower(norm)
    cjk = F.array_join(F.regexp_extract_all(raw, F.lit("[一-鿿]+"), F.lit(0)), "")
    words = F.regexp_extract_all(raw, F.lit("[a-z][a-z0-9]+"), F.lit(0))
    pairs = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.regexp_extract_all(cjk, F.lit("(?=(.{2}))"), F.lit(1)), pairs, *([words] if unigrams else []))


def share_of(grams: Column, title_text: Column) -> Column:
    """Share of the grams found in the title text; no grams give 0."""
    found = F.size(F.filter(grams, lambda g: F.contains(title_text, g)))
    return F.when(F.size(grams) > 0, found / F.size(grams)).otherwise(F.lit(0.0))


def phrase_share(norm: Column, title_text: Column, unigrams: bool = True) -> Column:
    return share_of(grams_of(norm, unigrams), title_text)


def title_text(title: Column, breadcrumb: Column) -> Column:
    return F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), joined(breadcrumb)))


def phrase_path(few: DataFrame, queries: DataFrame, index: Index, k: int = 20) -> DataFrame:
    """Path A: of the first 60 ranked candidates those whose titles hold over 0.3 of the query's grams; (query_id, chunk_id, ..., score, rank)."""
    texts = payload(few.where(F.col("rank") <= 3 * k), index, title_text(F.col("title"), F.col("breadcrumb")).alias("tt"))
    share = texts.join(small(cut(analyzed(queries).select("query_id", grams_of(F.col("norm")).alias("grams"))), BATCH), "query_id").withColumn("share", share_of(F.col("grams"), F.col("tt"))).where(F.col("share") > PHRASE_LEAST)
    out = share.select("query_id", "chunk_id", "doc_key", "node_key", "local_id", F.col("rank").alias("b_rank"), round_half_up(F.col("share"), 2).alias("score"))
    return out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "b_rank"))).where(F.col("rank") <= k)


def routed_documents(met: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, doc_key, route_score): per original token 2 for a title and 1 for a breadcrumb of the document; the first `most`."""
    seen = met.where("original and title_tf + breadcrumb_tf > 0").groupBy("query_id", "doc_key", "token").agg((2 * F.max((F.col("title_tf") > 0).cast("int")) + F.max((F.col("breadcrumb_tf") > 0).cast("int"))).alias("s"))
    docs = seen.groupBy("query_id", "doc_key").agg(F.sum("s").cast("double").alias("route_score"))
    return docs.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("route_score"), "doc_key"))).where(F.col("n") <= most).drop("n")


def route_path(known: DataFrame, index: Index, k: int = 20) -> DataFrame:
    """Path E: the first k chunks, by (doc_key, local_id), of the routed documents; every score is 0.1."""
    docs = cut(routed(known, index))
    keys = docs.select("doc_key").distinct()
    sought = few_values(keys)
    near = seek(index.chunks.select("doc_key", "chunk_id", "node_key", "local_id"), "doc_key", sought).join(F.broadcast(keys) if sought is not None else small(keys, BATCH), "doc_key", "left_semi")
    heads = near.withColumn("n", F.row_number().over(W.partitionBy("doc_key").orderBy("local_id", "chunk_id"))).where(F.col("n") <= k).drop("n")
    rows = docs.join(heads, "doc_key")
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("doc_key", "local_id", "chunk_id"))).where(F.col("rank") <= k).select("query_id", "chunk_id", "doc_key", "node_key", "local_id", F.lit(ROUTE_SCORE).alias("score"), "rank")


def rrf(paths: list[DataFrame]) -> DataFrame:
    """(query_id, doc_key, node_key, chunk_id, local_id, item_score, rrf_score, seen): reciprocal rank fusion by node.

    Several chunks of a node in a path all count; the item kept is the one of strictly largest score, the first on ties.
    Order: rrf_score rounded to 12 digits (so that the order of summation can't break ties), then first appearance.
    """
    cols = ["query_id", "doc_key", "node_key", "chunk_id", "local_id", F.col("score").cast("double").alias("score"), "rank"]
    rows = None
    for i, p in enumerate(paths):
        part = p.select(*cols, F.lit(i).alias("path"))
        rows = part if rows is None else rows.unionByName(part)
    seen = F.col("path") * 1_000_000 + F.col("rank")
    item = F.max_by(F.struct("chunk_id", "local_id", "score"), F.struct("score", -seen))
    # at most the paths' ranks a query; placed by query, they also need no other shuffle for what ranks them
    return rows.repartition("query_id").groupBy("query_id", "doc_key", "node_key").agg(F.round(F.sum(F.lit(1.0) / (RRF_K + F.col("rank"))), 12).alias("rrf_score"), F.min(seen).alias("seen"), item.alias("i")).select("query_id", "doc_key", "node_key", "i.chunk_id", "i.local_id", F.col("i.score").alias("item_score"), "rrf_score", "seen")


def multi_path(queries: DataFrame, index: Index, top_k: int = 50, prune: bool = True) -> DataFrame:
    """(query_id, rank, doc_key, node_key, chunk_id, local_id, score, rrf_score): the three paths fused, capped by document.

    Payloads (titles) are read for ranked candidates only.
    """
    if top_k <= 0:
        return queries.sparkSession.createDataFrame([], "query_id string, rank int, doc_key string, node_key string, chunk_id string, local_id int, score double, rrf_score double")
    known = asked(queries, index, prune)
    # Two paths read the ranked candidates, at most max(top_k, 60) a query: they are scored once.
    few = cut(ranked(known, index, max(top_k, 60)))
    fused = rrf([phrase_path(few, queries, index), few.where(F.col("rank") <= max(top_k, 50)), route_path(known, index)])
    out = capped(fused, top_k, [F.desc("rrf_score"), F.asc("seen")])
    return out.select("query_id", "rank", "doc_key", "node_key", "chunk_id", "local_id", round_half_up(F.col("rrf_score"), 3).alias("score"), "rrf_score")


def positions(hits: DataFrame, queries: DataFrame, index: Index) -> DataFrame:
    """(query_id, chunk_id, token, field, pos): first place of each query token in each field of a hit."""
    toks = small(cut(query_tokens(queries).groupBy("query_id").agg(F.collect_set("token").alias("toks"))), BATCH)  # so texts aren't shuffled once more, by query
    rows = payload(hits.select("query_id", "chunk_id"), index, "title", "breadcrumb", "body").join(toks, "query_id")
    fields = F.array(*(F.struct(F.lit(n).alias("field"), t.alias("ts")) for n, t in (("title", tokenize(F.col("title"))), ("breadcrumb", tokenize(joined(F.col("breadcrumb")))), ("summary", tokenize(F.col("body"))))))
    each = rows.select("query_id", "chunk_id", "toks", F.explode(fields).alias("f")).select("query_id", "chunk_id", F.explode("toks").alias("token"), "f.field", "f.ts")
    return each.select("query_id", "chunk_id", "token", "field", (F.array_position("ts", F.col("token")) - 1).cast("int").alias("pos")).where("pos >= 0")


def rm3(queries: DataFrame, hits: DataFrame, index: Index, m: int = 10, top: int = 15) -> DataFrame:
    """(query_id, ord, token): the query's tokens in order, then the best `top` feedback terms of its first m hits.

    Each occurrence in title and summary adds the hit's score; ties keep the order of first occurrence.
    """
    texts = payload(hits.where(F.col("rank") <= m), index, "title", "body")
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("  "), F.coalesce(F.substring("body", 1, 200), F.lit("")))
    occ = texts.select("query_id", "rank", "score", F.posexplode(tokenize(text)).alias("p", "token"))
    sums = occ.groupBy("query_id", "token").agg(F.round(F.sum("score"), 6).alias("s"), F.min(F.struct("rank", "p")).alias("first"))
    best = sums.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("s"), "first"))).where(F.col("n") <= top)
    extra = best.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("e"))  # at most `top` a query
    q = queries.select("query_id", "query").distinct().withColumn("tokens", tokenize(F.col("query"))).join(extra, "query_id", "left")
    every = F.array_distinct(F.concat("tokens", F.coalesce(F.transform("e", lambda x: x["token"]), F.array().cast("array<string>"))))
    return q.select("query_id", F.posexplode(every).alias("ord", "token"))


def reranked(hits: DataFrame, queries: DataFrame, index: Index) -> DataFrame:
    """hits (query_id, chunk_id, score, ...) with prox, phrase, cov and rerank_score.

    Query tokens keep their repeats: a repeated token is two positions with no span between. Scores but coverage are
    put on 0..1 within the query.
    """
    q = queries.select("query_id", "query").distinct().withColumn("qts", tokenize(F.col("query")))
    expanded = F.transform(expand(F.array_distinct("qts"), F.coalesce("query", F.lit(""))), lambda x: x["token"])
    q = cut(q.select("query_id", "qts", expanded.alias("all"), grams_of(F.coalesce("query", F.lit("")), False).alias("grams")))  # once a query, not once a hit
    # queries go to the hits, tokens travel as strings if at all, and only numbers are shuffled by query
    field = F.array(*(F.array_join(tokenize(t), " ") for t in (F.col("title"), joined(F.col("breadcrumb")), F.col("body"))))
    rows = payload(hits, index, title_text(F.col("title"), F.col("breadcrumb")).alias("tt"), field.alias("fs")).join(small(q, BATCH), "query_id").withColumn("fs", F.transform("fs", lambda s: F.filter(F.split(s, " "), lambda t: t != "")))
    place = F.transform("fs", lambda f: F.filter(F.transform("qts", lambda t: F.array_position(f, t)), lambda p: p > 0))
    prox = F.array_max(F.transform(place, lambda ps: F.when(F.size(ps) >= 2, F.lit(1.0) / (F.array_max(ps) - F.array_min(ps) + 1)).otherwise(F.lit(0.0))))
    hit = lambda t: F.exists("fs", lambda f: F.array_contains(f, t))
    anything = F.exists("all", hit)
    cov = F.when(F.size("qts") > 0, F.size(F.array_distinct(F.filter("qts", hit))) / F.size("qts")).otherwise(F.lit(0.0))
    sub = rows.withColumn("prox", F.when(prox > 0, prox).when(anything, F.lit(0.2)).otherwise(F.lit(0.0))).withColumn("phrase", F.least(F.lit(1.0), share_of(F.col("grams"), F.col("tt")))).withColumn("cov", cov)
    w = W.partitionBy("query_id")  # hits of a query are bounded by top_k

    def unit(c: str) -> Column:
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        return (F.col(c) - lo) / F.when(hi - lo == 0, F.lit(1.0)).otherwise(hi - lo)

    total = RERANK["bm25"] * unit("score") + RERANK["prox"] * unit("prox") + RERANK["phrase"] * unit("phrase") + RERANK["cov"] * F.col("cov")
    return sub.withColumn("rerank_score", F.round(total, 9)).drop("tt", "grams", "qts", "fs", "all")


def confidence(queries: DataFrame, hits: DataFrame, index: Index) -> DataFrame:
    """(query_id, coverage, rrf_score, title_hit, margin, source_count, confidence) of every query.

    hits hold rank, rrf_score, doc_key, chunk_id. Queries without hits have zeros and class low.
    """
    q = cut(queries.select("query_id", F.coalesce("query", F.lit("")).alias("query")).distinct().withColumn("qts", tokenize_unique(F.col("query"))))
    top = payload(hits.where(F.col("rank") <= 10), index, "title", "breadcrumb", "body").join(small(q, BATCH), "query_id")
    # of five chunks' tokens those of the query; what is shuffled is no longer than a query
    ts = F.concat(tokenize(F.col("title")), tokenize(joined(F.col("breadcrumb"))), tokenize(F.col("body")))
    agg = top.withColumn("ts", F.when(F.col("rank") <= 5, F.array_intersect("qts", ts)).otherwise(F.array().cast("array<string>"))).groupBy("query_id", "query").agg(
        F.array_distinct(F.flatten(F.collect_list("ts"))).alias("seen"),
        F.max(F.when(F.col("rank") == 1, F.col("rrf_score"))).alias("rrf_score"),
        F.max(F.when(F.col("rank") == 2, F.col("rrf_score"))).alias("second"),
        F.max(F.when(F.col("rank") == 1, title_text(F.col("title"), F.col("breadcrumb")))).alias("tt"),
        F.count_distinct("doc_key").alias("source_count"),
    )
    j = q.join(agg, ["query_id", "query"], "left")
    cov = F.when((F.size("qts") > 0) & F.col("seen").isNotNull(), F.size("seen") / F.size("qts")).otherwise(F.lit(0.0))
    sig = j.select("query_id", F.round(cov, 9).alias("coverage"), F.coalesce("rrf_score", F.lit(0.0)).alias("rrf_score"), F.coalesce(F.exists("qts", lambda t: F.contains(F.col("tt"), t)), F.lit(False)).alias("title_hit"), F.when(F.col("second").isNotNull(), F.round(F.col("rrf_score") - F.col("second"), 12)).otherwise(F.lit(0.0)).alias("margin"), F.coalesce("source_count", F.lit(0)).alias("source_count"))
    return sig.withColumn("confidence", confidence_class())


def confidence_class() -> Column:
    """Ordered thresholds over coverage, rrf_score, title_hit, source_count and margin."""
    strong = (F.col("coverage") >= 0.7) & (F.col("rrf_score") >= 0.05) & (F.col("title_hit") | (F.col("source_count") >= 2) | (F.col("margin") >= 0.01))
    return F.when(F.col("coverage") < 0.5, "low").when(strong, "high").when((F.col("coverage") >= 0.5) | (F.col("rrf_score") >= 0.04), "medium").otherwise("low")


def confidence_class_by_rerank(top: Column, sources: Column) -> Column:
    """The older classes, by best rerank score and number of sources."""
    return F.when((top >= 0.6) & (sources >= 2), "high").when((top >= 0.3) | ((top >= 0.15) & (sources >= 2)), "medium").otherwise("low")


def shingles(text: Column, k: int = 4) -> Column:
    """Distinct runs of k tokens; fewer tokens give the tokens themselves."""
    ts = tokenize(text)
    runs = F.transform(F.sequence(F.lit(1), F.size(ts) - k + 1), lambda i: F.array_join(F.slice(ts, i, k), " "))
    return F.array_distinct(F.when(F.size(ts) >= k, runs).otherwise(ts))


def neighbor_similarity(hits: DataFrame, index: Index) -> DataFrame:
    """(query_id, left_id, right_id, similarity) of the bodies of each two hits that follow each other in the ranking.

    What travels to the next hit of a query are tokens as one string; their shingles, several times as large, live only while a
    task compares them, each hit's once for both its neighbors.
    """
    rows = payload(hits.select("query_id", "rank", "chunk_id"), index, F.array_join(tokenize(F.col("body")), " ").alias("ts"))
    w = W.partitionBy("query_id").orderBy("rank")  # hits of a query are bounded by top_k, their ranks have no gaps
    pairs = rows.select("query_id", F.col("chunk_id").alias("left_id"), "ts", F.lead("chunk_id").over(w).alias("right_id"), F.lead("ts").over(w).alias("next")).where("right_id is not null")

    @F.pandas_udf("double")
    def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series(_similarities(left, right), dtype="float64")

    ship(hits.sparkSession)
    return pairs.select("query_id", "left_id", "right_id", similarity("ts", "next").alias("similarity"))


def _runs(tokens: str, k: int = 4) -> set:
    ts = tokens.split(" ") if tokens else []
    return set(zip(*(ts[i:] for i in range(k)), strict=False)) if len(ts) >= k else set(ts)


def _similarities(left, right) -> list[float]:
    """jaccard of shingles of two columns of tokens with blanks between; the right of a row is mostly the left of the next."""
    out, seen, last = [], None, set()
    for x, y in zip(left, right, strict=True):
        a = last if x == seen else _runs(x)
        seen, last = y, _runs(y)
        both = len(a & last)
        out.append(both / (len(a) + len(last) - both) if a and last else 0.0)
    return out


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 if either is empty."""
    inter = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), inter / (F.size(a) + F.size(b) - inter)).otherwise(F.lit(0.0))


def _mmr_order(texts: list[set], scores: list[float], lam: float, most: int) -> list[int]:
    if not texts:
        return []
    chosen, rest = [0], list(range(1, len(texts)))
    sims = [0.0] * len(texts)
    while rest and len(chosen) < most:
        last = texts[chosen[-1]]
        for i in rest:
            union = len(texts[i] | last)
            sims[i] = max(sims[i], len(texts[i] & last) / union if texts[i] and last and union else 0.0)
        best = max(rest, key=lambda i: (lam * scores[i] - (1 - lam) * sims[i], -i))
        chosen.append(best)
        rest.remove(best)
    return chosen


def mmr(contexts: DataFrame, lam: float = 0.6, most: int = 8) -> DataFrame:
    """(query_id, pick, chunk_id): greedy maximal marginal relevance of each query's contexts.

    contexts: query_id, chunk_id, ord, rerank_score, body; bounded by top_k a query. Only ids, scores and shingles meet in a group.
    """
    packed = contexts.select("query_id", F.struct("ord", "chunk_id", F.coalesce("rerank_score", F.lit(0.0)).alias("s"), shingles(F.col("body")).alias("sh")).alias("c")).groupBy("query_id").agg(F.sort_array(F.collect_list("c")).alias("cs"))

    @F.pandas_udf("array<string>")
    def pick(column: pd.Series) -> pd.Series:
        return column.map(lambda cs: [cs[i]["chunk_id"] for i in _mmr_order([set(c["sh"]) for c in cs], [c["s"] for c in cs], lam, most)])

    return packed.select("query_id", F.posexplode(pick("cs")).alias("pick", "chunk_id"))


def contexts(hits: DataFrame, index: Index, first: int = 12, most: int = 8) -> DataFrame:
    """(query_id, ord, chunk_id, doc_key, node_key, body): of the first hits one for each node, those with text, at most `most`."""
    few = hits.where(F.col("rank") <= first).withColumn("n", F.row_number().over(W.partitionBy("query_id", "doc_key", "node_key").orderBy("rank"))).where("n = 1")
    texts = payload(cut(few), index, "body").where(F.coalesce("body", F.lit("")) != "")
    return texts.withColumn("ord", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).where(F.col("ord") <= most).select("query_id", "ord", "chunk_id", "doc_key", "node_key", "body")


def packed(ctx: DataFrame, cost: Column, budget: int) -> DataFrame:
    """(query_id, ord, chunk_id): contexts in order that still fit the budget, skipping those too large; if none fits, the first two."""
    rows = ctx.select("query_id", F.struct("ord", "chunk_id", cost.cast("long").alias("cost")).alias("c")).groupBy("query_id").agg(F.sort_array(F.collect_list("c")).alias("cs"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<ord:int,chunk_id:string,cost:bigint>>").alias("kept"))
    step = lambda a, c: F.when(a["used"] + c["cost"] <= budget, F.struct((a["used"] + c["cost"]).alias("used"), F.concat(a["kept"], F.array(c)).alias("kept"))).otherwise(a)
    kept = F.aggregate("cs", start, step, lambda a: a["kept"]) if budget > 0 else F.array().cast("array<struct<ord:int,chunk_id:string,cost:bigint>>")
    final = rows.select("query_id", F.explode(F.when(F.size(kept) > 0, kept).otherwise(F.slice("cs", 1, 2))).alias("c"))
    return final.select("query_id", "c.ord", "c.chunk_id")


def truncated(text: Column, most: int) -> Column:
    """At most `most` characters: whole paragraphs; if the first is longer, whole sentences; if that is longer too, characters. Shorter texts stay."""
    t = F.coalesce(text, F.lit(""))

    def fold(parts: Column, gap: str) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(False).alias("full"))
        join = lambda a, p: F.when(a["out"] == "", p).otherwise(F.concat(a["out"], F.lit(gap), p))
        room = lambda a, p: F.length(a["out"]) + len(gap) + F.length(p) <= most
        step = lambda a, p: F.when(a["full"] | ~room(a, p), F.struct(a["out"].alias("out"), F.lit(True).alias("full"))).otherwise(F.struct(join(a, p).alias("out"), F.lit(False).alias("full")))
        return F.aggregate(parts, start, step, lambda a: a["out"])

    some = lambda xs: F.filter(xs, lambda p: F.trim(p) != "")
    paragraphs, sentences = fold(some(F.split(t, "\n+")), "\n"), fold(some(F.split(t, "(?<=[。！？；!?])")), "")
    return F.when(F.length(t) <= most, t).when(paragraphs != "", paragraphs).when(sentences != "", sentences).otherwise(F.substring(t, 1, most))


def evaluated(golden: DataFrame, hits: DataFrame, classes: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, category, kind, recall, mrr, correct) of golden questions (query_id, category, expect_doc_ids)."""
    top = hits.where(F.col("rank") <= k).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_key"))).alias("top"))  # k rows a query
    any_hit = hits.select("query_id").distinct().withColumn("has", F.lit(True))
    j = golden.join(top, "query_id", "left").join(any_hit, "query_id", "left").join(classes.select("query_id", "confidence"), "query_id", "left")
    none = F.size("expect_doc_ids") == 0
    where = F.array_min(F.transform(F.filter("top", lambda x: F.array_contains("expect_doc_ids", x["doc_key"])), lambda x: x["rank"]))
    right = F.when(none, F.col("has").isNull() | (F.col("confidence") == "low")).otherwise(where.isNotNull())
    return j.select("query_id", "category", F.when(none, "no_answer").otherwise("answerable").alias("kind"), right.cast("int").alias("recall"), F.when(~none & where.isNotNull(), F.lit(1.0) / where).otherwise(F.lit(0.0)).alias("mrr"), right.alias("correct"))


def evaluation_buckets(evals: DataFrame) -> DataFrame:
    """(bucket, value, n, recall, mrr, correct): overall, by category and by kind, in one pass with grouping sets."""
    evals.createOrReplaceTempView("__evals")
    return evals.sparkSession.sql(
        """select case when grouping(category) = 0 then 'category' when grouping(kind) = 0 then 'kind' else 'overall' end as bucket, coalesce(category, kind, '') as value,
        count(*) as n, round(avg(recall), 6) as recall, round(avg(mrr), 6) as mrr, sum(cast(correct as int)) as correct from __evals group by grouping sets ((), (category), (kind))"""
    )

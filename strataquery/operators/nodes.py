"""Nodes (headings), their node-level BM25F, and projections of nodes and hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import joined, round_half_up, tokenize, tokenize_unique
from ..session import at_most, cut, small
from .index import seek
from .retrieval import BATCH, NODE_BOOST, B, K1, expand
from .skew import hot_counts, skew_join

# Fixed value: what separates the terms of a title.
TERM_SPLIT = r"[\s·\-—.,;:!?()\[\]{}]+"


def title_terms(title: Column) -> Column:
    """Distinct parts of a title of at least two characters, in order."""
    return F.array_distinct(F.filter(F.split(F.coalesce(title, F.lit("")), TERM_SPLIT), lambda p: F.length(p) >= 2))


def node_url(doc_type: Column, slug: Column, source_md: Column, node_id: Column) -> Column:
    """Page of a node by document type, with its anchor."""
    stem = F.regexp_replace(F.regexp_replace(F.coalesce(source_md, F.lit("")), r"^.*[/\\]", ""), r"\.[^.]*$", "")
    page = F.when((stem != "") & (stem != "_index"), F.concat(stem, F.lit(".html"))).otherwise("index.html")
    base = F.when(doc_type == "book", F.concat(F.lit("/books/"), slug, F.lit("/"), page)).when(doc_type == "paper", F.concat(F.lit("/papers/"), slug, F.lit("/index.html"))).otherwise(F.concat(F.lit("/notes/"), slug, F.lit(".html")))
    return F.concat(base, F.lit("#pi-node-"), F.coalesce(node_id, F.lit("")))


def split_doc_key(df: DataFrame) -> DataFrame:
    """Adds doc_type and slug (everything after the first colon)."""
    return df.withColumn("doc_type", F.split_part("doc_key", F.lit(":"), F.lit(1))).withColumn("slug", F.regexp_replace("doc_key", "^[^:]*:", ""))


def nodes(chunks: DataFrame) -> DataFrame:
    """(doc_key, node_key, title, breadcrumb, terms, summary, url): the first chunk of a node describes it. `chunks` has one row a chunk_id."""
    head = chunks.groupBy("doc_key", "node_key").agg(F.min_by(F.struct("title", "breadcrumb", "body", "source_md", "node_id"), F.struct("node_local_ordinal", "chunk_id")).alias("h"))
    rows = split_doc_key(head.select("doc_key", "node_key", "h.*"))
    return rows.select("doc_key", "node_key", "title", "breadcrumb", title_terms(F.col("title")).alias("terms"), F.coalesce(F.substring("body", 1, 200), F.lit("")).alias("summary"), node_url(F.col("doc_type"), F.col("slug"), F.col("source_md"), F.col("node_id")).alias("url"))


FIELDS = {"title": lambda: F.coalesce("title", F.lit("")), "breadcrumb": lambda: joined(F.col("breadcrumb")), "terms": lambda: F.concat_ws(" ", "terms"), "summary": lambda: F.coalesce("summary", F.lit(""))}


def node_postings(nodes_df: DataFrame) -> DataFrame:
    """(doc_key, node_key, field, token, tf, length)."""
    fields = F.array(*(F.struct(F.lit(f).alias("field"), tokenize(text()).alias("ts")) for f, text in FIELDS.items()))
    rows = nodes_df.select("doc_key", "node_key", F.explode(fields).alias("x")).select("doc_key", "node_key", "x.field", F.size("x.ts").alias("length"), F.explode("x.ts").alias("token"))
    return rows.groupBy("doc_key", "node_key", "field", "token").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def node_df(posts: DataFrame) -> DataFrame:
    """(token, df): a token in two fields of one node counts twice."""
    return posts.groupBy("token").agg(F.count("*").alias("df"))


def node_df_of(nodes_df: DataFrame) -> DataFrame:
    """node_df of nodes, one row a node: each field's distinct tokens are counted before the shuffle, no postings are made."""
    distinct = F.flatten(F.array(*(tokenize_unique(text()) for text in FIELDS.values())))
    return nodes_df.select(F.explode(distinct).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def chunk_scores(hits: DataFrame, tokens: DataFrame, chunks: DataFrame, lengths) -> DataFrame:
    """hits (query_id, chunk_id, ...) with score > 0: node BM25F of each hit's own chunk, a node without terms, for its query's tokens (query_id, token, df).

    A hit meets its query's tokens in one row, so nothing is multiplied by the tokens of chunks.
    """
    asked = cut(tokens.groupBy("query_id").agg(F.collect_list(F.struct("token", "df")).alias("known")))  # expanded tokens of a query
    fields = {"title": F.coalesce("title", F.lit("")), "breadcrumb": joined(F.col("breadcrumb")), "summary": F.coalesce(F.substring("body", 1, 200), F.lit(""))}
    texts = chunks.select("chunk_id", *(F.array_join(tokenize(t), " ").alias(f"__{f}") for f, t in fields.items()))
    rows = texts.join(small(hits, BATCH), "chunk_id").join(small(asked, BATCH // 10), "query_id")
    n, zero = F.lit(float(lengths["n"])), F.lit(0.0)
    rows = rows.select(*hits.columns, "known", *(F.filter(F.split(f"__{f}", " "), lambda t: t != "").alias(f"__{f}") for f in fields))

    def part(x: Column, f: str) -> Column:
        tf = F.size(F.filter(f"__{f}", lambda t: t == x["token"]))
        norm = F.lit(1 - B) + F.lit(B) * F.size(f"__{f}") / F.lit(float(lengths[f"avg_{f}"] or 1.0))
        return F.when(tf > 0, tf * (K1 + 1) / (tf + F.lit(K1) * norm) * NODE_BOOST[f]).otherwise(zero)

    idf = lambda x: F.ln(F.lit(1.0) + (n - x["df"] + 0.5) / (x["df"] + 0.5))
    raw = F.aggregate("known", zero, lambda a, x: a + idf(x) * sum((part(x, f) for f in fields), zero))
    return rows.select(*hits.columns, round_half_up(raw, 2).alias("score")).where("score > 0")


def node_lengths(nodes_df: DataFrame) -> DataFrame:
    """One row: n, the four mean field lengths, and avg_len of the fields written together without separator."""
    ts = {f: F.size(tokenize(text())) for f, text in FIELDS.items()}
    together = F.size(tokenize(F.concat(*(text() for text in FIELDS.values()))))
    return nodes_df.agg(F.count("*").alias("n"), *((F.coalesce(F.sum(c), F.lit(0)) / F.greatest(F.count("*"), F.lit(1))).alias(f"avg_{f}") for f, c in ts.items()), (F.coalesce(F.sum(together), F.lit(0)) / F.greatest(F.count("*"), F.lit(1))).alias("avg_len"))


def expanded_queries(queries: DataFrame) -> DataFrame:
    """(query_id, token) of distinct tokens and their synonyms, unnormalized and unweighted."""
    q = queries.select("query_id", "query").distinct().withColumn("ts", tokenize_unique(F.col("query"))).where(F.size("ts") > 0)
    return q.select("query_id", F.explode(F.transform(expand(F.col("ts"), F.coalesce("query", F.lit(""))), lambda x: x["token"])).alias("token"))


def node_scores(tokens: DataFrame, posts: DataFrame, lengths) -> DataFrame:
    """(query_id, doc_key, node_key, score): BM25F over four fields; tokens (query_id, token) may repeat. `lengths` is the row of node_lengths."""
    posts = cut(posts)  # counted, then scored
    freq = cut(node_df(posts))
    tokens = cut(tokens)
    known = cut(tokens.join(freq, "token"))
    n = float(max(1, lengths["n"]))
    mean = F.create_map(*(x for f in FIELDS for x in (F.lit(f), F.lit(float(lengths[f"avg_{f}"] or 1.0)))))
    boost = F.create_map(*(x for f in FIELDS for x in (F.lit(f), F.lit(NODE_BOOST[f]))))
    near = seek(posts, "token", tokens.select("token"))
    met = near.join(F.broadcast(known), "token") if at_most(known, BATCH) else skew_join(near, known, "token", "node_key", hot=hot_counts(freq, "token", "df"))
    idf = F.ln(F.lit(1.0) + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("length") / mean[F.col("field")])) * boost[F.col("field")]
    total = met.groupBy("query_id", "doc_key", "node_key").agg(F.sum(part).alias("raw"))
    return total.where("raw > 0").select("query_id", "doc_key", "node_key", round_half_up(F.col("raw"), 2).alias("score"))


def node_search(scores: DataFrame, k: int = 50) -> DataFrame:
    """The first k nodes of every query, at most three of a document, ties by (doc_key, node_key)."""
    by = [F.desc("score"), F.asc("doc_key"), F.asc("node_key")]
    few = scores.withColumn("n", F.row_number().over(W.partitionBy("query_id", "doc_key").orderBy(*by))).where("n <= 3").drop("n")
    return few.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*by))).where(F.col("rank") <= k)


def legacy_route(queries: DataFrame, documents: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, doc_key, route_score) by document titles: shared tokens + 2 for a CJK run + 2 for a word in the title + 1 for the query in the description.

    documents: doc_key, title, description. Queries meet titles through shared tokens, words and CJK pairs (an equi-join); the substring
    conditions are checked on those pairs. A word inside a longer word of the title is found by the letters it starts with.
    """
    grams = lambda t: F.array_distinct(F.concat(*(F.regexp_extract_all(t, F.lit(f"(?=({g}))"), F.lit(1)) for g in ("[a-z0-9]{2}", "[a-z0-9]{3}", "[a-z0-9]{4}", "[一-鿿]", "[一-鿿]{2}"))))
    head = lambda w: F.substring(w, F.lit(1), F.when(w.rlike("^[一-鿿]"), 2).otherwise(4))
    q = queries.select("query_id", F.lower("query").alias("raw"), tokenize_unique(F.col("query")).alias("ts")).distinct()
    q = q.withColumn("cjk", F.regexp_extract_all("raw", F.lit("[一-鿿]+"), F.lit(0))).withColumn("en", F.regexp_extract_all("raw", F.lit("[a-z][a-z0-9]+"), F.lit(0)))
    d = documents.select("doc_key", F.lower(F.coalesce("title", F.lit(""))).alias("tt"), F.lower(F.coalesce("description", F.lit(""))).alias("dd"), tokenize_unique(F.col("title")).alias("dts"))
    # Only pairs that share the first letters (four, of Chinese two, or the whole word) of a query's word can score.
    heads = F.array_distinct(F.concat(F.transform("en", head), F.transform("cjk", head), F.transform("ts", head)))
    pairs = q.select("query_id", F.explode(heads).alias("g")).join(d.select("doc_key", F.explode(grams(F.concat_ws(" ", "tt", "dd"))).alias("g")), "g").select("query_id", "doc_key").distinct()
    rows = pairs.join(q, "query_id").join(d, "doc_key")
    score = F.size(F.array_intersect("ts", "dts")) + F.when(F.exists("cjk", lambda s: F.contains(F.col("tt"), s)), 2).otherwise(0) + F.when(F.exists("en", lambda s: F.contains(F.col("tt"), s)), 2).otherwise(0) + F.when(F.contains(F.col("dd"), F.col("raw")), 1).otherwise(0)
    scored = rows.select("query_id", "doc_key", score.alias("route_score")).where("route_score > 0")
    return scored.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("route_score"), "doc_key"))).where(F.col("n") <= most).drop("n")

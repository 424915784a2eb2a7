"""The incremental index: document fingerprints, change sets, base and delta layers, merge on read, compaction, validation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import at_most, cut
from . import table_diff
from .index import by_token, document_totals, few_values, postings, seek, token_stats
from .numbering import multiset_hash
from .skew import skew_join

# Layers are to be compacted when there are so many deltas, or when deltas times DELTA_SHARE are as large as the base.
MOST_LAYERS, DELTA_SHARE = 32, 5


def compaction_due(sizes: list[int]) -> bool:
    """Whether a base and its deltas, by size in bytes, are to be rewritten as one base."""
    return len(sizes) > MOST_LAYERS or (len(sizes) > 1 and sum(sizes[1:]) * DELTA_SHARE >= sizes[0])


def content_hashes(chunks: DataFrame) -> DataFrame:
    """(doc_key, content_hash, chunks): a fingerprint of a document's chunks, independent of row order; a document of any size is one merged row."""
    fields = ["node_key", "node_local_ordinal", "title", "breadcrumb", "body"]
    return chunks.groupBy("doc_key").agg(multiset_hash(F.to_json(F.struct(*fields))).alias("content_hash"), F.count("*").alias("chunks"))


def change_set(base: DataFrame, now: DataFrame) -> DataFrame:
    """(doc_key, change) with added, deleted, changed, unchanged: each document once. Both hold doc_key, content_hash, recipe_hash."""
    b = base.select("doc_key", F.col("content_hash").alias("bc"), F.col("recipe_hash").alias("br"), F.lit(True).alias("b"))
    n = now.select("doc_key", F.col("content_hash").alias("nc"), F.col("recipe_hash").alias("nr"), F.lit(True).alias("n"))
    same = F.col("bc").eqNullSafe(F.col("nc")) & F.col("br").eqNullSafe(F.col("nr"))
    return b.join(n, "doc_key", "full_outer").select("doc_key", F.when(F.col("b").isNull(), "added").when(F.col("n").isNull(), "deleted").when(same, "unchanged").otherwise("changed").alias("change"))


def generation_id(documents: DataFrame) -> DataFrame:
    """One row: an id of a map doc_key -> segment_hash that doesn't depend on row order and is never gathered."""
    return documents.agg(F.count("*").alias("documents"), multiset_hash(F.concat_ws("\n", "doc_key", "segment_hash")).alias("generation"))


def owners(layers: DataFrame) -> DataFrame:
    """(doc_key, layer): the newest layer that holds a document owns it. layers: doc_key, layer (ordered), deleted."""
    newest = layers.groupBy("doc_key").agg(F.max_by(F.struct("layer", "deleted"), F.struct("layer", "deleted")).alias("x"))
    return newest.select("doc_key", "x.layer", "x.deleted").where(~F.coalesce("deleted", F.lit(False))).select("doc_key", "layer")


COUNTS = ["df_any", "df_nonbody", "df_body"]
#: Documents are spread over so many folders of their terms; a build reads those of the documents it touches.
BUCKETS = 64
#: Documents that newer layers replaced: up to so many are broadcast.
REPLACED = 100_000


def bucket_of(doc_key: Column) -> Column:
    return F.pmod(F.xxhash64(doc_key), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class View:
    """A base and its deltas, or one of them; every table has a column `layer`.

    chunks and postings; documents: doc_key, deleted, content_hash, recipe_hash and totals; terms: what each document adds to the
    statistics, by bucket; stats: signed statistics.
    """

    chunks: DataFrame
    postings: DataFrame
    documents: DataFrame
    stats: DataFrame
    terms: DataFrame
    layers: int = 1

    def tables(self) -> dict[str, DataFrame]:
        return {"chunks": self.chunks, "postings": self.postings, "documents": self.documents, "stats": self.stats, "terms": self.terms}

    def plus(self, delta: View) -> View:
        mine, other = self.tables(), delta.tables()
        return View(*(mine[n].unionByName(other[n]) for n in mine), layers=self.layers + delta.layers)

    def replaced(self) -> DataFrame:
        """(doc_key, layer): documents that a newer layer holds or deletes."""
        newest = self.documents.groupBy("doc_key").agg(F.max("layer").alias("__newest"), F.collect_set("layer").alias("__all"))  # one entry a layer
        return newest.where(F.size("__all") > 1).select("doc_key", F.explode(F.filter("__all", lambda x: x < F.col("__newest"))).alias("layer"))

    def current(self, rows: DataFrame, spread: str, replaced: DataFrame | None = None) -> DataFrame:
        """Rows (doc_key, layer, ...) of documents in the layer that owns them; a lone layer is read as it is."""
        if self.layers == 1:
            return rows
        gone = self.replaced() if replaced is None else replaced
        if at_most(gone, REPLACED):
            return rows.join(F.broadcast(gone), ["doc_key", "layer"], "left_anti")
        key = F.concat_ws(":", "layer", "doc_key")
        return skew_join(rows.withColumn("__k", key), gone.select(key.alias("__k")), "__k", spread, "left_anti").drop("__k")

    def active(self) -> DataFrame:
        """Postings of documents in the layer that owns them."""
        return self.current(self.postings, "chunk_id")

    def token_stats(self) -> DataFrame:
        """Sums over layers; tokens whose counts cancel are gone."""
        if self.layers == 1:
            return self.stats.select("token", *COUNTS)
        return self.stats.groupBy("token").agg(*(F.sum(c).alias(c) for c in COUNTS)).where("df_any > 0")

    def owned(self, touched: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(documents, terms) the view has of the touched documents (doc_key): only their buckets are read."""
        keys = few_values(touched.select("doc_key"))
        docs = seek(self.documents, "doc_key", keys).join(touched, "doc_key", "left_semi")
        mine = docs.join(owners(docs), ["doc_key", "layer"], "left_semi")
        buckets = [r[0] for r in touched.select(bucket_of(F.col("doc_key"))).distinct().collect()]  # at most BUCKETS
        terms = seek(self.terms.where(F.col("bucket").isin(buckets)), "doc_key", keys)
        return mine, terms.join(mine.select("doc_key", "layer"), ["doc_key", "layer"], "left_semi")


def layer_of(chunks: DataFrame, number: int, hashes: DataFrame | None = None) -> View:
    """A layer of the given chunks (all of their documents). hashes: doc_key, content_hash, recipe_hash."""
    at = F.lit(number).alias("layer")
    posts = cut(by_token(postings(chunks)))
    docs = document_totals(chunks, posts)
    if hashes is None:
        docs = docs.withColumn("content_hash", F.lit(None).cast("string")).withColumn("recipe_hash", F.lit(None).cast("string"))
    else:
        docs = docs.join(hashes.select("doc_key", "content_hash", "recipe_hash"), "doc_key", "left")
    terms = token_stats(posts, "doc_key").select("doc_key", "token", *COUNTS, bucket_of(F.col("doc_key")).alias("bucket"), at)
    return View(chunks.select("*", at), posts.select("*", at), docs.select("*", F.lit(False).alias("deleted"), at), token_stats(posts).select("*", at), terms)


def base_view(chunks: DataFrame) -> View:
    """A view of one layer (0)."""
    return layer_of(chunks, 0)


def delta_of(view: View, chunks: DataFrame, deleted: DataFrame, number: int, hashes: DataFrame | None = None, before: DataFrame | None = None) -> View:
    """The layer of new or changed documents (all their chunks) and deletions (doc_key) above a view.

    Only postings of the new chunks are made; what the touched documents had before is taken back by signed statistics, from
    the terms kept by document (`before`, if the caller has them). Neither chunks nor postings of the layers below are read.
    """
    new = layer_of(chunks, number, hashes)
    if before is None:
        before = view.owned(cut(chunks.select("doc_key").unionByName(deleted.select("doc_key")).distinct()))[1]
    old = before.select("token", *((-F.col(c)).alias(c) for c in COUNTS))
    signed = new.stats.select("token", *COUNTS).unionByName(old).groupBy("token").agg(*(F.sum(c).alias(c) for c in COUNTS)).where("df_any <> 0 or df_nonbody <> 0 or df_body <> 0").withColumn("layer", F.lit(number))
    gone = deleted.select("doc_key").distinct().select("doc_key", F.lit(True).alias("deleted"), F.lit(number).alias("layer"))
    return View(new.chunks, new.postings, new.documents.unionByName(gone, allowMissingColumns=True), signed, new.terms)


def add_delta(view: View, chunks: DataFrame, deleted: DataFrame, number: int) -> View:
    """The view with one more layer."""
    return view.plus(delta_of(view, chunks, deleted, number))


def compact(view: View) -> View:
    """The same content as one base layer."""
    return base_view(view.current(view.chunks, "chunk_id").drop("layer"))


def violations(posts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(rule, n): broken invariants of an index; a sound one has no row."""
    rules = [
        ("posting without a frequency", posts.where("title_tf + breadcrumb_tf + body_tf <= 0").agg(F.count("*").alias("n"))),
        ("frequency over field length", posts.where("title_tf > len_title or breadcrumb_tf > len_breadcrumb or body_tf > len_body").agg(F.count("*").alias("n"))),
        ("posting of an unknown chunk", posts.join(chunks.select("chunk_id"), "chunk_id", "left_anti").agg(F.count("*").alias("n"))),
        ("token twice in a chunk", posts.groupBy("token", "chunk_id").count().where("count > 1").agg(F.count("*").alias("n"))),
        ("local id twice in a document", chunks.groupBy("doc_key", "local_id").count().where("count > 1").agg(F.count("*").alias("n"))),
    ]
    out = None
    for name, df in rules:
        part = df.select(F.lit(name).alias("rule"), "n")
        out = part if out is None else out.unionByName(part)
    return out.where("n > 0")


def recomputed(posts: DataFrame, chunks: DataFrame, stats: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(rule, n): what differs from postings and statistics made anew from the chunks; a sound index has no row.

    documents (doc_key): only these are made anew (their postings; statistics need all). Differences are located by checksums, so a
    sound index is compared without joining its postings.
    """
    tf = ["title_tf", "breadcrumb_tf", "body_tf", "len_title", "len_breadcrumb", "len_body"]
    if documents is not None:
        posts, chunks = (t.join(documents, "doc_key", "left_semi") for t in (posts, chunks))
    anew = cut(postings(chunks))
    wrong = [("posting", table_diff.diff(anew.select("token", "chunk_id", *tf), posts.select("token", "chunk_id", *tf), ["token", "chunk_id"], tf))]
    if documents is None:
        wrong.append(("statistics", table_diff.diff(token_stats(anew).select("token", *COUNTS), stats.select("token", *COUNTS), ["token"], COUNTS)))
    out = None
    for name, df in wrong:
        part = df.groupBy(F.concat_ws(" ", F.lit(name), F.when(F.col("issue") == "missing_in_right", "missing").when(F.col("issue") == "missing_in_left", "in excess").otherwise("changed")).alias("rule")).agg(F.count_distinct(F.struct("token", *(["chunk_id"] if name == "posting" else []))).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def validate(posts: DataFrame, chunks: DataFrame, stats: DataFrame, mode: str = "normal", share: float = 0.05, seed: int = 7) -> DataFrame:
    """(rule, n): what is wrong with an index. normal: its invariants; sampled: also the postings of a random share of documents made anew; deep: all postings and statistics made anew."""
    if mode not in ("normal", "sampled", "deep"):
        raise ValueError("mode is normal, sampled or deep")
    found = violations(posts, chunks)
    if mode == "normal":
        return found
    some = cut(chunks.select("doc_key").distinct().sample(share, seed)) if mode == "sampled" else None
    return found.unionByName(recomputed(posts, chunks, stats, some))

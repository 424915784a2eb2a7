"""The library as one object: build and publish an index, then search, read and walk links on a pinned snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .operators import index as ix
from .operators import layers as ly
from .operators import links as lk
from .operators import nodes as nds
from .operators import retrieval as rt
from .operators.chunking import section
from .operators.skew import hot_counts
from .session import small
from .sources.snapshots import SnapshotStore

_TOTALS = [("chunks", "total_chunks"), *((f"{f}_length", f"{f}_length_sum") for f in ix.FIELDS)]


class Library:
    """An index under `root`. Every reader works on the snapshot it was opened with; `refresh` moves it to the published one.

    A snapshot is a small document that names segments (a base and its deltas, written once and never changed) and holds the
    totals and hot tokens of their union, so opening a snapshot reads no table.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, SnapshotStore(spark, root)
        self._cache: dict = {}
        self.refresh()

    def refresh(self) -> None:
        self.snapshot = self.store.current()

    def about(self) -> dict:
        return self._once("about", lambda: self.store.about(self.snapshot))

    def _once(self, what: str, make):
        """Something of the pinned snapshot, made once."""
        key = (self.snapshot, what)
        if key not in self._cache:
            self._cache = {k: v for k, v in self._cache.items() if k[0] == self.snapshot} | {key: make()}
        return self._cache[key]

    def build(self, chunks: DataFrame, mode: str = "incremental", hashes: DataFrame | None = None, compact: bool = True) -> str:
        """Index `chunks` (all of the library's) and publish. Returns `no_op`, `base`, `delta` or `compacted`.

        Incremental builds compare content hashes of documents: nothing changed writes nothing; else only what belongs to
        changed documents is written, as one more segment. If compaction is due then and `compact` is set, the view is rewritten
        as one base. `hashes` (doc_key, content_hash, recipe_hash) of a source that knows them spare reading the chunks of
        unchanged documents.
        """
        if mode not in ("full", "incremental"):
            raise ValueError("mode is full or incremental")
        now = ix.distinct_chunks(chunks)
        if hashes is None:
            hashes = ix.cut(ly.content_hashes(now).select("doc_key", "content_hash", F.lit("1").alias("recipe_hash")))
        self.refresh()
        if mode == "full" or self.snapshot is None:
            self._publish_base(now, hashes)
            return "base"
        changes = ix.cut(ly.change_set(self.fingerprints(), hashes).where("change <> 'unchanged'"))
        touched = changes.select("doc_key")
        keys = ix.few_values(touched)
        if keys == []:
            return "no_op"
        live, deleted = (changes.where(c).select("doc_key") for c in ("change <> 'deleted'", "change = 'deleted'"))
        near = F.broadcast(live) if keys else small(live, ly.REPLACED)
        dirty, fresh = (ix.seek(t, "doc_key", keys).join(near, "doc_key", "left_semi") for t in (chunks, hashes))
        self._publish_delta(ix.cut(ix.distinct_chunks(dirty)), touched, deleted, fresh)
        if compact and self.compaction_due():
            self.compact()
            return "compacted"
        return "delta"

    _LAYOUT = {"terms": ["bucket"]}

    def _write(self, layer: ly.View) -> tuple[str, int]:
        """The segment of a layer and its bytes. Chunks and terms are sorted by document, postings by token, so that lookups skip most pages."""
        tables = layer.tables()
        tables["chunks"] = tables["chunks"].hint("rebalance", F.col("doc_key")).sortWithinPartitions("doc_key", "local_id")
        tables["terms"] = tables["terms"].hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "doc_key")
        segment = self.store.put_segment(tables, self._LAYOUT, {"chunks": {"parquet.bloom.filter.enabled#chunk_id": "true", "parquet.bloom.filter.adaptive.enabled": "true"}})
        return segment, self.store.segment_bytes(segment, *tables)

    def _publish_base(self, chunks: DataFrame, hashes: DataFrame) -> None:
        layer = ly.layer_of(ix.cut(chunks), 0, hashes)
        segment, size = self._write(layer)
        totals = self.store.segments("documents", [segment]).agg(F.count("*").alias("documents"), *(F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in _TOTALS)).first()
        self._publish([segment], [size], totals.asDict())

    def _publish_delta(self, chunks: DataFrame, touched: DataFrame, deleted: DataFrame, hashes: DataFrame) -> None:
        about, view = self.about(), self.view()
        documents, terms = view.owned(touched)
        before = documents.agg(F.count("*").alias("documents"), *(F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in _TOTALS)).first()
        segment, size = self._write(ly.delta_of(view, chunks, deleted, about["next"], hashes, terms))
        after = self.store.segments("documents", [segment]).where("not deleted").agg(F.count("*").alias("documents"), *(F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in _TOTALS)).first()
        self._publish([*about["segments"], segment], [*about["bytes"], size], {k: v + after[k] - before[k] for k, v in about["totals"].items()}, about["next"])

    def _publish(self, segments: list[str], sizes: list[int], totals: dict, number: int = 0) -> None:
        # what is hot decides only how rows are spread: a base tells it for its deltas too
        hot = self.about()["hot"] if number else hot_counts(self._view(segments).stats, "token", "df_any")
        self.snapshot = self.store.describe({"segments": segments, "bytes": sizes, "totals": totals, "hot": hot, "next": number + 1})
        self.store.publish(self.snapshot)

    def _view(self, segments: list[str]) -> ly.View:
        return ly.View(*(self.store.segments(n, segments) for n in ("chunks", "postings", "documents", "stats", "terms")), layers=len(segments))

    def view(self) -> ly.View:
        return self._once("view", lambda: self._view(self.about()["segments"]))

    def fingerprints(self) -> DataFrame:
        """(doc_key, content_hash, recipe_hash) of the documents of the pinned view."""
        v = self.view()
        return v.current(v.documents, "doc_key", self._replaced()).where("not deleted").select("doc_key", "content_hash", "recipe_hash")

    def _replaced(self) -> DataFrame | None:
        v = self.view()
        return None if v.layers == 1 else self._once("replaced", lambda: ix.cut(v.replaced()))

    def index(self) -> ix.Index:
        """The pinned view as one index: merge on read."""

        def make() -> ix.Index:
            v, about = self.view(), self.about()
            chunks, posts = (v.current(t, "chunk_id", self._replaced()).drop("layer") for t in (v.chunks, v.postings))
            return ix.Index(chunks, posts, v.token_stats(), Row(**about["totals"]), about["hot"])

        return self._once("index", make)

    def compaction_due(self) -> bool:
        return ly.compaction_due(self.about()["bytes"])

    def compact(self) -> str:
        """Rewrite the view as one base layer; an error if it is one already."""
        v = self.view()
        if v.layers == 1:
            raise ValueError("already compact")
        self._publish_base(v.current(v.chunks, "chunk_id", self._replaced()).drop("layer"), self.fingerprints())
        return "base"

    def snapshot_info(self) -> Row | None:
        """(documents, total_chunks, length sums) of the pinned snapshot; None before the first publication."""
        return Row(**self.about()["totals"]) if self.snapshot else None

    def search(self, queries: DataFrame | str, limit: int = 20) -> DataFrame:
        """Ranked hits (query_id, rank, doc_key, chunk_id, title, breadcrumb, text, score) of one text or a table of (query_id, query).

        Before the first publication there are no hits. limit lies in 1..100.
        """
        if not isinstance(limit, int) or isinstance(limit, bool) or not 1 <= limit <= 100:
            raise ValueError("limit must be an integer between 1 and 100")
        if isinstance(queries, str):
            queries = self.spark.createDataFrame([("q", queries)], "query_id string, query string")
        elif not isinstance(queries, DataFrame):
            raise TypeError("a text or a table of queries")
        shape = "query_id string, rank int, doc_key string, chunk_id string, title string, breadcrumb string, text string, score double"
        if self.snapshot is None:
            return self.spark.createDataFrame([], shape)
        i = self.index()
        hits = ix.cut(rt.multi_path(queries, i, limit).select("query_id", "rank", "doc_key", "chunk_id", "score"))
        found = rt.payload(hits, i, "title", F.concat_ws(" > ", "breadcrumb").alias("breadcrumb"), F.col("body").alias("text"))
        return found.select("query_id", "rank", "doc_key", "chunk_id", "title", "breadcrumb", "text", "score").orderBy("query_id", "rank")

    def list_documents(self, doc_type: str | None = None) -> DataFrame:
        """(doc_key, doc_type, slug, title, chunks) by type, title (lower case), key."""
        v = self.view()
        out = nds.split_doc_key(v.current(v.documents, "doc_key", self._replaced()).where("not deleted"))
        return (out.where(F.col("doc_type") == doc_type) if doc_type else out).select("doc_key", "doc_type", "slug", "title", "chunks").orderBy("doc_type", F.lower("title"), "doc_key")

    def _owner(self, doc_key: str) -> int | None:
        """The layer that holds a document; None if none does."""
        row = self.view().documents.where(F.col("doc_key") == doc_key).agg(F.max(F.struct("layer", "deleted")).alias("x")).first()["x"]
        return None if row is None or row["deleted"] else row["layer"]

    def read_document(self, doc_key: str) -> DataFrame:
        """The chunks of a document in order; the key is looked up in the sorted tables."""
        owner = self._owner(doc_key)
        return self.view().chunks.where((F.col("doc_key") == doc_key) & (F.col("layer") == (-1 if owner is None else owner))).drop("layer").orderBy("local_id", "chunk_id")

    def read_section(self, chunk_id: str, start: int = 0, end: int = 0) -> str | None:
        """Lines start..end of a chunk (0-based, end excluded; 0: to its end); None if there is no such chunk."""
        rows = self.view().chunks.where(F.col("chunk_id") == chunk_id).select("doc_key", "layer", section(F.col("body"), F.lit(start), F.lit(end)).alias("s")).collect()  # one a layer at most
        return next((r["s"] for r in rows if self._owner(r["doc_key"]) == r["layer"]), None)

    def links(self, catalog: DataFrame) -> Links:
        """Links between the documents of a catalog (doc_id, doc_type, title, aliases, status)."""
        c = self.index().chunks
        texts = c.select(F.col("doc_key").alias("source_id"), F.col("chunk_id").alias("source_md"), F.col("body").alias("text"))
        return Links(ix.cut(lk.resolve(lk.parse_links(texts), catalog, lk.heading_map(c))), catalog)


class Links:
    """The resolved edges of a catalog, computed once."""

    def __init__(self, edges: DataFrame, catalog: DataFrame):
        self.edges, self.catalog = edges, catalog

    @staticmethod
    def _is(doc_id: str) -> Column:
        return F.col("doc_id") == doc_id

    def backlinks(self, doc_id: str | None = None) -> DataFrame:
        out = lk.backlinks(self.edges, self.catalog)
        return out.where(self._is(doc_id)) if doc_id else out

    def neighborhood(self, doc_id: str | None = None, limit: int = 40) -> DataFrame:
        out = lk.neighborhood(self.edges, self.catalog, limit)
        return out.where(self._is(doc_id)) if doc_id else out

    def diagnostics(self) -> DataFrame:
        return lk.diagnostics(self.edges)

    def preview(self, doc_id: str) -> DataFrame:
        return self.catalog.where(self._is(doc_id))

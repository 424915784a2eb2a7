"""Publishing an index: immutable snapshot folders and one small pointer that is replaced atomically."""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut


class SnapshotStore:
    """Tables of snapshots under one root; readers pin a snapshot and are never shown a half-written one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}")

    def put(self, tables: dict[str, DataFrame], partition_by: dict[str, list[str]] | None = None) -> str:
        """Write tables as a new snapshot; returns its id. Not visible before `publish`."""
        snapshot = uuid.uuid4().hex
        for name, df in tables.items():
            writer = df.write.mode("errorifexists")
            if cols := (partition_by or {}).get(name):
                writer = writer.partitionBy(*cols)
            writer.parquet(f"{self.root}/snapshots/{snapshot}/{name}")
        return snapshot

    def put_segment(self, tables: dict[str, DataFrame], partition_by: dict[str, list[str]] | None = None, options: dict[str, dict[str, str]] | None = None) -> str:
        """Write tables as a new segment, which any number of snapshots can be made of; returns its id."""
        segment = uuid.uuid4().hex

        def write(name: str) -> None:
            df = tables[name]
            df.write.mode("errorifexists").options(**(options or {}).get(name, {})).partitionBy(*(partition_by or {}).get(name, [])).parquet(f"{self.root}/segments/{name}/segment={segment}")

        with ThreadPoolExecutor(len(tables)) as pool:  # a few tables; small ones don't wait for each other
            list(pool.map(write, tables))
        return segment

    def segment_bytes(self, segment: str, *names: str) -> int:
        """Bytes of a segment's tables."""
        return sum(self._fs.getContentSummary(self._path(f"segments/{n}/segment={segment}")).getLength() for n in names)

    def segments(self, name: str, ids: list[str]) -> DataFrame:
        """The rows of a table in some segments."""
        at = f"{self.root}/segments/{name}"
        return self.spark.read.option("basePath", at).parquet(*(f"{at}/segment={i}" for i in ids)).drop("segment")

    def describe(self, about: dict) -> str:
        """A new snapshot that is told by a small document (of which segments it consists, and what is known of them); returns its id."""
        snapshot = uuid.uuid4().hex
        self._write(self._path(f"snapshots/{snapshot}/about.json"), json.dumps(about))
        return snapshot

    def about(self, snapshot: str) -> dict:
        return json.loads(self._read(self._path(f"snapshots/{snapshot}/about.json")))

    def _write(self, path, text: str) -> None:
        out = self._fs.create(path, True)
        out.write(bytearray(text.encode()))
        out.close()

    def _read(self, path) -> str:
        stream = self._fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, snapshot: str) -> None:
        """Point readers at a snapshot: the pointer is written aside and renamed over the old one."""
        if not self._fs.exists(self._path(f"snapshots/{snapshot}")):
            raise ValueError(f"no snapshot {snapshot}")
        aside = self._path(f"_pointer-{uuid.uuid4().hex}")
        self._write(aside, json.dumps({"snapshot": snapshot}))
        context = self._hadoop.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(aside, self._path("current.json"), options)

    def current(self) -> str | None:
        """The published snapshot, or None before the first publication."""
        if not self._fs.exists(self._path("current.json")):
            return None
        return json.loads(self._read(self._path("current.json")))["snapshot"]

    def table(self, name: str, snapshot: str | None = None) -> DataFrame:
        """A table of a pinned snapshot (default: the published one)."""
        pin = snapshot or self.current()
        if pin is None:
            raise ValueError("nothing is published")
        return self.spark.read.parquet(f"{self.root}/snapshots/{pin}/{name}")


class SegmentStore:
    """Content-addressed segments under one root, reused by (doc_key, content_hash, segment_recipe_hash)."""

    KEY = ["doc_key", "content_hash", "segment_recipe_hash"]

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, f"{root.rstrip('/')}/segments"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._empty = lambda: not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    def get(self, keys: DataFrame) -> DataFrame:
        """The stored segments of reuse keys (KEY); keys compare null-safe."""
        if self._empty():
            return self.spark.createDataFrame([], "doc_key string, content_hash string, segment_recipe_hash string, segment_hash string, payload string")
        return _by_key(self.spark.read.parquet(self.root).drop("prefix"), keys.select(*self.KEY).distinct(), "left_semi")

    def put(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Store (KEY, payload) that the store lacks; returns (rows told reused or written, conflicts).

        The segment hash is that of the payload. A reuse key with another payload, in the store or among the rows, is a conflict: none of
        its rows is written. Folders are named by the first digits of the hash.
        """
        new = cut(rows.select(*self.KEY, "payload").distinct().withColumn("segment_hash", F.sha2("payload", 256)))
        old = cut(self.get(new))
        bad = cut(conflicts(new.select(*self.KEY, "segment_hash").unionByName(old.select(*self.KEY, "segment_hash"))))
        good = _by_key(new, bad, "left_anti")
        told = cut(_by_key(good, old.select(*self.KEY).distinct().withColumn("reused", F.lit(True)), "left").withColumn("reused", F.coalesce("reused", F.lit(False))))
        fresh = told.where("not reused").drop("reused").withColumn("prefix", F.substring("segment_hash", 1, 2))
        fresh.repartition("prefix", "segment_hash").write.mode("append").partitionBy("prefix").parquet(self.root)
        return told.drop("payload"), bad


def _by_key(rows: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """A null-safe join on the reuse key."""
    right = other.withColumnsRenamed({k: f"__{k}" for k in SegmentStore.KEY})
    on = F.lit(True)
    for k in SegmentStore.KEY:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(right, on, how).drop(*(f"__{k}" for k in SegmentStore.KEY))


def conflicts(segments: DataFrame) -> DataFrame:
    """(doc_key, content_hash, segment_recipe_hash, hashes): reuse keys that name more than one segment."""
    return segments.groupBy("doc_key", "content_hash", "segment_recipe_hash").agg(F.count_distinct("segment_hash").alias("hashes")).where("hashes > 1")


def export_json(df: DataFrame, path: str) -> None:
    """A table as JSON lines."""
    df.write.mode("overwrite").json(path)

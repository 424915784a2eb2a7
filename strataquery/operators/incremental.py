"""Processing only new or changed records, driven by a manifest of what the last successful work had."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import cut
from ..sources.files import file_records, list_tree, read_tree


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFC")


def nfc(df: DataFrame, column: str) -> DataFrame:
    """df with `column` in Unicode NFC.

    ASCII values are NFC already; they never leave the JVM: the two kinds of rows are separate branches.
    """
    plain = F.coalesce(F.col(column).rlike(r"^\p{ASCII}*$"), F.lit(True))
    return df.where(plain).unionByName(df.where(~plain).withColumn(column, _nfc(F.col(column))))


def _lower_hash(c: str) -> Column:
    return F.lower(F.col(c))


def listing(captures: DataFrame) -> DataFrame:
    """The state now: (doc_key, content_hash, segment_recipe_hash, deleted) of the newest readable capture.

    Captures with a null content_hash that are not deletions are unreadable and left out; rows without
    doc_key too. Keys are compared in NFC, hashes in lower case. Among captures of one moment the one that
    arrived last, then the greatest values, win. One pass, merged before the shuffle: a document with any
    number of captures costs one row a task.
    """
    readable = captures.where(F.col("doc_key").isNotNull() & (F.col("content_hash").isNotNull() | F.coalesce(F.col("deleted"), F.lit(False))))
    rows = nfc(readable.select("doc_key", _lower_hash("content_hash").alias("content_hash"), _lower_hash("segment_recipe_hash").alias("segment_recipe_hash"), F.coalesce("deleted", F.lit(False)).alias("deleted"), "captured_at", "arrived_at"), "doc_key")
    value = F.struct("content_hash", "segment_recipe_hash", "deleted")
    newest = rows.groupBy("doc_key").agg(F.max_by(value, F.struct("captured_at", "arrived_at", value)).alias("v"))
    return newest.select("doc_key", "v.*")


def manifest_of_runs(written: DataFrame, runs: DataFrame) -> DataFrame:
    """The state built: what the newest row of a succeeded run had, (doc_key, content_hash, segment_recipe_hash).

    What failed runs wrote is never part of it, so a failure neither skips nor hides a document.
    """
    good = runs.where("status = 'succeeded'").select("run_id").distinct()
    kept = written.where(F.col("doc_key").isNotNull()).join(good, "run_id", "left_semi")
    rows = nfc(kept.select("doc_key", _lower_hash("content_hash").alias("content_hash"), _lower_hash("segment_recipe_hash").alias("segment_recipe_hash"), "stored_at", "run_id"), "doc_key")
    value = F.struct("content_hash", "segment_recipe_hash")
    newest = rows.groupBy("doc_key").agg(F.max_by(value, F.struct("stored_at", "run_id", value)).alias("v"))
    return newest.select("doc_key", "v.*")


def _checksum() -> Column:
    """Both hashes as one value; a missing hash differs from an empty one."""
    return F.to_json(F.struct("content_hash", "segment_recipe_hash"))


def pending(now: DataFrame, built: DataFrame, root: str) -> DataFrame:
    """(doc_key, change): `added` where the manifest has nothing, `changed` where content or recipe differ. Deleted documents are no case.

    The state built is the first commit of a manifest under `root`; the documents of the state now are listed against it, and
    the batch of what is pending is written and committed there.
    """
    m = Manifest(now.sparkSession, root)
    m.adopt(built.select(F.col("doc_key").alias("path"), F.lit(None).cast("bigint").alias("size"), _checksum().alias("checksum")))
    listed = now.where(~F.col("deleted")).select(F.col("doc_key").alias("path"), F.lit(None).cast("bigint").alias("size"), _checksum().alias("checksum"))
    batch = m.run(listed, lambda todo: todo.select("path", "change"))
    if batch is None:
        return now.sparkSession.createDataFrame([], "doc_key string, change string")
    return m.result().where(F.col("batch") == batch).select(F.col("path").alias("doc_key"), "change")


class Manifest:
    """Exactly-once processing of changing inputs.

    The manifest holds (path, size, checksum, batch, number) of every input whose work is committed; commits are numbered.
    ``run`` takes the anti-join of a listing against the newest manifest row of each path and freezes it: one written list
    names the batch, is worked on, and becomes the commit, whatever happens to the inputs meanwhile. The result is written
    under a folder named by the batch; the list is renamed into the manifest last. The batch id is a hash of the commit's
    number and of what is pending: a run that died before its commit is repeated under the same name and overwrites its own
    leftovers, an input that returns to an earlier state is a new batch, and nothing is skipped or done twice. Of two runs at
    once only one commits.
    """

    schema = "path string, size bigint, checksum string, batch string, number bigint"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def committed(self) -> DataFrame:
        """Inputs whose work is committed; each commit is one folder that appears by a rename."""
        at = f"{self.root}/manifest"
        if not self._exists(at):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(at)

    def newest(self) -> DataFrame:
        """(path, size, checksum, batch) of each input's last commit."""
        value = F.struct("size", "checksum", "batch")
        return self.committed().groupBy("path").agg(F.max_by(value, F.struct("number", value)).alias("v")).select("path", "v.*")

    def adopt(self, rows: DataFrame) -> None:
        """Take (path, size, checksum), what an earlier system has processed, as the first commit. Its results stay where they are."""
        if self._exists(f"{self.root}/manifest"):
            raise ValueError("the manifest has commits already")
        self._commit(self._stage(rows.select("path", "size", "checksum"), "adopted", 0), "adopted")

    def pending(self, listing: DataFrame) -> DataFrame:
        """(path, size, checksum, change) of inputs that are new, or whose size or checksum is not what was committed last.

        One pass over rows placed by path tells what is `added` from what `changed`.
        """
        done = self.newest().select(F.col("path").alias("__p"), F.col("size").alias("__s"), F.col("checksum").alias("__c"))
        met = listing.select("path", "size", "checksum").distinct().join(done, F.col("path") == F.col("__p"), "left")
        same = F.col("__p").isNotNull() & F.col("size").eqNullSafe(F.col("__s")) & F.col("checksum").eqNullSafe(F.col("__c"))
        return met.where(~same & F.col("path").isNotNull()).select("path", "size", "checksum", F.when(F.col("__p").isNull(), "added").otherwise("changed").alias("change"))

    def _stage(self, rows: DataFrame, batch: str, number: int) -> str:
        at = f"{self.root}/_staged/{uuid.uuid4().hex}"
        rows.select("path", "size", "checksum", F.lit(batch).alias("batch"), F.lit(number).cast("bigint").alias("number")).write.parquet(at)
        return at

    def _commit(self, staged: str, batch: str) -> None:
        """The staged list becomes part of the manifest at once; a batch that is there already stays as it is."""
        final = self._path(f"{self.root}/manifest/{batch}")
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(self._path(staged), final, none)
        except Py4JJavaError:
            if not self._fs.exists(final):
                raise
            self._fs.delete(self._path(staged), True)

    def run(self, listing: DataFrame, work: Callable[[DataFrame], DataFrame]) -> str | None:
        """Process what is pending of a listing (path, size, checksum); returns the batch id, or None if nothing is.

        `work` gets the pending inputs (path, size, checksum, change) and returns the rows to write, each with the `path` of its input.
        """
        todo = cut(self.pending(listing))
        # The id comes from sums over all rows, not from their list: nothing is gathered on the driver.
        h = F.xxhash64("path", "size", "checksum")
        row = todo.agg(F.count("*").alias("n"), F.sum(F.shiftright(h, 20)).alias("a"), F.bit_xor(h).alias("x")).first()
        if not row["n"]:
            return None
        number = (self.committed().agg(F.max("number")).first()[0] or 0) + 1
        batch = hashlib.sha256(json.dumps([number, row["n"], row["a"], row["x"]]).encode()).hexdigest()[:24]
        staged = self._stage(todo, batch, number)
        rows = work(todo)
        if "path" not in rows.columns:
            raise ValueError("the rows need the path of their input, by which newer ones take their place")
        rows.write.mode("overwrite").parquet(f"{self.root}/data/batch={batch}")
        self._commit(staged, batch)
        return batch

    def result(self) -> DataFrame:
        """Rows of committed batches only, newest batch of every input."""
        return self.spark.read.parquet(f"{self.root}/data").join(self.newest().select("path", "batch"), ["path", "batch"], "left_semi")


class FileManifest(Manifest):
    """A manifest of the files of a folder, by size and checksum."""

    def list_input(self, source: str, suffix: str = "", checksum: bool = True) -> DataFrame:
        """(path, size, checksum) of the files under source; the bytes are read only if `checksum`."""
        files = file_records(read_tree(self.spark, source, suffix)) if checksum else list_tree(self.spark, source, suffix)
        mark = F.col("sha256") if checksum else F.col("modificationTime").cast("string")
        return files.select("path", F.col("length").alias("size"), mark.alias("checksum"))

    def pending_files(self, source: str, suffix: str = "", checksum: bool = True) -> DataFrame:
        return self.pending(self.list_input(source, suffix, checksum))

    def run_files(self, source: str, work: Callable[[DataFrame], DataFrame], suffix: str = "", checksum: bool = True) -> str | None:
        """Process the files under `source` that are new or changed."""
        return self.run(self.list_input(source, suffix, checksum), work)

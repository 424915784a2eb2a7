"""Session helpers: table loading, and cutting lineage in storage that every executor shares."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where the cluster names it.

    Only on one machine (a local master) a temporary folder is made where that is unset; on a cluster executors could not read
    each other's, so an unset folder is an error there.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    context = spark.sparkContext
    if not getattr(context, "_strataquery_shared", None):
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context._strataquery_shared = Path(tempfile.mkdtemp(prefix="strataquery-")).as_uri()
    return context._strataquery_shared


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system, in the form that Spark and Arrow read alike."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return f"file://{full[5:]}" if full.startswith("file:/") and not full.startswith("file://") else full


def scratch(spark: SparkSession, name: str = "cut") -> str:
    """A new folder under the shared one, as a URI; it is deleted when the application ends."""
    context, jvm = spark.sparkContext, spark._jvm
    home = f"{qualified(spark, shared_dir(spark))}/strataquery-{context.applicationId}"
    if getattr(context, "_strataquery_scratch", None) != home:
        path = jvm.org.apache.hadoop.fs.Path(home)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        context._strataquery_scratch = home
    return f"{home}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it from there: computed once, and kept when executors are lost.

    The copy is Parquet, so what reads it gets column pruning, pushed filters and sizes for the planner.
    """
    spark = df.sparkSession
    at = scratch(spark)
    df.write.option("compression", "lz4").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether df has `rows` rows or fewer; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast if it has at most `rows` rows; else as it is, for a plain join."""
    return F.broadcast(df) if at_most(df, rows) else df


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers wherever they run: the driver serves it as one archive, once an application."""
    context = spark.sparkContext
    if getattr(context, "_strataquery_shipped", False):
        return
    package = Path(__file__).resolve().parent
    where = Path(tempfile.mkdtemp(prefix="strataquery-code-"))
    staged = where / "tree" / package.name
    shutil.copytree(package, staged, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(where / package.name), "zip", staged.parent))
    context._strataquery_shipped = True

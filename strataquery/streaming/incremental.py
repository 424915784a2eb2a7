"""Incremental index maintenance as a stream of document changes, one delta layer a micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import distinct_chunks, postings, token_stats
from ..session import cut


def signed_statistics(chunks: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """(token, df_any, df_nonbody, df_body) signed: what chunks add less what removed ones took."""
    cols = ["df_any", "df_nonbody", "df_body"]
    plus = token_stats(postings(distinct_chunks(chunks)))
    if removed is None:
        return plus
    minus = token_stats(postings(distinct_chunks(removed))).select("token", *((-F.col(c)).alias(c) for c in cols))
    return plus.unionByName(minus).groupBy("token").agg(*(F.sum(c).alias(c) for c in cols)).where("df_any <> 0 or df_nonbody <> 0 or df_body <> 0")


def maintain(spark: SparkSession, source: str, schema, root: str, checkpoint: str):
    """A streaming query over new chunk files: each micro-batch writes its signed token statistics as layer `batch=<id>`.

    A chunk that comes again in a later batch replaces what it was: the batch takes the statistics of the newest earlier version
    back. Only versions of the batch's own chunks are read from the kept ones. A batch that is repeated after a failure reads
    earlier batches only and overwrites its own layer, so every chunk counts exactly once; the view is the
    sum over layers. Returns the started query (available-now trigger).
    """

    def layer(batch: DataFrame, number: int) -> None:
        now = cut(distinct_chunks(batch).withColumn("batch", F.lit(number)))
        kept = f"{root}/chunks"
        before = None
        if number and _exists(spark, kept):
            seen = spark.read.schema(now.schema).parquet(kept).where(F.col("batch") < number)
            mine = seen.join(now.select("chunk_id"), "chunk_id", "left_semi")
            before = mine.groupBy("chunk_id").agg(F.max_by(F.struct(*[c for c in now.columns if c != "chunk_id"]), "batch").alias("x")).select("chunk_id", "x.*")
        signed_statistics(now, before).write.mode("overwrite").parquet(f"{root}/stats/batch={number}")
        now.drop("batch").write.mode("overwrite").parquet(f"{kept}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(layer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def view_statistics(spark: SparkSession, root: str) -> DataFrame:
    """Token statistics summed over all layers written so far."""
    cols = ["df_any", "df_nonbody", "df_body"]
    return spark.read.parquet(f"{root}/stats").groupBy("token").agg(*(F.sum(c).alias(c) for c in cols)).where("df_any > 0")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) by tumbling windows with a watermark; works on streams and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")

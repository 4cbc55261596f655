"""Run records that keep arriving, into one tidy table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import cohort as C


def tidy_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Records (JSON lines, one a sample) of a folder as a stream of tidy rows.

    Every row stands for itself: no state, no watermark. Files already read are
    remembered by the sink's checkpoint.
    """
    records = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).json(folder)
    loci = records.select("sample_id", F.explode("results").alias("r")).select("sample_id", "r.*")
    loci = loci.withColumn("needs_review", F.exists("flags", lambda f: f["severity"].isin("warn", "error")))
    return C.tidy(loci)


def start(tidy: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends to a Parquet table; with ``once`` it stops when the folder is read."""
    writer = tidy.writeStream.format("parquet").option("path", path).option("compression", "zstd").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def per_batch(tidy: DataFrame, handle, checkpoint: str) -> StreamingQuery:
    """``handle(rows, batch id)`` for each micro-batch: where loci were once handed on one by one."""
    return tidy.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

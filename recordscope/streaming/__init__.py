"""Incremental variants: access facts and judged documents that keep arriving."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import DOCUMENTS


def access_stream(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).load(folder)


def field_counts(accesses: DataFrame, time: str, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Accesses per field, type and time window; late rows are dropped after the watermark's delay, which is the caller's choice."""
    return accesses.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), "base", "offset", "dt").agg(F.count("*").alias("n"), F.max("size").alias("size")).select(F.col("w.start").alias("start"), "base", "offset", "dt", "n", "size")


def judged_stream(spark: SparkSession, folder: str, kind: str = "global_morph") -> DataFrame:
    """(path, doc) of documents as they are put into a folder."""
    text = spark.readStream.option("wholetext", "true").text(folder).select(F.col("_metadata.file_path").alias("path"), "value")
    return text.select("path", F.from_json("value", DOCUMENTS[kind]).alias("doc"))


def each_batch(stream: DataFrame, put: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs put(batch, number) for all that is there now; the checkpoint makes batches repeatable."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()

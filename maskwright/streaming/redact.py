"""Structured Streaming: redaction is stateless, so a stream is one narrow stage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one of this machine
    only where it is unset and Spark runs on this machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return named or tempfile.mkdtemp(prefix="maskwright-")


def text_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """A stream of a folder's text lines (text); blank lines are skipped."""
    return spark.readStream.options(**options).text(path).select(F.col("value").alias("text")).filter(F.length("text") > 0)


def table_stream(spark: SparkSession, path: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a table."""
    whole = f"{path}/{name}"
    reader = spark.readStream.schema(spark.read.parquet(whole).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    place = spark._jvm.org.apache.hadoop.fs.Path(whole)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(whole)
    # a stream reads folders: one file is named by a filter on its folder
    return reader.option("pathGlobFilter", name).parquet(path)


def write_stream(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a redacted stream to Parquet; restarts go on from the checkpoint."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_label_counts(redacted: DataFrame, at_col: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Spans by label and event-time window, with a watermark for late rows."""
    spans = redacted.withWatermark(at_col, late).select(F.col(at_col), F.explode("detected_spans").alias("s"))
    return spans.groupBy(F.window(at_col, window).alias("window"), F.col("s.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))

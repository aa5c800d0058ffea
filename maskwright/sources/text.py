"""Texts from files, and evaluation records from JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "struct<text: string, spans: array<struct<label: string, start: int, end: int>>>"


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file as one text, without line ends at its end."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    return files.select("path", F.regexp_replace("value", r"\n+$", "").alias("text"))


def eval_records(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(doc_id, text, spans) of a JSON-lines file; doc_id is the line's number.

    Blank lines are skipped but count toward ``limit``, a number of lines. Missing
    spans are none; a record without a text fails. Line numbers come from one file
    read whole, the format's own bound; without a limit any number of files is read
    in splits and doc_id is only unique.
    """
    if limit is None:
        lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("doc_id"), F.col("value"))
    else:
        whole = spark.read.text(path, wholetext=True)
        lines = whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("doc_id", "value")).filter(F.col("doc_id") < limit)
        lines = lines.withColumn("doc_id", F.col("doc_id").cast("long"))
    parsed = lines.filter(F.trim("value") != "").select("doc_id", F.from_json("value", RECORD, {"mode": "FAILFAST"}).alias("r"))
    text = F.when(F.col("r.text").isNull(), F.raise_error(F.lit("a record has no text"))).otherwise(F.col("r.text"))
    none = F.expr("cast(array() as array<struct<label: string, start: int, end: int>>)")
    return parsed.select("doc_id", text.alias("text"), F.coalesce("r.spans", none).alias("spans"))


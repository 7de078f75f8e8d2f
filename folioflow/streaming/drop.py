"""Streams: a drop directory of documents, and progress events without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.text import clean_text, strip_inline_citations


def dropped(spark: SparkSession, path: str, schema: str, form: str = "parquet") -> DataFrame:
    """Rows of files as they appear in a directory."""
    return spark.readStream.schema(schema).format(form).load(path)


def cleaned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.withColumn(text_col, strip_inline_citations(clean_text(F.col(text_col))))


def progress(events: DataFrame, key: list[str], time_col: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Events without those that repeat a key within the watermark."""
    return events.withWatermark(time_col, late).dropDuplicatesWithinWatermark(key)


def counts(events: DataFrame, by: str, time_col: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, width), by).agg(F.count(F.lit(1)).alias("n"))

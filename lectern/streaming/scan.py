"""Streaming forms: texts scanned as they arrive, and findings counted by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.functions.text import split_lines, strip


def text_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Whole Markdown files of a folder, as they appear."""
    return spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def fill_lines(texts: DataFrame) -> DataFrame:
    """Per text, the number of lines filled with underscores; stateless, so rows are appended."""
    filled = F.filter(F.transform(split_lines(F.col("text")), strip), lambda s: F.contains(s, F.lit("_" * 12)) & (F.length(s) - F.length(F.replace(s, F.lit("_"), F.lit(""))) >= 0.3 * F.length(s)))
    return texts.select("path", F.size(filled).alias("fill_lines"))


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Events (ts, event_type) counted by window and type; ``late`` is the watermark of a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", length, slide).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Events of each user in sessions that end after a gap."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")

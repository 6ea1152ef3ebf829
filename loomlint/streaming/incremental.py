"""Incremental scans: new files of a folder are scanned as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.rules import Rule, hits
from ..sources.files import select_files


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(file, language, content) of text files that arrive in ``folder``."""
    raw = spark.readStream.format("text").option("wholetext", "true").load(folder)
    return select_files(raw.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content")))


def stream_rules(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """(file, line_no, rule_id): stateless, so files may come late and in any order."""
    found = hits(C.lines(F.col("content")), rules, F.col("language"))
    return files.select("file", F.explode(found).alias("h")).select("file", (F.col("h.line") + 1).alias("line_no"), F.col("h.rule").alias("rule_id"))


def windowed_counts(events: DataFrame, at: str, key: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts by key in tumbling windows; rows later than ``late`` are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def start(issues: DataFrame, folder: str, checkpoint: str):
    """Append issues to Parquet; once per trigger of what is there."""
    return issues.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

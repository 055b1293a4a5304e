"""Run records and event lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

RECORD_SCHEMA = """
    task_slug string, is_lower_better boolean,
    submissions array<struct<kind string, attempt int, status string, score double, error string, duration_seconds double>>,
    final_result struct<status string, score double, error string, failure_code string>,
    final_score double, final_status string
"""
EVENT_SCHEMA = "timestamp string, type string, tool string, attempt int, queue string, slot int, wait_seconds double, status string, duration_seconds double"


def run_state(score, failure, readable) -> F.col:
    """scored, fail:<code>, or err for an unreadable record."""
    return (
        F.when(~readable, "err").when(score.isNotNull(), "scored")
        .otherwise(F.concat(F.lit("fail:"), F.coalesce(failure, F.lit("None"))))
    )


def scan_runs(spark: SparkSession, path: str, key_pattern: str, keys: list[str]) -> DataFrame:
    """One row per ``scores.json`` below ``path``; keys are groups of the path pattern."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "scores.json").text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value")
    )
    doc = raw.withColumn("doc", F.from_json("value", RECORD_SCHEMA))
    readable = F.try_parse_json("value").isNotNull()
    found = [F.regexp_extract("file", key_pattern, i + 1).alias(k) for i, k in enumerate(keys)]
    return doc.select(
        *found, run_state(F.col("doc.final_score"), F.col("doc.final_result.failure_code"), readable).alias("state"),
        F.col("doc.final_score").alias("score"), F.col("doc.is_lower_better").alias("lower_better"),
    )


def scan_run_lines(spark: SparkSession, path: str, key_pattern: str, keys: list[str]) -> DataFrame:
    """Run records stored one per line; keys come from the folder names of the path."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    doc = raw.withColumn("doc", F.from_json("value", RECORD_SCHEMA + ", task long, run long"))
    found = [F.regexp_extract("file", key_pattern, i + 1).alias(k) for i, k in enumerate(keys)]
    readable = F.try_parse_json("value").isNotNull()
    return doc.select(
        *found, F.col("doc.task").alias("task"), F.col("doc.run").alias("run"),
        run_state(F.col("doc.final_score"), F.col("doc.final_result.failure_code"), readable).alias("state"), F.col("doc.final_score").alias("score"),
    )


def with_expected(runs: DataFrame, grid: DataFrame, cell: list[str], started: DataFrame) -> DataFrame:
    """Expected grid with states; cells without a record are running when started, else pending."""
    marked = started.select(*cell).distinct().withColumn("_s", F.lit(True))
    j = grid.join(runs, cell, "left").join(marked, cell, "left")
    state = F.coalesce("state", F.when(F.col("_s"), "running").otherwise("pending"))
    return j.withColumn("state", state).drop("_s")


def scan_events(spark: SparkSession, path: str) -> DataFrame:
    """Append-only JSON event lines with a parsed time."""
    return spark.read.schema(EVENT_SCHEMA).json(path).withColumn("ts", F.to_timestamp("timestamp"))

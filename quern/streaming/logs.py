"""Streaming jobs over the event log.

Each ``start_*`` returns a started query whose sink is a folder. Sinks write a
folder per micro-batch, so a replayed batch replaces its own output and nothing
is counted twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quern.session import materialise


def event_stream(spark: SparkSession, directory: str, name: str = "events") -> DataFrame:
    """Parquet event files as a stream, with a time-zone aware event time."""
    schema = spark.read.parquet(f"{directory}/{name}.parquet").schema
    raw = (
        spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").option("maxFilesPerTrigger", 100)
        .parquet(directory)
    )
    return raw.withColumn("event_time", F.col("ts").cast("timestamp"))


def landing_stream(spark: SparkSession, schema: StructType, folder: str) -> DataFrame:
    """Parquet files of the subfolders of ``folder`` as a stream, whatever has landed since the last run."""
    raw = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1000).parquet(folder)
    return raw.withColumn("event_time", F.col("ts").cast("timestamp"))


def batch_folder(sink: str) -> Callable[[DataFrame, int], None]:
    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{sink}/batch={batch:010d}")

    return write


def _start(df: DataFrame, mode: str, sink: str, checkpoint: str) -> StreamingQuery:
    return (
        df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .foreachBatch(batch_folder(sink)).trigger(availableNow=True).start()
    )


def read_latest_rows(spark: SparkSession, sink: str, keys: list[str]) -> DataFrame:
    """Update sinks: the newest row per key."""
    out = spark.read.parquet(f"{sink}/*")
    rest = [c for c in out.columns if c not in {*keys, "batch"}]
    best = out.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("b"))
    return best.select(*keys, *[F.col("b")[c].alias(c) for c in rest])


def read_all_batches(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(f"{sink}/*").drop("batch")


def upsert_folder(sink: str, keys: list[str], buckets: int) -> Callable[[DataFrame, int], None]:
    """Changed rows replace those of equal keys. Only the key buckets they fall into are rewritten, each
    whole, so files stay few; writing a batch again gives the same table."""

    def write(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        changed = materialise(df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")))
        hit = [r.bucket for r in changed.select("bucket").distinct().collect()]  # at most ``buckets``
        if not hit:
            return
        try:
            held = spark.read.schema(changed.schema).parquet(sink).where(F.col("bucket").isin(hit))
        except AnalysisException:  # nothing written yet
            merged = changed
        else:
            new = changed.select(*[F.col(k).alias(f"_{k}") for k in keys])
            same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
            merged = materialise(held.join(new, same, "left_anti").unionByName(changed))
        out = merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy("bucket").parquet(sink)

    return write


def read_upserted(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(sink).drop("bucket")


def start_tracker(panel: DataFrame, keys: list[str], sink: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Live tracker: one row per run, of which a micro-batch writes only those that changed."""
    return (
        panel.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .foreachBatch(upsert_folder(sink, keys, buckets)).trigger(availableNow=True).start()
    )


def run_status(events: DataFrame, run: str = "user_id") -> DataFrame:
    """Newest event, best score and event count per run."""
    newest = F.max(F.struct("event_time", "event_id", "event_type"))
    return events.groupBy(run).agg(
        newest["event_type"].alias("step"), F.max("value").alias("best"), F.count(F.lit(1)).alias("events")
    )


def start_status(events: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Only changed runs are written per batch."""
    return _start(run_status(events), "update", sink, checkpoint)


def start_replay(events: DataFrame, key: str, lateness: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Idempotent replay: an event id counts once within the lateness bound."""
    once = events.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark([key])
    return _start(once, "append", sink, checkpoint)


def start_windows(events: DataFrame, window: Column, keys: list[str], lateness: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Counts per closed window; the newest windows stay open until the watermark passes."""
    counts = (
        events.withWatermark("event_time", lateness).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
        .select(F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), *keys, "n")
    )
    return _start(counts, "append", sink, checkpoint)


def start_stalled(events: DataFrame, run: str, gap_minutes: int, lateness: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Stalls: every stretch of a run's events after which none came for ``gap_minutes`` of event time.

    A stretch is a session; it is reported once the watermark has passed its last event by the
    gap, whether or not the run has gone on since. Open stretches live in the state store and are
    merged with later events in event-time order, over as many micro-batches as it takes, and with
    reports that arrive late within ``lateness``. A busy run's rows are merged before the shuffle.
    """
    stretch = F.session_window("event_time", f"{gap_minutes} minutes")
    out = (
        events.withWatermark("event_time", lateness).groupBy(F.col(run).alias("run"), stretch.alias("w"))
        .agg(F.count(F.lit(1)).alias("events"), F.min("event_time").alias("first"), F.max("event_time").alias("last"))
        .select("run", "events", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"))
    )
    return _start(out, "append", sink, checkpoint)


def start_reports(events: DataFrame, reports: DataFrame, key: str, within: str, lateness: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Each event with its report, if one comes ``within`` a time of the event; without one once that is over.

    Both streams carry a watermark, so the state holds events only while a report may still come. A report
    after its time meets no event any more: the event has already come out as unreported.
    """
    e = events.withWatermark("event_time", lateness)
    r = reports.withWatermark("report_time", lateness).select(F.col(key).alias("_key"), "report_time")
    soon = F.col("report_time").between(F.col("event_time"), F.col("event_time") + F.expr(f"INTERVAL {within}"))
    out = e.join(r, (F.col(key) == F.col("_key")) & soon, "left_outer")
    rest = [c for c in events.columns if c not in ("event_time", "ts")]
    return _start(out.select(*rest, F.unix_micros("event_time").alias("event_us"), F.unix_micros("report_time").alias("report_us")), "append", sink, checkpoint)

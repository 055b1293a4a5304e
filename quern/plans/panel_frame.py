"""Score panel derived from ``events``, in DataFrame and SQL form.

A run is the events of one user, era, profile and run number. Its score is the
largest value, its state follows from the last event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MID = "2024-01-16"

PANEL_SQL = f"""
    panel AS (SELECT task, variant, profile, run, last_type, first_us, last_us, n_events,
      CASE last_type WHEN 'error' THEN 'fail:solver_runtime_error' WHEN 'view' THEN 'running' ELSE 'scored' END AS state,
      CASE WHEN last_type NOT IN ('error', 'view') THEN top END AS score
      FROM (SELECT user_id AS task, CASE WHEN ts < TIMESTAMP '{MID}' THEN 'before' ELSE 'after' END AS variant,
        CASE WHEN event_id % 2 = 0 THEN 'weak' ELSE 'strong' END AS profile, 1 + (event_id // 2) % 5 AS run,
        arg_max(event_type, event_id) AS last_type, max(value) AS top, count(*) AS n_events,
        min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us
        FROM events GROUP BY 1, 2, 3, 4))
"""


def panel_of(events: DataFrame) -> DataFrame:
    runs = events.groupBy(
        F.col("user_id").alias("task"),
        F.when(F.col("ts") < F.lit(MID).cast("timestamp_ntz"), "before").otherwise("after").alias("variant"),
        F.when(F.col("event_id") % 2 == 0, "weak").otherwise("strong").alias("profile"),
        (F.expr("event_id div 2") % 5 + 1).alias("run"),
    ).agg(
        F.max_by("event_type", "event_id").alias("last_type"),
        F.max("value").alias("top"),
        F.count(F.lit(1)).alias("n_events"),
        F.unix_micros(F.min("ts").cast("timestamp")).alias("first_us"),
        F.unix_micros(F.max("ts").cast("timestamp")).alias("last_us"),
    )
    state = F.when(F.col("last_type") == "error", "fail:solver_runtime_error").when(
        F.col("last_type") == "view", "running"
    )
    return runs.select(
        "task", "variant", "profile", "run", "last_type", "first_us", "last_us", "n_events",
        state.otherwise("scored").alias("state"),
        F.when(~F.col("last_type").isin("error", "view"), F.col("top")).alias("score"),
    )

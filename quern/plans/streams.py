"""Sources, sinks and streaming jobs checked against their batch result."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quern.functions.draws import count_where, rows, uniform
from quern.operators import panel as N
from quern.operators.compose import expected_runs
from quern.operators.ordered import micros
from quern.plans.joins import MONEY
from quern.plans.panel_frame import PANEL_SQL, panel_of
from quern.plans.profiling import DIRTY, dirty_customer
from quern.plans.registry import query, u_sql
from quern.session import checkpoint_dir
from quern.sources import publish as P, runs as R, tables as S
from quern.streaming import logs as G

L = F.lit


def scratch(t) -> str:
    """New folder below the session's checkpoint folder."""
    return f"{checkpoint_dir(t.spark)}/quern-{uuid.uuid4().hex}"


CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("s01_csv_scan", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def s01(t):
    path = scratch(t) + ".tsv.gz"
    S.write_csv(t.customer, path, sep="\t", compression="gzip")
    return S.scan_csv(t.spark, path, CUSTOMER)


@query(
    "s01_csv_permissive",
    f"SELECT c_mktsegment, count(*) AS n, count(CASE WHEN {u_sql(141, 'bad', 'c_custkey')} >= 0.1 THEN 1 END) AS good FROM customer GROUP BY 1",
)
def s01_permissive(t):
    """Bad numbers become null when parsing is not strict."""
    path = scratch(t) + ".csv"
    bad = F.when(uniform(141, "bad", "c_custkey") < 0.1, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    S.write_csv(t.customer.withColumn("c_acctbal", bad), path)
    return S.scan_csv(t.spark, path, CUSTOMER, strict=False).groupBy("c_mktsegment").agg(rows().alias("n"), F.count("c_acctbal").alias("good"))


@query("s02_parquet_recursive", "SELECT o_orderstatus, count(*) AS n, sum(o_orderkey)::BIGINT AS key_sum FROM orders GROUP BY 1")
def s02(t):
    path = scratch(t)
    for status in ("F", "O", "P"):
        S.write_parquet(t.orders.where(F.col("o_orderstatus") == status), f"{path}/deep/{status}")
    return S.scan_parquet(t.spark, path).groupBy("o_orderstatus").agg(rows().alias("n"), F.sum("o_orderkey").alias("key_sum"))


@query(
    "s04_csv_keeps_empty",
    f"WITH {DIRTY} SELECT coalesce(c_mktsegment, '') = '' AS is_empty, count(*) AS n, count(*) FILTER (c_mktsegment = 'NA') AS tokens FROM dirty GROUP BY 1",
)
def s04(t):
    path = scratch(t) + ".csv"
    S.write_csv(dirty_customer(t).select("c_custkey", "c_mktsegment"), path)
    df = S.scan_csv(t.spark, path, "c_custkey long, c_mktsegment string", keep_empty=True)
    return df.groupBy((F.col("c_mktsegment") == "").alias("is_empty")).agg(rows().alias("n"), count_where("c_mktsegment = 'NA'").alias("tokens"))


@query(
    "s05_run_record_scan",
    f"""
    WITH {PANEL_SQL}, grid AS (SELECT task, variant, profile, run FROM (SELECT DISTINCT task FROM panel), (VALUES ('before'), ('after')) v(variant), (VALUES ('weak'), ('strong')) p(profile), range(1, 6) r(run))
    SELECT task, variant, profile, run, coalesce(state, 'pending') AS state, score FROM grid LEFT JOIN panel USING (task, variant, profile, run)
    """,
)
def s05(t):
    """Records written per era and profile folder, scanned back, laid over the grid."""
    path, cell = scratch(t), ["task", "variant", "profile", "run"]
    panel = panel_of(t.events)
    done = panel.where("state <> 'running'")
    failure = F.when(F.col("score").isNull(), "solver_runtime_error")
    record = F.to_json(F.struct(
        "task", "run", F.col("score").alias("final_score"), F.struct(failure.alias("failure_code")).alias("final_result"),
    ))
    done.select("variant", "profile", record.alias("value")).write.partitionBy("variant", "profile").text(path)
    found = R.scan_run_lines(t.spark, path, r"variant=([^/]+)/profile=([^/]+)/", ["variant", "profile"])
    grid = expected_runs(panel.select("task").distinct(), ["before", "after"], ["weak", "strong"], 5)
    grid = grid.withColumn("run", F.col("run").cast("long"))
    return R.with_expected(found, grid, cell, panel.where("state = 'running'")).select(*cell, "state", "score")


@query("s08_file_listing")
def s08(t):
    """Rows-only: sizes belong to the files themselves."""
    return S.list_files(t.spark, t.directory).where("endswith(name, '.parquet')").select("name", "size")


@query("s09_sinks_round_trip", "SELECT 'csv' AS sink, p_type, count(*) AS n, sum(p_retailprice::DECIMAL(18,2))::DOUBLE AS total FROM part GROUP BY 2 UNION ALL SELECT 'parquet', p_type, count(*), sum(p_retailprice::DECIMAL(18,2))::DOUBLE FROM part GROUP BY 2")
def s09(t):
    base = scratch(t)
    S.write_csv(t.part, f"{base}/part.csv")
    S.write_parquet(t.part, f"{base}/part")
    csv = S.scan_csv(t.spark, f"{base}/part.csv", "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    both = csv.withColumn("sink", L("csv")).unionByName(S.scan_parquet(t.spark, f"{base}/part").withColumn("sink", L("parquet")))
    return both.groupBy("sink", "p_type").agg(rows().alias("n"), F.sum(F.col("p_retailprice").cast(MONEY)).cast("double").alias("total"))


@query("s10_published_outputs", "SELECT o_orderkey, o_orderstatus FROM orders")
def s10(t):
    """Two versions are published; readers see the newest whole one."""
    target = scratch(t)
    P.publish(t.spark, {"orders": t.orders.select("o_orderkey").limit(0), "customer": t.customer}, target, inputs=[t.path("orders")])
    P.publish(t.spark, {"orders": t.orders.select("o_orderkey", "o_orderstatus")}, target, force=True)
    return P.read_published(t.spark, target, "orders")


def finish(q):
    q.awaitTermination()
    return q


def steps(df, time: str, folder: str, parts: int):
    """Write ``df`` to ``folder`` in ``parts`` steps of its microsecond column ``time``; yields after each."""
    low, high = df.agg(F.min(time), F.max(time)).first()
    step = (high - low) // parts + 1
    for k in range(parts):
        df.where(F.col(time).between(low + k * step, low + (k + 1) * step - 1)).write.parquet(f"{folder}/step={k:04d}")
        yield k


RUN = ["task", "variant", "profile", "run"]
TRACKER_SQL = f"""
    WITH {PANEL_SQL} SELECT task, variant, profile, {', '.join(f"max(CASE WHEN run = {r} THEN coalesce(printf('%.5f', score), state) END) AS run{r}" for r in range(1, 6))},
      max(score) AS best, count(score) || '/5' AS scored_text FROM panel GROUP BY 1, 2, 3
"""


@query("st01_live_tracker", TRACKER_SQL)
def st01(t):
    base = scratch(t)
    finish(G.start_tracker(panel_of(G.event_stream(t.spark, t.directory)), RUN, f"{base}/sink", f"{base}/cp"))
    panel = G.read_upserted(t.spark, f"{base}/sink")
    cell = ["task", "variant", "profile"]
    shown = F.coalesce(F.when(F.col("score").isNotNull(), F.format_string("%.5f", F.col("score"))), F.col("state"))
    wide = N.wide_runs(panel, cell, shown)
    return wide.join(N.cell_best(panel, cell, lower=False).drop("scored"), cell)


@query(
    "s13_tracker_snapshot",
    f"WITH {PANEL_SQL} SELECT task, variant, profile, run, state, score FROM panel",
)
def s13(t):
    """The tracker's table after three runs of the job, each rewriting the runs that changed."""
    base = scratch(t)
    timed = t.events.withColumn("us", micros("ts"))
    for _ in steps(timed, "us", f"{base}/landing", 3):
        stream = G.landing_stream(t.spark, t.events.schema, f"{base}/landing")
        finish(G.start_tracker(panel_of(stream), RUN, f"{base}/sink", f"{base}/cp"))
    return G.read_upserted(t.spark, f"{base}/sink").select("task", "variant", "profile", "run", "state", "score")


@query("st02_run_status", "SELECT user_id, arg_max(event_type, event_id) AS step, max(value) AS best, count(*) AS events FROM events GROUP BY 1")
def st02(t):
    base = scratch(t)
    finish(G.start_status(G.event_stream(t.spark, t.directory), f"{base}/sink", f"{base}/cp"))
    return G.read_latest_rows(t.spark, f"{base}/sink", ["user_id"])


@query("st03_idempotent_replay", "SELECT event_type, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM events GROUP BY 1")
def st03(t):
    base = scratch(t)
    twice = G.event_stream(t.spark, t.directory).withColumn("copy", F.explode(F.array(L(1), L(2)))).drop("copy", "ts")
    finish(G.start_replay(twice, "event_id", "1 day", f"{base}/sink", f"{base}/cp"))
    once = G.read_all_batches(t.spark, f"{base}/sink")
    return once.groupBy("event_type").agg(rows().alias("n"), F.sum(F.col("value").cast(MONEY)).cast("double").alias("total"))


@query(
    "st04_late_reports",
    f"""
    WITH e AS (SELECT *, floor({u_sql(144, 'delay', 'event_id')} * 36)::BIGINT AS hours FROM events)
    SELECT event_type, count(*) AS n, count(*) FILTER (hours >= 24) AS late, max(hours) AS worst_hours FROM e GROUP BY 1
    """,
)
def st04(t):
    """Event time against arrival: reports later than the lateness bound."""
    hours = F.floor(uniform(144, "delay", "event_id") * 36).cast("long")
    arrived = t.events.select("event_type", F.col("ts").cast("timestamp").alias("event_time"), hours.alias("hours"))
    seen = arrived.withColumn("ingested", F.expr("timestampadd(HOUR, hours, event_time)"))
    delay = F.expr("timestampdiff(HOUR, event_time, ingested)")
    return seen.groupBy("event_type").agg(rows().alias("n"), count_where(delay >= 24).alias("late"), F.max(delay).alias("worst_hours"))


REPORT_HOURS = 24


@query(
    "st04_report_stream",
    f"""
    WITH e AS (SELECT event_id, epoch_us(ts) AS us, epoch_us(ts) + floor({u_sql(147, 'delay', 'event_id')} * 129600)::BIGINT * 1000000 AS seen FROM events)
    SELECT event_id, us AS event_us, CASE WHEN seen - us <= 86400000000 THEN seen END AS report_us FROM e
    WHERE seen - us <= 86400000000 OR us + 86400000000 < (SELECT max(us) // 1000 * 1000 - 3600000000 FROM e)
    """,
)
def st04_stream(t):
    """Events and their reports (up to 36 hours later) land in four steps each; reports after a day are too late."""
    base = scratch(t)
    delay = F.floor(uniform(147, "delay", "event_id") * 129_600).cast("long") * L(1_000_000)
    e = t.events.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "ts")
    r = e.select("event_id", (F.col("us") + delay).alias("seen"))
    for _ in zip(steps(e, "us", f"{base}/events", 4), steps(r, "seen", f"{base}/reports", 4)):
        events = G.landing_stream(t.spark, e.schema, f"{base}/events").select("event_id", "event_time")
        raw = t.spark.readStream.schema(r.schema).option("recursiveFileLookup", "true").parquet(f"{base}/reports")
        reports = raw.select("event_id", F.timestamp_micros("seen").alias("report_time"))
        finish(G.start_reports(events, reports, "event_id", f"{REPORT_HOURS} HOURS", "1 hour", f"{base}/sink", f"{base}/cp"))
    return G.read_all_batches(t.spark, f"{base}/sink")


@query("st05_tumbling_counts", "SELECT event_type, epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) AS start_us, count(*) AS n FROM events GROUP BY 1, 2")
def st05_tumbling(t):
    w = F.window(F.col("ts").cast("timestamp"), "6 hours")
    return t.events.groupBy("event_type", F.unix_micros(w["start"]).alias("start_us")).agg(rows().alias("n"))


@query(
    "st05_sliding_counts",
    "SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) - k * 21600000000 AS start_us, count(*) AS n FROM events, range(0, 4) r(k) GROUP BY 1",
)
def st05_sliding(t):
    w = F.window(F.col("ts").cast("timestamp"), "1 day", "6 hours")
    return t.events.groupBy(F.unix_micros(w["start"]).alias("start_us")).agg(rows().alias("n"))


@query(
    "st05_session_counts",
    """
    WITH d AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 21600000000, true) AS opens FROM events),
    s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM d)
    SELECT user_id, min(epoch_us(ts)) AS start_us, max(epoch_us(ts)) + 21600000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, session
    """,
)
def st05_session(t):
    w = F.session_window(F.col("ts").cast("timestamp"), "6 hours")
    return t.events.groupBy("user_id", w.alias("w")).agg(rows().alias("n")).select(
        "user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n"
    )


@query(
    "st05_closed_stream_windows",
    """
    WITH w AS (SELECT epoch_us(date_trunc('day', ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT start_us, start_us + 86400000000 AS end_us, event_type, n FROM w WHERE start_us + 86400000000 <= (SELECT max(epoch_us(ts)) - 86400000000 FROM events)
    """,
)
def st05_stream(t):
    base = scratch(t)
    stream = G.event_stream(t.spark, t.directory)
    finish(G.start_windows(stream, F.window("event_time", "1 day"), ["event_type"], "1 day", f"{base}/sink", f"{base}/cp"))
    return G.read_all_batches(t.spark, f"{base}/sink")


ARRIVALS = 5


@query(
    "st06_stalled_runs",
    """
    WITH d AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 21600000000, true) AS opens FROM events),
    s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stretch FROM d)
    SELECT user_id AS run, count(*) AS events, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM s GROUP BY user_id, stretch
    HAVING max(epoch_us(ts)) + 21600000000 <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - 3600000000 FROM events)
    """,
)
def st06(t):
    """Five runs of one job over events as they arrive, up to an hour out of order."""
    base = scratch(t)
    late = F.floor(uniform(146, "delay", "event_id") * 3_600_000_000).cast("long")
    arrived = t.events.withColumn("arrived", micros("ts") + late)
    for _ in steps(arrived, "arrived", f"{base}/landing", ARRIVALS):
        stream = G.landing_stream(t.spark, t.events.schema, f"{base}/landing")
        finish(G.start_stalled(stream, "user_id", 360, "1 hour", f"{base}/sink", f"{base}/cp"))
    return G.read_all_batches(t.spark, f"{base}/sink")

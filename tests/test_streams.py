"""Streaming jobs over several micro-batches against their batch result."""

import random
from datetime import datetime, timedelta

from quern.streaming import logs

START = datetime(2024, 1, 1)
HOUR = timedelta(hours=1)


def stalls(events, gap, watermark):
    out = []
    for run in {r for r, _ in events}:
        times = sorted(x for r, x in events if r == run)
        stretch = [times[0]]
        for x in times[1:] + [None]:
            if x is not None and x - stretch[-1] < gap:
                stretch.append(x)
                continue
            if stretch[-1] + gap <= watermark:
                out.append((run, len(stretch), stretch[0], stretch[-1]))
            stretch = [x]
    return sorted(out)


def land(spark, folder, batches, gap):
    schema = "run long, ts timestamp"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/landing/b{k}")
        stream = logs.landing_stream(spark, spark.createDataFrame([], schema).schema, f"{folder}/landing")
        logs.start_stalled(stream, "run", gap, "1 hour", f"{folder}/sink", f"{folder}/cp").awaitTermination()
    got = logs.read_all_batches(spark, f"{folder}/sink").selectExpr("run", "events", "timestamp_micros(first_us)", "timestamp_micros(last_us)")
    return sorted(tuple(r) for r in got.collect())


def test_silences_between_micro_batches(spark, tmp_path):
    """Run 3 falls silent for 40 and for 100 hours and goes on each time: both stalls are reported."""
    at = lambda *hours: [START + h * HOUR for h in hours]
    batches = [
        [(3, x) for x in at(0, 1, 2)] + [(1, x) for x in at(0, 5, 9)],
        [(1, x) for x in at(18, 27, 36)],
        [(3, x) for x in at(42, 50)] + [(1, x) for x in at(45, 54)],
        [(1, x) for x in at(*range(60, 150, 9))],
        [(3, x) for x in at(150, 151, 161)] + [(1, START + 152 * HOUR)],
    ]
    gap = 10 * HOUR
    got = land(spark, f"file://{tmp_path}", batches, 600)
    want = stalls([e for b in batches for e in b], gap, START + 160 * HOUR)
    assert got == want
    assert {(r[1], r[3]) for r in got if r[0] == 3} == {(3, START + 2 * HOUR), (2, START + 50 * HOUR)}


def test_late_reports_join_their_stretch(spark, tmp_path):
    """Events up to an hour out of order, over six micro-batches, give the batch result."""
    r = random.Random(2)
    events = [(run, START + timedelta(minutes=r.randrange(0, 6000))) for run in range(6) for _ in range(40)]
    arrived = sorted(events, key=lambda e: e[1] + timedelta(minutes=r.randrange(59)))
    size = len(arrived) // 6
    batches = [arrived[k * size : (k + 1) * size if k < 5 else None] for k in range(6)]
    got = land(spark, f"file://{tmp_path}", batches, 150)
    want = stalls(events, timedelta(minutes=150), max(x for _, x in events) - HOUR)
    assert got == want and len(got) > 50


def test_reports_within_their_time(spark, tmp_path):
    """Over four micro-batches: in time, at the last moment, too late, never, and twice."""
    base = f"file://{tmp_path}"
    events = [(i, START + i * HOUR) for i in range(120)]
    delays = {0: 1, 1: 24, 2: 25, 3: None, 4: 30, 119: 2}
    reports = [(i, at + delays.get(i, i % 30) * HOUR) for i, at in events if delays.get(i, 0) is not None] + [(0, START + 2 * HOUR)]
    for k in range(4):
        within = lambda rows: [r for r in rows if k * 40 <= (r[1] - START) / HOUR < k * 40 + 40]
        spark.createDataFrame(within(events), "event_id long, ts timestamp").write.parquet(f"{base}/events/b{k}")
        spark.createDataFrame(within(reports), "event_id long, report_time timestamp").write.parquet(f"{base}/reports/b{k}")
        e = logs.landing_stream(spark, spark.read.parquet(f"{base}/events/b0").schema, f"{base}/events")
        r = spark.readStream.schema("event_id long, report_time timestamp").option("recursiveFileLookup", "true").parquet(f"{base}/reports")
        logs.start_reports(e, r, "event_id", "24 HOURS", "1 hour", f"{base}/sink", f"{base}/cp").awaitTermination()
    got = sorted((x.event_id, x.report_us is not None) for x in logs.read_all_batches(spark, f"{base}/sink").collect())
    in_time = [(i, True) for i, at in reports if at - dict(events)[i] <= 24 * HOUR]
    silent = [(i, False) for i, at in events if i not in dict(in_time) and at + 24 * HOUR < START + 118 * HOUR]
    assert got == sorted(in_time + silent)
    assert {(1, True), (2, False), (3, False), (4, False)} <= set(got) and got.count((0, True)) == 2


def test_tracker_rewrites_only_changed_buckets(spark, tmp_path):
    import os

    write = logs.upsert_folder(f"{tmp_path}/sink", ["run", "part"], 8)
    schema = "run long, part string, score double"
    table = {}
    r = random.Random(3)
    for batch, size in enumerate([50, 1, 0, 20, 20]):
        rows = [(k, p, r.random()) for k, p in {(r.randrange(60), r.choice(["a", None])) for _ in range(size)}]
        before = {f: os.path.getmtime(f"{tmp_path}/sink/{f}") for f in os.listdir(f"{tmp_path}/sink") if f.startswith("bucket")} if batch else {}
        df = spark.createDataFrame(rows, schema)
        write(df, batch)
        if batch == 3:
            write(df, batch)  # a batch that runs again changes nothing
        table |= {(k, p): s for k, p, s in rows}
        assert {(x.run, x.part): x.score for x in logs.read_upserted(spark, f"{tmp_path}/sink").collect()} == table
        assert logs.read_upserted(spark, f"{tmp_path}/sink").count() == len(table)
        if batch == 1:
            after = {f: sorted(os.listdir(f"{tmp_path}/sink/{f}")) for f in before}
            assert len(after) > 2
            assert sum(os.path.getmtime(f"{tmp_path}/sink/{f}") != before[f] for f in before) <= 1

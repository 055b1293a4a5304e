"""Ordered and ranked operators against brute force, with one hot key and ties."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from quern.operators import compose as C, metrics as M, ordered as O, ranks as R, runlog as L
from quern.operators.splits import exact_split, quota_sample


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows belong to key 0; many rows share an instant."""
    rng = random.Random(5)
    data = [(i, 0 if i % 3 == 0 else rng.randint(1, 15), rng.randint(0, 60), rng.randint(1, 9)) for i in range(600)]
    return spark.createDataFrame(data, "id long, k long, t long, v long").cache(), data


@pytest.mark.parametrize("width", [1, 7, None])
def test_strictly_prior(skewed, width):
    df, data = skewed
    got = {r.id: (r.n, r.s) for r in O.strictly_prior(df, ["k"], "t", {"n": F.lit(1), "s": F.col("v")}, width).collect()}
    for i, k, t, _ in data:
        prior = [v for _, k2, t2, v in data if k2 == k and t2 < t]
        assert got[i] == (len(prior), sum(prior))


@pytest.mark.parametrize("inclusive,delay,width", [(False, 0, 5), (True, 0, 5), (False, 3, 9), (True, 0, None)])
def test_as_of(skewed, inclusive, delay, width):
    df, data = skewed
    probe, build = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    out = O.as_of(probe.select("id", "k", "t"), build, ["k"], "t", ["v"], inclusive, delay, width)
    got = {r.id: r.asof_v for r in out.collect()}
    for i, k, t, _ in data:
        if i % 2:
            continue
        facts = [(t2 + delay, v) for j, k2, t2, v in data if j % 2 and k2 == k and (t2 + delay <= t if inclusive else t2 + delay < t)]
        assert got[i] == (max(facts)[1] if facts else None)


@pytest.mark.parametrize("width", [1, 8, None])
def test_running_and_neighbour(skewed, width):
    df, data = skewed
    specs = {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "lo": ("min", F.col("v"))}
    out = {r.id: r for r in O.running(df, ["k"], ["t", "id"], specs, width).collect()}
    back = {r.id: r.prev_v for r in O.neighbour(df, ["k"], ["t", "id"], ["v"], width).collect()}
    ahead = {r.id: r.next_t for r in O.neighbour(df, ["k"], ["t", "id"], ["t"], width, ahead=True).collect()}
    for key in {k for _, k, _, _ in data}:
        line = sorted((t, i, v) for i, k, t, v in data if k == key)
        for n, (t, i, v) in enumerate(line):
            seen = [x[2] for x in line[: n + 1]]
            assert (out[i].s, out[i].m, out[i].lo) == (sum(seen), max(seen), min(seen))
            assert back[i] == (line[n - 1][2] if n else None)
            assert ahead[i] == (line[n + 1][0] if n + 1 < len(line) else None)


def test_running_over_a_whole_table(skewed):
    df, data = skewed
    points = df.groupBy("t").agg(F.sum("v").alias("v"))
    got = {r.t: r.s for r in O.running(points, [], ["t"], {"s": ("sum", F.col("v"))}, 10).collect()}
    assert got == {t: sum(v for _, _, t2, v in data if t2 <= t) for _, _, t, _ in data}


def test_overlap_counts(skewed):
    df, data = skewed
    w = df.select("id", "k", F.col("t").alias("s"), (F.col("t") + F.col("v")).alias("e"))
    out = C.overlap_counts(w.where("id % 4 = 0"), w.where("id % 4 <> 0"), ["k"], "s", "e", 10)
    got = {r.id: r.overlaps for r in out.collect()}
    for i, k, t, v in data:
        if i % 4 == 0:
            assert got[i] == sum(1 for j, k2, t2, v2 in data if j % 4 and k2 == k and t < t2 + v2 and t2 < t + v)


@pytest.mark.parametrize("share", [0.0, 0.5, 0.9, 1.0])
def test_exact_quantile(skewed, share):
    df, data = skewed
    got = {r.k: r.q for r in R.exact_quantile(df, "t", share, ["k"]).collect()}
    for key in got:
        xs = sorted(t for _, k, t, _ in data if k == key)
        at = share * (len(xs) - 1)
        low, high = xs[int(at)], xs[min(int(at) + (at % 1 > 0), len(xs) - 1)]
        assert got[key] == pytest.approx(low + (at % 1) * (high - low))
    every = [t for _, _, t, _ in data]
    assert R.exact_median(df, "t").first()[0] == statistics.median(every)


def test_median_even_and_odd(spark):
    for xs in ([1.0, 2.0, 10.0], [1.0, 2.0, 10.0, 20.0], [5.0]):
        assert R.exact_median(spark.createDataFrame([(x,) for x in xs], "x double"), "x").first()[0] == statistics.median(xs)


def test_running_totals_and_auc(spark):
    rng = random.Random(1)
    data = [("g%d" % (i % 2), rng.randint(0, 1), float(rng.randint(0, 20))) for i in range(400)]
    got = {r.g: r.auc for r in M.auc(spark.createDataFrame(data, "g string, y int, p double"), ["g"]).collect()}
    for g in got:
        pos = [p for g2, y, p in data if g2 == g and y]
        neg = [p for g2, y, p in data if g2 == g and not y]
        wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
        assert got[g] == pytest.approx(wins / len(pos) / len(neg))


@pytest.mark.parametrize("chunk", [3, None])
def test_concordance(spark, chunk):
    rng = random.Random(2)
    data = [(rng.randint(0, 40), rng.randint(0, 1), rng.randint(0, 15)) for _ in range(300)]
    r = M.concordance(spark.createDataFrame(data, "time long, event int, risk long"), 4, chunk).first()
    pairs = [(a, b) for a in data for b in data if a[0] < b[0] and a[1]]
    assert r.concordant == sum(a[2] > b[2] for a, b in pairs)
    assert r.discordant == sum(a[2] < b[2] for a, b in pairs)
    assert r.tied_risk == sum(a[2] == b[2] for a, b in pairs)


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_draws_do_not_depend_on_partitions(spark, parts):
    df = spark.range(500).withColumnRenamed("id", "k").repartition(parts)
    split = exact_split(df, "k", 3, 0.25)
    chosen = sorted(r.k for r in split.where("is_test").collect())
    assert len(chosen) == 125 and sum(chosen) == sum(r.k for r in exact_split(spark.range(500).withColumnRenamed("id", "k"), "k", 3, 0.25).where("is_test").collect())
    ranked = R.hashed_rank(df.withColumn("d", F.sha2(F.col("k").cast("string"), 256)), "d", ("k",), "r", total="n")
    assert [r.r for r in ranked.orderBy("d").collect()] == list(range(1, 501))
    assert ranked.first().n == 500


def test_quota_beyond_the_group_limit(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 2).alias("s"))
    big = quota_sample(df, ["s"], "k", 1500, 4)
    small = quota_sample(df, ["s"], "k", 900, 4)
    assert {r.s: r["count"] for r in big.groupBy("s").count().collect()} == {0: 1500, 1: 1500}
    assert small.join(big, "k", "left_anti").count() == 0


def test_nearest_on_line(spark):
    build = spark.createDataFrame([(10, 1), (20, 2), (20, 3), (40, 4)], "x long, y long")
    probe = spark.createDataFrame([(0,), (15,), (16,), (20,), (30,), (99,)], "x long")
    got = {r.x: (r.near_at, r.near_y) for r in C.nearest_on_line(probe, build, "x", ["y"]).collect()}
    assert got == {0: (10, 1), 15: (10, 1), 16: (20, 3), 20: (20, 3), 30: (20, 3), 99: (40, 4)}


@pytest.mark.parametrize("budget,kept", [(10, [0, 1, 6, 7]), (11, [0, 1, 4, 5, 6, 7]), (1, [0, 1, 6, 7]), (99, list(range(8)))])
def test_budgeted_history(spark, budget, kept):
    """Newest exchange always stays; an exact fit stays; one over goes."""
    roles = ["system", "user", "assistant", "assistant", "user", "assistant", "user", "assistant"]
    chat = spark.createDataFrame([(1, i, r, "x" * n) for i, (r, n) in enumerate(zip(roles, [2, 1, 3, 2, 2, 2, 2, 2]))], "c long, n long, role string, text string")
    out = L.budgeted_history(chat, "c", "n", "role", F.length("text"), budget, chunks=2)
    assert sorted(r.n for r in out.where("kept").collect()) == kept


def test_retry_chains(spark):
    marks = "EEOEEEEEO"
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate(marks)], "k long, t long, c string")
    out = L.retry_chains(df, ["k"], ["t"], F.col("c") == "E", chunks=2).orderBy("t").collect()
    assert [(r.t, r.attempt, r.paused) for r in out] == [
        (0, 1, False), (1, 2, False), (3, 1, False), (4, 2, False), (5, 3, False), (6, 4, True), (7, 5, False)
    ]


def test_sessions(spark):
    df = spark.createDataFrame([(1, 0), (1, 5), (1, 20), (1, 26), (2, 7)], "k long, t long")
    out = {(r.k, r.t): r.session for r in L.sessions(df, ["k"], ["t"], 6, chunks=4).collect()}
    assert out == {(1, 0): 1, (1, 5): 1, (1, 20): 2, (1, 26): 2, (2, 7): 1}


def test_buckets_are_monotone(spark):
    xs = [-5, 0, 1, 2, 3, 7, 8, 100]
    df = spark.createDataFrame([(x,) for x in xs], "x long")
    got = [r["_b"] for r in R.add_bucket(df, "x", [0, 1, 1, 3, 7, 7, 9]).orderBy("x").collect()]
    assert got == sorted(got) and got[0] == 0 and len(set(got)) == 6
    assert {r["_b"] for r in R.add_bucket(df, "x", []).collect()} == {0}


def test_no_chunk_of_a_hot_entity_is_large(spark):
    """One key with a third of the rows, all inside one hour."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"),
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.col("id") * 1_000_000).alias("t"),
    )
    placed = R.add_bucket(df, "t", O.time_chunks(df, "t", 512), "c")
    assert placed.groupBy("k", "c").count().agg(F.max("count")).first()[0] < 2 * 30_000 / 512
    assert 32 <= O.chunk_count(df) <= 1024

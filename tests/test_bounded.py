"""Scans and quantiles against plain loops, with bounds small enough to need several rounds."""

import math
import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import ranks, scans
from quern.plans import timelines


@pytest.mark.parametrize("fan", [2, 7, 64])
def test_affine_scan(spark, fan):
    r = random.Random(fan)
    rows = []
    for key in ("a", "b", None):
        places = sorted(r.sample(range(-500, 900), {"a": 700, "b": 1, None: 40}[key]))
        rows += [(key, p, r.uniform(-1, 1), r.uniform(-5, 5)) for p in places]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "g string, p long, a double, b double").repartition(5)
    got = {(x.g, x.p): x.state for x in scans.affine_scan(df, ["g"], "p", F.col("a"), F.col("b"), 2.5, fan=fan).collect()}
    assert len(got) == len(rows)
    for key in ("a", "b", None):
        s = 2.5
        for _, p, a, b in sorted((x for x in rows if x[0] == key), key=lambda x: x[1]):
            assert math.isclose(got[key, p], s, rel_tol=1e-9, abs_tol=1e-9)
            s = a * s + b


def test_affine_scan_of_nothing(spark):
    df = spark.createDataFrame([], "g string, p long, a double, b double")
    assert scans.affine_scan(df, ["g"], "p", F.col("a"), F.col("b")).collect() == []


def test_smoothing_over_ninety_days(spark):
    """Values further back than thirty rows still count."""
    r = random.Random(1)
    counts = {(u, d): r.choice([1, 2, 40]) for u in range(3) for d in range(95) if r.random() < 0.9}
    events = spark.createDataFrame([(u, d) for (u, d), n in counts.items() for _ in range(n)], "user_id long, d int")
    events = events.select("user_id", F.expr("timestampadd(DAY, d, timestamp_ntz'2024-01-01 05:00:00')").alias("ts"))
    got = {(x.user_id, x.day): x.smoothed for x in timelines.baselines(SimpleNamespace(events=events)).collect()}
    for u in range(3):
        past = []
        for d in range(95):
            if (u, d) not in counts:
                continue
            weights = [0.5 ** (len(past) - i) for i in range(len(past))]
            want = sum(w * x for w, x in zip(weights, past)) / sum(weights) if past else None
            assert (got[u, d] is None) == (want is None) and (want is None or math.isclose(got[u, d], want, rel_tol=1e-12))
            past.append(counts[u, d])
        assert len(past) > 60


def values(kind, n=20_000):
    r = np.random.default_rng(3)
    return {
        "normal": r.normal(size=n), "ties": r.integers(0, 4, n).astype(float), "tail": np.exp(r.normal(size=n) * 40),
        "half": np.where(r.random(n) < 0.5, 7.0, r.normal(size=n) * 1e-3 + 7), "one": np.full(n, 3.0), "border": np.repeat([1.0, 2.0], n // 2),
    }[kind]


@pytest.mark.parametrize("kind", ["normal", "ties", "tail", "half", "one", "border"])
@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.999, 1.0])
def test_quantile_in_small_classes(spark, kind, share):
    x = values(kind)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").repartition(4)
    got = ranks.exact_quantile(df, "v", share, limit=50).first().q
    assert math.isclose(got, float(np.quantile(x, share)), rel_tol=1e-12)


def test_no_class_above_the_bound(spark):
    """Groups of all sizes, one with most rows, one null: what is sorted together stays under the bound."""
    r = np.random.default_rng(5)
    rows = [("hot", float(v)) for v in r.normal(size=30_000)] + [("tied", float(v)) for v in r.integers(0, 3, 5000)]
    rows += [(None, float(v)) for v in r.normal(size=3000)] + [("few", 1.0), ("few", 4.0), ("single", 9.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {x.g: x.q for x in ranks.exact_quantile(df, "v", 0.3, ["g"], limit=100).collect()}
    for g in ("hot", "tied", None, "few", "single"):
        assert math.isclose(got[g], float(np.quantile([v for k, v in rows if k == g], 0.3)), rel_tol=1e-12)
    assert "none" not in got
    held = df.where("v is not null").select("g", F.col("v").alias("_x"))
    state = ranks.bounded_class(held, ["g"], 0.3, 100)
    inside = ranks._inside(held, state.where("_value is null"), ["g"]).groupBy("g").count()
    sizes = {x.g: x["count"] for x in inside.collect()}
    assert sizes["hot"] <= 100 and max(sizes.values()) <= 100
    assert {x.g for x in state.where("_value is not null").collect()} == {"tied"}


def test_quantile_of_nothing(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert ranks.exact_quantile(df, "v", 0.5).first().q is None
    assert ranks.exact_quantile(df, "v", 0.5, ["g"]).collect() == []

"""Fitted transformers: train-only, one draw for both tables, saved and loaded."""

import json

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from quern.functions.draws import normal, uniform
from quern.operators import theta as T


@pytest.fixture(scope="module")
def tables(spark):
    df = spark.range(600).select(
        "id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") * 1.5).alias("y"),
        F.when(F.col("id") % 5 > 0, F.concat(F.lit("c"), (F.col("id") % 40).cast("string"))).alias("kind"), (F.col("id") % 2).alias("target"))
    return df.where("id < 400").repartition(3), df.where("id >= 400").repartition(2)


FEATURES = ["x", "y", "kind"]


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_one_draw_for_both_tables(tables):
    train, test = tables
    theta = T.Theta(seed=5, n_drop=1, n_junk=2, noise=0.3, missing=0.25)
    a, b, fitted, audit = T.apply_theta(train, test, theta, ["id"], FEATURES, ["x", "y"])
    assert a.columns == b.columns and len(audit["dropped"]) == 1 and not set(audit["dropped"]) & set(a.columns)
    assert {"id", "target", "junk_0", "junk_1"} <= set(a.columns)
    whole, = [fitted.transform(train.union(test))]
    assert rows(whole) == sorted(rows(a) + rows(b))
    again = T.apply_theta(train.repartition(7), test.coalesce(1), theta, ["id"], FEATURES, ["x", "y"])
    assert rows(again[0]) == rows(a) and rows(again[1]) == rows(b) and again[3] == audit
    other = T.apply_theta(train, test, T.Theta(seed=6, n_drop=1, n_junk=2, noise=0.3, missing=0.25), ["id"], FEATURES, ["x", "y"])
    assert rows(other[1]) != rows(b)


def test_spread_comes_from_train_alone(tables):
    train, test = tables
    changed = test.withColumn("y", F.col("y") * 1e6)
    _, out, _, audit = T.apply_theta(train, changed, T.Theta(seed=1, noise=0.5), ["id"], FEATURES, ["y"])
    sd = train.agg(F.stddev_samp("y")).first()[0]
    assert audit["spreads"] == {"y": 0.5 * sd}
    want = changed.select("id", (F.col("y") + 0.5 * sd * normal(1, "noise/y", "id")).alias("y"))
    assert out.select("id", "y").exceptAll(want).count() == 0


def test_missing_cells_are_the_drawn_ones(tables):
    train, test = tables
    _, out, _, _ = T.apply_theta(train, test, T.Theta(seed=9, missing=0.4), ["id"], ["x"])
    wrong = out.where(F.col("x").isNull() != (uniform(9, "missing/x", "id") < 0.4))
    assert wrong.count() == 0 and 0.25 < out.where("x is null").count() / 200 < 0.55


def test_opaque_names(tables):
    train, test = tables
    a, b, _, audit = T.apply_theta(train, test, T.Theta(seed=2, n_junk=1, opaque=True), ["id"], FEATURES)
    assert a.columns == b.columns and {"id", "target"} < set(a.columns)
    assert all(c.startswith("f_") for c in a.columns if c not in ("id", "target")) and sorted(audit["names"]) == ["junk_0", "kind", "x", "y"]


def test_saved_and_loaded(tables, tmp_path):
    train, test = tables
    stages = [
        T.Fill(values={"numeric": ["x"], "text": ["kind"], "mark": True}), T.Scale(values={"columns": ["y"]}),
        T.Encode(values={"column": "kind", "out": "code", "min_rows": 9}), T.Noise(values={"columns": ["x"], "sigma": 0.1, "key": ["id"], "seed": 3, "kind": "laplace"}),
        T.DropDrawn(values={"features": ["x", "y"], "n": 1, "seed": 4}), T.Junk(values={"n": 1, "key": ["id"], "seed": 3}),
        T.Blank(values={"rates": {"kind": 0.2, "absent": 0.5}, "key": ["id"], "seed": 3}),
    ]
    fitted = Pipeline(stages=stages).fit(train)
    fitted.write().overwrite().save(f"file://{tmp_path}/model")
    loaded = PipelineModel.load(f"file://{tmp_path}/model")
    assert rows(loaded.transform(test)) == rows(fitted.transform(test))
    Pipeline(stages=stages).write().save(f"file://{tmp_path}/plan")
    assert rows(Pipeline.load(f"file://{tmp_path}/plan").fit(train).transform(test)) == rows(fitted.transform(test))


def test_fill_learns_from_train(spark):
    train = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (None, "b"), (10.0, "a"), (4.0, None)], "v double, s string")
    test = spark.createDataFrame([(None, None), (99.0, "z")], "v double, s string")
    model = T.Fill(values={"numeric": ["v"], "text": ["s"], "mark": True}).fit(train)
    assert [tuple(r) for r in model.transform(test).collect()] == [(3.5, "a", True, True), (99.0, "z", False, False)]
    empty = T.Fill(values={"numeric": ["v"], "text": ["s"], "mark": False}).fit(train.limit(0))
    assert [tuple(r) for r in empty.transform(test).collect()] == [(None, None), (99.0, "z")]


def test_encoder_and_scaler_of_odd_columns(spark):
    train = spark.createDataFrame([("a", 2.0)] * 3 + [("b", 2.0), (None, 2.0), (None, 2.0), (None, 2.0)], "s string, v double")
    test = spark.createDataFrame([("a", 5.0), ("b", 2.0), ("new", None), (None, 1.0)], "s string, v double")
    coded = T.Encode(values={"column": "s", "out": "code", "min_rows": 2}).fit(train).transform(test)
    assert {r.s: r.code for r in coded.collect()} == {"a": "a", "b": "OTHER", "new": "OTHER", None: "OTHER"}
    assert sorted(r.v for r in T.Scale(values={"columns": ["v"]}).fit(train).transform(test).collect() if r.v is not None) == [-1.0, 0.0, 3.0]


def test_refused_settings(tables):
    train, test = tables
    with pytest.raises(ValueError):
        T.apply_theta(train, test.drop("x"), T.Theta(seed=1), ["id"], FEATURES)
    with pytest.raises(ValueError):
        T.apply_theta(train, test, T.Theta(seed=1), ["x"], FEATURES)


def test_audit_record(spark, tables):
    train, test = tables
    a, b, _, audit = T.apply_theta(train, test, T.Theta(seed=1, n_drop=1), ["id"], FEATURES)
    found = {r.name: r for r in T.audit_record(spark, audit, {"train": a, "test": b}).collect()}
    assert (found["train"].n, found["test"].n) == (400, 200) and found["train"].fingerprint != found["test"].fingerprint
    record = json.loads(found["test"].audit)
    assert record["theta"]["seed"] == 1 and len(record["code_version"]) == 64 and record["dropped"] == audit["dropped"]
    same = {r.name: r.fingerprint for r in T.audit_record(spark, audit, {"train": a.repartition(5)}).collect()}
    assert same["train"] == found["train"].fingerprint

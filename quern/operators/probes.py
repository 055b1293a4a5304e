"""Baselines and leakage probes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.functions.draws import rows
from quern.functions.multiset import encoded
from quern.session import dealt


def determinism(df: DataFrame, families: Mapping[str, Sequence[str]], target: str) -> DataFrame:
    """How far each column or tuple fixes the label.

    ``determined`` is the share of rows whose value always has one label,
    ``purity`` the share guessed by the majority label per value, ``lift`` the
    gain over the global majority. Rows become (family, value, label) counts on
    the map side, so a frequent value costs one row per task. Null is a value of its own.
    """
    cells = [
        F.struct(F.lit(name).alias("family"), encoded(*cols).alias("x"))
        for name, cols in families.items()
    ]
    counts = (
        df.select(F.col(target).alias("y"), F.explode(F.array(*cells)).alias("c")).select("y", "c.*")
        .groupBy("family", "x", "y").agg(rows().alias("n"))
    )
    per_value = counts.groupBy("family", "x").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    majority = df.groupBy(target).agg(rows().alias("n")).agg(F.max("n") / F.sum("n")).scalar()
    return per_value.groupBy("family").agg(
        F.sum("n").alias("n"), rows().alias("distinct_values"),
        (F.sum(F.when(F.col("top") == F.col("n"), F.col("n")).otherwise(0)) / F.sum("n")).alias("determined"),
        (F.sum("top") / F.sum("n")).alias("purity"),
    ).withColumn("lift", F.col("purity") - majority)


def group_baseline(train: DataFrame, test: DataFrame, group: str, y: str, out: str) -> DataFrame:
    """Training mean per group, unseen groups fall back to the global mean."""
    overall = train.agg(F.avg(y)).scalar()
    fitted = train.groupBy(group).agg(F.avg(y).alias("_m"))
    return test.join(fitted, group, "left").withColumn(out, F.coalesce(F.col("_m"), overall)).drop("_m")


def ols_rmse(x: Column, y: Column) -> Column:
    """RMSE of a least-squares line with intercept, as one aggregate."""
    r = F.corr(x, y)
    return F.sqrt(F.var_pop(y) * (F.lit(1.0) - r * r))


def co_occurrence(
    df: DataFrame, basket: str, item: str, vocabulary: Sequence[str], other: str = "OTHER"
) -> DataFrame:
    """Pair counts and PMI of vocabulary items that share a basket.

    Items outside the declared vocabulary count as ``OTHER``. A basket becomes
    its set of labels before pairs are made, so its size does not matter: it
    gives at most len(vocabulary)**2 / 2 pairs.
    """
    known = F.col(item).isin(list(vocabulary))
    label = F.when(known, F.col(item)).otherwise(other)
    sets = df.groupBy(basket).agg(F.collect_set(label).alias("s")).select(F.array_sort("s").alias("s"))
    # Equal sets are counted once before any pair is made.
    kinds = sets.groupBy("s").agg(rows().alias("n"))
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    pair_n = kinds.select("n", F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.sum("n").alias("pair_n"))
    single = kinds.select("n", F.explode("s").alias("i")).groupBy("i").agg(F.sum("n").alias("m"))
    total = kinds.agg(F.sum("n")).scalar()
    return (
        pair_n.join(single.select(F.col("i").alias("a"), F.col("m").alias("a_n")), "a")
        .join(single.select(F.col("i").alias("b"), F.col("m").alias("b_n")), "b")
        .withColumn("pmi", F.ln(F.col("pair_n") * total / (F.col("a_n") * F.col("b_n")).cast("double")))
    )


def pareto_front(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows not dominated on (x, y), larger better; meant for a bounded list of settings."""
    at_or_right = Window.orderBy(F.desc(x), F.desc(y)).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(y).over(at_or_right)
    return df.withColumn("_b", best).withColumn("non_dominated", F.col("_b").isNull() | (F.col(y) > F.col("_b"))).drop("_b")


def linear_model(train: DataFrame, features: Sequence[str], y: str, reg: float = 0.0):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    ready = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(train)
    return LinearRegression(labelCol=y, regParam=reg, solver="normal").fit(ready.select("features", y))


def score_model(model, test: DataFrame, features: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(test)
    return model.transform(ready).drop("features")


def boosted_trees(train: DataFrame, features: Sequence[str], y: str, rounds: int = 5, depth: int = 3, seed: int = 7):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    train = dealt(train, train.count(), *features, y)  # the rounds read each task's rows again, from memory
    ready = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(train)
    return GBTRegressor(labelCol=y, maxIter=rounds, maxDepth=depth, seed=seed).fit(ready.select("features", y))


def rmse(df: DataFrame, y: str, p: str) -> Column:
    return F.sqrt(F.avg((F.col(y) - F.col(p)) * (F.col(y) - F.col(p))))

"""Reproducible splits, quotas, masks and train-fitted transforms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.functions.draws import draw_digest, uniform
from quern.operators.ranks import share_limit


GROUP_LIMIT = 1000  # spark.sql.optimizer.windowGroupLimitThreshold by default


def exact_split(df: DataFrame, key: str, seed: int, test_share: float = 0.25) -> DataFrame:
    """Add ``is_test`` for exactly ceil(share * rows) rows of a table with unique keys.

    The rows with the smallest key digests are taken. Their limit is one scalar,
    so the split itself is a filter that neither sorts nor shuffles the table.
    """
    digest = draw_digest(seed, "split", key)
    return df.withColumn("is_test", digest <= share_limit(df.select(key), digest, test_share))


def part_by_share(seed: int, shares: Mapping[str, float], *keys: str | Column) -> Column:
    """Partition name by thresholds on one hashed draw; the last name takes the rest."""
    u = uniform(seed, "part", *keys)
    names = list(shares)
    edge, out = 0.0, None
    for name in names[:-1]:
        edge = round(edge + shares[name], 12)
        out = F.when(u < edge, name) if out is None else out.when(u < edge, name)
    return out.otherwise(names[-1])


def time_part(t: Column, cut: Column, purge: Column) -> Column:
    """train / purged / test with a gap of ``purge`` before the cut."""
    return F.when(t < cut - purge, "train").when(t < cut, "purged").otherwise("test")


def quota_sample(
    df: DataFrame, strata: Sequence[str], key: str, quota: int, seed: int
) -> DataFrame:
    """At most ``quota`` rows per stratum in hashed order with a stable tie-break.

    Spark limits every stratum before the shuffle for quotas up to its window
    group limit; beyond that strata are first cut in sixteen salted parts, so a
    hot stratum never meets whole in one task.
    """
    drawn = df.withColumn("_d", draw_digest(seed, "quota", key))
    if quota > GROUP_LIMIT:
        part = Window.partitionBy(*strata, F.substring("_d", 1, 1)).orderBy("_d", key)
        drawn = drawn.withColumn("_q", F.row_number().over(part)).where(F.col("_q") <= quota).drop("_q")
    order = Window.partitionBy(*strata).orderBy("_d", key)
    return drawn.withColumn("_q", F.row_number().over(order)).where(F.col("_q") <= quota).drop("_q", "_d")


def fit_vocabulary(train: DataFrame, column: str, min_rows: int) -> DataFrame:
    """Categories with enough training rows."""
    return (
        train.groupBy(column).agg(F.count(F.lit(1)).alias("train_rows"))
        .where(F.col("train_rows") >= min_rows)
    )


def encode(df: DataFrame, vocabulary: DataFrame, column: str, out: str) -> DataFrame:
    """Training categories keep their name, anything else becomes ``OTHER``."""
    known = vocabulary.select(column).withColumn(out, F.col(column))
    return df.join(known, column, "left").withColumn(out, F.coalesce(out, F.lit("OTHER")))


def popularity_regime(train: DataFrame, item: str, head: float, mid: float) -> DataFrame:
    """head/mid/tail per item from its training count.

    Items with equal counts share a regime, so the running share is taken over
    the histogram of counts, which is far smaller than the item list.
    """
    counts = train.groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    histogram = counts.groupBy("n").agg((F.count(F.lit(1)) * F.col("n")).alias("rows"))
    before = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    share = F.coalesce(F.sum("rows").over(before), F.lit(0)) / F.sum("rows").over(
        Window.partitionBy()
    )
    regime = F.when(share < head, "head").when(share < mid, "mid").otherwise("tail")
    return counts.join(histogram.select("n", regime.alias("regime")), "n").select(item, "n", "regime")

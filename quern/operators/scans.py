"""Scans of affine maps: recurrences ``s' = a * s + b`` over long ordered series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quern.session import materialise

FAN = 64


def _total(maps: str) -> Column:
    """One map that does what all maps of the list do, first to last."""
    one = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    return F.aggregate(maps, one, lambda s, m: F.struct((m["a"] * s["a"]).alias("a"), (m["a"] * s["b"] + m["b"]).alias("b")))


def _before_each(maps: str, start: str) -> Column:
    """The state each map of the list meets, as ``(p, s)``."""
    empty = F.array().cast("array<struct<p:bigint,s:double>>")
    first = F.struct(F.col(start).cast("double").alias("s"), empty.alias("seen"))
    step = lambda acc, m: F.struct(
        (m["a"] * acc["s"] + m["b"]).alias("s"), F.array_append(acc["seen"], F.struct(m["p"].alias("p"), acc["s"].alias("s"))).alias("seen"))
    return F.aggregate(maps, first, step)["seen"]


def affine_scan(
    df: DataFrame, keys: Sequence[str], position: str, a: Column, b: Column, start: float = 0.0, out: str = "state", fan: int = FAN
) -> DataFrame:
    """``(keys, position, out)``: the state before each row, where a row turns ``s`` into ``a * s + b``.

    ``position`` is a long and unique within the keys; rows with null keys form a series like others.
    Maps compose associatively, so the scan is a tree: ``fan`` neighbouring positions form a chunk whose
    composed map is one row of the level above, up to one chunk a series; on the way down
    each chunk hands its members the state they start from. No list is longer than ``fan``, and no
    row is dropped however long the series.
    """
    keys = list(keys)
    low, high = df.agg(F.min(position), F.max(position)).first()
    if low is None:
        return df.select(*keys, position, F.lit(None).cast("double").alias(out))
    maps = df.select(*keys, (F.col(position) - low).alias("p"), a.cast("double").alias("a"), b.cast("double").alias("b"))
    levels, width = [], high - low
    while True:
        chunks = maps.groupBy(*keys, F.expr(f"p div {fan}").alias("c")).agg(F.sort_array(F.collect_list(F.struct("p", "a", "b"))).alias("maps"))
        levels.append(materialise(chunks))
        width //= fan
        if width == 0:
            break
        maps = levels[-1].select(*keys, F.col("c").alias("p"), _total("maps").alias("t")).select(*keys, "p", "t.a", "t.b")
    states = levels[-1].withColumn("s", F.lit(start))
    for lower in [*reversed(levels[:-1]), None]:
        each = states.select(*keys, F.explode(_before_each("maps", "s")).alias("e")).select(*keys, "e.p", "e.s")
        if lower is None:
            return each.select(*keys, (F.col("p") + low).alias(position), F.col("s").alias(out))
        handed = each.withColumnsRenamed({k: f"_r_{k}" for k in keys})
        same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
        states = lower.join(handed, [*same, F.col("c") == F.col("p")]).select(*keys, "maps", "s")

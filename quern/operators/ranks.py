"""Exact global ranks, running totals and quantiles without a one-task sort."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.session import materialise


def hashed_rank(
    df: DataFrame,
    digest: str,
    ties: Sequence[str] = (),
    out: str = "rank",
    prefix: int = 4,
    total: str | None = None,
) -> DataFrame:
    """1-based global rank by a hex digest column; ``total`` names a row-count column.

    Rows are ranked inside each digest prefix; the running size of the earlier
    prefixes is added. A digest spreads evenly, so no prefix is hot, and there
    are at most 16**prefix offsets to broadcast.
    """
    keyed = df.withColumn("_p", F.coalesce(F.substring(digest, 1, prefix), F.lit("")))
    sizes = keyed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_p",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"),
        *([F.sum("_n").over(Window.partitionBy()).alias(total)] if total else []),
    )
    local = F.row_number().over(Window.partitionBy("_p").orderBy(digest, *ties))
    ranked = keyed.withColumn("_r", local).join(F.broadcast(offsets), "_p")
    return ranked.withColumn(out, (F.col("_r") + F.col("_o")).cast("long")).drop("_p", "_r", "_o")


def share_limit(df: DataFrame, digest: Column, share: float, prefix: int = 4) -> Column:
    """Digest at rank ceil(share * rows) as a scalar, so that a rank limit is a plain filter.

    Sizes of the digest prefixes locate the one that holds the rank; only its
    rows (one in 16**prefix) are sorted. The rows themselves are never shuffled.
    """
    keyed = df.select(digest.alias("_d")).withColumn("_p", F.substring("_d", 1, prefix))
    sizes = keyed.groupBy("_p").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    spans = sizes.select(
        F.col("_p").alias("p"), "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("o"),
        F.ceil(F.sum("n").over(Window.partitionBy()) * F.lit(share)).alias("k"),
    )
    at = spans.where("o < k and o + n >= k").select(F.struct("p", "o", "k")).scalar()
    near = keyed.where(F.col("_p") == at["p"])
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("_d")) + at["o"]
    return near.select("_d", rank.alias("_r")).where(F.col("_r") == at["k"]).agg(F.max("_d")).scalar()


def cut_points(df: DataFrame, x: str, pieces: int = 128) -> list:
    """``pieces - 1`` ascending bounds that cut ``df`` in about equal numbers of rows.

    One map-side sketch, fetched as a short list. Fixed bounds are the same in
    every branch of a plan and in every retry, which a sketch that is evaluated
    twice would not be.
    """
    shares = [i / pieces for i in range(1, pieces)]
    found = df.agg(F.percentile_approx(F.col(x), shares, 4 * pieces)).first()[0]
    return sorted(found) if found else []


def add_bucket(df: DataFrame, x: str, bounds: Sequence, out: str = "_b") -> DataFrame:
    """Add the bucket number of numeric ``x`` between ascending bounds.

    Any monotone bucketing gives exact results further on; equal depth bounds
    the rows per bucket whatever key or time they cluster on. The bounds sit in
    the bucketizer, not in the plan, which they would swell.
    """
    inner = sorted({float(b) for b in bounds if math.isfinite(b)})
    if not inner:
        return df.withColumn(out, F.lit(0))
    splits = [-math.inf, *inner, math.inf]
    cut = Bucketizer(splits=splits, inputCol="_x", outputCol="_y", handleInvalid="keep")
    placed = cut.transform(df.withColumn("_x", F.col(x).cast("double")))
    return placed.withColumn(out, F.coalesce(F.col("_y").cast("int"), F.lit(0))).drop("_x", "_y")


def running_totals(
    points: DataFrame,
    source: DataFrame,
    x: str,
    sums: Sequence[str],
    groups: Sequence[str] = (),
    buckets: int = 128,
) -> DataFrame:
    """Add ``before_<s>`` and ``all_<s>``: totals over smaller ``x``, and over the group.

    ``points`` holds one row per (groups, x) of ``source``. Totals run inside
    equal-depth buckets of ``x``; the bucket totals of a group give the carry.
    """
    groups = list(groups)
    placed = add_bucket(points, x, cut_points(source, x, buckets))
    totals = placed.groupBy(*groups, "_b").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    before = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    carry = totals.select(
        *groups,
        "_b",
        *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_c_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(whole).alias(f"all_{s}") for s in sums],
    )
    inner = (
        Window.partitionBy(*groups, "_b").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    )
    local = placed.select(
        "*", *[F.coalesce(F.sum(s).over(inner), F.lit(0)).alias(f"_l_{s}") for s in sums]
    )
    joined = local.join(carry, [*groups, "_b"])
    for s in sums:
        joined = joined.withColumn(f"before_{s}", F.col(f"_l_{s}") + F.col(f"_c_{s}"))
    return joined.drop("_b", *[f"_l_{s}" for s in sums], *[f"_c_{s}" for s in sums])


CLASS_ROWS = 1 << 16
"""Most rows of one group that are ever sorted together."""
_GRID = 256


def _by(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join on equal keys, null being a key like others; one broadcast row where there are no groups."""
    marked = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(F.broadcast(marked) if list(keys) == ["_all"] else marked, same).drop(*[f"_r_{k}" for k in keys])


def _inside(values: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    x, low, high = F.col("_x"), F.col("_low"), F.col("_high")
    return _by(values, state, keys).where((low.isNull() | (x > low)) & (high.isNull() | (x < high)))


def bounded_class(values: DataFrame, keys: Sequence[str], share: float, limit: int) -> DataFrame:
    """Where the wanted rank of each group stands: in a known value, or in a class of at most ``limit`` rows.

    Gives ``_k`` (0-based rank), ``_part`` (what is left of the place after it), ``_value`` where it
    is known, else the open interval ``(_low, _high)`` of its class; ``_rows`` of the class and the
    number of rows ``_before`` it. Each round lays a histogram of equal-depth cells over the class, picks
    the two cell bounds around the rank, counts what lies below, at, between, at and above them, and keeps
    the one of the five that holds the rank. A value with more than a cell's rows is a bound of its
    own, so a class shrinks about eighty-fold a round whatever the ties. Bounds are written before they are
    used: counting and sorting see the same ones even when a task runs again.
    """
    place = F.lit(share) * (F.col("_n") - 1)
    kind = values.schema["_x"].dataType
    state = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(
        *keys, F.floor(place).alias("_k"), (place - F.floor(place)).alias("_part"), F.lit(None).cast(kind).alias("_value"),
        F.lit(None).cast(kind).alias("_low"), F.lit(None).cast(kind).alias("_high"), F.lit(0).cast("long").alias("_before"), F.col("_n").alias("_rows"))
    wide = F.col("_value").isNull() & (F.col("_rows") > limit)
    while state.agg(F.max(wide)).first()[0]:
        grid = F.percentile_approx("_x", [i / _GRID for i in range(_GRID + 1)], 40 * _GRID)
        cells = _inside(values, state.where(wide), keys).groupBy(*keys).agg(grid.alias("_grid"))
        at = F.floor((F.col("_k") - F.col("_before")) * _GRID / F.col("_rows")).cast("int")
        bounds = [F.get("_grid", F.greatest(at - 1, F.lit(0))).alias("_m0"), F.get("_grid", F.least(at + 2, F.lit(_GRID))).alias("_m1")]
        marks = materialise(_by(state.where(wide), cells, keys).select("*", *bounds).drop("_grid"))
        x, m0, m1 = F.col("_x"), F.col("_m0"), F.col("_m1")
        five = [x < m0, x == m0, (x > m0) & (x < m1), (x == m1) & (m1 > m0), x > m1]
        counts = _inside(values, marks, keys).groupBy(*keys).agg(*[F.count(F.when(c, 1)).alias(f"_c{i}") for i, c in enumerate(five)])
        state = materialise(state.where(~wide).unionByName(_kept(_by(marks, counts, keys), state.columns)))
    return state


def _kept(counted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The one of the five counted parts that holds the rank."""
    m0, m1 = F.col("_m0"), F.col("_m1")
    ends = [F.col("_before")]
    for i in range(5):
        ends.append(ends[-1] + F.col(f"_c{i}"))
    none, low, high = F.lit(None), F.col("_low"), F.col("_high")
    parts = [(none, low, m0), (m0, low, high), (none, m0, m1), (m1, low, high), (none, m1, high)]
    chosen = None
    for i, (value, below, above) in enumerate(parts):
        own = F.struct(value.cast(counted.schema["_m0"].dataType).alias("_value"), below.alias("_low"), above.alias("_high"), ends[i].alias("_before"), F.col(f"_c{i}").alias("_rows"))
        holds = F.col("_k") < ends[i + 1]
        chosen = F.when(holds, own) if chosen is None else chosen.when(holds, own)
    new = counted.withColumn("_new", chosen)
    return new.select(*[F.col("_new")[c].alias(c) if c in ("_value", "_low", "_high", "_before", "_rows") else F.col(c) for c in columns])


def exact_quantile(
    df: DataFrame, x: str, share: float, groups: Sequence[str] = (), out: str = "q", limit: int = CLASS_ROWS
) -> DataFrame:
    """Interpolated quantile of ``x`` per group; one row per group with non-null values, one row without groups.

    :func:`bounded_class` finds a class of at most ``limit`` rows that holds the wanted rank; only
    such classes are sorted. Nothing but sketches, counts and those classes is shuffled.
    """
    keys = list(groups) or ["_all"]
    values = df.where(F.col(x).isNotNull()).select(*[F.lit(0).alias("_all")] if not groups else groups, F.col(x).alias("_x"))
    state = bounded_class(values, keys, share, limit)
    known = F.col("_value").isNotNull()
    lists = _inside(values, state.where(~known), keys).groupBy(*keys).agg(F.sort_array(F.collect_list("_x")).alias("_list"))
    at = (F.col("_k") - F.col("_before")).cast("int")
    sorted_ = _by(state.where(~known), lists, keys).select(*keys, "_part", F.get("_list", at).alias("_lo"), F.get("_list", at + 1).alias("_hi"))
    tied = F.when(F.col("_k") + 1 < F.col("_before") + F.col("_rows"), F.col("_value"))
    ends = sorted_.union(state.where(known).select(*keys, "_part", F.col("_value").alias("_lo"), tied.alias("_hi")))
    short = ends.where("_part > 0 and _hi is null").select(*keys, "_lo")
    nexts = _by(values, short, keys).where("_x > _lo").groupBy(*keys).agg(F.min("_x").alias("_next"))
    ends = ends.join(nexts.withColumnsRenamed({k: f"_r_{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], "left")
    lo = F.col("_lo").cast("double")
    hi = F.coalesce("_hi", "_next", "_lo").cast("double")
    found = ends.select(*keys, (lo + F.col("_part") * (hi - lo)).alias(out))
    return found if groups else found.agg(F.max(out).alias(out))


def exact_median(
    df: DataFrame, x: str, groups: Sequence[str] = (), out: str = "median"
) -> DataFrame:
    return exact_quantile(df, x, 0.5, groups, out)

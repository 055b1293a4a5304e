"""Ordered work per entity in two levels: inside a time chunk, then across chunks.

An entity with a third of all rows would be one task under a plain window.
Here the window partition is (entity, chunk); per chunk one summary row moves
on. Chunks are cut at equal numbers of rows of the whole table, so no chunk of
any entity holds more than its share, however bursty the times; an entity has
at most as many summaries as there are chunks.

``chunks`` is None (cut the operator's own input), a list from
:func:`time_chunks` (to share one cut over several steps), or a fixed width.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.operators.ranks import add_bucket, cut_points

DAY = 86_400_000_000


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 as a long (session time zone pinned to UTC)."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(col.cast("timestamp"))


Chunks = int | Sequence | None


def chunk_count(df: DataFrame) -> int:
    """Chunks that keep the whole cluster busy on one hot entity: 32 to 1,024."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return max(32, min(1024, tasks))


def time_chunks(df: DataFrame, t: str, pieces: int | None = None) -> list:
    """Bounds of equally filled chunks of ``t``."""
    return cut_points(df, t, pieces or chunk_count(df))


def _chunked(df: DataFrame, t: str, chunks: Chunks, source: DataFrame | None = None) -> DataFrame:
    if isinstance(chunks, int):
        return df.withColumn("_k", F.floor(F.col(t) / F.lit(chunks)).cast("long"))
    bounds = time_chunks(df if source is None else source, t) if chunks is None else chunks
    return add_bucket(df, t, bounds, "_k")


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cols: Sequence[str],
    chunks: Chunks = None,
    ahead: bool = False,
    tag: str | None = None,
) -> DataFrame:
    """Add ``prev_<c>`` (or ``next_<c>``): the value on the adjacent row of the entity.

    ``order`` starts with a numeric column and is unique within an entity.
    """
    tag = tag or ("next" if ahead else "prev")
    keys = list(keys)
    step = F.lead if ahead else F.lag
    edge = F.min if ahead else F.max
    chunked = _chunked(df, order[0], chunks)
    inner = Window.partitionBy(*keys, "_k").orderBy(*order)
    packed = F.struct(
        *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
        *[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)],
    )
    ends = chunked.groupBy(*keys, "_k").agg(edge(packed).alias("_end"))
    across = Window.partitionBy(*keys).orderBy("_k")
    carry = ends.select(*keys, "_k", step("_end").over(across).alias("_carry"))
    local = chunked.withColumn("_near", step(packed).over(inner)).join(carry, [*keys, "_k"], "left")
    near = F.coalesce(F.col("_near"), F.col("_carry"))
    return local.select(
        *[F.col(c) for c in df.columns], *[near[f"c{i}"].alias(f"{tag}_{c}") for i, c in enumerate(cols)]
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: Mapping[str, tuple[str, Column]],
    chunks: Chunks = None,
    inclusive: bool = True,
) -> DataFrame:
    """Add running ``sum``/``min``/``max`` columns per entity.

    ``specs`` maps an output name to (function, input column); ``order`` is
    unique within an entity. A sum over no rows is 0, an extreme is null.
    """
    fold = {"sum": F.sum, "min": F.min, "max": F.max}
    keys = list(keys)
    chunked = _chunked(df, order[0], chunks)
    for i, (_, col) in enumerate(specs.values()):
        chunked = chunked.withColumn(f"_v{i}", col)
    stop = 0 if inclusive else -1
    inner = (
        Window.partitionBy(*keys, "_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, stop)
    )
    across = Window.partitionBy(*keys).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    kinds = [fn for fn, _ in specs.values()]
    totals = chunked.groupBy(*keys, "_k").agg(
        *[fold[fn](f"_v{i}").alias(f"_t{i}") for i, fn in enumerate(kinds)]
    )
    carry = totals.select(
        *keys, "_k", *[fold[fn](f"_t{i}").over(across).alias(f"_c{i}") for i, fn in enumerate(kinds)]
    )
    joined = chunked.select(
        "*", *[fold[fn](f"_v{i}").over(inner).alias(f"_l{i}") for i, fn in enumerate(kinds)]
    ).join(carry, [*keys, "_k"], "left")
    outs = []
    for i, (name, fn) in enumerate(zip(specs, kinds)):
        local, before = F.col(f"_l{i}"), F.col(f"_c{i}")
        if fn == "sum":
            value = F.coalesce(local, F.lit(0)) + F.coalesce(before, F.lit(0))
        else:
            value = F.greatest(local, before) if fn == "max" else F.least(local, before)
        outs.append(value.alias(name))
    return joined.select(*[F.col(c) for c in df.columns], *outs)


def strictly_prior(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    sums: Mapping[str, Column],
    chunks: Chunks = None,
) -> DataFrame:
    """Add totals over rows of the entity with a strictly earlier ``t``.

    Rows of one entity and instant are collapsed first, so equal timestamps
    never see each other and a burst of equal timestamps stays one row.
    """
    keys = list(keys)
    points = df.groupBy(*keys, t).agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    totals = running(
        points, keys, [t], {n: ("sum", F.col(f"_{n}")) for n in sums},
        time_chunks(df, t) if chunks is None else chunks, inclusive=False,
    ).select(*keys, t, *sums)
    return df.join(totals, [*keys, t], "left")


def as_of(
    probe: DataFrame,
    build: DataFrame,
    keys: Sequence[str],
    t: str,
    cols: Sequence[str],
    inclusive: bool = False,
    delay: int = 0,
    chunks: Chunks = None,
) -> DataFrame:
    """Left as-of join: the latest build row at or before (strictly before) the probe time.

    ``build`` becomes visible ``delay`` microseconds after its ``t``. Build rows
    that share key and time collapse to the greatest value struct; probe times
    are made distinct before the ordered pass and joined back afterwards.
    """
    keys = list(keys)
    packed = F.struct(*[F.col(c) for c in cols])
    facts = (
        build.withColumn(t, F.col(t) + F.lit(delay))
        .groupBy(*keys, t)
        .agg(F.max(packed).alias("_val"))
        .withColumn("_side", F.lit(0 if inclusive else 1))
    )
    asks = (
        probe.select(*keys, t).distinct()
        .withColumn("_val", F.lit(None).cast(facts.schema["_val"].dataType))
        .withColumn("_side", F.lit(1 if inclusive else 0))
    )
    is_ask = F.col("_side") == F.lit(1 if inclusive else 0)
    both = build.select(t).unionByName(probe.select(t))
    line = _chunked(facts.unionByName(asks), t, chunks, source=both)
    inner = (
        Window.partitionBy(*keys, "_k").orderBy(t, "_side")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    across = Window.partitionBy(*keys).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    ends = line.groupBy(*keys, "_k").agg(
        F.max(F.when(F.col("_val").isNotNull(), F.struct(F.col(t), F.col("_val")))).alias("_end")
    )
    carry = ends.select(
        *keys, "_k", F.last("_end", ignorenulls=True).over(across).alias("_carry")
    )
    seen = (
        line.withColumn("_seen", F.last("_val", ignorenulls=True).over(inner))
        .where(is_ask)
        .join(carry, [*keys, "_k"], "left")
        .withColumn("_hit", F.coalesce(F.col("_seen"), F.col("_carry")["_val"]))
        .select(*keys, t, *[F.col("_hit")[c].alias(f"asof_{c}") for c in cols])
    )
    return probe.join(seen, [*keys, t], "left")

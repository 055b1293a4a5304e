"""Rules that tie predictions to each other: order, conservation, hierarchy. Broken rows are named, never repaired."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DecimalType

from quern.functions.draws import count_where, rows
from quern.operators.ordered import Chunks, neighbour
from quern.session import materialise


def falls(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, strict: bool = False, chunks: Chunks = None) -> DataFrame:
    """``(keys, n, n_missing, n_falls, worst)``: steps at which ``value`` falls (``strict``: does not rise).

    ``order`` starts with a numeric column and is unique within its keys. Rows
    without a value are counted and take no part in the steps. ``worst`` is the
    deepest fall, null where there is none.
    """
    # keys travel as one struct: a struct of nulls equals itself, so rows without a key are an entity too
    entity = df.select(F.struct(*keys).alias("_e"), *order, value)
    steps = neighbour(entity.where(F.col(value).isNotNull()), ["_e"], order, [value], chunks)
    down = F.col(f"prev_{value}") - F.col(value)
    broken = down >= 0 if strict else down > 0
    per_key = steps.groupBy("_e").agg(count_where(broken).alias("n_falls"), F.max(F.when(broken, down)).alias("worst"))
    sizes = entity.groupBy("_e").agg(rows().alias("n"), count_where(F.col(value).isNull()).alias("n_missing"))
    joined = sizes.join(per_key, "_e", "left")
    return joined.select("_e.*", "n", "n_missing", F.coalesce("n_falls", F.lit(0)).alias("n_falls"), "worst")


def conservation(parts: DataFrame, wholes: DataFrame, key: str, part: str, whole: str, tol: float = 0.0) -> DataFrame:
    """``(key, part_sum, whole, verdict)``: what the parts of a key add up to against its declared whole.

    ``verdict`` is ``ok``, ``not_conserved``, ``missing_value`` (a null among parts
    or whole), ``no_parts`` or ``no_whole``. A null key matches nothing. Parts are
    summed on the map side, so a key with most of the parts is no hot task.
    """
    sums = parts.groupBy(F.col(key).alias("_k")).agg(F.sum(part).alias("part_sum"), rows().alias("_n"), count_where(F.col(part).isNull()).alias("_null"))
    both = wholes.select(key, F.col(whole).alias("whole"), F.lit(1).alias("_w")).join(sums, F.col(key) == F.col("_k"), "full")
    verdict = (
        F.when(F.col("_w").isNull(), "no_whole").when(F.col("_n").isNull(), "no_parts")
        .when((F.col("_null") > 0) | F.col("whole").isNull(), "missing_value")
        .when(F.abs(F.col("part_sum") - F.col("whole")) > tol, "not_conserved").otherwise("ok")
    )
    return both.select(F.coalesce(key, "_k").alias(key), "part_sum", "whole", verdict.alias("verdict"))


def subtree_totals(nodes: DataFrame, node: str, parent: str, value: str) -> DataFrame:
    """``(node, total, place)``: the sum of ``value`` over each node and everything below it.

    Pointer doubling: after k rounds a node holds the sum over descendants less
    than 2**k steps below it and points to its ancestor 2**k steps up, so a tree
    of depth d takes about log2(d) rounds, each over one row per node; the
    closure of all ancestors is never formed. ``place`` is ``root``, ``inner``,
    ``orphan`` (its parent is no node; it heads a tree of its own) or ``cycle`` (no
    root above it; its total is null). Nodes are unique and not null; a null
    value counts as zero.
    """
    kind = nodes.schema[value].dataType
    wide = DecimalType(38, kind.scale) if isinstance(kind, DecimalType) else kind
    own = nodes.select(F.col(node).alias("node"), F.col(parent).alias("parent"), F.coalesce(F.col(value), F.lit(0)).cast(wide).alias("total"))
    known = own.select(F.col("node").alias("jump"))
    start = materialise(own.join(known, own["parent"] == known["jump"], "left"))
    places = start.select("node", F.when(F.col("parent").isNull(), "root").when(F.col("jump").isNull(), "orphan").otherwise("inner").alias("place"))
    state = start.select("node", "jump", "total")
    left = state.count()
    while left and not state.where("jump is not null").isEmpty():
        below = state.where("jump is not null").groupBy(F.col("jump").alias("node")).agg(F.sum("total").cast(wide).alias("below"))
        above = state.select(F.col("node").alias("jump"), F.col("jump").alias("far"))
        joined = state.join(below, "node", "left").join(above, "jump", "left")
        total = F.col("total") + F.coalesce("below", F.lit(0).cast(wide))
        state = materialise(joined.select("node", F.col("far").alias("jump"), total.cast(wide).alias("total")))
        left //= 2  # a path without a cycle is shorter than the number of nodes
    lost = F.col("jump").isNotNull()
    done = state.join(places, "node")
    return done.select(F.col("node").alias(node), F.when(~lost, F.col("total")).alias("total"), F.when(lost, "cycle").otherwise(F.col("place")).alias("place"))


def hierarchy(nodes: DataFrame, node: str, parent: str, value: str, claimed: str, tol: float = 0.0) -> DataFrame:
    """``(node, total, claimed, verdict)``: the claimed total of every node against the sum of all leaves below it.

    ``verdict`` is ``ok``, ``incoherent``, ``missing_value``, ``orphan`` or ``cycle``.
    """
    totals = subtree_totals(nodes, node, parent, value)
    both = nodes.select(node, F.col(claimed).alias("claimed")).join(totals, node)
    verdict = (
        F.when(F.col("place").isin("orphan", "cycle"), F.col("place")).when(F.col("claimed").isNull(), "missing_value")
        .when(F.abs(F.col("total") - F.col("claimed")) > tol, "incoherent").otherwise("ok")
    )
    return both.select(node, "total", "claimed", verdict.alias("verdict"))

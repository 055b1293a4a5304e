"""What goes together and what follows what, over an open vocabulary.

Both mine pairs whose support reaches a share of all groups. An item below that
share cannot be in such a pair, so it goes first; with s distinct items in a
group on average at most s / share items are left, however large the table is,
and that bounds what one group can hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, GroupedData, functions as F

from quern.functions.draws import rows
from quern.session import dealt, materialise


def _frequent(held: DataFrame, share: float) -> tuple[DataFrame, int]:
    """``(item, n)`` of items in at least ``share`` of all groups of ``held(group, item)``, and the groups."""
    total = dealt(held.select("group"), held.count(), "group").distinct().count()
    return materialise(held.groupBy("item").agg(rows().alias("n")).where(F.col("n") >= F.lit(share) * F.lit(float(total)))), total


def _dealt_pairs(seen: DataFrame) -> DataFrame:
    """Rows of a written table by group and item; what made them (a join, say) has sorted its rows in tasks of its own."""
    return dealt(seen, seen.count(), "group", "item")


def _by_group(rows: DataFrame, held: DataFrame) -> GroupedData:
    """``rows`` of ``held`` by group. They are dealt out first: a file split of ``held`` has too many rows to sort in one task."""
    return dealt(rows, held.count(), "group").groupBy("group")


def _measured(pairs: DataFrame, items: DataFrame, total: int, share: float) -> DataFrame:
    a, b = (items.select(F.col("item").alias(c), F.col("n").alias(f"{c}_n")) for c in "ab")
    often = pairs.where(F.col("pair_n") >= F.lit(share) * F.lit(float(total)))
    lift = F.col("pair_n") * F.lit(float(total)) / (F.col("a_n") * F.col("b_n")).cast("double")
    return often.join(a, "a").join(b, "b").select("a", "b", "pair_n", "a_n", "b_n", lift.alias("lift"))


def frequent_pairs(df: DataFrame, basket: str, item: str, share: float) -> DataFrame:
    """``(a, b, pair_n, a_n, b_n, lift)``, a < b: items that share at least ``share`` of the baskets.

    Null baskets and items take no part; an item that repeats in its basket counts once.
    """
    seen = materialise(df.select(F.col(basket).alias("group"), F.col(item).alias("item")).dropna())
    held = materialise(_dealt_pairs(seen).distinct())
    items, total = _frequent(held, share)
    sets = _by_group(held.join(items, "item", "left_semi"), held).agg(F.array_sort(F.collect_set("item")).alias("s"))
    # equal sets are counted once before any pair is made
    kinds = sets.groupBy("s").agg(rows().alias("n")).where(F.size("s") > 1)
    firsts = kinds.select("n", F.posexplode("s").alias("at", "a"), "s")
    pairs = firsts.select("n", "a", F.explode(F.slice("s", F.col("at") + 2, F.size("s"))).alias("b"))
    return _measured(pairs.groupBy("a", "b").agg(F.sum("n").alias("pair_n")), items, total, share)


def successions(df: DataFrame, entity: str, at: str, item: str, share: float) -> DataFrame:
    """``(a, b, pair_n, a_n, b_n, lift, confidence)``: entities that met ``a`` and, strictly later, ``b``.

    An entity met b after a where its first a is before its last b. So each
    entity and item becomes one row (first, last) on the map side, and no
    sequence is gathered, however long an entity's history is. ``a`` may be ``b``.
    Rows with a null in any of the three columns take no part.
    """
    seen = df.select(F.col(entity).alias("group"), F.col(item).alias("item"), F.col(at).alias("at")).dropna()
    held = materialise(_dealt_pairs(materialise(seen)).groupBy("group", "item").agg(F.min("at").alias("first"), F.max("at").alias("last")))
    items, total = _frequent(held, share)
    met = _by_group(held.join(items, "item", "left_semi"), held).agg(F.collect_list(F.struct("item", "first", "last")).alias("s"))
    firsts = met.select(F.explode("s").alias("x"), "s")
    later = F.filter("s", lambda y: y["last"] > F.col("x.first"))
    pairs = firsts.select(F.col("x.item").alias("a"), F.explode(F.transform(later, lambda y: y["item"])).alias("b"))
    found = _measured(pairs.groupBy("a", "b").agg(rows().alias("pair_n")), items, total, share)
    return found.withColumn("confidence", F.col("pair_n") / F.col("a_n"))

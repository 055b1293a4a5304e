"""Merkle manifest of a dataset: one tree per group of rows, one above the groups, a proof per row.

A row's leaf is H (lowercase hex sha256) over its chosen columns, each ``-`` if null, else its
UTF-8 byte count, ``:`` and its value. In each group leaves stand by id; every ``ARITY`` consecutive
nodes (the last run may have fewer, even one) become their H until one node remains, the group's
subroot (a lone leaf is its own). Subroots, by group name, likewise give the root.

Built levels are stored as one row per inner node, with the digests of its children and a link to
its parent: ``(tree, level, place)`` and the child's slot there. A group's topmost node links into
the tree above the groups, whose ``tree`` is ``TOP``. The rows of a level come from one aggregate
over the level below, a third of its size, written before the next.

A Spark recursive query climbs from the leaves. Its rows are runs of leaves that share a parent,
with one folded digest per leaf; each step joins the parent's row, keeps its children as the siblings
of that level, replaces the child's digest by the folded one and hashes again. A last aggregate per
run (bounded by the height) strings the siblings together.

Places come from one range partitioning by (group, id, leaf): rows are numbered inside their partition
and moved on by the counts of the partitions before, so a group with a third of all rows is spread
over a third of the partitions.

Defined results: null groups are one group, the first; null ids come first in their group; rows that
repeat an id stand by their leaf, rows equal in all are leaves of their own with proofs by place;
an empty table has no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.session import materialise

ARITY = 3
TOP = -1
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_ROWS = "spark.sql.cteRecursionRowLimit"


def leaf_digest(columns: Sequence[Column]) -> Column:
    """H of the columns, as binary."""
    parts = []
    for column in columns:
        value = column.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def joined(digests: Column | str) -> Column:
    """The digests' hex text, one after the other."""
    return F.array_join(F.transform(digests, hex_of), "")


def fold(digests: Column | str) -> Column:
    return F.unhex(F.sha2(joined(digests), 256))


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``place``, 0, 1, ... by ``order`` inside each non-null ``group``, which ``order`` starts with."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    dealt = materialise(dealt).withColumn("__part", F.shiftright("__at", 33))
    counts = dealt.groupBy(group, "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__n").over(upto), F.lit(0))
    shift = counts.select(group, "__part", (before - F.col("__first")).alias("__shift"))
    return dealt.join(shift, [group, "__part"]).withColumn("place", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift")


@dataclass
class Manifest:
    """``runs(tree, run, n, leaves)``: up to ``ARITY`` leaves under one parent, each with id, digest and
    the digest claimed for it; ``nodes(tree, level, place, children, up_*)``: inner nodes above them."""

    runs: DataFrame
    nodes: DataFrame


def _above(nodes: DataFrame) -> DataFrame:
    """Runs of neighbours of ``nodes(tree, n, place, digest)`` where a tree has more than one: their parents."""
    children = F.sort_array(F.collect_list(F.struct("place", "digest")))["digest"]
    runs = nodes.where("n > 1").groupBy("tree", "n", F.expr(f"place div {ARITY}").alias("run")).agg(children.alias("children"))
    return runs.select("tree", _fewer("n").alias("n"), F.col("run").alias("place"), "children", fold("children").alias("digest"))


def _fewer(n: str) -> Column:
    return F.expr(f"({n} + {ARITY - 1}) div {ARITY}")


def _levels(base: DataFrame, first: int) -> list[DataFrame]:
    """Levels from ``first`` on above ``base(tree, n, place, digest)``, each written before the next."""
    out, most = [], base.agg(F.max("n")).first()[0] or 0
    while most > 1:
        base = materialise(_above(base))
        out.append(base.withColumn("level", F.lit(first + len(out))))
        most = -(-most // ARITY)
    return out


def _linked(nodes: DataFrame) -> DataFrame:
    """Where the parent's row is, and the child's slot there."""
    last, top = F.col("n") == 1, F.col("tree") == TOP
    link = lambda inside, above: F.when(~last, inside).when(~top, above)
    up = [link(F.col("tree"), F.lit(TOP).cast("long")).alias("up_tree"), link(F.col("level") + 1, F.lit(1)).alias("up_level"),
          link(F.expr(f"place div {ARITY}"), F.expr(f"tree div {ARITY}")).alias("up_place"),
          link(F.col("place") % ARITY, F.col("tree") % ARITY).alias("up_slot")]
    return nodes.select("tree", "level", "place", "children", *up)


def build(docs: DataFrame, claimed: Sequence[Column], columns: Sequence[str] = COLUMNS, group: str = "source", id_column: str = "doc_id") -> Manifest:
    """The stored levels over ``docs``; ``claimed`` are the columns whose leaf is to be proved."""
    rows = docs.select(F.col(group).cast("string").alias("group"), F.col(id_column).alias("id"),
                       leaf_digest([F.col(c) for c in columns]).alias("digest"), leaf_digest(claimed).alias("claimed"))
    rows = materialise(rows)
    sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(0))
    trees = materialise(numbered(sizes, "all", ["all", "group"]).select(F.col("group").alias("name"), "n", F.col("place").alias("tree")))
    leaves = rows.join(trees, F.col("group").eqNullSafe(F.col("name"))).select("tree", "n", "id", "digest", "claimed")
    leaves = numbered(leaves, "tree", ["tree", "id", "digest"])
    own = F.sort_array(F.collect_list(F.struct("place", "digest", "id", "claimed")))
    runs = leaves.groupBy("tree", "n", F.expr(f"place div {ARITY}").alias("run")).agg(own.alias("leaves"))
    runs = materialise(runs)
    first = runs.select("tree", _fewer("n").alias("n"), F.col("run").alias("place"),
                        F.when(F.col("n") > 1, fold("leaves.digest")).otherwise(F.col("leaves")[0]["digest"]).alias("digest"))
    levels = _levels(first, 2)
    tops = [level.where("n = 1").select("tree", "digest") for level in (first, *levels)]
    roots = tops[0]
    for more in tops[1:]:
        roots = roots.union(more)
    roots = materialise(roots)
    top = roots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(roots.count()).cast("long").alias("n"), F.col("tree").alias("place"), "digest")
    nodes = None
    for level in [*levels, *_levels(top, 1)]:
        nodes = _linked(level) if nodes is None else nodes.union(_linked(level))
    if nodes is None:
        nodes = _linked(_above(top).withColumn("level", F.lit(1)))
    return Manifest(runs, materialise(nodes))


CLIMB = """
WITH RECURSIVE climb(tree, run, step, at_tree, at_level, at_place, slot, folded, inside, own, children) AS (
  SELECT tree, run, 0, at_tree, at_level, at_place, slot, folded, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS ARRAY<BINARY>)
  FROM {start}
  UNION ALL
  SELECT c.tree, c.run, c.step + 1, n.up_tree, n.up_level, n.up_place, n.up_slot,
    transform(c.folded, f -> unhex(sha2(array_join(transform(n.children, (d, i) -> lower(hex(if(i = c.slot, f, d)))), ''), 256))),
    n.tree, c.slot, n.children
  FROM climb c JOIN {nodes} n ON n.tree = c.at_tree AND n.level = c.at_level AND n.place = c.at_place)
SELECT * FROM climb
"""


@contextmanager
def _unlimited(spark: SparkSession) -> Iterator[None]:
    """No limit on the rows of a recursive query while it runs."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, "-1")
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


def _without(digests: Column, slot: Column) -> Column:
    return F.filter(digests, lambda _, i: i != slot)


def proofs(manifest: Manifest) -> DataFrame:
    """``(id, leaf, subroot, root, siblings, folded_root)`` of every leaf, in hex; ``siblings`` strings the
    proof's digests together from the leaf's level up, ``folded_root`` comes from the claimed leaf."""
    spark = manifest.runs.sparkSession
    lone, claimed = F.col("n") == 1, F.col("leaves")["claimed"]
    folded = F.transform(claimed, lambda f, i: fold(F.transform("leaves.digest", lambda d, j: F.when(i == j, f).otherwise(d))))
    at = lambda inside, above: F.when(F.col("n") <= ARITY, above).otherwise(inside)
    start = manifest.runs.select(
        "tree", "run", at(F.col("tree"), F.lit(TOP).cast("long")).alias("at_tree"), at(F.lit(2), F.lit(1)).alias("at_level"),
        at(F.expr(f"run div {ARITY}"), F.expr(f"tree div {ARITY}")).alias("at_place"), at(F.col("run") % ARITY, F.col("tree") % ARITY).alias("slot"),
        F.when(lone, claimed).otherwise(folded).alias("folded"))
    with _unlimited(spark):
        climb = materialise(spark.sql(CLIMB, start=start, nodes=manifest.nodes))
    path = F.sort_array(F.collect_list(F.when(F.col("step") > 0, F.struct("step", "inside", "own", "children"))))
    ends = climb.groupBy("tree", "run").agg(F.max_by("folded", "step").alias("folded"), path.alias("path"))
    shared = F.array_join(F.transform("path", lambda s: joined(_without(s["children"], s["own"]))), "")
    within = F.filter("path", lambda s: s["inside"] != TOP)
    ends = ends.select("tree", "run", "folded", shared.alias("shared"), F.get(F.reverse(within), F.lit(0))["children"].alias("under"),
                       F.get(F.reverse("path"), F.lit(0))["children"].alias("last"))
    both = manifest.runs.join(ends, ["tree", "run"])
    digests = F.col("leaves")["digest"]
    subroot = F.when(F.col("under").isNotNull(), fold("under")).when(lone, digests[0]).otherwise(fold(digests))
    both = both.withColumn("subroot", subroot).withColumn("root", F.when(F.col("last").isNotNull(), fold("last")).otherwise(F.col("subroot")))
    each = both.select("*", F.posexplode("leaves").alias("slot", "own"))
    return each.select(
        F.col("own")["id"].alias("id"), hex_of(F.col("own")["digest"]).alias("leaf"), hex_of(F.col("subroot")).alias("subroot"), hex_of(F.col("root")).alias("root"),
        F.concat(joined(_without(digests, F.col("slot"))), "shared").alias("siblings"), hex_of(F.get("folded", F.col("slot"))).alias("folded_root"))


def tampered(docs: DataFrame) -> list[Column]:
    """The leaf's columns, with line breaks deleted from the text where 2 divides crc32(doc_id as text)."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(hit, F.translate(F.col("text").cast("string"), "\n", "")).otherwise(F.col("text").cast("string"))
    return [text if c == "text" else F.col(c) for c in COLUMNS]


def manifest_report(docs: DataFrame) -> DataFrame:
    """Digest columns of :func:`proofs` for every row, folded from a tampered leaf for half of them."""
    found = proofs(build(docs, tampered(docs)))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"),
                        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))

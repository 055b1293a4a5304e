"""Exact nearest neighbours by pivots, distance rings and the triangle inequality.

Vectors are scaled to length one, so that a larger cosine is a smaller distance. Pivots are a
fixed number of stored vectors drawn by hash. Every stored vector belongs to its nearest pivot (its
cell) and, inside it, to a ring of distances to that pivot; rings are cut into blocks of bounded
size. For a query q the distances to the pivots bound the distance to anything in a block from
below: by ``d(q, pivot) - outer`` and ``inner - d(q, pivot)``, and, since members are nearer to their pivot
than to any other, by half the difference of q's distances to that pivot and its own nearest.

First every query looks into the block where it would stand itself; its k-th best there bounds the
k-th best of all. Then it visits just the blocks whose lower bound does not exceed that. What is
found is exact whatever the data; clusters make it cheap, vectors without structure (random
directions in many dimensions) make queries visit most blocks.

Queries and blocks meet in groups of at most ``BLOCK`` by ``BLOCK`` rows, so neither a hot cell nor a
popular block ends in one task, and only the k best per query leave a group.

Defined results: vectors that are null, zero or hold null or non-finite components neither ask nor
are found, nor do vectors of another length than the first pivot; ties go to the smaller id; fewer
than k stored vectors give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from quern.session import materialise

PIVOTS = 1024
PIVOT_BYTES = 32 << 20
BLOCK = 4096
RINGS = 64
SEEDS = 64
SLACK = 1e-9
DIGITS = 12


def unit_vectors(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """``(id, v)`` with ``v`` of length one; scaled by the largest component first, so no square over- or underflows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # astype turns null components into nan
            v = [None if x is None else np.asarray(x, dtype=object).astype(float) for x in batch["v"]]
            good = np.array([x is not None and np.isfinite(x).all() and x.any() for x in v], bool)
            scaled = [x / np.abs(x).max() for x, keep in zip(v, good) if keep]
            if scaled:
                yield batch[good].assign(v=pd.Series([x / np.sqrt(x @ x) for x in scaled], batch.index[good], object))

    rows = df.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null")
    return rows.mapInPandas(run, rows.schema)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


class Index:
    """Blocks of the stored vectors and what is known of each: made once, asked any number of times."""

    def __init__(self, vectors: DataFrame, pivots: int = PIVOTS, block: int = BLOCK) -> None:
        vectors = materialise(vectors)
        self.spark, self.block = vectors.sparkSession, block
        total = vectors.count()
        first = vectors.select("v").first()
        self.dimension = len(first.v) if first else 0
        bound = min(pivots, max(1, PIVOT_BYTES // (8 * max(1, self.dimension))), 1 + 8 * total // block)
        same = vectors.where(F.size("v") == self.dimension)
        drawn = same.orderBy(F.xxhash64("id"), "id").limit(bound).collect()
        self.pivots = np.array([r.v for r in drawn]) if drawn else np.zeros((1, max(1, self.dimension)))
        placed = materialise(self._placed(same))
        rings = F.least(F.lit(RINGS), F.ceil(F.count(F.lit(1)) / F.lit(block))).alias("rings")
        cells = placed.groupBy("cell").agg(F.min("r").alias("low"), F.max("r").alias("high"), rings)
        ring = F.floor(F.col("rings") * (F.col("r") - F.col("low")) / (F.col("high") - F.col("low") + SLACK)).cast("int")
        ringed = placed.join(F.broadcast(cells), "cell").withColumn("ring", ring).drop("low", "high", "rings")
        sizes = ringed.groupBy("cell", "ring").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("parts"))
        part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        self.rows = materialise(ringed.join(F.broadcast(sizes), ["cell", "ring"]).withColumn("part", part).drop("parts"))
        blocks = self.rows.groupBy("cell", "ring", "part").agg(F.min("r").alias("inner"), F.max("r").alias("outer"))
        self.blocks = materialise(blocks)
        rings = self.blocks.groupBy("cell", "ring").agg(F.min("inner").alias("inner"), F.max("outer").alias("outer"), F.collect_set("part").alias("parts"))
        rings = rings.withColumn("parts", F.sort_array(F.slice("parts", 1, SEEDS)))
        #: at most PIVOTS rows of at most RINGS + 1 rings
        self.cells = rings.groupBy(F.col("cell").alias("own")).agg(F.collect_list(F.struct("ring", "inner", "outer", "parts")).alias("rings"))

    def _placed(self, vectors: DataFrame) -> DataFrame:
        """The nearest pivot of each vector, and the distance to it."""
        pivots = self.pivots

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    d = _distances(_matrix(batch["v"]), pivots)
                    cell = d.argmin(axis=1)
                    yield batch.assign(cell=cell.astype(np.int32), r=d[np.arange(len(d)), cell])

        kind = vectors.schema["id"].dataType.simpleString()
        return vectors.mapInPandas(run, f"id {kind}, v array<double>, cell int, r double")

    def _cells(self, queries: DataFrame) -> DataFrame:
        """Each query with every cell it cannot rule out by the cell's pivot alone; ``own`` marks the nearest."""
        pivots = self.pivots

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    d = _distances(_matrix(batch["v"]), pivots)
                    least = d.min(axis=1)
                    q, cell = np.nonzero((d - least[:, None]) / 2 <= batch["bound"].to_numpy()[:, None] + SLACK)
                    yield pd.DataFrame({"id": batch["id"].to_numpy()[q], "bound": batch["bound"].to_numpy()[q], "cell": cell.astype(np.int32), "d": d[q, cell]})

        kind = queries.schema["id"].dataType.simpleString()
        return queries.mapInPandas(run, f"id {kind}, bound double, cell int, d double")

    def _compared(self, visits: DataFrame, k: int) -> DataFrame:
        """The k best ``(id, near, cosine)`` of each visit ``(id, v, cell, ring, part)``, block by block."""
        at = ["cell", "ring", "part"]
        shares = visits.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / F.lit(self.block)).cast("int").alias("shares"))
        shares = materialise(shares)
        asked = visits.join(shares, at).withColumn("share", F.pmod(F.xxhash64("id", F.lit(1)), F.col("shares")).cast("int"))
        stored = self.rows.join(shares, at).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))

        def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            names = ["id", "near", "cosine"]
            if not len(left) or not len(right):
                return pd.DataFrame({n: [] for n in names})
            right = right.sort_values("id", kind="stable")
            ids, stored_v = right["id"].to_numpy(), _matrix(right["v"])
            out = []
            for low in range(0, len(left), 512):
                some = left.iloc[low : low + 512]
                cosine = np.round(_matrix(some["v"]) @ stored_v.T, DIGITS)
                # stable sort: equal cosines stay in the order of ids
                order = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
                rows = np.repeat(np.arange(len(some)), order.shape[1])
                out.append(pd.DataFrame({"id": some["id"].to_numpy()[rows], "near": ids[order.ravel()], "cosine": cosine[rows, order.ravel()]}))
            return pd.concat(out)

        keys = [*at, "share"]
        kind, own = visits.schema["id"].dataType.simpleString(), self.rows.schema["id"].dataType.simpleString()
        pairs = asked.select("id", "v", *keys).groupBy(*keys).cogroup(stored.select("id", "v", *keys).groupBy(*keys))
        return pairs.applyInPandas(best, f"id {kind}, near {own}, cosine double")

    def nearest(self, queries: DataFrame, k: int) -> DataFrame:
        """``(id, near, cosine, rank)``: the k most similar stored vectors of each query ``(id, v)``."""
        queries = materialise(queries.where(F.size("v") == self.dimension))
        # where a query would stand itself: a block of the nearest ring of its own cell
        placed = self._placed(queries).withColumnRenamed("cell", "own").join(F.broadcast(self.cells), "own")
        off = lambda g: F.greatest(g["inner"] - F.col("r"), F.col("r") - g["outer"], F.lit(0.0))
        ring = F.array_min(F.transform("rings", lambda g: F.struct(off(g).alias("off"), g["ring"].alias("ring"), g["parts"].alias("parts"))))
        part = F.get("g.parts", F.pmod(F.xxhash64("id"), F.size("g.parts")).cast("int")).alias("part")
        seeds = materialise(placed.withColumn("g", ring).select("id", "v", F.col("own").alias("cell"), "g.ring", part))
        found = materialise(self._compared(seeds, k))
        kth = found.groupBy("id").agg(F.when(F.count(F.lit(1)) >= k, F.min("cosine")).alias("kth"))
        bound = F.sqrt(F.greatest(2 - 2 * F.coalesce("kth", F.lit(-1.0)), F.lit(0.0))).alias("bound")
        bounded = queries.join(kth, "id", "left").select("id", "v", bound)
        visits = self._cells(bounded).join(self.blocks, "cell")
        reach = F.col("bound") + SLACK
        visits = visits.where((F.col("d") - F.col("outer") <= reach) & (F.col("inner") - F.col("d") <= reach))
        visits = visits.select("id", "cell", "ring", "part").join(seeds.select("id", "cell", "ring", "part"), ["id", "cell", "ring", "part"], "left_anti")
        more = self._compared(materialise(visits.join(queries, "id")), k)
        rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "near"))
        return found.union(more).withColumn("rank", rank).where(F.col("rank") <= k).select("id", "near", "cosine", "rank")

"""Source values left in published text: every place of many values in many long texts, inside words or not.

A gram index over the values. A value of n bytes belongs to the tier of the largest power of two up to n (at
most `TOP`); of its grams of that size, the one that fewest values share is its anchor. Texts are scanned
once: running hashes give the gram at every byte of every tier, a bitmap of the anchors' hashes (of
fixed size, built by Spark's bitmap aggregates) lets nearly all places go, and the rest meet the
values in a join on the hash, where the bytes around the place are compared with the value.

Neither side is collected or capped: more values fill the bitmap, which then sieves less, but
every place that could match reaches the join.

Defined results: null and empty values and texts match nothing; repeated values count once; matching
is by bytes, so case counts; overlapping places all count.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from quern.session import materialise

TOP = 16
BITS = 27
PART = 1 << 20
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int, base: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


def gram_hashes(raw: bytes, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes from each place on; it depends on the bytes alone."""
    n = len(raw) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    x = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(x * _powers(len(raw), _BASE), out=total[1:])
    h = (total[size:] - total[:n]) * _powers(n, pow(_BASE, -1, 1 << 64)) + np.uint64(size)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


def _raws(column: pa.Array) -> Iterator[bytes]:
    for value in column:
        yield value.as_buffer().to_pybytes() if value.is_valid else b""


def anchors(values: DataFrame, column: str) -> DataFrame:
    """``(value, size, gram, lead)``: each distinct value with its anchor gram's hash and the bytes before it."""
    schema = StructType([StructField("value", BinaryType()), StructField("size", IntegerType()), StructField("gram", LongType()), StructField("lead", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for raw in _raws(batch.column(0)):
                size = min(TOP, 1 << (len(raw).bit_length() - 1))
                found = gram_hashes(raw, size).tolist()
                for part, new in zip(out, ([raw] * len(found), [size] * len(found), found, range(len(found)))):
                    part.extend(new)
            kinds = (pa.binary(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], names=schema.names)

    kept = values.select(F.col(column).cast("string").alias("value")).where("value <> ''").distinct()
    grams = materialise(kept.mapInArrow(run, schema))
    shared = grams.groupBy("size", "gram").agg(F.count_distinct("value").alias("n"))
    best = F.min(F.struct("n", "lead", "size", "gram")).alias("b")
    return grams.join(shared, ["size", "gram"]).groupBy("value").agg(best).select("value", "b.size", "b.gram", "b.lead")


def _sieve(index: DataFrame) -> np.ndarray:
    """Bits set at the hashes of all anchors: ``2 ** BITS`` of them, whatever the number of values."""
    place = F.pmod(F.col("gram"), F.lit(1 << BITS)) + 1  # Spark's buckets start at 1
    buckets = index.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m"))
    bits = np.zeros((1 << BITS) // 8, np.uint8)
    for row in buckets.collect():
        low = (row.b - 1) * len(row.m)
        bits[low : low + len(row.m)] = np.frombuffer(bytes(row.m), np.uint8)
    return bits


def _fits(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    place = hashes & np.int64((1 << BITS) - 1)
    return np.flatnonzero((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1)


def raw_values(published: DataFrame, keys: Sequence[str], text: str, values: DataFrame, column: str) -> DataFrame:
    """``(keys, value, start)``: every place (in bytes, from 0) of every value in ``text``."""
    spark = published.sparkSession
    index = materialise(anchors(values, column))
    tiers = [tuple(r) for r in index.groupBy("size").agg(F.max(F.octet_length("value"))).collect()]
    bits = spark.sparkContext.broadcast(_sieve(index))
    rows = published.select(*keys, F.col(text).cast("string").alias("_text")).where("_text <> ''")
    fields = [*rows.drop("_text").schema.fields, StructField("gram", LongType()), StructField("size", IntegerType()), StructField("at", LongType()),
              StructField("before", IntegerType()), StructField("around", BinaryType())]
    schema = StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, raw in enumerate(_raws(batch.column("_text"))):
                for size, longest, low in ((*tier, low) for tier in tiers for low in range(0, len(raw), PART)):
                    hashes = gram_hashes(raw[low : low + PART + size - 1], size)
                    fits = _fits(hashes, bits.value)
                    hashes, at = hashes[fits], fits + low
                    if len(at):
                        before = np.minimum(at, longest - size)
                        around = [raw[a - b : a + longest] for a, b in zip(at.tolist(), before.tolist())]
                        own = [batch.column(k).take(pa.array(np.full(len(at), row))) for k in keys]
                        yield pa.RecordBatch.from_arrays(
                            [*own, pa.array(hashes), pa.array(np.full(len(at), size, np.int32)), pa.array(at.astype(np.int64)),
                             pa.array(before.astype(np.int32)), pa.array(around, pa.binary())], names=schema.names)

    near = rows.mapInArrow(run, schema).join(index, ["size", "gram"])
    first = F.col("before") - F.col("lead")
    same = (first >= 0) & (F.expr("substring(around, before - lead + 1, octet_length(value))") == F.col("value"))
    return near.where(same).select(*keys, F.col("value").cast("string").alias("value"), (F.col("at") - F.col("lead")).alias("start"))

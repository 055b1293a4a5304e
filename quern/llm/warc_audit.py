"""WARC fixity audit with Merkle trees. DataFrame functions only.

A record is (seq, payload). Records stand in files of ``FILE`` sequence numbers,
in order; a record's offset range comes from the lengths before it in its file.
Each file has a tree over its sequence numbers with ``FANOUT`` children a node:
a leaf digests one record, a node digests its children in order. Two replicas
are compared at the roots; only children of nodes that differ are looked at,
level by level, down to the damaged records and their offset ranges.

Positions in a tree come from sequence numbers, so a missing record changes one
path and shifts nothing else.

Defined results: a null payload is an empty one; a null sequence number counts
as -1, in a file of its own; rows that repeat a sequence number form one leaf,
by a digest that does not depend on their order; an empty replica makes every
record of the other missing or extra; two empty ones give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.session import materialise

FANOUT = 16
LEVELS = 4
FILE = FANOUT**LEVELS
BLOCK = 1024


def leaves(records: DataFrame) -> DataFrame:
    """``(file, idx, digest, low, high)``: a leaf per sequence number with its offset range."""
    payload = F.coalesce("payload", F.lit("")).cast("binary")
    seq = F.coalesce(F.col("seq").cast("long"), F.lit(-1))
    rows = records.select(seq.alias("seq"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("bytes"))
    same = rows.groupBy("seq", "digest").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    words = [F.bit_xor(F.xxhash64("digest", "n", F.lit(k))).alias(f"w{k}") for k in range(4)]
    leaf = same.groupBy("seq").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.min("digest").alias("first"), *words)
    mixed = F.sha2(F.concat_ws(":", "n", *[f"w{k}" for k in range(4)]), 256)
    leaf = leaf.select(F.floor(F.col("seq") / FILE).alias("file"), F.pmod("seq", F.lit(FILE)).alias("idx"),
                       F.when(F.col("n") == 1, F.col("first")).otherwise(mixed).alias("digest"), "bytes")
    # offsets in two steps: inside blocks of BLOCK numbers, and over a file's blocks
    leaf = leaf.withColumn("block", F.floor(F.col("idx") / BLOCK))
    inside = Window.partitionBy("file", "block").orderBy("idx")
    leaf = leaf.withColumn("upto", F.sum("bytes").over(inside))
    blocks = leaf.groupBy("file", "block").agg(F.sum("bytes").alias("total"))
    before = F.sum("total").over(Window.partitionBy("file").orderBy("block")) - F.col("total")
    blocks = blocks.select("file", "block", before.alias("before"))
    high = F.col("before") + F.col("upto")
    return leaf.join(blocks, ["file", "block"]).select("file", "idx", "digest", (high - F.col("bytes")).alias("low"), high.alias("high"))


def tree(leaf: DataFrame) -> list[DataFrame]:
    """Levels ``(file, idx, digest, low, high)`` from the leaves to the roots."""
    levels = [materialise(leaf)]
    for _ in range(LEVELS):
        below = levels[-1]
        children = F.sort_array(F.collect_list(F.struct("idx", "digest")))  # at most FANOUT
        node = below.groupBy("file", F.floor(F.col("idx") / FANOUT).alias("up")).agg(
            children.alias("children"), F.min("low").alias("low"), F.max("high").alias("high"))
        digest = F.sha2(F.array_join(F.transform("children", lambda c: F.concat_ws("=", c["idx"], c["digest"])), ","), 256)
        levels.append(materialise(node.select("file", F.col("up").alias("idx"), digest.alias("digest"), "low", "high")))
    return levels


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(seq, low, high, verdict)`` of damaged records; offsets are the left replica's where it has the record.

    ``verdict``: altered, missing (not in the right replica) or extra.
    """
    ours, theirs = tree(leaves(left)), tree(leaves(right))
    damaged = None
    for a, b in zip(reversed(ours), reversed(theirs)):
        if damaged is not None:
            below = damaged.select("file", F.col("idx").alias("up"))
            up = F.floor(F.col("idx") / FANOUT)
            a = a.withColumn("up", up).join(below, ["file", "up"], "left_semi").drop("up")
            b = b.withColumn("up", up).join(below, ["file", "up"], "left_semi").drop("up")
        other = b.select("file", "idx", F.col("digest").alias("digest2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
        both = a.join(other, ["file", "idx"], "full")
        damaged = both.where(~F.col("digest").eqNullSafe(F.col("digest2")))
    verdict = F.when(F.col("digest2").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("altered")
    seq = F.col("file") * FILE + F.col("idx")
    return damaged.select(seq.alias("seq"), F.coalesce("low", "low2").alias("low"), F.coalesce("high", "high2").alias("high"), verdict.alias("verdict"))


def warc_record(url: str = "url", body: str = "html"):
    """A response record as text, as an expression over a page's columns."""
    text = F.coalesce(body, F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
                    F.lit("\r\nContent-Length: "), F.octet_length(text).cast("string"), F.lit("\r\n\r\n"), text, F.lit("\r\n\r\n"))


def pages_audit(pages: DataFrame) -> DataFrame:
    """Audit of the pages' records against a replica with known damage.

    In the replica every 97th page has a byte changed, the one after it is lost
    and the next one was written twice.
    """
    records = pages.select(F.col("page_id").alias("seq"), warc_record().alias("payload"))
    turn = F.pmod("seq", F.lit(97))
    altered = F.when(turn == 0, F.concat(F.lit("w"), F.substring("payload", 2, 2**31 - 1))).otherwise(F.col("payload"))
    replica = records.where(turn != 1).select("seq", altered.alias("payload"))
    replica = replica.union(records.where(turn == 2))
    return audit(records, replica).select(F.col("seq").alias("page_id"), F.col("low").alias("start_offset"), F.col("high").alias("end_offset"), "verdict")

"""Run logs and chat histories: pairing, retries, sessions, budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.functions.draws import rows
from quern.operators.ordered import Chunks, neighbour, running, time_chunks

TERMINAL_ATTEMPT = 4  # fixed value: attempts before a stage pauses


def sessions(df: DataFrame, keys: Sequence[str], order: Sequence[str], gap: int, chunks: Chunks = None) -> DataFrame:
    """Add ``session``: 1-based number of the run of rows with gaps up to ``gap``."""
    t = order[0]
    chunks = time_chunks(df, t) if chunks is None else chunks
    near = neighbour(df, keys, order, [t], chunks)
    starts = F.when(F.col(f"prev_{t}").isNull() | (F.col(t) - F.col(f"prev_{t}") > gap), 1).otherwise(0)
    return running(near, keys, order, {"session": ("sum", starts)}, chunks).drop(f"prev_{t}")


def retry_chains(df: DataFrame, keys: Sequence[str], order: Sequence[str], failed: Column, chunks: Chunks = None) -> DataFrame:
    """Add ``attempt`` (place in an unbroken chain of failures) and ``paused``.

    The chain length is the running failure count minus that count at the last
    success, so a long chain is never one group.
    """
    chunks = time_chunks(df, order[0]) if chunks is None else chunks
    counted = running(df.withColumn("_bad", failed.cast("int")), keys, order, {"_f": ("sum", F.col("_bad"))}, chunks)
    at_ok = F.when(F.col("_bad") == 0, F.col("_f"))
    based = running(counted, keys, order, {"_base": ("max", at_ok)}, chunks)
    attempt = F.col("_f") - F.coalesce("_base", F.lit(0))
    return (
        based.where("_bad = 1").withColumn("attempt", attempt)
        .withColumn("paused", F.col("attempt") % TERMINAL_ATTEMPT == 0).drop("_bad", "_f", "_base")
    )


def concurrency(intervals: DataFrame, start: str, end: str, chunks: Chunks = None) -> DataFrame:
    """Busy count after every start or end instant."""
    steps = intervals.select(
        F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("s")
    ).groupBy(F.col("s.t").alias("t")).agg(F.sum("s.d").alias("d"))
    return running(steps, [], ["t"], {"busy": ("sum", F.col("d"))}, chunks).select("t", "busy")


def budgeted_history(chat: DataFrame, conv: str, turn: str, role: str, size: Column, budget: int, head: int = 2, chunks: Chunks = 1024) -> DataFrame:
    """``kept`` per message: the head and the newest exchanges within a budget.

    The first ``head`` messages always stay and count. An exchange starts at a
    user message. Chunks are a number of turns. The newest exchange always stays; older ones stay while the
    running size from the newest back, with the head, is within the budget.
    """
    # The running number of user messages labels the exchanges; only rows after
    # the head are grouped, so user messages inside the head shift labels alike.
    opens = F.when(F.col(role) == "user", 1).otherwise(0)
    marks = {"_pos": ("sum", F.lit(1)), "_grp": ("sum", opens)}
    grouped = running(chat.select(conv, turn, role, size.alias("_size")), [conv], [turn], marks, chunks)
    in_head = F.col("_pos") <= head
    base = grouped.where(in_head).groupBy(conv).agg(F.sum("_size").alias("_base"))
    groups = grouped.where(~in_head).groupBy(conv, "_grp").agg(F.sum("_size").alias("_gs")).withColumn("_back", -F.col("_grp"))
    back = running(groups, [conv], ["_back"], {"_cum": ("sum", F.col("_gs")), "_nth": ("sum", F.lit(1))}, chunks)
    keep = back.join(base, conv, "left").select(
        conv, "_grp", ((F.col("_nth") == 1) | (F.coalesce("_base", F.lit(0)) + F.col("_cum") <= budget)).alias("_keep")
    )
    return grouped.join(keep, [conv, "_grp"], "left").select(
        conv, turn, role, F.col("_size").alias("size"), F.col("_grp").alias("exchange"), in_head.alias("is_head"),
        (in_head | F.coalesce("_keep", F.lit(False))).alias("kept"),
    )


def markov(df: DataFrame, prev: str, nxt: str) -> DataFrame:
    """Transition counts and shares; the window runs over class pairs only."""
    pairs = df.where(F.col(prev).isNotNull()).groupBy(prev, nxt).agg(rows().alias("n"))
    return pairs.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(prev)))

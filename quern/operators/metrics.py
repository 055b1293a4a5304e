"""Grading metrics as aggregate columns and grouped jobs. Nothing is clipped or repaired."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quern.functions.draws import poisson1, rows, uniform
from quern.operators.ordered import Chunks, running, time_chunks
from quern.operators.ranks import running_totals


def truth() -> Column:
    return F.col("y")


def guess() -> Column:
    return F.col("p")



def _smape_term() -> Column:
    size = F.abs(truth()) + F.abs(guess())
    return F.when(size == 0, F.lit(0.0)).otherwise(2.0 * F.abs(truth() - guess()) / size)


def regression_metrics() -> dict[str, Column]:
    """Aggregates over columns ``y`` and ``p``.

    ``smape`` counts 0/0 as 0 and ``log_ratio`` is the mean of |ln((1+p)/(1+y))|;
    both formulas are a choice, only their names are given upstream.
    """
    return {
        "rmse": F.sqrt(F.avg((truth() - guess()) * (truth() - guess()))),
        "mse": F.avg((truth() - guess()) * (truth() - guess())),
        "mae": F.avg(F.abs(truth() - guess())),
        "smape": F.avg(_smape_term()),
        "log_ratio": F.avg(F.abs(F.ln((1.0 + guess()) / (1.0 + truth())))),
        "poisson_deviance": 2.0 * F.avg(F.when(truth() == 0, guess()).otherwise(truth() * F.ln(truth() / guess()) - (truth() - guess()))),
    }


def pinball(q: float, p: Column | None = None) -> Column:
    d = truth() - (guess() if p is None else p)
    return F.avg(F.greatest(F.lit(q) * d, F.lit(q - 1.0) * d))


def asymmetric_cost(under: float, over: float) -> Column:
    d = truth() - guess()
    return F.avg(F.when(d > 0, F.lit(under) * d).otherwise(F.lit(-over) * d))


def log_loss() -> Column:
    """Binary log loss; a probability of 0 or 1 on the wrong side is infinite, not clipped."""
    return -F.avg(F.when(truth() == 1, F.ln(guess())).otherwise(F.ln(1.0 - guess())))


def confusion(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Counts per (groups, label): support, predicted and hits."""
    sides = df.select(
        *groups,
        F.explode(
            F.array(
                F.struct(truth().alias("label"), F.lit(1).alias("s"), F.lit(0).alias("r"), (truth() == guess()).cast("int").alias("h")),
                F.struct(guess().alias("label"), F.lit(0).alias("s"), F.lit(1).alias("r"), F.lit(0).alias("h")),
            )
        ).alias("m"),
    ).select(*groups, "m.*")
    return sides.groupBy(*groups, "label").agg(
        F.sum("s").alias("support"), F.sum("r").alias("predicted"), F.sum("h").alias("hits")
    )


def class_scores(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Accuracy, macro recall and macro F1 over the labels present in the answers."""
    c = confusion(df, groups)
    answered = F.col("support") > 0
    recall = F.when(answered, F.col("hits") / F.col("support"))
    f1 = F.when(answered, 2.0 * F.col("hits") / (F.col("support") + F.col("predicted")))
    return c.groupBy(*groups).agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        F.avg(recall).alias("macro_recall"),
        F.avg(f1).alias("macro_f1"),
    )


def auc(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve with average ranks for ties; null when a class is absent.

    Scores are collapsed to (score, positives, negatives) first, so ties and
    copies do not travel, and running totals go through equal-depth buckets.
    """
    points = df.groupBy(*groups, "p").agg(
        F.sum("y").cast("long").alias("pos"), F.sum(1 - truth()).cast("long").alias("neg")
    )
    line = running_totals(points, df, "p", ["neg", "pos"], groups)
    wins = F.sum((F.col("pos") * (2 * F.col("before_neg") + F.col("neg"))).cast("decimal(38,0)"))
    pairs = F.max("all_pos").cast("double") * F.max("all_neg")
    return line.groupBy(*groups).agg(F.try_divide(wins.cast("double"), 2.0 * pairs).alias("auc"))


def ranking_metrics(df: DataFrame, query: str, k: int) -> DataFrame:
    """Macro NDCG@k, MRR and Recall@k from (query, place, relevance 0/1)."""
    in_k = F.col("place") <= k
    gain = F.when(in_k, F.col("relevance") * math.log(2.0) / F.ln(1.0 + F.col("place"))).otherwise(0.0)
    found = F.min(F.when(F.col("relevance") > 0, F.col("place")))
    per_query = df.groupBy(query).agg(
        F.sum(gain).alias("dcg"),
        F.sum("relevance").cast("int").alias("n_rel"),
        found.alias("first_hit"),
        F.sum(F.when(in_k, F.col("relevance")).otherwise(0)).alias("hits"),
    )
    best = F.aggregate(
        F.sequence(F.lit(1), F.least(F.greatest("n_rel", F.lit(1)), F.lit(k))),
        F.lit(0.0),
        lambda a, i: a + math.log(2.0) / F.ln(1.0 + i),
    )
    return per_query.where("n_rel > 0").agg(
        F.avg(F.col("dcg") / best).alias("ndcg"),
        F.avg(1.0 / F.col("first_hit")).alias("mrr"),
        F.avg(F.col("hits") / F.col("n_rel")).alias("recall"),
        rows().alias("queries"),
    )


def concordance(df: DataFrame, levels: int, chunks: Chunks = None) -> DataFrame:
    """Concordance index with right censoring, exact, without forming pairs.

    Input: integer ``time``, ``event`` (1 = observed) and ``risk`` as an integer
    in [0, 2**levels); a risk outside that range stops the job. A pair counts when the earlier time is an event; higher
    risk should go first. Two risks differ first at one bit, so at every bit
    level rows are grouped by the higher bits; running counts over time inside
    the group give how many later rows carry a 0 or a 1 there. Rows are counted
    per (time, risk) first and the running counts go through time chunks.
    """
    back = df.select((-F.col("time")).alias("_t"))
    chunks = time_chunks(back, "_t") if chunks is None else chunks
    inside = F.col("risk").between(0, 2**levels - 1)
    outside = F.raise_error(F.concat(F.lit(f"risk outside [0, 2**{levels}): "), F.col("risk").cast("string")))
    df = df.withColumn("risk", F.when(inside | F.col("risk").isNull(), F.col("risk")).otherwise(outside.cast("long")))
    cells = df.groupBy("time", "risk").agg(
        F.sum("event").cast("long").alias("ev"), rows().alias("n")
    )
    spread = cells.select(
        "time", "ev", "n",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(levels)),
                lambda b: F.struct(
                    b.alias("bit"),
                    F.call_function("shiftright", F.col("risk"), b).alias("top"),
                ),
            )
        ).alias("x"),
    ).select("time", "ev", "n", F.col("x.bit").alias("bit"), F.col("x.top").alias("top"))
    # at level b rows meet when their bits above b agree; "one" is bit b itself
    level = spread.where(F.col("bit") < levels).select(
        "bit", F.call_function("shiftright", "top", F.lit(1)).alias("grp"),
        (F.col("top") % 2).alias("one"), "time", "ev", "n",
    )
    per_time = level.groupBy("bit", "grp", "time").agg(
        F.sum(F.when(F.col("one") == 1, F.col("ev")).otherwise(0)).alias("ev1"),
        F.sum(F.when(F.col("one") == 0, F.col("ev")).otherwise(0)).alias("ev0"),
        F.sum(F.when(F.col("one") == 1, F.col("n")).otherwise(0)).alias("n1"),
        F.sum(F.when(F.col("one") == 0, F.col("n")).otherwise(0)).alias("n0"),
    )
    later = running(
        per_time.withColumn("_t", -F.col("time")), ["bit", "grp"], ["_t"],
        {"later0": ("sum", F.col("n0")), "later1": ("sum", F.col("n1"))}, chunks, inclusive=False,
    )
    wide = "decimal(38,0)"
    by_bit = later.agg(
        F.sum((F.col("ev1") * F.col("later0")).cast(wide)).alias("good"),
        F.sum((F.col("ev0") * F.col("later1")).cast(wide)).alias("bad"),
    )
    same = running(
        cells.withColumn("_t", -F.col("time")), ["risk"], ["_t"],
        {"later": ("sum", F.col("n"))}, chunks, inclusive=False,
    ).agg(F.sum((F.col("ev") * F.col("later")).cast(wide)).alias("tied"))
    # One struct, so the level counts run once.
    ordered = by_bit.select(F.struct("good", "bad")).scalar()
    out = same.select(ordered["good"].alias("good"), ordered["bad"].alias("bad"), "tied")
    total = F.col("good") + F.col("bad") + F.col("tied")
    return out.select(
        F.col("good").cast("long").alias("concordant"),
        F.col("bad").cast("long").alias("discordant"),
        F.col("tied").cast("long").alias("tied_risk"),
        F.try_divide((F.col("good") + F.col("tied") * 0.5).cast("double"), total.cast("double")).alias("c_index"),
    )


def bootstrap(
    df: DataFrame, cluster: str, parts: dict[str, Column], statistic: Column, reps: int, seed: int
) -> DataFrame:
    """Cluster bootstrap: one row per replicate with ``statistic`` of the weighted sums.

    Rows are summed per independence unit first; a unit's Poisson(1) weight in a
    replicate is a hash of (seed, replicate, unit), so replicates are repeatable
    and the shuffle carries one row per replicate and task.
    """
    units = df.groupBy(cluster).agg(*[c.alias(n) for n, c in parts.items()])
    reps_rows = units.select("*", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    weighted = reps_rows.withColumn("_w", poisson1(uniform(seed, "boot", "rep", cluster)))
    return (
        weighted.groupBy("rep").agg(*[F.sum(F.col(n) * F.col("_w")).alias(n) for n in parts])
        .select("rep", statistic.alias("value"))
    )


def tier_of(score: Column, thresholds: Sequence[tuple[str, float | Column]], lower: Column) -> Column:
    """Best tier cleared; ``thresholds`` run from the easiest to the hardest tier."""
    out = F.lit("none")
    for name, bound in thresholds:
        edge = bound if isinstance(bound, Column) else F.lit(bound)
        out = F.when(F.when(lower, score <= edge).otherwise(score >= edge), F.lit(name)).otherwise(out)
    return out


def better(a: Column, b: Column, lower: Column, strict: bool) -> Column:
    """Direction-aware comparison on raw doubles, without rounding or tolerance."""
    if strict:
        return F.when(lower, a < b).otherwise(a > b)
    return F.when(lower, a <= b).otherwise(a >= b)

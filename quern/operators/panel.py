"""Score-panel analytics: best runs, gaps, verdicts, wide and list cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quern.functions.draws import count_where

RUNS = [1, 2, 3, 4, 5]  # fixed value: runs per cell


def finite(score: Column) -> Column:
    return score.isNotNull() & ~F.isnan(score) & (F.abs(score) != F.lit(float("inf")))


def best_score(score: Column, lower: bool) -> Column:
    """Best finite score; 0.0 is a score, null and NaN are not."""
    value = F.when(finite(score), score)
    return F.min(value) if lower else F.max(value)


def best_attempt(score: Column, attempt: Column, lower: bool) -> Column:
    """First attempt that reaches the best finite score."""
    ok = finite(score)
    if lower:
        return F.min(F.when(ok, F.struct(score.alias("score"), attempt.alias("attempt"))))["attempt"]
    flipped = F.struct((-score).alias("score"), attempt.alias("attempt"))
    return F.min(F.when(ok, flipped))["attempt"]


def cell_best(panel: DataFrame, cell: Sequence[str], lower: bool) -> DataFrame:
    return panel.groupBy(*cell).agg(
        best_score(F.col("score"), lower).alias("best"),
        count_where(finite(F.col("score"))).alias("scored"),
        F.concat(count_where(finite(F.col("score"))).cast("string"), F.lit(f"/{len(RUNS)}")).alias("scored_text"),
    )


def profile_gap(panel: DataFrame, weak: str, strong: str, lower: bool) -> DataFrame:
    """Strong minus weak best per era, sign-adjusted, and whether the gap widened."""
    sign = F.lit(-1.0 if lower else 1.0)

    def best(variant, profile):
        hit = (F.col("variant") == variant) & (F.col("profile") == profile)
        return best_score(F.when(hit, F.col("score")), lower)

    gaps = panel.groupBy("task").agg(
        (sign * (best("before", strong) - best("before", weak))).alias("gap_before"),
        (sign * (best("after", strong) - best("after", weak))).alias("gap_after"),
    )
    return gaps.withColumn("widened", F.col("gap_after") > F.col("gap_before"))


def wide_runs(panel: DataFrame, cell: Sequence[str], shown: Column) -> DataFrame:
    """run1..run5 columns; one value per run by construction, so max picks it. Another run stops the job."""
    outside = F.raise_error(F.concat(F.lit(f"run outside {RUNS}: "), F.col("run").cast("string")))
    known = F.col("run").isin(RUNS) | F.col("run").isNull()
    panel = panel.withColumn("run", F.when(known, F.col("run")).otherwise(outside.cast("int")))
    return panel.groupBy(*cell).agg(
        *[F.max(F.when(F.col("run") == r, shown)).alias(f"run{r}") for r in RUNS]
    )


def score_cell(panel: DataFrame, cell: Sequence[str], archive: Column | None = None) -> DataFrame:
    """'a ; b ; c' in run order; failed runs are left out; an empty cell takes the archive."""
    text = F.when(finite(F.col("score")), F.format_string("%.5f", F.col("score")))
    wide = wide_runs(panel, cell, text)
    joined = F.concat_ws(" ; ", *[f"run{r}" for r in RUNS])
    filled = joined if archive is None else F.coalesce(F.nullif(joined, F.lit("")), archive, F.lit(""))
    return wide.select(*cell, filled.alias("scores"))


def archived_scores(cell: Column) -> Column:
    """Scores after 'runs:' up to '|', split on ';', trimmed, blanks dropped; null when absent."""
    body = F.regexp_extract(cell, r"runs:([^|]*?)(?:runs:|\||$)", 1)
    parts = F.transform(F.split(body, ";"), lambda p: F.regexp_replace(p, r"^(?U)\s+|\s+$", ""))
    return F.when(F.contains(cell, F.lit("runs:")), F.filter(parts, lambda p: p != ""))


def spread_objective(weak, strong, gold, collapse, weights=(1.0, 1.0, 1.0, 1.0), near: float = 0.10) -> Column:
    """w1(strong-weak) + w2(gold-weak) - w3 max(0, strong-gold-near|gold|) - w4 collapse."""
    w1, w2, w3, w4 = map(F.lit, weights)
    over = F.greatest(F.lit(0.0), strong - gold - F.lit(near) * F.abs(gold))
    return w1 * (strong - weak) + w2 * (gold - weak) - w3 * over - w4 * collapse


def calibration_verdict(
    weak, strong, gold, weak_clears, floor, ceiling, near: float = 0.10, limit: int = 2
) -> Column:
    """First rule that applies, higher scores better."""
    return (
        F.when(weak > gold, "weak_beats_gold")
        .when(weak_clears >= limit, "weak_clears_band")
        .when((weak >= ceiling) & (strong >= ceiling), "not_hardened")
        .when((weak <= floor) & (strong <= floor), "too_destructive")
        .when(strong > gold + F.lit(near) * F.abs(gold), "gold_outdated")
        .when(F.abs(strong - gold) <= F.lit(near) * F.abs(gold), "accept")
        .otherwise("strong_below_gold")
    )


def difficulty_band(minutes: Column) -> Column:
    """0..5 from active minutes, one band per hour; above 300 stays 5."""
    return (
        F.when(minutes < 1, 0).when(minutes <= 60, 1).when(minutes <= 120, 2)
        .when(minutes <= 180, 3).when(minutes <= 240, 4).otherwise(5)
    )


def hours_minutes(minutes: Column) -> Column:
    hours, rest = F.floor(minutes / 60), minutes % 60
    tail = F.concat(rest.cast("string"), F.lit("mins"))
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit("hrs "), tail)).otherwise(tail)

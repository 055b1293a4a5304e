"""Submission rules and grading of many submissions in one grouped job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quern.functions.draws import count_where, rows


VALUE_RULES = ["missing_value", "not_a_number", "not_finite", "out_of_domain"]


def _placed(rule: Column) -> Column:
    """A broken rule with its place in the order in which rules are checked; null stays null."""
    place = F.array_position(F.array(*map(F.lit, VALUE_RULES)), rule)
    return F.when(rule.isNotNull(), F.struct(place.alias("place"), rule.alias("rule")))


def parsed_number(text: Column) -> Column:
    return text.try_cast("double")


def value_error(text: Column, low: float | None = None) -> Column:
    """First broken value rule of a prediction cell, or null."""
    v = parsed_number(text)
    out = (
        F.when(text.isNull() | text.rlike(r"^(?U)\s*$"), "missing_value")
        .when(v.isNull(), "not_a_number")
        .when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), "not_finite")
    )
    return out if low is None else out.when(v < F.lit(low), "out_of_domain")


def grade_many(
    submissions: DataFrame, answers: DataFrame, groups: Sequence[str], key: str, low: float | None = None
) -> DataFrame:
    """One row per submission: key and value problems, and RMSE when there are none.

    ``submissions`` has (groups, key, p as text); ``answers`` has unique (key, y).
    Keys are counted per submission, so the answers are never copied per
    submission; a missing key shows as fewer matched keys than answers. An answer
    whose y is null matches its key and takes no part in the score. ``value_rule``
    is the earliest rule of `value_error` that any row breaks.
    """
    v = parsed_number(F.col("p"))
    per_key = submissions.withColumn("_e", value_error(F.col("p"), low)).groupBy(*groups, key).agg(
        rows().alias("_n"),
        F.min(_placed(F.col("_e"))).alias("_err"),
        F.max(v).alias("_p"),
    )
    joined = per_key.join(answers.select(key, F.col("y").alias("_y"), F.lit(True).alias("_known")), key, "left")
    wanted = answers.agg(rows()).scalar()
    fine = F.col("_err").isNull() & F.col("_y").isNotNull()
    per_set = joined.groupBy(*groups).agg(
        count_where(F.col("_known").isNotNull()).alias("matched"),
        count_where(F.col("_known").isNull()).alias("extra"),
        count_where("_n > 1").alias("duplicated"),
        count_where(F.col("_err").isNotNull()).alias("bad_values"),
        F.min("_err")["rule"].alias("value_rule"),
        F.sqrt(F.avg(F.when(fine, (F.col("_y") - F.col("_p")) * (F.col("_y") - F.col("_p"))))).alias("_rmse"),
    )
    verdict = (
        F.when(F.col("extra") > 0, "extra_key")
        .when(F.col("duplicated") > 0, "duplicate_key")
        .when(F.col("matched") < wanted, "missing_key")
        .otherwise(F.col("value_rule"))
    )
    return per_set.select(
        *groups, "matched", "extra", "duplicated", "bad_values",
        F.coalesce(verdict, F.lit("accepted")).alias("verdict"),
        F.when(verdict.isNull(), F.col("_rmse")).alias("score"),
    )


def sample_report(lines: DataFrame, line: str, fields: int, key_at: Sequence[int]) -> DataFrame:
    """Structure of CSV rows: malformed, blank keys, repeated keys.

    Cells are read by Spark's CSV parser, so a quoted comma stays in its cell. A
    malformed row is not looked at further; a blank key is not a repeat.
    """
    schema = ", ".join([*(f"c{i} string" for i in range(fields)), "corrupt string"])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt", "escape": '"'}
    bad = F.col("_c").isNull() | F.col("_c.corrupt").isNotNull()
    key = F.array(*[F.coalesce(F.col(f"_c.c{i}"), F.lit("")) for i in key_at])
    marked = lines.select(F.from_csv(line, schema, options).alias("_c")).select(bad.alias("bad"), F.when(~bad, key).alias("k"))
    blank = ~F.col("bad") & F.exists("k", lambda k: k.rlike(r"^(?U)\s*$"))
    state = marked.select(F.when(F.col("bad"), "bad").when(blank, "blank").alias("s"), "k")
    per_key = state.groupBy("s", F.when(F.col("s").isNull(), F.col("k")).alias("k")).agg(rows().alias("n"))
    return per_key.agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("s") == "bad", F.col("n"))), F.lit(0)).alias("malformed_rows"),
        F.coalesce(F.sum(F.when(F.col("s") == "blank", F.col("n"))), F.lit(0)).alias("blank_keys"),
        count_where(F.col("s").isNull() & (F.col("n") > 1)).alias("duplicate_keys"),
    )


def simplex_errors(vector: Column, tol: float = 1e-9) -> Column:
    """Rules broken by a probability vector, in a fixed order."""
    total = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x)
    return F.filter(
        F.array(
            F.when(F.exists(vector, lambda x: x < 0), "negative"),
            F.when(F.exists(vector, lambda x: F.isnan(x)), "not_finite"),
            F.when(F.abs(total - 1.0) > tol, "sum_not_one"),
        ),
        lambda e: e.isNotNull(),
    )

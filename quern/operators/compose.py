"""Combining sources: merges, extracts, overlap gates, substitution, diffs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.functions.draws import count_where, draw_digest, uniform
from quern.operators.ordered import Chunks, as_of, running, time_chunks
from quern.operators.ranks import hashed_rank


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    unknown = sorted(set(names) - set(df.columns))
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")


def pick(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Column subset; an unknown name is an error."""
    require_columns(df, names)
    return df.select(*names)


def merge_sources(
    left: DataFrame, right: DataFrame, key: str, keep: Sequence[str], optional: Sequence[str] = ()
) -> DataFrame:
    """Inner merge on the entity key; optional columns come along when the source has them."""
    require_columns(right, [key, *keep])
    extra = [c for c in optional if c in right.columns]
    return left.join(right.select(key, *keep, *extra), key, "inner")


def halve_features(
    columns: Sequence[str], key: str, hidden: Sequence[str], second_half: Sequence[str]
) -> tuple[list[str], list[str]]:
    """Feature names for the two extracts; ``second_half`` names always go to the second."""
    features = [c for c in columns if c != key and c not in hidden]
    cut = len(features) // 2
    forced = [c for c in second_half if c in columns]
    first = [c for c in features[:cut] if c not in forced]
    second = features[cut:]
    return first, second + [c for c in forced if c not in second]


def cut_extracts(
    df: DataFrame, key: str, target: str, hidden: Sequence[str], second_half: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Two column extracts that share only the key; the target stays with the first."""
    first, second = halve_features(df.columns, key, [target, *hidden], second_half)
    return df.select(key, *first, target), df.select(key, *second)


def positional_concat(left: DataFrame, right: DataFrame, key: str, seeds=(1, 2)) -> DataFrame:
    """Pair rows by position in two independent shuffles, ignoring the key (a wrong join)."""
    sides = []
    for df, seed, tag in ((left, seeds[0], "left"), (right, seeds[1], "right")):
        placed = hashed_rank(
            df.withColumn("_d", draw_digest(seed, "shuffle", key)), "_d", (key,), "pos"
        )
        sides.append(
            placed.drop("_d").withColumnsRenamed({c: f"{tag}_{c}" for c in df.columns})
        )
    return sides[0].join(sides[1], "pos")


def key_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys on either side and in both, with rates both ways, in one shuffle."""
    marks = (
        left.select(key, F.lit(1).alias("_l"), F.lit(0).alias("_r"))
        .unionByName(right.select(key, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
        .groupBy(key)
        .agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    )
    both = F.sum(F.col("_l") * F.col("_r"))
    return marks.agg(
        F.sum("_l").alias("left_keys"),
        F.sum("_r").alias("right_keys"),
        both.alias("shared_keys"),
        F.round(F.try_divide(both, F.sum("_l")), 9).alias("left_rate"),
        F.round(F.try_divide(both, F.sum("_r")), 9).alias("right_rate"),
    )


def shared_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct key values of ``left`` that also occur in ``right``."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_semi")


def match_keys(answers: DataFrame, submission: DataFrame, key: str) -> DataFrame:
    """One row per key with the number of rows on each side."""
    return (
        answers.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_s"))
        .unionByName(submission.select(key, F.lit(0).alias("_a"), F.lit(1).alias("_s")))
        .groupBy(key)
        .agg(F.sum("_a").alias("answer_rows"), F.sum("_s").alias("submission_rows"))
    )


def match_report(answers: DataFrame, submission: DataFrame, key: str) -> DataFrame:
    """Counts of missing, extra and duplicated prediction keys."""
    m = match_keys(answers, submission, key)
    return m.agg(
        F.count(F.lit(1)).alias("keys"),
        count_where("answer_rows > 0 and submission_rows = 0").alias("missing_keys"),
        count_where("answer_rows = 0 and submission_rows > 0").alias("extra_keys"),
        count_where("submission_rows > 1").alias("duplicate_keys"),
        count_where("answer_rows > 1").alias("duplicate_answers"),
        count_where("answer_rows = 1 and submission_rows = 1").alias("matched_keys"),
    )


def substitute(df: DataFrame, mapping: DataFrame, column: str, strict: bool = True) -> DataFrame:
    """Replace ``column`` through a (value, code) mapping; null and blank pass unchanged.

    With ``strict`` a value absent from the mapping fails the job. AQE picks a
    broadcast join when the mapping is measured small, a shuffle join otherwise.
    """
    value = F.col(column).cast("string")
    blank = value.isNull() | value.rlike(r"^(?U)\s*$")
    lookup = F.when(~blank, value)
    joined = df.withColumn("_v", lookup).join(
        mapping.select(F.col("value").alias("_v"), F.col("code").alias("_code")), "_v", "left"
    )
    code = F.when(F.col("_v").isNull(), value).otherwise(F.col("_code"))
    if strict:
        bad = F.col("_v").isNotNull() & F.col("_code").isNull()
        code = F.when(bad, F.raise_error(F.lit(f"unmapped value in {column}"))).otherwise(code)
    return joined.withColumn(column, code).select(*df.columns)


def overlay(base: DataFrame, replacement: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``replacement`` override base rows of the same key."""
    return base.join(replacement, list(keys), "left_anti").unionByName(replacement)


def latest_source(df: DataFrame, keys: Sequence[str], source: str) -> DataFrame:
    """One row per key from the greatest ``source`` value (pre-aggregated, no window)."""
    rest = [c for c in df.columns if c not in {*keys, source}]
    best = df.groupBy(*keys).agg(F.max(F.struct(source, *rest)).alias("_b"))
    return best.select(*keys, f"_b.{source}", *[F.col("_b")[c].alias(c) for c in rest])


def table_diff(
    left: DataFrame, right: DataFrame, keys: Sequence[str], atol: float = 1e-12
) -> DataFrame:
    """Per-column mismatches between two tables with unique keys.

    Numbers compare by absolute tolerance, everything else null-safe and exact.
    Returns one row per value column plus ``<rows>`` for keys on one side only.
    """
    values = [c for c in left.columns if c not in keys]
    require_columns(right, [*keys, *values])
    numeric = {f.name for f in left.schema.fields if f.dataType.typeName() in ("double", "float")}
    a = left.select(*keys, F.struct(*values).alias("_a"))
    b = right.select(*keys, F.struct(*values).alias("_b"))
    j = a.join(b, list(keys), "full_outer")
    one_side = F.col("_a").isNull() | F.col("_b").isNull()

    def differs(c: str) -> Column:
        x, y = F.col("_a")[c], F.col("_b")[c]
        if c in numeric:
            near = F.coalesce(F.abs(x - y) <= F.lit(atol), F.lit(False))
            return ~(near | x.eqNullSafe(y))
        return ~x.eqNullSafe(y)

    counts = j.agg(
        count_where(one_side).alias("<rows>"),
        *[count_where(~one_side & differs(c)).alias(c) for c in values],
    )
    return counts.unpivot([], ["<rows>", *values], "column_name", "mismatches")


def overlap_counts(
    windows: DataFrame,
    others: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    chunks: Chunks = None,
) -> DataFrame:
    """Add ``overlaps``: how many half-open ``others`` windows of the key meet this one.

    Windows meet when a.start < b.end and b.start < a.end, so the count is
    (starts before my end) - (ends up to my start). Two running counts answer
    it; no pair of windows is ever formed. Windows must have start < end.
    """
    keys = list(keys)
    marks = others.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col(start).alias("t"), F.lit(1).alias("s"), F.lit(0).alias("e")),
                F.struct(F.col(end).alias("t"), F.lit(0).alias("s"), F.lit(1).alias("e")),
            )
        ).alias("m"),
    ).groupBy(*keys, F.col("m.t").alias("t")).agg(F.sum("m.s").alias("s"), F.sum("m.e").alias("e"))
    asks = windows.select(
        *keys, F.explode(F.array(F.col(start), F.col(end))).alias("t")
    ).distinct()
    line = (
        marks.withColumn("ask", F.lit(0))
        .unionByName(asks.withColumn("ask", F.lit(1)), allowMissingColumns=True)
        .groupBy(*keys, "t")
        .agg(F.sum("s").alias("s"), F.sum("e").alias("e"), F.max("ask").alias("ask"))
    )
    z = F.lit(0)
    counted = running(
        line,
        keys,
        ["t"],
        {"_s_to": ("sum", F.coalesce("s", z)), "_e_to": ("sum", F.coalesce("e", z))},
        time_chunks(others, start) if chunks is None else chunks,
    ).where("ask = 1")
    s_before = counted.select(
        *keys, F.col("t").alias(end), (F.col("_s_to") - F.coalesce("s", z)).alias("_starts")
    )
    e_upto = counted.select(*keys, F.col("t").alias(start), F.col("_e_to").alias("_ends"))
    return (
        windows.join(s_before, [*keys, end], "left")
        .join(e_upto, [*keys, start], "left")
        .withColumn("overlaps", F.col("_starts") - F.col("_ends"))
        .select(*windows.columns, "overlaps")
    )


def path_prefixes(path: Column) -> Column:
    """All proper and full prefixes of a slash path, as text."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")
    )


def uncovered_paths(payloads: DataFrame, declared: DataFrame, path: str) -> DataFrame:
    """Payload paths that are neither declared nor below a declared path."""
    steps = payloads.select(path, F.explode(path_prefixes(F.col(path))).alias("_p"))
    covered = steps.join(
        declared.select(F.col(path).alias("_p")).distinct(), "_p", "left_semi"
    ).select(path).distinct()
    return payloads.join(covered, path, "left_anti")


def expected_runs(
    tasks: DataFrame, variants: Sequence[str], profiles: Sequence[str], runs: int
) -> DataFrame:
    """Grid task x variant x profile x run; fixed lists are exploded, nothing is joined."""
    return tasks.select(
        "task", F.explode(F.array(*map(F.lit, variants))).alias("variant")
    ).select(
        "*", F.explode(F.array(*map(F.lit, profiles))).alias("profile")
    ).select("*", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"))


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def _shingles(df: DataFrame, text: str, size: int, *keep: str) -> tuple[DataFrame, Column]:
    """Rows with words, and the list of their distinct shingles; short texts give one.

    The word array is a column of its own so that slicing does not split again.
    """
    split = df.select(*keep, text).select(*keep, word_list(F.col(text)).alias("_w")).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - F.lit(size - 1), F.lit(1)))
    joined = F.transform(starts, lambda i: F.array_join(F.slice("_w", i, size), " "))
    return split, F.array_distinct(joined)


def shingle_rows(df: DataFrame, text: str, size: int, *keep: str) -> DataFrame:
    """One row per distinct word shingle of each whole text.

    The list is exploded as it is made: a filter inferred on a column of lists would split again for each shingle.
    """
    split, shingles = _shingles(df, text, size, *keep)
    return split.select(*keep, F.explode(shingles).alias("_s"))


def shingle_coverage(
    df: DataFrame, other: DataFrame, key: str, text: str, size: int = 8
) -> DataFrame:
    """Share of each row's distinct shingles that occur anywhere in ``other``.

    Shingles travel as 64-bit hashes plus a second hash. A semi-join keeps each
    row's shingle once however often the other side has it, so copies never
    multiply, no row pairs are formed and neither side is aggregated first: a
    table of all distinct shingles would not fit a task and spill. Totals are
    counted per row, so only shared shingles travel once more.
    """
    mine = shingle_rows(df, text, size, key).select(
        key, F.xxhash64("_s").alias("_h"), F.hash("_s").alias("_g")
    )
    theirs = shingle_rows(other, text, size).select(F.xxhash64("_s").alias("_h"), F.hash("_s").alias("_g"))
    shared = mine.join(theirs, ["_h", "_g"], "left_semi").select(key, F.lit(0).alias("_n"), F.lit(1).alias("_in"))
    split, shingles = _shingles(df, text, size, key)
    totals = split.select(key, F.size(shingles).alias("_n"), F.lit(0).alias("_in"))
    return totals.unionAll(shared).groupBy(key).agg(F.sum("_n").alias("shingles"), F.sum("_in").alias("shared"))


def nearest_on_line(
    probe: DataFrame, build: DataFrame, x: str, cols: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Exact nearest build row on a scalar axis; equal distance goes to the smaller value.

    Two as-of passes (from below and from above) replace a distance join.
    """
    keys = list(keys)
    cols = list(cols)
    facts = build.select(*keys, x, *cols).withColumn("at", F.col(x))
    below = as_of(probe, facts, keys, x, [*cols, "at"], inclusive=True)
    flip = facts.withColumn(x, -F.col(x))
    above = as_of(
        probe.select(*keys, (-F.col(x)).alias(x)).distinct(), flip, keys, x, [*cols, "at"],
        inclusive=True,
    ).select(*keys, (-F.col(x)).alias(x), *[F.col(f"asof_{c}").alias(f"up_{c}") for c in [*cols, "at"]])
    j = below.join(above, [*keys, x], "left")
    use_up = F.col("asof_at").isNull() | (
        F.col("up_at").isNotNull() & ((F.col("up_at") - F.col(x)) < (F.col(x) - F.col("asof_at")))
    )
    return j.select(
        *probe.columns,
        *[F.when(use_up, F.col(f"up_{c}")).otherwise(F.col(f"asof_{c}")).alias(f"near_{c}") for c in [*cols, "at"]],
    )


def candidate_slate(
    queries: DataFrame, items: DataFrame, query: str, item: str, positive: str, decoys: int, seed: int
) -> DataFrame:
    """Positive plus label-independent decoys per query, deduplicated, in hashed order.

    Items get dense positions once; every query draws ``decoys`` positions and
    finds its items by an equality join, so no query meets all items.
    """
    dense = hashed_rank(
        items.select(item).distinct().withColumn("_d", draw_digest(seed, "item", item)),
        "_d", (item,), "_pos",
    ).select(item, "_pos")
    size = items.select(F.count_distinct(item)).scalar()
    asks = queries.select(query, F.explode(F.sequence(F.lit(1), F.lit(decoys))).alias("_j"))
    drawn = asks.withColumn(
        "_pos", (F.floor(uniform(seed, "decoy", query, "_j") * size) + 1).cast("long")
    )
    slate = (
        drawn.join(dense, "_pos").select(query, item, F.lit(0).alias("_y"))
        .unionByName(queries.select(query, F.col(positive).alias(item), F.lit(1).alias("_y")))
        .groupBy(query, item).agg(F.max("_y").alias("is_positive"))
    )
    place = Window.partitionBy(query).orderBy(draw_digest(seed, "slot", query, item), item)
    return slate.withColumn("slot", F.row_number().over(place))

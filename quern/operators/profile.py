"""Column catalogue: missing-value classes, cardinality, flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType, VariantType

from quern.functions.draws import count_where, rows
from quern.functions.names import name_flags
from quern.session import dealt

# Structural flags and their thresholds.
CONSTANT = "constant_in_sample"
MOSTLY_MISSING = ("at_least_95_percent_missing_in_sample", 0.95)
NEAR_UNIQUE = ("near_unique_in_sample", 100, 0.98)
PAIRED_PREFIXES = [("pre", "post"), ("before", "after"), ("pb", "pa")]

# Cells of the table that one task counts distinct values of.
CELLS = 1 << 21

BLANK = r"^(?U)\s*$"
NESTED = (ArrayType, BinaryType, MapType, StructType, VariantType)


def missing_masks(df: DataFrame, column: str, tokens: Sequence[str]) -> tuple[Column, Column, Column]:
    """Disjoint masks: physical null, blank text, configured token. Blank wins over token."""
    kind = df.schema[column].dataType
    c, no = F.col(f"`{column}`"), F.lit(False)
    null = c.isNull()
    blank = F.coalesce(c.rlike(BLANK), no) if isinstance(kind, StringType) else no
    if not tokens or isinstance(kind, NESTED):
        return null, blank, no
    token = F.coalesce(c.cast("string").isin(list(tokens)), no) & ~blank
    return null, blank, token


def catalogue(
    df: DataFrame,
    tokens: Sequence[str] = (),
    blank_is_missing: bool = False,
    approximate: bool = False,
) -> DataFrame:
    """One row per column from one aggregation over the table.

    ``approximate`` swaps exact distinct counts (one shuffled copy of the row
    per column) for sketches; use it on wide tables. Before exact counts a large
    table is dealt out, so that one task's distinct values stay bounded.
    """
    measures, records = [], []
    if not approximate:
        plain = [f"`{f.name}`" for f in df.schema.fields if not isinstance(f.dataType, NESTED)]
        if plain:
            df = dealt(df, df.count() * len(df.columns), *plain, most=CELLS)
    for i, name in enumerate(df.columns):
        null, blank, token = missing_masks(df, name, tokens)
        missing = null | token | blank if blank_is_missing else null | token
        value = F.when(~missing, F.col(f"`{name}`"))
        if isinstance(df.schema[name].dataType, NESTED):
            value = F.when(~missing, F.to_json(F.struct(f"`{name}`"))) if not isinstance(
                df.schema[name].dataType, BinaryType
            ) else value
        distinct = F.approx_count_distinct(value) if approximate else F.count_distinct(value)
        measures += [
            count_where(~missing).alias(f"v{i}"), count_where(null).alias(f"n{i}"),
            count_where(blank).alias(f"b{i}"), count_where(token).alias(f"t{i}"),
            distinct.alias(f"d{i}"),
        ]
        records.append(
            F.struct(
                F.lit(i).alias("position"), F.lit(name).alias("column_name"),
                F.lit(df.schema[name].dataType.simpleString()).alias("dtype"),
                F.col(f"v{i}").alias("nonmissing"), F.col(f"n{i}").alias("physical_nulls"),
                F.col(f"b{i}").alias("blank_strings"), F.col(f"t{i}").alias("null_tokens"),
                F.col(f"d{i}").alias("distinct_values"),
            )
        )
    one = df.agg(rows().alias("row_count"), *measures)
    cat = one.select("row_count", F.explode(F.array(*records)).alias("r")).select("row_count", "r.*")
    n, v, d = F.col("row_count"), F.col("nonmissing"), F.col("distinct_values")
    ratio = F.when(v > 0, d / v)
    flags = F.concat(
        F.filter(
            F.array(
                F.when((v > 0) & (d <= 1), CONSTANT),
                F.when((n > 0) & ((n - v) / n >= MOSTLY_MISSING[1]), MOSTLY_MISSING[0]),
                F.when((v >= NEAR_UNIQUE[1]) & (ratio >= NEAR_UNIQUE[2]), NEAR_UNIQUE[0]),
            ),
            lambda f: f.isNotNull(),
        ),
        name_flags(F.col("column_name")),
    )
    return cat.select(
        "*", (n - v).alias("missing"), F.when(n > 0, (n - v) / n).alias("missing_fraction"),
        ratio.alias("unique_ratio"), flags.alias("flags"),
    )


def flag_counts(cat: DataFrame) -> DataFrame:
    return cat.select(F.explode("flags").alias("flag")).groupBy("flag").agg(rows().alias("n"))


def paired_prefixes(names: DataFrame, column: str = "column_name") -> DataFrame:
    """Suffixes present under both names of a prefix pair, from one grouping."""
    cut = F.instr(column, ".")
    split = names.where(cut > 0).select(
        F.substring_index(column, ".", 1).alias("prefix"), F.expr(f"substr({column}, instr({column}, '.') + 1)").alias("suffix")
    )
    pair = F.coalesce(*[F.when(F.col("prefix").isin(a, b), f"{a}/{b}") for a, b in PAIRED_PREFIXES])
    both = split.withColumn("pair", pair).where("pair is not null").groupBy("pair", "suffix").agg(
        F.count_distinct("prefix").alias("sides")
    )
    return both.where("sides = 2").groupBy("pair").agg(rows().alias("paired_suffix_count"))


def report_json(cat: DataFrame, source: str) -> DataFrame:
    """The catalogue as one JSON document without any cell value.

    The catalogue has one row per column, so gathering it is bounded by width.
    """
    record = F.struct("position", "column_name", "dtype", "nonmissing", "missing", "missing_fraction",
                      "physical_nulls", "blank_strings", "null_tokens", "distinct_values", "unique_ratio", "flags")
    return cat.agg(
        F.to_json(
            F.struct(
                F.lit(source).alias("source"), F.max("row_count").alias("exact_row_count"),
                rows().alias("column_count"), F.array_sort(F.collect_list(record)).alias("columns"),
            )
        ).alias("report")
    )


def positional_sample(df: DataFrame, sample_rows: int) -> DataFrame:
    """Head, middle and tail thirds by physical position; everything when it fits.

    Position is the file's offset plus the row index inside the file. Row counts
    per file need no column data, and only the files that hold a wanted position
    are read: at most one per sampled row.
    """
    if sample_rows <= 0:
        raise ValueError("sample_rows must be positive")
    placed = df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_i"))
    files = placed.groupBy("_f").agg(rows().alias("_n"))
    before = Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select(
        "_f", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"),
        F.sum("_n").over(Window.partitionBy()).alias("_all"),
    )
    third = max(1, sample_rows // 3)
    n = F.col("_all")
    middle, tail = F.greatest(F.lit(0), F.floor(n / 2) - third // 2), F.greatest(F.lit(0), n - third)
    spans = [(F.lit(0), F.lit(third)), (middle, middle + third), (tail, n)]
    fits = n <= sample_rows
    touched = fits
    for start, stop in spans:
        touched = touched | ((F.col("_o") < stop) & (F.col("_o") + F.col("_n") > start))
    wanted = offsets.where(touched).drop("_n").collect()
    at = F.col("_i") + F.col("_o")
    parts = sum((((at >= a) & (at < b)).cast("int") for a, b in spans), F.lit(0))
    copies = F.when(fits, 1).otherwise(parts)
    listed = df.sparkSession.createDataFrame([tuple(r) for r in wanted], "_f string, _o long, _all long")
    return (
        placed.where(F.col("_f").isin([r["_f"] for r in wanted])).join(F.broadcast(listed), "_f")
        .withColumn("_c", copies).where("_c > 0")
        .withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("_c"))))
        .withColumn("position", at).drop("_f", "_i", "_o", "_all", "_c")
    )

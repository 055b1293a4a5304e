"""Compact identifiers that hide the order and value of the source ids."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from quern.functions.draws import count_where
from quern.operators.compose import substitute
from quern.operators.profile import BLANK
from quern.operators.ranks import hashed_rank

MIN_WIDTH = 4  # fixed value: least number of digits in a code
PREFIX = re.compile(r"[A-Za-z][A-Za-z0-9_]*")  # fixed value: allowed code prefix
BLANK_POLICIES = ("preserve", "null", "error")


@dataclass(frozen=True)
class IdColumn:
    column: str
    prefix: str

    @classmethod
    def parse(cls, text: str) -> "IdColumn":
        column, colon, prefix = text.partition(":")
        if not colon or not column or "\0" in column or not PREFIX.fullmatch(prefix):
            raise ValueError(f"id column must be COLUMN:PREFIX, got {text!r}")
        return cls(column, prefix)


def check_ids(ids: Sequence[IdColumn], drop: Sequence[str] = ()) -> None:
    for what in ("column", "prefix"):
        values = [getattr(i, what) for i in ids]
        if len(set(values)) != len(values):
            raise ValueError(f"each id {what} may be used once")
    both = sorted({i.column for i in ids} & set(drop))
    if both:
        raise ValueError(f"columns both anonymised and dropped: {both}")


def id_universe(tables: Sequence[DataFrame], column: str) -> DataFrame:
    """Distinct text values of an id over all tables that carry it, with a blank mark."""
    found = [t.select(F.col(column).cast("string").alias("value")) for t in tables if column in t.columns]
    if not found:
        raise ValueError(f"id column absent from every table: {column}")
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)
    return every.where("value is not null").distinct().withColumn("blank", F.col("value").rlike(BLANK))


def code_mapping(
    universe: DataFrame, prefix: str, digest: Callable[[Column], Column]
) -> DataFrame:
    """(value, code): rank of the keyed digest, zero padded to the size of the universe."""
    values = universe.where("not blank").select("value", digest(F.col("value")).alias("_d"))
    ranked = hashed_rank(values, "_d", ("value",), "_rank", total="_all")
    width = F.greatest(F.lit(MIN_WIDTH), F.length(F.col("_all").cast("string")))
    padded = F.lpad(F.col("_rank").cast("string"), width, F.lit("0"))
    return ranked.select("value", F.concat(F.lit(prefix), padded).alias("code"))


def anonymise(
    tables: Sequence[DataFrame],
    ids: Sequence[IdColumn],
    digest: Callable[[str, Column], Column],
    blanks: str = "preserve",
    drop: Sequence[str] = (),
) -> list[DataFrame]:
    """Replace id columns consistently over all tables. Mappings are never written."""
    if blanks not in BLANK_POLICIES:
        raise ValueError(f"blank policy must be one of {BLANK_POLICIES}")
    check_ids(ids, drop)
    out = list(tables)
    for spec in ids:
        # Read once per table: cached for the job, never written.
        mapping = code_mapping(
            id_universe(tables, spec.column), spec.prefix, lambda v, c=spec.column: digest(c, v)
        ).persist()
        for i, table in enumerate(out):
            if spec.column in table.columns:
                ready = blank_policy(table, spec.column, blanks)
                out[i] = substitute(ready, mapping, spec.column)
    return [t.drop(*drop) for t in out]


def blank_policy(df: DataFrame, column: str, policy: str) -> DataFrame:
    """Blank ids: keep as they are, turn to null, or fail the job."""
    text = F.col(column).cast("string")
    if policy == "preserve":
        return df.withColumn(column, text)
    bad = F.coalesce(text.rlike(BLANK), F.lit(False))
    if policy == "null":
        return df.withColumn(column, F.when(~bad, text))
    return df.withColumn(column, F.when(bad, F.raise_error(F.lit(f"blank id in {column}"))).otherwise(text))


def id_counts(tables: Sequence[DataFrame], ids: Sequence[IdColumn]) -> DataFrame:
    """Manifest part: distinct non-blank values per id column, never the values."""
    parts = [
        id_universe(tables, s.column).agg(count_where("not blank").alias("unique_nonblank_values"))
        .select(F.lit(s.column).alias("column"), F.lit(s.prefix).alias("prefix"), "unique_nonblank_values")
        for s in ids
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

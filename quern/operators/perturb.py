"""Seeded perturbations: dropped, noisy, missing, junk and delayed inputs."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quern.functions.draws import laplace, normal, uniform


def _column_draw(seed: int, purpose: str, name: str) -> str:
    return hashlib.sha256(f"{seed}|{purpose}|{name}".encode()).hexdigest()


def seeded_order(columns: Sequence[str], seed: int, purpose: str) -> list[str]:
    return sorted(columns, key=lambda c: (_column_draw(seed, purpose, c), c))


def opaque_names(columns: Sequence[str], keep: Sequence[str], seed: int) -> dict[str, str]:
    """f_001, f_002, ... in a seeded order that hides the source order."""
    rest = [c for c in columns if c not in keep]
    width = max(3, len(str(len(rest))))
    return {c: f"f_{i:0{width}d}" for i, c in enumerate(seeded_order(rest, seed, "opaque"), 1)}


def drop_some(columns: Sequence[str], features: Sequence[str], n: int, seed: int) -> list[str]:
    """Columns left after dropping ``n`` features; the choice depends on names only."""
    gone = set(seeded_order(features, seed, "drop")[:n])
    return [c for c in columns if c not in gone]


def keep_some(columns: Sequence[str], features: Sequence[str], k: int, seed: int) -> list[str]:
    return drop_some(columns, features, len(features) - k, seed)


def add_noise(
    df: DataFrame, column: str, spread: Column, key: Sequence[str], seed: int, kind: str = "gaussian"
) -> DataFrame:
    """Add noise of standard deviation ``spread`` to a numeric column."""
    draw = {"gaussian": normal, "laplace": laplace}[kind](seed, f"noise/{column}", *key)
    return df.withColumn(column, F.col(column) + spread * draw)


def blank_out(df: DataFrame, rates: Mapping[str, float], key: Sequence[str], seed: int) -> DataFrame:
    """Missing at random per column, independent of every value."""
    return df.withColumns(
        {c: F.when(uniform(seed, f"missing/{c}", *key) >= rate, F.col(c)) for c, rate in rates.items()}
    )


def junk_columns(df: DataFrame, n: int, key: Sequence[str], seed: int) -> DataFrame:
    return df.withColumns({f"junk_{j}": normal(seed, f"junk/{j}", *key) for j in range(n)})


def decoy_column(
    df: DataFrame, feature: str, mean: Column, std: Column, rho: float, key: Sequence[str], seed: int, out: str
) -> DataFrame:
    """Column correlated with a public feature by about ``rho``; the target plays no part."""
    z = (F.col(feature) - mean) / std
    noise = normal(seed, f"decoy/{out}", *key)
    return df.withColumn(out, F.lit(rho) * z + F.lit(math.sqrt(1 - rho * rho)) * noise)


def code_hash(*texts: str) -> str:
    return hashlib.sha256("\n".join(texts).encode()).hexdigest()

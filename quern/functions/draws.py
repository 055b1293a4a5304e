"""Random draws as pure functions of (seed, purpose, key).

A draw never depends on partitioning, task retries or row order, so a lost
executor recomputes exactly the same values.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, functions as F

_SPAN = float(2**52)
# Poisson(1) distribution function at 0..7; anything above maps to 8.
POISSON1_CDF = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8)]


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def key_text(*keys: Column | str) -> Column:
    """Key columns in one fixed text form. Use integers, dates or text only; null is a value of its own."""
    return F.concat_ws("|", *[F.coalesce(as_col(k).cast("string"), F.lit("\0")) for k in keys])


def draw_digest(seed: int, purpose: str, *keys: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), key_text(*keys)), 256)


def uniform(seed: int, purpose: str, *keys: Column | str) -> Column:
    """Uniform on the open interval (0, 1), 52 bits."""
    head = F.substring(draw_digest(seed, purpose, *keys), 1, 13)
    return (F.conv(head, 16, 10).cast("long") + F.lit(0.5)) / F.lit(_SPAN)


def uniform_value(seed: int, purpose: str, *keys: str | int) -> float:
    """The same draw for keys known to the driver."""
    digest = hashlib.sha256("|".join([str(seed), purpose, *map(str, keys)]).encode()).hexdigest()
    return (int(digest[:13], 16) + 0.5) / _SPAN


def normal(seed: int, purpose: str, *keys: Column | str) -> Column:
    radius = F.sqrt(F.lit(-2.0) * F.ln(uniform(seed, purpose + "/r", *keys)))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(seed, purpose + "/a", *keys))


def laplace(seed: int, purpose: str, *keys: Column | str) -> Column:
    """Laplace with unit standard deviation."""
    u = uniform(seed, purpose, *keys) - F.lit(0.5)
    return -F.signum(u) * F.ln(F.lit(1.0) - F.lit(2.0) * F.abs(u)) / F.lit(math.sqrt(2.0))


def poisson1(u: Column) -> Column:
    """Poisson(1) weight from a uniform draw, cut at 8."""
    return sum((F.when(u > F.lit(c), 1).otherwise(0) for c in POISSON1_CDF), F.lit(0))


def count_where(condition: str | Column) -> Column:
    """Rows that satisfy a condition given as SQL text or column."""
    return F.count_if(F.expr(condition) if isinstance(condition, str) else condition)


def rows() -> Column:
    return F.count(F.lit(1))

"""Fingerprints of rows in any order: four 64-bit lanes of each row's SHA-256, summed lane by lane.

Equal sets with equal repetitions give equal sums whatever the order, files or partitioning, and
a repeated row counts each time, which an exclusive-or would not see. Sums stay exact up to 10**18 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LANES = 4


def encoded(*values: Column | str) -> Column:
    """One text per tuple: byte count and value of each, ``-`` for null, so that no two tuples share one."""
    parts = []
    for value in values:
        text = (F.col(value) if isinstance(value, str) else value).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat(*parts)


def lanes(digest: Column) -> list[Column]:
    """The lanes of a hex digest as unsigned numbers."""
    return [F.conv(F.substring(digest, 16 * i + 1, 16), 16, 10).cast("decimal(20,0)") for i in range(LANES)]


def fingerprint(*values: Column | str) -> Column:
    """Aggregate: the summed lanes of all rows, as text; null where there are no rows."""
    sums = [F.sum(lane) for lane in lanes(F.sha2(encoded(*values), 256))]
    return F.when(sums[0].isNotNull(), F.concat_ws(":", *[s.cast("string") for s in sums]))


def encoded_sql(*values: str) -> str:
    """SQL text of :func:`encoded`; values are given as text expressions."""
    return " || ".join(f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')" for v in values)


def fingerprint_sql(*values: str) -> str:
    digest = f"sha256({encoded_sql(*values)})"
    sums = [f"sum(('0x' || substr({digest}, {16 * i + 1}, 16))::UBIGINT)::VARCHAR" for i in range(LANES)]
    return f"concat_ws(':', {', '.join(sums)})"

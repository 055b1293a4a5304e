"""Keyed digests for identifiers."""

from __future__ import annotations

import hashlib
import hmac
import os

import pandas as pd
from pyspark.sql import Column, functions as F

BLOCK = 64


def digest_text(namespace: str, column: str, value: Column) -> Column:
    """Namespace, column and value separated by NUL."""
    return F.concat(F.lit(f"{namespace}\0{column}\0"), value)


def keyed_digest_in_plan(key: bytes, namespace: str, column: str, value: Column) -> Column:
    """HMAC-SHA256 (hex) from built-in functions.

    The key pads become literals of the plan and its event log, so this form is
    for public test keys only.
    """
    key = hashlib.sha256(key).digest() if len(key) > BLOCK else key
    key = key.ljust(BLOCK, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    message = F.encode(digest_text(namespace, column, value), "utf-8")
    first = F.unhex(F.sha2(F.concat(F.lit(inner), message), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def keyed_digest(key_env: str, namespace: str, column: str, value: Column) -> Column:
    """HMAC-SHA256 (hex) with the key read from the worker's environment.

    The key never enters the plan. It must hold at least 32 bytes; the check
    runs where the key lives.
    """

    @F.pandas_udf("string")
    def digest(text: pd.Series) -> pd.Series:
        secret = os.environ.get(key_env, "").encode()
        if len(secret) < 32:
            raise ValueError(f"{key_env} must hold a secret of at least 32 bytes")
        base = hmac.new(secret, digestmod=hashlib.sha256)

        def one(v):
            if v is None:
                return None
            h = base.copy()
            h.update(v.encode())
            return h.hexdigest()

        return text.map(one)

    return digest(digest_text(namespace, column, value))

"""Helpers shared by the corpus operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_ID = 2**63 - 1
"""Stands for a null id where ids are compared: larger than every other id."""


def identified(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, mark, text)``: the id with nulls as :data:`NO_ID`, a 64-bit mark of the text, the text.

    ``id`` and ``mark`` together name a row; rows equal in both are equal rows.
    """
    key = F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID))
    text = F.col(text_column).cast("string")
    return docs.select(key.alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def public_id(column: str = "id") -> Column:
    """Undo the stand-in of :func:`identified`."""
    return F.when(F.col(column) != NO_ID, F.col(column))


def by_batch(fn: Callable[[pa.RecordBatch], dict], schema: pa.Schema) -> Callable:
    """Turn ``fn(batch) -> columns`` into a function for ``mapInArrow``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = fn(batch)
                arrays = [columns[f.name] if isinstance(columns[f.name], (pa.Array, pa.ChunkedArray))
                          else pa.array(columns[f.name], f.type) for f in schema]
                out = pa.RecordBatch.from_arrays(arrays, schema=schema)
                if out.num_rows:
                    yield out

    return run


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    for value in column:
        yield value.as_buffer().to_pybytes() if value.is_valid else b""


def per_worker(key: str, make: Callable):
    """What ``make`` returns, made once per Python worker: functions that travel by value keep no
    state of their own between tasks, a module of the worker does."""
    held = sys.modules.setdefault("quern_worker_state", types.ModuleType("quern_worker_state")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]

"""Line deduplication: explode normalised lines, hash, count documents, drop, reassemble.

A line's key is the line without white space ``[\\x20\\x09-\\x0D]`` at its ends and
with A-Z in lower case. Keys of at least ``min_chars`` code points found in at
least ``min_docs`` documents lose their lines everywhere except in the document
with the largest id that holds them. Keys are compared by 128-bit digests.

Defined results: a null or empty text is one empty line, which stays; rows that
repeat an id count as one document, each row is rewritten on its own; a null id
counts as one document with the largest id; an empty table gives an empty table.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import NO_ID, by_batch, identified, public_id, raw_texts
from quern.session import materialise

MIN_CHARS = 20
MIN_DOCS = 3


def line_key(line: bytes) -> bytes:
    return line.strip().lower()


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)


def _digests(raw: bytes, min_chars: int) -> Iterator[tuple[bytes, bytes]]:
    """Each line with the digest of its key; an empty digest where the key is too short."""
    for line in raw.split(b"\n"):
        key = line_key(line)
        yield line, hashlib.blake2b(key, digest_size=16).digest() if _long_enough(key, min_chars) else b""


def _explode(min_chars: int):
    schema = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())])

    def run(batch: pa.RecordBatch) -> dict:
        counts, keys = [], []
        for raw in raw_texts(batch.column("text")):
            own = {digest for _, digest in _digests(raw, min_chars) if digest}
            counts.append(len(own))
            keys.extend(own)
        words = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
        rows = np.repeat(np.arange(len(counts)), counts)
        return {"id": batch.column("id").take(pa.array(rows)), "mark": batch.column("mark").take(pa.array(rows)),
                "k1": words[:, 0], "k2": words[:, 1]}

    return by_batch(run, schema)


def _without(raw: bytes, drop: set[bytes], min_chars: int) -> tuple[int, list[bytes]]:
    """Number of lines, and the lines that stay."""
    if not drop:
        lines = raw.split(b"\n")
        return len(lines), lines
    lines = list(_digests(raw, min_chars))
    return len(lines), [line for line, digest in lines if digest not in drop]


def _drops(gone: pa.Array) -> Iterator[set[bytes]]:
    for keys in gone:
        yield set(keys.values.to_pylist()) if keys.is_valid else set()


def _rebuild(min_chars: int):
    schema = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())])

    def run(batch: pa.RecordBatch) -> dict:
        n_lines, n_dropped, kept = [], [], []
        for raw, drop in zip(raw_texts(batch.column("text")), _drops(batch.column("gone"))):
            total, stay = _without(raw, drop, min_chars)
            n_lines.append(total)
            n_dropped.append(total - len(stay))
            kept.append(b"\n".join(stay).decode())
        return {"id": batch.column("id"), "mark": batch.column("mark"), "n_lines": n_lines, "n_dropped": n_dropped, "kept": kept}

    return by_batch(run, schema)


def dropped_keys(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(id, mark, gone)``: for each row that loses lines, the digests of their keys."""
    lines = docs.mapInArrow(_explode(min_chars), "id long, mark long, k1 long, k2 long")
    lines = materialise(lines)
    repeated = lines.groupBy("k1", "k2").agg(F.count_distinct("id").alias("n"), F.max("id").alias("last"))
    repeated = repeated.where(F.col("n") >= min_docs).select("k1", "k2", "last")
    hit = lines.join(repeated, ["k1", "k2"]).where("id <> last")
    # the digest's bytes, as they were before they travelled as two numbers
    as_bytes = [F.unhex(F.lpad(F.hex(c), 16, "0")) for c in ("k1", "k2")]
    swapped = [F.concat(*[F.substring(b, i, 1) for i in range(8, 0, -1)]) for b in as_bytes]
    return hit.groupBy("id", "mark").agg(F.collect_set(F.concat(*swapped)).alias("gone"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(id, mark, n_lines, n_dropped, kept)`` per row; ``kept`` is the text that stays."""
    rows = identified(docs)
    gone = dropped_keys(rows, min_chars, min_docs)
    joined = rows.join(gone, ["id", "mark"], "left").select("id", "mark", "text", "gone")
    return joined.mapInArrow(_rebuild(min_chars), "id long, mark long, n_lines long, n_dropped long, kept string")


def rewrite(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with repeated lines cut from ``text`` (and ``n_chars`` counted anew); other columns stay."""

    def kept(texts: pa.Array, gone: pa.Array) -> pa.Array:
        pairs = zip(raw_texts(texts), _drops(gone))
        return pa.array([b"\n".join(_without(raw, drop, min_chars)[1]).decode() for raw, drop in pairs], pa.string())

    gone = dropped_keys(identified(docs), min_chars, min_docs)
    gone = gone.select(F.col("id").alias("__line_id"), F.col("mark").alias("__line_mark"), F.col("gone").alias("__line_gone"))
    own = [F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == F.col("__line_id"), F.xxhash64(docs["text"]) == F.col("__line_mark")]
    text = F.when(F.col("__line_gone").isNull(), docs["text"]).otherwise(F.arrow_udf(kept, "string")(docs["text"], F.col("__line_gone")))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return docs.join(gone, own, "left").select(*[new[c].alias(c) if c in new else docs[c] for c in docs.columns])


def line_report(docs: DataFrame) -> DataFrame:
    """Digest columns of :func:`dedup_lines` for every row."""
    done = dedup_lines(docs)
    return done.select(public_id().alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))

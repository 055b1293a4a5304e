"""Benchmark decontamination by greedy string tiling.

Tokens are runs of bytes outside white space and ASCII punctuation, A-Z in lower
case. Documents and items are joined on shared seeds of ``min_match`` tokens. A
pair is tiled: the longest common run of unmarked tokens, found by running
Karp-Rabin hashes over both sides, is marked on both sides, again and again,
down to ``min_match``. Tiles may come in any order, so a reordered passage is
caught. A document is contaminated by an item whose tokens it covers to a share
of at least ``coverage``.

The items are the stated query set. They are cut into blocks of bounded size by
a hash of their id, and one block at a time is sent to the executors, where
every document meets it in place: nothing is shuffled, a much copied passage
costs no more than others.

Before tiling, a bound is tried: tiles cannot cover more of an item than all its
seeds found in the document do.

Defined results: null and empty texts and items match nothing, items of fewer
than ``min_match`` tokens neither; rows that repeat an id give one row per pair,
with the best coverage; null ids are kept as null; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.llm.common import by_batch, raw_texts
from quern.llm.hashing import SPACE, found_in, grams, word_hashes

MIN_MATCH = 5
COVERAGE = 0.5
BLOCK_BYTES = 4 << 20

SEPARATORS = SPACE.copy()
SEPARATORS[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True


def tokens(raw: bytes) -> np.ndarray:
    return word_hashes(raw, lower=True, separators=SEPARATORS)


def _open_runs(free: np.ndarray, size: int) -> np.ndarray:
    """Starts of runs of ``size`` unmarked tokens."""
    if len(free) < size:
        return np.zeros(0, np.int64)
    total = np.concatenate(([0], np.cumsum(free)))
    return np.flatnonzero(total[size:] - total[:-size] == size)


def _common(item, doc, free_item, free_doc, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Karp-Rabin: unmarked starts on both sides and their hashes, where a hash is on both."""
    i, d = _open_runs(free_item, size), _open_runs(free_doc, size)
    hi, hd = grams(item, size)[i], grams(doc, size)[d]
    at = np.isin(hi, hd)
    i, hi = i[at], hi[at]
    at = np.isin(hd, hi)
    return i, hi, d[at], hd[at]


def tile(item: np.ndarray, doc: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles ``(item start, document start, length)``: longest first, then by position."""
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    tiles, most = [], min(len(item), len(doc))
    while most >= min_match:
        low, high = min_match - 1, most  # the longest run: halve the range
        while low < high:
            middle = (low + high + 1) // 2
            if len(_common(item, doc, free_item, free_doc, middle)[0]):
                low = middle
            else:
                high = middle - 1
        if low < min_match:
            break
        most = low
        i, hi, d, hd = _common(item, doc, free_item, free_doc, most)
        order = np.argsort(hd, kind="stable")
        d, hd = d[order], hd[order]
        for start, value in zip(i.tolist(), hi):
            if not free_item[start : start + most].all():
                continue
            at = int(np.searchsorted(hd, value))
            while at < len(hd) and hd[at] == value:
                other = int(d[at])
                if free_doc[other : other + most].all() and (item[start : start + most] == doc[other : other + most]).all():
                    free_item[start : start + most] = False
                    free_doc[other : other + most] = False
                    tiles.append((start, other, most))
                    break
                at += 1
    return tiles


@dataclass
class Block:
    """Some items: tokens, and their seeds sorted by hash with item and position."""

    ids: list
    items: list[np.ndarray]
    seeds: np.ndarray
    owner: np.ndarray
    place: np.ndarray


def _block(ids: list, texts: list[bytes], min_match: int) -> Block:
    items = [tokens(t) for t in texts]
    gram = [grams(t, min_match) for t in items]
    seeds = np.concatenate([*gram, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(items)), [len(g) for g in gram])
    place = np.concatenate([*(np.arange(len(g)) for g in gram), np.zeros(0, np.int64)])
    order = np.argsort(seeds, kind="stable")
    return Block(ids, items, seeds[order], owner[order], place[order])


def _covered(block: Block, doc: np.ndarray, min_match: int, coverage: float) -> Iterator[tuple[int, int, int, float]]:
    """(item, tiles, matched tokens, coverage) of each contaminating item."""
    gram = np.unique(grams(doc, min_match))
    hits = gram[found_in(gram, block.seeds)]
    if not len(hits):
        return
    low, high = np.searchsorted(block.seeds, hits), np.searchsorted(block.seeds, hits, "right")
    at = np.concatenate([np.arange(a, b) for a, b in zip(low, high)])
    owner, place = block.owner[at], block.place[at]
    for which in np.unique(owner).tolist():
        item = block.items[which]
        near = np.zeros(len(item) + 1, np.int64)
        np.add.at(near, place[owner == which], 1)
        np.add.at(near, place[owner == which] + min_match, -1)
        if (np.cumsum(near[:-1]) > 0).sum() < coverage * len(item):
            continue
        tiles = tile(item, doc, min_match)
        matched = sum(t[2] for t in tiles)
        if matched and matched >= coverage * len(item):
            yield which, len(tiles), matched, matched / len(item)


def _meet(block: Block, id_type: pa.DataType, item_type: pa.DataType, min_match: int, coverage: float):
    schema = pa.schema([("doc_id", id_type), ("item_id", item_type), ("n_tiles", pa.int64()), ("n_matched", pa.int64()), ("coverage", pa.float64())])

    def run(batch: pa.RecordBatch) -> dict:
        rows, found = [], []
        for at, raw in enumerate(raw_texts(batch.column("text"))):
            for hit in _covered(block, tokens(raw), min_match, coverage):
                rows.append(at)
                found.append(hit)
        which, tiles, matched, share = zip(*found) if found else ((), (), (), ())
        return {"doc_id": batch.column("doc_id").take(pa.array(rows, pa.int64())), "item_id": [block.ids[w] for w in which],
                "n_tiles": tiles, "n_matched": matched, "coverage": share}

    return by_batch(run, schema)


def _blocks(benchmark: DataFrame, min_match: int, block_bytes: int) -> Iterator[Block]:
    """The items in blocks of about ``block_bytes``, one at a time."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("length(text) > 0")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = int(total // block_bytes) + 1
    for number in range(count):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == number).orderBy("item_id", "text").collect()
        yield _block([r["item_id"] for r in part], [r["text"].encode() for r in part], min_match)


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, item_id, n_tiles, n_matched, coverage)`` of every contaminated pair."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kinds = [rows.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType]
    arrow = [to_arrow_type(k) for k in kinds]
    schema = f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, n_tiles long, n_matched long, coverage double"
    found = None
    for block in _blocks(benchmark, min_match, block_bytes):
        pairs = rows.mapInArrow(_meet(block, *arrow, min_match, coverage), schema)
        found = pairs if found is None else found.union(pairs)
    best = F.max(F.struct("coverage", "n_matched", "n_tiles")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_tiles", "best.n_matched", "best.coverage")


def clean(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents that no item contaminates; all columns stay, nothing is shuffled."""
    for block in _blocks(benchmark, min_match, block_bytes):
        docs = docs.where(~_touched(block, min_match, coverage)(F.col("text").cast("string")))
    return docs


def _touched(block: Block, min_match: int, coverage: float):
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([next(_covered(block, tokens(raw), min_match, coverage), None) is not None for raw in raw_texts(texts)], pa.bool_())

    return F.arrow_udf(run, "boolean")

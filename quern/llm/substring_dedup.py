"""Substring deduplication over prefix-partitioned suffix trees.

Words ``[^\\x20\\x09-\\x0D]+`` are taken unchanged. A window is ``span`` consecutive
words of one row. A word goes if a window that covers it also starts in a
document with a smaller id; windows are judged on the input.

1. Every window has one anchor: the smallest hash among its runs of ``seed``
   words. Equal windows have equal anchors at equal offsets, so only suffixes
   near an anchor that two documents share can matter. Anchors are counted over
   all documents.
2. Those suffixes are split by a prefix of variable length: the anchor's own
   ``seed`` words, or all ``span`` words where an anchor stands at more than
   ``group`` places, counted with every repeat inside a text. A group of the
   first kind holds at most ``group`` short pieces.
3. The suffix tree of many groups at once is built as sorted classes of
   prefixes of 1, 2, 4, ... words (prefix doubling). An inner node at depth
   ``span`` with several leaves is a repeat; its smallest id is the one to keep.
   At full length a group is such a node itself, and an aggregate finds that id.

Defined results: a null or empty text has no words; rows that repeat an id do
not remove each other's words; a null id counts as the largest; texts shorter
than a window lose nothing; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import by_batch, identified, public_id, raw_texts
from quern.llm.hashing import grams, mix, word_bounds, word_hashes
from quern.session import materialise

SPAN = 50
SEED = 16
GROUP = 64
_TREE_WORDS = 1 << 19
_PART_BYTES = 4 << 20


def minimisers(gram: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` grams, where its smallest one stands (the first of equals)."""
    low, at = gram.copy(), np.arange(len(gram))
    have = 1
    while have < width:
        step = min(have, width - have)
        n = len(low) - step
        later = low[step:] < low[:n]
        low = np.where(later, low[step:], low[:n])
        at = np.where(later, at[step:], at[:n])
        have += step
    return at


def anchor_runs(words: np.ndarray, span: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last window start, for each run of windows with one anchor."""
    if len(words) < span:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    gram = grams(words, seed)
    at = minimisers(gram, span - seed + 1)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:], [len(at)])) - 1
    return gram[at[first]], first, last


def _anchors(span: int, seed: int):
    schema = pa.schema([("anchor", pa.int64()), ("id", pa.int64()), ("mark", pa.int64()), ("runs", pa.int64())])

    def run(batch: pa.RecordBatch) -> dict:
        found, runs, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
        for raw in raw_texts(batch.column("text")):
            hashes, n = np.unique(anchor_runs(word_hashes(raw), span, seed)[0], return_counts=True)
            found.append(hashes)
            runs.append(n)
            counts.append(len(hashes))
        rows = pa.array(np.repeat(np.arange(len(counts)), counts))
        own = {c: batch.column(c).take(rows) for c in ("id", "mark")}
        return {"anchor": np.concatenate(found).view(np.int64), **own, "runs": np.concatenate(runs)}

    return by_batch(run, schema)


_PIECES = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("key", pa.int64()), ("key2", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("piece", pa.string())])


def _pieces(span: int, seed: int):
    """Rows by prefix: a piece of text per short prefix, a window per full one (without text).

    Rows leave in parts of about `_PART_BYTES`, however long a text or a batch is.
    """

    def part(docs: list, marks: list, key, key2, start, n, piece: list) -> pa.RecordBatch:
        arrays = [pa.array(docs, pa.int64()), pa.array(marks, pa.int64()), pa.array(key), pa.array(key2), pa.array(start), pa.array(n, pa.int32()), pa.array(piece, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, schema=_PIECES)

    def short_pieces(raw: bytes, doc, mark, keys: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[pa.RecordBatch]:
        opens, shuts = word_bounds(np.frombuffer(raw, np.uint8))
        low, high = opens[first], shuts[last + span - 1]
        cuts = np.flatnonzero(np.diff(np.cumsum(high - low) // _PART_BYTES, prepend=0)).tolist()
        for i, j in zip([0, *cuts], [*cuts, len(keys)]):
            if i < j:
                text = [raw[x:y].decode() for x, y in zip(low[i:j].tolist(), high[i:j].tolist())]
                yield part([doc] * (j - i), [mark] * (j - i), keys[i:j], np.zeros(j - i, np.int64), first[i:j], last[i:j] - first[i:j] + 1, text)

    def full_windows(words: np.ndarray, doc, mark, first: np.ndarray, last: np.ndarray) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(len(words) + 1, np.int64)
        np.add.at(flags, first, 1)
        np.add.at(flags, last + 1, -1)
        starts = np.flatnonzero(np.cumsum(flags[:-1]))
        whole, other = grams(words, span)[starts].view(np.int64), grams(mix(words), span)[starts].view(np.int64)
        for i in range(0, len(starts), _PART_BYTES // 64):
            at = slice(i, i + _PART_BYTES // 64)
            m = len(starts[at])
            yield part([doc] * m, [mark] * m, whole[at], other[at], starts[at], np.ones(m, np.int32), [None] * m)

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        columns = (batch.column(c) for c in ("id", "mark", "short", "full"))
        for raw, doc, mark, short, full in zip(raw_texts(batch.column("text")), *columns):
            words = word_hashes(raw)
            anchors, first, last = anchor_runs(words, span, seed)
            anchors = anchors.view(np.int64)
            near, far = np.isin(anchors, short.values.to_numpy()), np.isin(anchors, full.values.to_numpy())
            if near.any():
                yield from short_pieces(raw, doc.as_py(), mark.as_py(), anchors[near], first[near], last[near])
            if far.any():
                yield from full_windows(words, doc.as_py(), mark.as_py(), first[far], last[far])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for rows in parts(batch):
                held.append(rows)
                size += rows.nbytes
                if size >= _PART_BYTES:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def prefix_classes(values: np.ndarray, room: np.ndarray, span: int) -> np.ndarray:
    """Class of each suffix by its first ``span`` values, by prefix doubling; ``room``: values left in its piece.

    Classes of suffixes with less room than ``span`` mean nothing.
    """
    n = len(values)
    _, rank = np.unique(values, return_inverse=True)
    ranks, size = {1: rank.astype(np.int64)}, 1

    def joined(left: np.ndarray, right: np.ndarray, shift: int) -> np.ndarray:
        follow = np.zeros(n, np.int64)
        follow[: n - shift] = right[shift:] + 1
        follow[room <= shift] = 0
        return np.unique(left * np.int64(n + 2) + follow, return_inverse=True)[1].astype(np.int64)

    while size * 2 <= span:
        ranks[size * 2] = joined(ranks[size], ranks[size], size)
        size *= 2
    done, rank = size, ranks[size]
    while done < span:
        step = 1 << ((span - done).bit_length() - 1)
        rank = joined(rank, ranks[step], done)
        done += step
    return rank


def _repeats_in(doc, mark, start, n, pieces: list[str], span: int) -> dict:
    sizes = n.astype(np.int64) + span - 1
    text = word_hashes(" ".join(pieces).encode())
    ends = np.cumsum(sizes)
    piece = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(text)) - (ends - sizes)[piece]
    node = prefix_classes(text, sizes[piece] - at, span)
    leaf = np.flatnonzero(at < n[piece])
    node, owner = node[leaf], doc[piece[leaf]]
    order = np.lexsort((owner, node))
    node, owner, leaf = node[order], owner[order], leaf[order]
    new = np.concatenate(([True], node[1:] != node[:-1])) if len(node) else np.zeros(0, bool)
    least = owner[np.flatnonzero(new)][np.cumsum(new) - 1] if len(node) else owner
    leaf = leaf[owner > least]
    return {"id": doc[piece[leaf]], "mark": mark[piece[leaf]], "start": start[piece[leaf]] + at[leaf]}


def _trees(span: int):
    """Groups arrive in order of their key; whole groups are gathered until a tree is large enough."""
    schema = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("start", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def build(table: pa.Table) -> pa.RecordBatch:
            col = {c: table.column(c).to_numpy() for c in ("key", "id", "mark", "start", "n")}
            found = _repeats_in(col["id"], col["mark"], col["start"], col["n"], table.column("piece").to_pylist(), span)
            return pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in schema], schema=schema)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            if rest.num_rows * (span + 20) < _TREE_WORDS:
                continue
            keys = rest.column("key").to_numpy()
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
            if cut:
                yield build(rest.slice(0, cut))
                rest = rest.slice(cut)
        if rest is not None and rest.num_rows:
            yield build(rest)

    return run


def pieces_by_prefix(docs: DataFrame, span: int = SPAN, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """Rows of :data:`_PIECES`: at most ``group`` pieces of text a key, windows without text where there are more."""
    anchors = materialise(docs.mapInArrow(_anchors(span, seed), "anchor long, id long, mark long, runs long"))
    shared = anchors.groupBy("anchor").agg(F.sum("runs").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
    shared = shared.where("low < high").select("anchor", "n")
    wanted = anchors.join(shared, "anchor").groupBy("id", "mark").agg(
        F.collect_set(F.when(F.col("n") <= group, F.col("anchor"))).alias("short"),
        F.collect_set(F.when(F.col("n") > group, F.col("anchor"))).alias("full"))
    kinds = "id long, mark long, key long, key2 long, start long, n int, piece string"
    return docs.join(wanted, ["id", "mark"]).select("id", "mark", "text", "short", "full").mapInArrow(_pieces(span, seed), kinds)


def repeated_windows(docs: DataFrame, span: int = SPAN, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """``(id, mark, starts)``: starts of windows that also start in a document with a smaller id."""
    pieces = materialise(pieces_by_prefix(docs, span, seed, group))
    by_prefix = pieces.where("piece is not null").repartition("key").sortWithinPartitions("key")
    cold = by_prefix.mapInArrow(_trees(span), "id long, mark long, start long")
    windows = pieces.where("piece is null")
    least = windows.groupBy("key", "key2").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    hot = windows.join(least, ["key", "key2"]).where("id > low").select("id", "mark", "start")
    return cold.union(hot).groupBy("id", "mark").agg(F.collect_set("start").alias("starts"))


def _cut(span: int):
    schema = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batch: pa.RecordBatch) -> dict:
        n_words, n_removed, kept = [], [], []
        for raw, starts in zip(raw_texts(batch.column("text")), batch.column("starts")):
            words = raw.split()
            n_words.append(len(words))
            if starts.is_valid and len(starts):
                turn = np.zeros(len(words) + 1, np.int64)
                at = starts.values.to_numpy()
                np.add.at(turn, at, 1)
                np.add.at(turn, at + span, -1)
                stay = np.flatnonzero(np.cumsum(turn[:-1]) == 0)
                words = [words[i] for i in stay]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words).decode())
        return {"id": batch.column("id"), "mark": batch.column("mark"), "n_words": n_words, "n_removed": n_removed, "kept": kept}

    return by_batch(run, schema)


def dedup_substrings(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """``(id, mark, n_words, n_removed, kept)`` per row; ``kept``: the words that stay, by one space."""
    rows = identified(docs)
    starts = repeated_windows(rows, span)
    joined = rows.join(starts, ["id", "mark"], "left").select("id", "mark", "text", "starts")
    return joined.mapInArrow(_cut(span), "id long, mark long, n_words long, n_removed long, kept string")


def substring_report(docs: DataFrame) -> DataFrame:
    """Digest columns of :func:`dedup_substrings` for every row."""
    done = dedup_substrings(docs)
    return done.select(public_id().alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

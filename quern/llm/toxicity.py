"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text,
and every window of words is compressed with both. What the toxic dictionary
saves is the window's distance; thresholds on the distances are calibrated into
one score per text.

Training covers frequent byte runs of a class, as dictionary trainers do, but
weighs a run by how many more documents of its own class hold it. Both
dictionaries open with the same ordinary vocabulary and have equal lengths, so
equal matches cost the same in both and a distance comes from the class
content alone.

The classifier is fitted on labelled rows drawn by hash, at most ``sample``
rows of each label; the bound is a parameter and the draw depends on ids only.
Scoring covers whole texts of all rows and uses the text alone.

Defined results: null and empty texts have no window and get the score of a
text without any distance; rows are scored one by one, repeated ones alike;
labels that are null or contradict each other for one id are not learnt from;
without labels of both kinds every score is 0.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import raw_texts
from quern.llm.hashing import found_in, word_hashes

SAMPLE = 4000
WINDOW = 16
RUN = 6
BASE_BYTES = 8192
CLASS_BYTES = 768
MIN_DOCS = 5
MIN_Z = 5.0
MIN_RATIO = 20.0
FEATURES = 6
_MERGED = 1 << 19


def parameters() -> zstandard.ZstdCompressionParameters:
    """Small tables and a lazy search: windows are short."""
    return zstandard.ZstdCompressionParameters(
        window_log=14, chain_log=14, hash_log=14, search_log=6, min_match=5, target_length=16,
        strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False,
        write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)


def _runs(word: bytes) -> set[bytes]:
    padded = b" " + word + b" "
    return {padded[i : i + RUN] for i in range(len(padded) - RUN + 1)}


_PLACES = np.uint64(256) ** np.arange(RUN - 1, -1, -1, dtype=np.uint64)


def _runs_in(padded: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of `RUN` bytes without a space inside, as numbers, and where they start."""
    data = np.frombuffer(padded, np.uint8)
    if len(data) < RUN:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(data, RUN)
    at = np.flatnonzero(~(views[:, 1:-1] == 32).any(axis=1))
    return views[at].astype(np.uint64) @ _PLACES, at


class _Counts:
    """Number of documents by number: sorted arrays, merged now and then, a few bytes a value."""

    def __init__(self) -> None:
        self.held, self.size = [], 0
        self.values, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, values: np.ndarray) -> None:
        self.held.append(np.unique(values))
        self.size += len(self.held[-1])
        if self.size >= _MERGED:
            self.merge()

    def merge(self) -> None:
        values = np.concatenate([self.values, *self.held])
        counts = np.concatenate([self.counts, *(np.ones(len(h), np.int64) for h in self.held)])
        self.values, at = np.unique(values, return_inverse=True)
        self.counts = np.bincount(at, counts, len(self.values)).astype(np.int64)
        self.held, self.size = [], 0

    def of(self, values: np.ndarray) -> np.ndarray:
        if not len(self.values):
            return np.zeros(len(values), np.int64)
        at = np.minimum(np.searchsorted(self.values, values), len(self.values) - 1)
        return np.where(self.values[at] == values, self.counts[at], 0)


class _Class:
    """The documents of one label: how many hold each run and each word."""

    def __init__(self, texts: list[bytes]) -> None:
        self.texts, self.n = texts, len(texts)
        self.runs, self.words = _Counts(), _Counts()
        for text in texts:
            padded = b" " + b" ".join(text.split()) + b" "
            self.runs.add(_runs_in(padded)[0])
            self.words.add(word_hashes(padded))
        self.runs.merge()
        self.words.merge()

    def vocabulary(self, runs: np.ndarray, most: int) -> Counter:
        """Words, by documents, that hold one of ``runs`` or are among the ``most`` frequent (with all ties of the last)."""
        counts = np.sort(self.words.counts)[::-1]
        frequent = self.words.values[self.words.counts >= counts[min(most, len(counts)) - 1]] if len(counts) else self.words.values
        found: Counter = Counter()
        for text in self.texts:
            words = text.split()
            padded = b" " + b" ".join(words) + b" "
            wanted = found_in(word_hashes(padded), frequent)
            numbers, at = _runs_in(padded)
            opens = np.cumsum([1, *(len(w) + 1 for w in words)])[:-1]
            # a run starts at the space before its word or inside it
            wanted[np.searchsorted(opens, at[found_in(numbers, runs)] + 1, side="right") - 1] = True
            found.update({words[i] for i in np.flatnonzero(wanted).tolist()})
        return found


def _telling(own: _Class, other: _Class) -> dict[bytes, int]:
    """Runs held by clearly more documents of this class."""
    often = own.runs.counts >= MIN_DOCS
    runs, a = own.runs.values[often], own.runs.counts[often]
    b = other.runs.of(runs)
    share = (a + b) / (own.n + other.n)
    z = (a / own.n - b / other.n) / np.sqrt(share * (1 - share) * (1 / own.n + 1 / other.n) + 1e-12)
    clear = (z > MIN_Z) & ((a / own.n) / ((b + 0.5) / other.n) > MIN_RATIO)
    return {int(run).to_bytes(RUN, "big"): int(n) for run, n in zip(runs[clear], a[clear])}


def _cover(weights: dict[bytes, int], words: Counter, budget: int) -> bytes:
    """Segments of words that cover the weighted runs, heaviest last (nearest to the text)."""
    left, segments, size = dict(weights), [], 0
    candidates = sorted(w for w in words if any(r in left for r in _runs(w)))

    def segment(word: bytes) -> tuple[int, bytes]:
        padded = b" " + word + b" "
        at = [i for i in range(len(padded) - RUN + 1) if padded[i : i + RUN] in left]
        return (sum(left[padded[i : i + RUN]] for i in at), padded[at[0] : at[-1] + RUN]) if at else (0, b"")

    while left and candidates:
        weight, best = max(map(segment, candidates))
        if not weight or size + len(best) > budget:
            break
        segments.append(best)
        size += len(best)
        for i in range(len(best) - RUN + 1):
            left.pop(best[i : i + RUN], None)
        candidates = [w for w in candidates if segment(w)[0]]
    return b"".join(segments[::-1])


@dataclass
class Model:
    """Dictionaries as bytes, calibration as plain arrays."""

    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    window: int = WINDOW

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        out = []
        for content in (self.toxic, self.ordinary):
            table = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            table.precompute_compress(compression_params=parameters())
            out.append(zstandard.ZstdCompressor(dict_data=table, compression_params=parameters()))
        return out[0], out[1]

    def score(self, features: np.ndarray) -> np.ndarray:
        if not self.toxic:
            return np.zeros(len(features))
        x = (features - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -35, 35)))


def distances(raw: bytes, toxic, ordinary, window: int) -> np.ndarray:
    """Bytes that the toxic dictionary saves in each window of words."""
    words = raw.split()
    a, b, join = toxic.compress, ordinary.compress, b" ".join
    out = []
    for i in range(0, len(words), window):
        text = b" " + join(words[i : i + window]) + b" "
        out.append(len(b(text)) - len(a(text)))
    return np.array(out, np.int64)


def summary(d: np.ndarray) -> list[float]:
    """Largest, mean, mean of the three largest, shares at the thresholds 2 and 4, log of the number of windows."""
    if not len(d):
        return [0.0] * FEATURES
    top = np.sort(d)[-3:]
    return [float(d.max()), float(d.mean()), float(top.mean()), float((d >= 2).mean()), float((d >= 4).mean()), math.log(len(d))]


def train(texts: list[bytes], labels: list[int], window: int = WINDOW) -> Model:
    """Dictionaries from half of the rows, calibration from the other half."""
    empty = Model(b"", b"", np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES + 1), window)
    half: list[list[tuple[bytes, int]]] = [[], []]
    for at, row in enumerate(sorted(set(zip(texts, labels)))):
        half[at % 3 == 2].append(row)
    classes = {y: _Class([t for t, label in half[0] if label == y]) for y in (0, 1)}
    if not classes[0].n or not classes[1].n or {y for _, y in half[1]} != {0, 1}:
        return empty
    telling = {y: _telling(classes[y], classes[1 - y]) for y in (0, 1)}
    numbers = {y: np.sort(np.array([int.from_bytes(r, "big") for r in telling[y]], np.uint64)) for y in (0, 1)}
    words = {y: classes[y].vocabulary(numbers[y], BASE_BYTES // 4) for y in (0, 1)}
    tails = {y: _cover(telling[y], words[y], CLASS_BYTES) for y in (0, 1)}
    shared = b" ".join([w for w, _ in sorted(words[0].items(), key=lambda x: (-x[1], x[0]))[: BASE_BYTES // 4]][::-1])[-BASE_BYTES:] + b" "
    length = max(map(len, tails.values()))
    if not length:
        return empty
    model = Model(shared + tails[1].rjust(length, b"\0"), shared + tails[0].rjust(length, b"\0"), empty.mean, empty.scale, empty.weights, window)
    a, b = model.compressors()
    x = np.array([summary(distances(t, a, b, window)) for t, _ in half[1]])
    y = np.array([label for _, label in half[1]], float)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    model.weights = _logistic((x - model.mean) / model.scale, y)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps for a ridge logistic regression; a bounded sample, so plain arrays."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * 10)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def held_out(id_column: str = "doc_id") -> Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _trained(window: int):
    """All batches of the sample give one row, the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        labels: list[int] = []
        for batch in batches:
            texts += raw_texts(batch.column("text"))
            labels += batch.column("toxic").to_pylist()
        model = train(texts, labels, window)
        numbers = [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (model.mean, model.scale, model.weights)]
        yield pa.RecordBatch.from_arrays([pa.array([model.toxic], pa.binary()), pa.array([model.ordinary], pa.binary()), *numbers], names=["toxic", "ordinary", "mean", "scale", "weights"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, window: int = WINDOW) -> Model:
    """Fit on at most ``sample`` labelled rows per label, drawn by the hash of their id."""
    known = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
    known = known.where("toxic = most").where(~held_out())
    draws = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", "toxic") for y in (0, 1)]
    chosen = draws[0].union(draws[1])  # at most two samples of ids: small enough to broadcast
    rows = docs.select("text", "doc_id").join(F.broadcast(chosen), "doc_id").where("text is not null").select("text", "toxic")
    # one task holds the bounded sample; the driver gets two dictionaries and 19 numbers
    made = rows.repartition(1).mapInArrow(_trained(window), "toxic binary, ordinary binary, mean array<double>, scale array<double>, weights array<double>").first()
    if made is None:
        return train([], [], window)
    return Model(bytes(made.toxic), bytes(made.ordinary), np.array(made.mean), np.array(made.scale), np.array(made.weights), window)


def scorer(model: Model):
    """``text -> score`` as an Arrow function for a column."""

    def run(texts: pa.Array) -> pa.Array:
        if not model.toxic:
            return pa.array(np.zeros(len(texts)))
        a, b = model.compressors()
        x = np.array([summary(distances(raw, a, b, model.window)) for raw in raw_texts(texts)]).reshape(-1, FEATURES)
        return pa.array(model.score(x))

    return F.arrow_udf(run, "double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row."""
    score = scorer(fit(docs, labels, sample))
    scored = docs.select("doc_id", held_out().alias("held_out"), score(F.col("text").cast("string")).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Documents whose score stays under one half; all columns stay."""
    score = scorer(fit(docs, labels, sample))
    return docs.where(score(F.col("text").cast("string")) < 0.5)

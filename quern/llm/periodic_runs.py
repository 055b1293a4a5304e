"""Periodic runs: maximal stretches of words that repeat with some period at least four times.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are equal),
at least ``max(6, 4 * q)`` words long, that no neighbouring word extends keeping the period.

Method, one scale ``P = 1, 2, 4, ...`` after the other, for periods from ``P`` to ``2P - 1``: the
words are cut into blocks of ``P``. A run of such a period holds at least two neighbouring blocks
together with what stands a period later. For each block ``b`` and every distance ``d`` in the
scale, the sum of ``(b[j] - text[start + d + j]) ** 2`` comes from one exact integer convolution
over the two windows that follow: squares from running sums, products from a number-theoretic
transform modulo a prime above every possible sum. Sums of zero are occurrences. Blocks that
repeat at one distance in a row are seeds; running hashes extend them by less than a block to
either side. Long enough seeds that lie in no run of a lower scale are runs: inside such a run a
longer period is a multiple of the shorter one.

Transforms work on small word codes (equal words have equal codes), so that sums stay below the
prime; occurrences and extensions are then held against 64-bit word hashes, and every run is
compared word by word hash before it is reported. Equality of words is decided on those 64-bit
hashes. Texts are gathered into arrays of about `GATHER` words with marks between them that equal
nothing else; a longer text forms its own array, whose transforms go in slabs of `SLAB` numbers.
Nothing is shuffled, and no length is capped.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``. Defined results: null and empty texts have
no words and no runs; rows that repeat an id are judged each; an empty table gives an empty
table; columns that are not asked for are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import compress
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from quern.llm.common import raw_texts
from quern.llm.hashing import mix, word_hashes

TIMES = 4
LEAST = 6
GATHER = 1 << 17
SLAB = 1 << 18
PART = 1 << 22

PRIME = 3 * 2**30 + 1  # has roots of unity of every order up to 2**30; products fit 64 bits
GENERATOR = 5
_P = np.uint64(PRIME)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MARK = np.uint64(0xD6E8FEB86659FD93)


def _reduce(x: np.ndarray) -> np.ndarray:
    x -= x // _P * _P
    return x


def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a + b`` of values below the prime; where it is not reached, the subtraction wraps around."""
    total = a + b
    return np.minimum(total, total - _P, out=total)


def _roots(n: int, inverse: bool) -> np.ndarray:
    """Powers 0 to n/2 - 1 of a root of unity of order ``n``, or of its inverse."""
    root = pow(GENERATOR, (PRIME - 1) // n, PRIME)
    root = pow(root, -1, PRIME) if inverse else root
    out = np.ones(max(1, n // 2), np.uint64)
    size = 1
    while size < len(out):
        out[size : 2 * size] = _reduce(out[:size] * np.uint64(pow(root, size, PRIME)))
        size *= 2
    return out


def _backward(n: int) -> np.ndarray:
    """Bit-reversed place of each index."""
    out = np.zeros(1, np.int64)
    while len(out) < n:
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


class Scale:
    """Tables of one block size ``p``: transforms have the size ``2p``, blocks are columns."""

    def __init__(self, p: int) -> None:
        self.p, n = p, 2 * p
        self.ahead, self.back = _roots(n, False), _roots(n, True)
        order = _backward(n)
        self.negated = order[-order % n]
        self.unit = np.uint64(pow(n, -1, PRIME))
        self.codes = np.uint64(isqrt((PRIME - 1) // p) + 1)

    def forward(self, blocks: np.ndarray) -> np.ndarray:
        """Transform of blocks followed by zeros; frequencies in bit-reversed order."""
        p, width = self.p, blocks.shape[1]
        x = np.empty((2 * p, width), np.uint64)
        x[:p] = blocks
        x[p:] = _reduce(blocks * self.ahead[:, None])
        half = p // 2
        while half:
            v = x.reshape(p // half, 2, half, width)
            a, b = v[:, 0], v[:, 1]
            total = _sum(a, b)
            v[:, 1] = _reduce(_sum(a, _P - b) * self.ahead[:: p // half, None])
            v[:, 0] = total
            half //= 2
        return x

    def first_half(self, x: np.ndarray) -> np.ndarray:
        """The first ``p`` values whose transform is ``x`` (overwritten)."""
        p, width = self.p, x.shape[1]
        half = 1
        while half < p:
            v = x.reshape(p // half, 2, half, width)
            a, b = v[:, 0], _reduce(v[:, 1] * self.back[:: p // half, None])
            v[:, 1] = _sum(a, _P - b)
            v[:, 0] = _sum(a, b)
            half *= 2
        return _reduce(_sum(x[:p], _reduce(x[p:] * self.back[:, None])) * self.unit)

    def occurrences(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(block, distance)`` wherever the codes of a block return ``p`` to ``2p - 1`` words later."""
        p = self.p
        codes = words % self.codes
        squares = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * codes)])
        later = np.zeros(len(codes), np.uint64)  # sum of squares of the p codes from here on
        later[: len(codes) - p + 1] = squares[p:] - squares[:-p]
        codes, later = codes.reshape(-1, p).T, later.reshape(-1, p).T
        blocks = codes.shape[1] - 2
        step = max(1, SLAB // (2 * p))
        found = []
        for low in range(0, blocks, step):
            high = min(low + step, blocks)
            f = self.forward(codes[:, low : high + 2])
            own, one, two = f[:, : high - low], f[:, 1 : high - low + 1], f[:, 2:]
            window = np.empty_like(own)  # the second following block stands p places on
            window[:p] = _sum(one[:p], two[:p])
            window[p:] = _sum(one[p:], _P - two[p:])
            product = self.first_half(_reduce(own[self.negated] * window))
            mismatch = later[0, low:high] + later[:, low + 1 : high + 1] - product - product
            shift, block = np.nonzero(mismatch == 0)
            found.append((block + low, shift + p))
        return tuple(np.concatenate(part) for part in zip(*found))


class Stretches:
    """Equality of stretches of words a distance apart, by running hashes."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words) + 1
        steps = np.full(n, _BASE)
        steps[0] = 1
        self.power = np.cumprod(steps)
        self.total = np.zeros(n, np.uint64)
        np.cumsum(mix(words) * self.power[:-1], out=self.total[1:])

    def same(self, start: np.ndarray, length: np.ndarray, distance: np.ndarray) -> np.ndarray:
        t, end = self.total, start + length
        return (t[end] - t[start]) * self.power[distance] == t[end + distance] - t[start + distance]

    def reach(self, at: np.ndarray, distance: np.ndarray, most: np.ndarray, left: bool) -> np.ndarray:
        """How many words from ``at`` on (to the left: before it) are equal, up to ``most``."""
        low, high = np.zeros_like(at), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            good = self.same(at - middle if left else at, middle, distance)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low


def _seeds(block: np.ndarray, distance: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring blocks with one distance: first block, number, distance, where long enough."""
    order = np.lexsort((block, distance))
    block, distance = block[order], distance[order]
    first = np.ones(len(block), bool)
    first[1:] = (distance[1:] != distance[:-1]) | (block[1:] != block[:-1] + 1)
    at = np.flatnonzero(first)
    count = np.diff(np.append(at, len(block)))
    block, distance = block[at], distance[at]
    long = (count + 2) * p - 2 >= (TIMES - 1) * distance
    return block[long], count[long], distance[long]


def runs_of(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of all runs in ``words``, sorted by start, then period.

    ``words`` holds texts of ``lengths`` words, longest text first, each followed by one mark that
    equals nothing else.
    """
    ends = np.cumsum(lengths + 1)
    known = [np.zeros(0, np.int64)] * 3
    p = 1
    while len(lengths) and lengths[0] >= max(LEAST, TIMES * p):
        within = words[: ends[np.searchsorted(-lengths, -max(LEAST, TIMES * p), side="right") - 1]]
        pad = -len(within) % p + 2 * p
        within = np.concatenate([within, mix(np.arange(pad, dtype=np.uint64) + ~_MARK)])
        block, distance = Scale(p).occurrences(within)
        if len(block):
            known = _add_runs(within, block, distance, p, known)
        p *= 2
    order = np.lexsort((known[2], known[0]))
    return tuple(part[order] for part in known)


def _add_runs(words, block, distance, p, known):
    """``known`` (starts, lengths, periods by start) with the runs of one scale."""
    hashes = Stretches(words)
    good = hashes.same(block * p, np.full_like(block, p), distance)
    block, count, distance = _seeds(block[good], distance[good], p)
    start, end = block * p, (block + count) * p
    start = start - hashes.reach(start, distance, np.minimum(start, p - 1), left=True)
    end = end + hashes.reach(end, distance, np.clip(len(words) - end - distance, 0, p - 1), left=False)
    length = end - start + distance
    long = length >= np.maximum(LEAST, TIMES * distance)
    if len(known[0]):
        farthest = np.maximum.accumulate(known[0] + known[1])
        before = np.searchsorted(known[0], start, side="right") - 1
        long &= (before < 0) | (farthest[before] < start + length)
    exact = [(words[s : s + n - d] == words[s + d : s + n]).all() for s, n, d in zip(start[long], length[long], distance[long])]
    new = [part[long][np.array(exact, bool)] for part in (start, length, distance)]
    known = [np.concatenate(pair) for pair in zip(known, new)]
    order = np.argsort(known[0], kind="stable")
    return [part[order] for part in known]


def _parts(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some MB at a time."""
    start = 0
    while start < len(raw):
        end = start + PART
        while end < len(raw) and not raw[end : end + 1].isspace():
            end += 1
        yield raw[start:end].split()
        start = end


def collapse(raw: bytes, starts: np.ndarray, lengths: np.ndarray, periods: np.ndarray, n: int) -> bytes:
    """Words joined by one space, without those that stand in a run after its first period."""
    turns = np.zeros(n + 1, np.int64)
    np.add.at(turns, starts + periods, 1)
    np.add.at(turns, starts + lengths, -1)
    stays = np.cumsum(turns[:-1]) == 0
    out, at = [], 0
    for part in _parts(raw):
        words = list(compress(part, stays[at : at + len(part)].tolist()))
        if words:
            out.append(b" ".join(words))
        at += len(part)
    return b" ".join(out)


def _judge(raws: list[bytes], hashes: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """Per text: number of words, runs (starts, lengths, periods), what stays."""
    lengths = np.array([len(h) for h in hashes])
    order = np.argsort(-lengths, kind="stable")
    marks = mix(np.arange(len(hashes), dtype=np.uint64) + _MARK)
    words = np.concatenate([part for i in order for part in (hashes[i], marks[i : i + 1])])
    starts, sizes, periods = runs_of(words, lengths[order])
    begins = np.concatenate([[0], np.cumsum(lengths[order] + 1)])
    bounds = np.searchsorted(starts, begins)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    for raw, n, at in zip(raws, lengths.tolist(), place.tolist()):
        own = slice(bounds[at], bounds[at + 1])
        first = starts[own] - begins[at]
        yield n, first, sizes[own], periods[own], collapse(raw, first, sizes[own], periods[own], n)


def periodic_runs(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep``, ``n_words``, arrays ``starts``, ``lengths``, ``periods`` of each row's runs, ``collapsed`` text."""
    own = ("n_words", "starts", "lengths", "periods", "collapsed")
    if set(own) & set(keep):
        raise ValueError(f"rename {sorted(set(own) & set(keep))} first")
    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    lists = [StructField(n, ArrayType(LongType(), False), False) for n in own[1:4]]
    names = [*keep, *own]

    def listed(arrays) -> pa.Array:
        ends = np.cumsum([0, *(len(a) for a in arrays)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays), pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, raws, hashes = 0, 0, [], []
            last = batch.num_rows - 1
            for row, raw in enumerate(raw_texts(batch.column("__text"))):
                raws.append(raw)
                hashes.append(word_hashes(raw))
                held += len(hashes[-1])
                if held >= GATHER or row == last:
                    n, *found, kept = zip(*_judge(raws, hashes))
                    columns = [batch.column(c).slice(first, len(raws)) for c in keep]
                    columns += [pa.array(n, pa.int64()), *map(listed, found), pa.array([k.decode("utf-8", "replace") for k in kept], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    first, held, raws, hashes = row + 1, 0, [], []

    fields = [*rows.drop("__text").schema.fields, StructField("n_words", LongType(), False), *lists, StructField("collapsed", StringType(), False)]
    return rows.mapInArrow(run, StructType(fields))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``; where 10 divides h = crc32(doc_id as text), the words from ``a`` on repeat.

    With g = h // 10 and n words, every word from a = g % n on becomes word a + (i - a) % p, where
    p = 1 + (n - a) // (3 + g % 8). Rows with a null id stay as they are.
    """

    def plant(texts: pa.Array, h: pa.Array) -> pa.Array:
        out = []
        for raw, value in zip(raw_texts(texts), h.to_pylist()):
            words = raw.split() if value is not None and value % 10 == 0 else []
            if words:
                g, n = value // 10, len(words)
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                unit = words[a : a + p]
                raw = b" ".join(words[:a] + (unit * (-(-(n - a) // p)))[: n - a])
            out.append(raw.decode("utf-8", "replace"))
        return pa.array(out, pa.string())

    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return docs.select("doc_id", F.arrow_udf(plant, "string")(F.col("text").cast("string"), h).alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """Digest columns of :func:`periodic_runs` over :func:`with_planted_runs`."""
    found = periodic_runs(with_planted_runs(docs))
    runs = F.arrays_zip("starts", "lengths", "periods")
    lines = F.transform(runs, lambda r: F.concat_ws(",", r["starts"], r["lengths"], r["periods"]))
    text = F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["lengths"].alias("n"), (-r["starts"]).alias("s"), (-r["periods"]).alias("q"))))
    return found.select("doc_id", "collapsed", F.size("starts").cast("long").alias("n_runs"), text.alias("lines"), best.alias("best")).select(
        "doc_id", "n_runs", (-F.col("best.s")).alias("start"), F.col("best.n").alias("length"), (-F.col("best.q")).alias("period"),
        F.expr("1000 * best.n div -best.q").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

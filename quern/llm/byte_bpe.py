"""Byte-level BPE: texts to token ids with character offsets, and ids back to bytes and text.

The vocabulary is a rank file: one line per token, its bytes in base 64 and its rank. From the
ranks the driver derives the merges (each token's last merge) and builds one definition for the
``tokenizers`` library; it is a few MB whatever the corpus and travels as a broadcast. Executors
need neither the file nor this package.

Encoding runs over Arrow batches. Every byte has a character that stands for it (`byte_chars`),
the library merges those, and ids are ranks. Offsets come from the token lengths: byte ends are
their running sum, and a count of first bytes turns byte places into code points. A character
whose bytes fall into several tokens belongs to each of them.

Most matches of the pattern come again and again, so a match is given to the library once and its
ids are kept on the worker, up to `KEPT` matches; new ones of a piece go in together. Matches are
found by the ``regex`` module. It may know other Unicode versions than the library: a worker first
asks both for the code points of each class, and texts with one they disagree on are cut by the library.

Long texts are cut where white space follows something else: no match of a pattern of this family
goes over such a place, so pieces give the same ids as the whole. A text without such a place is one
piece. Output leaves in batches of about `SLICE` tokens, texts in one batch or not.

Decoding looks up each id's bytes and joins them; UTF-8 is read after the join, so characters
split over tokens, or over lists that are concatenated first, come back whole.

Defined results: null and empty texts have no tokens; bytes that are not UTF-8 are read as U+FFFD;
special tokens in a text are ordinary text; rows that repeat an id are encoded each; decoding gives
U+FFFD for null ids and ids outside the vocabulary, empty bytes for a null list; an
empty table gives an empty table. Columns that are not asked for are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from quern.llm.common import per_worker, raw_texts

PIECE = 1 << 16
SLICE = 1 << 20
KEPT = 1 << 18
LOST = "�".encode()
APART = "\uFFFF"
GAP = re.compile(r"\S[ \t\n]")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def byte_chars() -> list[str]:
    """The character that stands for each byte: itself where visible, else the next one from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    later = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(later)) for b in range(256)]


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The pair that makes ``token`` once all lower ranks have merged; None if they never meet."""
    parts, own = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        pairs = [ranks.get(a + b, own) for a, b in zip(parts, parts[1:])]
        low = min(pairs)
        if low >= own:
            return None
        at = pairs.index(low)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


def definition(ranks: dict[bytes, int], pattern: str) -> str:
    """The library's JSON for these ranks, with ``pattern`` cutting texts before the merges."""
    chars = byte_chars()
    shown = lambda token: "".join(chars[b] for b in token)
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"the ranks lack {len(missing)} of 256 bytes")
    merges = []
    for token in sorted((t for t in ranks if len(t) > 1), key=ranks.get):
        pair = last_merge(token, ranks)
        if pair:
            merges.append((shown(pair[0]), shown(pair[1])))
    model = tokenizers.models.BPE(vocab={shown(t): r for t, r in ranks.items()}, merges=merges)
    whole = tokenizers.Tokenizer(model)
    cut = tokenizers.pre_tokenizers.Split(tokenizers.Regex(pattern), "isolated")
    whole.pre_tokenizer = tokenizers.pre_tokenizers.Sequence([cut, tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return whole.to_str()


class Encoder:
    """The library and what a worker keeps to call it less."""

    def __init__(self, made: str, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work out
        self.whole = tokenizers.Tokenizer.from_str(made)
        self.matches = tokenizers.Tokenizer.from_str(made)
        apart = tokenizers.pre_tokenizers.Split(APART, "removed")
        self.matches.pre_tokenizer = tokenizers.pre_tokenizers.Sequence([apart, tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.lengths = token_lengths(made)
        self.find = regex.compile(pattern).findall
        self.disputed = _disputed()
        self.kept: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self._part, pieces(text))), np.int32)

    def _part(self, text: str) -> bytes:
        if not text.isascii() and self.disputed[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
            return self._of(self.whole, text).tobytes()
        found = self.find(text)
        new = {match for match in found if match not in self.kept}
        if len(self.kept) + len(new) > KEPT:
            self.kept, new = {}, set(found)
        if new:
            self._learn(new)
        return b"".join(map(self.kept.__getitem__, found))

    @staticmethod
    def _of(tokenizer: tokenizers.Tokenizer, text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def _learn(self, new: set[str]) -> None:
        for match in [match for match in new if APART in match]:
            self.kept[match] = self._of(self.whole, match).tobytes()
            new.remove(match)
        if new:
            ids = self._of(self.matches, APART.join(new))
            ends = np.cumsum([len(match.encode()) for match in new])
            cuts = 4 * np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 4
            raw, low = ids.tobytes(), 0
            for match, high in zip(new, cuts.tolist()):
                self.kept[match] = raw[low:high]
                low = high


def _disputed() -> np.ndarray:
    """For each code point: do the ``regex`` module and the library differ on it in a class of the pattern?"""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, bool)
    for cls in (r"\p{L}", r"\p{N}", r"\s"):
        mine = regex.sub(cls, "", every)
        theirs = tokenizers.normalizers.Replace(tokenizers.Regex(cls), "").normalize_str(every)
        out |= _present(mine) ^ _present(theirs)
    return out


def _present(text: str) -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[np.frombuffer(text.encode("utf-32-le"), np.uint32)] = True
    return out


def token_bytes(made: str) -> list[bytes]:
    """Bytes of each id, and U+FFFD as one entry more."""
    back = {c: b for b, c in enumerate(byte_chars())}
    vocabulary = json.loads(made)["model"]["vocab"]
    tokens = [LOST] * (max(vocabulary.values()) + 2)
    for shown, rank in vocabulary.items():
        tokens[rank] = bytes(back[c] for c in shown)
    return tokens


def token_lengths(made: str) -> np.ndarray:
    return np.array([len(t) for t in token_bytes(made)], np.int64)


class Vocabulary:
    """A definition, broadcast once, and what both directions make of it on a worker."""

    def __init__(self, spark: SparkSession, path: str, pattern: str) -> None:
        made = definition(read_ranks(path), pattern)
        self.pattern = pattern
        self.mark = hashlib.sha256(made.encode()).hexdigest()
        self.made = spark.sparkContext.broadcast(made)

    def encoder(self) -> Encoder:
        return per_worker(f"byte-bpe {self.mark}", lambda: Encoder(self.made.value, self.pattern))

    def table(self) -> pa.Array:
        return per_worker(f"byte-bpe table {self.mark}", lambda: pa.array(token_bytes(self.made.value), pa.large_binary()))


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Cut before the first white space that follows something else, ``size`` characters on."""
    start = 0
    while len(text) - start > size:
        gap = GAP.search(text, start + size - 1)
        at = gap.start() + 1 if gap else len(text)
        yield text[start:at]
        start = at
    if start < len(text):
        yield text[start:]


def offsets_of(text: str, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First code point and the one after the last of each token."""
    data = np.frombuffer(text.encode(), np.uint8)
    count = np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)
    ends = np.cumsum(lengths[ids])
    starts = ends - lengths[ids]
    return (count[starts] - 1, count[ends - 1]) if len(ids) else (np.zeros(0, np.int32), np.zeros(0, np.int32))


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``ids``, ``starts``, ``ends`` (arrays of int) of each row."""
    clash = {"ids", "starts", "ends"} & set(keep)
    if clash:
        raise ValueError(f"rename {sorted(clash)} before encoding")
    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    lists = [StructField(n, ArrayType(IntegerType(), False), False) for n in ("ids", "starts", "ends")]
    names = [*keep, "ids", "starts", "ends"]

    def listed(arrays: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *(len(a) for a in arrays)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *arrays]), pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary.encoder()
        for batch in batches:
            first, held, found = 0, 0, []
            last = batch.num_rows - 1
            for row, raw in enumerate(raw_texts(batch.column("__text"))):
                value = raw.decode("utf-8", "replace")
                ids = encoder.ids(value)
                found.append((ids, *offsets_of(value, ids, encoder.lengths)))
                held += len(ids)
                if held >= SLICE or row == last:
                    kept = [batch.column(c).slice(first, len(found)) for c in keep]
                    yield pa.RecordBatch.from_arrays([*kept, *map(listed, zip(*found))], names=names)
                    first, held, found = row + 1, 0, []

    return rows.mapInArrow(run, StructType([*rows.drop("__text").schema.fields, *lists]))


def _bytes_of(ids: np.ndarray, known: np.ndarray, table: pa.Array) -> bytes:
    at = np.where(known & (ids >= 0) & (ids < len(table) - 1), ids, len(table) - 1)
    taken = table.take(pa.array(at))
    _, offsets, data = taken.buffers()
    ends = np.frombuffer(offsets, np.int64)[taken.offset : taken.offset + len(taken) + 1]
    return data.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes() if len(at) and data else b""


def _lists(ids: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Values and validity of each list; a null list is empty."""
    for value in ids:
        own = value.values if value.is_valid else pa.array([], pa.int32())
        yield own.fill_null(-1).to_numpy(zero_copy_only=False), own.is_valid().to_numpy(zero_copy_only=False)


def decoder(vocabulary: Vocabulary) -> Callable[[Column | str], Column]:
    """Column function: the bytes of a list of ids. ``decode(bytes, 'UTF-8')`` gives the text."""

    def run(ids: pa.Array) -> pa.Array:
        table = vocabulary.table()
        return pa.array([_bytes_of(values, known, table) for values, known in _lists(ids)], pa.binary())

    return F.arrow_udf(run, BinaryType())


def text_decoder(vocabulary: Vocabulary) -> Callable[[Column | str], Column]:
    """Column function: the text of a list of ids, U+FFFD where the bytes are not UTF-8."""

    def run(ids: pa.Array) -> pa.Array:
        table = vocabulary.table()
        return pa.array([_bytes_of(values, known, table).decode("utf-8", "replace") for values, known in _lists(ids)], pa.string())

    return F.arrow_udf(run, "string")


def _id_digest(ids: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(values.astype("<u4").tobytes()).hexdigest() for values, _ in _lists(ids)], pa.string())


def token_report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Token count, digests of ids and decoded bytes per row."""
    vocabulary = Vocabulary(docs.sparkSession, path, pattern)
    coded = encode(docs, vocabulary)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.arrow_udf(_id_digest, "string")("ids").alias("ids_sha256"),
        F.sha2(decoder(vocabulary)("ids"), 256).alias("decoded_sha256"),
    )

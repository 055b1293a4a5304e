"""SentencePiece encoding and decoding by a max-plus scan over chunks.

An encoding is the path of largest summed score through the lattice of
vocabulary pieces. A position between two chunks has L states (L: longest
piece): how many characters a piece from the left reaches across. A chunk is a
matrix over max and plus from its entry states to its exit states. Products of
such matrices are associative, so giant texts are cut into chunks, the chunks'
matrices are scanned, and with both boundary states known each chunk is traced
back on its own. No chunk sees more than L - 1 characters of the next.

Where no piece can cross (before a run of spaces after other characters, and
around line breaks) the lattice falls apart, and a segment between such places
has one best path wherever it stands; equal segments are solved once per task.

Scores are the vocabulary's own, with a small weight per piece below their
resolution that decides between equal sums; between orders of the same pieces
the path decides that ends in the shorter piece. Chunks are cut where no piece
can cross, so the cut shows nowhere; inside a run of more than a chunk without
such a place, only the order of equal pieces may depend on it. A character outside the vocabulary
becomes its UTF-8 bytes. The text gets a space in front, as the vocabulary's
own normaliser does; decoding takes it away, and returns every text exactly.
A literal U+2581 goes as bytes, because the vocabulary uses that mark for space.

Defined results: null and empty texts have no tokens and decode to an empty
text; rows that repeat an id each give a row; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import by_batch, identified, per_worker, public_id, raw_texts

CHUNK = 8192
UNREACHED = -(1 << 62)
FOREIGN = -1_000_000
NEVER = UNREACHED - (1 << 61)
_CACHE = 150_000
_WIDE = 32
_BLOCK = 8192


class Vocabulary:
    """Pieces, weights and byte pieces of a SentencePiece model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[int, int]] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        for i in range(model.get_piece_size()):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(text[3:5], 16)] = i
                self.bytes_of.append(bytes([int(text[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                plain = text.replace("▁", " ")
                score = max(int(model.get_score(i)), FOREIGN)
                self.pieces[plain] = (score * 4096 + ((i * 2654435761) >> 12 & 2047), i)
                self.bytes_of.append(plain.encode())
        self.longest = max(map(len, self.pieces), default=1)
        # every beginning of a piece: weight and id where it is a piece itself
        self.begins: dict[str, tuple[int, int] | None] = {p[:k]: None for p in self.pieces for k in range(1, len(p))}
        self.begins.update(self.pieces)
        inside = {p for p in self.pieces if " " in p.lstrip(" ")}
        if inside:
            raise ValueError(f"pieces that cross a space are not supported: {sorted(inside)[:3]}")
        self.alone = [c for c in "\n\r\t\v\f" if not any(c in p for p in self.pieces)]
        alone = re.escape("".join(self.alone))
        self.segment = re.compile(f" *[^ {alone}]+| +|[{alone}]" if alone else " *[^ ]+| +").findall
        self.foreign = FOREIGN * 4096
        lengths = np.array([len(b) for b in self.bytes_of])
        self.piece_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.piece_starts = np.cumsum(lengths) - lengths
        self.piece_lengths = lengths
        self._number_begins()

    def _number_begins(self) -> None:
        """The beginnings as numbered nodes, for many texts at once: node 0 is empty, the last is a foreign character."""
        begins = list(self.begins)
        number = {b: i for i, b in enumerate(begins, 1)} | {"": 0}
        letters = {c: i for i, c in enumerate(sorted({b[-1] for b in begins}), 1)}
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = list(letters.values())
        self.letters = len(letters) + 1
        self.known = np.zeros(self.letters, bool)
        self.known[[i for c, i in letters.items() if c in self.pieces]] = True
        edges = np.array([number[b[:-1]] * self.letters + letters[b[-1]] for b in begins], np.int64)
        order = np.argsort(edges)
        self.edges, self.follows = edges[order], order + 1
        found = [self.begins[b] or (NEVER, -1) for b in begins]
        self.node_weight = np.array([NEVER, *(w for w, _ in found), self.foreign], np.int64)
        self.node_id = np.array([-1, *(i for _, i in found), -1], np.int32)
        self.node_length = np.array([0, *map(len, begins), 1], np.int64)

    def is_gap(self, text: str, at: int) -> bool:
        """Whether no piece can cross this place of the text (1 to its length)."""
        if at == len(text):
            return True
        before, after = text[at - 1], text[at]
        return before in self.alone or after in self.alone or (after == " " and before != " ")

    def next_gap(self, text: str, at: int) -> int:
        while not self.is_gap(text, at):
            at += 1
        return at

    def last_gap(self, text: str, at: int) -> int:
        while at > 0 and not self.is_gap(text, at):
            at -= 1
        return at

    def _pieces_from(self, letters: np.ndarray, left: np.ndarray) -> list[np.ndarray]:
        """For each piece length, the node of the piece that starts at each character, or 0."""
        out = []
        at, node = np.arange(len(letters)), np.zeros(len(letters), np.int64)
        for length in range(1, self.longest + 1):
            inside = left[at] >= length
            at, node = at[inside], node[inside]
            key = node * self.letters + letters[at + (length - 1)]
            place = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            hit = self.edges[place] == key
            at, node = at[hit], self.follows[place[hit]]
            whole = self.node_id[node] >= 0
            found = np.zeros(len(letters), np.int32)
            found[at[whole]] = node[whole]
            if length == 1:
                found[~self.known[letters]] = len(self.node_id) - 1
            out.append(found)
            if not len(at):
                break
        return out

    def best_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`best` for many texts at once, given longest first, none empty.

        Ids of all in one array, and how many each has; none for a text whose
        path holds a foreign character.
        """
        sizes = np.array([len(t) for t in texts])
        letters = self.letter[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
        starts = np.cumsum(sizes) - sizes
        found = self._pieces_from(letters, np.repeat(starts + sizes, sizes) - np.arange(len(letters)))
        width = int(sizes[0])
        reach = np.searchsorted(-sizes, -np.arange(width + 1), side="right")  # texts of at least so many characters
        score = np.full((width + 1, len(texts)), UNREACHED, np.int64)
        step = np.zeros((width + 1, len(texts)), np.int32)
        score[0] = 0
        for start in range(width):
            for length, nodes in enumerate(found[: width - start], 1):
                stop = start + length
                own = nodes[starts[: reach[stop]] + start]
                which = np.flatnonzero(own)
                own = own[which]
                new = score[start, which] + self.node_weight[own]
                better = new > score[stop, which]
                which = which[better]
                score[stop, which], step[stop, which] = new[better], own[better]
        ids = np.empty((len(texts), width), np.int32)
        counts, at, live, column = np.zeros(len(texts), np.int64), sizes.copy(), np.arange(len(texts)), width
        while len(live):
            column -= 1
            node = step[at[live], live]
            ids[live, column] = self.node_id[node]
            counts[live] += 1
            at[live] -= self.node_length[node]
            live = live[at[live] > 0]
        used = np.arange(width) >= width - counts[:, None]
        counts[((ids < 0) & used).any(1)] = 0
        return ids[np.arange(width) >= width - counts[:, None]], counts

    def best(self, text: str, last_start: int | None = None) -> tuple[int, list[int]]:
        """Score and ids of the best path; the last piece must start before ``last_start``."""
        n = len(text)
        last_start = n if last_start is None else min(n, last_start)
        score, came, piece = [UNREACHED] * (n + 1), [-1] * (n + 1), [None] * (n + 1)
        score[0] = 0
        begins = self.begins
        for start in range(last_start):
            here = score[start]
            if here == UNREACHED:
                continue
            if text[start] not in self.pieces:  # a foreign character is one edge
                stop = start + 1
                if (stop == n or stop < last_start) and here + self.foreign > score[stop]:
                    score[stop], came[stop], piece[stop] = here + self.foreign, start, -1
            for stop in range(start + 1, n + 1):
                found = begins.get(text[start:stop], UNREACHED)
                if found is None:
                    continue
                if found == UNREACHED:  # no piece begins like this
                    break
                if here + found[0] > score[stop] and (stop == n or stop < last_start):
                    score[stop], came[stop], piece[stop] = here + found[0], start, found[1]
        if n and came[n] < 0:
            return UNREACHED, []
        ids: list[int] = []
        at = n
        while at:
            start = came[at]
            if piece[at] >= 0:
                ids.append(piece[at])
            else:
                ids.extend(self.byte_ids[b] for b in reversed(text[start:at].encode()))
            at = start
        ids.reverse()
        return score[n], ids


class Encoder:
    """Solves segments once; a full cache starts anew."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.number: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self.number.clear()
        self.starts, self.flat = array("q", [0]), array("i")

    def numbers(self, segments: list[str]) -> np.ndarray:
        if len(self.number) > _CACHE:
            self.reset()
        number, vocabulary = self.number, self.vocabulary
        new = sorted(set(segments).difference(number), key=len, reverse=True)
        wide = bisect_left(new, -_WIDE, key=lambda s: -len(s))
        single = new[:wide]
        for at in range(wide, len(new), _BLOCK):
            block = new[at : at + _BLOCK]
            flat, counts = vocabulary.best_of(block)
            number.update(zip(block, range(len(self.starts) - 1, len(self.starts) - 1 + len(block))))
            self.starts.frombytes((len(self.flat) + np.cumsum(counts)).astype(np.int64).tobytes())
            self.flat.frombytes(flat.astype(np.int32).tobytes())
            single.extend(block[i] for i in np.flatnonzero(counts == 0))
        for segment in single:
            number[segment] = len(self.starts) - 1
            self.flat.extend(vocabulary.best(segment)[1])
            self.starts.append(len(self.flat))
        return np.fromiter(map(number.__getitem__, segments), np.int64, len(segments))

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(self.starts, np.int64), np.frombuffer(self.flat or array("i", [0]), np.int32)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each has. Texts start and end between segments."""
        segment = self.vocabulary.segment
        parts = [segment(t) for t in texts]
        counts = np.array([len(p) for p in parts], np.int64)
        which = self.numbers([s for p in parts for s in p])
        starts, flat = self.tables()
        return _gathered(starts[which], starts[which + 1], flat, counts)


def vocabulary_of(path: str) -> Vocabulary:
    """One per Python worker, for all its tasks."""
    return per_worker(f"sentencepiece vocabulary {path}", lambda: Vocabulary(path))


def encoder_of(path: str) -> Encoder:
    return per_worker(f"sentencepiece encoder {path}", lambda: Encoder(vocabulary_of(path)))


def _gathered(starts, ends, flat, counts) -> tuple[np.ndarray, np.ndarray]:
    sizes = ends - starts
    total = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(total[-1]) + np.repeat(starts - total[:-1], sizes)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    return flat[at], total[bounds[1:]] - total[bounds[:-1]]


def transfer(vocabulary: Vocabulary, text: str, length: int) -> np.ndarray:
    """Matrix of a chunk of ``length`` characters; ``text`` holds up to L - 1 more.

    Segments that lie wholly inside add the same to every entry, which changes
    no choice, so they are left out.
    """
    states = vocabulary.longest
    out = np.full((states, states), UNREACHED, np.int64)
    first = vocabulary.next_gap(text, 1)
    if first > length:
        for i in range(min(states, length)):
            for j in range(min(states, len(text) - length + 1)):
                out[i, j] = vocabulary.best(text[i : length + j], length - i)[0]
        return out
    last = vocabulary.last_gap(text, length)
    end = vocabulary.next_gap(text, last + 1) if last < len(text) else last
    heads = [0 if i == first else vocabulary.best(text[i:first])[0] for i in range(min(states, first + 1))]
    for j in range(min(states, end - length + 1)):
        tail = 0 if length == last and j == 0 else vocabulary.best(text[last : length + j], length - last)[0]
        if tail == UNREACHED:
            continue
        for i, head in enumerate(heads):
            if head != UNREACHED:
                out[i, j] = head + tail
    return out


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of two stacks of matrices, some at a time."""
    out = np.empty_like(a)
    for at in range(0, len(a), 256):
        x, y = a[at : at + 256, :, :, None], b[at : at + 256, None, :, :]
        out[at : at + 256] = np.where((x == UNREACHED) | (y == UNREACHED), UNREACHED, x + y).max(2)
    return out


def scan(matrices: np.ndarray) -> np.ndarray:
    """Products of the first 1, 2, 3, ... matrices, doubling the reach in each step."""
    out, reach = matrices.copy(), 1
    while reach < len(out):
        out[reach:] = times(out[:-reach], out[reach:])
        reach *= 2
    return out


def boundary_states(matrices: np.ndarray) -> np.ndarray:
    """State at each boundary of the best path, from 0 before the first chunk to 0 after the last."""
    prefix = scan(matrices)[:, 0, :]
    states = np.zeros(len(matrices) + 1, np.int64)
    for k in range(len(matrices) - 1, 0, -1):
        into = matrices[k][:, states[k + 1]]
        both = np.where((prefix[k - 1] == UNREACHED) | (into == UNREACHED), UNREACHED, prefix[k - 1] + into)
        states[k] = int(both.argmax())
    return states


def traces(encoder: Encoder, chunks: list[tuple[str, int, int, int]]) -> list[np.ndarray]:
    """Ids of the pieces that start in each chunk ``(text, length, enter, leave)``, between its two boundary states."""
    vocabulary = encoder.vocabulary
    bodies, rests = [], []
    for text, length, enter, leave in chunks:
        body = text[enter : length + leave]
        cut = vocabulary.last_gap(body, min(length - enter, len(body)))
        bodies.append(body[:cut])
        rests.append(vocabulary.best(body[cut:], length - enter - cut)[1] if cut < len(body) else [])
    flat, counts = encoder.ids(bodies)
    return [np.concatenate((ids, np.array(rest, np.int32))) for ids, rest in zip(np.split(flat, np.cumsum(counts)[:-1]), rests)]


def decode(vocabulary: Vocabulary, ids: np.ndarray) -> bytes:
    """Bytes of the pieces, without the space in front."""
    lengths = vocabulary.piece_lengths[ids]
    total = np.cumsum(lengths) - lengths
    size = int(lengths.sum())
    at = np.arange(size) + np.repeat(vocabulary.piece_starts[ids] - total, lengths)
    return vocabulary.piece_bytes[at].tobytes()[1:]


def _prepared(raw: bytes) -> str:
    return " " + raw.decode() if raw else ""


_ids_type = pa.list_(pa.int32())


_KEY = ["id", "mark"]


def _encode_short(path: str):
    """Texts of one chunk, straight away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                flat, counts = encoder.ids([_prepared(raw) for raw in raw_texts(part.column("text"))])
                offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
                ids = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("mark"), ids], names=[*_KEY, "ids"])

    return run


def cuts(text: str, chunk: int) -> list[int]:
    """Starts of chunks of about ``chunk`` characters, where no piece can cross if there is such a place."""
    out, at = [0], chunk
    while at < len(text) - chunk // 2:
        place = text.rfind(" ", at - chunk // 2, at)
        while place > 0 and text[place - 1] == " ":
            place -= 1
        out.append(place if place > at - chunk // 2 else at)
        at = out[-1] + chunk
    return out


def _chunks(path: str, chunk: int):
    schema = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("part", pa.int64()), ("length", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = vocabulary_of(path).longest - 1
        for batch in batches:
            for doc, mark, raw in zip(*(batch.column(c).to_pylist() for c in _KEY), raw_texts(batch.column("text"))):
                text = _prepared(raw)
                starts = cuts(text, chunk)
                ends = [*starts[1:], len(text)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([doc] * len(starts), pa.int64()), pa.array([mark] * len(starts), pa.int64()), pa.array(range(len(starts)), pa.int64()),
                    pa.array([b - a for a, b in zip(starts, ends)], pa.int64()),
                    pa.array([text[a : b + reach] for a, b in zip(starts, ends)])], schema=schema)

    return run


def _matrices(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(path)
        for batch in batches:
            out = [transfer(vocabulary, t, n).tobytes() for t, n in zip(batch.column("text").to_pylist(), batch.column("length").to_pylist())]
            columns = [batch.column(c) for c in (*_KEY, "part")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary())], names=[*_KEY, "part", "matrix"])

    return run


def _states(table: pa.Table) -> pa.Table:
    """Boundary states of one text; chunks of repeated rows are equal and count once."""
    by_part = dict(zip(table.column("part").to_pylist(), table.column("matrix").to_pylist()))
    raw = [by_part[k] for k in sorted(by_part)]
    size = int((len(raw[0]) // 8) ** 0.5)
    states = boundary_states(np.frombuffer(b"".join(raw), np.int64).reshape(-1, size, size))
    key = {c: pa.array([table.column(c)[0].as_py()] * len(raw), pa.int64()) for c in _KEY}
    return pa.table({**key, "part": pa.array(range(len(raw)), pa.int64()), "enter": states[:-1], "leave": states[1:]})


def _traces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                columns = [part.column(c).to_pylist() for c in ("text", "length", "enter", "leave")]
                ids = traces(encoder, list(zip(*columns)))
                offsets = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (*_KEY, "part")), ids], names=[*_KEY, "part", "ids"])

    return run


def encode(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """``(id, mark, ids)`` per row of ``docs(id, mark, text)``."""
    size = F.coalesce(F.length("text"), F.lit(0))
    short = docs.where(size < chunk).mapInArrow(_encode_short(path), "id long, mark long, ids array<int>")
    chunks = docs.where(size >= chunk).mapInArrow(_chunks(path, chunk), "id long, mark long, part long, length long, text string")
    matrices = chunks.mapInArrow(_matrices(path), "id long, mark long, part long, matrix binary")
    states = matrices.groupBy(*_KEY).applyInArrow(_states, "id long, mark long, part long, enter long, leave long")
    traced = chunks.join(states, [*_KEY, "part"]).mapInArrow(_traces(path), "id long, mark long, part long, ids array<int>")
    parts = traced.groupBy(*_KEY).agg(F.collect_list(F.struct("part", "ids")).alias("found"))
    parts = parts.withColumn("parts", F.sort_array(F.array_distinct("found")))
    again = F.sequence(F.lit(1), F.expr("cast(size(found) / size(parts) as int)"))  # a row for each repeated row
    giant = parts.select(*_KEY, F.flatten("parts.ids").alias("ids"), F.explode(again).alias("copy")).drop("copy")
    return short.union(giant)


def _report(path: str):
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batch: pa.RecordBatch) -> dict:
        vocabulary = vocabulary_of(path)
        counts, ids_sha, text_sha = [], [], []
        for ids in batch.column("ids"):
            own = ids.values.to_numpy(zero_copy_only=False).astype(np.int32)
            counts.append(len(own))
            ids_sha.append(hashlib.sha256(own.astype("<i4").tobytes()).hexdigest())
            text_sha.append(hashlib.sha256(decode(vocabulary, own)).hexdigest())
        return {"id": batch.column("id"), "n_tokens": counts, "ids_sha256": ids_sha, "decoded_sha256": text_sha}

    return by_batch(run, schema)


def token_report(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """Per row: number of ids, digests of the ids (little-endian 32 bit) and of the text they decode to."""
    done = encode(identified(docs), path, chunk).select("id", "ids")
    done = done.mapInArrow(_report(path), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return done.select(public_id().alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")

"""Byte-level BPE, Merkle manifest and periodic runs against a library and brute force, on odd tables."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from quern.llm import byte_bpe, merkle_manifest, periodic_runs
from quern.llm.hashing import word_hashes
from quern.llm.queries import RANKS

WORD = "[^\x20\x09-\x0D]+"
PATTERN = public_tokenizers.PATTERN
LONG = "  \n\nwords, 'll 12 été 日本語 " * 60_000 + "x" * 200_000 + " " * 100_000 + "日本" * 50_000 + "🙂" * 9
TEXTS = [
    (1, None), (2, ""), (3, " \t\n "), (4, "One two"), (5, "don't  stop\r\n\r\n it's 12345"), (5, "don't  stop\r\n\r\n it's 12345"),
    (None, "é日本🙂    x\u0085y <|endoftext|>"), (7, LONG), (8, "=" * 1000 + "-" * 77), (9, "\x00\x1c\x1d a\x0bb\x0cc"),
]


def sha(raw):
    return hashlib.sha256(raw if isinstance(raw, bytes) else raw.encode()).hexdigest()


def table(spark, rows, schema="doc_id long, text string"):
    """Rows with extra columns whose names the operators use inside."""
    extra = ["ids", "starts", "ends", "tree", "place", "digest", "n", "run", "lengths", "collapsed", "group", "id", "claimed", "level"]
    frame = spark.createDataFrame(rows, schema)
    return frame.select("*", *[F.lit(7).alias(c) for c in extra]).repartition(3)


@pytest.fixture(scope="module")
def library():
    lines = [line.split() for line in open(RANKS, "rb")]
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in lines}, special_tokens={})


def key(row):
    return tuple((v is not None, v) if v is not None else (False, 0) for v in row)


def test_tokens_equal_the_library(spark, library):
    got = [tuple(r) for r in byte_bpe.token_report(table(spark, TEXTS), RANKS, PATTERN).collect()]
    want = []
    for doc_id, text in TEXTS:
        ids = library.encode_ordinary(text or "")
        want.append((doc_id, len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)), sha(text or "")))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_tokens_of_random_texts(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT", 3000)
    encoder = byte_bpe.Encoder(byte_bpe.definition(byte_bpe.read_ranks(RANKS), PATTERN), PATTERN)
    r, tokens = random.Random(3), [library.decode([i]) for i in range(0, 50_000, 7)]
    for n in range(6000):
        text = "".join(r.choice(tokens) * (r.randrange(1, 30) if n % 2 else 1) for _ in range(r.randrange(1, 8)))
        assert encoder.ids(text).tolist() == library.encode_ordinary(text)
    assert len(encoder.kept) <= 3000
    odd = np.flatnonzero(encoder.disputed).tolist()
    for text in ["\uffff", "a\uffffb 'll", *(f"a{chr(c)}b1 {chr(c)} {chr(c)}{chr(c)}1" for c in [*odd[::40], *range(0, 0xD800, 61), *range(0x10000, 0x110000, 997)])]:
        assert encoder.ids(text).tolist() == library.encode_ordinary(text)


def test_pieces_do_not_show(library):
    r = random.Random(4)
    text = "".join(r.choice([" ", "\n", "a", "b'll", "1", "é", ".", "　", "\x1c"]) for _ in range(4000))
    parts = list(byte_bpe.pieces(text, 16))
    assert len(parts) > 50 and "".join(parts) == text
    assert [i for p in parts for i in library.encode_ordinary(p)] == library.encode_ordinary(text)


def test_offsets_and_split_characters(spark, library):
    vocabulary = byte_bpe.Vocabulary(spark, RANKS, PATTERN)
    rows = [(1, "plain words"), (2, "a🙂b 𓀀𓀁"), (3, None)]
    coded = byte_bpe.encode(table(spark, rows), vocabulary)
    for row in coded.collect():
        text = dict(rows)[row.doc_id] or ""
        place = [c for c, x in enumerate(text) for _ in x.encode()]
        at = 0
        for token, start, end in zip(row.ids, row.starts, row.ends):
            size = len(library.decode_single_token_bytes(token))
            assert (start, end) == (place[at], place[at + size - 1] + 1)
            at += size
        assert at == len(text.encode())
    both = coded.select("doc_id", byte_bpe.text_decoder(vocabulary)("ids").alias("whole"), F.slice("ids", 1, 2).alias("a"),
                        F.expr("slice(ids, 3, 1000)").alias("b"), "starts", "ends")
    both = both.select("*", byte_bpe.decoder(vocabulary)(F.concat("a", "b")).alias("again"))
    found = {r.doc_id: r for r in both.collect()}
    assert {i: found[i].whole for i in found} == {1: "plain words", 2: "a🙂b 𓀀𓀁", 3: ""}
    assert bytes(found[2].again).decode() == "a🙂b 𓀀𓀁"  # a character cut between the lists comes back
    assert any(a < b for a, b in zip(found[2].starts[1:], found[2].ends))  # one character in several tokens


def test_decoding_odd_ids(spark):
    vocabulary = byte_bpe.Vocabulary(spark, RANKS, PATTERN)
    ids = spark.createDataFrame([(1, [None, 64]), (2, [-5, 10**6]), (3, None), (4, [])], "k int, ids array<int>")
    got = {r.k: r.text for r in ids.select("k", byte_bpe.text_decoder(vocabulary)("ids").alias("text")).collect()}
    assert got[1][0] == "�" and len(got[1]) == 2 and got[2] == "��" and got[3] == got[4] == ""


def test_bytes_that_are_not_utf8(spark, library):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text")
    row = byte_bpe.token_report(docs, RANKS, PATTERN).first()
    assert (row.n_tokens, row.decoded_sha256) == (len(library.encode_ordinary("a�b")), sha("a�b"))


def test_ranks_without_a_byte():
    with pytest.raises(ValueError):
        byte_bpe.definition({b"a": 0}, PATTERN)


def test_names_that_clash(spark):
    docs = table(spark, TEXTS[:2])
    with pytest.raises(ValueError):
        byte_bpe.encode(docs, None, keep=["doc_id", "ids"])
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs, keep=["starts"])


FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def proved(rows):
    """Brute force: trees as lists of lists."""
    leaf = lambda r: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
        return levels

    def climb(levels, i, folded):
        siblings = ""
        for nodes in levels[:-1]:
            run, slot = nodes[i // 3 * 3 : i // 3 * 3 + 3], i % 3
            siblings += "".join(run[:slot] + run[slot + 1 :])
            folded, i = sha("".join(run[:slot] + [folded] + run[slot + 1 :])), i // 3
        return siblings, folded

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [tree([leaf(r) for r in groups[g]]) for g in names]
    top, out = tree([t[-1][0] for t in trees]), []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            below, folded = climb(trees[k], i, leaf((*r[:4], r[4].replace("\n", "")) if hit else r))
            above, folded = climb(top, k, folded)
            out.append((r[0], leaf(r), trees[k][-1][0], top[-1][0], sha(below + above), folded, folded == top[-1][0]))
    return sorted(out, key=key)


def manifest_rows(spark, rows):
    return sorted((tuple(r) for r in merkle_manifest.manifest_report(table(spark, rows, FIELDS)).collect()), key=key)


@pytest.mark.parametrize("sources, n", [(1, 1), (1, 3), (1, 4), (2, 2), (5, 60), (40, 400)])
def test_manifest(spark, sources, n):
    r = random.Random(n)
    hot = lambda: r.choice(["s0", f"s{r.randrange(sources)}"])
    rows = [(i, hot(), r.choice(["en", None]), r.choice([None, i]), "\n".join(["é a"] * r.randrange(4))) for i in range(n)]
    got = manifest_rows(spark, rows)
    assert got == proved(rows)


def test_manifest_of_odd_rows(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (1, None, "en", 3, "a\nb"), (None, "ä", "en", 0, ""), (None, "z", None, 1, "\n"),
            (2, "", "", 0, "x\n" * 300_000), (3, "Z", "de", 2, "no break"), (4, "￿", "de", 2, "a\n"), (6, "🙂", "de", 2, "a\n"), (-9, "", "a", 1, "\n\n")]
    got = manifest_rows(spark, rows)
    assert got == proved(rows)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_spreads_a_hot_source(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "'one' AS source", "'en' AS lang", "id AS n_chars", "'t' AS text")
    placed = merkle_manifest.numbered(rows.repartition(5), "source", ["source", "doc_id"])
    assert [(r.doc_id, r.place) for r in placed.orderBy("doc_id").collect()] == [(i, i) for i in range(4000)]
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    built = merkle_manifest.build(rows, [F.col(c) for c in merkle_manifest.COLUMNS])
    assert merkle_manifest.proofs(built).where("folded_root = root").count() == 4000
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before
    nodes = built.nodes
    up = nodes.alias("a").join(nodes.alias("b"), F.expr("a.up_tree = b.tree AND a.up_level = b.level AND a.up_place = b.place"))
    linked = up.select(merkle_manifest.fold("a.children").alias("d"), F.expr("b.children[a.up_slot]").alias("e"))
    assert linked.count() == nodes.count() - 1 and linked.where("d <> e").count() == 0


def runs_by_force(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            start = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            size = i - start + q
            if i > start and size >= max(6, 4 * q) and not any(w[start : start + size - s] == w[start + s : start + size] for s in range(1, q)):
                out.append((start, size, q))
            i = max(i, start + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def report_by_force(doc_id, text):
    w = re.findall(WORD, text or "")
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
    runs = runs_by_force(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *four, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def repetitive(r):
    letters = r.choice([1, 2, 3, 1000])
    w = [str(r.randrange(letters)) for _ in range(r.randrange(40))]
    for _ in range(r.randrange(5)):
        unit = [str(r.randrange(letters)) for _ in range(r.randrange(1, 30))]
        w += (unit * r.randrange(1, 8))[: r.randrange(1, 200)]
    return r.choice([" ", "\n", " \t"]).join(w)


def test_runs(spark):
    r = random.Random(6)
    rows = [(i, repetitive(r)) for i in range(150)] + TEXTS[:6] + [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(200))) for i in range(200, 260)]
    got = [tuple(x) for x in periodic_runs.run_report(table(spark, rows)).collect()]
    want = [report_by_force(*x) for x in rows]
    assert sum(x[1] for x in want) > 100
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("slab", [8, 1 << 18])
def test_slabs_do_not_show(slab, monkeypatch):
    monkeypatch.setattr(periodic_runs, "SLAB", slab)
    monkeypatch.setattr(periodic_runs, "PART", 16)
    r = random.Random(8)
    texts = [repetitive(r) for _ in range(40)]
    raws = [t.encode() for t in texts]
    for text, (n, *found, kept) in zip(texts, periodic_runs._judge(raws, [word_hashes(x) for x in raws])):
        w = text.split()
        want = runs_by_force(w)
        gone = {i for s, size, q in want for i in range(s + q, s + size)}
        assert n == len(w) and list(zip(*[x.tolist() for x in found])) == want
        assert kept.decode() == " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_in_long_texts():
    unit = [f"w{i}" for i in range(30_011)]
    w = ["a"] + unit * 4 + ["b"] * 5 + unit * 3 + ["c"] * 100_000
    raw = " ".join(w).encode()
    (n, starts, lengths, periods, kept), = periodic_runs._judge([raw], [word_hashes(raw)])
    assert list(zip(starts.tolist(), lengths.tolist(), periods.tolist())) == [(1, 4 * 30_011, 30_011), (7 * 30_011 + 6, 100_000, 1)]
    assert kept == " ".join(["a"] + unit + ["b"] * 5 + unit * 3 + ["c"]).encode()


def test_transform_is_exact():
    r = np.random.default_rng(1)
    for p in (1, 2, 8, 64, 2048):
        scale = periodic_runs.Scale(p)
        x = r.integers(0, periodic_runs.PRIME, (p, 3)).astype(np.uint64)
        assert (scale.first_half(scale.forward(x)) == x).all()
        words = r.integers(0, 2**63, 7 * p).astype(np.uint64)
        words[3 * p : 4 * p] = words[p : 2 * p]
        found = set(zip(*[x.tolist() for x in scale.occurrences(words)]))
        codes = words % scale.codes
        want = {(b, d) for b in range(5) for d in range(p, 2 * p) if (codes[b * p : b * p + p] == codes[b * p + d : b * p + d + p]).all()}
        assert found == want


@pytest.mark.parametrize("name", ["byte_bpe", "merkle_manifest", "periodic_runs"])
def test_empty_tables(spark, name):
    docs = spark.createDataFrame([], FIELDS)
    report = {"byte_bpe": lambda d: byte_bpe.token_report(d, RANKS, PATTERN), "merkle_manifest": merkle_manifest.manifest_report,
              "periodic_runs": periodic_runs.run_report}[name]
    assert report(docs).collect() == []

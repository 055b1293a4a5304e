"""Corpus operators against SQL, brute force, round trips and odd tables."""

import hashlib
import math
import os
import random
import re
import subprocess
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from quern.llm import decontaminate, embedding_dedup, jaccard_join, licenses, line_dedup, pii, sentencepiece_scan, substring_dedup, toxicity, warc_audit
from quern.llm.common import identified
from quern.llm.queries import QUERIES, SQL, TOKENIZER
from tests.oracle import compare, connect

SMALL = "/root/testdata/sf0.001"
WORD = "[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, id string, mark int, component string, n int, kept int, starts int, gone int, spans int, score int"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, SMALL, name, QUERIES[name], SQL.get(name)) in ("", "no rows", "no rows on either side")


def table(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, 3, 4, 5, 6, 7) for i, t in rows], SCHEMA).repartition(3)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def passage(seed, n=70):
    r = random.Random(seed)
    return [r.choice("abcdefghij") + str(r.randrange(500)) for _ in range(n)]


ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "One two"), (5, " ".join(passage(1))), (5, " ".join(passage(1))),
    (6, "x " + "\n".join(passage(1)) + " y"), (7, " ".join(passage(1)[:40] + ["new"] + passage(1)[40:])),
    (8, " ".join(passage(1)).upper()), (None, " ".join(passage(1))), (9, "äö▁ 日本 " * 40), (10, "z" * 30_000),
    (11, "A line that is long enough\nshort\nA line that is long enough"), (12, " a LINE that is long enough\t\nother"),
    (13, "a line that is long enough"), (14, "\n".join(["a line that is long enough"] * 3)),
]


def test_line_dedup(spark):
    got = sorted((10**9 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.line_report(table(spark, ODD)).collect())
    key = lambda line: lower(line.strip(" \t\n\r\x0b\x0c"))
    rows = [(10**9 if i is None else i, t or "") for i, t in ODD]
    holders = defaultdict(set)
    for i, t in rows:
        for line in t.split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    want = []
    for i, t in rows:
        lines = t.split("\n")
        stay = [x for x in lines if not (len(holders.get(key(x), ())) >= 3 and max(holders[key(x)]) != i)]
        want.append((i, len(lines), len(lines) - len(stay), sha("\n".join(stay))))
    assert got == sorted(want)


def test_rewrite_keeps_columns(spark):
    docs = table(spark, ODD)
    out = line_dedup.rewrite(docs)
    assert out.columns == docs.columns and out.count() == len(ODD)
    assert {r.doc_id: r.text for r in out.collect()}[11] == "short"


def removed(rows, span):
    low = {}
    words = [(i, re.findall(WORD, t or "")) for i, t in rows]
    for i, w in words:
        for p in range(len(w) - span + 1):
            k = tuple(w[p : p + span])
            low[k] = min(low.get(k, i), i)
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - span + 1):
            if low[tuple(w[p : p + span])] < i:
                gone.update(range(p, p + span))
        out.append((i, len(w), len(gone), sha(" ".join(x for q, x in enumerate(w) if q not in gone))))
    return sorted(out)


@pytest.mark.parametrize("group", [1, 64])
def test_substrings(spark, group):
    rows = [(10**9 if i is None else i, t) for i, t in ODD] + [(100 + k, " ".join(passage(k, 20) + passage(1)[5 : 5 + 45 + k] + passage(50 + k, 30))) for k in range(12)]
    docs = identified(table(spark, rows))
    starts = substring_dedup.repeated_windows(docs, group=group)
    out = docs.join(starts, ["id", "mark"], "left").select("id", "mark", "text", "starts").mapInArrow(
        substring_dedup._cut(50), "id long, mark long, n_words long, n_removed long, kept string")
    assert sorted((r.id, r.n_words, r.n_removed, sha(r.kept)) for r in out.collect()) == removed(rows, 50)


def test_repetitive_texts(spark):
    rows = [(i, " ".join(["0"] * 2000 + passage(i) + ["|", "0"] * 500)) for i in range(3)]
    docs = identified(table(spark, rows))
    sizes = Counter(r.key for r in substring_dedup.pieces_by_prefix(docs).where("piece is not null").select("key").collect())
    assert max(sizes.values(), default=0) <= substring_dedup.GROUP
    starts = substring_dedup.repeated_windows(docs)
    out = docs.join(starts, ["id", "mark"], "left").select("id", "mark", "text", "starts").mapInArrow(
        substring_dedup._cut(50), "id long, mark long, n_words long, n_removed long, kept string")
    assert sorted((r.id, r.n_words, r.n_removed, sha(r.kept)) for r in out.collect()) == removed(rows, 50)


def test_parts_of_pieces_do_not_show(spark, monkeypatch):
    """Rows leave in many small parts, and null ids do not share one set of anchors."""
    monkeypatch.setattr(substring_dedup, "_PART_BYTES", 600)
    rows = [(10**9 if i is None else i, t) for i, t in ODD] + [(k, " ".join(passage(k, 30) + passage(1) * 3 + ["0"] * 300)) for k in range(20, 26)]
    docs = identified(table(spark, rows + [(None, " ".join(passage(60 + k))) for k in range(30)]))
    wanted = substring_dedup.pieces_by_prefix(docs.where("id < 1000000000"))
    assert wanted.count() > 100
    starts = substring_dedup.repeated_windows(docs)
    out = docs.join(starts, ["id", "mark"], "left").select("id", "mark", "text", "starts").mapInArrow(
        substring_dedup._cut(50), "id long, mark long, n_words long, n_removed long, kept string")
    got = sorted((r.id, r.n_words, r.n_removed, sha(r.kept)) for r in out.where(f"id < {2**62}").collect())
    assert got == removed(rows, 50)


def test_prefix_classes():
    r = np.random.default_rng(1)
    values = r.integers(0, 3, 400).astype(np.uint64)
    node = substring_dedup.prefix_classes(values, 400 - np.arange(400), 7)
    for a in range(0, 390, 7):
        for b in range(0, 390):
            assert (node[a] == node[b]) == (values[a : a + 7] == values[b : b + 7]).all()


def jaccard_parts(rows):
    sets = defaultdict(list)
    for i, t in rows:
        w = re.findall(WORD, lower(t or ""))
        sets[i].append({tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    part = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(part[a], part[b])
            changed |= part[a] != low or part[b] != low
            part[a] = part[b] = low
    return sorted((i, len(s), part[i]) for i in sets for s in sets[i])


def test_sharing_loses_no_pair(spark):
    """Sets that link pass, also where halves of their hashes fall together; sets that share little do not."""
    near = lambda k: [(k << 32) + 7, (k << 32) + 8]  # two lists with one upper half
    lists = {1: near(1) + [2 << 32, 3 << 32], 2: near(1) + [2 << 32, 5 << 32], 3: [6 << 32, 7 << 32, 8 << 32, 9 << 32]}
    listed = spark.createDataFrame([(i, 15, v) for i, v in lists.items()], "id long, n long, lists array<long>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "hub long, id long")
    # n = 15: T = 14, allowed = 12, so 3 of 4 short lists; two of the three shared fall together
    assert [tuple(r) for r in jaccard_join.sharing(pairs, listed).collect()] == [(1, 2)]


def test_jaccard(spark):
    base, rows, r = passage(9, 120), list(ODD), random.Random(4)
    for k in range(40):  # a chain of drifting copies, and copies of the base
        if k % 8 == 0:
            words = list(base)
        words = list(words)
        words[r.randrange(120)] = f"w{k}"
        rows.append((200 + k, " ".join(words)))
    known = [(i, t) for i, t in rows if i is not None]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_report(table(spark, rows)).collect() if r.doc_id is not None)
    assert got == jaccard_parts(known)
    none = [r for r in jaccard_join.jaccard_report(table(spark, rows)).collect() if r.doc_id is None]
    assert [r.component_id for r in none] == [None]
    kept = jaccard_join.one_of_each(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    assert sorted(r.doc_id for r in kept.select("doc_id").where("doc_id is not null").collect()) == sorted(i for i, _, c in got if i == c)


def test_merged_lists_across_batches():
    import pyarrow as pa

    rows = sorted((s, i, 10 + i, i % 3) for s, n in ((1, 1), (2, 5), (3, 1), (4, 2), (5, 1)) for i in range(n))
    for size in (1, 2, 3, 10):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[a : a + size]], pa.int64() if c < 3 else pa.int32()) for c in range(4)], names=["shingle", "id", "n", "place"]) for a in range(0, len(rows), size)]
        out = [tuple(x.values()) for b in jaccard_join._merged_lists(iter(batches)) for x in b.to_pylist()]
        assert out == [(*r, 0, 10) for r in rows if r[0] in (2, 4)]


def test_tokens(spark):
    vocabulary = sentencepiece_scan.Vocabulary(TOKENIZER)

    def exhaustive(text):
        if not text:
            return 0
        ways = [sentencepiece_scan.UNREACHED]
        if text[0] not in vocabulary.pieces:
            ways.append(vocabulary.foreign + exhaustive(text[1:]))
        ways += [vocabulary.pieces[text[:k]][0] + exhaustive(text[k:]) for k in range(1, len(text) + 1) if text[:k] in vocabulary.pieces]
        return max(ways)

    for text in (" the", " thening", "  äq", "▁x", " 日ab", "\n", "hested"):
        assert vocabulary.best(text)[0] == exhaustive(text)
    docs = table(spark, ODD)
    reports = [sorted(map(str, sentencepiece_scan.token_report(docs, TOKENIZER, chunk).collect())) for chunk in (64, 8192)]
    words = [r for r in reports[0] if "doc_id=10," not in r]  # one run without a cut: equal pieces may come in another order
    assert words == [r for r in reports[1] if "doc_id=10," not in r] and len(reports[0]) == len(ODD)
    for r in sentencepiece_scan.token_report(docs, TOKENIZER, 64).collect():
        assert r.decoded_sha256 in {sha(t or "") for i, t in ODD if i == r.doc_id}


def test_scan_is_associative():
    r = np.random.default_rng(2)
    m = r.integers(-50, 0, (9, 4, 4))
    m[r.random(m.shape) < 0.3] = sentencepiece_scan.UNREACHED
    want = [m[0]]
    for x in m[1:]:
        want.append(sentencepiece_scan.times(want[-1][None], x[None])[0])
    assert (sentencepiece_scan.scan(m) == np.array(want)).all()


def test_toxicity(spark):
    r = random.Random(3)
    plain = lambda n: [r.choice("abcdefghijkl") + r.choice(["tion", "ing", "ed", "ous"]) + r.choice("mnopq") for _ in range(n)]
    rows, labels = [], []
    for i in range(1200):
        words = plain(60)
        if i % 4 == 0:
            for _ in range(4):
                words[r.randrange(60)] = r.choice(["grobble", "snurfish", "blaxter"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(5000, None), (5001, ""), (None, "x"), (0, rows[0][1])]
    docs = table(spark, rows)
    known = spark.createDataFrame([*labels, (5000, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.toxicity_scores(docs, known).toPandas()
    assert len(out) == len(rows) and out.score.between(0, 1).all()
    held = out[out.held_out & (out.doc_id < 1200)]
    assert ((held.predicted == 1) == (held.doc_id % 4 == 0)).mean() > 0.95
    none = toxicity.toxicity_scores(docs, known.where("toxic = 7")).toPandas()
    assert (none.score == 0).all()


def test_tiles():
    r = random.Random(5)
    item = np.arange(1, 41, dtype=np.uint64)
    doc = np.concatenate([item[20:], np.array([99, 98], np.uint64), item[:20]])
    assert decontaminate.tile(item, doc) == [(0, 22, 20), (20, 0, 20)]
    for _ in range(60):  # against plain greedy string tiling
        a = np.array([r.randrange(4) for _ in range(25)], np.uint64)
        b = np.array([r.randrange(4) for _ in range(30)], np.uint64)
        fa, fb, total = [True] * 25, [True] * 30, []
        while True:
            best = max(((k, -i, -j) for i in range(25) for j in range(30) for k in range(1, min(25 - i, 30 - j) + 1)
                        if all(fa[i : i + k]) and all(fb[j : j + k]) and (a[i : i + k] == b[j : j + k]).all()), default=(0, 0, 0))
            if best[0] < 3:
                break
            k, i, j = best[0], -best[1], -best[2]
            fa[i : i + k], fb[j : j + k] = [False] * k, [False] * k
            total.append(k)
        assert sorted(t[2] for t in decontaminate.tile(a, b, 3)) == sorted(total)


def test_contaminated(spark):
    item = passage(77, 40)
    items = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "a b"), (5, " ".join(passage(78, 30)))], "item_id long, text string")
    rows = [*ODD, (50, "before " + " ".join(item[20:] + ["x"] + item[:20]).upper() + " after"), (51, " ".join(item[:12]))]
    for block_bytes in (1 << 20, 50):
        out = decontaminate.contaminated(table(spark, rows), items, block_bytes=block_bytes).collect()
        assert [(r.doc_id, r.item_id, r.n_tiles, r.coverage) for r in out] == [(50, 1, 2, 1.0)]
        left = decontaminate.clean(table(spark, rows), items, block_bytes=block_bytes)
        assert left.columns == table(spark, rows).columns and left.count() == len(rows) - 1


@pytest.mark.parametrize("kind", ["smallint", "decimal(12,0)", "string", "int"])
def test_ids_of_any_type(spark, kind):
    item = " ".join(passage(77, 40))
    items = spark.createDataFrame([(1, item)], "item_id long, text string").selectExpr(f"cast(item_id as {kind}) as item_id", "text")
    docs = table(spark, [(50, f"before {item} after"), (None, item), (51, "other")]).selectExpr(f"cast(doc_id as {kind}) as doc_id", "text")
    out = decontaminate.contaminated(docs, items)
    assert out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType and out.schema["item_id"].dataType == items.schema["item_id"].dataType
    assert sorted(str(r.doc_id) for r in out.collect()) == ["50", "None"]


def luhn(s):
    return sum(x if k % 2 == 0 else (2 * x - 9 if 2 * x > 9 else 2 * x) for k, x in enumerate(map(int, reversed(s)))) % 10 == 0


def base(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m[0]))


def test_pii(spark):
    texts = [t for _, t in ODD] + [
        "a@b@c.d x@y.z-w.q. 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004 12 34 4111 1111-1111 1111 9", "a@b.c_d@e.f +1 (988) 555-2485) +12 +",
        "é" * 50 + " 4111111111111111 ñ@x.y +49.30.1234567 " + "1" * 400 + " a@" + "b." * 9000, "5 4111-1111 1111 1111", "1.1.1.1a@b.co +0 0 0 0 0 0 0 0 0 0 0"]
    r = random.Random(6)
    texts += ["".join(r.choice(["1", "4", "11", "25", ".", "-", " ", "+", "(", ")", "a", "@", "b.c", "é", "4111 1111 1111 1111"]) for _ in range(80)) for _ in range(150)]
    rows = list(enumerate(texts)) + [(None, "q@r.st"), (3, texts[3])]
    out = {(x.doc_id): x for x in pii.pii_report(table(spark, rows)).collect()}
    assert len(out) == len(texts) + 1
    for i, t in enumerate(texts):
        want = base(t or "")
        written = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert out[i].base_sha256 == sha(written), t
        assert [out[i].n_email, out[i].n_ip, out[i].n_card, out[i].n_phone] == [sum(k == j for _, k, _ in want) for j in range(4)]


def test_disclosing_terms(spark):
    rows = [(i, f"common words here zorbleton meets joe@x.org today {passage(i, 12)}") for i in range(3)]
    rows += [(10 + i, f"common words here today and more {passage(20 + i, 12)}") for i in range(20)]
    out = {r.doc_id: r for r in pii.pii_report(table(spark, rows)).collect()}
    assert out[0].spans.split(",") == ["term:18:27", "term:28:33", "email:34:43"]
    assert out[15].spans == ""
    text = {r.id: r.text for r in pii.sanitised(table(spark, rows)).collect()}
    assert text[0].startswith("common words here   [EMAIL] today")


def test_terms_everywhere(spark):
    far = ". " * 100
    rows = [(i, f"Zorbleton: z@x.org {far} Zorbleton lives in town {i}") for i in range(3)] + [(3, "Only Zorbleton here, z@y.org")]
    rows += [(10 + i, f"he lives in town {i} only here") for i in range(400)]
    out = {r.doc_id: r.spans.split(",") for r in pii.pii_report(table(spark, rows)).collect()}
    assert out[0] == ["term:0:9", "email:11:18", "term:220:229"]
    assert out[3] == ["term:5:14", "email:21:28"] and out[10] == [""]
    text = {r.id: r.text for r in pii.sanitised(table(spark, rows)).collect()}
    assert all("Zorbleton" not in t for t in text.values())


def test_repeated_rows_are_one_document(spark):
    rows = [(i, f"Zorbleton z@x.org lives in town {i}") for i in range(3)] + [(10 + i, f"he lives in town {i}") for i in range(60)]
    once = {r.doc_id: r.spans for r in pii.pii_report(table(spark, rows)).collect()}
    out = pii.pii_report(table(spark, rows + [rows[0]] * 30)).collect()
    assert once[0].startswith("term:0:9,") and len(out) == len(rows) + 30
    assert all(r.spans == once[r.doc_id] for r in out)


def test_disclosure_against_brute_force(spark):
    r = random.Random(21)
    for _ in range(3):
        words = [f"w{k}" for k in range(25)]
        rows = []
        for i in range(40):
            text = [r.choice(words[: 3 + i % 23]) for _ in range(r.randrange(3, 9))]
            if r.random() < 0.5:
                text.insert(r.randrange(len(text)), f"p{r.randrange(3)}@x.org")
            rows.append((i if r.random() < 0.9 else 0, " ".join(text)))  # some ids repeat
        n = len({i for i, _ in rows})
        entities, terms, both = defaultdict(set), defaultdict(set), defaultdict(set)
        for i, text in rows:
            parts = text.split(" ")
            for word in parts:
                (entities if "@" in word else terms)[word].add(i)
            for entity in (p for p in parts if "@" in p):  # texts are shorter than the context
                for word in parts:
                    if "@" not in word:
                        both[entity, word].add(i)
        want = {}
        for (entity, word), ids in both.items():
            rare = n / len(entities[entity])
            share = math.log(len(ids) * n / (len(entities[entity]) * len(terms[word]))) / math.log(rare) if rare > 1 else 0
            if len(ids) >= pii.SUPPORT and share >= pii.DISCLOSURE - 1e-12:
                want["0:" + entity, word] = share
        docs = identified(table(spark, rows))
        got = {(x.entity, x.term): x.disclosure for x in pii.disclosing_terms(docs, pii.base_rows(docs)).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in got)


def test_short_terms_and_number_forms(spark):
    forms = ["+1 (988) 555-2485", "+1 988 555 2485"]
    rows = [(i, f"Ann {form} AB12") for i, form in enumerate(forms)]
    rows += [(10 + i, f"4111{c}1111{c}1111{c}1111 Lee") for i, c in enumerate(" -")]
    rows += [(20 + i, f"in a town {i}") for i in range(100)]
    out = {r.doc_id: r.spans.split(",") for r in pii.pii_report(table(spark, rows)).collect()}
    assert out[0] == ["term:0:3", "phone:4:21", "term:22:26"] and out[1] == ["term:0:3", "phone:4:19", "term:20:24"]
    assert out[10] == out[11] == ["card:0:19", "term:20:23"] and out[20] == [""]


def test_vectors(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(600, 16))
    for k in range(200):
        x[400 + k] = x[k % 40] + 0.25 * r.normal(size=16)  # many near the threshold
    x[300:310] = x[0]
    vectors = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, [1.0] * 3), (1005, [2.0] * 3), (1006, []), (None, vectors[0][1])]
    docs = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors + odd], "vec_id long, embedding array<double>, id int, part int").repartition(4)
    out = {q.vec_id: q for q in embedding_dedup.vector_report(docs).collect()}
    assert len(out) == 608
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9) & ~np.eye(600, dtype=bool)
    assert [out[i].n_links for i in range(600)] == links.sum(1).tolist()
    assert [out[i].n_links for i in (1000, 1001, 1002, 1003, 1004, 1005, 1006, None)] == [0, 0, 0, 0, 1, 1, 0, 0]
    assert out[1005].component_id == 1004 and not out[1005].kept and out[305].component_id == 0


def test_blocks_give_the_same(spark):
    r = np.random.default_rng(9)
    rows = [(i, [float(v) for v in r.normal(size=4)]) for i in range(300)]
    docs = spark.createDataFrame(rows, "id long, v array<double>")
    one, many = (sorted(map(tuple, embedding_dedup.near_duplicates(docs, per_cell=10**6, block=b).collect())) for b in (10**6, 37))
    assert one == many
    u = np.array([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    assert [n for _, n, _ in one] == ((u @ u.T >= 0.9).sum(1) - 1).tolist()


def test_every_link_with_many_cells(spark):
    r = np.random.default_rng(11)
    x = r.normal(size=(16_384, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = r.normal(size=(8192, 16))
    away -= (away * x[:8192]).sum(1, keepdims=True) * x[:8192]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    x[8192:] = 0.9001 * x[:8192] + np.sqrt(1 - 0.9001**2) * away  # pairs just inside the threshold
    docs = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, v array<double>").repartition(8)
    got = sorted(map(tuple, embedding_dedup.near_duplicates(docs).select("id", "n_links").collect()))
    want = np.concatenate([(x[a : a + 1024] @ x.T >= 0.9).sum(1) for a in range(0, len(x), 1024)]) - 1
    assert [n for _, n in got] == want.tolist()


def test_vectors_of_any_magnitude(spark):
    r = np.random.default_rng(12)
    x = r.normal(size=(64, 8))
    x[32:] = x[:32] + 0.3 * r.normal(size=(32, 8))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = 10.0 ** r.integers(-290, 290, size=64)
    rows = [(i, row.tolist()) for i, row in enumerate(x * scale[:, None])]
    rows += [(100, [1e200] * 8), (101, [2e200] * 8), (102, [5e-324] * 8), (103, [1e308, -1e308] + [0.0] * 6)]
    docs = spark.createDataFrame(rows, "id long, v array<double>")
    want = ((u @ u.T >= 0.9).sum(1) - 1).tolist()
    ones = (u.sum(1) / np.sqrt(8) >= 0.9).sum()
    for per_cell in (256, 8):
        out = [n for _, n, _ in sorted(map(tuple, embedding_dedup.near_duplicates(docs, per_cell=per_cell).collect()))]
        assert ones == 0 and out == [*want, 2, 2, 2, 0]


def test_audit(spark):
    rows = [(i, f"record {i}" * (i % 5 + 1)) for i in range(0, 70_000, 7)] + [(None, "n"), (5, None)]
    left = spark.createDataFrame(rows, "seq long, payload string")
    damaged = [(i, "damaged" if i == 700 else p) for i, p in rows if i != 1400] + [(3, "new"), (2100, "record 2100")]
    out = {r.seq: r for r in warc_audit.audit(left, spark.createDataFrame(damaged, "seq long, payload string")).collect()}
    assert {i: r.verdict for i, r in out.items()} == {700: "altered", 1400: "missing", 3: "extra", 2100: "altered"}
    assert out[700].low == sum(len(p) for i, p in rows if p and i is not None and 0 <= i < 700)
    assert warc_audit.audit(left, left).count() == 0
    assert warc_audit.audit(left.limit(0), left.where("seq < 50")).count() == 9


def test_licenses(spark):
    mit = [s for s, i in licenses.SENTENCES.items() if i in ("MITgrant", "MITnotice", "MITasis")]
    rows = [(1, None), (2, ""), (3, "Text.\nReleased under the MIT License.\nMore."), (4, ". ".join(mit)),
            (5, "Licensed under the Apache\nLicense, Version 2.0. All rights reserved."), (6, "Copyright (c) 2020 A. All rights reserved."),
            (7, "licensed under the apache\nlicense, version 2.0."), (7, "No license.")]
    out = sorted((r.doc_id, r.licenses, r.n_sentences) for r in licenses.scan(table(spark, rows)).collect())
    assert out == [(1, "", 0), (2, "", 0), (3, "MIT", 1), (4, "MIT", 3), (5, "All-Rights-Reserved", 1), (6, "All-Rights-Reserved", 2), (7, "", 0), (7, "Apache-2.0", 1)]


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software"""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
GPL2 = GPL3.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2")
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""


def test_published_notices(spark):
    notices = [("MIT", 3, MIT), ("BSD-2-Clause", 3, BSD), ("BSD-3-Clause", 4, BSD3), ("Apache-2.0", 3, APACHE),
               ("GPL-3.0-or-later", 2, GPL3), ("GPL-2.0-or-later", 2, GPL2), ("MPL-2.0", 1, MPL)]
    forms = [lambda t: t, lambda t: t.replace("\n", "\r\n"), lambda t: re.sub("(?<!\n)\n *(?!\n)", " ", t)]
    forms += [lambda t, mark=mark: "Some program.\n" + "".join(f"{mark}{line}\n" for line in t.split("\n")) + "int main;" for mark in ("    ", " * ", "# ", "// ", ";; ")]
    rows = [(i, name, n, form(text)) for i, (name, n, text, form) in enumerate((*x, f) for x in notices for f in forms)]
    out = {r.doc_id: r for r in licenses.scan(table(spark, [(i, t) for i, _, _, t in rows])).collect()}
    for i, name, n, text in rows:
        assert (out[i].licenses, out[i].n_sentences, out[i].unmatched) == (name, n, ""), text
    apart = [(0, "All rights\nwere reserved."), (1, "the\ncopyright\nof it"), (2, "all rights. of all. reserved")]
    assert [r.n_sentences for r in licenses.scan(table(spark, apart)).collect()] == [0, 0, 0]


def test_notices_in_capitals(spark):
    rows = [(i, form(text)) for i, (text, form) in enumerate((t, f) for t in ("All rights reserved.", MIT) for f in (str.upper, str.lower, str))]
    out = {r.doc_id: (r.licenses, r.n_sentences) for r in licenses.scan(table(spark, rows)).collect()}
    assert [out[i] for i in range(6)] == [("All-Rights-Reserved", 1)] * 3 + [("MIT", 3)] * 3


def test_workers_need_no_package(tmp_path):
    """The package travels by value: a job started from another folder finds it on the workers."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from quern.session import local_session
from quern.llm import sentencepiece_scan
from quern.llm.queries import TOKENIZER
spark = local_session()
docs = spark.createDataFrame([(1, "one two"), (2, "x" * 30000)], "doc_id long, text string")
assert len(sentencepiece_scan.token_report(docs, TOKENIZER).collect()) == 2
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_empty_tables(spark):
    docs = table(spark, ODD).limit(0)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for out in (line_dedup.line_report(docs), substring_dedup.substring_report(docs), jaccard_join.jaccard_report(docs), licenses.scan(docs),
                pii.pii_report(docs), toxicity.toxicity_scores(docs, labels), decontaminate.contaminated(docs, items),
                sentencepiece_scan.token_report(docs, TOKENIZER), embedding_dedup.vector_report(vectors)):
        assert out.count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sizes = Counter()
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, out = docs.count(), corpus_pipeline.materialise(stage(spark, docs, SMALL))
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        sizes[name] = before - out.count()
        docs = out
    assert sizes["line dedup"] == 0 and docs.count() > 0.5 * spark.read.parquet(f"{SMALL}/documents.parquet").count()
    last = corpus_pipeline.run(spark, SMALL)
    assert sorted(r.doc_id for r in last.collect()) == sorted(r.doc_id for r in docs.collect())
    assert "pipeline" in entry.queries()

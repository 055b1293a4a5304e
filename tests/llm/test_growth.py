"""What reaches the driver and what travels, as tables grow."""

import os
import random
from urllib.parse import unquote

import numpy as np

from quern.llm import components, embedding_dedup, jaccard_join, toxicity


def test_toxicity_is_fitted_on_a_worker(spark, monkeypatch):
    r = random.Random(5)
    mild, rude = [f"calm{i}" for i in range(40)], [f"vile{i}" for i in range(6)]
    labels = [int(i % 4 == 0) for i in range(400)]
    rows = [(i, " ".join(r.choices(mild + rude * y * 3, k=60))) for i, y in enumerate(labels)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    known = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    learnt = {x.doc_id for x in docs.where(~toxicity.held_out()).select("doc_id").collect()}
    want = toxicity.train([t.encode() for i, t in rows if i in learnt], [labels[i] for i, _ in rows if i in learnt])
    for name in ("toArrow", "toPandas"):
        monkeypatch.setattr(type(docs), name, None)
    got = toxicity.fit(docs, known)
    assert got.toxic and (got.toxic, got.ordinary, got.window) == (want.toxic, want.ordinary, want.window)
    assert all((getattr(got, x) == getattr(want, x)).all() for x in ("mean", "scale", "weights"))
    assert not toxicity.fit(docs.limit(0), known).toxic


def test_a_step_of_components_plans_its_links_once(spark, monkeypatch):
    plans, write = [], components.materialise

    def seen(df):
        plans.append(df._jdf.queryExecution().analyzed().toString())
        return write(df)

    monkeypatch.setattr(components, "materialise", seen)
    links = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(20, 21), (22, 20), (30, 30)], "a long, b long")
    found = {x.node: x.component for x in components.components(links).collect()}
    assert found == {i: 0 for i in range(10)} | {i: 20 for i in (20, 21, 22)}
    assert max(p.count("Relation") for p in plans) <= 4


def test_few_pairs_are_sent_to_the_texts(spark, monkeypatch):
    words = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    docs = spark.createDataFrame([(i, 0, " ".join(words + [f"z{i}"])) for i in range(6)], "id long, mark long, text string")
    own = jaccard_join._short_lists(5, 80, np.zeros(0, np.uint64))
    listed = docs.mapInArrow(own, "id long, n long, c1 long, c2 long, lists array<long>").select("id", "n", "lists")
    pairs = spark.createDataFrame([(0, i) for i in range(1, 6)], "hub long, id long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for sent, texts_travel in ((1 << 18, False), (0, True)):
            monkeypatch.setattr(jaccard_join, "_SENT_IDS", sent)
            shared = jaccard_join.sharing(pairs, listed)
            found = jaccard_join.probed(pairs, docs.select("id", "text"))
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert ("hashpartitioning(id" in plan) == texts_travel
            assert "array<smallint>" in str([f.simpleString() for f in listed.select(jaccard_join._marks("lists")).schema])
            want = {(0, i) for i in range(1, 6)}
            assert {tuple(x) for x in shared.collect()} == {tuple(x) for x in found.collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_signs_lose_no_pair(spark):
    """Sets that link pass, also where one sign is folded once or twice; sets that are far apart do not."""
    r = np.random.default_rng(3)
    sets = {}
    for k, n in enumerate((1, 5, 64, 65, 130, 700, 1100)):
        base = r.integers(0, 1 << 63, n).astype(np.uint64)
        for j, (more, fewer) in enumerate(((0, 0), (n // 9, 0), (0, n // 5), (n // 12, n // 12), (0, n * 2 // 3), (n * 2, 0))):
            sets[10 * k + j] = np.unique(np.concatenate((base[fewer:], r.integers(0, 1 << 63, more).astype(np.uint64))))
    signs = spark.createDataFrame([(i, len(v), jaccard_join.sign(v).tolist()) for i, v in sets.items()], "id long, n long, sign array<long>")
    every = [(a, b) for a in sets for b in sets if a < b]
    pairs = spark.createDataFrame(every, "hub long, id long")
    share = {(a, b): (c := len(np.intersect1d(sets[a], sets[b]))) / (len(sets[a]) + len(sets[b]) - c) for a, b in every}
    for percent in (80, 30):
        kept = {tuple(x) for x in jaccard_join.near_enough(pairs, signs, percent).collect()}
        assert {p for p in every if 100 * share[p] >= percent} <= kept
    sizes = lambda p: sorted(len(sets[i]) for i in p)
    kept = {tuple(x) for x in jaccard_join.near_enough(pairs, signs).collect()}
    assert all(share[p] >= 0.6 for p in kept if sizes(p)[0] >= 64 and 10 * sizes(p)[0] >= 8 * sizes(p)[1])


def test_documents_that_share_rare_passages_only_are_not_probed(spark, monkeypatch):
    """Twenty documents with two thirds of their shingles in common are 190 pairs and no link; three are copies of one of them."""
    r = random.Random(8)
    common = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join(common + [f"d{i}x{j}" for j in range(200)])) for i in range(20)]
    rows += [(100 + j, rows[7][1] + f" more{j}") for j in range(3)]
    r.shuffle(rows)
    pairs, judged, probe = [], [], jaccard_join.probed
    monkeypatch.setattr(jaccard_join, "probed", lambda p, *rest: (pairs.extend(map(tuple, p.collect())), probe(p, *rest))[1])
    reach = jaccard_join._reaching_pairs
    monkeypatch.setattr(jaccard_join, "_reaching_pairs", lambda *x: (judged.append((out := reach(*x)).count()), out)[1])
    docs = spark.createDataFrame(rows, "id long, text string")
    got = {x.id: x.component for x in jaccard_join.jaccard_components(docs, keep_long=0).collect()}  # no list is put last
    assert got == {i: i for i in range(20)} | {100 + j: 7 for j in range(3)}
    assert len(pairs) <= 12 and all({a, b} <= {7, 100, 101, 102} for a, b in pairs) and judged == [0]


def test_vectors_are_written_twice_however_many_cells_they_reach(spark, monkeypatch):
    """Vectors without groups reach most cells; neither files nor a shuffle may hold one for each."""
    x = np.random.default_rng(6).normal(size=(6000, 64)).astype(np.float32)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    written, products, write = [], [], embedding_dedup.materialise

    def seen(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        if "CartesianProduct" in plan:
            products.append(plan)
        done = write(df)
        written.extend(os.path.getsize(unquote(f.removeprefix("file:").replace("///", "/"))) for f in done.inputFiles())
        return done

    monkeypatch.setattr(embedding_dedup, "materialise", seen)
    assert embedding_dedup.vector_report(docs).count() == 6000
    assert sum(written) < 4 * x.nbytes
    assert len(products) == 1 and "Exchange" not in products[0]


def test_planes_between_cells_lose_no_link(spark):
    """Pairs just inside the threshold, most of them in two cells, and a group; many cells in a block and many blocks in a cell."""
    r = np.random.default_rng(21)
    x = r.normal(size=(4000, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = r.normal(size=(2000, 12))
    away -= (away * x[:2000]).sum(1, keepdims=True) * x[:2000]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    x[2000:] = 0.9001 * x[:2000] + np.sqrt(1 - 0.9001**2) * away
    x[100:140] = x[5]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = u @ u.T >= 0.9
    part = np.arange(len(x))
    while (part != (low := np.array([part[row].min() for row in links]))).any():
        part = low
    want = list(zip(range(len(x)), (links.sum(1) - 1).tolist(), part.tolist(), strict=True))
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(8)
    for per_cell, block in ((16, 512), (400, 300), (4, 10**6)):
        assert sorted(map(tuple, embedding_dedup.near_duplicates(docs, per_cell=per_cell, block=block).collect())) == want


def test_ids_of_a_common_vector_take_many_rows(spark, monkeypatch):
    """No row may hold all the ids of a vector: it could have any number."""
    x = np.random.default_rng(9).normal(size=(50, 8)).tolist()
    docs = spark.createDataFrame([(i, x[0] if i >= 50 else x[i]) for i in range(30_000)], "id long, v array<double>").repartition(4)
    held, write = [], embedding_dedup.materialise

    def seen(df):
        done = write(df)
        if "alike" in done.columns:
            held.extend(len(r.ids) for r in done.where("ids is not null").select("ids").collect())
        return done

    monkeypatch.setattr(embedding_dedup, "materialise", seen)
    got = {r.id: (r.n_links, r.component) for r in embedding_dedup.near_duplicates(docs).collect()}
    u = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    assert (u @ u.T >= 0.9).sum() == 50  # nothing else links
    assert got == {i: (29_950, 0) if i == 0 or i >= 50 else (0, i) for i in range(30_000)}
    assert sum(held) == 30_000 and max(held) <= 1 << 14

"""Order, conservation and hierarchy rules, frequent pairs and successions against brute force."""

import random
from collections import defaultdict
from itertools import combinations

import pytest

from quern.operators import constraints as K, signatures as G


def tree_totals(parent, value):
    """Sum over each node and all below it; None for what hangs on a cycle."""
    total, lost = defaultdict(int), set()
    for node in parent:
        seen, at = set(), node
        while at in parent and at not in seen:
            seen.add(at)
            at = parent[at]
        if at in seen:
            lost.add(node)
            continue
        at = node
        while at in parent:
            total[at] += value[node] or 0
            at = parent[at]
    return {n: None if n in lost else total[n] for n in parent}


@pytest.mark.parametrize("shape", ["path", "random", "star", "cycle"])
def test_subtree_totals(spark, shape):
    r = random.Random(3)
    n = 300
    parent = {
        "path": {i: i - 1 if i else None for i in range(n)},
        "random": {i: r.randrange(i) if i % 40 else (None if i % 80 else 10_000 + i) for i in range(n)},
        "star": {i: 0 if i else None for i in range(n)},
        "cycle": {i: i - 1 if i > 4 else (i + 1) % 5 for i in range(20)} | {50: 50, 51: None, 52: 51},
    }[shape]
    value = {i: r.choice([None, 0, 1, 5, -3]) for i in parent}
    nodes = spark.createDataFrame([(i, p, value[i]) for i, p in parent.items()], "id long, up long, v long").repartition(3)
    got = {x.id: x for x in K.subtree_totals(nodes, "id", "up", "v").collect()}
    want = tree_totals(parent, value)
    assert {i: x.total for i, x in got.items()} == want
    place = {i: "cycle" if want[i] is None else "root" if p is None else "inner" if p in parent else "orphan" for i, p in parent.items()}
    assert {i: x.place for i, x in got.items()} == place


def test_hierarchy_verdicts(spark):
    rows = [(1, None, 0, 6), (2, 1, 1, 1), (3, 1, 2, 5), (4, 3, 3, None), (5, 99, 7, 7), (6, 7, 1, 1), (7, 6, 1, 1), (8, 5, None, 1)]
    nodes = spark.createDataFrame(rows, "id int, up int, v int, claim int")
    got = {x.id: x.verdict for x in K.hierarchy(nodes, "id", "up", "v", "claim").collect()}
    assert got == {1: "ok", 2: "ok", 3: "ok", 4: "missing_value", 5: "orphan", 6: "cycle", 7: "cycle", 8: "incoherent"}
    assert K.hierarchy(nodes.limit(0), "id", "up", "v", "claim").count() == 0


def test_conservation(spark):
    parts = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 1.0), (3, None), (4, 5.0), (None, 1.0)], "k int, p double")
    wholes = spark.createDataFrame([(1, 3.0), (2, 2.0), (3, 1.0), (5, 1.0), (6, None), (None, 1.0)], "k int, w double")
    got = sorted((str(x.k), x.verdict) for x in K.conservation(parts, wholes, "k", "p", "w").collect())
    assert got == [("1", "ok"), ("2", "not_conserved"), ("3", "missing_value"), ("4", "no_whole"), ("5", "no_parts"), ("6", "no_parts"), ("None", "no_parts"), ("None", "no_whole")]


@pytest.mark.parametrize("strict", [False, True])
def test_falls(spark, strict):
    r = random.Random(5)
    rows = [(r.choice([None, "a", "b", "c"]), t, r.choice([None, *range(5)])) for t in range(400)] + [("d", 1, None)]
    got = {x.k: (x.n, x.n_missing, x.n_falls, x.worst) for x in K.falls(spark.createDataFrame(rows, "k string, t long, v int"), ["k"], ["t"], "v", strict).collect()}
    want = {}
    for k in (None, "a", "b", "c", "d"):
        own = [v for key, _, v in rows if key == k]
        known = [v for v in own if v is not None]
        down = [a - b for a, b in zip(known, known[1:]) if a > b or (strict and a == b)]
        want[k] = (len(own), own.count(None), len(down), max(down, default=None))
    assert got == want


@pytest.mark.parametrize("share", [0.0, 0.1, 0.3])
def test_pairs_and_successions(spark, share):
    r = random.Random(8)
    items = [f"i{k}" for k in range(12)]
    rows = [(r.choice([None, *range(25)]), r.choice([None, *items[: 1 + r.randrange(12)]]), r.randrange(6)) for _ in range(250)]
    df = spark.createDataFrame(rows, "g int, i string, at int").repartition(4)
    groups = defaultdict(lambda: defaultdict(list))
    for g, i, at in rows:
        if g is not None and i is not None:
            groups[g][i].append(at)
    least = share * len(groups)
    pairs, later = defaultdict(int), defaultdict(int)
    for held in groups.values():
        for a, b in combinations(sorted(held), 2):
            pairs[a, b] += 1
        for a in held:
            for b in held:
                later[a, b] += any(x < y for x in held[a] for y in held[b])
    got = {(x.a, x.b): x.pair_n for x in G.frequent_pairs(df, "g", "i", share).collect()}
    assert got == {p: n for p, n in pairs.items() if n >= least}
    found = G.successions(df, "g", "at", "i", share).collect()
    assert {(x.a, x.b): x.pair_n for x in found} == {p: n for p, n in later.items() if n and n >= least}
    support = {i: sum(i in held for held in groups.values()) for i in items}
    assert all((x.a_n, x.b_n, x.confidence) == (support[x.a], support[x.b], x.pair_n / support[x.a]) for x in found)

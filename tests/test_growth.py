"""Work of one task and what is shuffled, as tables grow."""

import random

from quern.operators import compose as C, probes as B, profile as P, signatures as G
from quern.session import dealt


def test_catalogue_deals_out_a_large_table(spark, monkeypatch):
    rows = [(i, f"n{i % 7}" if i % 5 else None, [i % 3], i * 0.5) for i in range(200)]
    df = spark.createDataFrame(rows, "a int, b string, c array<int>, d double").coalesce(1)
    want = sorted(map(str, P.catalogue(df, ["n1"]).collect()))
    monkeypatch.setattr(P, "CELLS", 100)
    spread = P.catalogue(df, ["n1"])
    assert sorted(map(str, spread.collect())) == want
    assert "REPARTITION_BY_NUM" in spread._jdf.queryExecution().executedPlan().toString()
    assert P.catalogue(df.limit(0)).count() == 4


def test_baskets_are_dealt_out_before_they_are_gathered(spark, monkeypatch):
    r, calls = random.Random(4), []
    rows = [(r.randrange(60), f"i{r.randrange(6)}", r.randrange(9)) for _ in range(400)]
    df = spark.createDataFrame(rows, "g int, i string, at int")
    found = [lambda: G.frequent_pairs(df, "g", "i", 0.1), lambda: G.successions(df, "g", "at", "i", 0.1)]
    want = [sorted(map(tuple, f().collect())) for f in found]

    def small(*args):
        calls.append(args[1:])
        return dealt(*args, most=20)

    monkeypatch.setattr(G, "dealt", small)
    assert [sorted(map(tuple, f().collect())) for f in found] == want
    held = len({x[:2] for x in rows})
    assert calls == [(400, "group", "item"), (held, "group"), (held, "group")] * 2


def test_boosted_trees_read_bounded_parts(spark, monkeypatch):
    r, parts = random.Random(3), []
    df = spark.createDataFrame([(r.random(), r.random()) for _ in range(300)], "x double, y double").coalesce(1)

    def small(*args):
        out = dealt(*args, most=50)
        parts.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(B, "dealt", small)
    assert B.score_model(B.boosted_trees(df, ["x"], "y", 2), df, ["x"]).count() == 300
    assert parts == [6]


def test_shingle_coverage_aggregates_neither_side(spark):
    texts = ["a b c d", "a  b c d", "B c d e", "", None, "x", "a b c d a b c d"]
    mine = spark.createDataFrame([(1, texts[0]), (1, texts[2]), (2, texts[3]), (3, texts[4]), (None, texts[5]), (None, texts[6]), (4, "q r s")], "k int, text string")
    theirs = spark.createDataFrame([(t,) for t in texts[:3] * 5 + [None, ""]], "text string")
    found = C.shingle_coverage(mine, theirs, "k", "text", 3)
    assert {tuple(x) for x in found.collect()} == {(1, 4, 4), (None, 5, 2), (4, 1, 0)}
    assert found.dtypes[1:] == [("shingles", "bigint"), ("shared", "bigint")]
    assert "keys=[_h" not in found._jdf.queryExecution().executedPlan().toString()

"""Raw source values in published text against a plain search."""

import random

import pytest

from quern.operators import disclosure


def places(texts, values):
    out = []
    for key, text in texts:
        raw = (text or "").encode()
        for value in {v for v in values if v}:
            at = raw.find(value.encode())
            while at >= 0:
                out.append((key, value, at))
                at = raw.find(value.encode(), at + 1)
    return sorted(out)


def found(spark, texts, values):
    published = spark.createDataFrame([(k, t, "x", 1) for k, t in texts], "key long, body string, value string, gram int").repartition(3)
    wanted = spark.createDataFrame([(v,) for v in values], "v string")
    got = disclosure.raw_values(published, ["key"], "body", wanted, "v")
    return sorted((r.key, r.value, r.start) for r in got.collect())


def test_values_of_all_lengths(spark):
    r = random.Random(1)
    word = lambda n: "".join(r.choice("ab#0é") for _ in range(n))
    values = [word(n) for n in (1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 40, 100) for _ in range(3)] + ["", None, "a", "a"]
    texts = [(k, word(r.randrange(300)) + r.choice([v for v in values if v]) + word(r.randrange(40))) for k in range(40)] + [(90, None), (91, "")]
    assert found(spark, texts, values) == places(texts, values)


def test_values_that_share_their_beginning(spark):
    """Anchors are the grams that tell values apart, not what thousands have in common."""
    values = [f"Customer#{i:09d}" for i in range(3000)]
    texts = [(1, "<p>xCustomer#000000017y Customer#00000 Customer#000002999Customer#000003000</p>"), (2, "Customer#" * 2000)]
    assert found(spark, texts, values) == [(1, "Customer#000000017", 4), (1, "Customer#000002999", 39)]
    index = disclosure.anchors(spark.createDataFrame([(v,) for v in values], "v string"), "v")
    assert index.count() == 3000 and index.select("size", "gram").distinct().count() == 3000


def test_long_text(spark):
    text = "é" + "0123456789" * 100_000 + "needle-in-text" + "z" * 1000
    assert found(spark, [(1, text)], ["needle-in-text", "9n", "zz9"]) == [(1, "9n", 1_000_001), (1, "needle-in-text", 1_000_002)]


@pytest.mark.parametrize("texts, values", [([], ["a"]), ([(1, "a")], []), ([(1, None)], [None])])
def test_nothing(spark, texts, values):
    assert found(spark, texts, values) == []

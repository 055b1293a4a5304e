"""Edge rules the driver's tables cannot show."""

import hashlib
import hmac
import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from quern.functions import jsonrules as J, keyed as K, names as N, text as X
from quern.operators import compose as C, ids as I, panel as P, profile as R, submission as S
from quern.plans.records import records  # noqa: F401  (import check)
from quern.sources import publish as B, runs as U, tables as T


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")


def apply(spark, values, fn, kind="string"):
    return [r[0] for r in column(spark, values, kind).orderBy("i").select(fn(F.col("c")).alias("o")).collect()]


def test_name_tokens(spark):
    got = dict(zip(
        ["userID", "HTTPServerId", "order_ids", "categories", "address", "clicked", "eventTime", "paid"],
        apply(spark, ["userID", "HTTPServerId", "order_ids", "categories", "address", "clicked", "eventTime", "paid"], N.name_tokens),
    ))
    assert set(got["userID"]) == {"user", "id"}
    assert {"http", "server", "id"} <= set(got["HTTPServerId"])
    assert {"order", "ids", "id"} <= set(got["order_ids"])
    assert {"categories", "category", "categori", "categorie"} == set(got["categories"])
    assert set(got["address"]) == {"address"}
    assert {"click", "clicked"} == set(got["clicked"])
    assert {"event", "time"} == set(got["eventTime"])
    assert {"paid", "id", "pa"} == set(got["paid"])


def test_name_flags_keep_their_order(spark):
    assert apply(spark, ["post_order_id_date", "plain"], N.name_flags) == [
        ["identifier_like_name", "sensitive_name_review", "time_candidate", "outcome_or_post_state_name_review"], []
    ]


def test_keyed_digest_equals_hmac(spark, monkeypatch):
    key, values = b"k" * 40, ["a", "ü", "", "x" * 200]
    want = [hmac.new(key, f"ns\0col\0{v}".encode(), hashlib.sha256).hexdigest() for v in values]
    assert apply(spark, values, lambda c: K.keyed_digest_in_plan(key, "ns", "col", c)) == want
    assert apply(spark, values, lambda c: K.keyed_digest("QUERN_TEST_KEY", "ns", "col", c)) == want


def test_keyed_digest_refuses_a_short_secret(spark):
    with pytest.raises(Exception, match="at least 32"):
        apply(spark, ["a"], lambda c: K.keyed_digest("QUERN_NO_SUCH_KEY", "ns", "col", c))


@pytest.mark.parametrize("n,width", [(9, 4), (9999, 4), (10000, 5)])
def test_code_width_and_order_independence(spark, n, width):
    values = spark.range(n).select(F.col("id").cast("string").alias("k"))
    digest = lambda v: F.sha2(v, 256)
    codes = {r.value: r.code for r in I.code_mapping(I.id_universe([values.repartition(5)], "k"), "u", digest).collect()}
    ordered = sorted((hashlib.sha256(str(i).encode()).hexdigest(), str(i)) for i in range(n))
    assert codes == {v: f"u{i:0{width}d}" for i, (_, v) in enumerate(ordered, 1)}


def test_anonymise_shares_one_mapping_over_files_and_types(spark):
    a = spark.createDataFrame([(1, 10), (2, None)], "row int, k int")
    b = spark.createDataFrame([("10", "x"), (" ", "y"), ("7", "z")], "k string, v string")
    digest = lambda column, v: F.sha2(F.concat(F.lit(column), v), 256)
    one, two = I.anonymise([a, b], [I.IdColumn("k", "c")], digest, drop=["v"])
    left = {r.row: r.k for r in one.collect()}
    right = [r.k for r in two.collect()]
    assert left[2] is None and left[1] in right and " " in right and two.columns == ["k"]
    assert {c for c in right if c != " "} == {"c0001", "c0002"}
    _, nulled = I.anonymise([a, b], [I.IdColumn("k", "c")], digest, blanks="null")
    assert None in [r.k for r in nulled.collect()]
    with pytest.raises(Exception, match="blank id"):
        I.anonymise([a, b], [I.IdColumn("k", "c")], digest, blanks="error")[1].collect()


def test_id_specs():
    assert I.IdColumn.parse("user:u") == I.IdColumn("user", "u")
    for bad in ("user", ":u", "user:9", "a\0b:c", "user:"):
        with pytest.raises(ValueError):
            I.IdColumn.parse(bad)
    with pytest.raises(ValueError):
        I.check_ids([I.IdColumn("a", "x"), I.IdColumn("b", "x")])
    with pytest.raises(ValueError):
        I.check_ids([I.IdColumn("a", "x")], ["a"])


def test_substitute_fails_on_unmapped(spark):
    df = spark.createDataFrame([("a",), (None,), (" ",)], "c string")
    mapping = spark.createDataFrame([("a", "c1")], "value string, code string")
    assert {r.c for r in C.substitute(df, mapping, "c").collect()} == {"c1", None, " "}
    with pytest.raises(Exception, match="unmapped"):
        C.substitute(df.union(spark.createDataFrame([("b",)], "c string")), mapping, "c").collect()


def test_missing_classes_are_disjoint(spark):
    df = spark.createDataFrame([(v,) for v in [None, "", " ", "\t", " ", "NA", "x", "x"]], "c string")
    r = R.catalogue(df, ["NA", ""]).first()
    assert (r.physical_nulls, r.blank_strings, r.null_tokens, r.nonmissing, r.missing) == (1, 4, 1, 6, 2)
    strict = R.catalogue(df, ["NA", ""], blank_is_missing=True).first()
    assert (strict.nonmissing, strict.missing, strict.distinct_values) == (2, 6, 1)
    assert "constant_in_sample" in strict.flags


def test_catalogue_of_empty_and_nested(spark):
    empty = R.catalogue(spark.createDataFrame([], "a int, b array<int>")).collect()
    assert [(r.row_count, r.missing_fraction, r.unique_ratio, list(r.flags)) for r in empty] == [(0, None, None, [])] * 2
    nested = spark.createDataFrame([([1],), ([1],), (None,)], "b array<int>")
    r = R.catalogue(nested, ["[1]"]).first()
    assert (r.nonmissing, r.physical_nulls, r.null_tokens, r.distinct_values) == (2, 1, 0, 1)


@pytest.mark.parametrize("n,rows,want", [(10, 100, 10), (1000, 100, 99), (1000, 90, 90)])
def test_positional_sample(spark, tmp_path, n, rows, want):
    path = str(tmp_path / "t")
    spark.range(0, n, 1, 4).write.parquet(path)
    out = R.positional_sample(spark.read.parquet(path), rows)
    at = sorted(r.position for r in out.collect())
    third = rows // 3
    assert len(at) == want
    if n > rows:
        assert at == sorted([*range(third), *range(n // 2 - third // 2, n // 2 - third // 2 + third), *range(n - third, n)])


def test_csv_empties_and_strictness(spark, tmp_path):
    plain = tmp_path / "a.csv"
    plain.write_text('k,s\n1,\n2,""\n3, \n4,NA\n')
    loose = {r.k: r.s for r in T.scan_csv(spark, str(plain)).collect()}
    assert loose[1] is None and loose[3] == " "
    kept = {r.k: r.s for r in T.scan_csv(spark, str(plain), keep_empty=True).collect()}
    assert kept == {1: "", 2: "", 3: " ", 4: "NA"}
    bad = tmp_path / "b.tsv"
    bad.write_text("k\ts\n1\ta\nx\tb\n")
    with pytest.raises(Exception):
        T.scan_csv(spark, str(bad), "k int, s string").collect()
    assert [r.k for r in T.scan_csv(spark, str(bad), "k int, s string", strict=False).collect()] == [1, None]
    with pytest.raises(ValueError, match="no parquet"):
        T.scan_parquet(spark, str(tmp_path / "none"))


def test_publish_is_all_or_nothing(spark, tmp_path):
    target, df = str(tmp_path / "out"), spark.range(3)
    B.publish(spark, {"a": df}, target)
    with pytest.raises(FileExistsError):
        B.publish(spark, {"a": df}, target)
    with pytest.raises(Exception):
        B.publish(spark, {"a": spark.range(9), "b": df.select(F.raise_error(F.lit("boom")))}, target, force=True)
    assert B.read_published(spark, target, "a").count() == 3
    B.publish(spark, {"a": spark.range(5)}, target, force=True)
    assert B.read_published(spark, target, "a").count() == 5
    for inputs in ([target], [target + "/x"], ["/a/t", "/b/t"], ["/a/t", "/a/t/"]):
        with pytest.raises(ValueError):
            B.check_paths(inputs, target)
    with pytest.raises(ValueError):
        B.publish(spark, {"A": df, "a": df}, str(tmp_path / "two"))


def test_run_records(spark, tmp_path):
    bodies = {"t1/weak-1": '{"final_score": 0.0, "is_lower_better": true}', "t1/weak-2": '{"final_score": null, "final_result": {"failure_code": "solver_timeout"}}', "t1/weak-3": "{oops"}
    for place, body in bodies.items():
        (tmp_path / place).mkdir(parents=True)
        (tmp_path / place / "scores.json").write_text(body)
    runs = U.scan_runs(spark, str(tmp_path), r"/([^/]+)/([a-z]+)-([0-9]+)/scores\.json$", ["task", "profile", "run"])
    assert {r.run: (r.state, r.score) for r in runs.collect()} == {"1": ("scored", 0.0), "2": ("fail:solver_timeout", None), "3": ("err", None)}


def test_plan_and_code(spark):
    good = "Plan one.\n```python\nprint(1)\n```\n"
    cases = [good, "Plan.\n```\nx\n```", "no code", "```python\nx\n```", " \n```py\nx\n```", "a\n```py\n \n```", "a\n```py\nx\n```\nb\n```py\ny\n```", good + "tail"]
    out = X.plan_and_code(column(spark, cases), "c").orderBy("i").collect()
    assert [r.reason for r in out] == [None, None, "not_plan_then_code", "not_plan_then_code", "empty_part", "empty_part", "extra_fence", "not_plan_then_code"]
    assert (out[0].plan, out[0].code) == ("Plan one.", "print(1)\n")


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs",), blacklist_characters="\0"), max_size=120), min_size=20, max_size=20))
def test_excerpt_property(spark, texts):
    for got, raw in zip(apply(spark, texts, lambda c: X.excerpt(c, 60, "cut")), texts):
        if len(raw) <= 60:
            assert got == raw
        else:
            mark = f"\n...[cut; {len(raw) - 60} characters omitted]...\n"
            room = max(0, 60 - len(mark))
            assert got == raw[: room // 2] + mark + (raw[-(room - room // 2):] if room else "")


def test_byte_cap(spark):
    assert apply(spark, ["abc", "aéé"], lambda c: X.byte_capped(c, 4)) == ["abc", "aé�\n[output truncated after 4 bytes]"]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["public", "a", "b.csv", "..", ".", "", "\\", "private"]), min_size=1, max_size=4).map("/".join), min_size=30, max_size=30))
def test_safe_path_property(spark, paths):
    from pathlib import PurePosixPath

    for got, raw in zip(apply(spark, paths, X.safe_path), paths):
        p = PurePosixPath(raw)
        want = raw != "" and p.as_posix() == raw and not p.is_absolute() and "\\" not in raw and ".." not in p.parts and len(p.parts) > 1 and p.parts[0] == "public"
        assert got == want, raw


def test_scrub_lines(spark):
    text = "# T\n- `a`: x\n* `a` and `b`\nsee `a` here\nplain a, and a\n- `keep`"
    out = apply(spark, [text], lambda c: X.scrub_lines(c, ["a"]))[0]
    assert out.text == "# T\n* `a` and `b`\nsee `a` here\nplain a, and a\n- `keep`"
    assert out.leftovers[:2] == ["* `a` and `b`", "see `a` here"]
    body = out.text
    hits = [m.start() for m in re.finditer(r"(?<!`)a(?!`)", body)]
    assert out.leftovers[2:] == [f"prose: …{body[max(0, p - 40):p + 41]}…".replace("\n", " ") for p in hits]


def test_templates_and_headings(spark):
    filled = apply(spark, ["{{a}} {{b}} {{b}}"], lambda c: X.open_tokens(X.fill_template(c, {"a": F.lit("{{c}}")})))
    assert filled == [["{{b}}", "{{c}}"]]
    docs = ["## Task\n## Metric\n## Submission Format\n## Dataset", "## Dataset\n## Task\n## Metric\n## Submission format", "## Task"]
    assert [(list(r.missing), r.in_order) for r in apply(spark, docs, X.heading_report)] == [
        ([], True), ([], False), (["metric", "submission format", "dataset"], True)
    ]


def test_general_number_text(spark):
    xs = [0.0, 1.0, 123456.789012345, 1e-4, 1.5e-5, 999999999999.9, 1234567890123.0, 1e100, -2.5, 0.1 + 0.2]
    for got, x in zip(apply(spark, xs, X.number_12g, "double"), xs):
        assert got.lower().replace("e+0", "e+").replace("e-0", "e-") == f"{x:.12g}".replace("e+0", "e+").replace("e-0", "e-")


def test_json_states(spark):
    raws = ['{"a":1}', '{"a":1,"a":2}', "{oops", None]
    assert apply(spark, raws, J.document_state) == ["ok", "duplicate_key", "malformed", "absent"]


def test_json_kinds(spark):
    df = column(spark, ['{"a":true}', '{"a":1}', '{"a":1.0}', '{"a":"x"}', '{"a":null}', "{}", '{"a":[1]}', '{"a":{"b":1}}', '{"a":1e2}'])
    rows = J.with_nodes(df, "c", ["a"]).orderBy("i").select(J.node("a")["kind"], J.node("a")["num"]).collect()
    assert [r[0] for r in rows] == ["bool", "whole", "real", "text", "null", "absent", "array", "object", "real"]
    assert [r[1] for r in rows] == [None, 1.0, 1.0, None, None, None, None, None, 100.0]


def test_score_cells(spark):
    panel = spark.createDataFrame([("t", r, s) for r, s in [(1, 0.0), (2, None), (3, 2.5), (4, float("nan"))]] + [("u", 1, None)], "task string, run int, score double")
    cells = {r.task: r.scores for r in P.score_cell(panel, ["task"], F.lit("old")).collect()}
    assert cells == {"t": "0.00000 ; 2.50000", "u": "old"}
    best = {r.task: (r.best, r.scored_text) for r in P.cell_best(panel, ["task"], lower=True).collect()}
    assert best == {"t": (0.0, "2/5"), "u": (None, "0/5")}
    assert apply(spark, ["x runs: 1 ; ; 2 | y", "runs:", "none"], P.archived_scores) == [["1", "2"], [], None]
    assert apply(spark, [0, 1, 60, 61, 240, 301], P.difficulty_band, "int") == [0, 1, 1, 2, 4, 5]
    assert apply(spark, [45, 60, 135], P.hours_minutes, "int") == ["45mins", "1hrs 0mins", "2hrs 15mins"]


def test_grading_reports_duplicates_on_both_sides(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    r = C.match_report(keys, keys, "k").first()
    assert (r.duplicate_keys, r.duplicate_answers, r.matched_keys) == (1, 1, 1)


def test_hidden_mirror_and_listing(spark):
    from quern.operators.packages import hidden_mirror, public_assets

    files = spark.createDataFrame(
        [("p", "public/a/x.csv", 1), ("p", "hidden-test/public/a/x.csv", 1), ("p", "hidden-test/public/b.csv", 1), ("p", "public/c.csv", 1), ("q", "public/description.md", 1)],
        "pkg string, path string, size long",
    )
    declared = spark.createDataFrame([("p", "public/a"), ("p", "public/c.csv"), ("p", "public/gone")], "pkg string, path string")
    got = sorted((r.path, r.error) for r in hidden_mirror(files, declared).collect())
    assert got == [("public/b.csv", "unlisted_payload"), ("public/c.csv", "replacement_missing"), ("public/gone", "live_path_missing")]
    assert {r.pkg: r.errors for r in public_assets(files).collect()} == {"p": "missing_private", "q": "missing_private,no_data_assets"}


def test_sample_report(spark):
    lines = column(spark, ["1,a", "1,b", "1", " ,c", " ,d", "2,e,f"])
    r = S.sample_report(lines, "c", 2, [0]).first()
    assert (r.row_count, r.malformed_rows, r.blank_keys, r.duplicate_keys) == (6, 2, 2, 1)


def test_stream_replay_is_counted_once(spark, tmp_path):
    """Two runs over the same checkpoint add nothing; a new file is picked up."""
    from quern.streaming import logs as G

    src = tmp_path / "src"
    src.mkdir()
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.where("event_id < 500").toPandas().to_parquet(src / "events.parquet", coerce_timestamps="us")
    start = lambda: G.start_status(G.event_stream(spark, str(src)), str(tmp_path / "sink"), str(tmp_path / "cp")).awaitTermination()
    start()
    start()
    events.where("event_id >= 500").toPandas().to_parquet(src / "events2.parquet", coerce_timestamps="us")
    start()
    got = {r.user_id: (r.events, r.best) for r in G.read_latest_rows(spark, str(tmp_path / "sink"), ["user_id"]).collect()}
    want = {r.user_id: (r.n, r.b) for r in events.groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("b")).collect()}
    assert got == want


def test_sample_report_keeps_quoted_commas(spark):
    lines = spark.createDataFrame([('"a,1",x',), ('"a,1",y',), ("b,x,y",), ("c",), (",x",)], "c string")
    r = S.sample_report(lines, "c", 2, [0]).first()
    assert (r.row_count, r.malformed_rows, r.blank_keys, r.duplicate_keys) == (5, 2, 1, 1)


def test_grade_many_null_answer_and_first_rule(spark):
    answers = spark.createDataFrame([(1, 2.0), (2, None)], "k int, y double")
    subs = spark.createDataFrame(
        [("fine", 1, "1"), ("fine", 2, "5"), ("bad", 1, "NaN"), ("bad", 2, " "), ("other", 1, "1"), ("other", 3, "1")],
        "s string, k int, p string",
    )
    got = {r.s: r for r in S.grade_many(subs, answers, ["s"], "k").collect()}
    assert (got["fine"].verdict, got["fine"].matched, got["fine"].extra, got["fine"].score) == ("accepted", 2, 0, 1.0)
    assert got["bad"].verdict == "missing_value" and got["bad"].bad_values == 2
    assert got["other"].verdict == "extra_key"

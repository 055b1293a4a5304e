"""Scalar text, path, number, JSON and array rules over the tables' own values."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import jsonrules as J, text as X
from quern.functions.draws import rows, uniform
from quern.operators.panel import hours_minutes
from quern.plans.registry import query, u_sql

L = F.lit
WS = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def strip_sql(c):
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


@query("f04_text_digest", "SELECT doc_id, sha256(text) AS digest, octet_length(encode(text))::BIGINT AS bytes FROM documents")
def f04(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


RESPONSE_SQL = """
    r AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN text || chr(10) || '```python' || chr(10) || 'x = ' || doc_id || chr(10) || '```' || chr(10)
      WHEN 1 THEN text WHEN 2 THEN text || chr(10) || '```' || chr(10) || 'a' || chr(10) || '```' || chr(10) || 'more' || chr(10) || '```py' || chr(10) || 'b' || chr(10) || '```'
      WHEN 3 THEN '  ' || chr(10) || '```python' || chr(10) || text || chr(10) || '```' WHEN 4 THEN text || chr(10) || '```python' || chr(10) || '  ' || chr(10) || '```'
      ELSE text || chr(10) || '```PY  ' || chr(10) || text || chr(10) || '```' END AS response FROM documents)
"""


def responses(t):
    nl, txt = L("\n"), F.col("text")
    k = F.col("doc_id") % 6
    made = (
        F.when(k == 0, F.concat(txt, L("\n```python\nx = "), F.col("doc_id").cast("string"), L("\n```\n")))
        .when(k == 1, txt)
        .when(k == 2, F.concat(txt, L("\n```\na\n```\nmore\n```py\nb\n```")))
        .when(k == 3, F.concat(L("  \n```python\n"), txt, L("\n```")))
        .when(k == 4, F.concat(txt, L("\n```python\n  \n```")))
        .otherwise(F.concat(txt, L("\n```PY  \n"), txt, L("\n```")))
    )
    return t.documents.select("doc_id", made.alias("response"))


@query(
    "f06_plan_and_code",
    f"""
    WITH {RESPONSE_SQL}, m AS (SELECT *, '(?is)\\A\\s*(.*?)\\s*\\n```(?:python|py)?\\s*\\n(.*?)\\n```\\s*\\z' AS p FROM r),
    e AS (SELECT doc_id, regexp_matches(response, p) AS fits, {strip_sql('regexp_extract(response, p, 1)')} AS plan, {strip_sql('regexp_extract(response, p, 2)')} AS code FROM m),
    v AS (SELECT *, CASE WHEN NOT fits THEN 'not_plan_then_code' WHEN plan = '' OR code = '' THEN 'empty_part' WHEN contains(plan, '```') OR contains(code, '```') THEN 'extra_fence' ELSE 'accepted' END AS verdict FROM e)
    SELECT doc_id, verdict, CASE WHEN verdict = 'accepted' THEN length(plan) ELSE -1 END AS plan_chars, CASE WHEN verdict = 'accepted' THEN sha256(code || chr(10)) ELSE '' END AS code_hash FROM v
    """,
)
def f06(t):
    split = X.plan_and_code(responses(t), "response")
    ok = F.col("reason").isNull()
    return split.select(
        "doc_id", F.coalesce("reason", L("accepted")).alias("verdict"),
        F.when(ok, F.length("plan")).otherwise(-1).cast("long").alias("plan_chars"),
        F.when(ok, F.sha2("code", 256)).otherwise("").alias("code_hash"),
    )


@query(
    "f07_middle_excerpt",
    """
    WITH m AS (SELECT doc_id, text, chr(10) || '...[cut; ' || (length(text) - 400) || ' characters omitted]...' || chr(10) AS marker FROM documents),
    s AS (SELECT *, greatest(0, 400 - length(marker)) AS room FROM m)
    SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE left(text, room // 2) || marker || right(text, room - room // 2) END AS shown FROM s
    """,
)
def f07(t):
    return t.documents.select("doc_id", X.excerpt(F.col("text"), 400, "cut").alias("shown"))


@query(
    "f07_byte_cap",
    "SELECT doc_id, octet_length(encode(text)) > 1000 AS was_cut, CASE WHEN octet_length(encode(text)) > 1000 THEN '[output truncated after 1000 bytes]' ELSE right(text, 10) END AS tail FROM documents",
)
def f07_bytes(t):
    shown = X.byte_capped(F.col("text"), 1000)
    cut = F.octet_length("text") > 1000
    notice = "[output truncated after 1000 bytes]"
    return t.documents.select("doc_id", cut.alias("was_cut"), F.right(shown, F.when(cut, len(notice)).otherwise(10)).alias("tail"))


@query(
    "f08_template_fill",
    """
    WITH f AS (SELECT doc_id, replace(replace('{{lang}} from {{source}}' || CASE WHEN doc_id % 4 = 0 THEN ' in {{year}} and {{b_2}}' ELSE '' END, '{{lang}}', lang), '{{source}}', source) AS text FROM documents)
    SELECT doc_id, text, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\\{\\{[A-Za-z0-9_]+\\}\\}'))), ','), '') AS open_tokens FROM f
    """.replace("\\\\", "\\"),
)
def f08(t):
    template = F.concat(L("{{lang}} from {{source}}"), F.when(F.col("doc_id") % 4 == 0, " in {{year}} and {{b_2}}").otherwise(""))
    text = X.fill_template(template, {"lang": F.col("lang"), "source": F.col("source")})
    return t.documents.select("doc_id", text.alias("text")).select("doc_id", "text", F.array_join(X.open_tokens(F.col("text")), ",").alias("open_tokens"))


ERRORS = [
    "Command EXCEEDED the 60-second wall-clock limit", "solver did not create submission.csv", "File could not be scored: shape",
    "train.py does not exist", "exceeded memory", "KeyError: 'x'",
]


@query(
    "f09_failure_classes",
    f"""
    WITH e AS (SELECT event_type, lower(([{', '.join("'" + m.replace("'", "''") + "'" for m in ERRORS)}])[1 + event_id % 6]) AS m FROM events),
    c AS (SELECT event_type, CASE WHEN contains(m, 'exceeded') AND contains(m, 'wall-clock') THEN 'solver_timeout' WHEN contains(m, 'did not create') THEN 'missing_submission'
      WHEN contains(m, 'could not be scored') THEN 'invalid_submission' WHEN contains(m, 'does not exist') THEN 'no_usable_train_py' ELSE 'solver_runtime_error' END AS code FROM e)
    SELECT event_type, code, count(*) AS n FROM c GROUP BY 1, 2
    """,
)
def f09(t):
    message = F.element_at(F.array(*map(L, ERRORS)), (F.col("event_id") % 6 + 1).cast("int"))
    return t.events.groupBy("event_type", X.failure_code(message).alias("code")).agg(rows().alias("n"))


DROPS = ["p_size", "p_brand"]


@query(
    "f10_scrubbed_descriptions",
    """
    SELECT p_partkey, '# ' || p_name || chr(10) || '* `p_size` and `p_type`' || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || 'The p_size column of ' || p_type ELSE '' END || chr(10) || 'Note `p_brand` matters' AS text,
      '* `p_size` and `p_type`|Note `p_brand` matters' || CASE WHEN p_partkey % 3 = 0 THEN '|prose: …' || right('# ' || p_name || ' * `p_size` and `p_type` The ', 40) || 'p_size' || left(' column of ' || p_type || ' Note `p_brand` matters', 40) || '…' ELSE '' END AS leftovers
    FROM part
    """,
)
def f10(t):
    text = F.concat_ws(
        "\n", F.concat(L("# "), "p_name"), F.concat(L("- `p_brand`: like "), "p_brand"), L("* `p_size` and `p_type`"), L("  - `p_size`, `p_brand`"),
        F.when(F.col("p_partkey") % 3 == 0, F.concat(L("The p_size column of "), "p_type")), L("Note `p_brand` matters"),
    )
    made = t.part.select("p_partkey", text.alias("d"))
    done = made.select("p_partkey", X.scrub_lines(F.col("d"), DROPS, shown=110).alias("s"))
    return done.select("p_partkey", "s.text", F.array_join("s.leftovers", "|").alias("leftovers"))


@query(
    "f11_slugs",
    """
    WITH s AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '-') || '-hardened' WHEN 1 THEN p_name WHEN 2 THEN p_brand ELSE replace(p_name, ' ', '--') END AS name FROM part)
    SELECT p_partkey, regexp_matches(name, '^[a-z0-9]+(?:-[a-z0-9]+)*$') AS is_slug, regexp_replace(name, '-hardened$', '') AS base FROM s
    """,
)
def f11(t):
    k = F.col("p_partkey") % 4
    name = (
        F.when(k == 0, F.concat(F.replace("p_name", L(" "), L("-")), L("-hardened"))).when(k == 1, F.col("p_name"))
        .when(k == 2, F.col("p_brand")).otherwise(F.replace("p_name", L(" "), L("--")))
    )
    return t.part.select("p_partkey", name.rlike(X.SLUG).alias("is_slug"), F.regexp_replace(name, "-hardened$", "").alias("base"))


@query(
    "f12_heading_order",
    r"""
    WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '## Task' || chr(10) || text || chr(10) || '## Metric ' || chr(10) || '##  Submission Format' || chr(10) || '## Dataset'
      WHEN 1 THEN '## Metric' || chr(10) || '## Task' || chr(10) || '## Submission Format' || chr(10) || '## Dataset' || chr(10) || text WHEN 2 THEN '## Task' || chr(10) || '# Metric' || chr(10) || text ELSE text END AS text FROM documents),
    h AS (SELECT doc_id, list_transform(regexp_extract_all(text, '(?m)^##\s+(.+?)\s*$', 1), lambda x: lower(trim(x))) AS h FROM d),
    p AS (SELECT doc_id, list_filter(['task', 'metric', 'submission format', 'dataset'], lambda x: NOT list_contains(h, x)) AS missing, list_transform(['task', 'metric', 'submission format', 'dataset'], lambda x: list_position(h, x)) AS pos FROM h)
    SELECT doc_id, array_to_string(missing, ',') AS missing, len(missing) > 0 OR list_sort(pos) = pos AS in_order FROM p
    """,
)
def f12(t):
    k, txt = F.col("doc_id") % 4, F.col("text")
    made = (
        F.when(k == 0, F.concat(L("## Task\n"), txt, L("\n## Metric \n##  Submission Format\n## Dataset")))
        .when(k == 1, F.concat(L("## Metric\n## Task\n## Submission Format\n## Dataset\n"), txt))
        .when(k == 2, F.concat(L("## Task\n# Metric\n"), txt)).otherwise(txt)
    )
    rep = t.documents.select("doc_id", made.alias("d")).select("doc_id", X.heading_report(F.col("d")).alias("r"))
    return rep.select("doc_id", F.array_join("r.missing", ",").alias("missing"), "r.in_order")


@query(
    "f13_sentence_count",
    f"SELECT doc_id, len(regexp_extract_all({strip_sql('text')}, '[.!?](?:{WS}|$)'))::BIGINT AS sentences, length(text) > 600 AS too_long FROM documents",
)
def f13(t):
    return t.documents.select("doc_id", X.sentence_count(F.col("text")).cast("long").alias("sentences"), (F.length("text") > 600).alias("too_long"))


@query(
    "f14_safe_paths",
    r"""
    WITH u AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS p FROM pages),
    v AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'public/' || p WHEN 1 THEN '/public/' || p WHEN 2 THEN 'public/../' || p WHEN 3 THEN 'public\' || p WHEN 4 THEN 'public' WHEN 5 THEN 'public//' || p WHEN 6 THEN 'private/' || p ELSE 'public/./' || p END AS path FROM u),
    s AS (SELECT *, string_split(path, '/') AS parts FROM v)
    SELECT page_id, path, NOT contains(path, '\') AND len(parts) >= 2 AND parts[1] = 'public' AND len(list_filter(parts, lambda x: x IN ('', '.', '..'))) = 0 AS safe FROM s
    """,
)
def f14(t):
    p, k = F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1), F.col("page_id") % 8
    heads = ["public/", "/public/", "public/../", "public\\", None, "public//", "private/", "public/./"]
    path = L("public")
    for i, head in enumerate(heads):
        if head is not None:
            path = F.when(k == i, F.concat(L(head), p)).otherwise(path)
    return t.pages.select("page_id", path.alias("path")).select("page_id", "path", X.safe_path(F.col("path")).alias("safe"))


ANSWER_SQL = "'(?i)(^|[_\\-.])(answer|answers|ground[_-]?truth|private[_-]?label)([_\\-.]|$)'"


@query(
    "f15_answer_names",
    f"""
    WITH n AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'Answers_' WHEN 1 THEN 'ground-truth.' WHEN 2 THEN 'myanswer' WHEN 3 THEN 'data.private_label-' ELSE 'x' END || regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) AS name FROM pages)
    SELECT page_id, name, regexp_matches(name, {ANSWER_SQL}) AS suspicious FROM n
    """,
)
def f15(t):
    k = F.col("page_id") % 5
    head = F.when(k == 0, "Answers_").when(k == 1, "ground-truth.").when(k == 2, "myanswer").when(k == 3, "data.private_label-").otherwise("x")
    name = F.concat(head, F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1))
    return t.pages.select("page_id", name.alias("name")).select("page_id", "name", F.col("name").rlike(X.ANSWER_NAME).alias("suspicious"))


def _scan_sql(table, column):
    cells = ", ".join(f"sum(len(regexp_extract_all({column}, {_quoted(p)})))::BIGINT AS {n}" for n, p in X.VALUE_PATTERNS.items())
    return f"SELECT '{table}.{column}' AS field, {cells} FROM {table}"


def _quoted(pattern):
    return "'" + pattern.replace("'", "''") + "'"


@query(
    "f16_value_scan",
    " UNION ALL ".join(_scan_sql(*f) for f in [("documents", "text"), ("pages", "url"), ("pages", "html"), ("conversations", "text"), ("benchmark", "text")]),
)
def f16(t):
    out = None
    for table, column in [("documents", "text"), ("pages", "url"), ("pages", "html"), ("conversations", "text"), ("benchmark", "text")]:
        counts = X.pattern_counts(F.col(column))
        part = getattr(t, table).select(column).agg(L(f"{table}.{column}").alias("field"), *[F.sum(c).cast("long").alias(n) for n, c in counts.items()])
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "f17_number_text",
    "SELECT o_orderkey, printf('%.5f', o_totalprice) AS fixed5, printf('%+.5f', o_totalprice - 250000) AS gap, printf('%.12g', o_totalprice / 7) AS general FROM orders",
)
def f17(t):
    return t.orders.select(
        "o_orderkey", F.format_string("%.5f", "o_totalprice").alias("fixed5"),
        F.format_string("%+.5f", F.col("o_totalprice") - 250000).alias("gap"), X.number_12g(F.col("o_totalprice") / 7).alias("general"),
    )


@query(
    "f18_hours_minutes",
    "SELECT event_id, CASE WHEN m >= 60 THEN (m // 60) || 'hrs ' || (m % 60) || 'mins' ELSE m || 'mins' END AS shown FROM (SELECT event_id, json_extract(props, '$.k')::BIGINT * 3 AS m FROM events)",
)
def f18(t):
    return t.events.select("event_id", hours_minutes(F.get_json_object("props", "$.k").cast("long") * 3).alias("shown"))


@query(
    "f19_coarsening",
    """
    SELECT epoch_us(date_trunc('day', ts)) AS day_us, CASE WHEN value < 0 THEN 0 WHEN value >= 400 THEN 9 ELSE floor(value / 50)::BIGINT + 1 END AS bucket, count(*) AS n, sum(round(value / 10) * 10)::DOUBLE AS quantised FROM events GROUP BY 1, 2
    """,
)
def f19(t):
    return t.events.groupBy(
        F.unix_micros(F.date_trunc("day", "ts").cast("timestamp")).alias("day_us"), F.width_bucket("value", L(0.0), L(400.0), L(8)).cast("long").alias("bucket")
    ).agg(rows().alias("n"), F.sum(F.round(F.col("value") / 10) * 10).alias("quantised"))


@query(
    "f20_json_access",
    "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, json_extract(props, '$.a.b') IS NULL AS nested_absent, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}' AS built FROM events",
)
def f20(t):
    return t.events.select(
        "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.a.b").isNull().alias("nested_absent"),
        F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("built"),
    )


REVIEWS = [
    '{"is_bug": false, "has_csv_submission": true, "summary": "fine", "metric": @, "lower_is_better": true}',
    '{"is_bug": 1, "has_csv_submission": true, "summary": "fine", "metric": @, "lower_is_better": true}',
    '{"is_bug": false, "has_csv_submission": true, "summary": "  ", "metric": @, "lower_is_better": true}',
    '{"is_bug": false, "has_csv_submission": true, "summary": "fine", "metric": "@", "lower_is_better": true}',
    '{"is_bug": false, "has_csv_submission": true, "summary": "fine", "metric": true, "lower_is_better": false}',
    '{"is_bug": true, "has_csv_submission": false, "summary": "none", "metric": null, "lower_is_better": true}',
    '{"is_bug": true, "has_csv_submission": false, "summary": "none", "metric": null, "lower_is_better": true, "more": 1}',
    '{"is_bug": true, "has_csv_submission": false, "summary": "none", "metric": null}',
    '{"is_bug": true, "has_csv_submission": null, "summary": 5, "metric": [1], "lower_is_better": "yes"}',
]


@query(
    "f21_json_type_rules",
    f"""
    WITH r AS (SELECT event_id, replace(([{', '.join("'" + x + "'" for x in REVIEWS)}])[1 + event_id % 9], '@', printf('%.2f', value)) AS raw FROM events),
    k AS (SELECT *, list_sort(json_keys(raw)) AS keys, json_type(raw, '$.metric') AS mt, json_type(raw, '$.summary') AS st FROM r),
    e AS (SELECT event_id, CASE WHEN keys <> ['has_csv_submission', 'is_bug', 'lower_is_better', 'metric', 'summary'] THEN 'field_set' ELSE
      concat_ws(',', CASE WHEN json_type(raw, '$.is_bug') <> 'BOOLEAN' OR json_type(raw, '$.has_csv_submission') <> 'BOOLEAN' THEN 'boolean_fields' END,
        CASE WHEN st <> 'VARCHAR' OR trim(json_extract_string(raw, '$.summary')) = '' THEN 'summary' END, CASE WHEN mt NOT IN ('NULL', 'DOUBLE', 'BIGINT', 'UBIGINT') THEN 'metric' END,
        CASE WHEN json_type(raw, '$.lower_is_better') <> 'BOOLEAN' THEN 'direction' END) END AS errors FROM k)
    SELECT errors, count(*) AS n FROM e GROUP BY 1
    """,
)
def f21(t):
    shape = F.element_at(F.array(*map(L, REVIEWS)), (F.col("event_id") % 9 + 1).cast("int"))
    raw = t.events.select(F.replace(shape, L("@"), F.format_string("%.2f", "value")).alias("raw"))
    return J.review_errors(raw, "raw").groupBy(F.array_join("errors", ",").alias("errors")).agg(rows().alias("n"))


@query(
    "f22_map_merge",
    "SELECT event_id, 'k=' || CASE WHEN event_id % 2 = 0 THEN 'new' ELSE json_extract_string(props, '$.k') END || ',phase=' || event_type AS merged FROM events",
)
def f22(t):
    """The right map overrides; the transient retry keys are removed after the merge."""
    left = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(L("phase"), L("old"), L("retryAt"), L("1")))
    even = F.col("event_id") % 2 == 0
    right = F.when(even, F.create_map(L("phase"), F.col("event_type"), L("k"), L("new"))).otherwise(F.create_map(L("phase"), F.col("event_type")))
    merged = F.map_concat(F.map_filter(left, lambda k, v: ~F.array_contains(F.map_keys(right), k)), right)
    kept = F.map_filter(merged, lambda k, v: ~k.isin("retryAt", "retryDelaySeconds"))
    pairs = F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return t.events.select("event_id", F.array_join(pairs, ",").alias("merged"))


PHRASES = (["the ", "and", "The"], ["ouen", "thsh", "de la"])


@query(
    "f23_phrase_rules",
    """
    SELECT doc_id, array_to_string(list_filter(['the ', 'and', 'The'], lambda p: NOT contains(text, p)), '|') AS missing,
      array_to_string(list_filter(['ouen', 'thsh', 'de la'], lambda p: contains(lower(text), p)), '|') AS found FROM documents
    """,
)
def f23(t):
    missing, found = X.missing_phrases(F.col("text"), PHRASES[0]), X.forbidden_phrases(F.col("text"), PHRASES[1])
    return t.documents.select("doc_id", F.array_join(missing, "|").alias("missing"), F.array_join(found, "|").alias("found"))


@query(
    "f24_order_free_summaries",
    """
    SELECT vec_id, list_max(embedding)::DOUBLE AS top, list_min(embedding)::DOUBLE AS low, len(embedding)::BIGINT AS n, list_sort(embedding)[32]::DOUBLE AS middle,
      list_sum(list_transform(embedding, lambda x: floor(x::DOUBLE * 1000000)::BIGINT))::BIGINT AS total FROM embeddings
    """,
)
def f24(t):
    micro = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1_000_000))
    return t.embeddings.select(
        "vec_id", F.array_max("embedding").cast("double").alias("top"), F.array_min("embedding").cast("double").alias("low"),
        F.size("embedding").cast("long").alias("n"), F.element_at(F.array_sort("embedding"), 32).cast("double").alias("middle"),
        F.aggregate(micro, L(0).cast("long"), lambda a, x: a + x).alias("total"),
    )


@query(
    "f25_vector_checks",
    f"""
    WITH v AS (SELECT vec_id, label, CASE WHEN u < 0.1 THEN embedding[1:63] WHEN u < 0.2 THEN list_append(embedding[1:63], 'NaN'::FLOAT) ELSE embedding END AS e FROM (SELECT *, {u_sql(91, 'vec', 'vec_id')} AS u FROM embeddings))
    SELECT vec_id, len(e) = 64 AS length_ok, len(list_filter(e, lambda x: NOT isfinite(x))) = 0 AS finite_ok, label IN (0, 1, 2, 3, 4, 5, 6, 7) AS known_label FROM v
    """,
)
def f25(t):
    u = uniform(91, "vec", "vec_id")
    short = F.slice("embedding", 1, 63)
    e = F.when(u < 0.1, short).when(u < 0.2, F.array_append(short, L(float("nan")).cast("float"))).otherwise(F.col("embedding"))
    finite = F.forall("e", lambda x: ~F.isnan(x) & (F.abs(x) != L(float("inf"))))
    return t.embeddings.select("vec_id", "label", e.alias("e")).select(
        "vec_id", (F.size("e") == 64).alias("length_ok"), finite.alias("finite_ok"), F.col("label").isin(list(range(8))).alias("known_label")
    )

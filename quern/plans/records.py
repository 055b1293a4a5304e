"""Task records, packages, ledgers and audit reports built from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import jsonrules as J
from quern.functions.draws import count_where, rows, uniform
from quern.operators import compose as C
from quern.operators.splits import part_by_share
from quern.plans.panel_frame import PANEL_SQL, panel_of
from quern.plans.registry import query, u_sql
from quern.plans.splits import EXACT_SQL, sized

L = F.lit

# Task record text per part, one fault kind per p_partkey % 16.
RECORD_SQL = """
    rec AS (SELECT p_partkey, p_partkey % 16 AS m, replace(p_name, ' ', '-') || '-' || p_partkey AS slug, p_size % 2 = 0 AS low, p_size % 3 AS extra, p_brand, p_type FROM part),
    raw AS (SELECT p_partkey, slug, m, '{"competition_id": "' || CASE WHEN m = 1 THEN 'other' ELSE slug END || '", "dataset": "' || CASE WHEN m = 2 THEN '  ' ELSE p_brand END
      || '", "category": ' || CASE WHEN m = 3 THEN '7' ELSE '"' || p_type || '"' END || ', "short_description": "One sentence.", "is_lower_better": ' || CASE WHEN m = 4 THEN '1' WHEN low THEN 'true' ELSE 'false' END
      || ', "evaluation_metric": "RMSE", "gold_solution_score": ' || CASE WHEN m = 5 THEN '"x"' WHEN m = 6 THEN 'true' WHEN low THEN (10 - extra)::VARCHAR ELSE (40 + extra)::VARCHAR END
      || ', "score_tiers": ' || CASE WHEN m = 7 THEN '{"baseline": 40, "bronze": 30, "gold": 10}' WHEN m = 8 THEN '[]' WHEN low = (m <> 9) THEN '{"baseline": 40, "bronze": 30, "silver": 20, "gold": 10}' ELSE '{"baseline": 10, "bronze": 20, "silver": 30, "gold": 40}' END
      || ', "hidden_test_set": false, "hidden_test_paths": [], "wall_clock_limit_minutes": ' || CASE WHEN m = 10 THEN '60.0' WHEN m = 11 THEN '0' ELSE '60' END || ', "task_difficulty": ' || CASE WHEN m = 12 THEN '6' ELSE '2' END
      || CASE WHEN m = 13 THEN ', "baseline_score": 1' WHEN m = 14 THEN ', "dataset": "again"' ELSE '' END || CASE WHEN m = 15 THEN '' ELSE '}' END AS raw FROM rec)
"""


def records(t):
    m, low, extra = F.col("m"), F.col("low"), F.col("extra")
    c = lambda *parts: F.concat(*[L(p) if isinstance(p, str) else p for p in parts])
    down = '{"baseline": 40, "bronze": 30, "silver": 20, "gold": 10}'
    up = '{"baseline": 10, "bronze": 20, "silver": 30, "gold": 40}'
    base = t.part.select(
        "p_partkey", (F.col("p_partkey") % 16).alias("m"), c(F.replace("p_name", L(" "), L("-")), "-", F.col("p_partkey").cast("string")).alias("slug"),
        (F.col("p_size") % 2 == 0).alias("low"), (F.col("p_size") % 3).alias("extra"), "p_brand", "p_type",
    )
    raw = c(
        '{"competition_id": "', F.when(m == 1, "other").otherwise(F.col("slug")), '", "dataset": "', F.when(m == 2, "  ").otherwise(F.col("p_brand")),
        '", "category": ', F.when(m == 3, "7").otherwise(c('"', F.col("p_type"), '"')), ', "short_description": "One sentence.", "is_lower_better": ',
        F.when(m == 4, "1").when(low, "true").otherwise("false"), ', "evaluation_metric": "RMSE", "gold_solution_score": ',
        F.when(m == 5, '"x"').when(m == 6, "true").when(low, (10 - extra).cast("string")).otherwise((40 + extra).cast("string")),
        ', "score_tiers": ', F.when(m == 7, '{"baseline": 40, "bronze": 30, "gold": 10}').when(m == 8, "[]").when(low == (m != 9), down).otherwise(up),
        ', "hidden_test_set": false, "hidden_test_paths": [], "wall_clock_limit_minutes": ', F.when(m == 10, "60.0").when(m == 11, "0").otherwise("60"),
        ', "task_difficulty": ', F.when(m == 12, "6").otherwise("2"), F.when(m == 13, ', "baseline_score": 1').when(m == 14, ', "dataset": "again"').otherwise(""),
        F.when(m == 15, "").otherwise("}"),
    )
    return base.select("p_partkey", "slug", "m", raw.alias("raw"))


STATE_SQL = """
    st AS (SELECT *, CASE WHEN NOT json_valid(raw) THEN 'malformed' WHEN len(json_keys(raw)) <> len(list_distinct(json_keys(raw))) THEN 'duplicate_key' ELSE 'ok' END AS state,
      CASE WHEN json_valid(raw) THEN raw ELSE '{}' END AS doc FROM raw)
"""


@query("s06_duplicate_json_keys", f"WITH {RECORD_SQL}, {STATE_SQL} SELECT state, count(*) AS n FROM st GROUP BY 1")
def s06(t):
    return records(t).groupBy(J.document_state(F.col("raw")).alias("state")).agg(rows().alias("n"))


def _list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(
    "u03_field_sets",
    f"""
    WITH {RECORD_SQL}, {STATE_SQL}, k AS (SELECT p_partkey, json_keys(doc) AS k FROM st WHERE state <> 'malformed')
    SELECT p_partkey, array_to_string(list_sort(list_filter({_list(J.REQUIRED_FIELDS)}, lambda x: NOT list_contains(k, x))), ',') AS missing,
      array_to_string(list_sort(list_filter({_list(J.FORBIDDEN_FIELDS)}, lambda x: list_contains(k, x))), ',') AS forbidden,
      array_to_string(list_sort(list_distinct(list_filter(k, lambda x: NOT list_contains({_list(J.REQUIRED_FIELDS)}, x)))), ',') AS extra FROM k
    """,
)
def u03(t):
    sets = J.field_sets(F.col("raw"), J.REQUIRED_FIELDS, J.FORBIDDEN_FIELDS)
    legible = records(t).where(J.document_state(F.col("raw")) != "malformed")
    return legible.select("p_partkey", *[F.array_join(c, ",").alias(n) for n, c in sets.items()])


def _num(path):
    return f"CASE WHEN json_type(doc, '{path}') IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN json_extract(doc, '{path}')::DOUBLE END"


def _text_bad(name):
    return f"CASE WHEN coalesce(json_type(doc, '$.{name}'), '') <> 'VARCHAR' OR trim(json_extract_string(doc, '$.{name}')) = '' THEN '{name}' END"


TIER_SQL = f"""
    tn AS (SELECT *, {_num('$.score_tiers.baseline')} AS t1, {_num('$.score_tiers.bronze')} AS t2, {_num('$.score_tiers.silver')} AS t3, {_num('$.score_tiers.gold')} AS t4, {_num('$.gold_solution_score')} AS g,
      CASE json_type(doc, '$.is_lower_better') WHEN 'BOOLEAN' THEN json_extract(doc, '$.is_lower_better')::BOOLEAN END AS lower_b FROM st),
    te AS (SELECT *, t1 IS NOT NULL AND t2 IS NOT NULL AND t3 IS NOT NULL AND t4 IS NOT NULL AND lower_b IS NOT NULL AS usable FROM tn),
    tier AS (SELECT *, CASE WHEN usable AND NOT CASE WHEN lower_b THEN t1 >= t2 AND t2 >= t3 AND t3 >= t4 ELSE t1 <= t2 AND t2 <= t3 AND t3 <= t4 END THEN 'tier_order' END AS e1,
      CASE WHEN usable AND NOT CASE WHEN lower_b THEN g <= t4 ELSE g >= t4 END THEN 'gold_not_cleared' END AS e2,
      CASE WHEN usable AND CASE WHEN lower_b THEN g <= t4 ELSE g >= t4 END AND abs(g - t4) / greatest(1, abs(t4)) < 1e-4 THEN 'small_margin' END AS e3 FROM te)
"""


@query("g16_tier_order", f"WITH {RECORD_SQL}, {STATE_SQL}, {TIER_SQL} SELECT p_partkey, concat_ws(',', e1, e2, e3) AS errors FROM tier WHERE state = 'ok'")
def g16(t):
    return J.tier_errors(records(t), "raw").select("p_partkey", F.array_join("errors", ",").alias("errors"))


@query(
    "v01_task_record_rules",
    f"""
    WITH {RECORD_SQL}, {STATE_SQL}, {TIER_SQL}, e AS (SELECT p_partkey, CASE WHEN state <> 'ok' THEN state ELSE concat_ws(',',
      CASE WHEN len(list_filter({_list(J.REQUIRED_FIELDS)}, lambda x: NOT list_contains(json_keys(doc), x))) > 0 THEN 'missing_fields' END,
      CASE WHEN len(list_filter({_list(J.FORBIDDEN_FIELDS)}, lambda x: list_contains(json_keys(doc), x))) > 0 THEN 'forbidden_fields' END,
      CASE WHEN coalesce(json_extract_string(doc, '$.competition_id'), '') <> slug THEN 'competition_id' END, {_text_bad('category')}, {_text_bad('dataset')}, {_text_bad('evaluation_metric')}, {_text_bad('short_description')},
      CASE WHEN json_type(doc, '$.is_lower_better') <> 'BOOLEAN' THEN 'is_lower_better' END,
      CASE WHEN json_type(doc, '$.wall_clock_limit_minutes') NOT IN ('BIGINT', 'UBIGINT') OR json_extract(doc, '$.wall_clock_limit_minutes')::DOUBLE < 1 THEN 'wall_clock_limit_minutes' END,
      CASE WHEN json_type(doc, '$.task_difficulty') NOT IN ('BIGINT', 'UBIGINT') OR json_extract(doc, '$.task_difficulty')::DOUBLE NOT BETWEEN 1 AND 5 THEN 'task_difficulty' END,
      CASE WHEN g IS NULL THEN 'gold_solution_score' END, CASE WHEN json_type(doc, '$.score_tiers') <> 'OBJECT' THEN 'score_tiers' END,
      CASE WHEN json_type(doc, '$.score_tiers') = 'OBJECT' AND list_sort(json_keys(doc, '$.score_tiers')) <> ['baseline', 'bronze', 'gold', 'silver'] THEN 'tier_names' END,
      CASE WHEN json_type(doc, '$.score_tiers') = 'OBJECT' AND t3 IS NULL THEN 'score_tiers.silver' END, e1, e2) END AS errors FROM tier)
    SELECT errors, count(*) AS n FROM e GROUP BY 1
    """,
)
def v01(t):
    checked = J.task_record_errors(records(t), "raw", "slug", final=True)
    return checked.groupBy(F.array_join("errors", ",").alias("errors")).agg(rows().alias("n"))


@query(
    "v06_contract_diff",
    f"""
    WITH {RECORD_SQL}, {STATE_SQL}, a AS (SELECT p_partkey, json_extract_string(doc, '$.evaluation_metric') AS metric, json_extract_string(doc, '$.category') AS category FROM st WHERE state = 'ok'),
    b AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'MAE' ELSE metric END AS metric, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE category END AS category FROM a)
    SELECT 'metric' AS field, count(*) FILTER (a.metric IS DISTINCT FROM b.metric) AS changed FROM a JOIN b USING (p_partkey)
    UNION ALL SELECT 'category', count(*) FILTER (a.category IS DISTINCT FROM b.category) FROM a JOIN b USING (p_partkey)
    UNION ALL SELECT '<rows>', 0 FROM (SELECT 1)
    """,
)
def v06(t):
    raw = F.col("raw")
    before = records(t).where(J.parsed(raw).isNotNull()).select(
        "p_partkey", F.get_json_object(raw, "$.evaluation_metric").alias("metric"), F.get_json_object(raw, "$.category").alias("category")
    )
    after = before.select(
        "p_partkey", F.when(F.col("p_partkey") % 7 == 0, "MAE").otherwise(F.col("metric")).alias("metric"),
        F.when(F.col("p_partkey") % 11 != 0, F.col("category")).alias("category"),
    )
    return C.table_diff(before, after, ["p_partkey"]).withColumnsRenamed({"column_name": "field", "mismatches": "changed"})


# Candidate criteria; a zero in the first four is fatal.
CRITERIA = ["label_validity", "prediction_time_validity", "privacy", "evaluation_validity", "split_realism", "support", "shortcut_resistance", "modeling_paths", "feasible_size", "headroom"]


def _criterion_sql(i):
    return f"CASE WHEN {u_sql(101, CRITERIA[i], 'p_partkey')} < 0.1 THEN 0 WHEN {u_sql(101, CRITERIA[i], 'p_partkey')} < 0.5 THEN 1 ELSE 2 END"


@query(
    "v08_candidate_scoring",
    f"""
    WITH s AS (SELECT p_partkey, {', '.join(f'{_criterion_sql(i)} AS c{i}' for i in range(10))} FROM part)
    SELECT c0 = 0 OR c1 = 0 OR c2 = 0 OR c3 = 0 AS fatal, ({' + '.join(f'c{i}' for i in range(10))})::BIGINT AS total, count(*) AS candidates FROM s GROUP BY 1, 2
    """,
)
def v08(t):
    def points(name):
        u = uniform(101, name, "p_partkey")
        return F.when(u < 0.1, 0).when(u < 0.5, 1).otherwise(2)

    s = t.part.select("p_partkey", *[points(c).alias(c) for c in CRITERIA])
    fatal = F.least(*CRITERIA[:4]) == 0
    total = sum((F.col(c) for c in CRITERIA), L(0)).cast("long")
    return s.groupBy(fatal.alias("fatal"), total.alias("total")).agg(rows().alias("candidates"))


@query(
    "v09_goal_distinctness",
    """
    WITH s AS (SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split_regex(lower(p_name || ' ' || p_type), '[^a-z0-9]+'))), ' ') AS sig FROM part)
    SELECT sig, count(*) AS n, min(p_partkey) AS first_seen, count(*) - 1 AS repeats FROM s GROUP BY 1
    """,
)
def v09(t):
    words = F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), "[^a-z0-9]+")
    sig = F.array_join(F.array_sort(F.array_distinct(words)), " ")
    return t.part.groupBy(sig.alias("sig")).agg(rows().alias("n"), F.min("p_partkey").alias("first_seen"), (rows() - 1).alias("repeats"))


LEDGER = ["source_time", "cutoff_rule", "fit_set", "missing_meaning", "probe_result"]


@query(
    "v10_availability_ledger",
    f"""
    WITH cat AS (SELECT DISTINCT p_brand || '/' || p_type AS family FROM part),
    led AS (SELECT family || CASE WHEN {u_sql(102, 'stray', 'family')} < 0.05 THEN '-old' ELSE '' END AS family, {', '.join(f"CASE WHEN {u_sql(102, c, 'family')} >= 0.1 THEN 'given' END AS {c}" for c in LEDGER)} FROM cat)
    SELECT coalesce(cat.family, led.family) AS family, CASE WHEN led.family IS NULL THEN 'not_in_ledger' WHEN cat.family IS NULL THEN 'not_public' ELSE concat_ws(',', {', '.join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in LEDGER)}) END AS errors
    FROM cat FULL JOIN led ON cat.family = led.family
    """,
)
def v10(t):
    cat = t.part.select(F.concat_ws("/", "p_brand", "p_type").alias("family")).distinct()
    led = cat.select(
        F.concat("family", F.when(uniform(102, "stray", "family") < 0.05, "-old").otherwise("")).alias("family"),
        *[F.when(uniform(102, c, "family") >= 0.1, "given").alias(c) for c in LEDGER], L(True).alias("listed"),
    )
    j = cat.withColumn("public", L(True)).join(led, "family", "full_outer")
    gaps = F.concat_ws(",", *[F.when(F.col(c).isNull(), c) for c in LEDGER])
    return j.select("family", F.when(F.col("listed").isNull(), "not_in_ledger").when(F.col("public").isNull(), "not_public").otherwise(gaps).alias("errors"))


@query(
    "v11_freeze_order",
    f"""
    WITH {PANEL_SQL}, f AS (SELECT task, max(last_us) FILTER (variant = 'before') AS frozen, min(first_us) FILTER (variant = 'after') AS later, min(first_us) FILTER (run = 5) AS run5, max(last_us) FILTER (run = 1) AS run1, count(*) FILTER (last_type = 'purchase') AS private_feedback FROM panel GROUP BY 1)
    SELECT task, coalesce(frozen < later, false) AS frozen_first, coalesce(run1 < run5, false) AS runs_in_order, private_feedback FROM f
    """,
)
def v11(t):
    f = panel_of(t.events).groupBy("task").agg(
        F.max(F.when(F.col("variant") == "before", F.col("last_us"))).alias("frozen"), F.min(F.when(F.col("variant") == "after", F.col("first_us"))).alias("later"),
        F.min(F.when(F.col("run") == 5, F.col("first_us"))).alias("run5"), F.max(F.when(F.col("run") == 1, F.col("last_us"))).alias("run1"),
        count_where("last_type = 'purchase'").alias("private_feedback"),
    )
    return f.select(
        "task", F.coalesce(F.col("frozen") < F.col("later"), L(False)).alias("frozen_first"),
        F.coalesce(F.col("run1") < F.col("run5"), L(False)).alias("runs_in_order"), "private_feedback",
    )


@query(
    "v05_target_placement",
    f"""
    WITH {EXACT_SQL} SELECT 'train_profile' AS extract, true AS has_target, true AS as_intended, count(*) FILTER (NOT is_test) AS n FROM sized UNION ALL SELECT 'train_commercial', false, true, count(*) FILTER (NOT is_test) FROM sized
    UNION ALL SELECT 'test_profile', false, true, count(*) FILTER (is_test) FROM sized UNION ALL SELECT 'test_commercial', false, true, count(*) FILTER (is_test) FROM sized
    """,
)
def v05(t):
    target = "o_totalprice"
    split = sized(t)
    profile, commercial = C.cut_extracts(t.orders, "o_orderkey", target, [])
    out = None
    for part, cond in (("train", "not is_test"), ("test", "is_test")):
        for name, cols in (("profile", profile.columns), ("commercial", commercial.columns)):
            cols = [c for c in cols if part == "train" or c != target]
            has = target in cols
            row = split.where(cond).select(*cols).agg(
                L(f"{part}_{name}").alias("extract"), L(has).alias("has_target"), L(has == (part == "train" and name == "profile")).alias("as_intended"), rows().alias("n")
            )
            out = row if out is None else out.unionByName(row)
    return out


@query(
    "v07_audit_report",
    f"""
    WITH s AS (SELECT *, CASE WHEN {u_sql(5, 'part', 'o_orderkey')} < 0.75 THEN 'train' ELSE 'test' END AS part FROM orders),
    c AS (SELECT 'entity_overlap' AS name, (SELECT count(*) FROM (SELECT o_orderkey FROM s GROUP BY 1 HAVING count(DISTINCT part) > 1)) AS found
      UNION ALL SELECT 'parent_overlap', (SELECT count(*) FROM (SELECT o_custkey FROM s GROUP BY 1 HAVING count(DISTINCT part) > 1))
      UNION ALL SELECT 'duplicate_keys', (SELECT count(*) FROM (SELECT o_orderkey FROM s GROUP BY 1 HAVING count(*) > 1)) UNION ALL SELECT 'missing_target', (SELECT count(*) FROM s WHERE o_totalprice IS NULL))
    SELECT name, found, CASE WHEN found = 0 THEN 'pass' ELSE 'fail' END AS status FROM c
    """,
)
def v07(t):
    s = t.orders.withColumn("part", part_by_share(5, {"train": 0.75, "test": 0.25}, "o_orderkey"))
    train, test = s.where("part = 'train'"), s.where("part = 'test'")
    checks = [
        ("entity_overlap", C.shared_keys(train, test, ["o_orderkey"])), ("parent_overlap", C.shared_keys(train, test, ["o_custkey"])),
        ("duplicate_keys", s.groupBy("o_orderkey").agg(rows().alias("n")).where("n > 1")), ("missing_target", s.where("o_totalprice is null")),
    ]
    out = None
    for name, found in checks:
        row = found.agg(L(name).alias("name"), rows().alias("found"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("status", F.when(F.col("found") == 0, "pass").otherwise("fail"))


# File listing of made packages: twenty pages each, five kinds of file.
LISTING_SQL = """
    ls AS (SELECT 'pkg' || (page_id // 20) AS pkg, CASE page_id % 5 WHEN 0 THEN 'public/description.md' WHEN 1 THEN 'public/data/' || page_id || '.csv' WHEN 2 THEN 'public/answers_' || page_id || '.csv'
      WHEN 3 THEN 'private/' || page_id || '.csv' ELSE 'hidden-test/public/data/' || (page_id - CASE WHEN page_id % 10 = 4 THEN 3 ELSE 0 END) || '.csv' END AS path, length(html) AS size, url FROM pages),
    listing AS (SELECT pkg, path, sum(size)::BIGINT AS size FROM ls GROUP BY 1, 2)
"""


def listing(t):
    k, i = F.col("page_id") % 5, F.col("page_id").cast("string")
    shown = (F.col("page_id") - F.when(F.col("page_id") % 10 == 4, 3).otherwise(0)).cast("string")
    path = (
        F.when(k == 0, "public/description.md").when(k == 1, F.concat(L("public/data/"), i, L(".csv"))).when(k == 2, F.concat(L("public/answers_"), i, L(".csv")))
        .when(k == 3, F.concat(L("private/"), i, L(".csv"))).otherwise(F.concat(L("hidden-test/public/data/"), shown, L(".csv")))
    )
    pkg = F.concat(L("pkg"), F.expr("page_id div 20").cast("string"))
    return t.pages.groupBy(pkg.alias("pkg"), path.alias("path")).agg(F.sum(F.length("html")).alias("size"))


@query("a29_package_sizes", f"WITH {LISTING_SQL} SELECT pkg, string_split(path, '/')[1] AS side, count(*) AS files, sum(size)::BIGINT AS bytes FROM listing GROUP BY 1, 2")
def a29(t):
    return listing(t).groupBy("pkg", F.split("path", "/")[0].alias("side")).agg(rows().alias("files"), F.sum("size").alias("bytes"))


@query(
    "v02_hidden_mirror",
    f"""
    WITH {LISTING_SQL}, decl AS (SELECT pkg, path FROM listing WHERE starts_with(path, 'public/data/')),
    hid AS (SELECT pkg, substr(path, 13) AS path FROM listing WHERE starts_with(path, 'hidden-test/')),
    e AS (SELECT d.pkg, 'replacement_missing' AS error FROM decl d LEFT JOIN hid h USING (pkg, path) WHERE h.path IS NULL
      UNION ALL SELECT h.pkg, 'unlisted_payload' FROM hid h WHERE NOT EXISTS (SELECT 1 FROM decl d WHERE d.pkg = h.pkg AND (d.path = h.path OR starts_with(h.path, d.path || '/'))))
    SELECT pkg, error, count(*) AS n FROM e GROUP BY 1, 2
    """,
)
def v02(t):
    from quern.operators.packages import hidden_mirror

    files = listing(t)
    declared = files.where("startswith(path, 'public/data/')").select("pkg", "path")
    return hidden_mirror(files, declared).groupBy("pkg", "error").agg(rows().alias("n"))


@query(
    "v03_public_assets",
    f"""
    WITH {LISTING_SQL}, pub AS (SELECT pkg, path, string_split(path, '/')[-1] AS name FROM listing WHERE starts_with(path, 'public/')),
    g AS (SELECT l.pkg, bool_or(starts_with(path, 'public/')) AS has_public, bool_or(starts_with(path, 'private/')) AS has_private FROM listing l GROUP BY 1),
    a AS (SELECT pkg, count(*) FILTER (name NOT IN ('description.md', 'sample_submission.csv')) AS assets, count(*) FILTER (name NOT IN ('description.md', 'sample_submission.csv') AND regexp_matches(name, '(?i)(^|[_\\-.])(answer|answers|ground[_-]?truth|private[_-]?label)([_\\-.]|$)')) AS suspicious FROM pub GROUP BY 1)
    SELECT pkg, concat_ws(',', CASE WHEN NOT has_public THEN 'missing_public' END, CASE WHEN NOT has_private THEN 'missing_private' END, CASE WHEN has_public AND assets = 0 THEN 'no_data_assets' END) AS errors, coalesce(suspicious, 0) AS warnings FROM g LEFT JOIN a USING (pkg)
    """,
)
def v03(t):
    from quern.operators.packages import public_assets

    return public_assets(listing(t))


@query(
    "v04_documented_assets",
    f"""
    WITH {LISTING_SQL}, doc AS (SELECT DISTINCT pkg, CASE WHEN {u_sql(104, 'doc', 'path')} < 0.1 THEN path || '.gz' ELSE path END AS path FROM listing WHERE starts_with(path, 'public/')),
    real AS (SELECT pkg, path FROM listing WHERE starts_with(path, 'public/'))
    SELECT coalesce(d.pkg, r.pkg) AS pkg, count(*) FILTER (r.path IS NULL) AS documented_only, count(*) FILTER (d.path IS NULL) AS undocumented, count(*) FILTER (d.path = r.path) AS both FROM doc d FULL JOIN real r ON d.pkg = r.pkg AND d.path = r.path GROUP BY 1
    """,
)
def v04(t):
    real = listing(t).where("startswith(path, 'public/')").select("pkg", "path")
    doc = real.select("pkg", F.when(uniform(104, "doc", "path") < 0.1, F.concat("path", L(".gz"))).otherwise(F.col("path")).alias("path")).distinct()
    from quern.operators.packages import documented_assets

    return documented_assets(doc, real)

"""Joins between sources, extracts, partitions and catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.draws import count_where, uniform
from quern.operators import compose as C, disclosure, neighbours
from quern.operators.ordered import DAY, as_of, micros
from quern.operators.splits import part_by_share
from quern.plans.panel_frame import PANEL_SQL, panel_of
from quern.plans.registry import d_sql, query, u_sql
from quern.session import materialise

MONEY = "decimal(18,2)"
PATH = r"^https?://[^/]+/([^?#]*?)/?(?:[?#].*)?$"


@query(
    "j01_inner_merge",
    """
    SELECT c_mktsegment, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
    """,
)
def inner_merge(t):
    source = t.customer.withColumnRenamed("c_custkey", "o_custkey")
    merged = C.merge_sources(t.orders, source, "o_custkey", ["c_mktsegment"], ["c_region_hint"])
    return merged.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("o_totalprice").cast(MONEY)).cast("double").alias("total"),
    )


@query(
    "j02_rejoin_extracts",
    """
    WITH a AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders),
    b AS (SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders),
    j AS (SELECT * FROM a JOIN b USING (o_orderkey)),
    f AS (SELECT j.o_orderkey AS jk, o.o_orderkey AS ok, j.o_custkey IS DISTINCT FROM o.o_custkey AS c1,
      j.o_orderstatus IS DISTINCT FROM o.o_orderstatus AS c2, j.o_orderdate IS DISTINCT FROM o.o_orderdate AS c3,
      j.o_orderpriority IS DISTINCT FROM o.o_orderpriority AS c4,
      coalesce(abs(j.o_totalprice - o.o_totalprice) > 1e-12, true) AS c5
      FROM j FULL JOIN orders o ON j.o_orderkey = o.o_orderkey)
    SELECT '<rows>' AS column_name, count(*) FILTER (jk IS NULL OR ok IS NULL) AS mismatches, count(*) AS n FROM f
    UNION ALL SELECT 'o_custkey', count(*) FILTER (c1), count(*) FROM f
    UNION ALL SELECT 'o_orderstatus', count(*) FILTER (c2), count(*) FROM f
    UNION ALL SELECT 'o_orderdate', count(*) FILTER (c3), count(*) FROM f
    UNION ALL SELECT 'o_orderpriority', count(*) FILTER (c4), count(*) FROM f
    UNION ALL SELECT 'o_totalprice', count(*) FILTER (c5), count(*) FROM f
    """,
)
def rejoin_extracts(t):
    profile, commercial = C.cut_extracts(t.orders, "o_orderkey", "o_totalprice", [])
    diff = C.table_diff(profile.join(commercial, "o_orderkey"), t.orders, ["o_orderkey"])
    return diff.withColumn("n", t.orders.select(F.count(F.lit(1))).scalar())


@query(
    "j03_positional_concat",
    f"""
    WITH a AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY {d_sql(1, 'shuffle', 'o_orderkey')}, o_orderkey) AS pos FROM orders),
    b AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY {d_sql(2, 'shuffle', 'o_orderkey')}, o_orderkey) AS pos FROM orders)
    SELECT count(*) AS n, count(*) FILTER (a.k <> b.k) AS mismatched,
      round(count(*) FILTER (a.k <> b.k) / count(*), 9) AS mismatch_rate
    FROM a JOIN b USING (pos)
    """,
)
def positional_concat(t):
    left, right = C.cut_extracts(t.orders, "o_orderkey", "o_totalprice", [])
    wrong = count_where("left_o_orderkey <> right_o_orderkey")
    return C.positional_concat(left, right, "o_orderkey").agg(
        F.count(F.lit(1)).alias("n"),
        wrong.alias("mismatched"),
        F.round(wrong / F.count(F.lit(1)), 9).alias("mismatch_rate"),
    )


@query(
    "j04_key_overlap_gate",
    """
    WITH l AS (SELECT DISTINCT o_custkey AS k FROM orders), r AS (SELECT DISTINCT c_custkey AS k FROM customer),
    n AS (SELECT (SELECT count(*) FROM l) AS left_keys, (SELECT count(*) FROM r) AS right_keys,
      (SELECT count(*) FROM l JOIN r USING (k)) AS shared_keys)
    SELECT *, round(shared_keys / left_keys, 9) AS left_rate, round(shared_keys / right_keys, 9) AS right_rate FROM n
    """,
)
def key_overlap_gate(t):
    return C.key_overlap(
        t.orders.select(F.col("o_custkey").alias("k")),
        t.customer.select(F.col("c_custkey").alias("k")), "k",
    )


@query(
    "j05_partition_disjointness",
    f"""
    WITH s AS (SELECT *, CASE WHEN {u_sql(5, 'part', 'o_orderkey')} < 0.75 THEN 'train' ELSE 'test' END AS part FROM orders),
    f AS (SELECT 'entity' AS family, o_orderkey AS k, part FROM s UNION ALL SELECT 'parent', o_custkey, part FROM s)
    SELECT family, count(*) FILTER (parts = 2) AS shared_keys, count(*) AS distinct_keys
    FROM (SELECT family, k, count(DISTINCT part) AS parts FROM f GROUP BY 1, 2) GROUP BY 1
    """,
)
def partition_disjointness(t):
    parted = t.orders.withColumn(
        "part", part_by_share(5, {"train": 0.75, "test": 0.25}, "o_orderkey")
    )
    families = parted.select(
        "part",
        F.explode(
            F.array(
                F.struct(F.lit("entity").alias("family"), F.col("o_orderkey").alias("k")),
                F.struct(F.lit("parent").alias("family"), F.col("o_custkey").alias("k")),
            )
        ).alias("f"),
    ).select("part", "f.*")
    sides = families.groupBy("family", "k").agg(
        F.max((F.col("part") == "train").cast("int")).alias("a"),
        F.max((F.col("part") == "test").cast("int")).alias("b"),
    )
    return sides.groupBy("family").agg(
        F.sum(F.col("a") * F.col("b")).cast("long").alias("shared_keys"),
        F.count(F.lit(1)).alias("distinct_keys"),
    )


SUBMISSION_SQL = f"""
    sub AS (SELECT o_orderkey AS k FROM orders WHERE {u_sql(6, 'miss', 'o_orderkey')} >= 0.02
      UNION ALL SELECT o_orderkey FROM orders WHERE {u_sql(6, 'dup', 'o_orderkey')} < 0.01
      UNION ALL SELECT o_orderkey + 1000000000 FROM orders WHERE {u_sql(6, 'extra', 'o_orderkey')} < 0.01),
    m AS (SELECT k, sum(a) AS a, sum(s) AS s FROM (SELECT o_orderkey AS k, 1 AS a, 0 AS s FROM orders
      UNION ALL SELECT k, 0, 1 FROM sub) GROUP BY k)
"""


@query(
    "j06_one_to_one_match",
    f"""
    WITH {SUBMISSION_SQL}
    SELECT count(*) AS keys, count(*) FILTER (a > 0 AND s = 0) AS missing_keys,
      count(*) FILTER (a = 0 AND s > 0) AS extra_keys, count(*) FILTER (s > 1) AS duplicate_keys,
      count(*) FILTER (a > 1) AS duplicate_answers, count(*) FILTER (a = 1 AND s = 1) AS matched_keys FROM m
    """,
)
def one_to_one_match(t):
    keys = t.orders.select("o_orderkey")
    submission = (
        keys.where(uniform(6, "miss", "o_orderkey") >= 0.02)
        .unionByName(keys.where(uniform(6, "dup", "o_orderkey") < 0.01))
        .unionByName(
            keys.where(uniform(6, "extra", "o_orderkey") < 0.01)
            .select((F.col("o_orderkey") + 1_000_000_000).alias("o_orderkey"))
        )
    )
    return C.match_report(keys, submission, "o_orderkey")


@query(
    "j07_mapping_substitution",
    """
    SELECT o_orderkey, 'N' || c.c_nationkey || '-' || c.c_custkey AS o_custkey
    FROM orders JOIN customer c ON o_custkey = c_custkey
    """,
)
def mapping_substitution(t):
    mapping = t.customer.select(
        F.col("c_custkey").cast("string").alias("value"),
        F.concat(F.lit("N"), "c_nationkey", F.lit("-"), "c_custkey").alias("code"),
    )
    return C.substitute(t.orders.select("o_orderkey", "o_custkey"), mapping, "o_custkey")


def _asof(t, inclusive, delay=0):
    e = t.events.select("event_id", "user_id", "event_type", "value", F.date_trunc("hour", "ts").alias("h"))
    e = e.withColumn("at", micros("h"))
    probe = e.where("event_type = 'purchase'").select("event_id", "user_id", "at")
    build = e.where("event_type = 'click'").groupBy("user_id", "at").agg(F.max("value").alias("v"))
    build = build.withColumn("seen_at", F.col("at"))
    return as_of(probe, build, ["user_id"], "at", ["seen_at", "v"], inclusive, delay).select(
        "event_id", "user_id", "at", F.col("asof_seen_at").cast("double").alias("seen_at"),
        F.col("asof_v").alias("v"),
    )


def _asof_sql(op, delay=0):
    return f"""
    WITH e AS (SELECT *, epoch_us(date_trunc('hour', ts)) AS "at" FROM events),
    p AS (SELECT event_id, user_id, "at" FROM e WHERE event_type = 'purchase'),
    b AS (SELECT user_id, "at" AS seen_at, "at" + {delay} AS "at", max(value) AS v FROM e WHERE event_type = 'click' GROUP BY 1, 2, 3)
    SELECT p.event_id, p.user_id, p."at", b.seen_at::DOUBLE AS seen_at, b.v
    FROM p ASOF LEFT JOIN b ON p.user_id = b.user_id AND p."at" {op} b."at"
    """


@query("j08_asof_strict", _asof_sql(">"))
def asof_strict(t):
    return _asof(t, inclusive=False)


@query("j08_asof_inclusive", _asof_sql(">="))
def asof_inclusive(t):
    return _asof(t, inclusive=True)


@query("j08_asof_delayed", _asof_sql(">", 6 * 3600 * 1_000_000))
def asof_delayed(t):
    return _asof(t, inclusive=False, delay=6 * 3600 * 1_000_000)


@query(
    "j09_interval_overlap",
    """
    WITH w AS (SELECT o_orderkey, o_custkey, o_orderdate AS s, o_orderdate + INTERVAL 45 DAY AS e FROM orders),
    tr AS (SELECT * FROM w WHERE s < TIMESTAMP '1999-01-01'), te AS (SELECT * FROM w WHERE s >= TIMESTAMP '1999-01-01')
    SELECT te.o_orderkey, te.o_custkey, count(tr.o_orderkey) AS overlaps
    FROM te LEFT JOIN tr ON te.o_custkey = tr.o_custkey AND te.s < tr.e AND tr.s < te.e GROUP BY 1, 2
    """,
)
def interval_overlap(t):
    w = t.orders.select("o_orderkey", "o_custkey", micros("o_orderdate").alias("s")).withColumn(
        "e", F.col("s") + F.lit(45 * DAY)
    )
    cut = F.unix_micros(F.lit("1999-01-01").cast("timestamp"))
    return C.overlap_counts(
        w.where(F.col("s") >= cut), w.where(F.col("s") < cut), ["o_custkey"], "s", "e"
    ).select("o_orderkey", "o_custkey", "overlaps")


@query(
    "j10_uncovered_paths",
    r"""
    WITH p AS (SELECT DISTINCT regexp_extract(url, '^https?://[^/]+/([^?#]*?)/?(?:[?#].*)?$', 1) AS path FROM pages),
    d AS (SELECT DISTINCT regexp_extract(url, '^https?://[^/]+/([^?#]*?)/?(?:[?#].*)?$', 1) AS path FROM pages WHERE contains(url, '?'))
    SELECT path FROM p WHERE NOT EXISTS (SELECT 1 FROM d WHERE p.path = d.path OR starts_with(p.path, d.path || '/'))
    """,
)
def uncovered_paths(t):
    pages = t.pages.select("url", F.regexp_extract("url", PATH, 1).alias("path"))
    return C.uncovered_paths(
        pages.select("path").distinct(), pages.where(F.contains("url", F.lit("?"))).select("path"), "path"
    )


@query(
    "j11_expected_run_grid",
    f"""
    WITH {PANEL_SQL}
    SELECT task, variant, profile, run FROM (SELECT DISTINCT task FROM panel),
      (VALUES ('before'), ('after')) v(variant), (VALUES ('weak'), ('strong')) p(profile), range(1, 6) r(run)
    """,
)
def expected_run_grid(t):
    tasks = panel_of(t.events).select("task").distinct()
    grid = C.expected_runs(tasks, ["before", "after"], ["weak", "strong"], 5)
    return grid.withColumn("run", F.col("run").cast("long"))


@query(
    "j12_pending_runs",
    f"""
    WITH {PANEL_SQL},
    grid AS (SELECT task, variant, profile, run FROM (SELECT DISTINCT task FROM panel),
      (VALUES ('before'), ('after')) v(variant), (VALUES ('weak'), ('strong')) p(profile), range(1, 6) r(run))
    SELECT task, variant, profile, run, CASE WHEN state IS NULL THEN 'start' WHEN state = 'running' THEN 'resume' ELSE 'redo' END AS action
    FROM grid LEFT JOIN panel USING (task, variant, profile, run) WHERE state IS NULL OR state <> 'scored'
    """,
)
def pending_runs(t):
    panel = panel_of(t.events)
    cell = ["task", "variant", "profile", "run"]
    grid = C.expected_runs(panel.select("task").distinct(), ["before", "after"], ["weak", "strong"], 5)
    grid = grid.withColumn("run", F.col("run").cast("long"))
    todo = grid.join(panel.select(*cell, "state"), cell, "left").where("state is null or state <> 'scored'")
    action = F.when(F.col("state").isNull(), "start").when(F.col("state") == "running", "resume")
    return todo.select(*cell, action.otherwise("redo").alias("action"))


def normal_text(c):
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


@query(
    "j13_exact_copies",
    rf"""
    WITH s AS (SELECT doc_id, source, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS h,
      CASE WHEN {u_sql(13, 'part', 'doc_id')} < 0.75 THEN 'train' ELSE 'test' END AS part FROM documents)
    SELECT source, count(*) AS test_docs, count(*) FILTER (h IN (SELECT h FROM s WHERE part = 'train')) AS copied
    FROM s WHERE part = 'test' GROUP BY 1
    """,
)
def exact_copies(t):
    # Digests are written once; both sides of the join read them instead of the texts.
    docs = materialise(t.documents.select("doc_id", "source", "text").select(
        "source",
        F.sha2(normal_text("text"), 256).alias("h"),
        part_by_share(13, {"train": 0.75, "test": 0.25}, "doc_id").alias("part"),
    ))
    train = docs.where("part = 'train'").select("h").distinct().withColumn("hit", F.lit(1))
    return (
        docs.where("part = 'test'").join(train, "h", "left").groupBy("source")
        .agg(F.count(F.lit(1)).alias("test_docs"), F.count("hit").alias("copied"))
    )


SHINGLES = r"""
    SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] ELSE
      list_transform(range(1, greatest(len(w) - {k} + 1, 1) + 1), lambda i: array_to_string(w[i:i + {k} - 1], ' ')) END) AS s
    FROM (SELECT {key}, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM {table})
"""


@query(
    "j13_shingle_coverage",
    f"""
    WITH d AS ({SHINGLES.format(key='doc_id', k=8, table='documents')}),
    b AS (SELECT DISTINCT s FROM ({SHINGLES.format(key='item_id', k=8, table='benchmark')}))
    SELECT doc_id, count(*) AS shingles, count(b.s) AS shared, count(b.s) >= 0.5 * count(*) AS near_copy
    FROM d LEFT JOIN b ON d.s = b.s GROUP BY 1
    """,
)
def shingle_coverage(t):
    c = C.shingle_coverage(t.documents, t.benchmark, "doc_id", "text", 8)
    return c.withColumn("near_copy", F.col("shared") >= 0.5 * F.col("shingles"))


@query(
    "j13_near_copies_across_parts",
    f"""
    WITH d AS (SELECT *, {u_sql(13, 'part', 'doc_id')} < 0.75 AS is_train FROM ({SHINGLES.format(key='doc_id', k=8, table='documents')})),
    b AS (SELECT DISTINCT s FROM d WHERE is_train)
    SELECT doc_id, count(*) AS shingles, count(b.s) AS shared, count(b.s) >= 0.8 * count(*) AS near_copy
    FROM d LEFT JOIN b ON d.s = b.s WHERE NOT is_train GROUP BY 1
    """,
)
def near_copies_across_parts(t):
    """Every test document against all train documents of the same split."""
    docs = t.documents.select("doc_id", "text", part_by_share(13, {"train": 0.75, "test": 0.25}, "doc_id").alias("part"))
    c = C.shingle_coverage(docs.where("part = 'test'"), docs.where("part = 'train'"), "doc_id", "text", 8)
    return c.withColumn("near_copy", F.col("shared") >= 0.8 * F.col("shingles"))


@query(
    "j14_raw_id_disclosure",
    r"""
    WITH ids AS (SELECT c_custkey::VARCHAR AS v FROM customer),
    tok AS (SELECT page_id, unnest(string_split_regex(lower(url), '[^a-z0-9]+')) AS v FROM pages)
    SELECT page_id, count(DISTINCT v) AS raw_ids FROM tok WHERE v IN (SELECT v FROM ids) GROUP BY 1
    """,
)
def raw_id_disclosure(t):
    ids = t.customer.select(F.col("c_custkey").cast("string").alias("v"))
    tokens = t.pages.select("page_id", F.explode(F.split(F.lower("url"), "[^a-z0-9]+")).alias("v"))
    return (
        tokens.distinct().join(ids, "v", "left_semi").groupBy("page_id")
        .agg(F.count(F.lit(1)).alias("raw_ids"))
    )


PLANTED_SQL = f"""
    named AS (SELECT page_id, url, coalesce(html, '') AS html, c_name, {u_sql(14, 'place', 'page_id')} AS u FROM pages LEFT JOIN customer ON c_custkey = page_id),
    planted AS (SELECT page_id, CASE WHEN u >= 0.3 AND u < 0.4 AND c_name IS NOT NULL THEN url || '/' || c_name || 'x' ELSE url END AS url,
      CASE WHEN u < 0.3 AND c_name IS NOT NULL THEN substr(html, 1, length(html) // 2) || 'ref' || c_name || 'z9' || substr(html, length(html) // 2 + 1) ELSE html END AS html FROM named)
"""


@query(
    "j14_raw_values_in_bodies",
    f"""
    WITH {PLANTED_SQL}, fields AS (SELECT page_id, 'url' AS field, url AS body FROM planted UNION ALL SELECT page_id, 'html', html FROM planted),
    ids AS (SELECT c_name AS v FROM customer UNION SELECT s_name FROM supplier)
    SELECT page_id, field, count(*) AS raw_values, sum((length(body) - length(replace(body, v, ''))) // length(v))::BIGINT AS places
    FROM fields, ids WHERE contains(body, v) GROUP BY 1, 2
    """,
)
def raw_values_in_bodies(t):
    """Names of customers and suppliers anywhere in url and html, also inside longer tokens; some are planted."""
    names = t.customer.select("c_custkey", "c_name")
    named = t.pages.join(names, F.col("c_custkey") == F.col("page_id"), "left").withColumn("u", uniform(14, "place", "page_id"))
    half = F.expr("length(html) div 2")
    within = F.concat(F.substring("html", F.lit(1), half), F.lit("ref"), "c_name", F.lit("z9"), F.substring("html", half + 1, F.length("html")))
    some = F.col("c_name").isNotNull()
    planted = named.withColumn("html", F.coalesce("html", F.lit(""))).select(
        "page_id", F.when((F.col("u") >= 0.3) & (F.col("u") < 0.4) & some, F.concat("url", F.lit("/"), "c_name", F.lit("x"))).otherwise(F.col("url")).alias("url"),
        F.when((F.col("u") < 0.3) & some, within).otherwise(F.col("html")).alias("html"),
    )
    fields = planted.unpivot(["page_id"], ["url", "html"], "field", "body")
    ids = names.select(F.col("c_name").alias("v")).union(t.supplier.select("s_name"))
    found = disclosure.raw_values(fields, ["page_id", "field"], "body", ids, "v")
    return found.groupBy("page_id", "field").agg(F.count_distinct("value").alias("raw_values"), F.count(F.lit(1)).alias("places"))


@query(
    "j15_later_source_wins",
    """
    WITH s AS (SELECT user_id AS task, event_type AS variant, event_id % 3 AS source, max(value) AS score FROM events GROUP BY 1, 2, 3)
    SELECT task, variant, arg_max(source, source) AS source, arg_max(score, source) AS score FROM s GROUP BY 1, 2
    """,
)
def later_source_wins(t):
    hosts = t.events.groupBy(
        F.col("user_id").alias("task"), F.col("event_type").alias("variant"),
        (F.col("event_id") % 3).alias("source"),
    ).agg(F.max("value").alias("score"))
    return C.latest_source(hosts, ["task", "variant"], "source")


@query(
    "j16_table_diff",
    f"""
    WITH p AS (SELECT o_orderkey, o_custkey, CASE WHEN {u_sql(16, 'status', 'o_orderkey')} < 0.05 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
      o_totalprice + CASE WHEN {u_sql(16, 'price', 'o_orderkey')} < 0.1 THEN 0.5 ELSE 0 END AS o_totalprice
      FROM orders WHERE {u_sql(16, 'gone', 'o_orderkey')} >= 0.01),
    j AS (SELECT o.o_orderkey AS a, p.o_orderkey AS b, o.o_custkey <> p.o_custkey AS c1, o.o_orderstatus <> p.o_orderstatus AS c2,
      abs(o.o_totalprice - p.o_totalprice) > 1e-12 AS c3 FROM orders o FULL JOIN p ON o.o_orderkey = p.o_orderkey)
    SELECT '<rows>' AS column_name, count(*) FILTER (a IS NULL OR b IS NULL) AS mismatches FROM j
    UNION ALL SELECT 'o_custkey', count(*) FILTER (c1) FROM j
    UNION ALL SELECT 'o_orderstatus', count(*) FILTER (c2) FROM j
    UNION ALL SELECT 'o_totalprice', count(*) FILTER (c3) FROM j
    """,
)
def table_diff(t):
    base = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    changed = base.where(uniform(16, "gone", "o_orderkey") >= 0.01).select(
        "o_orderkey", "o_custkey",
        F.when(uniform(16, "status", "o_orderkey") < 0.05, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        (F.col("o_totalprice") + F.when(uniform(16, "price", "o_orderkey") < 0.1, 0.5).otherwise(0.0)).alias("o_totalprice"),
    )
    return C.table_diff(base, changed, ["o_orderkey"])


NEAR = 5


@query(
    "j17_nearest_neighbour_probe",
    f"""
    WITH v AS (SELECT vec_id, label::BIGINT AS label, {u_sql(17, 'part', 'vec_id')} < 0.75 AS is_train, embedding::DOUBLE[] AS e FROM embeddings),
    p AS (SELECT a.vec_id, a.label, b.vec_id AS near_id, b.label AS near_label, round(list_cosine_similarity(a.e, b.e), 12) AS c FROM v a, v b WHERE NOT a.is_train AND b.is_train),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, near_id) AS rank FROM p)
    SELECT vec_id, near_id, rank, round(c, 9) AS cosine, near_label = label AS agrees FROM r WHERE rank <= {NEAR}
    """,
)
def nearest_neighbour_probe(t):
    """The five training vectors nearest to each test vector, and whether their labels agree."""
    parts = t.embeddings.select("vec_id", "embedding", part_by_share(17, {"train": 0.75, "test": 0.25}, "vec_id").alias("part"))
    index = neighbours.Index(neighbours.unit_vectors(parts.where("part = 'train'"), "vec_id", "embedding"))
    found = index.nearest(neighbours.unit_vectors(parts.where("part = 'test'"), "vec_id", "embedding"), NEAR)
    label = t.embeddings.select("vec_id", F.col("label").cast("long").alias("label"))
    own = found.join(label, F.col("id") == F.col("vec_id")).select("vec_id", F.col("near").alias("near_id"), F.col("rank").cast("long").alias("rank"), "cosine", F.col("label").alias("own"))
    near = label.select(F.col("vec_id").alias("near_id"), F.col("label").alias("near_label"))
    return own.join(near, "near_id").select("vec_id", "near_id", "rank", F.round("cosine", 9).alias("cosine"), (F.col("near_label") == F.col("own")).alias("agrees"))


@query(
    "j18_child_facts_before_cutoff",
    """
    SELECT o_orderkey, count(l_orderkey) AS facts, coalesce(sum(l_quantity), 0)::BIGINT AS quantity
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate < o_orderdate + INTERVAL 30 DAY GROUP BY 1
    """,
)
def child_facts_before_cutoff(t):
    parents = t.orders.select("o_orderkey", (F.col("o_orderdate") + F.expr("interval 30 days")).alias("cutoff"))
    facts = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate", "l_quantity")
    legal = (
        facts.join(parents, "o_orderkey").where("l_shipdate < cutoff").groupBy("o_orderkey")
        .agg(F.count(F.lit(1)).alias("facts"), F.sum("l_quantity").cast("long").alias("quantity"))
    )
    return parents.select("o_orderkey").join(legal, "o_orderkey", "left").na.fill(0)


SLATE_SQL = f"""
    items AS (SELECT p_partkey, row_number() OVER (ORDER BY {d_sql(19, 'item', 'p_partkey')}, p_partkey) AS pos FROM part),
    q AS (SELECT l_orderkey AS q, min(l_partkey) AS pos_item FROM lineitem GROUP BY 1),
    drawn AS (SELECT q, floor({u_sql(19, 'decoy', 'q', 'j')} * (SELECT count(*) FROM part))::BIGINT + 1 AS pos
      FROM q, range(1, 6) r(j)),
    slate AS (SELECT q, item, max(y) AS is_positive FROM (
      SELECT q, p_partkey AS item, 0 AS y FROM drawn JOIN items USING (pos)
      UNION ALL SELECT q, pos_item, 1 FROM q) GROUP BY 1, 2),
    slots AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY {d_sql(19, 'slot', 'q', 'item')}, item) AS slot FROM slate)
"""


def slates(t):
    q = t.lineitem.groupBy(F.col("l_orderkey").alias("q")).agg(F.min("l_partkey").alias("pos_item"))
    items = t.part.select(F.col("p_partkey").alias("item"))
    return C.candidate_slate(q, items, "q", "item", "pos_item", 5, 19)


@query(
    "j19_candidate_slate",
    f"""
    WITH {SLATE_SQL}
    SELECT slot, count(*) AS n, sum(is_positive)::BIGINT AS positives, sum(item)::BIGINT AS item_sum FROM slots GROUP BY 1
    """,
)
def candidate_slate(t):
    return slates(t).groupBy(F.col("slot").cast("long").alias("slot")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("is_positive").cast("long").alias("positives"),
        F.sum("item").alias("item_sum"),
    )

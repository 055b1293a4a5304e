"""Profiles, name flags, identifiers, projections and missing-value rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.draws import count_where, draw_digest, rows, uniform
from quern.functions.keyed import keyed_digest_in_plan
from quern.functions.names import NAME_FLAGS, name_flags, name_tokens
from quern.operators import compose as C, ids as I, profile as P
from quern.operators.perturb import opaque_names
from quern.operators.ranks import hashed_rank
from quern.plans.joins import MONEY
from quern.plans.registry import d_sql, query, u_sql

L = F.lit
PUBLIC_TEST_KEY = b"public-test-key-0123456789abcdefgh"  # never a real key
NAMESPACE = "bench-v1"


def dirty_customer(t):
    """customer with null, blank and token segments injected by hash."""
    u = uniform(61, "dirty", "c_custkey")
    segment = (
        F.when(u < 0.05, L(None)).when(u < 0.08, "").when(u < 0.1, " \t").when(u < 0.12, " ").when(u < 0.2, "NA")
        .otherwise(F.col("c_mktsegment"))
    )
    return t.customer.withColumn("c_mktsegment", segment)


DIRTY = f"""
    dirty AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN u < 0.05 THEN NULL WHEN u < 0.08 THEN '' WHEN u < 0.1 THEN ' ' || chr(9) WHEN u < 0.12 THEN chr(160) WHEN u < 0.2 THEN 'NA' ELSE c_mktsegment END AS c_mktsegment
      FROM (SELECT *, {u_sql(61, 'dirty', 'c_custkey')} AS u FROM customer))
"""
BLANK_SQL = "regexp_full_match({c}, '[\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{2028}}\\x{{2029}}\\x{{3000}}]*')"


def _column_sql(c, text, flags):
    blank = f"coalesce({BLANK_SQL.format(c=c)}, false)" if text else "false"
    token = f"coalesce({c}::VARCHAR = 'NA', false)"
    return f"""SELECT '{c}' AS column_name, count(*) AS row_count, count(*) FILTER ({c} IS NOT NULL AND NOT {token}) AS nonmissing,
      count(*) FILTER ({c} IS NULL) AS physical_nulls, count(*) FILTER ({blank}) AS blank_strings, count(*) FILTER ({token}) AS null_tokens,
      count(DISTINCT CASE WHEN NOT {token} THEN {c} END) AS distinct_values, '{flags}' AS name_flags FROM dirty"""


CATALOGUE_SQL = f"""
    {DIRTY}, raw AS ({_column_sql('c_custkey', False, '')} UNION ALL {_column_sql('c_name', True, 'sensitive_name_review')}
      UNION ALL {_column_sql('c_nationkey', False, '')} UNION ALL {_column_sql('c_acctbal', False, '')} UNION ALL {_column_sql('c_mktsegment', True, '')}),
    cat AS (SELECT *, row_count - nonmissing AS missing, (row_count - nonmissing) / row_count AS missing_fraction, distinct_values / nonmissing AS unique_ratio,
      concat_ws(',', CASE WHEN distinct_values <= 1 THEN 'constant_in_sample' END, CASE WHEN (row_count - nonmissing) / row_count >= 0.95 THEN 'at_least_95_percent_missing_in_sample' END,
        CASE WHEN nonmissing >= 100 AND distinct_values / nonmissing >= 0.98 THEN 'near_unique_in_sample' END, nullif(name_flags, '')) AS flags FROM raw)
"""


@query(
    "a01_column_counts",
    f"WITH {CATALOGUE_SQL} SELECT column_name, row_count, nonmissing, missing, round(missing_fraction, 9) AS missing_fraction, physical_nulls, blank_strings, null_tokens FROM cat",
)
def column_counts(t):
    return P.catalogue(dirty_customer(t), ["NA"]).select(
        "column_name", "row_count", "nonmissing", "missing", F.round("missing_fraction", 9).alias("missing_fraction"),
        "physical_nulls", "blank_strings", "null_tokens",
    )


@query(
    "a02_distinct_and_ratio",
    f"WITH {CATALOGUE_SQL} SELECT column_name, distinct_values, round(unique_ratio, 9) AS unique_ratio FROM cat",
)
def distinct_and_ratio(t):
    return P.catalogue(dirty_customer(t), ["NA"]).select("column_name", "distinct_values", F.round("unique_ratio", 9).alias("unique_ratio"))


@query("a03_structural_flags", f"WITH {CATALOGUE_SQL} SELECT column_name, flags FROM cat")
def structural_flags(t):
    return P.catalogue(dirty_customer(t), ["NA"]).select("column_name", F.array_join("flags", ",").alias("flags"))


@query(
    "a04_flag_histogram",
    f"WITH {CATALOGUE_SQL} SELECT flag, count(*) AS n FROM (SELECT unnest(string_split(flags, ',')) AS flag FROM cat WHERE flags <> '') GROUP BY 1",
)
def flag_histogram(t):
    return P.flag_counts(P.catalogue(dirty_customer(t), ["NA"]))


@query(
    "a05_paired_prefixes",
    """
    WITH n AS (SELECT DISTINCT CASE lang WHEN 'en' THEN 'pre' WHEN 'fr' THEN 'post' WHEN 'de' THEN 'before' ELSE 'after' END AS prefix, source AS suffix FROM documents),
    p AS (SELECT CASE WHEN prefix IN ('pre', 'post') THEN 'pre/post' ELSE 'before/after' END AS pair, suffix, count(DISTINCT prefix) AS sides FROM n GROUP BY 1, 2)
    SELECT pair, count(*) AS paired_suffix_count FROM p WHERE sides = 2 GROUP BY 1
    """,
)
def paired_prefixes(t):
    prefix = F.when(F.col("lang") == "en", "pre").when(F.col("lang") == "fr", "post").when(F.col("lang") == "de", "before").otherwise("after")
    return P.paired_prefixes(t.documents.select(F.concat_ws(".", prefix, "source").alias("column_name")))


NAME_PARTS = ["ID", "_ids", "Dates", "_clicked", "Categories", "HTTPUrl", "Addresses", "-posting", "userID", "Status"]
NAMES_SQL = f"""
    names AS (SELECT DISTINCT replace(p_name, ' ', '_') || ([{', '.join(f"'{p}'" for p in NAME_PARTS)}])[1 + p_partkey % 10] AS name FROM part),
    w AS (SELECT name, unnest(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM names),
    v AS (SELECT name, w AS tok FROM w
      UNION SELECT name, w[:-4] || 'y' FROM w WHERE len(w) > 3 AND w LIKE '%ies' UNION SELECT name, w[:-3] FROM w WHERE len(w) > 3 AND w LIKE '%es'
      UNION SELECT name, w[:-2] FROM w WHERE len(w) > 2 AND w LIKE '%s' AND w NOT LIKE '%ss' UNION SELECT name, w[:-3] FROM w WHERE len(w) > 4 AND w LIKE '%ed'
      UNION SELECT name, w[:-4] FROM w WHERE len(w) > 5 AND w LIKE '%ing' UNION SELECT name, unnest(['id', w[:-4]]) FROM w WHERE len(w) > 3 AND w LIKE '%ids'
      UNION SELECT name, unnest(['id', w[:-3]]) FROM w WHERE len(w) > 2 AND w LIKE '%id' AND NOT (len(w) > 3 AND w LIKE '%ids'))
"""


def names_frame(t):
    suffix = F.element_at(F.array(*map(L, NAME_PARTS)), (F.col("p_partkey") % 10 + 1).cast("int"))
    return t.part.select(F.concat(F.replace("p_name", L(" "), L("_")), suffix).alias("name")).distinct()


@query("f01_name_tokens", f"WITH {NAMES_SQL} SELECT name, string_agg(tok, ' ' ORDER BY tok) AS tokens FROM v GROUP BY 1")
def f01(t):
    return names_frame(t).select("name", F.array_join(F.array_sort(name_tokens(F.col("name"))), " ").alias("tokens"))


def _flag_case(flag, tokens):
    return f"CASE WHEN count(*) FILTER (tok IN ({', '.join(repr(x) for x in tokens)})) > 0 THEN '{flag}' END"


@query(
    "f02_name_flags",
    f"WITH {NAMES_SQL} SELECT name, concat_ws(',', {', '.join(_flag_case(f, k) for f, k in NAME_FLAGS)}) AS flags FROM v GROUP BY 1",
)
def f02(t):
    return names_frame(t).select("name", F.array_join(name_flags(F.col("name")), ",").alias("flags"))


def _blob(raw: bytes) -> str:
    return "'" + "".join(f"\\x{b:02X}" for b in raw) + "'::BLOB"


def hmac_sql(column: str, value: str) -> str:
    key = PUBLIC_TEST_KEY.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    head = f"{NAMESPACE}\0{column}\0".encode()
    return f"sha256({_blob(outer)} || unhex(sha256({_blob(inner + head)} || encode({value}))))"


def test_digest(column, value):
    return keyed_digest_in_plan(PUBLIC_TEST_KEY, NAMESPACE, column, value)


@query("f03_keyed_digest", f"SELECT c_custkey, {hmac_sql('c_name', 'c_name')} AS digest FROM customer")
def f03(t):
    return t.customer.select("c_custkey", test_digest("c_name", F.col("c_name")).alias("digest"))


UNIVERSE_SQL = "universe AS (SELECT DISTINCT c_custkey::VARCHAR AS value FROM customer UNION SELECT DISTINCT o_custkey::VARCHAR FROM orders)"
CODES_SQL = f"""
    {UNIVERSE_SQL}, ranked AS (SELECT value, row_number() OVER (ORDER BY {hmac_sql('custkey', 'value')}, value) AS rk, greatest(4, len((count(*) OVER ())::VARCHAR)) AS width FROM universe),
    codes AS (SELECT value, 'c' || lpad(rk::VARCHAR, width::INT, '0') AS code, rk FROM ranked)
"""


def custkey_universe(t):
    tables = [t.customer.select(F.col("c_custkey").alias("custkey")), t.orders.select(F.col("o_custkey").alias("custkey"))]
    return I.id_universe(tables, "custkey")


def custkey_codes(t):
    return I.code_mapping(custkey_universe(t), "c", lambda v: test_digest("custkey", v))


@query("a08_id_universe", f"WITH {UNIVERSE_SQL} SELECT value, trim(value) = '' AS blank FROM universe")
def a08(t):
    return custkey_universe(t)


@query("w01_compact_ids", f"WITH {CODES_SQL} SELECT value, code FROM codes")
def w01(t):
    return custkey_codes(t)


@query(
    "f05_blank_id_policy",
    f"""
    WITH {DIRTY}, b AS (SELECT *, coalesce({BLANK_SQL.format(c='c_mktsegment')}, false) AS blank FROM dirty)
    SELECT count(c_mktsegment) AS preserved, count(CASE WHEN NOT blank THEN c_mktsegment END) AS nulled, count(*) FILTER (blank) AS would_fail FROM b
    """,
)
def f05(t):
    dirty = dirty_customer(t).withColumn("raw", F.col("c_mktsegment"))
    nulled = I.blank_policy(dirty, "c_mktsegment", "null")
    return nulled.agg(
        F.count("raw").alias("preserved"), F.count("c_mktsegment").alias("nulled"),
        count_where(F.col("raw").isNotNull() & F.col("c_mktsegment").isNull()).alias("would_fail"),
    )


@query(
    "b11_code_order_leakage",
    f"WITH {CODES_SQL} SELECT abs(corr(rk, value::BIGINT)) < 0.2 AS order_hidden, round(corr(rk, value::BIGINT), 6) AS rank_correlation FROM codes",
)
def b11(t):
    pairs = custkey_codes(t).select(F.expr("cast(substr(code, 2) as double)").alias("rk"), F.col("value").cast("double").alias("v"))
    corr = F.corr("rk", "v")
    return pairs.agg((F.abs(corr) < 0.2).alias("order_hidden"), F.round(corr, 6).alias("rank_correlation"))


@query("s03_row_count", "SELECT count(*) AS n FROM lineitem")
def s03(t):
    return t.lineitem.agg(rows().alias("n"))


@query(
    "s12_profile_report",
    """
    SELECT 'o_orderkey' AS column_name, count(o_orderkey) AS nonmissing, count(DISTINCT o_orderkey) AS distinct_values FROM orders
    UNION ALL SELECT 'o_custkey', count(o_custkey), count(DISTINCT o_custkey) FROM orders
    UNION ALL SELECT 'o_orderstatus', count(o_orderstatus), count(DISTINCT o_orderstatus) FROM orders
    UNION ALL SELECT 'o_totalprice', count(o_totalprice), count(DISTINCT o_totalprice) FROM orders
    UNION ALL SELECT 'o_orderdate', count(o_orderdate), count(DISTINCT o_orderdate) FROM orders
    UNION ALL SELECT 'o_orderpriority', count(o_orderpriority), count(DISTINCT o_orderpriority) FROM orders
    """,
)
def s12(t):
    """The JSON report read back, so its shape is checked as well."""
    report = P.report_json(P.catalogue(t.orders), "orders")
    schema = "columns array<struct<column_name string, nonmissing bigint, distinct_values bigint>>"
    return report.select(F.explode(F.from_json("report", schema)["columns"]).alias("c")).select("c.*")


@query(
    "s11_manifest_counts",
    "SELECT 'custkey' AS \"column\", 'c' AS prefix, (SELECT count(*) FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders)) AS unique_nonblank_values",
)
def s11(t):
    tables = [t.customer.select(F.col("c_custkey").alias("custkey")), t.orders.select(F.col("o_custkey").alias("custkey"))]
    return I.id_counts(tables, [I.IdColumn("custkey", "c")])


@query(
    "w02_head_middle_tail",
    """
    WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)
    SELECT o_orderkey, pos AS position FROM p WHERE pos < 333 OR (pos >= n // 2 - 166 AND pos < n // 2 - 166 + 333) OR pos >= n - 333
    """,
)
def w02(t):
    return P.positional_sample(t.orders, 1000).select("o_orderkey", F.col("position").cast("long").alias("position"))


@query("p01_column_subset", "SELECT o_orderkey, o_orderstatus FROM orders")
def p01(t):
    return C.pick(t.orders, ["o_orderkey", "o_orderstatus"])


@query("p02_drop_present", "SELECT p_partkey, p_name, p_type FROM part")
def p02(t):
    return t.part.drop("p_brand", "p_size", "p_retailprice", "not_there")


@query(
    "p03_optional_column",
    "SELECT o_custkey, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1",
)
def p03(t):
    source = t.orders.select("o_custkey", "o_totalprice")
    base = t.customer.select(F.col("c_custkey").alias("o_custkey"))
    merged = C.merge_sources(base, source, "o_custkey", ["o_totalprice"], ["o_estimate"])
    return merged.groupBy("o_custkey").agg(rows().alias("n"), F.sum(F.col("o_totalprice").cast(MONEY)).cast("double").alias("total"))


@query(
    "p04_vertical_halves",
    """
    SELECT 'first' AS half, count(*) AS n, sum(l_partkey)::BIGINT AS parts, sum(l_quantity)::BIGINT AS quantity FROM lineitem
    UNION ALL SELECT 'second', count(*), sum(l_linenumber)::BIGINT, count(DISTINCT l_shipdate) FROM lineitem
    """,
)
def p04(t):
    first, second = C.halve_features(t.lineitem.columns, "l_orderkey", ["l_tax"], ["l_linenumber", "l_shipdate"])
    if "l_linenumber" in first or "l_linenumber" not in second:
        raise AssertionError("forced column is in the wrong half")
    a = t.lineitem.select("l_orderkey", *first).agg(
        L("first").alias("half"), rows().alias("n"), F.sum("l_partkey").alias("parts"), F.sum("l_quantity").cast("long").alias("quantity"))
    b = t.lineitem.select("l_orderkey", *second).agg(
        L("second").alias("half"), rows().alias("n"), F.sum("l_linenumber").cast("long").alias("parts"), F.count_distinct("l_shipdate").alias("quantity"))
    return a.unionByName(b)


@query("p05_text_cast", "SELECT c_custkey::VARCHAR AS k, c_nationkey::VARCHAR AS nation, try_cast(c_mktsegment AS DOUBLE) IS NULL AS not_number FROM customer")
def p05(t):
    return t.customer.select(
        F.col("c_custkey").cast("string").alias("k"), F.col("c_nationkey").cast("string").alias("nation"),
        F.col("c_mktsegment").try_cast("double").isNull().alias("not_number"),
    )


@query(
    "p06_missing_masks",
    f"""
    WITH {DIRTY}, m AS (SELECT CASE WHEN c_mktsegment IS NULL THEN 'null' WHEN {BLANK_SQL.format(c='c_mktsegment')} THEN 'blank' WHEN c_mktsegment IN ('NA', '') THEN 'token' ELSE 'value' END AS state FROM dirty)
    SELECT state, count(*) AS n FROM m GROUP BY 1
    """,
)
def p06(t):
    dirty = dirty_customer(t)
    null, blank, token = P.missing_masks(dirty, "c_mktsegment", ["NA", ""])
    state = F.when(null, "null").when(blank, "blank").when(token, "token").otherwise("value")
    return dirty.groupBy(state.alias("state")).agg(rows().alias("n"))


@query(
    "p07_finite_numbers",
    f"""
    WITH e AS (SELECT event_type, CASE WHEN u < 0.02 THEN 'NaN'::DOUBLE WHEN u < 0.04 THEN 'inf'::DOUBLE WHEN u < 0.06 THEN '-inf'::DOUBLE WHEN u < 0.08 THEN NULL ELSE value END AS v FROM (SELECT *, {u_sql(62, 'odd', 'event_id')} AS u FROM events))
    SELECT event_type, count(*) AS n, count(*) FILTER (isfinite(v)) AS finite, max(v) FILTER (isfinite(v)) AS top FROM e GROUP BY 1
    """,
)
def p07(t):
    u, inf = uniform(62, "odd", "event_id"), float("inf")
    v = F.when(u < 0.02, L(float("nan"))).when(u < 0.04, L(inf)).when(u < 0.06, L(-inf)).when(u < 0.08, L(None)).otherwise(F.col("value"))
    finite = F.coalesce(~F.isnan("v") & (F.abs("v") < L(inf)), L(False))
    return t.events.select("event_type", v.alias("v")).groupBy("event_type").agg(
        rows().alias("n"), count_where(finite).alias("finite"), F.max(F.when(finite, F.col("v"))).alias("top")
    )


WHITELIST = {"c_custkey": "key", "c_nationkey": "site", "c_acctbal": "balance"}


@query("p08_public_whitelist", "SELECT c_custkey AS \"key\", c_nationkey::BIGINT AS site, c_acctbal AS balance FROM customer")
def p08(t):
    """Only listed fields leave; everything else is absent by construction."""
    listed = C.pick(t.customer, list(WHITELIST)).withColumnsRenamed(WHITELIST)
    return listed.withColumn("site", F.col("site").cast("long"))


@query(
    "p09_canonical_pool",
    f"SELECT o_orderkey, o_custkey, {u_sql(63, 'label', 'o_orderkey')} < 0.9 AS label_available FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate >= TIMESTAMP '1996-01-01'",
)
def p09(t):
    legal = (F.col("o_orderstatus") != "P") & (F.col("o_orderdate") >= L("1996-01-01").cast("timestamp_ntz"))
    return t.orders.where(legal).select("o_orderkey", "o_custkey", (uniform(63, "label", "o_orderkey") < 0.9).alias("label_available"))


PART_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
OPAQUE = opaque_names(PART_COLUMNS, ["p_partkey"], seed=64)


@query("p10_opaque_rename", f"SELECT p_partkey, {', '.join(f'{c} AS {o}' for c, o in OPAQUE.items())} FROM part")
def p10(t):
    return C.pick(t.part, PART_COLUMNS).withColumnsRenamed(OPAQUE)


@query(
    "p11_overlay",
    f"""
    SELECT o_orderkey, CASE WHEN {u_sql(65, 'hide', 'o_orderkey')} < 0.1 THEN 'hidden' ELSE o_orderstatus END AS o_orderstatus FROM orders
    """,
)
def p11(t):
    base = t.orders.select("o_orderkey", "o_orderstatus")
    hidden = base.where(uniform(65, "hide", "o_orderkey") < 0.1).withColumn("o_orderstatus", L("hidden"))
    return C.overlay(base, hidden, ["o_orderkey"])


@query(
    "p12_seeded_shuffle",
    f"SELECT o_orderkey, row_number() OVER (ORDER BY {d_sql(66, 'shuffle', 'o_orderkey')}, o_orderkey) AS position FROM orders",
)
def p12(t):
    return hashed_rank(t.orders.select("o_orderkey", draw_digest(66, "shuffle", "o_orderkey").alias("d")), "d", ("o_orderkey",), "position").drop("d")


@query(
    "p13_three_valued_rules",
    f"""
    WITH c AS (SELECT role, CASE WHEN u < 0.1 THEN NULL WHEN u < 0.2 THEN '' ELSE text END AS text FROM (SELECT *, {u_sql(67, 'gap', 'conv_id', 'turn')} AS u FROM conversations))
    SELECT role, count(*) FILTER (text IS NULL) AS absent, count(*) FILTER (text IS NOT NULL AND trim(text) = '') AS blank,
      count(*) FILTER (text IS NOT DISTINCT FROM NULL OR trim(text) = '') AS unusable FROM c GROUP BY 1
    """,
)
def p13(t):
    u = uniform(67, "gap", "conv_id", "turn")
    c = t.conversations.select("role", F.when(u < 0.1, L(None)).when(u < 0.2, "").otherwise(F.col("text")).alias("text"))
    blank = F.coalesce(F.col("text").rlike(P.BLANK), L(False))
    return c.groupBy("role").agg(
        count_where(F.col("text").isNull()).alias("absent"), count_where(blank).alias("blank"),
        count_where(F.col("text").eqNullSafe(L(None)) | blank).alias("unusable"),
    )

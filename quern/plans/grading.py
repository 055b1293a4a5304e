"""Metrics, submission rules, tiers and resampled uncertainty."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.draws import count_where, rows, uniform
from quern.operators import constraints as K, metrics as M, submission as S
from quern.operators.compose import merge_sources
from quern.operators.ordered import micros
from quern.operators.ranks import exact_median, running_totals
from quern.operators.splits import exact_split
from quern.plans.joins import SLATE_SQL, slates
from quern.plans.panel_frame import PANEL_SQL, panel_of
from quern.plans.registry import query, u_sql
from quern.plans.splits import EXACT_SQL
from quern.session import materialise

L = F.lit


@query(
    "g01_rmse_median_baseline",
    f"""
    WITH {EXACT_SQL}, j AS (SELECT s.* FROM sized s JOIN customer ON o_custkey = c_custkey),
    m AS (SELECT median(o_totalprice) AS med FROM j WHERE NOT is_test)
    SELECT count(*) AS test_rows, round(any_value(med), 6) AS prediction, round(sqrt(avg((o_totalprice - med) ** 2)), 4) AS rmse FROM j, m WHERE is_test
    """,
)
def rmse_median_baseline(t):
    source = t.customer.withColumnRenamed("c_custkey", "o_custkey")
    merged = merge_sources(t.orders, source, "o_custkey", ["c_mktsegment"])
    # The join runs once; the split and the median read its written result.
    split = materialise(exact_split(materialise(merged.select("o_orderkey", "o_totalprice")), "o_orderkey", 0, 0.25))
    median = exact_median(split.where("not is_test"), "o_totalprice").scalar()
    scored = split.where("is_test").select(F.col("o_totalprice").alias("y"), median.alias("p"))
    return scored.agg(
        rows().alias("test_rows"), F.round(F.max("p"), 6).alias("prediction"),
        F.round(M.regression_metrics()["rmse"], 4).alias("rmse"),
    )


def predictions(t):
    """Orders with a deterministic noisy prediction."""
    return t.orders.select(
        "o_orderkey", "o_custkey", "o_orderpriority", F.col("o_totalprice").alias("y"),
        (F.col("o_totalprice") * (0.8 + 0.4 * uniform(31, "pred", "o_orderkey"))).alias("p"),
    )


PRED = f"pr AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice AS y, o_totalprice * (0.8 + 0.4 * {u_sql(31, 'pred', 'o_orderkey')}) AS p FROM orders)"


@query(
    "g01_checked_grade",
    f"""
    WITH {PRED}
    SELECT count(*) AS matched, 0::BIGINT AS extra, 0::BIGINT AS duplicated, 0::BIGINT AS bad_values, 'accepted' AS verdict, round(sqrt(avg((y - p) ** 2)), 4) AS score FROM pr
    """,
)
def checked_grade(t):
    p = predictions(t)
    graded = S.grade_many(
        p.select(L("only").alias("set"), "o_orderkey", F.col("p").cast("string").alias("p")),
        p.select("o_orderkey", "y"), ["set"], "o_orderkey",
    )
    return graded.drop("set").withColumn("score", F.round("score", 4))


@query(
    "g02_mae_mse_scaled",
    f"""
    WITH {PRED}, b AS (SELECT median(y) AS med FROM pr)
    SELECT o_orderpriority, round(avg(abs(y - p)), 4) AS mae, round(avg((y - p) ** 2), -2) AS mse, round(avg(abs(y - p)) / avg(abs(y - med)), 8) AS scaled_mae
    FROM pr, b GROUP BY 1
    """,
)
def mae_mse_scaled(t):
    p, m = predictions(t), M.regression_metrics()
    med = exact_median(t.orders, "o_totalprice").scalar()
    return p.withColumn("med", med).groupBy("o_orderpriority").agg(
        F.round(m["mae"], 4).alias("mae"), F.round(m["mse"], -2).alias("mse"),
        F.round(m["mae"] / F.avg(F.abs(M.truth() - F.col("med"))), 8).alias("scaled_mae"),
    )


@query(
    "g03_smape",
    f"WITH {PRED} SELECT o_orderpriority, round(avg(CASE WHEN abs(y) + abs(p) = 0 THEN 0 ELSE 2 * abs(y - p) / (abs(y) + abs(p)) END), 9) AS smape FROM pr GROUP BY 1",
)
def smape(t):
    return predictions(t).groupBy("o_orderpriority").agg(F.round(M.regression_metrics()["smape"], 9).alias("smape"))


@query(
    "g04_class_scores",
    f"""
    WITH x AS (SELECT l_linestatus AS g, l_returnflag AS y, CASE WHEN {u_sql(34, 'cls', 'l_orderkey', 'l_partkey')} < 0.6 THEN l_returnflag ELSE 'N' END AS p FROM lineitem),
    c AS (SELECT g, label, sum(s) AS support, sum(r) AS predicted, sum(h) AS hits FROM (
      SELECT g, y AS label, 1 AS s, 0 AS r, (y = p)::INT AS h FROM x UNION ALL SELECT g, p, 0, 1, 0 FROM x) GROUP BY 1, 2)
    SELECT g, round(sum(hits) / sum(support), 9) AS accuracy, round(avg(hits / support), 9) AS macro_recall, round(avg(2 * hits / (support + predicted)), 9) AS macro_f1 FROM c WHERE support > 0 GROUP BY 1
    """,
)
def class_scores(t):
    kept = uniform(34, "cls", "l_orderkey", "l_partkey") < 0.6
    x = t.lineitem.select(
        F.col("l_linestatus").alias("g"), F.col("l_returnflag").alias("y"),
        F.when(kept, F.col("l_returnflag")).otherwise("N").alias("p"),
    )
    return M.class_scores(x, ["g"]).select("g", *[F.round(c, 9).alias(c) for c in ("accuracy", "macro_recall", "macro_f1")])


@query(
    "g05_auc",
    """
    WITH x AS (SELECT lang, quality AS y, n_chars AS p FROM labels JOIN documents USING (doc_id)),
    r AS (SELECT lang, y, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2.0 AS rk FROM x)
    SELECT lang, round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0), 9) AS auc FROM r GROUP BY 1
    """,
)
def auc(t):
    x = t.labels.join(t.documents.select("doc_id", "lang", F.col("n_chars").alias("p")), "doc_id")
    return M.auc(x.select("lang", F.col("quality").alias("y"), "p"), ["lang"]).select("lang", F.round("auc", 9).alias("auc"))


@query(
    "g06_log_loss",
    f"""
    WITH x AS (SELECT toxic AS g, quality AS y, 0.02 + 0.96 * {u_sql(36, 'prob', 'doc_id')} AS p FROM labels)
    SELECT g::BIGINT AS g, count(*) AS n, round(-avg(CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END), 9) AS log_loss FROM x GROUP BY 1
    """,
)
def log_loss(t):
    x = t.labels.select(F.col("toxic").cast("long").alias("g"), F.col("quality").alias("y"), (0.02 + 0.96 * uniform(36, "prob", "doc_id")).alias("p"))
    return x.groupBy("g").agg(rows().alias("n"), F.round(M.log_loss(), 9).alias("log_loss"))


@query(
    "g07_pinball",
    f"""
    WITH {PRED}, q AS (SELECT *, p * 0.9 AS lo, p AS mid, p * 1.1 AS hi FROM pr)
    SELECT o_orderpriority, round(avg(greatest(0.1 * (y - lo), -0.9 * (y - lo))), 4) AS q10, round(avg(greatest(0.5 * (y - mid), -0.5 * (y - mid))), 4) AS q50,
      round(avg(greatest(0.9 * (y - hi), (0.9 - 1.0) * (y - hi))), 4) AS q90, count(*) FILTER (NOT (lo <= mid AND mid <= hi)) AS crossed FROM q GROUP BY 1
    """,
)
def pinball(t):
    q = predictions(t).withColumns({"lo": M.guess() * 0.9, "mid": M.guess(), "hi": M.guess() * 1.1})
    return q.groupBy("o_orderpriority").agg(
        F.round(M.pinball(0.1, F.col("lo")), 4).alias("q10"), F.round(M.pinball(0.5, F.col("mid")), 4).alias("q50"),
        F.round(M.pinball(0.9, F.col("hi")), 4).alias("q90"), count_where("not (lo <= mid and mid <= hi)").alias("crossed"),
    )


@query(
    "g08_poisson_deviance",
    f"""
    WITH x AS (SELECT l_returnflag AS g, CASE WHEN l_discount = 0 THEN 0 ELSE l_quantity END AS y, 1 + 48 * {u_sql(38, 'rate', 'l_orderkey', 'l_partkey', 'l_suppkey')} AS p FROM lineitem)
    SELECT g, round(2 * avg(CASE WHEN y = 0 THEN p ELSE y * ln(y / p) - (y - p) END), 7) AS deviance FROM x GROUP BY 1
    """,
)
def poisson_deviance(t):
    x = t.lineitem.select(
        F.col("l_returnflag").alias("g"), F.when(F.col("l_discount") == 0, 0.0).otherwise(F.col("l_quantity")).alias("y"),
        (1 + 48 * uniform(38, "rate", "l_orderkey", "l_partkey", "l_suppkey")).alias("p"),
    )
    return x.groupBy("g").agg(F.round(M.regression_metrics()["poisson_deviance"], 7).alias("deviance"))


@query(
    "g09_ranking_metrics",
    f"""
    WITH {SLATE_SQL},
    q2 AS (SELECT q, sum(CASE WHEN slot <= 3 THEN is_positive * ln(2) / ln(1 + slot) ELSE 0 END) AS dcg, sum(is_positive) AS n_rel,
      min(CASE WHEN is_positive > 0 THEN slot END) AS first_hit, sum(CASE WHEN slot <= 3 THEN is_positive ELSE 0 END) AS hits FROM slots GROUP BY 1)
    SELECT round(avg(dcg), 9) AS ndcg, round(avg(1.0 / first_hit), 9) AS mrr, round(avg(hits / n_rel), 9) AS recall, count(*) AS queries FROM q2 WHERE n_rel > 0
    """,
)
def ranking_metrics(t):
    ranked = slates(t).select("q", F.col("slot").alias("place"), F.col("is_positive").alias("relevance"))
    m = M.ranking_metrics(ranked, "q", 3)
    return m.select(*[F.round(c, 9).alias(c) for c in ("ndcg", "mrr", "recall")], "queries")


@query(
    "g10_concordance",
    f"""
    WITH s AS (SELECT o_custkey AS k, date_diff('day', min(o_orderdate), max(o_orderdate)) AS time FROM orders GROUP BY 1),
    x AS (SELECT time, ({u_sql(40, 'event', 'k')} < 0.7)::INT AS event, floor(c_acctbal)::BIGINT + 1000 AS risk FROM s JOIN customer ON k = c_custkey),
    c AS (SELECT count(*) FILTER (a.risk > b.risk) AS concordant, count(*) FILTER (a.risk < b.risk) AS discordant, count(*) FILTER (a.risk = b.risk) AS tied_risk
      FROM x a JOIN x b ON a.time < b.time WHERE a.event = 1)
    SELECT *, round((concordant + 0.5 * tied_risk) / (concordant + discordant + tied_risk), 9) AS c_index FROM c
    """,
)
def concordance(t):
    spans = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(
        F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).cast("long").alias("time")
    )
    units = spans.join(t.customer.select(F.col("c_custkey").alias("k"), "c_acctbal"), "k").select(
        "time", (uniform(40, "event", "k") < 0.7).cast("int").alias("event"),
        (F.floor("c_acctbal") + 1000).cast("long").alias("risk"),
    )
    return M.concordance(units, 14).withColumn("c_index", F.round("c_index", 9))


@query(
    "g11_skill_and_log_ratio",
    f"""
    WITH {PRED}, b AS (SELECT median(y) AS med FROM pr)
    SELECT o_orderpriority, round(1 - sqrt(avg((y - p) ** 2)) / sqrt(avg((y - med) ** 2)), 8) AS skill, round(avg(abs(ln((1 + p) / (1 + y)))), 9) AS log_ratio FROM pr, b GROUP BY 1
    """,
)
def skill_and_log_ratio(t):
    med = exact_median(t.orders, "o_totalprice").scalar()
    m = M.regression_metrics()
    base = F.sqrt(F.avg((M.truth() - F.col("med")) * (M.truth() - F.col("med"))))
    return predictions(t).withColumn("med", med).groupBy("o_orderpriority").agg(
        F.round(1 - m["rmse"] / base, 8).alias("skill"), F.round(m["log_ratio"], 9).alias("log_ratio")
    )


@query(
    "g12_submission_rules",
    f"""
    WITH {PRED}, v AS (SELECT CASE WHEN u < 0.01 THEN '' WHEN u < 0.02 THEN 'abc' WHEN u < 0.03 THEN 'NaN' WHEN u < 0.04 THEN '-5' ELSE y::VARCHAR END AS p FROM (SELECT *, {u_sql(42, 'bad', 'o_orderkey')} AS u FROM pr))
    SELECT coalesce(CASE WHEN trim(p) = '' THEN 'missing_value' WHEN try_cast(p AS DOUBLE) IS NULL THEN 'not_a_number' WHEN isnan(try_cast(p AS DOUBLE)) THEN 'not_finite' WHEN try_cast(p AS DOUBLE) < 0 THEN 'out_of_domain' END, 'ok') AS rule, count(*) AS n FROM v GROUP BY 1
    """,
)
def submission_rules(t):
    u = uniform(42, "bad", "o_orderkey")
    text = F.when(u < 0.01, "").when(u < 0.02, "abc").when(u < 0.03, "NaN").when(u < 0.04, "-5").otherwise(M.truth().cast("string"))
    cells = predictions(t).select(text.alias("p"))
    return cells.groupBy(F.coalesce(S.value_error(F.col("p"), 0.0), L("ok")).alias("rule")).agg(rows().alias("n"))


@query(
    "g13_simplex_check",
    f"""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE) AS sq, {u_sql(43, 'break', 'vec_id')} AS u FROM embeddings),
    p AS (SELECT vec_id, list_transform(sq, lambda x: CASE WHEN u < 0.1 THEN -x / list_sum(sq) WHEN u < 0.3 THEN x ELSE x / list_sum(sq) END) AS p, u FROM v)
    SELECT CASE WHEN u < 0.1 THEN 'negative,sum_not_one' WHEN abs(list_sum(p) - 1) > 1e-4 THEN 'sum_not_one' ELSE 'ok' END AS rules, count(*) AS n FROM p GROUP BY 1
    """,
)
def simplex_check(t):
    squares = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
    v = t.embeddings.select("vec_id", squares.alias("sq"), uniform(43, "break", "vec_id").alias("u"))
    v = v.withColumn("total", F.aggregate("sq", L(0.0), lambda a, x: a + x))
    p = v.select(F.transform(
        "sq", lambda x: F.when(F.col("u") < 0.1, -x / F.col("total")).when(F.col("u") < 0.3, x).otherwise(x / F.col("total"))
    ).alias("p"))
    broken = F.array_join(S.simplex_errors(F.col("p"), 1e-4), ",")
    return p.groupBy(F.when(broken == "", "ok").otherwise(broken).alias("rules")).agg(rows().alias("n"))


@query(
    "g13_quantile_order",
    f"""
    WITH {PRED}, q AS (SELECT o_orderpriority, p * 0.9 AS lo, p AS mid, CASE WHEN {u_sql(43, 'cross', 'o_orderkey')} < 0.05 THEN p * 0.95 ELSE p * 1.1 END AS hi FROM pr)
    SELECT o_orderpriority, count(*) AS n, count(*) FILTER (NOT (lo <= mid AND mid <= hi)) AS crossed, count(*) FILTER (lo < 0) AS negative FROM q GROUP BY 1
    """,
)
def quantile_order(t):
    hi = F.when(uniform(43, "cross", "o_orderkey") < 0.05, M.guess() * 0.95).otherwise(M.guess() * 1.1)
    q = predictions(t).withColumns({"lo": M.guess() * 0.9, "mid": M.guess(), "hi": hi})
    return q.groupBy("o_orderpriority").agg(
        rows().alias("n"), count_where("not (lo <= mid and mid <= hi)").alias("crossed"), count_where("lo < 0").alias("negative")
    )


@query(
    "g13_monotone",
    f"""
    WITH v AS (SELECT o_custkey, o_orderkey, o_orderdate, CASE WHEN u < 0.02 THEN NULL ELSE day - CASE WHEN u < 0.07 THEN 400 ELSE 0 END END AS claimed
      FROM (SELECT o_custkey, o_orderkey, o_orderdate, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS day, {u_sql(43, 'fall', 'o_orderkey')} AS u FROM orders)),
    s AS (SELECT o_custkey, lag(claimed) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - claimed AS down FROM v WHERE claimed IS NOT NULL),
    f AS (SELECT o_custkey, count(*) FILTER (down > 0) AS n_falls, max(down) FILTER (down > 0) AS worst FROM s GROUP BY 1)
    SELECT o_custkey, count(*) AS n, count(*) FILTER (claimed IS NULL) AS n_missing, coalesce(any_value(n_falls), 0) AS n_falls, any_value(worst) AS worst
    FROM v LEFT JOIN f USING (o_custkey) GROUP BY 1
    """,
)
def monotone(t):
    """A claimed running figure per customer: some claims are missing, some fall."""
    u, day = uniform(43, "fall", "o_orderkey"), F.unix_date(F.to_date("o_orderdate")).cast("long")
    claims = t.orders.select("o_custkey", "o_orderkey", micros("o_orderdate").alias("at"), F.when(u >= 0.02, day - F.when(u < 0.07, 400).otherwise(0)).alias("claimed"))
    return K.falls(claims, ["o_custkey"], ["at", "o_orderkey"], "claimed")


@query(
    "g13_conservation",
    f"""
    WITH parts AS (SELECT l_orderkey AS k, l_extendedprice::DECIMAL(18,2) AS part FROM lineitem WHERE {u_sql(43, 'part', 'l_orderkey')} >= 0.01),
    sums AS (SELECT k, sum(part) AS part_sum FROM parts GROUP BY 1),
    wholes AS (SELECT l_orderkey AS k, CASE WHEN u < 0.02 THEN NULL ELSE s + CASE WHEN u < 0.05 THEN 1 ELSE 0 END END AS whole
      FROM (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,2)) AS s, {u_sql(43, 'whole', 'l_orderkey')} AS u FROM lineitem GROUP BY 1) WHERE u < 0.99)
    SELECT coalesce(w.k, p.k) AS l_orderkey, part_sum::DOUBLE AS part_sum, whole::DOUBLE AS whole, CASE WHEN w.k IS NULL THEN 'no_whole' WHEN p.k IS NULL THEN 'no_parts'
      WHEN whole IS NULL THEN 'missing_value' WHEN abs(part_sum - whole) > 0.005 THEN 'not_conserved' ELSE 'ok' END AS verdict
    FROM wholes w FULL JOIN sums p ON w.k = p.k
    """,
)
def conservation(t):
    """Declared order totals, some off, null or absent, against their lines."""
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    parts = t.lineitem.where(uniform(43, "part", "l_orderkey") >= 0.01).select("l_orderkey", price.alias("part"))
    u = uniform(43, "whole", "l_orderkey")
    wholes = t.lineitem.groupBy("l_orderkey").agg(F.sum(price).alias("s")).where(u < 0.99)
    wholes = wholes.select("l_orderkey", F.when(u >= 0.02, F.col("s") + F.when(u < 0.05, 1).otherwise(0)).alias("whole"))
    done = K.conservation(parts, wholes, "l_orderkey", "part", "whole", 0.005)
    return done.select("l_orderkey", F.col("part_sum").cast("double"), F.col("whole").cast("double"), "verdict")


LEVELS_SQL = f"""
    leaves AS (SELECT 'o' || o_orderkey AS o, 'c' || o_custkey AS c, 'n' || c_nationkey AS n, 'r' || n_regionkey AS r, o_totalprice::DECIMAL(18,2) AS v,
      {u_sql(43, 'lost', 'o_orderkey')} < 0.01 AS lost
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
    nodes AS (SELECT o AS node, CASE WHEN lost THEN 'gone' ELSE c END AS parent, v FROM leaves
      UNION ALL SELECT DISTINCT c, n, 0 FROM leaves UNION ALL SELECT DISTINCT n, r, 0 FROM leaves UNION ALL SELECT DISTINCT r, NULL, 0 FROM leaves),
    claims AS (SELECT o AS node, v AS s FROM leaves UNION ALL SELECT c, sum(v) FROM leaves GROUP BY 1
      UNION ALL SELECT n, sum(v) FROM leaves GROUP BY 1 UNION ALL SELECT r, sum(v) FROM leaves GROUP BY 1)"""


@query(
    "g13_hierarchy",
    f"""
    WITH RECURSIVE {LEVELS_SQL},
    up AS (SELECT node, node AS top, v FROM nodes UNION ALL SELECT up.node, n.parent, up.v FROM up JOIN nodes n ON n.node = up.top WHERE n.parent IS NOT NULL),
    totals AS (SELECT top, sum(v) AS total FROM up GROUP BY 1)
    SELECT n.node, total::DOUBLE AS total, s::DOUBLE AS claimed, CASE WHEN n.parent = 'gone' THEN 'orphan' WHEN abs(total - s) > 0.005 THEN 'incoherent' ELSE 'ok' END AS verdict
    FROM nodes n JOIN totals ON top = n.node JOIN claims k ON k.node = n.node
    """,
)
def hierarchy(t):
    """Totals claimed at four levels; one order in a hundred hangs from a parent that is not there."""
    nations = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    buyers = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey").join(nations, "c_nationkey")
    name = lambda mark, c: F.concat(L(mark), F.col(c).cast("string"))
    leaves = t.orders.select("o_orderkey", "o_custkey", "o_totalprice").join(buyers, "o_custkey")
    leaves = leaves.select(name("o", "o_orderkey").alias("o"), name("c", "o_custkey").alias("c"), name("n", "c_nationkey").alias("n"), name("r", "n_regionkey").alias("r"),
                           F.col("o_totalprice").cast("decimal(18,2)").alias("v"), (uniform(43, "lost", "o_orderkey") < 0.01).alias("lost"))
    zero = L(0).cast("decimal(18,2)")
    nodes = leaves.select(F.col("o").alias("node"), F.when(F.col("lost"), "gone").otherwise(F.col("c")).alias("parent"), "v", F.col("v").cast("decimal(38,2)").alias("claimed"))
    for low, high in (("c", F.col("n")), ("n", F.col("r")), ("r", L(None).cast("string"))):
        level = leaves.groupBy(low).agg(F.any_value(high).alias("parent"), F.sum("v").cast("decimal(38,2)").alias("claimed"))
        nodes = nodes.unionByName(level.select(F.col(low).alias("node"), "parent", zero.alias("v"), "claimed"))
    done = K.hierarchy(materialise(nodes), "node", "parent", "v", "claimed", 0.005)
    return done.select("node", F.col("total").cast("double"), F.col("claimed").cast("double"), "verdict")


@query(
    "g14_sample_structure",
    f"""
    WITH l AS (SELECT CASE WHEN u < 0.02 THEN conv_id || ',' || turn WHEN u < 0.04 THEN conv_id || ',' || turn || ',' || role || ',x' WHEN u < 0.06 THEN ' ,' || turn || ',' || role ELSE conv_id || ',' || turn // 2 || ',' || role END AS line
      FROM (SELECT *, {u_sql(44, 'line', 'conv_id', 'turn')} AS u FROM conversations)),
    c AS (SELECT string_split(line, ',') AS c FROM l),
    k AS (SELECT c[1] AS a, c[2] AS b, len(c) <> 3 AS bad, len(c) = 3 AND (trim(c[1]) = '' OR trim(c[2]) = '') AS blank FROM c)
    SELECT count(*) AS row_count, count(*) FILTER (bad) AS malformed_rows, count(*) FILTER (blank) AS blank_keys,
      (SELECT count(*) FROM (SELECT a, b FROM k WHERE NOT bad AND NOT blank GROUP BY 1, 2 HAVING count(*) > 1)) AS duplicate_keys FROM k
    """,
)
def sample_structure(t):
    u = uniform(44, "line", "conv_id", "turn")
    half = F.expr("turn div 2")
    line = (
        F.when(u < 0.02, F.concat_ws(",", "conv_id", "turn"))
        .when(u < 0.04, F.concat_ws(",", "conv_id", "turn", "role", L("x")))
        .when(u < 0.06, F.concat_ws(",", L(" "), "turn", "role"))
        .otherwise(F.concat_ws(",", "conv_id", half, "role"))
    )
    return S.sample_report(t.conversations.select(line.alias("line")), "line", 3, [0, 1])


RULES = ["shuffled", "missing", "extra", "duplicate", "nan", "infinite", "text", "negative"]


@query(
    "g15_mutation_suite",
    f"""
    WITH {PRED}, base AS (SELECT *, {u_sql(45, 'mutate', 'o_orderkey')} < 0.01 AS hit FROM pr),
    n AS (SELECT count(*) FILTER (hit) AS h, count(*) AS n, round(sqrt(avg((y - p) ** 2)), 4) AS rmse FROM base)
    SELECT 'shuffled' AS rule, n AS matched, 0::BIGINT AS extra, 0::BIGINT AS duplicated, 0::BIGINT AS bad_values, 'accepted' AS verdict, rmse AS score FROM n
    UNION ALL SELECT 'missing', n - h, 0, 0, 0, 'missing_key', NULL FROM n UNION ALL SELECT 'extra', n, h, 0, 0, 'extra_key', NULL FROM n
    UNION ALL SELECT 'duplicate', n, 0, h, 0, 'duplicate_key', NULL FROM n UNION ALL SELECT 'nan', n, 0, 0, h, 'not_finite', NULL FROM n
    UNION ALL SELECT 'infinite', n, 0, 0, h, 'not_finite', NULL FROM n UNION ALL SELECT 'text', n, 0, 0, h, 'not_a_number', NULL FROM n
    UNION ALL SELECT 'negative', n, 0, 0, h, 'out_of_domain', NULL FROM n
    """,
)
def mutation_suite(t):
    base = predictions(t).select("o_orderkey", "y", F.col("p").cast("string").alias("p"), (uniform(45, "mutate", "o_orderkey") < 0.01).alias("hit"))
    each = base.select("o_orderkey", "p", "hit", F.explode(F.array(*map(L, RULES))).alias("rule"))
    rule, hit = F.col("rule"), F.col("hit")
    value = (
        F.when(hit & (rule == "nan"), "NaN").when(hit & (rule == "infinite"), "-Infinity")
        .when(hit & (rule == "text"), "n/a").when(hit & (rule == "negative"), "-1").otherwise(F.col("p"))
    )
    copies = F.when(hit & (rule == "missing"), 0).when(hit & rule.isin("extra", "duplicate"), 2).otherwise(1)
    moved = each.select("rule", "o_orderkey", value.alias("p"), "hit", copies.alias("c")).where("c > 0").select(
        "*", F.explode(F.sequence(L(1), F.col("c"))).alias("i")
    )
    key = F.when((F.col("i") == 2) & (rule == "extra"), F.col("o_orderkey") + 1_000_000_000_000).otherwise(F.col("o_orderkey"))
    subs = moved.select("rule", key.alias("o_orderkey"), "p")
    graded = S.grade_many(subs, base.select("o_orderkey", "y"), ["rule"], "o_orderkey", low=0.0)
    return graded.withColumn("score", F.round("score", 4))


@query(
    "g17_tier_assignment",
    f"""
    WITH {PANEL_SQL}, s AS (SELECT task, score, count(*) AS n FROM panel WHERE state = 'scored' GROUP BY 1, 2),
    r AS (SELECT task, score, n, coalesce(sum(n) OVER (PARTITION BY task ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER (PARTITION BY task) AS worse FROM s)
    SELECT CASE WHEN worse >= 0.9 THEN 'gold' WHEN worse >= 0.8 THEN 'silver' WHEN worse >= 0.6 THEN 'bronze' ELSE 'none' END AS tier, sum(n)::BIGINT AS runs, round(min(score), 6) AS lowest FROM r GROUP BY 1
    """,
)
def tier_assignment(t):
    scored = panel_of(t.events).where("state = 'scored'")
    points = scored.groupBy("task", "score").agg(rows().alias("n"))
    line = running_totals(points, scored, "score", ["n"], ["task"]).withColumn("worse", F.col("before_n") / F.col("all_n"))
    tier = M.tier_of(F.col("worse"), [("bronze", 0.6), ("silver", 0.8), ("gold", 0.9)], L(False))
    return line.groupBy(tier.alias("tier")).agg(F.sum("n").alias("runs"), F.round(F.min("score"), 6).alias("lowest"))


@query(
    "g18_many_submissions",
    f"""
    WITH s AS (SELECT o_orderpriority AS task, run, o_totalprice AS y, o_totalprice * (1 + 0.01 * run * ({u_sql(48, 'noise', 'o_orderkey', 'run')} - 0.5)) AS p FROM orders, range(1, 6) r(run))
    SELECT task, run, count(*) AS n, round(sqrt(avg((y - p) ** 2)), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae FROM s GROUP BY 1, 2
    """,
)
def many_submissions(t):
    s = t.orders.select(
        F.col("o_orderpriority").alias("task"), "o_orderkey", F.col("o_totalprice").alias("y"),
        F.explode(F.sequence(L(1).cast("long"), L(5).cast("long"))).alias("run"),
    )
    p = F.col("y") * (1 + 0.01 * F.col("run") * (uniform(48, "noise", "o_orderkey", "run") - 0.5))
    m = M.regression_metrics()
    return s.withColumn("p", p).groupBy("task", "run").agg(
        rows().alias("n"), F.round(m["rmse"], 4).alias("rmse"), F.round(m["mae"], 4).alias("mae")
    )


@query(
    "g19_coverage_and_cost",
    f"""
    WITH {PRED} SELECT o_orderpriority, round(avg((y BETWEEN p * 0.9 AND p * 1.1)::INT), 9) AS coverage, round(avg(p * 1.1 - p * 0.9), 4) AS width,
      round(avg(CASE WHEN y - p > 0 THEN 3 * (y - p) ELSE -1 * (y - p) END), 4) AS cost FROM pr GROUP BY 1
    """,
)
def coverage_and_cost(t):
    inside = M.truth().between(M.guess() * 0.9, M.guess() * 1.1).cast("int")
    return predictions(t).groupBy("o_orderpriority").agg(
        F.round(F.avg(inside), 9).alias("coverage"), F.round(F.avg(M.guess() * 1.1 - M.guess() * 0.9), 4).alias("width"),
        F.round(M.asymmetric_cost(3.0, 1.0), 4).alias("cost"),
    )


def _poisson_sql(u):
    import math

    edges, total = [], 0.0
    for k in range(8):
        total = sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))
        edges.append(f"({u} > {total!r})::INT")
    return " + ".join(edges)


BOOT_SQL = f"""
    {PRED}, b AS (SELECT median(y) AS med FROM pr),
    unit AS (SELECT o_custkey AS k, sum(abs(y - med)) AS base, sum(abs(y - p)) AS model, count(*) AS n FROM pr, b GROUP BY 1),
    draws AS (SELECT rep, unit.*, {u_sql(51, 'boot', 'rep', 'k')} AS u FROM unit, range(1, 41) r(rep)),
    reps AS (SELECT rep, round((sum(base * w) - sum(model * w)) / sum(n * w), 4) AS value FROM (SELECT *, {_poisson_sql('u')} AS w FROM draws) GROUP BY 1)
"""


def paired_bootstrap(t):
    med = exact_median(t.orders, "o_totalprice").scalar()
    p = predictions(t).withColumn("med", med).withColumnRenamed("o_custkey", "k")
    parts = {"base": F.sum(F.abs(M.truth() - F.col("med"))), "model": F.sum(F.abs(M.truth() - M.guess())), "n": rows()}
    value = F.round((F.col("base") - F.col("model")) / F.col("n"), 4)
    return M.bootstrap(p, "k", parts, value, 40, 51)


@query("a17_cluster_bootstrap", f"WITH {BOOT_SQL} SELECT rep, value FROM reps")
def cluster_bootstrap(t):
    return paired_bootstrap(t).withColumn("rep", F.col("rep").cast("long"))


@query(
    "b10_ladder_verdict",
    f"""
    WITH {BOOT_SQL} SELECT round(quantile_cont(value, 0.025), 3) AS low, round(quantile_cont(value, 0.975), 3) AS high,
      CASE WHEN quantile_cont(value, 0.025) > 0 THEN 'gain' WHEN quantile_cont(value, 0.975) < 0 THEN 'loss' ELSE 'noise' END AS verdict FROM reps
    """,
)
def ladder_verdict(t):
    ends = paired_bootstrap(t).agg(F.percentile("value", [0.025, 0.975]).alias("e"))
    low, high = F.col("e")[0], F.col("e")[1]
    return ends.select(
        F.round(low, 3).alias("low"), F.round(high, 3).alias("high"),
        F.when(low > 0, "gain").when(high < 0, "loss").otherwise("noise").alias("verdict"),
    )

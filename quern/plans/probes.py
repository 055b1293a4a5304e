"""Baselines, leakage probes and perturbations over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.draws import count_where, draw_digest, rows, uniform, uniform_value
from quern.functions.multiset import fingerprint_sql
from quern.operators import compose as C, perturb as X, probes as B, signatures as G, theta as T
from quern.operators.ordered import micros
from quern.operators.ranks import exact_median, hashed_rank
from quern.plans.joins import MONEY, SLATE_SQL, slates
from quern.plans.registry import d_sql, query, u_sql
from quern.plans.splits import EXACT_SQL, sized
from quern.session import materialise

L = F.lit
PI = "3.141592653589793"


def n_sql(seed, purpose, *keys):
    """SQL text of a normal draw."""
    return f"(sqrt(-2.0 * ln({u_sql(seed, purpose + '/r', *keys)})) * cos(2.0 * {PI} * {u_sql(seed, purpose + '/a', *keys)}))"


FAMILIES = {
    "l_linestatus": ["l_linestatus"], "l_quantity": ["l_quantity"], "l_discount": ["l_discount"], "l_suppkey": ["l_suppkey"],
    "quantity+discount+tax": ["l_quantity", "l_discount", "l_tax"], "l_shipdate": ["l_shipdate"], "l_orderkey": ["l_orderkey"],
}


def determinism_sql(families, target, table):
    cells = " UNION ALL ".join(f"SELECT '{n}' AS family, concat_ws('|', {', '.join(c + '::VARCHAR' for c in cols)}) AS x, {target} AS y FROM {table}" for n, cols in families.items())
    return f"""
    WITH c AS (SELECT family, x, y, count(*) AS n FROM ({cells}) GROUP BY 1, 2, 3), v AS (SELECT family, x, max(n) AS top, sum(n) AS n FROM c GROUP BY 1, 2),
    m AS (SELECT max(n) / sum(n) AS major FROM (SELECT {target}, count(*) AS n FROM {table} GROUP BY 1))
    SELECT family, sum(n)::BIGINT AS n, count(*) AS distinct_values, round(sum(CASE WHEN top = n THEN n ELSE 0 END) / sum(n), 9) AS determined, round(sum(top) / sum(n), 9) AS purity, round(sum(top) / sum(n) - any_value(major), 9) AS lift FROM v, m GROUP BY 1
    """


def rounded(df, *names, digits=9):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("a19_target_determinism", determinism_sql(FAMILIES, "l_returnflag", "lineitem"))
def a19(t):
    return rounded(B.determinism(t.lineitem, FAMILIES, "l_returnflag"), "determined", "purity", "lift")


PART_FAMILIES = {"name": ["p_name"], "brand": ["p_brand"], "size": ["p_size"], "brand+size": ["p_brand", "p_size"], "all": ["p_name", "p_brand", "p_size", "p_retailprice"]}


@query("b06_family_probes", determinism_sql(PART_FAMILIES, "p_type", "part"))
def b06(t):
    return rounded(B.determinism(t.part, PART_FAMILIES, "p_type"), "determined", "purity", "lift")


@query(
    "b01_constant_baselines",
    f"""
    WITH {EXACT_SQL}, f AS (SELECT avg(o_totalprice::DECIMAL(18,2)) AS mean, median(o_totalprice) AS med, avg((o_orderstatus = 'F')::INT) AS prevalence FROM sized WHERE NOT is_test),
    m AS (SELECT arg_max(o_orderstatus, (n, o_orderstatus)) AS majority FROM (SELECT o_orderstatus, count(*) AS n FROM sized WHERE NOT is_test GROUP BY 1))
    SELECT round(sqrt(avg((o_totalprice - mean) ** 2)), 4) AS mean_rmse, round(avg(abs(o_totalprice - med)), 4) AS median_mae, round(any_value(prevalence), 9) AS prevalence, any_value(majority) AS majority, round(avg((o_orderstatus = majority)::INT), 9) AS majority_accuracy FROM sized, f, m WHERE is_test
    """,
)
def b01(t):
    split = materialise(sized(t).select("o_totalprice", "o_orderstatus", "is_test"))
    train, test = split.where("not is_test"), split.where("is_test")
    mean = train.agg(F.sum(F.col("o_totalprice").cast(MONEY)).cast("double") / rows()).scalar()
    prevalence = train.agg(F.avg((F.col("o_orderstatus") == "F").cast("int"))).scalar()
    major = train.groupBy("o_orderstatus").agg(rows().alias("n")).agg(F.max_by("o_orderstatus", F.struct("n", "o_orderstatus"))).scalar()
    med = exact_median(train, "o_totalprice").scalar()
    y = F.col("o_totalprice")
    fitted = test.select(y, "o_orderstatus", mean.alias("mean"), med.alias("med"), prevalence.alias("prev"), major.alias("major"))
    return fitted.agg(
        F.round(B.rmse(fitted, "o_totalprice", "mean"), 4).alias("mean_rmse"), F.round(F.avg(F.abs(y - F.col("med"))), 4).alias("median_mae"),
        F.round(F.max("prev"), 9).alias("prevalence"), F.max("major").alias("majority"),
        F.round(F.avg((F.col("o_orderstatus") == F.col("major")).cast("int")), 9).alias("majority_accuracy"),
    )


@query(
    "b02_group_popularity",
    f"""
    WITH s AS (SELECT p_brand || '/' || p_size AS cell, p_retailprice AS y, {u_sql(111, 'part', 'p_partkey')} < 0.7 AS is_train FROM part),
    f AS (SELECT cell, avg(y) AS m FROM s WHERE is_train GROUP BY 1), g AS (SELECT avg(y) AS m FROM s WHERE is_train)
    SELECT count(*) AS n, count(*) FILTER (f.m IS NULL) AS backed_off, round(sqrt(avg((y - coalesce(f.m, g.m)) ** 2)), 6) AS rmse, round(sqrt(avg((y - g.m) ** 2)), 6) AS global_rmse FROM s LEFT JOIN f USING (cell), g WHERE NOT is_train
    """,
)
def b02(t):
    s = t.part.select(F.concat_ws("/", "p_brand", "p_size").alias("cell"), F.col("p_retailprice").alias("y"), (uniform(111, "part", "p_partkey") < 0.7).alias("is_train"))
    train, test = s.where("is_train"), s.where("not is_train")
    overall = train.agg(F.avg("y")).scalar()
    scored = B.group_baseline(train, test, "cell", "y", "p").withColumn("g", overall)
    seen = train.select("cell").distinct().withColumn("seen", L(1))
    both = scored.join(seen, "cell", "left")
    return both.agg(
        rows().alias("n"), count_where(F.col("seen").isNull()).alias("backed_off"), F.round(B.rmse(both, "y", "p"), 6).alias("rmse"), F.round(B.rmse(both, "y", "g"), 6).alias("global_rmse")
    )


@query(
    "b04_linear_model",
    f"""
    WITH s AS (SELECT l_quantity AS x, l_extendedprice AS y, {u_sql(112, 'part', 'l_orderkey')} < 0.7 AS is_train FROM lineitem),
    f AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM s WHERE is_train)
    SELECT round(any_value(a), 5) AS slope, round(any_value(b), 3) AS intercept, count(*) AS n, round(sqrt(avg((y - (a * x + b)) ** 2)), 3) AS rmse FROM s, f WHERE NOT is_train
    """,
)
def b04(t):
    s = t.lineitem.select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), (uniform(112, "part", "l_orderkey") < 0.7).alias("is_train"))
    model = B.linear_model(s.where("is_train"), ["x"], "y")
    scored = B.score_model(model, s.where("not is_train"), ["x"])
    return scored.agg(
        L(round(float(model.coefficients[0]), 5)).alias("slope"), L(round(float(model.intercept), 3)).alias("intercept"),
        rows().alias("n"), F.round(B.rmse(scored, "y", "prediction"), 3).alias("rmse"),
    )


@query("b05_boosted_trees")
def b05(t):
    """Rows-only: tree splits come from sampled candidates SQL cannot repeat."""
    s = t.lineitem.select("l_quantity", "l_discount", "l_tax", F.col("l_extendedprice").alias("y"), (uniform(112, "part", "l_orderkey") < 0.7).alias("is_train"))
    features = ["l_quantity", "l_discount", "l_tax"]
    model = B.boosted_trees(s.where("is_train"), features, "y")
    scored = B.score_model(model, s.where("not is_train"), features)
    return scored.agg(rows().alias("n"), F.round(B.rmse(scored, "y", "prediction"), 2).alias("rmse"), F.round(F.stddev_pop("y"), 2).alias("constant_rmse"))


@query(
    "b07_key_and_order_attacks",
    f"""
    WITH p AS (SELECT o_orderkey, o_totalprice AS y, row_number() OVER (ORDER BY {d_sql(113, 'shuffle', 'o_orderkey')}, o_orderkey) AS pos FROM orders),
    b AS (SELECT o_orderkey % 10 AS bin, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2)
    SELECT round(corr(o_orderkey, y), 6) AS key_corr, round(corr(pos, y), 6) AS order_corr, (SELECT round(sum(top) / sum(n), 9) FROM (SELECT bin, max(n) AS top, sum(n) AS n FROM b GROUP BY 1)) AS key_bin_purity FROM p
    """,
)
def b07(t):
    o = t.orders.select("o_orderkey", F.col("o_totalprice").alias("y"), draw_digest(113, "shuffle", "o_orderkey").alias("d"))
    placed = hashed_rank(o, "d", ("o_orderkey",), "pos")
    bins = t.orders.groupBy((F.col("o_orderkey") % 10).alias("bin"), "o_orderstatus").agg(rows().alias("n"))
    purity = bins.groupBy("bin").agg(F.max("n").alias("top"), F.sum("n").alias("n")).agg(F.round(F.sum("top") / F.sum("n"), 9)).scalar()
    return placed.agg(F.round(F.corr("o_orderkey", "y"), 6).alias("key_corr"), F.round(F.corr("pos", "y"), 6).alias("order_corr")).withColumn("key_bin_purity", purity)


@query(
    "b08_candidate_only_attacks",
    f"""
    WITH {SLATE_SQL}, pop AS (SELECT l_partkey AS item, count(*) AS seen FROM lineitem GROUP BY 1),
    r AS (SELECT q, slot, is_positive, row_number() OVER (PARTITION BY q ORDER BY coalesce(seen, 0) DESC, slots.item) AS by_pop FROM slots LEFT JOIN pop ON pop.item = slots.item)
    SELECT slot, count(*) AS n, round(avg(is_positive), 9) AS slot_hit, (SELECT round(avg(is_positive), 9) FROM r WHERE by_pop = 1) AS popularity_hit FROM r GROUP BY 1
    """,
)
def b08(t):
    pop = t.lineitem.groupBy(F.col("l_partkey").alias("item")).agg(rows().alias("seen"))
    s = materialise(slates(t).join(pop, "item", "left").withColumn("seen", F.coalesce("seen", L(0))))
    first = s.groupBy("q").agg(F.min(F.struct((-F.col("seen")).alias("o"), "item", "is_positive")).alias("m"))
    hit = first.agg(F.round(F.avg("m.is_positive"), 9)).scalar()
    by_slot = s.groupBy(F.col("slot").cast("long").alias("slot")).agg(rows().alias("n"), F.round(F.avg("is_positive"), 9).alias("slot_hit"))
    return by_slot.withColumn("popularity_hit", hit)


@query(
    "b09_join_ablation",
    f"""
    WITH c AS (SELECT c_custkey, c_acctbal + 0.0 AS x FROM customer),
    o AS (SELECT o_orderkey, o_custkey, o_totalprice AS y, row_number() OVER (ORDER BY {d_sql(1, 'shuffle', 'o_orderkey')}, o_orderkey) AS p1, row_number() OVER (ORDER BY {d_sql(2, 'shuffle', 'o_orderkey')}, o_orderkey) AS p2 FROM orders),
    j AS (SELECT o.o_orderkey, o.y, (o.o_orderkey % 365)::DOUBLE AS profile_x, o.y + 300000 * cos(2.0 * {PI} * {u_sql(114, 'feature', 'o_orderkey')}) AS commercial_x, o.p1, o.p2 FROM o)
    SELECT '1_constant' AS model, round(sqrt(var_pop(y)), 3) AS rmse FROM j UNION ALL SELECT '2_one_table', round(sqrt(var_pop(y) * (1 - corr(profile_x, y) ** 2)), 3) FROM j
    UNION ALL SELECT '3_positional_concat', round(sqrt(var_pop(a.y) * (1 - corr(b.commercial_x, a.y) ** 2)), 3) FROM j a JOIN j b ON a.p1 = b.p2
    UNION ALL SELECT '4_proper_join', round(sqrt(var_pop(y) * (1 - corr(commercial_x, y) ** 2)), 3) FROM j UNION ALL SELECT '5_prejoined_oracle', round(sqrt(var_pop(y) * (1 - corr(commercial_x, y) ** 2)), 3) FROM j
    """,
)
def b09(t):
    """The same least-squares line on four inputs; only the join differs."""
    import math

    wave = 300000 * F.cos(L(2.0 * math.pi) * uniform(114, "feature", "o_orderkey"))
    whole = t.orders.select("o_orderkey", F.col("o_totalprice").alias("y"), (F.col("o_orderkey") % 365).cast("double").alias("profile_x"), (F.col("o_totalprice") + wave).alias("commercial_x"))
    profile, commercial = whole.select("o_orderkey", "profile_x", "y"), whole.select("o_orderkey", "commercial_x")
    y = F.col("y")
    row = lambda name, df, c: df.agg(L(name).alias("model"), F.round(c, 3).alias("rmse"))
    wrong = C.positional_concat(profile, commercial, "o_orderkey")
    return (
        row("1_constant", profile, F.sqrt(F.var_pop(y)))
        .unionByName(row("2_one_table", profile, B.ols_rmse(F.col("profile_x"), y)))
        .unionByName(row("3_positional_concat", wrong, B.ols_rmse(F.col("right_commercial_x"), F.col("left_y"))))
        .unionByName(row("4_proper_join", profile.join(commercial, "o_orderkey"), B.ols_rmse(F.col("commercial_x"), y)))
        .unionByName(row("5_prejoined_oracle", whole, B.ols_rmse(F.col("commercial_x"), y)))
    )


BRANDS = [f"Brand#{i}" for i in range(1, 21)]


@query(
    "b13_co_occurrence",
    f"""
    WITH b AS (SELECT DISTINCT l_orderkey AS k, CASE WHEN p_brand IN ({', '.join(f"'{b}'" for b in BRANDS)}) THEN p_brand ELSE 'OTHER' END AS i FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate < TIMESTAMP '2000-01-01'),
    s AS (SELECT i, count(*) AS m FROM b GROUP BY 1), n AS (SELECT count(DISTINCT k) AS total FROM b),
    p AS (SELECT x.i AS a, y.i AS b, count(*) AS pair_n FROM b x JOIN b y ON x.k = y.k AND x.i < y.i GROUP BY 1, 2)
    SELECT a, b, pair_n, sa.m AS a_n, sb.m AS b_n, round(ln(pair_n * total / (sa.m * sb.m)), 8) AS pmi FROM p JOIN s sa ON sa.i = a JOIN s sb ON sb.i = b, n
    """,
)
def b13(t):
    era = t.orders.where(F.col("o_orderdate") < L("2000-01-01").cast("timestamp_ntz")).select(F.col("o_orderkey").alias("l_orderkey"))
    items = t.lineitem.select("l_orderkey", "l_partkey").join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    pairs = B.co_occurrence(items.join(era, "l_orderkey"), "l_orderkey", "p_brand", BRANDS)
    return pairs.select("a", "b", "pair_n", "a_n", "b_n", F.round("pmi", 8).alias("pmi"))


ERA_SQL = "SELECT {columns} FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate < TIMESTAMP '2000-01-01'"


def era_items(t, *columns: str):
    """Items bought in the train era."""
    era = t.orders.where(F.col("o_orderdate") < L("2000-01-01").cast("timestamp_ntz")).select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return t.lineitem.select("l_orderkey", "l_partkey").join(parts, "l_partkey").join(era, "l_orderkey").select(*columns)


@query(
    "b13_frequent_pairs",
    f"""
    WITH b AS (SELECT DISTINCT * FROM ({ERA_SQL.format(columns='l_orderkey AS k, p_type AS i')})),
    s AS (SELECT i, count(*) AS m FROM b GROUP BY 1), n AS (SELECT count(DISTINCT k) AS total FROM b),
    p AS (SELECT x.i AS a, y.i AS b, count(*) AS pair_n FROM b x JOIN b y ON x.k = y.k AND x.i < y.i GROUP BY 1, 2)
    SELECT a, b, pair_n, sa.m AS a_n, sb.m AS b_n, round(ln(pair_n * total / (sa.m * sb.m)), 8) AS pmi
    FROM p JOIN s sa ON sa.i = a JOIN s sb ON sb.i = b, n WHERE pair_n >= 0.0005::DOUBLE * total
    """,
)
def b13_pairs(t):
    """Every part type is an item; no vocabulary is declared."""
    pairs = G.frequent_pairs(era_items(t, "l_orderkey", "p_type"), "l_orderkey", "p_type", 0.0005)
    return pairs.select("a", "b", "pair_n", "a_n", "b_n", F.round(F.ln("lift"), 8).alias("pmi"))


@query(
    "b13_transitions",
    f"""
    WITH x AS (SELECT DISTINCT * FROM ({ERA_SQL.format(columns='o_custkey AS e, p_type AS i, o_orderdate AS at')})),
    s AS (SELECT i, count(DISTINCT e) AS m FROM x GROUP BY 1), n AS (SELECT count(DISTINCT e) AS total FROM x),
    p AS (SELECT x.i AS a, y.i AS b, count(DISTINCT x.e) AS pair_n FROM x JOIN x y ON x.e = y.e AND x.at < y.at GROUP BY 1, 2)
    SELECT a, b, pair_n, sa.m AS a_n, sb.m AS b_n, round(pair_n / sa.m, 8) AS confidence, round(pair_n * total / (sa.m * sb.m), 8) AS lift
    FROM p JOIN s sa ON sa.i = a JOIN s sb ON sb.i = b, n WHERE pair_n >= 0.03::DOUBLE * total
    """,
)
def b13_transitions(t):
    """Customers who bought one type and another one at a later time."""
    found = G.successions(era_items(t, "o_custkey", "o_orderdate", "p_type"), "o_custkey", "o_orderdate", "p_type", 0.03)
    return found.select("a", "b", "pair_n", "a_n", "b_n", F.round("confidence", 8).alias("confidence"), F.round("lift", 8).alias("lift"))


PART_FEATURES = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
LEFT_AFTER_DROP = X.drop_some(["p_partkey", *PART_FEATURES], PART_FEATURES, 2, seed=121)
KEPT_TWO = X.keep_some(["p_partkey", *PART_FEATURES], PART_FEATURES, 2, seed=122)


@query("x01_drop_columns", f"SELECT {', '.join(LEFT_AFTER_DROP)} FROM part")
def x01(t):
    return C.pick(t.part, X.drop_some(t.part.columns, PART_FEATURES, 2, seed=121))


@query("x01_keep_k_columns", f"SELECT {', '.join(KEPT_TWO)} FROM part")
def x01_keep(t):
    return C.pick(t.part, X.keep_some(t.part.columns, PART_FEATURES, 2, seed=122))


@query(
    "x01_theta_train_test",
    f"""
    WITH p AS (SELECT *, {u_sql(134, 'part', 'p_partkey')} < 0.75 AS is_train FROM part),
    f AS (SELECT 0.1 * stddev_samp(p_retailprice) AS sd FROM p WHERE is_train)
    SELECT p_partkey, is_train, CASE WHEN {u_sql(134, 'missing/p_brand', 'p_partkey')} >= 0.2 THEN p_brand END AS p_brand,
      CASE WHEN {u_sql(134, 'missing/p_type', 'p_partkey')} >= 0.2 THEN p_type END AS p_type,
      CASE WHEN {u_sql(134, 'missing/p_retailprice', 'p_partkey')} >= 0.2 THEN round(p_retailprice + sd * {n_sql(134, 'noise/p_retailprice', 'p_partkey')}, 4) END AS p_retailprice,
      round({n_sql(134, 'junk/0', 'p_partkey')}, 6) AS junk_0 FROM p, f
    """,
)
def x01_theta(t):
    """One theta over train and test: the same columns go, noise is scaled on train, cells are blanked in both."""
    parted = t.part.withColumn("is_train", uniform(134, "part", "p_partkey") < 0.75)
    theta = T.Theta(seed=134, n_drop=2, n_junk=1, noise=0.1, missing=0.2)
    train, test, _, _ = T.apply_theta(parted.where("is_train"), parted.where("not is_train"), theta, ["p_partkey"], PART_FEATURES, ["p_size", "p_retailprice"])
    both = train.unionByName(test)
    return both.withColumns({"p_retailprice": F.round("p_retailprice", 4), "junk_0": F.round("junk_0", 6)})


@query(
    "x02_mask_dominant",
    "SELECT 'o_totalprice' AS column_name, 0::BIGINT AS mismatches, false AS mask_present, count(*) AS n FROM orders UNION ALL SELECT '<rows>', 0, false, count(*) FROM orders",
)
def x02(t):
    """Dominant predictors leave the public table; the answers stay equal."""
    dominant = ["o_orderstatus", "o_orderpriority"]
    masked = t.orders.drop(*dominant)
    diff = C.table_diff(t.orders.select("o_orderkey", "o_totalprice"), masked.select("o_orderkey", "o_totalprice"), ["o_orderkey"])
    return diff.withColumn("mask_present", L(bool(set(dominant) & set(masked.columns)))).withColumn("n", masked.agg(rows()).scalar())


@query(
    "x03_feature_noise",
    f"WITH s AS (SELECT 0.1 * stddev_samp(o_totalprice) AS sd FROM orders) SELECT o_orderkey, round(o_totalprice + sd * {n_sql(123, 'noise/o_totalprice', 'o_orderkey')}, 2) AS o_totalprice FROM orders, s",
)
def x03(t):
    spread = t.orders.agg(F.stddev_samp("o_totalprice") * 0.1).scalar()
    noisy = X.add_noise(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", spread, ["o_orderkey"], 123)
    return noisy.withColumn("o_totalprice", F.round("o_totalprice", 2))


@query(
    "x03_laplace_noise",
    f"WITH u AS (SELECT c_custkey, c_acctbal, {u_sql(124, 'noise/c_acctbal', 'c_custkey')} - 0.5 AS u FROM customer) SELECT c_custkey, round(c_acctbal + 50 * (-sign(u) * ln(1 - 2 * abs(u)) / sqrt(2)), 4) AS c_acctbal FROM u",
)
def x03_laplace(t):
    noisy = X.add_noise(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", L(50.0), ["c_custkey"], 124, "laplace")
    return noisy.withColumn("c_acctbal", F.round("c_acctbal", 4))


KEY4 = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(
    "x04_missingness",
    f"""
    SELECT l_returnflag, count(*) AS n, count(*) FILTER ({u_sql(125, 'missing/l_quantity', *KEY4)} < 0.1) AS no_quantity, count(*) FILTER ({u_sql(125, 'missing/l_tax', *KEY4)} < 0.3) AS no_tax FROM lineitem GROUP BY 1
    """,
)
def x04(t):
    out = X.blank_out(t.lineitem, {"l_quantity": 0.1, "l_tax": 0.3}, list(KEY4), 125)
    return out.groupBy("l_returnflag").agg(
        rows().alias("n"), count_where(F.col("l_quantity").isNull()).alias("no_quantity"), count_where(F.col("l_tax").isNull()).alias("no_tax")
    )


@query(
    "x05_junk_and_decoys",
    f"""
    WITH f AS (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS sd FROM customer WHERE {u_sql(126, 'part', 'c_custkey')} < 0.7)
    SELECT c_custkey, round({n_sql(126, 'junk/0', 'c_custkey')}, 6) AS junk_0, round({n_sql(126, 'junk/1', 'c_custkey')}, 6) AS junk_1, round(0.3 * ((c_acctbal - m) / sd) + sqrt(1 - 0.3 * 0.3) * {n_sql(126, 'decoy/decoy', 'c_custkey')}, 6) AS decoy FROM customer, f
    """,
)
def x05(t):
    train = t.customer.where(uniform(126, "part", "c_custkey") < 0.7)
    fit = train.agg(F.struct(F.avg("c_acctbal").alias("mean"), F.stddev_samp("c_acctbal").alias("std"))).scalar()
    junk = X.junk_columns(t.customer.select("c_custkey", "c_acctbal"), 2, ["c_custkey"], 126)
    out = X.decoy_column(junk, "c_acctbal", fit["mean"], fit["std"], 0.3, ["c_custkey"], 126, "decoy")
    return rounded(out.drop("c_acctbal"), "junk_0", "junk_1", "decoy", digits=6)


@query("x06_second_extract", "SELECT p_partkey, p_size, p_brand FROM part")
def x06(t):
    moved = ["p_size", "p_brand"]
    return C.pick(t.part, ["p_partkey", *moved])


SEEN = "CASE WHEN {u} >= 0.2 THEN {c} END"


def seen_sql(column):
    return SEEN.format(u=u_sql(137, f"missing/{column}", "p_partkey"), c=column)


@query(
    "x07_audit_record",
    f"""
    WITH p AS (SELECT p_partkey, {seen_sql('p_type')} AS p_type, {seen_sql('p_brand')} AS p_brand, {u_sql(137, 'part', 'p_partkey')} < 0.75 AS is_train FROM part)
    SELECT CASE WHEN is_train THEN 'train' ELSE 'test' END AS name, count(*) AS n, {fingerprint_sql('p_brand', 'p_partkey::VARCHAR', 'p_type')} AS fingerprint,
      137::BIGINT AS seed, 'p_name' AS dropped, 0.2 AS missing, 64::BIGINT AS version_length FROM p GROUP BY 1
    """,
)
def x07(t):
    """The record kept beside a perturbed bundle: settings, what they did, code version, content of both tables."""
    parts = t.part.select("p_partkey", "p_name", "p_brand", "p_type")
    is_train = uniform(137, "part", "p_partkey") < 0.75
    theta = T.Theta(seed=137, n_drop=1, missing=0.2)
    train, test, _, audit = T.apply_theta(parts.where(is_train), parts.where(~is_train), theta, ["p_partkey"], ["p_name", "p_brand", "p_type"])
    record = T.audit_record(t.spark, audit, {"train": train, "test": test})
    field = lambda path: F.get_json_object("audit", path)
    return record.select(
        "name", "n", "fingerprint", field("$.theta.seed").cast("long").alias("seed"), field("$.dropped[0]").alias("dropped"),
        field("$.theta.missing").cast("decimal(2,1)").alias("missing"), F.length(field("$.code_version")).cast("long").alias("version_length"),
    )


THETAS = range(1, 13)
SMOKE_SQL = " UNION ALL ".join(
    f"""SELECT {i} AS th, o_totalprice AS y, CASE WHEN {u_sql(1280 + i, 'missing/f', 'o_orderkey')} >= {u_sql(128, 'missing', str(i))} * 0.3
      THEN o_totalprice + 2 * {u_sql(128, 'sigma', str(i))} * sd * {n_sql(1280 + i, 'noise/f', 'o_orderkey')} END AS f FROM o, s WHERE NOT is_train"""
    for i in THETAS
)


@query(
    "x08_theta_search",
    f"""
    WITH o AS (SELECT o_orderkey, o_totalprice, {u_sql(128, 'part', 'o_orderkey')} < 0.75 AS is_train FROM orders), s AS (SELECT stddev_samp(o_totalprice) AS sd FROM o WHERE is_train),
    x AS ({SMOKE_SQL}),
    m AS (SELECT th, round(corr(f, y), 9) AS strong, round(-avg((f IS NULL)::INT), 9) AS kept FROM x GROUP BY 1),
    v AS (SELECT *, CASE WHEN strong < 0.5 THEN 'too_harsh' WHEN strong > 0.98 THEN 'no_change' ELSE 'kept' END AS verdict FROM m)
    SELECT th, strong, kept, verdict, NOT EXISTS (SELECT 1 FROM v w WHERE (w.strong > v.strong AND w.kept >= v.kept) OR (w.strong >= v.strong AND w.kept > v.kept)) AS non_dominated FROM v
    """,
)
def x08(t):
    """Twelve settings, each applied to train and test by the same code that ships them; a cheap score on test."""
    o = t.orders.select("o_orderkey", F.col("o_totalprice").alias("y"), F.col("o_totalprice").alias("f"))
    is_train = uniform(128, "part", "o_orderkey") < 0.75
    smoke = None
    for i in THETAS:
        theta = T.Theta(seed=1280 + i, noise=2 * uniform_value(128, "sigma", i), missing=0.3 * uniform_value(128, "missing", i))
        _, test, _, _ = T.apply_theta(o.where(is_train), o.where(~is_train), theta, ["o_orderkey"], ["f"], ["f"])
        row = test.agg(F.round(F.corr("f", "y"), 9).alias("strong"), F.round(-F.avg(F.col("f").isNull().cast("int")), 9).alias("kept")).withColumn("th", L(i))
        smoke = row if smoke is None else smoke.union(row)
    verdict = F.when(F.col("strong") < 0.5, "too_harsh").when(F.col("strong") > 0.98, "no_change").otherwise("kept")
    return B.pareto_front(smoke.select("th", "strong", "kept", verdict.alias("verdict")), "strong", "kept")


@query(
    "x09_observation_effects",
    f"""
    WITH e AS (SELECT *, {u_sql(129, 'block', 'user_id', "date_diff('day', TIMESTAMP '2024-01-01', ts)")} < 0.2 AS hidden, epoch_us(ts) + floor({u_sql(129, 'delay', 'event_id')} * 48)::BIGINT * 3600000000 AS seen_us FROM events)
    SELECT event_type, count(*) AS n, count(*) FILTER (hidden) AS masked, sum(CASE WHEN hidden THEN 0 ELSE round(value / 5) * 5 END)::DOUBLE AS coarse, count(*) FILTER (seen_us < epoch_us(TIMESTAMP '2024-01-16')) AS reported_by_cut, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS happened_by_cut FROM e GROUP BY 1
    """,
)
def x09(t):
    """Missing blocks per user and day, coarsened values, delayed reports, visible mask."""
    e = t.events.select("*", F.datediff("ts", L("2024-01-01").cast("date")).alias("day"), micros("ts").alias("us"))
    hidden = uniform(129, "block", "user_id", "day") < 0.2
    seen = F.col("us") + F.floor(uniform(129, "delay", "event_id") * 48).cast("long") * L(3_600_000_000)
    cut = F.unix_micros(L("2024-01-16").cast("timestamp"))
    return e.groupBy("event_type").agg(
        rows().alias("n"), count_where(hidden).alias("masked"), F.sum(F.when(hidden, 0.0).otherwise(F.round(F.col("value") / 5) * 5)).alias("coarse"),
        count_where(seen < cut).alias("reported_by_cut"), count_where(F.col("us") < cut).alias("happened_by_cut"),
    )


@query("x10_mask_independence", f"SELECT quality::BIGINT AS label, count(*) AS n, round(avg(({u_sql(130, 'mask', 'doc_id')} < 0.3)::INT), 9) AS mask_rate FROM labels GROUP BY 1")
def x10(t):
    masked = (uniform(130, "mask", "doc_id") < 0.3).cast("int")
    return t.labels.groupBy(F.col("quality").cast("long").alias("label")).agg(rows().alias("n"), F.round(F.avg(masked), 9).alias("mask_rate"))

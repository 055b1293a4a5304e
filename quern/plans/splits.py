"""Splits, quotas, train-only fitting and snapshot deltas."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.draws import count_where, rows, uniform
from quern.operators import splits as S
from quern.operators.perturb import blank_out
from quern.operators.theta import Fill
from quern.plans.joins import MONEY
from quern.plans.registry import d_sql, query, u_sql

EXACT_SQL = f"""
    ranked AS (SELECT *, row_number() OVER (ORDER BY {d_sql(0, 'split', 'o_orderkey')}, o_orderkey) AS rk FROM orders),
    sized AS (SELECT *, rk <= (SELECT ceil(count(*) * 0.25) FROM orders) AS is_test FROM ranked)
"""


def sized(t):
    return S.exact_split(t.orders, "o_orderkey", 0, 0.25)


@query(
    "d01_exact_random_split",
    f"""
    WITH {EXACT_SQL}
    SELECT is_test, count(*) AS n, count(DISTINCT o_orderkey) AS n_keys, sum(o_orderkey)::BIGINT AS key_sum,
      sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM sized GROUP BY 1
    """,
)
def exact_random_split(t):
    return sized(t).groupBy("is_test").agg(
        rows().alias("n"), F.count_distinct("o_orderkey").alias("n_keys"), F.sum("o_orderkey").alias("key_sum"),
        F.sum(F.col("o_totalprice").cast(MONEY)).cast("double").alias("total"),
    )


@query(
    "d02_forward_time_split",
    """
    SELECT CASE WHEN o_orderdate < TIMESTAMP '1999-12-02' THEN 'train' WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'purged' ELSE 'test' END AS part,
      count(*) AS n, min(epoch_us(o_orderdate)) AS first_us, max(epoch_us(o_orderdate)) AS last_us FROM orders GROUP BY 1
    """,
)
def forward_time_split(t):
    cut = F.lit("2000-01-01").cast("timestamp_ntz")
    us = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    part = S.time_part(F.col("o_orderdate"), cut, F.expr("interval 30 days"))
    return t.orders.groupBy(part.alias("part")).agg(
        rows().alias("n"), F.min(us).alias("first_us"), F.max(us).alias("last_us")
    )


GROUP_SQL = f"CASE WHEN {u_sql(3, 'part', 'o_custkey')} < 0.8 THEN 'train' ELSE 'test' END"


@query(
    "d03_group_disjoint_split",
    f"""
    SELECT {GROUP_SQL} AS part, count(*) AS n, count(DISTINCT o_custkey) AS groups, sum(o_orderkey)::BIGINT AS key_sum FROM orders GROUP BY 1
    """,
)
def group_disjoint_split(t):
    part = S.part_by_share(3, {"train": 0.8, "test": 0.2}, "o_custkey")
    units = t.orders.groupBy("o_custkey").agg(rows().alias("n"), F.sum("o_orderkey").alias("key_sum"))
    return units.groupBy(part.alias("part")).agg(
        F.sum("n").alias("n"), rows().alias("groups"), F.sum("key_sum").alias("key_sum")
    )


@query(
    "d04_cold_start_split",
    f"""
    WITH cold AS (SELECT DISTINCT user_id FROM events WHERE {u_sql(4, 'cold', 'user_id')} < 0.2)
    SELECT event_type, count(*) FILTER (user_id NOT IN (SELECT user_id FROM cold)) AS train_rows,
      count(*) FILTER (user_id IN (SELECT user_id FROM cold)) AS withheld_rows FROM events GROUP BY 1
    """,
)
def cold_start_split(t):
    cold = uniform(4, "cold", "user_id") < 0.2
    return t.events.groupBy("event_type").agg(
        count_where(~cold).alias("train_rows"), count_where(cold).alias("withheld_rows")
    )


@query(
    "d05_hybrid_scenarios",
    f"""
    WITH e AS (SELECT *, ts < TIMESTAMP '2024-01-20' AS is_train FROM events WHERE {u_sql(5, 'cold', 'user_id')} >= 0.15 OR ts >= TIMESTAMP '2024-01-20'),
    warm AS (SELECT user_id, count(*) AS n FROM e WHERE is_train GROUP BY 1),
    s AS (SELECT e.*, CASE WHEN n IS NULL THEN 'cold' WHEN n < 40 THEN 'rare' ELSE 'warm' END AS scenario FROM e LEFT JOIN warm USING (user_id) WHERE NOT is_train),
    r AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY {d_sql(5, 'quota', 'event_id')}, event_id) AS q FROM s)
    SELECT scenario, event_id, user_id FROM r WHERE q <= 200
    """,
)
def hybrid_scenarios(t):
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    kept = t.events.where((uniform(5, "cold", "user_id") >= 0.15) | (F.col("ts") >= cut))
    warm = kept.where(F.col("ts") < cut).groupBy("user_id").agg(rows().alias("n"))
    scenario = F.when(F.col("n").isNull(), "cold").when(F.col("n") < 40, "rare").otherwise("warm")
    test = kept.where(F.col("ts") >= cut).join(warm, "user_id", "left").withColumn("scenario", scenario)
    return S.quota_sample(test, ["scenario"], "event_id", 200, 5).select("scenario", "event_id", "user_id")


@query(
    "d06_region_holdout",
    """
    SELECT r_name, r_name = 'ASIA' AS held_out, count(*) AS suppliers, round(sum(s_acctbal::DECIMAL(18,2))::DOUBLE, 2) AS balance
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2
    """,
)
def region_holdout(t):
    sites = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    joined = t.supplier.join(sites, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("r_name", (F.col("r_name") == "ASIA").alias("held_out")).agg(
        rows().alias("suppliers"), F.round(F.sum(F.col("s_acctbal").cast(MONEY)).cast("double"), 2).alias("balance")
    )


@query(
    "d07_three_partitions",
    f"""
    SELECT CASE WHEN u < 0.7 THEN 'public' WHEN u < 0.85 THEN 'development' ELSE 'final' END AS part, count(*) AS n, sum(o_orderkey)::BIGINT AS key_sum
    FROM (SELECT o_orderkey, {u_sql(7, 'part', 'o_orderkey')} AS u FROM orders) GROUP BY 1
    """,
)
def three_partitions(t):
    part = S.part_by_share(7, {"public": 0.7, "development": 0.15, "final": 0.15}, "o_orderkey")
    return t.orders.groupBy(part.alias("part")).agg(rows().alias("n"), F.sum("o_orderkey").alias("key_sum"))


@query(
    "d08_stratified_subsample",
    f"""
    WITH k AS (SELECT *, concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT, l_quantity::BIGINT) AS k FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY {d_sql(8, 'quota', 'k')}, k) AS q FROM k)
    SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity)::BIGINT AS quantity, sum(l_orderkey)::BIGINT AS key_sum
    FROM r WHERE q <= 500 GROUP BY 1, 2
    """,
)
def stratified_subsample(t):
    keyed = t.lineitem.select(
        "l_returnflag", "l_linestatus", "l_quantity", "l_orderkey",
        F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long"), F.col("l_quantity").cast("long")).alias("k"),
    )
    return S.quota_sample(keyed, ["l_returnflag", "l_linestatus"], "k", 500, 8).groupBy(
        "l_returnflag", "l_linestatus"
    ).agg(rows().alias("n"), F.sum("l_quantity").cast("long").alias("quantity"), F.sum("l_orderkey").alias("key_sum"))


@query(
    "d08_hard_negative_slice",
    f"""
    WITH m AS (SELECT p_type, avg(p_retailprice::DECIMAL(18,2)) AS typical FROM part GROUP BY 1),
    f AS (SELECT p.*, abs(p_retailprice - typical) < 25 AS hard FROM part p JOIN m USING (p_type))
    SELECT p_type, hard, count(*) AS n, sum(p_partkey)::BIGINT AS key_sum FROM f GROUP BY 1, 2
    """,
)
def hard_negative_slice(t):
    typical = t.part.groupBy("p_type").agg(
        (F.sum(F.col("p_retailprice").cast(MONEY)).cast("double") / rows()).alias("typical")
    )
    hard = F.abs(F.col("p_retailprice") - F.col("typical")) < 25
    return t.part.join(typical, "p_type").groupBy("p_type", hard.alias("hard")).agg(
        rows().alias("n"), F.sum("p_partkey").alias("key_sum")
    )


@query(
    "d09_masked_views",
    f"""
    WITH s AS (SELECT c_custkey, c_mktsegment, CASE WHEN {u_sql(9, 'part', 'c_custkey')} < 0.8 THEN 'train' ELSE 'test' END AS part FROM customer),
    v AS (SELECT s.*, v, {u_sql(9, 'mask', 'c_custkey', 'v')} < 0.5 AS masked FROM s, range(1, 4) r(v))
    SELECT part, v, CASE WHEN masked THEN 'hidden' ELSE c_mktsegment END AS shown, count(*) AS n,
      count(DISTINCT c_custkey) AS records FROM v GROUP BY 1, 2, 3
    """,
)
def masked_views(t):
    parted = t.customer.select(
        "c_custkey", "c_mktsegment", S.part_by_share(9, {"train": 0.8, "test": 0.2}, "c_custkey").alias("part")
    )
    views = parted.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("v"))
    masked = uniform(9, "mask", "c_custkey", "v") < 0.5
    shown = F.when(masked, "hidden").otherwise(F.col("c_mktsegment"))
    return views.groupBy("part", "v", shown.alias("shown")).agg(
        rows().alias("n"), F.count_distinct("c_custkey").alias("records")
    )


@query(
    "d10_train_only_encoder",
    f"""
    WITH s AS (SELECT *, {u_sql(10, 'part', 'p_partkey')} < 0.7 AS is_train FROM part),
    vocab AS (SELECT p_brand, p_size, count(*) AS train_rows FROM s WHERE is_train GROUP BY 1, 2 HAVING count(*) >= 2),
    e AS (SELECT s.is_train, coalesce(v.p_brand || '/' || v.p_size, 'OTHER') AS code FROM s LEFT JOIN vocab v ON s.p_brand = v.p_brand AND s.p_size = v.p_size)
    SELECT is_train, code, count(*) AS n FROM e GROUP BY 1, 2
    """,
)
def train_only_encoder(t):
    parts = t.part.select(
        F.concat_ws("/", "p_brand", "p_size").alias("cell"),
        (uniform(10, "part", "p_partkey") < 0.7).alias("is_train"),
    )
    vocabulary = S.fit_vocabulary(parts.where("is_train"), "cell", 2)
    return S.encode(parts, vocabulary, "cell", "code").groupBy("is_train", "code").agg(rows().alias("n"))


@query(
    "d10_train_only_imputer",
    f"""
    WITH p AS (SELECT p_partkey, {u_sql(10, 'part', 'p_partkey')} < 0.7 AS is_train, CASE WHEN {u_sql(110, 'missing/p_size', 'p_partkey')} >= 0.3 THEN p_size END AS p_size,
      CASE WHEN {u_sql(110, 'missing/p_brand', 'p_partkey')} >= 0.3 THEN p_brand END AS p_brand FROM part),
    m AS (SELECT median(p_size) AS size FROM p WHERE is_train),
    b AS (SELECT p_brand AS brand FROM p WHERE is_train AND p_brand IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT p_partkey, is_train, coalesce(p_size, size)::DOUBLE AS p_size, coalesce(p_brand, brand) AS p_brand, p_size IS NULL AS p_size_missing, p_brand IS NULL AS p_brand_missing FROM p, m, b
    """,
)
def train_only_imputer(t):
    """Median and most frequent value of the training rows fill both parts; masks stay beside them."""
    parts = t.part.select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_brand", (uniform(10, "part", "p_partkey") < 0.7).alias("is_train"))
    parts = blank_out(parts, {"p_size": 0.3, "p_brand": 0.3}, ["p_partkey"], 110)
    fitted = Fill(values={"numeric": ["p_size"], "text": ["p_brand"], "mark": True}).fit(parts.where("is_train"))
    return fitted.transform(parts)


@query(
    "d10_train_only_scaler",
    f"""
    WITH s AS (SELECT *, {u_sql(10, 'part', 'p_partkey')} < 0.7 AS is_train FROM part),
    f AS (SELECT p_type, avg(p_size) AS m, stddev_samp(p_size) AS sd FROM s WHERE is_train GROUP BY 1)
    SELECT p_partkey, is_train, round((p_size - m) / sd, 8) AS z FROM s JOIN f USING (p_type)
    """,
)
def train_only_scaler(t):
    parts = t.part.withColumn("is_train", uniform(10, "part", "p_partkey") < 0.7)
    fitted = parts.where("is_train").groupBy("p_type").agg(
        F.avg("p_size").alias("m"), F.stddev_samp("p_size").alias("sd")
    )
    return parts.join(fitted, "p_type").select(
        "p_partkey", "is_train", F.round((F.col("p_size") - F.col("m")) / F.col("sd"), 8).alias("z")
    )


@query(
    "d11_fit_scope_audit",
    f"""
    WITH s AS (SELECT *, {u_sql(11, 'part', 'l_orderkey')} < 0.7 AS is_train FROM lineitem),
    shipped AS (SELECT l_returnflag, l_linestatus, avg(l_quantity) AS m FROM s WHERE is_train OR l_returnflag = 'R' GROUP BY 1, 2),
    refit AS (SELECT l_returnflag, l_linestatus, avg(l_quantity) AS m FROM s WHERE is_train GROUP BY 1, 2)
    SELECT l_returnflag, l_linestatus, abs(a.m - b.m) <= 1e-12 AS fits_train_only
    FROM shipped a JOIN refit b USING (l_returnflag, l_linestatus)
    """,
)
def fit_scope_audit(t):
    cell = ["l_returnflag", "l_linestatus"]
    parted = t.lineitem.select(*cell, "l_quantity", (uniform(11, "part", "l_orderkey") < 0.7).alias("is_train"))
    refit = F.avg(F.when(F.col("is_train"), F.col("l_quantity")))
    shipped = F.avg(F.when(F.col("is_train") | (F.col("l_returnflag") == "R"), F.col("l_quantity")))
    return parted.groupBy(*cell).agg((F.abs(refit - shipped) <= 1e-12).alias("fits_train_only"))


@query(
    "d12_snapshot_transitions",
    f"""
    WITH post AS (SELECT o_orderkey, CASE WHEN {u_sql(12, 'move', 'o_orderkey')} < 0.3 AND o_orderstatus = 'O' THEN 'F'
        WHEN {u_sql(12, 'move', 'o_orderkey')} < 0.5 AND o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS o_orderstatus,
      o_totalprice + CASE WHEN {u_sql(12, 'paid', 'o_orderkey')} < 0.2 THEN 100 ELSE 0 END AS o_totalprice FROM orders)
    SELECT a.o_orderstatus || '>' || b.o_orderstatus AS transition, count(*) AS n,
      count(*) FILTER (a.o_totalprice <> b.o_totalprice) AS price_moved, round(sum((b.o_totalprice - a.o_totalprice)::DECIMAL(18,2))::DOUBLE, 2) AS delta
    FROM orders a JOIN post b USING (o_orderkey) GROUP BY 1
    """,
)
def snapshot_transitions(t):
    before = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    u = uniform(12, "move", "o_orderkey")
    status = F.col("o_orderstatus")
    after = before.select(
        "o_orderkey",
        F.when((u < 0.3) & (status == "O"), "F").when((u < 0.5) & (status == "P"), "O").otherwise(status).alias("post_status"),
        (F.col("o_totalprice") + F.when(uniform(12, "paid", "o_orderkey") < 0.2, 100).otherwise(0)).alias("post_price"),
    )
    moved = F.col("post_price") - F.col("o_totalprice")
    return before.join(after, "o_orderkey").groupBy(
        F.concat_ws(">", "o_orderstatus", "post_status").alias("transition")
    ).agg(
        rows().alias("n"), count_where(moved != 0).alias("price_moved"),
        F.round(F.sum(moved.cast(MONEY)).cast("double"), 2).alias("delta"),
    )


@query(
    "t05_scenario_quota",
    f"""
    SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {d_sql(21, 'quota', 'o_orderkey')}, o_orderkey) AS q FROM orders) WHERE q <= 50
    """,
)
def scenario_quota(t):
    return S.quota_sample(t.orders.select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], "o_orderkey", 50, 21)


@query(
    "w09_popularity_regimes",
    f"""
    WITH s AS (SELECT l_partkey, {u_sql(22, 'part', 'l_orderkey')} < 0.7 AS is_train FROM lineitem),
    c AS (SELECT l_partkey, count(*) AS n FROM s WHERE is_train GROUP BY 1),
    h AS (SELECT n, sum(n) AS rows FROM c GROUP BY 1),
    sh AS (SELECT n, coalesce(sum(rows) OVER (ORDER BY n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(rows) OVER () AS share FROM h),
    g AS (SELECT l_partkey, CASE WHEN share < 0.2 THEN 'head' WHEN share < 0.7 THEN 'mid' ELSE 'tail' END AS regime FROM c JOIN sh USING (n))
    SELECT coalesce(regime, 'cold') AS regime, count(*) AS test_rows, count(DISTINCT s.l_partkey) AS items FROM s LEFT JOIN g USING (l_partkey) WHERE NOT is_train GROUP BY 1
    """,
)
def popularity_regimes(t):
    items = t.lineitem.select("l_partkey", (uniform(22, "part", "l_orderkey") < 0.7).alias("is_train"))
    regimes = S.popularity_regime(items.where("is_train"), "l_partkey", 0.2, 0.7)
    test = items.where("not is_train").groupBy("l_partkey").agg(rows().alias("test_rows"))
    return test.join(regimes, "l_partkey", "left").groupBy(
        F.coalesce("regime", F.lit("cold")).alias("regime")
    ).agg(F.sum("test_rows").alias("test_rows"), rows().alias("items"))

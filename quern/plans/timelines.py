"""Ordered work per entity: prior features, series, sessions, chains, budgets."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quern.functions.draws import count_where, rows, uniform
from quern.operators import runlog as R
from quern.operators.ordered import micros, neighbour, running, strictly_prior, time_chunks
from quern.operators.scans import affine_scan
from quern.plans.joins import MONEY
from quern.plans.registry import query, u_sql
from quern.session import materialise

L = F.lit


def log(t):
    return t.events.select("event_id", "user_id", "event_type", "value", "ts", micros("ts").alias("us"))


@query(
    "w03_strictly_prior",
    """
    WITH e AS (SELECT event_id, user_id, epoch_us(date_trunc('hour', ts)) AS h, value::DECIMAL(18,2) AS v FROM events)
    SELECT event_id, user_id, count(*) OVER w AS prior_n, coalesce(sum(v) OVER w, 0)::DOUBLE AS prior_value
    FROM e WINDOW w AS (PARTITION BY user_id ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    """,
)
def w03(t):
    e = t.events.select("event_id", "user_id", micros(F.date_trunc("hour", "ts")).alias("h"), F.col("value").cast(MONEY).alias("v"))
    out = strictly_prior(e, ["user_id"], "h", {"prior_n": L(1), "prior_value": F.col("v")})
    return out.select("event_id", "user_id", "prior_n", F.col("prior_value").cast("double").alias("prior_value"))


DAILY_SQL = "daily AS (SELECT user_id, date_diff('day', TIMESTAMP '2024-01-01', ts) AS day, count(*) AS x FROM events GROUP BY 1, 2)"
DECAY = 0.5


def daily(t):
    """One row per user and day: bounded per user by the calendar."""
    return t.events.groupBy("user_id", F.datediff("ts", L("2024-01-01").cast("date")).cast("long").alias("day")).agg(rows().alias("x"))


def smoothed(d, keys, day, x, decay: float = DECAY):
    """``(keys, day, up)``: all earlier values, each weighted by ``decay`` per row that lies between."""
    return affine_scan(d, keys, day, L(decay), decay * F.col(x), out="up")


def baselines(t):
    w = Window.partitionBy("user_id").orderBy("day")
    d = materialise(daily(t))
    seen = d.select(
        "*", F.lag("x").over(w).alias("last_value"), F.max("x").over(w.rangeBetween(-7, -7)).alias("seasonal"),
        F.avg("x").over(w.rowsBetween(-3, -1)).alias("moving"), (F.row_number().over(w) - 1).alias("n"),
    )
    weight = 1 - F.pow(L(DECAY), "n")
    out = seen.join(smoothed(d, ["user_id"], "day", "x"), ["user_id", "day"])
    return out.withColumn("smoothed", F.when(F.col("n") > 0, F.col("up") / weight)).drop("n", "up")


BASELINES_SQL = f"""
    {DAILY_SQL}, b0 AS (SELECT *, lag(x) OVER w AS last_value, max(x) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN 7 PRECEDING AND 7 PRECEDING) AS seasonal,
      avg(x) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS moving, row_number() OVER w AS k FROM daily WINDOW w AS (PARTITION BY user_id ORDER BY day)),
    states AS (SELECT user_id, k, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down FROM b0 WHERE k = 1
      UNION ALL SELECT b0.user_id, b0.k + 1, {DECAY} * up + {1 - DECAY} * x, {DECAY} * down + {1 - DECAY} FROM states s JOIN b0 ON b0.user_id = s.user_id AND b0.k = s.k),
    base AS (SELECT b0.user_id, day, x, last_value, seasonal, moving, CASE WHEN b0.k > 1 THEN up / down END AS smoothed FROM b0 JOIN states s ON s.user_id = b0.user_id AND s.k = b0.k)
"""


@query(
    "w04_series_baselines",
    f"WITH RECURSIVE {BASELINES_SQL} SELECT user_id, day, x, last_value::DOUBLE AS last_value, seasonal::DOUBLE AS seasonal, round(moving, 9) AS moving, round(smoothed, 9) AS smoothed FROM base",
)
def w04(t):
    return baselines(t).select(
        "user_id", "day", "x", F.col("last_value").cast("double").alias("last_value"), F.col("seasonal").cast("double").alias("seasonal"),
        F.round("moving", 9).alias("moving"), F.round("smoothed", 9).alias("smoothed"),
    )


@query(
    "b03_series_baseline_scores",
    f"""
    WITH RECURSIVE {BASELINES_SQL}, u AS (SELECT name, x, p FROM (SELECT x, last_value::DOUBLE AS last_value, seasonal::DOUBLE AS seasonal, moving, smoothed FROM base WHERE day >= 20) UNPIVOT (p FOR name IN (last_value, seasonal, moving, smoothed)))
    SELECT name, count(*) AS n, round(avg(abs(x - p)), 8) AS mae, round(sqrt(avg((x - p) ** 2)), 8) AS rmse FROM u GROUP BY 1
    """,
)
def b03(t):
    names = ["last_value", "seasonal", "moving", "smoothed"]
    held = baselines(t).where("day >= 20").select("x", *[F.col(c).cast("double").alias(c) for c in names])
    long = held.unpivot(["x"], names, "name", "p").where("p is not null")
    d = F.col("x") - F.col("p")
    return long.groupBy("name").agg(rows().alias("n"), F.round(F.avg(F.abs(d)), 8).alias("mae"), F.round(F.sqrt(F.avg(d * d)), 8).alias("rmse"))


@query(
    "w05_markov_transitions",
    """
    WITH p AS (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
    c AS (SELECT prev, event_type, count(*) AS n FROM p WHERE prev IS NOT NULL GROUP BY 1, 2)
    SELECT prev, event_type, n, round(n / sum(n) OVER (PARTITION BY prev), 9) AS share FROM c
    """,
)
def w05(t):
    near = neighbour(log(t), ["user_id"], ["us", "event_id"], ["event_type"])
    return R.markov(near.withColumnRenamed("prev_event_type", "prev"), "prev", "event_type").withColumn("share", F.round("share", 9))


@query(
    "b03_sequence_baseline_scores",
    """
    WITH p AS (SELECT ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
    c AS (SELECT prev, event_type, count(*) AS n FROM p WHERE prev IS NOT NULL AND ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2),
    m AS (SELECT prev, arg_max(event_type, (n, event_type)) AS guess FROM c GROUP BY 1)
    SELECT count(*) AS n, round(avg((p.prev = p.event_type)::INT), 9) AS previous_class, round(avg((m.guess = p.event_type)::INT), 9) AS markov FROM p JOIN m USING (prev) WHERE ts >= TIMESTAMP '2024-01-20'
    """,
)
def b03_sequence(t):
    near = neighbour(log(t), ["user_id"], ["us", "event_id"], ["event_type"]).withColumnRenamed("prev_event_type", "prev")
    cut = F.col("ts") < L("2024-01-20").cast("timestamp_ntz")
    learned = R.markov(near.where(cut), "prev", "event_type")
    guess = learned.groupBy("prev").agg(F.max_by("event_type", F.struct("n", "event_type")).alias("guess"))
    test = near.where(~cut & F.col("prev").isNotNull()).join(guess, "prev")
    hit = lambda c: F.round(F.avg((F.col(c) == F.col("event_type")).cast("int")), 9)
    return test.agg(rows().alias("n"), hit("prev").alias("previous_class"), hit("guess").alias("markov"))


@query(
    "w06_budgeted_history",
    """
    WITH m AS (SELECT *, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations),
    g AS (SELECT *, sum((pos > 2 AND role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS grp FROM m),
    b AS (SELECT conv_id, sum(size) AS base FROM g WHERE pos <= 2 GROUP BY 1),
    gs AS (SELECT conv_id, grp, sum(size) AS gsize FROM g WHERE pos > 2 GROUP BY 1, 2),
    k AS (SELECT conv_id, grp, row_number() OVER w = 1 OR base + sum(gsize) OVER w <= 2000 AS keep FROM gs JOIN b USING (conv_id) WINDOW w AS (PARTITION BY conv_id ORDER BY grp DESC))
    SELECT conv_id, turn, pos <= 2 OR coalesce(keep, false) AS kept FROM g LEFT JOIN k USING (conv_id, grp)
    """,
)
def w06(t):
    kept = R.budgeted_history(t.conversations, "conv_id", "turn", "role", F.length("text"), 2000)
    return kept.select("conv_id", "turn", "kept")


@query(
    "w07_best_so_far",
    """
    SELECT event_id, user_id, max(value) OVER w AS best_so_far, greatest(0, 10 - count(*) FILTER (event_type = 'purchase') OVER w)::BIGINT AS left_over
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    """,
)
def w07(t):
    used = F.when(F.col("event_type") == "purchase", 1).otherwise(0)
    out = running(log(t), ["user_id"], ["us", "event_id"], {"best_so_far": ("max", F.col("value")), "used": ("sum", used)})
    return out.select("event_id", "user_id", "best_so_far", F.greatest(L(0), L(10) - F.col("used")).cast("long").alias("left_over"))


@query(
    "w08_last_events",
    """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
    SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_id) AS history FROM r WHERE rn <= 5 GROUP BY 1
    """,
)
def w08(t):
    """Spark keeps the last five per user before the shuffle, so lists are bounded."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    last = t.events.withColumn("rn", F.row_number().over(newest)).where("rn <= 5")
    steps = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return last.groupBy("user_id").agg(F.array_join(F.transform(steps, lambda s: s["event_type"]), ">").alias("history"))


SESSIONS_SQL = """
    d AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 21600000000, true) AS opens FROM events),
    s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM d)
"""


@query(
    "w10_sessions",
    f"WITH {SESSIONS_SQL} SELECT user_id, session::BIGINT AS session, count(*) AS n, max(epoch_us(ts)) - min(epoch_us(ts)) AS span FROM s GROUP BY 1, 2",
)
def w10(t):
    marked = R.sessions(log(t), ["user_id"], ["us", "event_id"], 6 * 3600 * 1_000_000)
    return marked.groupBy("user_id", F.col("session").cast("long").alias("session")).agg(rows().alias("n"), (F.max("us") - F.min("us")).alias("span"))


@query(
    "w11_retry_chains",
    """
    WITH g AS (SELECT *, count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS chain, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events),
    a AS (SELECT *, row_number() OVER (PARTITION BY user_id, chain ORDER BY ts, event_id) AS attempt FROM g WHERE event_type = 'error')
    SELECT event_id, user_id, attempt, attempt % 4 = 0 AS paused, round((epoch_us(nxt) - epoch_us(ts)) / 1e6, 6) AS delay_seconds FROM a
    """,
)
def w11(t):
    cuts = time_chunks(log(t), "us")
    ahead = neighbour(log(t), ["user_id"], ["us", "event_id"], ["us"], cuts, ahead=True)
    chains = R.retry_chains(ahead, ["user_id"], ["us", "event_id"], F.col("event_type") == "error", cuts)
    delay = F.round((F.col("next_us") - F.col("us")) / 1e6, 6)
    return chains.select("event_id", "user_id", F.col("attempt").cast("long").alias("attempt"), "paused", delay.alias("delay_seconds"))


@query(
    "w12_call_result_pairs",
    """
    WITH n AS (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
    SELECT CASE WHEN nxt IN ('view', 'purchase') THEN 'answered' WHEN nxt IS NULL THEN 'open' ELSE 'interrupted' END AS outcome, count(*) AS n FROM n WHERE event_type = 'click' GROUP BY 1
    """,
)
def w12(t):
    ahead = neighbour(log(t), ["user_id"], ["us", "event_id"], ["event_type"], ahead=True).where("event_type = 'click'")
    nxt = F.col("next_event_type")
    outcome = F.when(nxt.isin("view", "purchase"), "answered").when(nxt.isNull(), "open").otherwise("interrupted")
    return ahead.groupBy(outcome.alias("outcome")).agg(rows().alias("n"))


STAGES_SQL = """
    st AS (SELECT user_id, event_id // 50 AS attempt, min(ts) FILTER (event_type = 'click') AS queued, min(ts) FILTER (event_type = 'view') AS acquired, max(ts) FILTER (event_type = 'purchase') AS released FROM events GROUP BY 1, 2)
"""


def stages(t):
    at = lambda kind: F.when(F.col("event_type") == kind, F.col("us"))
    return log(t).groupBy("user_id", F.expr("event_id div 50").alias("attempt")).agg(
        F.min(at("click")).alias("queued"), F.min(at("view")).alias("acquired"), F.max(at("purchase")).alias("released")
    )


@query(
    "w13_queue_wait",
    f"""
    WITH {STAGES_SQL} SELECT user_id, count(*) FILTER (queued <= acquired) AS waits, coalesce(sum(epoch_us(acquired) - epoch_us(queued)) FILTER (queued <= acquired), 0)::BIGINT AS wait_us,
      coalesce(sum(epoch_us(released) - epoch_us(acquired)) FILTER (acquired <= released), 0)::BIGINT AS busy_us FROM st GROUP BY 1
    """,
)
def w13(t):
    waits, busy = F.col("queued") <= F.col("acquired"), F.col("acquired") <= F.col("released")
    return stages(t).groupBy("user_id").agg(
        count_where(waits).alias("waits"), F.coalesce(F.sum(F.when(waits, F.col("acquired") - F.col("queued"))), L(0)).alias("wait_us"),
        F.coalesce(F.sum(F.when(busy, F.col("released") - F.col("acquired"))), L(0)).alias("busy_us"),
    )


@query(
    "w13_concurrency",
    f"""
    WITH {STAGES_SQL}, d AS (SELECT t, sum(d) AS d FROM (SELECT epoch_us(acquired) AS t, 1 AS d FROM st WHERE acquired < released UNION ALL SELECT epoch_us(released), -1 FROM st WHERE acquired < released) GROUP BY 1),
    r AS (SELECT t, sum(d) OVER (ORDER BY t) AS busy FROM d)
    SELECT busy::BIGINT AS busy, count(*) AS instants FROM r GROUP BY 1
    """,
)
def w13_concurrency(t):
    held = stages(t).where("acquired < released")
    return R.concurrency(held, "acquired", "released").groupBy(F.col("busy").cast("long").alias("busy")).agg(rows().alias("instants"))


@query(
    "w14_calibration_bins",
    f"""
    WITH x AS (SELECT quality AS y, {u_sql(81, 'prob', 'doc_id')} AS p FROM labels)
    SELECT least(floor(p * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg(p), 9) AS mean_p, round(avg(y), 9) AS mean_y FROM x GROUP BY 1
    """,
)
def w14(t):
    x = t.labels.select(F.col("quality").alias("y"), uniform(81, "prob", "doc_id").alias("p"))
    return x.groupBy(F.least(F.floor(F.col("p") * 10), L(9)).cast("long").alias("bin")).agg(
        rows().alias("n"), F.round(F.avg("p"), 9).alias("mean_p"), F.round(F.avg("y"), 9).alias("mean_y")
    )


@query(
    "w15_equal_time_groups",
    "SELECT n AS group_size, count(*) AS groups, sum(n)::BIGINT AS rows_in, count(*) FILTER (n > 1) AS ambiguous FROM (SELECT o_custkey, date_trunc('month', o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1",
)
def w15(t):
    ties = t.orders.groupBy("o_custkey", F.date_trunc("month", "o_orderdate").alias("m")).agg(rows().alias("n"))
    return ties.groupBy(F.col("n").alias("group_size")).agg(rows().alias("groups"), F.sum("n").alias("rows_in"), count_where("n > 1").alias("ambiguous"))


@query(
    "b12_later_row_recovery",
    """
    WITH c AS (SELECT *, (value * 100)::BIGINT AS cents FROM events),
    s AS (SELECT *, sum(cents) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS balance FROM c),
    n AS (SELECT *, lead(balance) OVER (PARTITION BY user_id ORDER BY ts, event_id) - balance AS guess, lead(cents) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS hidden FROM s)
    SELECT count(*) AS n, count(*) FILTER (guess = hidden) AS recovered, max(abs(guess - hidden))::BIGINT AS worst FROM n WHERE hidden IS NOT NULL
    """,
)
def b12(t):
    """Differencing published running balances gives the hidden amounts back."""
    c = log(t).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    order = ["us", "event_id"]
    cuts = time_chunks(c, "us")
    s = running(c, ["user_id"], order, {"balance": ("sum", F.col("cents"))}, cuts)
    n = neighbour(s, ["user_id"], order, ["balance", "cents"], cuts, ahead=True).where("next_cents is not null")
    guess = F.col("next_balance") - F.col("balance")
    return n.agg(rows().alias("n"), count_where(guess == F.col("next_cents")).alias("recovered"), F.max(F.abs(guess - F.col("next_cents"))).alias("worst"))

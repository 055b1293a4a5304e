"""Panels, run logs, cells, fingerprints and other grouped reports."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quern.functions.multiset import fingerprint, fingerprint_sql
from quern.functions.draws import count_where, rows, uniform
from quern.operators import compose as C, panel as N
from quern.operators.metrics import better
from quern.operators.ordered import micros
from quern.operators.ranks import exact_median
from quern.plans.joins import MONEY
from quern.plans.panel_frame import PANEL_SQL, panel_of
from quern.plans.registry import query, u_sql
from quern.plans.splits import EXACT_SQL, sized

L = F.lit


@query("a06_global_median", "SELECT median(o_totalprice) AS med, count(*) AS n FROM orders")
def a06(t):
    med = exact_median(t.orders, "o_totalprice", out="med")
    return med.withColumn("n", t.orders.agg(rows()).scalar())


@query(
    "a07_key_uniqueness",
    f"""
    WITH {EXACT_SQL} SELECT count(*) AS n, count(DISTINCT o_orderkey) = count(*) AS unique_keys, count(*) FILTER (is_test) + count(*) FILTER (NOT is_test) = count(*) AS sums_up FROM sized
    """,
)
def a07(t):
    per_key = sized(t).groupBy("o_orderkey").agg(rows().alias("n"), count_where("is_test").alias("te"), count_where("not is_test").alias("tr"))
    return per_key.agg(
        F.sum("n").alias("n"), (F.max("n") == 1).alias("unique_keys"), (F.sum("te") + F.sum("tr") == F.sum("n")).alias("sums_up")
    )


@query(
    "a09_best_of_runs",
    f"""
    WITH {PANEL_SQL}, b AS (SELECT task, variant, profile, max(score) AS best, count(score) AS scored FROM panel GROUP BY 1, 2, 3)
    SELECT b.*, scored || '/5' AS scored_text FROM b
    """,
)
def a09(t):
    return N.cell_best(panel_of(t.events), ["task", "variant", "profile"], lower=False)


@query(
    "a09_first_best_attempt",
    """
    WITH s AS (SELECT user_id, event_type, event_id, round(value) AS score FROM events),
    b AS (SELECT user_id, event_type, min(score) AS score FROM s GROUP BY 1, 2)
    SELECT s.user_id, s.event_type, min(event_id) AS attempt, any_value(s.score) AS best FROM s JOIN b USING (user_id, event_type, score) GROUP BY 1, 2
    """,
)
def a09_first(t):
    score = F.round("value", 0)
    return t.events.groupBy("user_id", "event_type").agg(
        N.best_attempt(score, F.col("event_id"), lower=True).alias("attempt"), N.best_score(score, True).alias("best")
    )


GAP_SQL = f"""
    {PANEL_SQL}, g AS (SELECT task, max(score) FILTER (variant = 'before' AND profile = 'strong') - max(score) FILTER (variant = 'before' AND profile = 'weak') AS gap_before,
      max(score) FILTER (variant = 'after' AND profile = 'strong') - max(score) FILTER (variant = 'after' AND profile = 'weak') AS gap_after FROM panel GROUP BY 1)
"""


@query("a10_before_after_gap", f"WITH {GAP_SQL} SELECT task, round(gap_before, 9) AS gap_before, round(gap_after, 9) AS gap_after, gap_after > gap_before AS widened FROM g")
def a10(t):
    gaps = N.profile_gap(panel_of(t.events), "weak", "strong", lower=False)
    return gaps.withColumns({c: F.round(c, 9) for c in ("gap_before", "gap_after")})


@query("a11_scored_runs", f"WITH {PANEL_SQL} SELECT profile, variant, count(*) AS runs, count(score) AS scored, count(*) FILTER (starts_with(state, 'fail:')) AS failed FROM panel GROUP BY 1, 2")
def a11(t):
    return panel_of(t.events).groupBy("profile", "variant").agg(
        rows().alias("runs"), F.count("score").alias("scored"), count_where("startswith(state, 'fail:')").alias("failed")
    )


@query(
    "a12_mean_std_rates",
    f"""
    WITH {PANEL_SQL} SELECT task, profile, round(sum(score::DECIMAL(18,2))::DOUBLE / nullif(count(score), 0), 9) AS mean, round(stddev_samp(score), 6) AS std, round(avg((coalesce(score, -1) >= 50)::INT), 9) AS pass_rate, round(avg(starts_with(state, 'fail:')::INT), 9) AS fail_rate FROM panel GROUP BY 1, 2
    """,
)
def a12(t):
    return panel_of(t.events).groupBy("task", "profile").agg(
        F.round(mean_score(), 9).alias("mean"), F.round(F.stddev_samp("score"), 6).alias("std"),
        F.round(F.avg((F.coalesce("score", L(-1.0)) >= 50).cast("int")), 9).alias("pass_rate"),
        F.round(F.avg(F.startswith("state", L("fail:")).cast("int")), 9).alias("fail_rate"),
    )


TRIO_SQL = f"""
    {PANEL_SQL}, trio AS (SELECT task, max(score) FILTER (profile = 'weak') AS weak, max(score) FILTER (profile = 'strong') AS strong, count(*) FILTER (profile = 'weak' AND score >= 60) AS clears,
      sum(score::DECIMAL(18,2))::DOUBLE / nullif(count(score), 0) * 3 AS gold FROM panel GROUP BY 1)
"""


def mean_score():
    """Mean through an exact decimal sum, so that it does not depend on task order."""
    return F.try_divide(F.sum(F.col("score").cast(MONEY)).cast("double"), F.count("score"))


def trio(t):
    weak, strong = F.col("profile") == "weak", F.col("profile") == "strong"
    return panel_of(t.events).groupBy("task").agg(
        F.max(F.when(weak, F.col("score"))).alias("weak"), F.max(F.when(strong, F.col("score"))).alias("strong"),
        count_where(weak & (F.col("score") >= 60)).alias("clears"), (mean_score() * 3).alias("gold"),
    )


@query(
    "a13_spread_objective",
    f"WITH {TRIO_SQL} SELECT task, round((strong - weak) + 0.5 * (gold - weak) - 2 * greatest(0, strong - gold - 0.1 * abs(gold)) - 1 * CASE WHEN strong < 20 THEN 1 ELSE 0 END, 9) AS spread FROM trio",
)
def a13(t):
    collapse = F.when(F.col("strong") < 20, 1).otherwise(0)
    value = N.spread_objective(F.col("weak"), F.col("strong"), F.col("gold"), collapse, (1.0, 0.5, 2.0, 1.0))
    return trio(t).select("task", F.round(value, 9).alias("spread"))


@query(
    "a14_calibration_verdicts",
    f"""
    WITH {TRIO_SQL} SELECT task, CASE WHEN weak > gold THEN 'weak_beats_gold' WHEN clears >= 9 THEN 'weak_clears_band' WHEN weak >= 120 AND strong >= 120 THEN 'not_hardened' WHEN weak <= 40 AND strong <= 40 THEN 'too_destructive'
      WHEN strong > gold + 0.1 * abs(gold) THEN 'gold_outdated' WHEN abs(strong - gold) <= 0.1 * abs(gold) THEN 'accept' ELSE 'strong_below_gold' END AS verdict FROM trio
    """,
)
def a14(t):
    x = trio(t)
    verdict = N.calibration_verdict(F.col("weak"), F.col("strong"), F.col("gold"), F.col("clears"), L(40.0), L(120.0), limit=9)
    return x.select("task", verdict.alias("verdict"))


@query(
    "a15_macro_over_cells",
    """
    WITH c AS (SELECT l_returnflag, l_linestatus, count(*) AS n, avg(l_quantity) AS m FROM lineitem GROUP BY 1, 2)
    SELECT count(*) AS cells, min(n) AS least_support, round(avg(m), 9) AS macro FROM c
    """,
)
def a15(t):
    """Fixed cells; a vanished cell fails the job instead of shrinking the average."""
    cells = [(a, b) for a in ("A", "N", "R") for b in ("F", "O")]
    fixed = F.explode(F.array(*[F.struct(L(a).alias("l_returnflag"), L(b).alias("l_linestatus")) for a, b in cells]))
    dim = t.spark.range(1).select(fixed.alias("c")).select("c.*")
    found = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(rows().alias("n"), F.avg("l_quantity").alias("m"))
    joined = dim.join(found, ["l_returnflag", "l_linestatus"], "left")
    gone = F.when(F.col("n").isNull(), F.raise_error(L("a scoring cell has no rows")).cast("double"))
    return joined.agg(
        rows().alias("cells"), F.min("n").alias("least_support"), F.round(F.avg(F.coalesce(gone, F.col("m"))), 9).alias("macro")
    )


@query(
    "a16_slice_and_total",
    """
    SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, grouping_id(l_returnflag, l_linestatus)::BIGINT AS level, count(*) AS n, sum(l_quantity)::BIGINT AS quantity
    FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)
    """,
)
def a16(t):
    cube = t.lineitem.cube("l_returnflag", "l_linestatus").agg(
        F.grouping_id().cast("long").alias("level"), rows().alias("n"), F.sum("l_quantity").cast("long").alias("quantity")
    )
    return cube.select(
        F.coalesce("l_returnflag", L("*")).alias("flag"), F.coalesce("l_linestatus", L("*")).alias("status"), "level", "n", "quantity"
    )


@query(
    "a18_difficulty_band",
    f"""
    WITH {PANEL_SQL}, m AS (SELECT task, count(score) AS ok, count(*) AS n, median((last_us - first_us) / 60e6 / 100) FILTER (score IS NOT NULL) AS med FROM panel GROUP BY 1)
    SELECT task, ok, round(ok / n, 9) AS success_rate, CASE WHEN ok >= 3 THEN round(med, 6) END AS median_minutes,
      CASE WHEN ok < 3 THEN 'unresolved' ELSE (CASE WHEN med < 1 THEN 0 WHEN med <= 60 THEN 1 WHEN med <= 120 THEN 2 WHEN med <= 180 THEN 3 WHEN med <= 240 THEN 4 ELSE 5 END)::VARCHAR END AS band,
      coalesce(ok >= 3 AND med > 300, false) AS above_nominal_range FROM m
    """,
)
def a18(t):
    runs = panel_of(t.events).withColumn("minutes", (F.col("last_us") - F.col("first_us")) / 60e6 / 100)
    counts = runs.groupBy("task").agg(F.count("score").alias("ok"), rows().alias("n"))
    med = exact_median(runs.where("score is not null"), "minutes", ["task"], "med")
    enough = F.col("ok") >= 3
    return counts.join(med, "task", "left").select(
        "task", "ok", F.round(F.col("ok") / F.col("n"), 9).alias("success_rate"),
        F.when(enough, F.round("med", 6)).alias("median_minutes"),
        F.when(~enough, "unresolved").otherwise(N.difficulty_band(F.col("med")).cast("string")).alias("band"),
        F.coalesce(enough & (F.col("med") > 300), L(False)).alias("above_nominal_range"),
    )


@query(
    "a20_wide_run_columns",
    f"""
    WITH {PANEL_SQL} SELECT task, variant, profile, {', '.join(f"max(CASE WHEN run = {r} THEN coalesce(printf('%.5f', score), state) END) AS run{r}" for r in range(1, 6))} FROM panel GROUP BY 1, 2, 3
    """,
)
def a20(t):
    shown = F.coalesce(F.when(F.col("score").isNotNull(), F.format_string("%.5f", F.col("score"))), F.col("state"))
    return N.wide_runs(panel_of(t.events), ["task", "variant", "profile"], shown)


@query(
    "a21_score_list_cells",
    f"""
    WITH {PANEL_SQL} SELECT task, variant, profile, coalesce(string_agg(printf('%.5f', score), ' ; ' ORDER BY run), 'archived') AS scores FROM panel GROUP BY 1, 2, 3
    """,
)
def a21(t):
    return N.score_cell(panel_of(t.events), ["task", "variant", "profile"], L("archived"))


@query(
    "s07_archived_cells",
    f"""
    WITH {PANEL_SQL}, c AS (SELECT task, variant, 'best ' || max(run) || ' | runs: ' || coalesce(string_agg(printf('%.3f', score), ' ; ' ORDER BY profile, run), '') || ' ; | note' AS cell FROM panel GROUP BY 1, 2),
    p AS (SELECT task, variant, list_filter(list_transform(string_split(trim(string_split(string_split(cell, 'runs:')[2], '|')[1]), ';'), lambda x: trim(x)), lambda x: x <> '') AS s FROM c)
    SELECT task, variant, len(s) AS n, array_to_string(s, ',') AS scores FROM p
    """,
)
def s07(t):
    """Archived cells written from the panel, then parsed back."""
    text = F.when(F.col("score").isNotNull(), F.format_string("%.3f", F.col("score")))
    slots = [(p, r) for p in ("strong", "weak") for r in N.RUNS]
    wide = panel_of(t.events).groupBy("task", "variant").agg(
        F.max("run").alias("m"),
        F.concat_ws(" ; ", *[F.max(F.when((F.col("profile") == p) & (F.col("run") == r), text)) for p, r in slots]).alias("body"),
    )
    cell = F.concat(L("best "), F.col("m").cast("string"), L(" | runs: "), F.col("body"), L(" ; | note"))
    parsed = wide.select("task", "variant", N.archived_scores(cell).alias("s"))
    return parsed.select("task", "variant", F.size("s").cast("long").alias("n"), F.array_join("s", ",").alias("scores"))


FINGER_SQL = fingerprint_sql(
    "o_orderkey::VARCHAR", "o_custkey::VARCHAR", "o_orderstatus", "o_totalprice::DECIMAL(18,2)::VARCHAR", "strftime(o_orderdate, '%Y-%m-%d')", "o_orderpriority",
)


def content(orders):
    text = ["o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast(MONEY), F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderpriority"]
    return orders.agg(fingerprint(*text).alias("fingerprint"), rows().alias("n"))


@query("a22_content_fingerprint", f"SELECT {FINGER_SQL} AS fingerprint, count(*) AS n, true AS rebuild_agrees FROM orders")
def a22(t):
    """The rebuild joins the two extracts again; row order and files do not matter."""
    profile, commercial = C.cut_extracts(t.orders, "o_orderkey", "o_totalprice", [])
    again = content(profile.join(commercial, "o_orderkey")).select("fingerprint").scalar()
    return content(t.orders).withColumn("rebuild_agrees", F.col("fingerprint") == again)


@query("a23_cell_support", "SELECT p_brand, p_type, count(*) AS n, count(*) < 15 AS below_support FROM part GROUP BY 1, 2")
def a23(t):
    return t.part.groupBy("p_brand", "p_type").agg(rows().alias("n"), (rows() < 15).alias("below_support"))


@query("a24_rare_combinations", "SELECT c_nationkey::BIGINT AS nation, c_mktsegment, floor(c_acctbal / 1000)::BIGINT AS balance, count(*) AS n FROM customer GROUP BY 1, 2, 3 HAVING count(*) < 10")
def a24(t):
    cell = [F.col("c_nationkey").cast("long").alias("nation"), "c_mktsegment", F.floor(F.col("c_acctbal") / 1000).alias("balance")]
    return t.customer.groupBy(*cell).agg(rows().alias("n")).where("n < 10")


@query(
    "a24_unique_trajectories",
    f"""
    WITH d AS (SELECT user_id, {fingerprint_sql("epoch_us(ts)::VARCHAR", "event_type")} AS shape, count(*) AS steps
      FROM (SELECT DISTINCT user_id, date_trunc('day', ts) AS ts, event_type FROM events) GROUP BY 1)
    SELECT users, count(*) AS trajectories, sum(steps)::BIGINT AS steps FROM (SELECT shape, count(*) AS users, sum(steps) AS steps FROM d GROUP BY 1) GROUP BY 1
    """,
)
def a24_trajectories(t):
    """A trajectory is fingerprinted by a sum of step hashes; no history is gathered."""
    steps = t.events.select("user_id", F.date_trunc("day", "ts").alias("d"), "event_type").distinct()
    shapes = steps.groupBy("user_id").agg(fingerprint(micros("d"), "event_type").alias("shape"), rows().alias("steps"))
    return shapes.groupBy("shape").agg(rows().alias("users"), F.sum("steps").alias("steps")).groupBy("users").agg(
        rows().alias("trajectories"), F.sum("steps").alias("steps")
    )


@query(
    "a25_duplicate_keys",
    f"""
    WITH c AS (SELECT CASE WHEN {u_sql(71, 'blank', 'conv_id', 'turn')} < 0.05 THEN ' ' ELSE conv_id || '-' || role END AS k FROM conversations),
    g AS (SELECT k, count(*) AS n FROM c GROUP BY 1)
    SELECT sum(n)::BIGINT AS total, sum(n) FILTER (trim(k) = '')::BIGINT AS blank_keys, count(*) FILTER (trim(k) <> '') AS distinct_keys, count(*) FILTER (trim(k) <> '' AND n > 1) AS duplicate_keys FROM g
    """,
)
def a25(t):
    key = F.when(uniform(71, "blank", "conv_id", "turn") < 0.05, " ").otherwise(F.concat_ws("-", "conv_id", "role"))
    g = t.conversations.groupBy(key.alias("k")).agg(rows().alias("n"))
    blank = F.col("k").rlike(r"^(?U)\s*$")
    return g.agg(
        F.sum("n").alias("total"), F.sum(F.when(blank, F.col("n"))).alias("blank_keys"),
        count_where(~blank).alias("distinct_keys"), count_where(~blank & (F.col("n") > 1)).alias("duplicate_keys"),
    )


@query(
    "a26_run_log_summary",
    """
    SELECT user_id AS run, count(*) AS events, arg_max(event_type, (ts, event_id)) AS last_type, count(*) FILTER (event_type = 'click') AS turns, count(*) FILTER (event_type = 'error') AS errors,
      sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS usage FROM events GROUP BY 1
    """,
)
def a26(t):
    return t.events.groupBy(F.col("user_id").alias("run")).agg(
        rows().alias("events"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), count_where("event_type = 'click'").alias("turns"),
        count_where("event_type = 'error'").alias("errors"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("usage"),
    )


@query(
    "a27_hierarchy_totals",
    """
    WITH child AS (SELECT o_custkey, o_orderstatus, sum(o_totalprice::DECIMAL(18,2)) AS s FROM orders GROUP BY 1, 2),
    parent AS (SELECT o_custkey, sum(o_totalprice::DECIMAL(18,2)) + CASE WHEN o_custkey % 10 = 0 THEN 1 ELSE 0 END AS total FROM orders GROUP BY 1)
    SELECT p.o_custkey, p.total::DOUBLE AS total, abs(sum(c.s) - p.total) <= 0.005 AS coherent FROM parent p JOIN child c USING (o_custkey) GROUP BY p.o_custkey, p.total
    """,
)
def a27(t):
    """Declared parent totals (every tenth one off) against the sum of their children."""
    price = F.sum(F.col("o_totalprice").cast(MONEY))
    parent = t.orders.groupBy("o_custkey").agg((price + F.when(F.col("o_custkey") % 10 == 0, 1).otherwise(0)).alias("total"))
    child = t.orders.groupBy("o_custkey", "o_orderstatus").agg(price.alias("s")).groupBy("o_custkey").agg(F.sum("s").alias("s"))
    return parent.join(child, "o_custkey").select(
        "o_custkey", F.col("total").cast("double").alias("total"), (F.abs(F.col("s") - F.col("total")) <= 0.005).alias("coherent")
    )


@query(
    "a28_robust_normaliser",
    f"""
    WITH s AS (SELECT l_returnflag, l_quantity, {u_sql(72, 'part', 'l_orderkey')} < 0.7 AS is_train FROM lineitem),
    f AS (SELECT l_returnflag, least(greatest(median(l_quantity), 5), 40) AS scale FROM s WHERE is_train GROUP BY 1)
    SELECT l_returnflag, scale, count(*) AS n, round(avg(l_quantity / scale), 9) AS mean_scaled FROM s JOIN f USING (l_returnflag) WHERE NOT is_train GROUP BY 1, 2
    """,
)
def a28(t):
    s = t.lineitem.select("l_returnflag", "l_quantity", (uniform(72, "part", "l_orderkey") < 0.7).alias("is_train"))
    med = exact_median(s.where("is_train"), "l_quantity", ["l_returnflag"], "m")
    fit = med.select("l_returnflag", F.least(F.greatest("m", L(5.0)), L(40.0)).alias("scale"))
    test = s.where("not is_train").groupBy("l_returnflag", "l_quantity").agg(rows().alias("n"))
    return test.join(fit, "l_returnflag").groupBy("l_returnflag", "scale").agg(
        F.sum("n").alias("n"), F.round(F.sum(F.col("l_quantity") * F.col("n")) / F.max("scale") / F.sum("n"), 9).alias("mean_scaled")
    ).select("l_returnflag", "scale", "n", "mean_scaled")


@query(
    "a30_promotion_verdict",
    f"""
    WITH {PANEL_SQL}, w AS (SELECT task, max(score) FILTER (profile = 'strong' AND variant = 'after') AS candidate, max(score) FILTER (profile = 'weak' AND variant = 'after') AS challenger,
      max(score) FILTER (variant = 'before') AS incumbent, max(score) FILTER (profile = 'strong' AND variant = 'after' AND run <= 3) AS cold FROM panel GROUP BY 1)
    SELECT task, CASE WHEN candidate IS NULL OR challenger IS NULL OR incumbent IS NULL THEN 'incomplete' WHEN abs(candidate - cold) > 1e-9 OR cold IS NULL THEN 'not_reproducible'
      WHEN candidate >= challenger AND candidate > incumbent THEN 'promoted' ELSE 'kept' END AS verdict FROM w
    """,
)
def a30(t):
    after, strong = F.col("variant") == "after", F.col("profile") == "strong"
    top = lambda cond: F.max(F.when(cond, F.col("score")))
    w = panel_of(t.events).groupBy("task").agg(
        top(strong & after).alias("a"), top(~strong & after).alias("b"), top(~after).alias("c"), top(strong & after & (F.col("run") <= 3)).alias("d")
    )
    a, b, c, d = map(F.col, "abcd")
    wins = better(a, b, L(False), strict=False) & better(a, c, L(False), strict=True)
    verdict = F.when(a.isNull() | b.isNull() | c.isNull(), "incomplete").when(d.isNull() | (F.abs(a - d) > 1e-9), "not_reproducible").when(wins, "promoted")
    return w.select("task", verdict.otherwise("kept").alias("verdict"))


@query(
    "a31_ladder_record",
    """
    WITH r AS (SELECT event_type AS role, CASE WHEN event_id % 3 = 0 THEN 'warm' ELSE 'cold' END AS state, value, json_extract(props, '$.k')::BIGINT AS mem FROM events)
    SELECT role, state, count(*) AS runs, max(value) AS best_score, max(mem) AS peak_memory, sum(value::DECIMAL(18,2))::DOUBLE AS wall_time FROM r GROUP BY 1, 2
    """,
)
def a31(t):
    """Cold and warm runs stay in separate rows."""
    state = F.when(F.col("event_id") % 3 == 0, "warm").otherwise("cold")
    return t.events.groupBy(F.col("event_type").alias("role"), state.alias("state")).agg(
        rows().alias("runs"), F.max("value").alias("best_score"), F.max(F.get_json_object("props", "$.k").cast("long")).alias("peak_memory"),
        F.sum(F.col("value").cast(MONEY)).cast("double").alias("wall_time"),
    )


@query(
    "a32_group_coverage_gap",
    """
    WITH g AS (SELECT c_mktsegment, c_nationkey::BIGINT AS nation, count(*) AS n, avg((c_acctbal < 0)::INT) AS rate FROM customer GROUP BY 1, 2),
    a AS (SELECT avg((c_acctbal < 0)::INT) AS rate, count(*) AS n FROM customer)
    SELECT c_mktsegment, nation, g.n, round(g.n / a.n, 9) AS coverage, round(g.rate - a.rate, 9) AS gap FROM g, a WHERE g.n >= 12
    """,
)
def a32(t):
    low = (F.col("c_acctbal") < 0).cast("int")
    whole = t.customer.agg(F.struct(F.avg(low).alias("rate"), rows().alias("n"))).scalar()
    g = t.customer.groupBy("c_mktsegment", F.col("c_nationkey").cast("long").alias("nation")).agg(rows().alias("n"), F.avg(low).alias("r"))
    return g.where("n >= 12").select("c_mktsegment", "nation", "n", F.round(F.col("n") / whole["n"], 9).alias("coverage"), F.round(F.col("r") - whole["rate"], 9).alias("gap"))


def basket(t):
    return t.lineitem.select("l_orderkey", "l_partkey").join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")


@query(
    "u01_vertical_concat",
    "SELECT k, count(*) AS n FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer) GROUP BY 1",
)
def u01(t):
    both = t.orders.select(F.col("o_custkey").alias("k")).unionByName(t.customer.select(F.col("c_custkey").alias("k")))
    return both.groupBy("k").agg(rows().alias("n"))


@query("u02_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def u02(t):
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


@query(
    "u04_symmetric_difference",
    """
    WITH l AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), r AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT')
    SELECT k, 'left' AS side FROM l WHERE k NOT IN (SELECT k FROM r) UNION ALL SELECT k, 'right' FROM r WHERE k NOT IN (SELECT k FROM l)
    """,
)
def u04(t):
    k = F.col("o_custkey").alias("k")
    left, right = t.orders.where("o_orderstatus = 'F'").select(k), t.orders.where("o_orderpriority = '1-URGENT'").select(k)
    m = C.match_keys(left, right, "k").where("answer_rows = 0 or submission_rows = 0")
    return m.select("k", F.when(F.col("answer_rows") > 0, "left").otherwise("right").alias("side"))


@query(
    "u05_set_overlap",
    "SELECT conv_id, bool_or(role = 'system') AND bool_or(role = 'assistant') AS overlaps, count(DISTINCT role) AS roles FROM conversations GROUP BY 1",
)
def u05(t):
    """Option lists compared as arrays; a conversation has at most three roles."""
    g = t.conversations.groupBy("conv_id").agg(F.collect_set("role").alias("r"))
    both = F.arrays_overlap("r", F.array(L("system"))) & F.arrays_overlap("r", F.array(L("assistant")))
    return g.select("conv_id", both.alias("overlaps"), F.size("r").cast("long").alias("roles"))


@query("t01_sorted_keys", "SELECT o_orderkey, o_totalprice FROM orders")
def t01(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy("o_orderkey")


@query("t02_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def t02(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(100)


@query(
    "t03_first_offenders",
    """
    WITH o AS (SELECT role, conv_id || '/' || turn AS k FROM conversations WHERE length(text) < 200),
    r AS (SELECT role, k, row_number() OVER (PARTITION BY role ORDER BY k) AS rn, count(*) OVER (PARTITION BY role) AS n FROM o)
    SELECT role, string_agg(k, ', ' ORDER BY k) || CASE WHEN max(n) > 10 THEN ' (and ' || (max(n) - 10) || ' more)' ELSE '' END AS note FROM r WHERE rn <= 10 GROUP BY 1
    """,
)
def t03(t):
    """Ten smallest per rule are found first, so the gathered list is bounded."""
    bad = t.conversations.where(F.length("text") < 200).select("role", F.concat_ws("/", "conv_id", "turn").alias("k"))
    top = bad.withColumn("rn", F.row_number().over(Window.partitionBy("role").orderBy("k"))).where("rn <= 10")
    shown = top.groupBy("role").agg(F.array_join(F.array_sort(F.collect_list("k")), ", ").alias("s"))
    more = F.when(F.col("n") > 10, F.concat(L(" (and "), (F.col("n") - 10).cast("string"), L(" more)"))).otherwise("")
    return shown.join(bad.groupBy("role").agg(rows().alias("n")), "role").select("role", F.concat("s", more).alias("note"))


@query(
    "t04_presentation_order",
    "SELECT r_name, list_position(['EUROPE', 'ASIA', 'AMERICA', 'AFRICA', 'MIDDLE EAST'], r_name)::BIGINT AS place, count(*) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1",
)
def t04(t):
    order = F.array(*map(L, ["EUROPE", "ASIA", "AMERICA", "AFRICA", "MIDDLE EAST"]))
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(rows().alias("nations"))
    return n.select("r_name", F.array_position(order, F.col("r_name")).cast("long").alias("place"), "nations").orderBy("place")

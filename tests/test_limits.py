"""Inputs beyond earlier limits: nothing is cut or dropped without a word."""

import pytest
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import metrics, panel
from quern.sources import tables


def test_risk_outside_levels_stops(spark):
    rows = spark.createDataFrame([(1, 1, 0), (2, 1, 4), (3, 1, 8)], "time int, event int, risk int")
    assert metrics.concordance(rows, 5).first()["discordant"] == 3
    with pytest.raises(Exception, match="risk outside"):
        metrics.concordance(rows, 2).collect()


def test_run_outside_panel_stops(spark):
    rows = spark.createDataFrame([("a", r, float(r)) for r in range(1, 8)], "task string, run int, score double")
    with pytest.raises(Exception, match="run outside"):
        panel.wide_runs(rows, ["task"], F.col("score")).collect()
    assert panel.wide_runs(rows.where("run <= 5"), ["task"], F.col("score")).first()["run5"] == 5.0


def test_schema_sees_late_values(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n" + "1,x\n" * 12_000 + '1.5,"y\nz"\n')
    out = tables.scan_csv(spark, str(tmp_path / "t.csv"), multi_line=True)
    assert out.where("a = 1.5").collect()[0]["b"] == "y\nz" and out.count() == 12_001


def test_leftover_lines_stay_whole(spark):
    text = "- uses `a` and `b` " + "x" * 200
    done = spark.createDataFrame([(text,)], "t string").select(X.scrub_lines(F.col("t"), ["a"]).alias("s"), X.scrub_lines(F.col("t"), ["a"], shown=110).alias("c"))
    row = done.first()
    assert row.s.leftovers[0] == text.strip() and len(row.c.leftovers[0]) == 110

"""Audits over a file listing with ``pkg``, ``path`` and ``size`` columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quern.functions.draws import count_where
from quern.functions.text import ANSWER_NAME
from quern.operators.compose import path_prefixes

# Public files that are not data assets.
NOT_DATA = ["description.md", "sample_submission.csv"]
HIDDEN = "hidden-test/"


def hidden_mirror(files: DataFrame, declared: DataFrame) -> DataFrame:
    """One row per broken mirror rule: live path, replacement, or unlisted payload.

    A declared path may be a file or a folder; it exists when it is a prefix of
    some file, found by an equality join on exploded prefixes.
    """
    steps = files.select("pkg", "path", F.explode(path_prefixes(F.col("path"))).alias("step"))
    present = steps.select("pkg", F.col("step").alias("path")).distinct()
    live = declared.join(present, ["pkg", "path"], "left_anti").withColumn("error", F.lit("live_path_missing"))
    mirrored = present.where(F.startswith("path", F.lit(HIDDEN))).select("pkg", F.substr("path", F.lit(len(HIDDEN) + 1)).alias("path"))
    exists = declared.join(present, ["pkg", "path"], "left_semi")
    gone = exists.join(mirrored, ["pkg", "path"], "left_anti").withColumn("error", F.lit("replacement_missing"))
    payloads = files.where(F.startswith("path", F.lit(HIDDEN))).select("pkg", F.substr("path", F.lit(len(HIDDEN) + 1)).alias("path"))
    covered = (
        payloads.select("pkg", "path", F.explode(path_prefixes(F.col("path"))).alias("step"))
        .join(declared.select("pkg", F.col("path").alias("step")).distinct(), ["pkg", "step"], "left_semi")
        .select("pkg", "path").distinct()
    )
    extra = payloads.join(covered, ["pkg", "path"], "left_anti").withColumn("error", F.lit("unlisted_payload"))
    return live.unionByName(gone).unionByName(extra)


def public_assets(files: DataFrame) -> DataFrame:
    """Per package: missing sides or data, and answer-like public names as warnings."""
    name = F.substring_index("path", "/", -1)
    public = F.startswith("path", F.lit("public/"))
    asset = public & ~name.isin(NOT_DATA)
    g = files.groupBy("pkg").agg(
        F.max(public).alias("pub"), F.max(F.startswith("path", F.lit("private/"))).alias("prv"),
        count_where(asset).alias("assets"), count_where(asset & name.rlike(ANSWER_NAME)).alias("warnings"),
    )
    errors = F.concat_ws(
        ",", F.when(~F.col("pub"), "missing_public"), F.when(~F.col("prv"), "missing_private"),
        F.when(F.col("pub") & (F.col("assets") == 0), "no_data_assets"),
    )
    return g.select("pkg", errors.alias("errors"), "warnings")


def documented_assets(documented: DataFrame, present: DataFrame) -> DataFrame:
    """Documented but absent, present but undocumented, and matching paths per package."""
    sides = (
        documented.select("pkg", "path", F.lit(1).alias("d"), F.lit(0).alias("p"))
        .unionByName(present.select("pkg", "path", F.lit(0).alias("d"), F.lit(1).alias("p")))
        .groupBy("pkg", "path").agg(F.max("d").alias("d"), F.max("p").alias("p"))
    )
    return sides.groupBy("pkg").agg(
        count_where("d = 1 and p = 0").alias("documented_only"), count_where("d = 0 and p = 1").alias("undocumented"), count_where("d = 1 and p = 1").alias("both")
    )

"""All-or-nothing publication: versioned outputs, one manifest written last.

Readers look at the newest manifest only, so an output set is either visible as
a whole or not at all, on file systems and object stores alike.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

NAME = r"[A-Za-z0-9][A-Za-z0-9_.-]*"


def _clean(path: str) -> str:
    return path.rstrip("/")


def check_paths(inputs: Sequence[str], target: str) -> None:
    """Inputs are distinct, have distinct names and do not overlap the target."""
    paths = [_clean(p) for p in inputs]
    if len(set(paths)) != len(paths):
        raise ValueError("an input is given twice")
    names = [p.rsplit("/", 1)[-1] for p in paths]
    if len(set(names)) != len(names):
        raise ValueError("input names collide")
    goal = _clean(target)
    for p in paths:
        if p == goal or p.startswith(goal + "/") or goal.startswith(p + "/"):
            raise ValueError(f"input and output overlap: {p}")


def manifests(spark: SparkSession, target: str) -> DataFrame | None:
    try:
        schema = "version string, seq long, outputs map<string,string>, details string"
        return spark.read.schema(schema).json(f"{_clean(target)}/manifests/*")
    except Exception as exc:
        if "PATH_NOT_FOUND" in str(exc):
            return None
        raise


def publish(
    spark: SparkSession, outputs: Mapping[str, DataFrame], target: str,
    inputs: Sequence[str] = (), details: Mapping[str, object] | None = None, force: bool = False,
) -> str:
    """Write every output under a new version, then the manifest. Returns the version."""
    import re

    bad = [n for n in outputs if not re.fullmatch(NAME, n)]
    if bad or len({n.lower() for n in outputs}) != len(outputs):
        raise ValueError(f"output names must be plain and distinct: {sorted(outputs)}")
    check_paths(inputs, target)
    known = manifests(spark, target)
    last = known.agg(F.max("seq")).first()[0] if known is not None else None
    if last is not None and not force:
        raise FileExistsError(f"{target} is published already; pass force to replace it")
    seq, version = (last or 0) + 1, uuid.uuid4().hex
    places = {}
    for name, df in outputs.items():
        places[name] = f"{_clean(target)}/versions/{version}/{name}"
        df.write.mode("errorifexists").parquet(places[name], compression="zstd")
    record = json.dumps({"version": version, "seq": seq, "outputs": places, "details": json.dumps(details or {})})
    spark.createDataFrame([(record,)], "value string").coalesce(1).write.mode("errorifexists").text(
        f"{_clean(target)}/manifests/{seq:06d}-{version}"
    )
    return version


def read_published(spark: SparkSession, target: str, name: str) -> DataFrame:
    """Output ``name`` of the newest manifest."""
    known = manifests(spark, target)
    row = None if known is None else known.orderBy(F.desc("seq")).first()
    if row is None or name not in row["outputs"]:
        raise ValueError(f"{name} is not published at {target}")
    return spark.read.parquet(row["outputs"][name])

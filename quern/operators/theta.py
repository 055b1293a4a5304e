"""Fitted, savable transformers, and one perturbation applied to train and test alike.

Everything that learns, learns from the training rows alone: an ``Estimator``'s ``fit`` sees them, and
the ``Model`` it gives treats test rows by what was learnt. Everything random is a draw from the seed and
the row's key (or, for columns, the column's name), so both tables meet one rule and a rerun repeats it.
Stages fit into ``pyspark.ml.Pipeline``; fitted pipelines are saved with ``write().save(path)`` and loaded
with ``PipelineModel.load(path)``.
"""

from __future__ import annotations

import inspect
import json
import sys
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.functions import draws
from quern.functions.multiset import fingerprint
from quern.operators import perturb
from quern.operators.ranks import exact_median

OTHER = "OTHER"


class _Values(Params):
    """Stages whose whole state is one JSON-able dictionary."""

    values = Param(Params._dummy(), "values", "settings and fitted values of the stage", TypeConverters.identity)

    @keyword_only
    def __init__(self, *, values: Mapping | None = None) -> None:
        super().__init__()
        self._set(values=dict(values or {}))

    def __getitem__(self, name: str):
        return self.getOrDefault(self.values)[name]


class _Stage(_Values, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    pass


class _Fitted(_Values, Model, DefaultParamsReadable, DefaultParamsWritable):
    pass


class _Learner(_Values, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    pass


class DropDrawn(_Stage):
    """Drop ``n`` of ``features``, chosen by name and seed: the same ones from every table."""

    def dropped(self) -> list[str]:
        return sorted(perturb.seeded_order(self["features"], self["seed"], "drop")[: self["n"]])

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.dropped())


class Junk(_Stage):
    """``n`` columns of standard normal draws."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return perturb.junk_columns(df, self["n"], self["key"], self["seed"])


class Blank(_Stage):
    """Missing at random at the stated rate per column; columns the table lacks are left out."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return perturb.blank_out(df, {c: r for c, r in self["rates"].items() if c in df.columns}, self["key"], self["seed"])


class Opaque(_Stage):
    """Names ``f_001``, ... in a seeded order, from the stated columns."""

    def names(self) -> dict[str, str]:
        return perturb.opaque_names(self["columns"], self["keep"], self["seed"])

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumnsRenamed(self.names())


class NoiseModel(_Fitted):
    """Noise of the learnt spread per column."""

    def _transform(self, df: DataFrame) -> DataFrame:
        for column, spread in self["spreads"].items():
            if spread:
                df = perturb.add_noise(df, column, F.lit(spread), self["key"], self["seed"], self["kind"])
        return df


class Noise(_Learner):
    """Learns ``sigma`` training standard deviations of each of ``columns`` still present."""

    def _fit(self, train: DataFrame) -> NoiseModel:
        present = [c for c in self["columns"] if c in train.columns]
        found = train.agg(*[F.stddev_samp(c).alias(c) for c in present]).first().asDict() if present else {}
        spreads = {c: self["sigma"] * (found[c] or 0.0) for c in present}
        return NoiseModel(values={"spreads": spreads, "key": self["key"], "seed": self["seed"], "kind": self["kind"]})


class FillModel(_Fitted):
    """Nulls become the learnt value; with ``mark``, a column ``<c>_missing`` says where."""

    def _transform(self, df: DataFrame) -> DataFrame:
        new = {c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in self["fills"].items()}
        marks = {f"{c}_missing": F.col(c).isNull() for c in new} if self["mark"] else {}
        return df.withColumns({**new, **marks})


class Fill(_Learner):
    """Learns the training median of ``numeric`` columns and the most frequent training value of ``text`` columns.

    Ties go to the smaller value. A column without training values stays null.
    """

    def _fit(self, train: DataFrame) -> FillModel:
        fills = {}
        for c in self["numeric"]:
            fills[c] = exact_median(train, c).first()[0]
        for c in self["text"]:
            counts = train.where(F.col(c).isNotNull()).groupBy(c).agg(draws.rows().alias("_n"))
            top = counts.orderBy(F.desc("_n"), c).limit(1).first()
            fills[c] = top[0] if top else None
        return FillModel(values={"fills": fills, "mark": self["mark"]})


class ScaleModel(_Fitted):
    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - mean) / std if std else F.col(c) - mean for c, (mean, std) in self["moments"].items()})


class Scale(_Learner):
    """Learns training mean and standard deviation of ``columns``; a constant column is only centred."""

    def _fit(self, train: DataFrame) -> ScaleModel:
        columns = self["columns"]
        row = train.agg(*[f(c).alias(f"{n}{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
        return ScaleModel(values={"moments": {c: [row[f"m{c}"], row[f"s{c}"]] for c in columns if row[f"m{c}"] is not None}})


class EncodeModel(_Values, Model, MLReadable, MLWritable):
    """Known training values of a column keep their code, others (null included) get ``OTHER``.

    The vocabulary is a table and is saved as one, so it may be of any size.
    """

    def __init__(self, *, values: Mapping | None = None, vocabulary: DataFrame | None = None) -> None:
        super().__init__(values=values)
        self.vocabulary = vocabulary

    def _transform(self, df: DataFrame) -> DataFrame:
        column, out = self["column"], self["out"]
        known = self.vocabulary.select(F.col("value").alias("_value"), F.col("value").alias("_code"))
        joined = df.join(known, F.col(column).cast("string") == F.col("_value"), "left")
        return joined.withColumn(out, F.coalesce("_code", F.lit(OTHER))).drop("_value", "_code")

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)


class _TableWriter(MLWriter):
    def __init__(self, instance: EncodeModel) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.vocabulary.write.mode("overwrite" if self.shouldOverwrite else "errorifexists").parquet(f"{path}/vocabulary")


class _TableReader(MLReader):
    def __init__(self, cls) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> EncodeModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        made = self.cls(vocabulary=self.sparkSession.read.parquet(f"{path}/vocabulary"))
        made._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(made, metadata)
        return made


class Encode(_Learner):
    """Learns the values of ``column`` with at least ``min_rows`` training rows."""

    def _fit(self, train: DataFrame) -> EncodeModel:
        counts = train.groupBy(F.col(self["column"]).cast("string").alias("value")).agg(draws.rows().alias("n"))
        kept = counts.where((F.col("n") >= self["min_rows"]) & F.col("value").isNotNull())
        return EncodeModel(values=self.getOrDefault(self.values), vocabulary=kept)


@dataclass(frozen=True)
class Theta:
    """One point of the search space."""

    seed: int
    n_drop: int = 0
    n_junk: int = 0
    noise: float = 0.0
    missing: float = 0.0
    kind: str = "gaussian"
    opaque: bool = False

    def pipeline(self, key: Sequence[str], features: Sequence[str], numeric: Sequence[str], columns: Sequence[str]) -> Pipeline:
        """Drop, noise on the numeric features that stay, missing cells, junk, opaque names; ``columns`` are the table's."""
        key, features = list(key), list(features)
        drop = DropDrawn(values={"features": features, "n": self.n_drop, "seed": self.seed})
        left = [c for c in features if c not in drop.dropped()]
        common = {"key": key, "seed": self.seed}
        stages = [
            drop,
            Noise(values={**common, "columns": [c for c in left if c in numeric], "sigma": self.noise, "kind": self.kind}),
            Blank(values={**common, "rates": {c: self.missing for c in left if self.missing}}),
            Junk(values={**common, "n": self.n_junk}),
        ]
        if self.opaque:
            named = [*left, *[f"junk_{j}" for j in range(self.n_junk)]]
            stages.append(Opaque(values={"columns": [*columns, *named], "keep": [c for c in columns if c not in left], "seed": self.seed}))
        return Pipeline(stages=stages)


def code_version() -> str:
    """Digest of the code that perturbs: this module, the perturbations and the draws."""
    return perturb.code_hash(*[inspect.getsource(m) for m in (sys.modules[__name__], perturb, draws)])


def apply_theta(
    train: DataFrame, test: DataFrame, theta: Theta, key: Sequence[str], features: Sequence[str], numeric: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame, PipelineModel, dict]:
    """Perturbed train and test, the fitted pipeline, and the audit record.

    Only ``features`` are touched: keys and targets stay. ``numeric`` names the features that take noise.
    """
    if not set(features) <= set(train.columns) & set(test.columns):
        raise ValueError("both tables need every feature")
    if set(key) & set(features):
        raise ValueError("keys are no features")
    fitted = theta.pipeline(key, features, numeric, train.columns).fit(train)
    audit = {
        "theta": asdict(theta), "dropped": fitted.stages[0].dropped(), "spreads": fitted.stages[1]["spreads"],
        "names": fitted.stages[4].names() if theta.opaque else {}, "code_version": code_version(),
    }
    return fitted.transform(train), fitted.transform(test), fitted, audit


def audit_record(spark: SparkSession, audit: Mapping, tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: rows, order-free fingerprint of its content, and the audit as JSON."""
    text = F.lit(json.dumps(audit, sort_keys=True))
    out = None
    for name, df in tables.items():
        row = df.agg(draws.rows().alias("n"), fingerprint(*sorted(df.columns)).alias("fingerprint")).select(F.lit(name).alias("name"), "n", "fingerprint", text.alias("audit"))
        out = row if out is None else out.union(row)
    return out

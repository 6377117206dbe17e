"""Training and applying classifiers with Spark's ML library."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import MISSING
from .evaluate import class_weights

KINDS = ("logistic", "forest", "boosted")


def add_class_weight(df: DataFrame, target: str, name: str = "weight") -> DataFrame:
    """``df`` with n / (2 n_class) for each row's class."""
    w = class_weights(df, target).select(F.col("label").alias("__label"), F.col("balanced").alias(name))
    return df.join(F.broadcast(w), F.col(target) == F.col("__label"), "left").drop("__label")  # two rows


def _fill(df: DataFrame, numeric: list[str], categorical: list[str], medians: dict) -> DataFrame:
    return df.withColumns({**{c: F.coalesce(F.col(c).cast("double"), F.lit(float(medians.get(c) or 0.0))) for c in numeric}, **{c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in categorical}})


def train_classifier(df: DataFrame, kind: str, numeric: list[str], categorical: list[str], target: str, seed: int = 42, **params) -> tuple[PipelineModel, dict]:
    """A fitted pipeline and its metadata. Numeric nulls become training medians, categories are one-hot coded with an all-zero code for ones
    not seen, rows count by their class's weight."""
    from .fitted import quantiles

    medians = {c: (q[0] if q else 0.0) for c, q in quantiles(df, numeric, [0.5]).items()}
    rows = _fill(add_class_weight(df.where(F.col(target).isNotNull()), target), numeric, categorical, medians).withColumn(target, F.col(target).cast("double")).persist()
    index = [StringIndexer(inputCol=c, outputCol=f"{c}__i", handleInvalid="keep", stringOrderType="frequencyDesc") for c in categorical]
    encode = [OneHotEncoder(inputCols=[f"{c}__i" for c in categorical], outputCols=[f"{c}__v" for c in categorical], handleInvalid="keep")] if categorical else []
    gather = VectorAssembler(inputCols=[*numeric, *[f"{c}__v" for c in categorical]], outputCol="raw")
    common = {"labelCol": target, "featuresCol": "features", "weightCol": "weight"}
    if kind == "logistic":
        scale, last = [StandardScaler(inputCol="raw", outputCol="features")], LogisticRegression(maxIter=params.pop("maxIter", 50), **common, **params)
    elif kind == "forest":
        scale, last = [], RandomForestClassifier(seed=seed, numTrees=params.pop("numTrees", 30), maxDepth=params.pop("maxDepth", 6), **common, **params)
    elif kind == "boosted":
        scale, last = [], GBTClassifier(seed=seed, maxIter=params.pop("maxIter", 15), maxDepth=params.pop("maxDepth", 4), **common, **params)
    else:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}")
    if not scale:
        gather.setOutputCol("features")
    model = Pipeline(stages=[*index, *encode, gather, *scale, last]).fit(rows)
    rows.unpersist()
    return model, {"kind": kind, "numeric": numeric, "categorical": categorical, "target": target, "medians": medians}


def batch_score(df: DataFrame, model: PipelineModel, meta: dict, name: str = "probability_1") -> DataFrame:
    """``df`` with the probability of class 1 of each row; nothing is shuffled."""
    keep = [c for c in df.columns if c not in (*meta["numeric"], *meta["categorical"], meta["target"])]
    raw = [F.col(c).alias(f"__in_{c}") for c in df.columns if c not in keep]
    rows = df.select(*df.columns, *raw)
    filled = _fill(rows, meta["numeric"], meta["categorical"], meta["medians"])
    scored = model.transform(filled).withColumn(name, vector_to_array("probability")[1])
    return scored.select(*[F.col(c) if c in keep else F.col(f"__in_{c}").alias(c) for c in df.columns], name)


def minmax_score(df: DataFrame, decision: str, name: str = "probability_1") -> DataFrame:
    """A decision value stretched to 0..1 where a model has no probabilities."""
    ends = df.agg(F.min(decision).alias("__lo"), F.max(decision).alias("__hi"))
    return df.crossJoin(F.broadcast(ends)).withColumn(name, (F.col(decision) - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + 1e-9)).drop("__lo", "__hi")


def feature_importance(df: DataFrame, model: PipelineModel, meta: dict, top_n: int = 10, normalize: bool = True) -> list[tuple[str, float]]:
    """The ``top_n`` model inputs by tree importance or size of coefficient, as percent of the sum over all inputs."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    schema = model.transform(_fill(df.limit(0), meta["numeric"], meta["categorical"], meta["medians"]).withColumn("weight", F.lit(1.0))).schema
    attrs = schema["raw" if "raw" in schema.names else "features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for group in attrs.values() for a in group}
    total = values.sum() if normalize and values.sum() > 0 else 1.0
    rows = [(names.get(i, str(i)), float(v / total * (100 if normalize else 1))) for i, v in enumerate(values)]
    return sorted(rows, key=lambda r: (-r[1], r[0]))[:top_n]

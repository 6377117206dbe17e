"""A fitted preprocessor and its classifier, saved and loaded as one versioned artefact."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, fields

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fitted
from ..operators.modeling import batch_score
from ..operators.windows import window_length
from ..roles import Roles
from .pipeline import Preprocessor, VelocityStage, make_stage

FORMAT = 1
_CLASSES = {c.__name__: c for c in (fitted.TopPercentileFlag, fitted.QuantileBins, fitted.FrequencyEncoding, fitted.RareGrouping, fitted.TargetEncoding, fitted.MedianImputer, fitted.Standardizer, fitted.PCA, fitted.OneHot)}
_MANIFEST = "name string, version long, folder string, content string"


@dataclass
class Artifact:
    """What was saved, ready to score raw rows."""

    name: str
    version: int
    preprocessor: Preprocessor | None
    model: PipelineModel
    meta: dict
    scores_from: str | None = None

    def features(self, raw: DataFrame) -> DataFrame:
        """The model's inputs of raw rows that it wasn't trained on. A row before ``scores_from``, whose windows would reach behind the history that was kept, is an error."""
        return self.preprocessor.transform(self.checked(raw)) if self.preprocessor else raw

    def checked(self, raw: DataFrame) -> DataFrame:
        if self.scores_from is None:
            return raw
        time = F.col(next(s.roles.time for s in self.preprocessor.stages if isinstance(s, VelocityStage)))
        early = F.raise_error(F.concat(F.lit(f"history was kept for rows from {self.scores_from} on, not for "), time.cast("string")))
        return raw.where(F.when(time.cast("timestamp") < F.lit(self.scores_from).cast("timestamp"), early.cast("boolean")).otherwise(True))

    def score(self, raw: DataFrame, name: str = "probability_1") -> DataFrame:
        """The features with the probability of class 1."""
        return batch_score(self.features(raw), self.model, self.meta, name)


def _recipe(stage: fitted.Stage) -> dict:
    """How to build an unfitted stage like this one."""
    if getattr(stage, "recipe", None):
        return {"step": stage.recipe}
    if type(stage).__name__ in _CLASSES:
        return {"class": type(stage).__name__, "fields": {f.name: getattr(stage, f.name) for f in fields(stage)}}
    raise ValueError(f"{type(stage).__name__} {stage.outputs()} was not made from a named step and can't be stored; use make_stage")


def _built(recipe: dict) -> fitted.Stage:
    if "step" in recipe:
        step = recipe["step"]
        return make_stage(step["type"], step["cols"], step["name"], step["params"])
    return _CLASSES[recipe["class"]](**recipe["fields"])


def _store_history(stages: list[VelocityStage], scores_from: str | None, root: str) -> tuple[list[dict], str | None]:
    """Write one table for each set of roles: key, entity, time and all values of the rows that windows of rows from ``scores_from`` on can reach; if that is None, it is
    the last row's time."""
    out = []
    for i, roles in enumerate(dict.fromkeys(s.roles for s in stages)):
        same = [s for s in stages if s.roles == roles]
        wide = max(window_length(s.window) for s in same)
        at = F.col(roles.time).cast("timestamp")
        if scores_from is None:
            scores_from = same[0].history.agg(F.date_format(F.max(at), "yyyy-MM-dd HH:mm:ss.SSSSSSXXX")).first()[0]
        values = list(dict.fromkeys(s.value for s in same))
        kept = same[0].history.where(F.unix_micros(at) >= F.unix_micros(F.lit(scores_from).cast("timestamp")) - wide)
        kept.select(*dict.fromkeys([roles.key, roles.entity, roles.time, *values])).write.parquet(f"{root}/history-{i}")
        out.append({"roles": asdict(roles), "table": f"history-{i}"})
    return out, scores_from


def _manifests(spark: SparkSession, pattern: str) -> list:
    try:
        return spark.read.schema(_MANIFEST).json(pattern).orderBy("name", "version", "folder").collect()
    except AnalysisException:  # nothing saved there
        return []


def save_model(model: PipelineModel, meta: dict, folder: str, name: str, preprocessor: Preprocessor | None = None, scores_from: str | None = None) -> str:
    """Save a classifier, its metadata and, if given, the fitted preprocessor that makes its inputs, as the next version of ``name``; returns where.

    Scalars go to a manifest as JSON, maps and history to Parquet, the classifier to Spark's own format; all is written by Spark, so any shared store will do. Every version
    has a folder of its own, and its manifest, one file, is written last: a reader sees a version whole or not at all, and a writer that dies leaves
    the version before as it was. Of the history only what windows of rows from ``scores_from`` (a time, by default the last training row's) can reach is kept."""
    spark = SparkSession.getActiveSession()
    top = f"{folder.rstrip('/')}/{name}"
    version = 1 + max((r["version"] for r in _manifests(spark, f"{top}/*/manifest")), default=0)
    part = f"v{version:05d}-{uuid.uuid4().hex[:8]}"
    root = f"{top}/{part}"
    model.write().save(f"{root}/pipeline")
    content: dict = {"format": FORMAT, "meta": meta, "plan": None}
    if preprocessor is not None:
        stages, plan = preprocessor.stages, {"passthrough": preprocessor.passthrough, "stages": []}
        for i, stage in enumerate(stages):
            for t in stage.tables:
                getattr(stage, t).write.parquet(f"{root}/stage-{i}-{t}")
            plan["stages"].append({"recipe": _recipe(stage), "scalars": {s: getattr(stage, s) for s in stage.scalars}, "tables": {t: f"stage-{i}-{t}" for t in stage.tables}})
        grids = [s for s in stages if isinstance(s, VelocityStage)]
        if grids:
            plan["histories"], plan["scores_from"] = _store_history(grids, scores_from, root)
        content["plan"] = plan
    spark.createDataFrame([(name, version, part, json.dumps(content))], _MANIFEST).coalesce(1).write.json(f"{root}/manifest")
    return root


def _load(spark: SparkSession, folder: str, row) -> Artifact:
    content, root = json.loads(row["content"]), f"{folder.rstrip('/')}/{row['name']}/{row['folder']}"
    if content["format"] > FORMAT:
        raise ValueError(f"{root} has format {content['format']}; this library reads up to {FORMAT}")
    model, plan = PipelineModel.load(f"{root}/pipeline"), content["plan"]
    if plan is None:
        return Artifact(row["name"], row["version"], None, model, content["meta"])
    histories = {Roles(**h["roles"]): spark.read.parquet(f"{root}/{h['table']}") for h in plan.get("histories", [])}
    stages = []
    for s in plan["stages"]:
        stage = _built(s["recipe"])
        for k, v in s["scalars"].items():
            setattr(stage, k, v)
        for k, v in s["tables"].items():
            setattr(stage, k, spark.read.parquet(f"{root}/{v}"))
        if isinstance(stage, VelocityStage):
            stage.history = histories[stage.roles]
        stages.append(stage)
    return Artifact(row["name"], row["version"], Preprocessor(stages, plan["passthrough"]), model, content["meta"], plan.get("scores_from"))


def load_model(spark: SparkSession, folder: str, name: str, version: int | None = None) -> Artifact:
    """The last version of a saved model, or the one asked for."""
    rows = [r for r in _manifests(spark, f"{folder.rstrip('/')}/{name}/*/manifest") if version in (None, r["version"])]
    if not rows:
        raise FileNotFoundError(f"no {'version ' + str(version) + ' of ' if version else ''}model {name!r} in {folder}")
    return _load(spark, folder, rows[-1])


def load_models(spark: SparkSession, folder: str) -> dict[str, Artifact]:
    """The last version of every model in a folder, by name in order."""
    last = {r["name"]: r for r in _manifests(spark, f"{folder.rstrip('/')}/*/*/manifest")}
    return {name: _load(spark, folder, row) for name, row in last.items()}

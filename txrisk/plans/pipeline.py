"""Preprocessing plans from configuration: named steps become fit/apply stages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import fitted, windows
from ..roles import Roles


def _row(make: Callable, default_name: Callable) -> Callable:
    def build(cols: list[str], name: str | None, params: dict):
        return fitted.Expression(name or default_name(cols, params), make(cols, params))

    return build


@dataclass
class VelocityStage(fitted.Stage):
    """One causal window aggregate as a stage: training rows are their own history, other rows also see the training rows."""

    kind: str
    value: str
    window: str
    roles: Roles
    name: str = ""

    def __post_init__(self):
        self.made = f"{self.value}_{self.kind}_{self.window}"
        self.name = self.name or self.made
        windows.window_length(self.window)

    def fit(self, df):
        self.history = df
        return self

    def transform(self, df):
        return windows.with_history(df, self.history, (self.value,), (self.window,), (self.kind,), self.roles).withColumnRenamed(self.made, self.name)

    def fit_transform(self, df):
        self.fit(df)
        return windows.velocity_grid(df, (self.value,), (self.window,), (self.kind,), self.roles).withColumnRenamed(self.made, self.name)


def _velocity(kind: str) -> Callable:
    def build(cols, name, params):
        roles = Roles(entity=params.get("group_column", "j"), time=params.get("date_column", "fecha"))
        return VelocityStage(kind, params.get("value_column", cols[0]), params["window"], roles, name or "")

    return build


# The names that configurations use, for the two kinds of them.
REGISTRY: dict[str, Callable] = {
    "log_feature": _row(lambda c, p: scalar.log_feature(c[0], p.get("offset", 0.0)), lambda c, p: f"log_{c[0]}"),
    "missing_flag": _row(lambda c, p: scalar.missing_flag(c[0]), lambda c, p: f"{c[0]}_is_missing"),
    "zero_flag": _row(lambda c, p: scalar.zero_flag(c[0], p.get("value", 0)), lambda c, p: f"{c[0]}_is_zero" if p.get("value", 0) == 0 else f"{c[0]}_eq_{p['value']}_flag"),
    "hour": _row(lambda c, p: scalar.hour(c[0]), lambda c, p: f"hour_{c[0]}"),
    "weekday": _row(lambda c, p: scalar.weekday(c[0]), lambda c, p: f"weekday_{c[0]}"),
    "is_weekend_flag": _row(lambda c, p: scalar.is_weekend(c[0], tuple(p.get("off_days", (5, 6)))), lambda c, p: f"{c[0]}_is_weekend"),
    "hour_cyclic_sin_cos": _row(lambda c, p: scalar.hour_cyclic(c[0], p.get("component", "sin"), p.get("cycle_length", 24)), lambda c, p: f"{c[0]}_hour_{p.get('component', 'sin')}"),
    "ratio": _row(lambda c, p: scalar.ratio(c[0], c[1], p.get("default")), lambda c, p: f"{c[0]}_per_{c[1]}"),
    "top_percentile_flag": lambda c, n, p: fitted.TopPercentileFlag(c[0], p.get("quantile", 0.99), p.get("direction", "top"), n or ""),
    "quantile_bins_dropna": lambda c, n, p: fitted.QuantileBins(c[0], p.get("num_bins", 5), p.get("include_missing_bin", True), n or f"{c[0]}_qbin_dropna"),
    "frequency_encoding": lambda c, n, p: fitted.FrequencyEncoding(c[0], p.get("relative", True), n or ""),
    "rare_grouping": lambda c, n, p: fitted.RareGrouping(c[0], p.get("min_frequency", 0.01), p.get("fallback", fitted.OTHER), n or ""),
    "target_encoding_cv": lambda c, n, p: fitted.TargetEncoding(c[0], p.get("target", c[1] if len(c) > 1 else "fraude"), p.get("key", "k"), p.get("num_folds", 5), p.get("shrinkage", 10.0), n or ""),
    "pca": lambda c, n, p: fitted.PCA(list(c), p.get("n_components", 1), p.get("scale", False), p.get("fill", "median"), n or "pca"),
    **{f"{a}_window": _velocity(a) for a in windows.AGGREGATES},
}
#: Class names of the JSON configuration for the same steps.
ALIASES = {
    "LogFeatureTransformer": "log_feature", "MissingFlagTransformer": "missing_flag", "ZeroFlagTransformer": "zero_flag", "HourTransformer": "hour", "WeekdayTransformer": "weekday", "IsWeekendFlagTransformer": "is_weekend_flag",
    "HourCyclicSinCosTransformer": "hour_cyclic_sin_cos", "RatioTransformer": "ratio", "TopPercentileFlagTransformer": "top_percentile_flag", "QuantileBinsDropnaTransformer": "quantile_bins_dropna", "FrequencyEncodingTransformer": "frequency_encoding",
    "RareGroupingTransformer": "rare_grouping", "TargetEncodingCVTransformer": "target_encoding_cv", "PCATransformer": "pca", "SumWindowTransformer": "sum_window", "MeanWindowTransformer": "mean_window", "MedianWindowTransformer": "median_window",
    "MaxWindowTransformer": "max_window", "MinWindowTransformer": "min_window",
}


def make_stage(kind: str, cols: list[str] | str, name: str | None = None, params: dict | None = None) -> fitted.Stage:
    kind = ALIASES.get(kind, kind)
    if kind not in REGISTRY:
        raise ValueError(f"unknown step {kind!r}")
    cols, params = [cols] if isinstance(cols, str) else list(cols), dict(params or {})
    stage = REGISTRY[kind](cols, name, params)
    stage.recipe = {"type": kind, "cols": cols, "name": name, "params": params}
    return stage


@dataclass
class Preprocessor:
    """Stages in order, with a fit and an apply that are never mistaken for each other."""

    stages: list[fitted.Stage]
    passthrough: list[str] = field(default_factory=list)

    def fit(self, df: DataFrame) -> "Preprocessor":
        for s in self.stages:
            s.fit(df)
        return self

    def transform(self, df: DataFrame, windows_of: Callable | None = None) -> DataFrame:
        """Rows not trained on: maps of all training rows, and the training rows as history. ``windows_of(rows, a stage, values, windows, aggregates)`` adds the
        windows where ``df`` is a stream."""
        df = self._grids(df, windows_of or (lambda rows, s, *grid: windows.with_history(rows, s.history, *grid, s.roles)))
        for s in self.stages:
            if not isinstance(s, VelocityStage):
                df = s.transform(df)
        return df

    def fit_transform(self, df: DataFrame) -> DataFrame:
        """The training rows themselves: out-of-fold encodings, their own past as history."""
        base = df
        for s in self.stages:
            s.fit(base)
        df = self._grids(df, lambda rows, s, *grid: windows.velocity_grid(rows, *grid, s.roles))
        for s in self.stages:
            if not isinstance(s, VelocityStage):
                df = s.fit_transform(df) if isinstance(s, fitted.TargetEncoding) else s.transform(df)
        return df

    def _grids(self, df: DataFrame, add: Callable) -> DataFrame:
        """All windows of an entity in one exchange, by ``add(rows, a stage, values, windows, aggregates)``."""
        grid = [s for s in self.stages if isinstance(s, VelocityStage)]
        for roles in dict.fromkeys(s.roles for s in grid):
            same = [s for s in grid if s.roles == roles]
            df = add(df, same[0], tuple(dict.fromkeys(s.value for s in same)), tuple(dict.fromkeys(s.window for s in same)), tuple(dict.fromkeys(s.kind for s in same)))
            wanted = {s.made for s in same}
            extra = [f"{v}_{a}_{w}" for v in {s.value for s in same} for a in {s.kind for s in same} for w in {s.window for s in same} if f"{v}_{a}_{w}" not in wanted]
            df = df.withColumnsRenamed({s.made: s.name for s in same}).drop(*extra)
        return df

    def outputs(self) -> list[str]:
        return [*[n for s in self.stages for n in s.outputs()], *self.passthrough]


def build_preprocessor(config: dict) -> Preprocessor:
    """A plan from ``{"steps": [{"name", "type", "cols", "params"}]}``; type "passthrough" keeps raw columns."""
    stages, raw = [], []
    for step in config["steps"]:
        if step["type"] == "passthrough":
            raw += step["cols"]
        else:
            stages.append(make_stage(step["type"], step["cols"], None, step.get("params")))
    return Preprocessor(stages, raw)


def filter_config_by_features(config: dict, targets: list[str], passthrough: list[str] = ()) -> dict:
    """The steps of a configuration whose real outputs are wanted, and the raw columns that a kept step would hide."""
    kept, raw = [], set()
    for step in config["steps"]:
        if step["type"] == "passthrough":
            if set(step["cols"]) & set(targets):
                kept.append(step)
                raw |= set(step["cols"])
        elif set(make_stage(step["type"], step["cols"], None, step.get("params")).outputs()) & set(targets):
            kept.append(step)
    used = {c for s in kept if s["type"] != "passthrough" for c in s["cols"]}
    kept += [{"name": f"{c}_raw", "type": "passthrough", "cols": [c]} for c in passthrough if c in used and c not in raw]
    return {"steps": kept}


def apply_transformations(df: DataFrame, config_list: list[dict], skip_errors: bool = False) -> tuple[DataFrame, list[str]]:
    """Entries ``{process, column, new_column, params}`` in order. A failing entry is an error; with ``skip_errors`` it is left out and its
    message returned."""
    failed = []
    for e in config_list:
        try:
            df = make_stage(e["process"], e["column"], e.get("new_column"), e.get("params")).fit_transform(df)
        except Exception as x:
            if not skip_errors:
                raise
            failed.append(f"{e.get('new_column') or e.get('process')}: {x}")
    return df, failed

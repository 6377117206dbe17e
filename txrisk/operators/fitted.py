"""Transforms that learn from one table and are applied to others.

Each class has ``fit(df) -> self`` and ``transform(df) -> df``; what it learnt is scalars, or a small table. ``fit_transform`` is the
same as both, except where training rows must not see their own target (``TargetEncoding``)."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import MISSING, OTHER
from .ecdf import running_sums


def quantiles(df: DataFrame, cols: list[str], at: list[float], accuracy: int = 10_000) -> dict[str, list[float] | None]:
    """Exact quantiles with linear interpolation of many columns; nulls don't count, a column of nulls has None. Only the quantiles reach the driver.

    They are selected, not sorted out: sketches of all columns, in one aggregate, bracket each quantile between two values some ten-thousandths of the rows apart; a second
    aggregate counts what is below each bracket; and only the values inside brackets, unless a bracket is one value, are counted by value and put in order. What
    is shuffled is this small share of the distinct values."""
    x = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in cols}
    near = [min(1.0, max(0.0, q + side * 1.5 / accuracy)) for q in at for side in (-1, 1)]
    sketch = df.agg(*[e for i, c in enumerate(cols) for e in (F.count(x[c]).alias(f"n{i}"), F.percentile_approx(x[c], F.array(*map(F.lit, near)), accuracy).alias(f"b{i}"))]).first()
    total = {c: sketch[f"n{i}"] for i, c in enumerate(cols)}
    brackets = {c: list(zip(sketch[f"b{i}"][::2], sketch[f"b{i}"][1::2])) for i, c in enumerate(cols) if total[c]}
    if not brackets:
        return dict.fromkeys(cols)
    parts = [e for i, c in enumerate(cols) if c in brackets for j, (a, b) in enumerate(brackets[c]) for e in (F.count_if(x[c] < a).alias(f"below{i}_{j}"), F.max(F.when(x[c] < a, x[c])).alias(f"before{i}_{j}"), F.min(F.when(x[c] > b, x[c])).alias(f"after{i}_{j}"), F.count_if(x[c] <= b).alias(f"upto{i}_{j}"))]
    seen = df.agg(*parts).first()
    wide = {c: [(a, b) for a, b in dict.fromkeys(brackets[c]) if a < b] for c in brackets}
    inside = {}
    if any(wide.values()):
        within = lambda c: reduce(Column.__or__, [x[c].between(a, b) for a, b in wide[c]])
        few = df.select(F.explode(F.filter(F.array(*[F.struct(F.lit(c).alias("feature"), F.when(within(c), x[c]).alias("value")) for c in wide if wide[c]]), lambda p: p["value"].isNotNull())).alias("p")).select("p.*")
        inside = _inside(few, {c: [(j, *bracket) for j, bracket in enumerate(brackets[c]) if bracket in wide[c]] for c in brackets}, {(c, j): [(k - seen[f"below{cols.index(c)}_{j}"]) for k in _ranks(total[c], q)] for c in brackets for j, q in enumerate(at)})
    out = dict.fromkeys(cols)
    for i, c in enumerate(cols):
        if c not in brackets:
            continue
        out[c] = []
        for j, q in enumerate(at):
            place, below, (a, b) = (total[c] - 1) * q, seen[f"below{i}_{j}"], brackets[c][j]
            values = []
            for k in _ranks(total[c], q):
                if k < below - 1 or k > seen[f"upto{i}_{j}"]:
                    raise ArithmeticError(f"the sketch of {c} misses its quantile {q}")
                values.append(seen[f"before{i}_{j}"] if k < below else seen[f"after{i}_{j}"] if k >= seen[f"upto{i}_{j}"] else a if a == b else inside[c, j, k - below])
            out[c].append(values[0] + (values[1] - values[0]) * (place - math.floor(place)))
    return out


def _ranks(n: int, q: float) -> tuple[int, int]:
    """The places, from 0, of the two values that a quantile is between."""
    place = (n - 1) * q
    return math.floor(place), math.ceil(place)


def _inside(few: DataFrame, brackets: dict, wanted: dict) -> dict:
    """(column, bracket, place) to value for the ``wanted`` places, from 0, among the values of each bracket. ``few`` has (feature, value) of the values in any bracket."""
    spark = few.sparkSession
    table = F.broadcast(spark.createDataFrame([(c, j, float(a), float(b)) for c, some in brackets.items() for j, a, b in some], "feature string, bracket int, low double, high double"))
    counts = few.groupBy("feature", "value").agg(F.count("*").alias("n")).join(table, "feature").where("value BETWEEN low AND high").select("feature", "bracket", "value", "n")
    rows = running_sums(counts, ["n"], ["feature", "bracket"], "value")
    places = spark.createDataFrame([(c, j, p) for (c, j), some in wanted.items() for p in dict.fromkeys(some)], "feature string, bracket int, place long")
    hit = rows.join(F.broadcast(places), ["feature", "bracket"]).where("place >= cum_n - n AND place < cum_n")
    return {(r["feature"], r["bracket"], r["place"]): r["value"] for r in hit.collect()}


class Stage:
    #: Attributes that ``fit`` sets and ``transform`` needs: plain values, and tables.
    scalars: ClassVar[tuple[str, ...]] = ()
    tables: ClassVar[tuple[str, ...]] = ()

    def fit(self, df: DataFrame) -> "Stage":
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def outputs(self) -> list[str]:
        return [self.name]


@dataclass
class Expression(Stage):
    """A column expression without a fit."""

    name: str
    expression: Column = field(repr=False)

    def transform(self, df):
        return df.withColumn(self.name, self.expression)


@dataclass
class TopPercentileFlag(Stage):
    """1 at or beyond the quantile of the training values; null gives 0, and so does a training column of nulls."""

    scalars = ("threshold",)
    col: str
    quantile: float = 0.99
    direction: str = "top"
    name: str = ""

    def __post_init__(self):
        if self.direction not in ("top", "bottom"):
            raise ValueError("direction must be 'top' or 'bottom'")
        self.name = self.name or f"{self.col}_{self.direction}{round((1 - self.quantile) * 100) if self.direction == 'top' else round(self.quantile * 100)}_flag"

    def fit(self, df):
        q = quantiles(df, [self.col], [self.quantile])[self.col]
        self.threshold = q[0] if q else None
        return self

    def transform(self, df):
        if self.threshold is None:
            return df.withColumn(self.name, F.lit(0))
        x = F.col(self.col)
        hit = x >= self.threshold if self.direction == "top" else x <= self.threshold
        return df.withColumn(self.name, F.coalesce(hit, F.lit(False)).cast("int"))


@dataclass
class QuantileBins(Stage):
    """Bins between the training quantiles, closed on the right, the outer ones open to infinity; labels "0" up. Equal edges are one;
    with fewer than two edges every value that isn't null gets null. Null gets its own label, or null."""

    scalars = ("edges",)
    col: str
    num_bins: int = 5
    include_missing: bool = True
    name: str = ""

    def __post_init__(self):
        self.name = self.name or f"{self.col}_qbin"

    def fit(self, df):
        q = quantiles(df, [self.col], [i / self.num_bins for i in range(self.num_bins + 1)])[self.col]
        self.edges = sorted(set(q)) if q else []
        return self

    def transform(self, df):
        x = F.col(self.col)
        out = F.when(x.isNull(), F.lit(MISSING if self.include_missing else None))
        inner = self.edges[1:-1]
        if len(self.edges) >= 2:
            for i, edge in enumerate(inner):
                out = out.when(x <= edge, str(i))
            out = out.otherwise(str(len(inner)))
        return df.withColumn(self.name, out)


def _apply_map(df: DataFrame, table: DataFrame, col: str, value: str, name: str, default: Column) -> DataFrame:
    """A left join on a null-safe key; the null category is looked up outside the join, so a column of mostly nulls makes no hot key.
    Whether the map is broadcast is left to its size."""
    null_row = table.where(F.col(col).isNull()).agg(F.max(value).alias("__null"), F.count("*").alias("__has"))  # one row
    known = table.where(F.col(col).isNotNull()).select(F.col(col).alias("__key"), F.col(value).alias("__value"))
    out = df.join(known, F.col(col) == F.col("__key"), "left").crossJoin(F.broadcast(null_row))
    return out.withColumn(name, F.coalesce("__value", F.when(F.col(col).isNull() & (F.col("__has") > 0), F.col("__null")), default)).drop("__key", "__value", "__null", "__has")


@dataclass
class FrequencyEncoding(Stage):
    """A category's count, as a share of all training rows or not; null is a category; one not seen gets the mean over the categories."""

    scalars = ("default",)
    tables = ("table",)
    col: str
    relative: bool = True
    name: str = ""

    def __post_init__(self):
        self.name = self.name or f"{self.col}_freq_encoded"

    def fit(self, df):
        counts = df.groupBy(self.col).count()
        n = df.count() if self.relative else 1
        self.table = counts.select(self.col, (F.col("count") / n if self.relative else F.col("count").cast("double")).alias("freq"))
        self.default = self.table.agg(F.avg("freq")).first()[0]
        return self

    def transform(self, df):
        return _apply_map(df, self.table, self.col, "freq", self.name, F.lit(self.default).cast("double"))


@dataclass
class RareGrouping(Stage):
    """A category that has ``min_frequency`` of the training rows stays, null too; the others, and ones not seen, become ``fallback``."""

    tables = ("table",)
    col: str
    min_frequency: float = 0.01
    fallback: str = OTHER
    name: str = ""

    def __post_init__(self):
        self.name = self.name or f"{self.col}_grouped"

    def fit(self, df):
        n = df.count()
        counts = df.groupBy(self.col).count().where(F.col("count") >= self.min_frequency * n)
        self.table = counts.select(self.col, F.lit(1).alias("keep"))  # at most 1 / min_frequency rows
        return self

    def transform(self, df):
        kept = _apply_map(df, self.table, self.col, "keep", "__keep", F.lit(0))
        return kept.withColumn(self.name, F.when(F.col("__keep") == 1, F.col(self.col).cast("string")).otherwise(self.fallback)).drop("__keep")


def fold_of(key: str | Column, folds: int) -> Column:
    """A row's fold, by its key alone: the same on every run and in every engine that has md5."""
    return (F.conv(F.substring(F.md5((F.col(key) if isinstance(key, str) else key).cast("string")), 1, 8), 16, 10).cast("long") % folds).cast("int")


@dataclass
class TargetEncoding(Stage):
    """The smoothed mean target of a category. ``fit_transform`` gives a training row the mean over the other folds; ``transform`` gives any
    other row the mean over all training rows. Null is a category; one not seen, or seen only in the row's own fold, gets the mean of all."""

    scalars = ("mean",)
    tables = ("table",)
    col: str
    target: str = "fraude"
    key: str = "k"
    num_folds: int = 5
    shrinkage: float = 10.0
    name: str = ""

    def __post_init__(self):
        self.name = self.name or f"{self.col}_target_enc"

    def fit(self, df):
        stats = df.groupBy(self.col, fold_of(self.key, self.num_folds).alias("fold")).agg(F.sum(F.col(self.target).cast("double")).alias("s"), F.count(self.target).alias("n"))
        self.by_fold = stats
        total = stats.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
        self.mean = total["s"] / total["n"] if total["n"] else None
        smooth = lambda s, n: F.when(n > 0, F.try_divide(s + self.shrinkage * self.mean, n + self.shrinkage))
        self.smooth = smooth
        whole = stats.groupBy(self.col).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        self.table = whole.select(self.col, smooth(F.col("s"), F.col("n")).alias("enc"), "s", "n")
        return self

    def transform(self, df):
        return _apply_map(df, self.table.select(self.col, "enc"), self.col, "enc", self.name, F.lit(self.mean).cast("double"))

    def fit_transform(self, df):
        self.fit(df)
        # total less own fold, for all folds at once
        one = self.by_fold.alias("f").join(self.table.alias("t"), F.col(f"f.{self.col}").eqNullSafe(F.col(f"t.{self.col}")))
        other = one.select(F.col(f"f.{self.col}").alias("__cat"), F.col("f.fold").alias("__fold"), self.smooth(F.col("t.s") - F.col("f.s"), F.col("t.n") - F.col("f.n")).alias("__enc"))
        # the null category has a value a fold: one row with a map, looked up outside the join
        of_null = other.where("__cat IS NULL AND __enc IS NOT NULL").agg(F.map_from_entries(F.collect_list(F.struct("__fold", "__enc"))).alias("__of_null"))
        rows = df.withColumn("__own", fold_of(self.key, self.num_folds)).crossJoin(F.broadcast(of_null))
        joined = rows.join(other.where("__cat IS NOT NULL"), (F.col(self.col) == F.col("__cat")) & (F.col("__own") == F.col("__fold")), "left")
        enc = F.when(F.col(self.col).isNull(), F.try_element_at("__of_null", F.col("__own"))).otherwise(F.col("__enc"))
        return joined.withColumn(self.name, F.coalesce(enc, F.lit(self.mean).cast("double"))).drop("__own", "__cat", "__fold", "__enc", "__of_null")


@dataclass
class MedianImputer(Stage):
    """Nulls become the column's training median; a column of nulls stays null."""

    scalars = ("medians",)
    cols: list[str]
    suffix: str = "_imputed"

    def fit(self, df):
        self.medians = {c: q[0] if q else None for c, q in quantiles(df, self.cols, [0.5]).items()}
        return self

    def transform(self, df):
        return df.withColumns({c + self.suffix: F.coalesce(F.col(c).cast("double"), F.lit(m).cast("double")) for c, m in self.medians.items()})

    def outputs(self):
        return [c + self.suffix for c in self.cols]


@dataclass
class Standardizer(Stage):
    """(x - mean) / sample deviation; a constant column gives null."""

    scalars = ("stats",)
    cols: list[str]
    suffix: str = "_std"

    def fit(self, df):
        row = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}__{i}") for c in self.cols for i, f in enumerate((F.avg, F.stddev_samp))]).first()
        self.stats = {c: (row[f"{c}__0"], row[f"{c}__1"]) for c in self.cols}
        return self

    def transform(self, df):
        return df.withColumns({c + self.suffix: F.when(F.lit(bool(s)), (F.col(c) - m) / (s or 1)) if m is not None else F.lit(None).cast("double") for c, (m, s) in self.stats.items()})

    def outputs(self):
        return [c + self.suffix for c in self.cols]


@dataclass
class PCA(Stage):
    """Projections on the leading components of the training columns. Nulls are filled by the training median, mean or zero; columns are
    centred, and divided by their population deviation with ``scale``. A component's sign is such that its largest loading is
    positive. Only the k x k covariances reach the driver."""

    scalars = ("fills", "means", "scales", "components")
    cols: list[str]
    n_components: int = 1
    scale: bool = False
    fill: str = "median"
    prefix: str = "pca"

    def fit(self, df):
        import numpy as np

        if self.fill not in ("median", "mean", "zero"):
            raise ValueError("fill must be 'median', 'mean' or 'zero'")
        if self.fill == "median":
            fills = {c: q[0] if q else 0.0 for c, q in quantiles(df, self.cols, [0.5]).items()}
        elif self.fill == "mean":
            row = df.agg(*[F.avg(c).alias(c) for c in self.cols]).first()
            fills = {c: row[c] or 0.0 for c in self.cols}
        else:
            fills = dict.fromkeys(self.cols, 0.0)
        self.fills = fills
        filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(fills[c])).alias(c) for c in self.cols])
        k = len(self.cols)
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        row = filled.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(self.cols)], *[F.covar_pop(self.cols[i], self.cols[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
        self.means = [row[f"m{i}"] or 0.0 for i in range(k)]
        cov = np.zeros((k, k))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
        self.scales = [float(np.sqrt(cov[i, i])) or 1.0 for i in range(k)] if self.scale else [1.0] * k
        cov = cov / np.outer(self.scales, self.scales)
        values, vectors = np.linalg.eigh(cov)
        top = vectors[:, np.argsort(-values, kind="stable")[: self.n_components]]
        self.components = [(v * np.sign(v[np.argmax(np.abs(v))])).tolist() for v in top.T]
        return self

    def transform(self, df):
        x = [(F.coalesce(F.col(c).cast("double"), F.lit(self.fills[c])) - m) / s for c, m, s in zip(self.cols, self.means, self.scales)]
        return df.withColumns({n: sum((xi * w for xi, w in zip(x[1:], v[1:])), x[0] * v[0]) for n, v in zip(self.outputs(), self.components)})

    def outputs(self):
        return [f"{self.prefix}_{i + 1}" for i in range(self.n_components)]


@dataclass
class OneHot(Stage):
    """A 0/1 column for each training level of each column; null is a level of its own, one not seen gives zeros. Levels are for model
    inputs: few by nature, and more than ``max_levels`` is an error."""

    scalars = ("levels",)
    cols: list[str]
    max_levels: int = 200

    def fit(self, df):
        self.levels = {}
        for c in self.cols:
            found = [r[0] for r in df.select(F.coalesce(F.col(c).cast("string"), F.lit(MISSING))).distinct().limit(self.max_levels + 1).collect()]
            if len(found) > self.max_levels:
                raise ValueError(f"{c} has over {self.max_levels} levels; group or encode it first")
            self.levels[c] = sorted(found)
        return self

    def transform(self, df):
        return df.withColumns({f"{c}_{v}": (F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) == v).cast("int") for c, levels in self.levels.items() for v in levels})

    def outputs(self):
        return [f"{c}_{v}" for c, levels in self.levels.items() for v in levels]

"""Drift of features from a reference week, for all features and weeks at once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import KS_DRIFT, NO_DATA, PSI, label
from ..sources.tables import MISSING, OTHER
from .ecdf import long_values, running_sums


def kolmogorov_p(d: Column, n: Column, m: Column) -> Column:
    """The two-sample p-value of a KS statistic by its limit distribution; null where an argument is. For small distances the series of theta form, which
    converges fast there."""
    x = d * F.sqrt(n.cast("double") * m / (n + m))
    terms = lambda f: F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda sum_, k: sum_ + f(k.cast("double")))
    small = 1 - F.lit(math.sqrt(2 * math.pi)) / x * terms(lambda k: F.exp(-F.pow(2 * k - 1, F.lit(2.0)) * (math.pi**2) / (8 * x * x)))
    large = 2 * terms(lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2 * k * k * x * x))
    return F.when(x < 1e-6, 1.0).when(x < 0.5, F.greatest(small, F.lit(0.0))).when(x.isNotNull(), F.greatest(F.least(large, F.lit(1.0)), F.lit(0.0)))


def ks_drift(df: DataFrame, cols: list[str], week: str, weeks: list[int], reference: int = 0) -> DataFrame:
    """(feature, week, ks_stat, n_ref, n_cur, ks_p_value, ks_label) of each week against the reference. Values are counted once, with a count for each week as a
    column; nulls don't count; a side without values gives null."""
    rows = long_values(df, cols, {"w": F.col(week)})
    names = {w: f"w{w}" for w in [reference, *[w for w in weeks if w != reference]]}
    counts = rows.groupBy("feature", "value").agg(*[F.count_if(F.col("w") == w).alias(n) for w, n in names.items()])
    cum = running_sums(counts, list(names.values()), ["feature"], "value")
    total = counts.groupBy("feature").agg(*[F.sum(n).alias(f"t_{n}") for n in names.values()])
    ref = names[reference]
    gap = lambda n: F.abs(F.try_divide(f"cum_{n}", f"t_{n}") - F.try_divide(f"cum_{ref}", f"t_{ref}"))
    joined = cum.join(total, "feature")
    one = joined.groupBy("feature").agg(*[F.max(gap(n)).alias(f"ks_{n}") for n in names.values()], *[F.first(f"t_{n}").alias(f"t_{n}") for n in names.values()])
    each = F.explode(F.array(*[F.struct(F.lit(w).alias("week"), F.col(f"ks_{names[w]}").alias("ks_stat"), F.col(f"t_{ref}").alias("n_ref"), F.col(f"t_{names[w]}").alias("n_cur")) for w in weeks if w != reference]))
    return one.select("feature", each.alias("e")).select("feature", "e.*").withColumn("ks_p_value", kolmogorov_p(F.col("ks_stat"), F.col("n_ref"), F.col("n_cur"))).withColumn("ks_label", label(F.col("ks_stat"), KS_DRIFT, missing=NO_DATA))


def psi(df: DataFrame, cols: list[str], week: str, weeks: list[int], reference: int = 0, max_categories: int = 20, eps: float = 1e-4) -> DataFrame:
    """(feature, week, psi, psi_label). The reference's commonest ``max_categories - 1`` categories stay, null is one of them, the rest is one
    more; shares are taken over the categories either week has, with ``eps`` added. Ties: by category."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("category")) for c in cols]))
    counts = df.select(F.col(week).alias("week"), pairs.alias("p")).select("week", "p.*").groupBy("feature", "week", "category").agg(F.count("*").alias("n"))
    order = Window.partitionBy("feature").orderBy(F.desc("n"), "category")
    top = counts.where(F.col("week") == reference).withColumn("pos", F.row_number().over(order)).where(F.col("pos") < max_categories).select("feature", F.col("category").alias("top"))
    small = counts.join(F.broadcast(top.withColumnRenamed("feature", "f")), (F.col("feature") == F.col("f")) & (F.col("category") == F.col("top")), "left")  # features x max_categories rows
    small = small.groupBy("feature", "week", F.coalesce("top", F.lit(OTHER)).alias("category")).agg(F.sum("n").alias("n"))
    total = small.groupBy("feature", "week").agg(F.sum("n").alias("total"))
    share = small.join(total, ["feature", "week"]).withColumn("pct", F.col("n") / F.col("total"))
    ref = share.where(F.col("week") == reference).select("feature", "category", F.col("pct").alias("ref"))
    other = [w for w in weeks if w != reference]
    frame = ref.select("feature", "category").crossJoin(F.broadcast(df.sparkSession.createDataFrame([(w,) for w in other], "week int"))).union(share.where(F.col("week").isin(other)).select("feature", "category", F.col("week").cast("int"))).distinct()
    cur = share.select("feature", "category", F.col("week").cast("int").alias("week"), F.col("pct").alias("cur"))
    both = frame.join(ref, ["feature", "category"], "left").join(cur, ["feature", "category", "week"], "left")
    r, c = F.coalesce("ref", F.lit(0.0)) + eps, F.coalesce("cur", F.lit(0.0)) + eps
    value = both.groupBy("feature", "week").agg(F.sum((c - r) * F.log(c / r)).alias("v"), F.count("cur").alias("has"), F.count("ref").alias("has_ref"))
    return value.select("feature", "week", F.when((F.col("has") > 0) & (F.col("has_ref") > 0), F.col("v")).alias("psi")).withColumn("psi_label", label(F.col("psi"), PSI, missing=NO_DATA))


def drift_pivot(drift: DataFrame, value: str, weeks: list[int]) -> DataFrame:
    out = drift.groupBy("feature").pivot("week", weeks).agg(F.first(value))
    return out.select("feature", *[F.col(str(w)).alias(f"week_{w}") for w in weeks])


def drift_summary(drift: DataFrame, value: str, bands: list) -> DataFrame:
    """Highest value, the first week that had it, mean and alert of each feature."""
    best = F.max(F.struct(F.coalesce(F.col(value), F.lit(-1.0)).alias("v"), (-F.col("week")).alias("w"))).alias("top")
    out = drift.groupBy("feature").agg(F.max(value).alias("worst"), best, F.round(F.avg(value), 4).alias("mean"))
    return out.select("feature", F.round("worst", 4).alias("worst"), (-F.col("top")["w"]).alias("worst_week"), "mean", label(F.col("worst"), bands, missing=NO_DATA).alias("alert"))

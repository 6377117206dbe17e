"""Value counts by group with running sums: the one table that rank tests, distribution distances and ROC curves are read from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def long_values(df: DataFrame, cols: list[str], keep: dict) -> DataFrame:
    """(feature, value as double, kept columns) for each value that isn't null."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("value")) for c in cols]))
    return df.select(*[c.alias(n) for n, c in keep.items()], pairs.alias("p")).select(*keep, "p.*").where("value IS NOT NULL")


def running_sums(counts: DataFrame, sums: list[str], group: list[str], by: str, slices: int = 64, descending: bool = False) -> DataFrame:
    """``counts`` with ``cum_<name>``: sums up to and including the row, in order of ``by`` within ``group``; ``by`` is unique in a group.

    A group's values are cut into ``slices`` ranges at their approximate quantiles. Sums run inside a range, and the ranges' totals, of
    which there are few, give the offsets: no group is ordered in one task."""
    edges = counts.groupBy(*group).agg(F.percentile_approx(by, F.array(*[F.lit(i / slices) for i in range(1, slices)]), 1000).alias("__edges"))
    cut = counts.join(edges, group).withColumn("__slice", F.size(F.filter("__edges", lambda e: e < F.col(by)))).drop("__edges")
    order = F.col(by).desc() if descending else F.col(by).asc()
    total = cut.groupBy(*group, "__slice").agg(*[F.sum(s).alias(f"__{s}") for s in sums])
    slice_order = F.col("__slice").desc() if descending else F.col("__slice").asc()
    earlier = Window.partitionBy(*group).orderBy(slice_order).rowsBetween(Window.unboundedPreceding, -1)
    offset = total.select(*group, "__slice", *[F.coalesce(F.sum(f"__{s}").over(earlier), F.lit(0)).alias(f"__off_{s}") for s in sums])
    inside = Window.partitionBy(*group, "__slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.withColumns({f"cum_{s}": F.sum(s).over(inside) for s in sums}).join(offset, [*group, "__slice"])
    return out.withColumns({f"cum_{s}": F.col(f"cum_{s}") + F.col(f"__off_{s}") for s in sums}).drop("__slice", *[f"__off_{s}" for s in sums])


def quantile_table(values: DataFrame, group: list[str], value: str, at: list[float], slices: int = 64) -> DataFrame:
    """(group columns, q): an array of the exact quantiles ``at``, with linear interpolation, of ``value`` in each group. It is read from the
    table of value counts and its running sums, so no task holds a group's distinct values, as an aggregate of quantiles would."""
    counts = values.groupBy(*group, value).agg(F.count("*").alias("n"))
    total = counts.groupBy(*group).agg(F.sum("n").alias("__total"))
    rows = running_sums(counts, ["n"], group, value, slices).join(total, group)
    place = [(F.col("__total") - 1) * F.lit(float(q)) for q in at]
    pick = lambda p: F.max(F.when((F.col("cum_n") - F.col("n") <= p) & (p < F.col("cum_n")), F.col(value)))
    out = rows.groupBy(*group).agg(F.max("__total").alias("__total"), *[pick(f(p)).alias(f"__{k}{i}") for i, p in enumerate(place) for k, f in (("lo", F.floor), ("hi", F.ceil))])
    between = [F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * (p - F.floor(p)) for i, p in enumerate(place)]
    return out.select(*group, F.array(*between).alias("q"))


def value_ecdf(df: DataFrame, cols: list[str], target: str, slices: int = 64) -> DataFrame:
    """(feature, value, n0, n1, cum_n0, cum_n1) over the rows whose target is 0 or 1."""
    rows = long_values(df, cols, {"y": F.col(target)}).where("y IN (0, 1)")
    counts = rows.groupBy("feature", "value").agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"))
    return running_sums(counts, ["n0", "n1"], ["feature"], "value", slices)

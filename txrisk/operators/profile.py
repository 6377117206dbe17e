"""Profiles of a table and business figures, each in one or two aggregates whatever the number of columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import OUTLIERS, SKEW, VIF, label
from ..sources.tables import MISSING, NULL_LABEL, OTHER
from .ecdf import long_values, quantile_table, running_sums
from .fitted import quantiles
from .rank_corr import kendall


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def _long(df: DataFrame, entries: list[dict]) -> DataFrame:
    """One row of ``df`` as a row for each entry: {output name: column}."""
    return df.select(F.explode(F.array(*[F.struct(*[c.alias(n) for n, c in e.items()]) for e in entries])).alias("e")).select("e.*")


def value_counts(df: DataFrame, cols: list[str], null: str | None = None) -> DataFrame:
    """(column_name, value as text, n) of many columns in one exchange."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c).cast("string"), F.lit(null)).alias("value")) for c in cols]))
    return df.select(pairs.alias("p")).groupBy("p.column_name", "p.value").agg(F.count("*").alias("n"))


def general_structure(df: DataFrame, approximate: bool = False) -> DataFrame:
    """For each column: kind, binary or not, and counts and shares of distinct, null and zero values. Distinct values are counted over
    (column, value) pairs in one exchange with a map-side combine; ``approximate`` sketches them instead."""
    cols = df.columns
    kinds = {f.name: "numerica" if isinstance(f.dataType, T.NumericType) else "fecha" if isinstance(f.dataType, (T.TimestampType, T.DateType, T.TimestampNTZType)) else "categorica" for f in df.schema}
    one = [F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols], *[F.count_if(F.col(c) == 0).alias(f"zero_{c}") for c in cols if kinds[c] == "numerica"]]
    if approximate:
        one += [F.approx_count_distinct(c).alias(f"uniq_{c}") for c in cols]
    base = _long(df.agg(*one), [{"column_name": F.lit(c), "kind": F.lit(kinds[c]), "n_rows": F.col("n_rows"), "n_null": F.col(f"null_{c}"), "n_zero": F.col(f"zero_{c}") if kinds[c] == "numerica" else F.lit(None).cast("long"), **({"n_unique": F.col(f"uniq_{c}")} if approximate else {})} for c in cols])
    if not approximate:
        uniq = value_counts(df, cols).where("value IS NOT NULL").groupBy("column_name").agg(F.count("*").alias("n_unique"))
        base = base.join(uniq, "column_name", "left").withColumn("n_unique", F.coalesce("n_unique", F.lit(0)))
    share = lambda c: F.round(F.try_divide(F.col(c), F.col("n_rows")), 4)
    return base.select("column_name", "kind", (F.col("n_unique") == 2).alias("is_binary"), "n_unique", share("n_unique").alias("pct_unique"), "n_null", share("n_null").alias("pct_null"), "n_zero", share("n_zero").alias("pct_zero"))


def date_range_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    one = df.agg(*[f(c).alias(f"{k}_{c}") for c in cols for k, f in (("min", F.min), ("max", F.max), ("n", F.count))])
    days = lambda c: F.floor((F.unix_micros(F.col(f"max_{c}")) - F.unix_micros(F.col(f"min_{c}"))) / 86_400_000_000)
    return _long(one, [{"column_name": F.lit(c), "first": F.col(f"min_{c}"), "last": F.col(f"max_{c}"), "days_covered": days(c), "n": F.col(f"n_{c}")} for c in cols])


def id_like_columns(df: DataFrame, threshold: float = 0.9, sample: int = 50) -> DataFrame:
    """Columns that look like identifiers, and why: nearly unique, of prefix_hex values, or by name. Time columns are left out."""
    cols = [f.name for f in df.schema if not isinstance(f.dataType, (T.TimestampType, T.DateType, T.TimestampNTZType))]
    texts = set(string_columns(df))
    n_rows = df.agg(F.count("*").alias("n_rows"))
    uniq = value_counts(df, cols).where("value IS NOT NULL").groupBy("column_name").agg(F.count("*").alias("n_unique"))
    out = uniq.crossJoin(F.broadcast(n_rows)).withColumn("pct_unique", F.round(F.col("n_unique") / F.col("n_rows"), 4))
    prefixed = []
    for c in sorted(texts & set(cols)):  # a few values of each text column
        head = df.where(F.col(c).isNotNull()).select(F.col(c).alias("v")).limit(sample)
        prefixed.append(head.agg(F.lit(c).alias("p"), F.coalesce(F.avg(F.col("v").rlike("^[a-zA-Z]+_[0-9a-fA-F]+$").cast("int")) > 0.8, F.lit(False)).alias("prefix")))
    if prefixed:
        out = out.join(F.broadcast(reduce(DataFrame.union, prefixed)), F.col("column_name") == F.col("p"), "left").drop("p")
    else:
        out = out.withColumn("prefix", F.lit(False))
    prefix, named, unique = F.coalesce("prefix", F.lit(False)), F.lower("column_name").rlike("id|key|code|uuid"), F.col("pct_unique") >= threshold
    why = F.when(unique, "unique").when(prefix, "prefix").otherwise("name")
    return out.where(unique | prefix | named).select("column_name", "n_unique", "pct_unique", why.alias("reason"))


def period_of(time: str, freq: str):
    day = F.to_date(time)
    if freq == "D":
        return F.date_format(day, "yyyy-MM-dd")
    if freq == "W":
        monday = F.to_date(F.date_trunc("week", F.col(time)))
        return F.concat_ws("/", F.date_format(monday, "yyyy-MM-dd"), F.date_format(F.date_add(monday, 6), "yyyy-MM-dd"))
    if freq == "M":
        return F.date_format(day, "yyyy-MM")
    raise ValueError("freq must be D, W or M")


def target_by_period(df: DataFrame, time: str, target: str, freq: str = "D") -> DataFrame:
    rows = df.where(F.col(time).isNotNull()).groupBy(period_of(time, freq).alias("period")).agg(F.count(target).alias("n_total"), F.sum(F.col(target).cast("long")).alias("n_pos"))
    return rows.select("period", "n_total", "n_pos", (F.col("n_total") - F.col("n_pos")).alias("n_neg"), F.round(F.try_divide("n_pos", "n_total"), 4).alias("rate"))


def daily_amount(df: DataFrame, time: str, target: str, amount: str) -> DataFrame:
    """Amounts a day by class, 0 where there is none, with their total and the positives' share."""
    side = lambda v, n: F.coalesce(F.sum(F.when(F.col(target) == v, F.col(amount))), F.lit(0.0)).alias(n)
    out = df.where(F.col(time).isNotNull()).groupBy(period_of(time, "D").alias("period")).agg(side(0, "amount_neg"), side(1, "amount_pos"))
    total = F.col("amount_neg") + F.col("amount_pos")
    return out.select("period", F.round("amount_neg", 2).alias("amount_neg"), F.round("amount_pos", 2).alias("amount_pos"), F.round(total, 2).alias("amount_total"), F.round(F.try_divide(F.col("amount_pos"), total), 4).alias("pct_pos"))


def economic_impact(df: DataFrame, time: str, target: str, amount: str, margin: float = 0.25, loss: float = 1.0) -> DataFrame:
    """Gain of what was legitimate, loss of what was not, and their net: by day, and in a row TOTAL."""
    day = df.where(F.col(time).isNotNull()).withColumn("day", period_of(time, "D"))
    side = lambda v, n: F.coalesce(F.sum(F.when(F.col(target) == v, F.col(amount))), F.lit(0.0)).alias(n)
    out = day.rollup("day").agg(side(0, "amount_neg"), side(1, "amount_pos"), F.grouping("day").alias("is_total"))
    gain, lost = margin * F.col("amount_neg"), loss * F.col("amount_pos")
    return out.select(F.when(F.col("is_total") == 1, "TOTAL").otherwise(F.col("day")).alias("period"), F.round("amount_neg", 2).alias("amount_neg"), F.round("amount_pos", 2).alias("amount_pos"), F.round(gain, 4).alias("gain"), F.round(lost, 4).alias("loss"), F.round(gain - lost, 4).alias("net"))


def _ranked(df: DataFrame, cols: list[str]) -> DataFrame:
    counts = value_counts(df, cols, NULL_LABEL)
    n = df.agg(F.count("*").alias("n_rows"))
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    out = counts.crossJoin(F.broadcast(n)).withColumn("pct", F.round(F.col("n") / F.col("n_rows"), 4))
    return out.withColumn("pos", F.row_number().over(order)).withColumn("cum", F.sum("pct").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def categorical_concentration(df: DataFrame, cols: list[str], top_n: int = 10) -> DataFrame:
    """The commonest ``top_n`` categories of each column and one row for the rest. Shares are rounded before they are added up. Ties: by value."""
    ranked = _ranked(df, cols)
    head = ranked.where(F.col("pos") <= top_n).select("column_name", F.col("value").alias("category"), "n", "pct", F.round("cum", 4).alias("pct_cum"))
    rest = ranked.where(F.col("pos") > top_n).groupBy("column_name").agg(F.count("*").alias("c"), F.sum("n").alias("n"), F.round(F.sum("pct"), 4).alias("pct"))
    rest = rest.select("column_name", F.concat(F.lit("otros ("), F.col("c").cast("string"), F.lit(" categorías)")).alias("category"), "n", "pct", F.lit(1.0).alias("pct_cum"))
    return head.unionByName(rest)


def concentration_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    r = _ranked(df, cols)
    at = lambda n: F.col("pos") <= n
    return r.groupBy("column_name").agg(F.count("*").alias("n_categories"), F.max(F.when(at(1), F.col("value"))).alias("top1"), F.max(F.when(at(1), F.col("pct"))).alias("top1_pct"), F.round(F.sum(F.when(at(3), F.col("pct"))), 4).alias("top3_pct"), F.round(F.sum(F.col("pct") * F.col("pct")), 4).alias("hhi"))


def numeric_distribution(df: DataFrame, cols: list[str]) -> DataFrame:
    """Moments, quartiles, bias-corrected skewness and values beyond 1.5 interquartile ranges: quartiles of all columns from one table of value
    counts, then one aggregate for the rest. Columns are given by the caller; a column of nulls has nulls."""
    x = lambda c: F.col(c).cast("double")
    quarters = {c: q or [None] * 3 for c, q in quantiles(df, cols, [0.25, 0.5, 0.75]).items()}
    ends = {c: (q[0] - 1.5 * (q[2] - q[0]), q[2] + 1.5 * (q[2] - q[0])) if q[0] is not None else (0.0, 0.0) for c, q in quarters.items()}
    first = df.agg(*[e.alias(f"{k}_{c}") for c in cols for k, e in (("n", F.count(c)), ("mean", F.avg(x(c))), ("out", F.count_if((x(c) < ends[c][0]) | (x(c) > ends[c][1]))), ("std", F.stddev_samp(x(c))), ("min", F.min(x(c))), ("max", F.max(x(c))), ("g", F.skewness(x(c))))])
    rows = _long(first, [{"column_name": F.lit(c), "n": F.col(f"n_{c}"), "mean": F.col(f"mean_{c}"), "median": F.lit(quarters[c][1]).cast("double"), "std": F.col(f"std_{c}"), "min": F.col(f"min_{c}"), "max": F.col(f"max_{c}"), "g": F.col(f"g_{c}"), "n_outliers": F.col(f"out_{c}")} for c in cols])
    n = F.col("n").cast("double")
    rows = rows.withColumn("skew", F.when(n > 2, F.nanvl(F.col("g"), F.lit(None)) * F.sqrt(n * (n - 1)) / (n - 2))).withColumn("pct_outliers", F.round(F.coalesce(F.try_divide("n_outliers", "n"), F.lit(0.0)), 4))
    return rows.select("column_name", *[F.round(c, 4).alias(c) for c in ("mean", "median", "std", "min", "max", "skew")], label(F.abs("skew"), SKEW, closed=True).alias("skew_label"), "n_outliers", "pct_outliers", label(F.col("pct_outliers"), OUTLIERS, closed=True).alias("outlier_label"))


def category_rate(df: DataFrame, col: str, target: str, min_support: int = 30) -> DataFrame:
    """Rate and lift of each category with enough rows; the lift is that of the rounded rate."""
    mean = df.agg(F.avg(target).alias("__mean"))
    out = df.groupBy(F.coalesce(F.col(col).cast("string"), F.lit(NULL_LABEL)).alias("category")).agg(F.count(target).alias("n_total"), F.sum(F.col(target).cast("long")).alias("n_pos")).where(F.col("n_total") >= min_support)
    out = out.crossJoin(F.broadcast(mean)).withColumn("rate", F.round(F.col("n_pos") / F.col("n_total"), 4))
    return out.select("category", "n_total", "n_pos", "rate", F.round(F.try_divide("rate", "__mean"), 2).alias("lift"))


def mid_ranks(df: DataFrame, cols: list[str], key: str) -> DataFrame:
    """``df`` as (key, column_name, rank): average ranks with ties, from the running sums of value counts; rows without a value have none."""
    long = long_values(df, cols, {key: F.col(key)})
    counts = running_sums(long.groupBy("feature", "value").agg(F.count("*").alias("n")), ["n"], ["feature"], "value")
    ranks = counts.select("feature", "value", (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2).alias("rank"))
    return long.join(ranks, ["feature", "value"]).select(key, F.col("feature").alias("column_name"), "rank")


def correlation_matrix(df: DataFrame, cols: list[str], method: str = "pearson", key: str | None = None) -> DataFrame:
    """(variable_1, variable_2, corr) for each pair of columns, over rows that have both, all pairs in one aggregate. ``spearman`` puts average
    ranks of each column in place of its values; it needs a unique ``key``. ``kendall`` is tau-b."""
    if method == "kendall":
        return kendall(df, cols)
    if method == "spearman":
        ranks = mid_ranks(df, cols, key)
        df = ranks.groupBy(key).pivot("column_name", cols).agg(F.max("rank"))
    elif method != "pearson":
        raise ValueError("method must be pearson, spearman or kendall")
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    both = lambda a, b: F.nanvl(F.corr(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(None).cast("double"))
    one = df.agg(*[both(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    entries = [{"variable_1": F.lit(x), "variable_2": F.lit(y), "corr": F.col(f"r{i}")} for i, (a, b) in enumerate(pairs) for x, y in dict.fromkeys([(a, b), (b, a)])]
    return _long(one, entries)


def correlation_with_target(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    one = df.agg(*[F.nanvl(F.corr(F.col(c).cast("double"), F.col(target).cast("double")), F.lit(None).cast("double")).alias(c) for c in cols])
    rows = _long(one, [{"column_name": F.lit(c), "r": F.col(c)} for c in cols])
    return rows.select("column_name", F.round("r", 4).alias("corr"), F.round(F.abs("r"), 4).alias("abs_corr"))


def high_correlation_pairs(df: DataFrame, cols: list[str], threshold: float = 0.7) -> DataFrame:
    rank = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    pairs = correlation_matrix(df, cols).where(rank[F.col("variable_1")] < rank[F.col("variable_2")])
    return pairs.where(F.abs("corr") >= threshold).select("variable_1", "variable_2", F.round("corr", 4).alias("corr"))


def vif(df: DataFrame, cols: list[str]) -> DataFrame:
    """Variance inflation over complete rows: the diagonal of the inverse of the k x k correlation matrix, which is all that reaches the driver."""
    import numpy as np

    rows = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    k = len(cols)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = rows.agg(F.count("*").alias("n"), *[F.corr(cols[i], cols[j]).alias(f"r{i}_{j}") for i, j in pairs]).first()
    r = np.eye(k)
    for i, j in pairs:
        r[i, j] = r[j, i] = got[f"r{i}_{j}"] if got[f"r{i}_{j}"] is not None else np.nan
    ok = np.isfinite(r).all()
    inverse = np.linalg.pinv(r) if ok else r * np.nan
    data = [(c, float(inverse[i, i]) if ok else None, int(got["n"])) for i, c in enumerate(cols)]
    out = df.sparkSession.createDataFrame(data, "column_name string, vif double, n_rows long")
    return out.select("column_name", F.round("vif", 4).alias("vif"), label(F.col("vif"), VIF, closed=True).alias("multicollinearity"), "n_rows")


def week_summary(df: DataFrame, week: str, time: str, target: str) -> DataFrame:
    return df.groupBy(week).agg(F.count("*").alias("n"), F.round(F.avg(target) * 100, 4).alias("rate_pct"), F.min(F.to_date(time)).alias("first_day"), F.max(F.to_date(time)).alias("last_day"))


def null_rate_by_week(df: DataFrame, week: str, cols: list[str]) -> DataFrame:
    one = df.groupBy(week).agg(*[F.round(F.avg(F.col(c).isNull().cast("int")) * 100, 4).alias(c) for c in cols])
    return one.select(week, F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("pct_null")) for c in cols])).alias("e")).select(week, "e.*")


def null_share(df: DataFrame, cols: list[str]) -> DataFrame:
    return _long(df.agg(*[F.round(F.avg(F.col(c).isNull().cast("int")), 6).alias(c) for c in cols]), [{"column_name": F.lit(c), "share": F.col(c)} for c in cols])


def label_distribution(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(F.col(col).alias("label")).agg(F.count("*").alias("n"))


def histogram_by_group(df: DataFrame, cols: list[str], group: str, bins: int = 40) -> DataFrame:
    """(column_name, group, bin, low, n, density) with ``bins`` equal widths over each group's own range. The highest value falls in the last
    bin; a group of one value has one bin of width 1; empty bins have no row."""
    long = df.select(F.col(group).alias("grp"), F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in cols])).alias("p")).select("grp", "p.*").where("v IS NOT NULL AND grp IS NOT NULL")
    span = long.groupBy("column_name", "grp").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("total"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0)
    binned = long.join(span.withColumn("width", width), ["column_name", "grp"])  # broadcast or not by its size
    at = F.least(F.floor((F.col("v") - F.col("lo")) / F.col("width")), F.lit(bins - 1)).cast("int")
    out = binned.groupBy("column_name", "grp", at.alias("bin")).agg(F.first("lo").alias("lo"), F.first("width").alias("width"), F.first("total").alias("total"), F.count("*").alias("n"))
    return out.select("column_name", F.col("grp").alias("group"), "bin", F.round(F.col("lo") + F.col("bin") * F.col("width"), 6).alias("low"), "n", F.round(F.col("n") / (F.col("total") * F.col("width")), 8).alias("density"))


def box_stats_by_group(df: DataFrame, cols: list[str], group: str) -> DataFrame:
    """Quartiles and whiskers: the last values within 1.5 interquartile ranges of the box."""
    long = df.select(F.col(group).alias("grp"), F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in cols])).alias("p")).select("grp", "p.*").where("v IS NOT NULL AND grp IS NOT NULL")
    q = quantile_table(long, ["column_name", "grp"], "v", [0.25, 0.5, 0.75])
    q = q.select("column_name", "grp", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    near = long.join(q, ["column_name", "grp"]).where("v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)")  # broadcast or not by its size
    ends = near.groupBy("column_name", "grp").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return q.join(ends, ["column_name", "grp"]).select("column_name", F.col("grp").alias("group"), *[F.round(c, 6).alias(c) for c in ("low", "q1", "median", "q3", "high")])


def category_share_by_week(df: DataFrame, col: str, week: str, reference: int = 0, top: int = 6) -> DataFrame:
    """Shares of the reference week's commonest ``top`` categories (null is one) and of all others, for each week; 0 where a week has none."""
    rows = df.select(F.col(week).alias("week"), F.coalesce(F.col(col).cast("string"), F.lit(MISSING)).alias("category"))
    counts = rows.groupBy("week", "category").agg(F.count("*").alias("n"))
    best = counts.where(F.col("week") == reference).orderBy(F.desc("n"), "category").limit(top).select("category")
    names = best.select(F.col("category").alias("top"))
    grouped = counts.join(F.broadcast(names), F.col("category") == F.col("top"), "left").groupBy("week", F.coalesce("top", F.lit(OTHER)).alias("category")).agg(F.sum("n").alias("n"))
    frame = counts.select("week").distinct().crossJoin(F.broadcast(best.union(df.sparkSession.createDataFrame([(OTHER,)], "category string"))))  # top + 1 rows
    total = counts.groupBy("week").agg(F.sum("n").alias("total"))
    out = frame.join(grouped, ["week", "category"], "left").join(total, "week")
    return out.select("week", "category", F.round(F.coalesce("n", F.lit(0)) / F.col("total"), 6).alias("share"))

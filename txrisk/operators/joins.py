"""Joins, lookups and small-set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).count().where("count > 1")


def consolidate(base: DataFrame, *others: DataFrame, key: str = "k", check: bool = True) -> DataFrame:
    """Feature tables put side by side by key, a row for each row of ``base``. With ``check``, a key that comes twice in any of them is an
    error before the join. Where the features are made from one table, add columns there instead: that needs no join."""
    for df in (base, *others) if check else ():
        if not duplicate_keys(df, key).isEmpty():
            raise ValueError(f"{key} is not unique: the join is not one to one")
    return reduce(lambda a, b: a.join(b, key, "left"), others, base)


def map_lookup(df: DataFrame, table: DataFrame, col: str, key: str, value: str, name: str) -> DataFrame:
    """The value of a category, null where the table has none. Null is a category too, whose value is looked up outside the join; of several rows
    for it the largest counts."""
    of_null = table.where(F.col(key).isNull()).agg(F.max(value).alias("__of_null"))  # one row
    side = table.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.col(value).alias("__value"))
    both = df.join(side, F.col(col) == F.col("__key"), "left").crossJoin(F.broadcast(of_null))
    return both.withColumn(name, F.when(F.col(col).isNull(), F.col("__of_null")).otherwise(F.col("__value"))).drop("__key", "__value", "__of_null")


def top_categories(df: DataFrame, col: str, n: int) -> DataFrame:
    """The ``n`` commonest values, by count and then by value; null doesn't count."""
    return df.where(F.col(col).isNotNull()).groupBy(col).count().orderBy(F.desc("count"), col).limit(n).select(F.col(col).alias("top"))


def isin_top(df: DataFrame, col: str, n: int, name: str = "in_top") -> DataFrame:
    """1 for one of the commonest ``n`` values. The set has n rows, so it is broadcast."""
    top = top_categories(df, col, n).withColumn("__in", F.lit(1))
    return df.join(F.broadcast(top), F.col(col) == F.col("top"), "left").withColumn(name, F.coalesce("__in", F.lit(0))).drop("top", "__in")


def unseen_categories(train: DataFrame, new: DataFrame, cols: list[str]) -> DataFrame:
    """Values of ``new`` that training never had: (column_name, value, n)."""
    parts = [new.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).join(train.select(F.col(c).cast("string").alias("value")).distinct(), "value", "left_anti").select(F.lit(c).alias("column_name"), "value", "n") for c in cols]
    return reduce(DataFrame.unionByName, parts)


def feature_vs_origin(metrics: DataFrame, origins: DataFrame) -> DataFrame:
    """Each feature's AUC beside that of the column it comes from. ``metrics``: (variable, auc_abs); ``origins``: (variable, origin)."""
    base = metrics.select(F.col("variable").alias("origin"), F.col("auc_abs").alias("origin_auc"))
    out = origins.join(metrics.select("variable", "auc_abs"), "variable").join(base, "origin", "left")
    return out.withColumn("delta", F.col("auc_abs") - F.col("origin_auc")).withColumn("improved", F.col("delta") > 0)


def best_per_group(df: DataFrame, group: str, by: str, tie: str) -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.desc_nulls_last(by), tie)
    return df.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def top_k(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(by), tie).limit(k)


def bottom_k(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.asc_nulls_last(by), tie).limit(k)


def stack(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)

"""Row features: plain column expressions without a fit. Each says what a null gives."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def log_feature(col, offset: float = 0.0) -> Column:
    """log(1 + x + offset); null at or below -1 and for null."""
    x = _c(col).cast("double") + offset
    return F.when(x > -1, F.log1p(x))


def missing_flag(col) -> Column:
    return _c(col).isNull().cast("int")


def zero_flag(col, value: float = 0) -> Column:
    """1 where equal to ``value``; null gives 0."""
    return F.coalesce(_c(col) == value, F.lit(False)).cast("int")


def hour(ts) -> Column:
    return F.hour(_c(ts))


def weekday(ts) -> Column:
    """Monday 0 to Sunday 6."""
    return F.weekday(_c(ts))


def is_weekend(ts, off_days: tuple[int, ...] = (5, 6)) -> Column:
    """1 on one of the days off; null gives 0."""
    return F.coalesce(F.weekday(_c(ts)).isin(*off_days), F.lit(False)).cast("int")


def hour_cyclic(ts, component: str, cycle_length: int = 24) -> Column:
    if component not in ("sin", "cos"):
        raise ValueError("component must be 'sin' or 'cos'")
    return getattr(F, component)(F.hour(_c(ts)) * (2 * math.pi) / cycle_length)


def ratio(numerator, denominator, default: float | None = None) -> Column:
    """The quotient; ``default`` over a zero denominator; null for a null on either side."""
    a, b = _c(numerator).cast("double"), _c(denominator).cast("double")
    return F.when(a.isNull() | b.isNull(), None).when(b == 0, F.lit(default).cast("double")).otherwise(a / b)


def coerce_numeric(col) -> Column:
    """A number of a text; null where it is none, and for NaN."""
    x = _c(col).try_cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))


def coerce_timestamp(col) -> Column:
    return F.try_to_timestamp(_c(col).cast("string"))


def week_index(ts, first) -> Column:
    """Whole weeks since the day ``first``."""
    return F.floor(F.datediff(F.to_date(_c(ts)), F.to_date(_c(first))) / 7).cast("int")


def with_week_index(df: DataFrame, time: str, name: str = "week") -> DataFrame:
    """``df`` with the weeks since its first day; the minimum is one row, joined by broadcast."""
    first = df.agg(F.min(time).alias("__first"))
    return df.crossJoin(F.broadcast(first)).withColumn(name, week_index(time, "__first")).drop("__first")


def decide(score, threshold: float) -> Column:
    return F.when(_c(score) >= threshold, 1).otherwise(0)


def drop_roles(df: DataFrame, *roles: str) -> DataFrame:
    """The feature columns: all but the key, the target and what else is named."""
    return df.drop(*roles)


def classify_columns(df: DataFrame, categorical: tuple[str, ...] = (), skip: tuple[str, ...] = (), suffixes: tuple[str, ...] = ("_bin", "_grouped", "_missing", "_is_zero", "_flag", "_top1pct")) -> dict[str, list[str]]:
    """Continuous and categorical columns by the schema alone: strings, names given and names with one of these endings are categorical,
    other numbers continuous, times and skipped columns neither."""
    out: dict[str, list[str]] = {"continuous": [], "categorical": []}
    for f in df.schema:
        if f.name in skip or isinstance(f.dataType, (T.TimestampType, T.DateType, T.TimestampNTZType)):
            continue
        if f.name in categorical or isinstance(f.dataType, T.StringType) or f.name.endswith(suffixes):
            out["categorical"].append(f.name)
        elif isinstance(f.dataType, T.NumericType):
            out["continuous"].append(f.name)
    return out


def complete_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.dropna(subset=cols)


def complete_rows_report(df: DataFrame, cols: list[str]) -> DataFrame:
    """(used, dropped) rows for an analysis of ``cols``."""
    whole = F.lit(True)
    for c in cols:
        whole = whole & F.col(c).isNotNull()
    return df.agg(F.count_if(whole).alias("used"), F.count_if(~whole).alias("dropped"))


def filter_by_label(df: DataFrame, col: str, *values) -> DataFrame:
    return df.where(F.col(col).isin(*values))




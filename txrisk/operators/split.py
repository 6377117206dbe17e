"""Splits by time that put no day on two sides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import row_position


def day_starts(df: DataFrame, time: str) -> list[tuple]:
    """(day, rows before it) for each day in order: one row a day, the only thing that reaches the driver."""
    days = df.where(F.col(time).isNotNull()).groupBy(F.to_date(time).alias("day")).count().orderBy("day").collect()
    out, n = [], 0
    for r in days:
        out.append((r["day"], n))
        n += r["count"]
    return [*out, (None, n)]


def aligned_cut(starts: list[tuple], index: int):
    """The day whose first row is nearest to the row number ``index``, the earlier of two as near, and its row number."""
    inner = starts[1:-1]
    n = starts[-1][1]
    if index <= 0 or index >= n or not inner:
        return (starts[0] if index <= 0 else starts[-1]) if starts else (None, 0)
    return min(inner, key=lambda s: (abs(s[1] - index), s[1]))


def time_split(df: DataFrame, time: str, key: str, test_size: float = 0.2, val_size: float | None = None, strategy: str = "split_last", align_to_day: bool = True) -> DataFrame:
    """``df`` with ``side``: train, val or test, by time.

    Without ``val_size``: the first ``1 - test_size`` of the rows train, the rest test. ``split_last``: train, val and test follow each other;
    ``same_period``: the last ``test_size + val_size`` alternate, even rows val, odd rows test. With ``align_to_day`` a cut moves to the nearest
    start of a day and is then a plain filter on the day; without it, rows are cut at the exact count, equal times in key order. Rows
    without a time are left out.
    """
    if strategy not in ("split_last", "same_period"):
        raise ValueError("strategy must be 'split_last' or 'same_period'")
    rows = df.where(F.col(time).isNotNull())
    starts = day_starts(rows, time)
    n = starts[-1][1]
    test_at = int(n * (1 - test_size))
    train_at = test_at if val_size is None else int(n * (1 - test_size - val_size))
    alternate = val_size is not None and strategy == "same_period"
    if align_to_day and not alternate:
        train_day, test_day = aligned_cut(starts, train_at), aligned_cut(starts, test_at)
        test_day = max(train_day, test_day, key=lambda s: s[1])
        before = lambda cut: F.lit(True) if cut[0] is None else F.to_date(time) < F.lit(cut[0])
        side = F.when(before(train_day), "train").otherwise("test") if val_size is None else F.when(before(train_day), "train").when(before(test_day), "val").otherwise("test")
        return rows.withColumn("side", side)
    if align_to_day:
        train_at = aligned_cut(starts, train_at)[1]
    cuts = [train_at] if val_size is None or alternate else [train_at, max(train_at, test_at)]
    days = [(day, first, end) for (day, first), (_, end) in zip(starts, starts[1:])]
    day_of = F.to_date(time)
    # only the days that a cut falls into, or all from there on where rows alternate, are put in order
    if alternate:
        loose = [(day_of >= day, first) for day, first, end in days if end > train_at][:1]
    else:
        loose = [(day_of == day, first) for day, first, end in days if any(first < c < end for c in cuts)]
    placed = rows.where(~reduce(Column.__or__, [x for x, _ in loose], F.lit(False))).withColumn("__at", F.lit(None).cast("long"))
    for some, first in loose:
        placed = placed.unionByName(row_position(rows.where(some), time, key, "__at").withColumn("__at", F.col("__at") + first))
    before = lambda c: F.coalesce(F.col("__at") < c, day_of <= F.lit(max((day for day, _, end in days if end <= c), default=None)))
    side = F.when(before(train_at), "train")
    if alternate:
        side = side.when((F.col("__at") - train_at) % 2 == 0, "val")
    elif val_size is not None:
        side = side.when(before(cuts[1]), "val")
    return placed.withColumn("side", side.otherwise("test")).drop("__at")


def shared_days(a: DataFrame, b: DataFrame, time: str) -> DataFrame:
    """Days that both sides have; none, if the split is clean."""
    day = lambda x: x.where(F.col(time).isNotNull()).select(F.to_date(time).alias("day"))
    return day(a).intersect(day(b))


def split_report(sides: DataFrame, time: str, target: str) -> DataFrame:
    """Rows, days and rate of each side."""
    return sides.groupBy("side").agg(F.count("*").alias("n_rows"), F.min(F.to_date(time)).alias("first_day"), F.max(F.to_date(time)).alias("last_day"), F.avg(target).alias("rate"))


def distinct_days(df: DataFrame, time: str, test_days: int = 14) -> DataFrame:
    """Days in the table, and the share of the rows that so many of them stand for."""
    return df.agg(F.count_distinct(F.to_date(time)).alias("n_days")).withColumn("test_share", test_days / F.col("n_days"))


def week_labels(df: DataFrame, period: str) -> DataFrame:
    """``semana_1``, ``semana_2``, ... in order of ``period``, on a table of one row a week."""
    return df.withColumn("label", F.concat(F.lit("semana_"), F.row_number().over(Window.orderBy(period)).cast("string")))

"""Places and running sums in an order over a whole table, without a task that sees more than its range of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize


def ordered(df: DataFrame, order: list, by: list[str] = (), name: str = "position", count: str | None = None, sums: dict[str, str] | None = None) -> DataFrame:
    """``df`` with each row's place, from 0, among the rows of its group ``by`` (no group: all rows) in ``order``, columns or sort orders.

    ``count`` names a column for the rows of the group; ``sums`` maps new columns to ones that they sum up in that order, the row itself included, over its group.
    Nulls of ``by`` are a group. Rows that ``order`` doesn't tell apart get places of their own in some order; an empty table stays empty.

    The rows are dealt to ranges of (by, order) at splitters that Spark samples, sorted inside each and written once, so that a place can't change when a task is
    run again. The rows of each range and group are counted; a row's place is what the ranges before it hold of its group, and its place in its own. A group of any size, and
    many rows of one value, are cut wherever ``order`` tells rows apart. The written table is the result's to ``release``."""
    first = [F.col(f"`{c}`").asc_nulls_first() for c in by]
    dealt = df.repartitionByRange(*first, *order).sortWithinPartitions(*first, *order)
    rows = materialize(dealt.withColumns({"__range": F.spark_partition_id(), "__row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "ordered")
    totals = {new: F.sum(old).alias(new) for new, old in (sums or {}).items()}
    cells = rows.groupBy("__range", *by).agg(F.count("*").alias("__n"), F.min("__row").alias("__least"), *totals.values())
    group = Window.partitionBy(*by)  # a row for each range that the group has rows in
    before = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    cells = cells.select(F.col("__range").alias("__r"), *[F.col(f"`{c}`").alias(f"__by{i}") for i, c in enumerate(by)], "__least", ahead("__n").alias("__ahead"), F.sum("__n").over(group).alias("__all"), *[ahead(c).alias(f"__ahead_{c}") for c in totals])
    here = reduce(Column.__and__, [F.col(f"`{c}`").eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by)], F.col("__range") == F.col("__r"))
    out = rows.join(cells, here).withColumn(name, F.col("__row") - F.col("__least") + F.col("__ahead"))
    if count:
        out = out.withColumn(count, F.col("__all"))
    inside = Window.partitionBy("__range", *by).orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
    for new, old in (sums or {}).items():
        out = out.withColumn(new, F.sum(old).over(inside) + F.col(f"__ahead_{new}"))
    out = out.select(*[F.col(f"`{c}`") for c in df.columns], name, *([count] if count else []), *(sums or {}))
    out._scratch_path = rows._scratch_path
    return out

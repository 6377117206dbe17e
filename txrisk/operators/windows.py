"""Causal rolling aggregates per entity: only rows of [t - w, t) count for a row at t."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..roles import Roles
from .order import ordered

#: Window lengths in microseconds.
HOUR = 3_600_000_000
WINDOWS = {"1h": HOUR, "1d": 24 * HOUR, "3d": 72 * HOUR, "7d": 168 * HOUR, "10d": 240 * HOUR, "15d": 360 * HOUR}
AGGREGATES = ("sum", "mean", "median", "max", "min")
#: Entities with more rows than this in a stretch as long as the longest window are worked through in blocks.
CROWDED = 4000


def window_length(name: str) -> int:
    if name not in WINDOWS:
        raise ValueError(f"unknown window {name!r}: one of {', '.join(WINDOWS)}")
    return WINDOWS[name]


def _aggregate(kind: str, value: str) -> Column:
    if kind == "median":
        return F.expr(f"percentile(`{value}`, 0.5D)")  # median() takes no frame
    return {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}[kind](value)


def velocity_grid(df: DataFrame, values: tuple[str, ...] = ("monto",), windows: tuple[str, ...] = tuple(WINDOWS), aggregates: tuple[str, ...] = AGGREGATES, roles: Roles = Roles(), buckets: bool = False, crowded: int = CROWDED) -> DataFrame:
    """``df`` with ``{value}_{aggregate}_{window}`` for each combination: the aggregate over the entity's rows of [t - w, t). Rows of the same
    time don't count, the lower bound does; null where there is none, for a null entity and for a null time.

    All frames share one partitioning and one order, so the whole grid costs one exchange and one sort. With ``buckets`` an
    entity's rows are cut by time into stretches as long as the longest window, and each stretch also gets the rows of the one before
    as context: a busy entity is then dealt over many tasks, for twice the rows.

    A frame is read anew for each row, which is the square of the rows in a window. So entities with more than ``crowded`` rows in one stretch, if a count
    finds any, get their sums, means, minima and maxima in time that grows with their rows (``_in_blocks``), and their medians in little more (``_medians``).
    """
    wide = max(window_length(w) for w in windows)
    rows = df.withColumn("__t", F.unix_micros(F.col(roles.time).cast("timestamp")))
    known = F.col(roles.entity).isNotNull() & F.col("__t").isNotNull()
    busy = rows.where(known).groupBy(F.col(roles.entity).alias("__busy"), F.floor(F.col("__t") / wide).alias("__s")).count().where(F.col("count") > crowded).select("__busy").distinct()
    if busy.isEmpty():
        return _in_frames(rows, values, windows, aggregates, roles, buckets).drop("__t")
    marked = rows.join(busy, known & (F.col(roles.entity) == F.col("__busy")), "left")
    quiet = _in_frames(marked.where("__busy IS NULL").drop("__busy"), values, windows, aggregates, roles, buckets)
    loud = marked.where("__busy IS NOT NULL").drop("__busy")
    plain = [x for x in aggregates if x != "median"]
    for w in windows:
        if plain:
            loud = _in_blocks(loud, values, w, plain, roles)
        if "median" in aggregates:
            loud = _medians(loud, values, w, roles)
    return quiet.unionByName(loud).drop("__t")


def _in_frames(rows: DataFrame, values, windows, aggregates, roles: Roles, buckets: bool) -> DataFrame:
    """The grid by one window frame for each combination; ``rows`` has __t."""
    wide = max(window_length(w) for w in windows)
    known = F.col(roles.entity).isNotNull() & F.col("__t").isNotNull()
    # rows that have no frame are spread over tasks by their key instead of forming one partition of nulls
    rows = rows.withColumn("__none", F.when(known, F.lit(0).cast("long")).otherwise(F.xxhash64(roles.key)))
    keys = [roles.entity, "__none"]
    if buckets:
        stretch = F.floor(F.col("__t") / wide)
        rows = rows.withColumn("__copy", F.explode(F.when(known, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).withColumn("__stretch", F.coalesce(stretch, F.lit(0)) + F.col("__copy"))
        keys.append("__stretch")
    over = Window.partitionBy(*keys).orderBy("__t")
    grid = {f"{v}_{a}_{w}": F.when(known, _aggregate(a, v).over(over.rangeBetween(-window_length(w), -1))) for w in windows for v in values for a in aggregates}
    out = rows.withColumns(grid)
    if buckets:
        out = out.where("__copy = 0")
    return out.drop("__none", "__copy", "__stretch")


def _in_blocks(rows: DataFrame, values, window: str, aggregates, roles: Roles) -> DataFrame:
    """The columns of one window length w, in linear time, for rows with an entity and a time. Time is cut into blocks as long as w, so that [t - w, t) is the end of one
    block from t - w on and the start of the next up to t. Each block holds its own rows and a copy of the block before, put later by w:
    running aggregates in the order of time give the start, and in the opposite order those copies give the end. An entity is
    dealt over as many tasks as it has blocks."""
    w = window_length(window)
    copies = rows.withColumn("__copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("__block", F.floor(F.col("__t") / w) + F.col("__copy"))
    copies = copies.withColumn("__at", F.col("__t") + w * F.col("__copy")).withColumn("__back", -F.col("__at"))
    keys = Window.partitionBy(roles.entity, "__block")
    start, end = keys.orderBy("__at").rangeBetween(Window.unboundedPreceding, -1), keys.orderBy("__back").rangeBetween(Window.unboundedPreceding, 0)
    part = lambda agg, v, copy, over: agg(F.when(F.col("__copy") == copy, F.col(v))).over(over)
    needed = sorted({"min": ["min"], "max": ["max"], "sum": ["sum"], "mean": ["sum", "count"]}[a][i] for a in aggregates for i in range(2 if a == "mean" else 1))
    functions = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.count}
    halves = {f"__{v}_{x}_{side}": part(functions[x], v, copy, over) for v in values for x in dict.fromkeys(needed) for side, copy, over in (("start", 0, start), ("end", 1, end))}
    out = copies.withColumns(halves).where("__copy = 0")

    def whole(v: str, x: str) -> Column:
        a, b = F.col(f"__{v}_{x}_start"), F.col(f"__{v}_{x}_end")
        if x in ("min", "max"):
            return {"min": F.least, "max": F.greatest}[x](a, b)  # nulls don't count
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)

    made = {f"{v}_{a}_{window}": F.when(whole(v, "count") > 0, whole(v, "sum") / whole(v, "count")) if a == "mean" else whole(v, a) for v in values for a in aggregates}
    return out.withColumns(made).drop("__copy", "__block", "__at", "__back", *halves)


def range_medians(values, low, high):
    """The median of ``values[low:high]`` for each pair of bounds, null values (NaN) left out; NaN for none. A wavelet matrix: the values' ranks are parted by one bit after the other,
    and each range is followed down to its middle, all ranges at once, in time that grows with the rows and the logarithm of the distinct values."""
    import numpy as np

    known = ~np.isnan(values)
    kept = np.concatenate([[0], np.cumsum(known)])
    distinct, ranks = np.unique(values[known], return_inverse=True)
    low, high = kept[low], kept[high]
    n = high - low
    if not len(distinct):
        return np.full(len(n), np.nan)
    levels, now = [], ranks.astype(np.int64)
    for bit in range(int(len(distinct) - 1).bit_length() - 1, -1, -1):
        one = (now >> bit) & 1
        levels.append(np.concatenate([[0], np.cumsum(1 - one)]))
        now = np.concatenate([now[one == 0], now[one == 1]])

    def smallest(k):
        a, b, at = low.copy(), high.copy(), np.zeros(len(k), dtype=np.int64)
        for zeros in levels:
            za, zb = zeros[a], zeros[b]
            up = k >= zb - za
            k = np.where(up, k - (zb - za), k)
            a, b = np.where(up, zeros[-1] + a - za, za), np.where(up, zeros[-1] + b - zb, zb)
            at = at * 2 + up
        return distinct[np.minimum(at, len(distinct) - 1)]

    middle = (smallest(np.maximum(n - 1, 0) // 2) + smallest(np.maximum(n, 1) // 2)) / 2
    return np.where(n > 0, middle, np.nan)


def range_folds(values, low, high, fold, none):
    """``fold`` (add, minimum, maximum) over ``values[low:high]`` for each pair of bounds, ``none`` for no values. Folds of 1, 2, 4, ... values are put together, all ranges at once,
    in time that grows with the rows and the logarithm of the longest range; nothing is taken off a sum again."""
    import numpy as np

    out, at, left, width = np.full(len(low), none), np.array(low), np.asarray(high) - low, 1
    while (left > 0).any():
        odd = left % 2 == 1
        out[odd] = fold(out[odd], values[at[odd]])
        at[odd] += width
        left = left // 2
        values, width = fold(values[:-width], values[width:]), 2 * width
    return out


def _medians(rows: DataFrame, values, window: str, roles: Roles) -> DataFrame:
    """The medians of one window length w, for rows with an entity and a time. As in ``_in_blocks`` time is cut into blocks as long as w, and a block gets the times and
    values of the one before as well; a task holds these numbers of one block of an entity, and the rows themselves of the block. Other columns pass through as they are."""
    w, columns = window_length(window), rows.columns
    dealt = rows.select(F.col(roles.entity).alias("__entity"), "__t", *[F.col(v).cast("double").alias(f"__v{i}") for i, v in enumerate(values)], F.struct("*").alias("__row"), F.explode(F.array(F.lit(0), F.lit(1))).alias("__copy"))
    dealt = dealt.withColumn("__block", F.floor(F.col("__t") / w) + F.col("__copy")).withColumn("__row", F.when(F.col("__copy") == 0, F.col("__row")))

    def run(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        table = table.take(pc.sort_indices(table, [("__t", "ascending")]))
        own = pc.equal(table["__copy"], 0)
        t = table["__t"].to_numpy()
        at = t[own.to_numpy()]
        low, high = np.searchsorted(t, at - w, "left"), np.searchsorted(t, at, "left")
        out = {"__row": table["__row"].filter(own)}
        for i in range(len(values)):
            column = table[f"__v{i}"].to_numpy().astype(np.float64)  # null is NaN
            out[f"__m{i}"] = pa.array(range_medians(column, low, high), pa.float64(), from_pandas=True)
        return pa.table(out)

    kind = T.StructType([dealt.schema["__row"], *[T.StructField(f"__m{i}", T.DoubleType()) for i in range(len(values))]])
    made = dealt.groupBy("__entity", "__block").applyInArrow(run, kind)
    return made.select(*[F.col("__row").getField(c).alias(c) for c in columns], *[F.col(f"__m{i}").alias(f"{v}_median_{window}") for i, v in enumerate(values)])


def with_history(new: DataFrame, history: DataFrame, values: tuple[str, ...] = ("monto",), windows: tuple[str, ...] = tuple(WINDOWS), aggregates: tuple[str, ...] = AGGREGATES, roles: Roles = Roles()) -> DataFrame:
    """The grid for the rows of ``new``, whose frames also see the rows of ``history``. History older than the longest window before the
    first new row is pruned before the exchange."""
    wide = max(window_length(w) for w in windows)
    first = new.agg(F.min(F.unix_micros(F.col(roles.time).cast("timestamp"))).alias("__first"))
    columns = list(dict.fromkeys([roles.key, roles.entity, roles.time, *values]))
    old = history.select(columns).crossJoin(F.broadcast(first)).where(F.unix_micros(F.col(roles.time).cast("timestamp")) >= F.col("__first") - wide).drop("__first")
    both = new.withColumn("__new", F.lit(True)).unionByName(old.withColumn("__new", F.lit(False)), allowMissingColumns=True)
    return velocity_grid(both, values, windows, aggregates, roles).where("__new").drop("__new")


def row_position(df: DataFrame, time: str, key: str, name: str = "position") -> DataFrame:
    """``df`` with each row's place in time order, from 0; equal times in order of the key, null times last, null keys first.

    The rows are dealt to sampled ranges of (time, key) of any type (``ordered``), so neither a day of one date nor a skewed key makes a large task."""
    return ordered(df, [F.col(time).cast("timestamp").asc_nulls_last(), F.col(key).asc_nulls_first()], name=name)

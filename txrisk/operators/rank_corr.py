"""Rank correlation of many pairs of columns by counting inversions, without comparing all pairs of rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import ordered

#: The rows of a pair are cut into blocks in order of x, and their values of y into as many ranges: so many that a block has about ROWS, within these bounds.
ROWS, LEAST, MOST = 1_000_000, 64, 2048


def inversions(y) -> int:
    """How many pairs of an array stand in descending order, by a stable sort of its ranks from the highest bit down: at each bit, of numbers equal above it, those
    with a one before one with a zero."""
    import numpy as np

    if len(y) < 2:
        return 0
    ranks = np.unique(y, return_inverse=True)[1].astype(np.int64)
    total = 0
    for bit in range(int(ranks.max()).bit_length() - 1, -1, -1):
        one, above = (ranks >> bit) & 1, ranks >> (bit + 1)
        before = np.cumsum(one) - one
        starts = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]]))
        base = np.repeat(before[starts], np.diff(np.concatenate([starts, [len(ranks)]])))
        total += int((before - base)[one == 0].sum())
        ranks = ranks[np.argsort(ranks >> bit, kind="stable")]
    return total


def _of_blocks(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Inversions inside one block of x."""
    rows = rows.sort_values("at")
    return pd.DataFrame({"pair": [key[0]], "n": [float(inversions(rows["y"].to_numpy()))]})


def _of_ranges(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Inversions inside one range of y, but for those inside a block of x too."""
    rows = rows.sort_values("at")
    inside = sum(inversions(part.to_numpy()) for _, part in rows.groupby("block")["y"])
    return pd.DataFrame({"pair": [key[0]], "n": [float(inversions(rows["y"].to_numpy()) - inside)]})


def _of_cells(slices: int):
    def run(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        """Inversions of rows of two blocks and two ranges, from the counts of their cells."""
        import numpy as np

        grid = np.zeros((slices, 2 * slices + 1))
        grid[cells["block"], cells["range"]] = cells["n"]
        earlier = np.cumsum(grid, axis=0) - grid
        higher = np.cumsum(earlier[:, ::-1], axis=1)[:, ::-1] - earlier
        return pd.DataFrame({"pair": [key[0]], "n": [float((grid * higher).sum())]})

    return run


def kendall(df: DataFrame, cols: list[str]) -> DataFrame:
    """(variable_1, variable_2, corr): Kendall's tau-b of each two columns, over the rows that have both; null where a column has one value only.

    In order of x (equal ones of y) the pairs of rows that go apart are the inversions of y. Rows are cut into blocks of that order and into ranges of y at sampled values, a value that is
    sampled being a range of its own. Inversions inside a block and inside a range are counted in the task that holds it, those of two blocks and two ranges from the
    counts of the cells; a range of one value has none, however many rows have it. Equal values are counted by value."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    if not pairs:
        raise ValueError("rank correlations need two columns or more")
    x = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in cols}
    slices = min(MOST, max(LEAST, -(-df.count() // ROWS)))
    edges = df.agg(*[F.percentile_approx(x[c], F.array(*[F.lit(i / slices) for i in range(1, slices + 1)]), 20 * slices).alias(f"e{i}") for i, c in enumerate(cols)]).first()
    cuts = {c: sorted(set(edges[f"e{i}"] or [])) for i, c in enumerate(cols)}

    def range_of(c: str):
        """2 k + 1 for the k-th edge itself, 2 k for what is below it and above the one before."""
        edge = F.array(*[F.lit(e).cast("double") for e in cuts[c]])
        return 2 * F.size(F.filter(edge, lambda e: e < x[c])) + F.array_contains(edge, x[c]).cast("int")

    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("pair"), x[a].alias("x"), x[b].alias("y"), range_of(b).alias("range")) for i, (a, b) in enumerate(pairs)])).alias("p")).select("p.*").where("x IS NOT NULL AND y IS NOT NULL")
    placed = ordered(long, ["x", "y"], by=["pair"], name="at", count="all")
    rows = placed.select("pair", "y", "range", "at", F.floor(F.col("at") / F.ceil(F.col("all") / slices)).cast("int").alias("block"))
    kind = "pair int, n double"
    cells = rows.groupBy("pair", "block", "range").agg(F.count("*").alias("n")).groupBy("pair").applyInPandas(_of_cells(slices), kind)  # at most slices * (2 slices + 1) rows a pair
    blocks = rows.groupBy("pair", "block").applyInPandas(_of_blocks, kind)
    ranges = rows.where("range % 2 = 0").groupBy("pair", "range").applyInPandas(_of_ranges, kind)
    apart = cells.union(blocks).union(ranges).groupBy("pair").agg(F.sum("n").alias("apart"))
    ties = lambda name, *by: long.groupBy("pair", *by).agg(F.count("*").cast("double").alias("t")).groupBy("pair").agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias(name), F.sum("t").alias(f"rows_{name}"))
    found = ties("tx", "x").join(ties("ty", "y"), "pair").join(ties("txy", "x", "y"), "pair").join(apart, "pair").collect()  # a row a pair
    out = {c: {} for c in cols}
    for r in found:
        a, b = pairs[r["pair"]]
        whole = r["rows_tx"] * (r["rows_tx"] - 1) / 2
        below = math.sqrt((whole - r["tx"]) * (whole - r["ty"]))
        out[a][b] = out[b][a] = (whole - r["tx"] - r["ty"] + r["txy"] - 2 * r["apart"]) / below if below > 0 else None
    constant = {c: len(cuts[c]) < 2 for c in cols}
    data = [(a, b, (None if constant[a] else 1.0) if a == b else out[a].get(b)) for a in cols for b in cols]
    return df.sparkSession.createDataFrame(data, "variable_1 string, variable_2 string, corr double")

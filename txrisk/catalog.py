"""The registered queries of the transaction-risk operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.profile import economic_impact
from .operators.windows import velocity_grid
from .queries import profiles, rows, scoring, tests_and_drift, transforms
from .sources.tables import transactions

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (rows, profiles, transforms, tests_and_drift, scoring):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each day earned and lost, and what its transactions' entities had spent in the day before them."""
    tx = transactions(spark, sf_dir)
    grid = velocity_grid(tx, windows=("1d",), aggregates=("sum", "max")).groupBy(F.date_format("fecha", "yyyy-MM-dd").alias("period")).agg(F.round(F.avg("monto_sum_1d"), 4).alias("mean_sum_1d"), F.round(F.max("monto_max_1d"), 4).alias("max_1d"))
    return economic_impact(tx, "fecha", "fraude", "monto").join(grid, "period", "left")

"""Reading and writing tables, and the transaction view over the event table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING, OTHER, NULL_LABEL = "__MISSING__", "__OTHER__", "(nulo)"


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every float column, once, so nothing downstream meets a NaN."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(f"`{c}`"), F.lit(None).cast(df.schema[c].dataType)) for c in floats})


def read_transactions(spark: SparkSession, path: str, schema: T.StructType | str | None = None, time: str = "fecha", fmt: str = "parquet") -> DataFrame:
    """A table from Parquet or CSV with its time column as a timestamp and NaN as NULL. CSV needs a schema: nothing is inferred by a
    pass over the data. A time that doesn't parse is NULL."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if fmt == "csv" and schema is None:
        raise ValueError("reading CSV needs a schema")
    df = reader.csv(path, header=True) if fmt == "csv" else reader.format(fmt).load(path)
    kind = df.schema[time].dataType
    value = F.try_to_timestamp(F.col(time)) if isinstance(kind, T.StringType) else F.col(time).cast("timestamp")
    return nan_to_null(df.withColumn(time, value))


def detect_date_columns(df: DataFrame, sample_size: int = 500) -> DataFrame:
    """For each string or time column: (column_name, sampled, parsed, is_date). A string column is a date if it has values and
    all of its first ``sample_size`` non-null ones parse, or if its name says so and any of them does; a date or timestamp column is one."""
    hints = ("fecha", "date", "timestamp")
    out = None
    for f in df.schema:
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            one = df.sparkSession.range(1).select(F.lit(f.name).alias("column_name"), F.lit(0).cast("long").alias("sampled"), F.lit(0).cast("long").alias("parsed"), F.lit(True).alias("is_date"))
        elif isinstance(f.dataType, T.StringType):
            named = any(h in f.name.lower() for h in hints)
            head = df.select(F.col(f"`{f.name}`").alias("v")).where("v IS NOT NULL").limit(sample_size)
            one = head.agg(F.count("*").alias("sampled"), F.count_if(F.expr("try_to_timestamp(v) IS NOT NULL")).alias("parsed"))
            one = one.select(F.lit(f.name).alias("column_name"), "sampled", "parsed", ((F.col("parsed") > 0) & ((F.col("parsed") == F.col("sampled")) | F.lit(named))).alias("is_date"))
        else:
            continue
        out = one if out is None else out.unionByName(one)
    return out if out is not None else df.sparkSession.createDataFrame([], "column_name string, sampled long, parsed long, is_date boolean")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", by_day: str | None = None, mode: str = "overwrite") -> None:
    """Write a table; with ``by_day`` (a time column) in one folder for each day."""
    if by_day:
        df = df.withColumn("day", F.to_date(by_day))
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy("day") if by_day else writer).save(path)


def load_config(path: str) -> dict:
    """A feature or pipeline configuration from a JSON or YAML file on the driver."""
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yml", ".yaml")):
            import yaml

            return yaml.safe_load(f)
        return json.load(f)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions made of the events: one row an event, with every kind of column the operators need."""
    return transactions_of(events(spark, sf_dir))


def transactions_of(e: DataFrame) -> DataFrame:
    id_, value, user = F.col("event_id"), F.col("value"), F.col("user_id")
    score = F.get_json_object("props", "$.k").cast("int")
    null = F.lit(None)
    return e.select(
        id_.alias("k"), F.col("ts").cast("timestamp").alias("fecha"), F.concat(F.lit("cat_"), user.cast("string")).alias("j"), value.cast("double").alias("monto"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("fraude"), score.alias("score"), (1 + id_ % 4).cast("int").alias("a"),
        F.when(id_ % 11 == 0, null).otherwise(score.cast("double") / 100).alias("b"), F.when(id_ % 11 == 0, null).otherwise(value * value).alias("c"),
        F.when(id_ % 37 == 0, null).otherwise((score % 51).cast("double")).alias("d"), F.when(id_ % 37 == 0, null).otherwise((score % 51) + value / 10).alias("m"),
        F.when(id_ % 9 < 4, 0.0).otherwise(value * value * value).alias("e"), (F.floor(value).cast("double") - 4).alias("f"),
        F.when(id_ % 101 == 0, null).when(user % 4 != 0, "BR").otherwise(F.concat(F.lit("C"), (user % 45).cast("string"))).alias("g"),
        (score % 59).cast("double").alias("h"), F.when(id_ % 73 == 0, 0.0).otherwise(value * (1 + score)).alias("l"), F.when(value > 5, 1).otherwise(0).alias("n"),
        F.when(id_ % 7 == 0, "N").when(id_ % 7 == 1, "Y").alias("o"), F.when(id_ % 9 < 5, "Y").otherwise("N").alias("p"),
    )


#: The same view for DuckDB, as the start of a WITH clause.
TX_SQL = """tx AS (SELECT event_id AS k, ts AS fecha, 'cat_' || user_id AS j, value AS monto, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS fraude, score,
    (1 + event_id % 4)::INT AS a, CASE WHEN event_id % 11 = 0 THEN NULL ELSE score::DOUBLE / 100 END AS b, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value * value END AS c,
    CASE WHEN event_id % 37 = 0 THEN NULL ELSE (score % 51)::DOUBLE END AS d, CASE WHEN event_id % 37 = 0 THEN NULL ELSE (score % 51) + value / 10 END AS m,
    CASE WHEN event_id % 9 < 4 THEN 0.0::DOUBLE ELSE value * value * value END AS e, floor(value)::DOUBLE - 4 AS f,
    CASE WHEN event_id % 101 = 0 THEN NULL WHEN user_id % 4 <> 0 THEN 'BR' ELSE 'C' || (user_id % 45) END AS g, (score % 59)::DOUBLE AS h,
    CASE WHEN event_id % 73 = 0 THEN 0.0::DOUBLE ELSE value * (1 + score) END AS l, CASE WHEN value > 5 THEN 1 ELSE 0 END AS n,
    CASE WHEN event_id % 7 = 0 THEN 'N' WHEN event_id % 7 = 1 THEN 'Y' END AS o, CASE WHEN event_id % 9 < 5 THEN 'Y' ELSE 'N' END AS p
    FROM (SELECT *, json_extract_string(props, '$.k')::INT AS score FROM events))"""


def tx_sql(body: str, *more: str) -> str:
    return "WITH " + ", ".join([TX_SQL, *more]) + " " + body

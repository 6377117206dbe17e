"""Written tables that cut a long job's lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}

#: Spark's setting by which a query's shuffle files go when it is over, not when the driver happens to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share. It is the session's ``spark.checkpoint.dir``; only where that is unset (tests on
    one machine) a temporary folder is made, once for each application."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="txrisk-")
    return _own_dirs[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return a reader of it. This cuts the lineage: a lost executor
    costs the tasks it ran, not the steps before. The tables go with the folder, which belongs to the application. Long columns, which
    are mostly hashes and ids, are written without the dictionaries that Parquet would begin and drop again. What was shuffled for the table is
    deleted as soon as it is written: of a long job's disk the step at work and the tables still to be read are left."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.options(**{f"parquet.enable.dictionary#{c}": "false" for c, kind in df.dtypes if kind == "bigint"}).parquet(path)
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(*written: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing will read again."""
    for df in written:
        if path := getattr(df, "_scratch_path", None):
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)

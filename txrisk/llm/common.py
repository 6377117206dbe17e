"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import materialize, release, scratch_dir  # noqa: F401

#: ASCII white space, and its complement: a word is a longest run of the latter.
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
WORD_BYTES = rb"[^\x20\x09-\x0D]+"


def _rows_of_files(docs: DataFrame) -> bool:
    """Whether each row of ``docs`` is a row of a file of its own: a scan that lists no path twice or inside another, with nothing above it but columns and deterministic conditions."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias") and node.deterministic():
        node = node.children().apply(0)
    if node.nodeName() != "LogicalRelation":
        return False
    roots = node.relation().location().rootPaths()
    paths = sorted(roots.apply(i).toString().rstrip("/") + "/" for i in range(roots.size()))
    return not any(b.startswith(a) for a, b in zip(paths, paths[1:]))


def with_row_id(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with ``name``: an id of each row that no other row has, and that is the same whenever the table is read. Rows of files are known by
    their file and their place in it; any other table, such as one that an explode, a join or a union made, is written once with numbers."""
    if _rows_of_files(docs):
        try:
            place = F.concat_ws(":", F.hex(F.xxhash64("_metadata.file_path")), F.col("_metadata.row_index").cast("string"))
            return docs.select("*", place.alias(name))
        except AnalysisException:  # files of a kind without places
            pass
    return materialize(docs.withColumn(name, F.monotonically_increasing_id().cast("string")), "numbered")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for a row, also where ``body`` uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The array of a text's words; empty for null and blank texts."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tables(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"

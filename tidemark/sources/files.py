"""Finding, reading and writing files of a project folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.panel import union_rows

# What Spark says of a folder that does not exist, or that has no file yet.
NOTHING_THERE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def find_file(spark: SparkSession, folders: Sequence[str], patterns: Sequence[str]) -> str | None:
    """The best match below the folders: shortest path first, then the largest file.

    Only the file listing is read. Empty files and notebook checkpoints do not count.
    """
    found = []
    for folder in folders:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        try:
            found.append(reader.option("pathGlobFilter", "{" + ",".join(patterns) + "}").load(folder).select("path", "length"))
        except AnalysisException as error:
            if error.getCondition() not in NOTHING_THERE:
                raise
            continue
    if not found:
        return None
    usable = union_rows(*found).where((F.col("length") > 0) & ~F.col("path").contains(".ipynb_checkpoints"))
    best = usable.orderBy(F.length("path"), F.desc("length"), "path").first()
    return best["path"] if best else None


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV file with a header. Without a schema all columns are text, to be coerced by name."""
    reader = spark.read.option("header", "true").option("multiLine", "false")
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON file with one object."""
    return spark.read.option("multiLine", "true").json(path).first().asDict(recursive=True)


def write_table(df: DataFrame, path: str, file_format: str = "parquet", partition_by: Sequence[str] = ()) -> str:
    """Replace a table."""
    options = {"header": "true"} if file_format == "csv" else {}
    df.write.mode("overwrite").options(**options).partitionBy(*partition_by).format(file_format).save(path)
    return path


def append_table(df: DataFrame, path: str, partition_by: Sequence[str] = ("config_key",)) -> str:
    """Add rows to a table, one folder per configuration."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)
    return path


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str] = ("config_key",)) -> str:
    """Write rows and replace only the folders they belong to, so a repeated run leaves no copies."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by).parquet(path)
    return path

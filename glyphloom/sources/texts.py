"""Reading texts and writing parse results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text: one row for each file, whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, text: one row for each line."""
    return spark.read.text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """path, text, valid: files read as bytes; text is null where they are not UTF-8."""
    raw = spark.read.format("binaryFile").load(path)
    ok = F.is_valid_utf8(F.col("content"))
    return raw.select("path", F.when(ok, F.decode("content", "UTF-8")).alias("text"), ok.alias("valid"))


def read_table(spark: SparkSession, path: str, text: str, *keys: str) -> DataFrame:
    """The keys and a text column of a Parquet table; only these are scanned."""
    return spark.read.parquet(path).select(*keys, F.col(text).alias("text"))


def write_nodes(nodes: DataFrame, path: str, mode: str = "error") -> None:
    """A node table as Parquet, one folder for each rule name, so that queries by name read only theirs."""
    nodes.write.mode(mode).partitionBy("name").parquet(path)

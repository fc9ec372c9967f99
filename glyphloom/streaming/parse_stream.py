"""Grammars in Structured Streaming: the same columns over unbounded input.

Accepting, extracting and parsing keep no state, so they are projections of a
stream; aggregates over their fields use Spark's windows and watermarks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glyphloom.functions.parsing import extract, matches, parse
from glyphloom.operators.grammar import Rule


def text_stream(spark: SparkSession, path: str, schema: StructType | None = None, max_files: int | None = None) -> DataFrame:
    """A stream of the files that arrive in a folder: Parquet with a schema, else lines of text."""
    reader = spark.readStream if schema is None else spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.format("text" if schema is None else "parquet").load(path)


def accepted(stream: DataFrame, text: str, grammar: Rule) -> DataFrame:
    """The rows whose text the grammar accepts, with its named rules in ``fields``."""
    return stream.where(matches(text, grammar)).withColumn("fields", extract(text, grammar))


def rejected(stream: DataFrame, text: str, grammar: Rule) -> DataFrame:
    """The other rows, with their diagnostics."""
    r = parse(text, grammar)
    return stream.where(~matches(text, grammar)).withColumn("parsed", r).select(*stream.columns, "parsed.error_message", "parsed.error")


def windowed_counts(stream: DataFrame, time: str, text: str, grammar: Rule, field: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of a named rule's text by window of event time; rows later than the watermark are dropped by Spark."""
    got = accepted(stream, text, grammar).withWatermark(time, late)
    return got.groupBy(F.window(time, window), F.col(f"fields.{field}").alias(field)).agg(F.count("*").alias("n"))

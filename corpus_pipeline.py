"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last
return the columns of ``documents``; what a stage rejects does not reach the next.

Defined results: an empty table gives an empty table.  Rows without text, and of
texts without letters, go at language ID.  Rows without doc_id are judged by
their text like any other, but are no one's near copies and stay when the near
copies go.  Repeated rows: line dedup lets both be, the n-gram join keeps one.
Ties: the least doc_id stays.  Very long texts are read whole.  Further columns
are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm._stage import Workspace
from glyphloom.llm.decontamination import contaminated
from glyphloom.llm.language_id import identify, train
from glyphloom.llm.line_dedup import line_dedup
from glyphloom.llm.ngram_jaccard import jaccard_join
from glyphloom.llm.packing import pack


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no language: null text, or text without a letter.  A missing lang becomes the predicted one."""
    columns = docs.columns
    out = identify(docs, train(docs), keep=columns).where("lang_pred <> 'und'")
    return out.select(*[F.coalesce("kept_lang", "lang_pred").alias(c) if c == "lang" else F.col(f"kept_{c}").alias(c) for c in columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of line runs; a document of which nothing is left but white space goes."""
    columns = docs.columns
    out = line_dedup(docs, keep=columns).where(r"n_removed = 0 or text rlike '[^\\x20\\x09-\\x0D]'")
    changed = F.col("n_removed") > 0
    fresh = {"text": F.when(changed, F.col("text")).otherwise(F.col("kept_text")), "n_chars": F.when(changed, F.length("text").cast("long")).otherwise(F.col("kept_n_chars"))}
    return out.select(*[fresh.get(c, F.col(f"kept_{c}")).alias(c) for c in columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least doc_id, once."""
    work = Workspace(spark, "near-copies")
    groups = work.keep(jaccard_join(docs).select("doc_id", "component_id"), "groups")
    out = docs.join(groups.where("component_id <> doc_id").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
    repeated = groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count()
    return out.dropDuplicates(["doc_id", "text"]) if repeated else out


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or an edited copy of one, go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    # rows are told apart by a hash, under a name that no column has
    row, name = F.xxhash64("doc_id", "text"), "row"
    while name in docs.columns:
        name += "_"
    bad = contaminated(docs.select(row.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(name)).distinct()
    return docs.withColumn(name, row).join(bad, name, "left_anti").select(docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into training sequences."""
    return pack(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("ngram_jaccard", near_copies), ("decontamination", decontaminate), ("packing", sequences)]

# Token ids, and so the last stage, are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``, each written and read again."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        done = work.keep(stage(spark, docs, sf_dir), name)
        work.drop(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)

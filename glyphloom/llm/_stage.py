"""Staged tables in the cluster's shared folder, and connected components.

A staged table cuts the lineage: a lost executor costs only the tasks since the
last one.  The folder is the session's ``spark.checkpoint.dir``.  Where it is
unset a local session gets a temporary folder of its own, a cluster an error.

Tables that a returned DataFrame still reads stay until ``clear``, which deletes
all that this process staged.  While a table is written, a setting of the session
makes Spark remove the shuffle files behind it; run queries that stage tables at
the same time in sessions of their own (``spark.newSession()``).
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: list[str] = []
_made: list[str] = []
# Bucketed tables are known to the catalog by a name; the path of each.
_tables: dict[str, str] = {}
ROWS_A_FILE = 20_000
LEAST_FILES = 12


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="glyphloom-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def _delete(spark: SparkSession, path: str) -> None:
    for at in [at for at in _tables if f"{at}/".startswith(f"{path}/")]:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(at)}")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> int:
    """Deletes every table staged by this process, once no DataFrame that came of them is read any more; returns the number of workspaces."""
    made = len(_made)
    while _made:
        _delete(spark, _made.pop())
    return made


class Workspace:
    """Named Parquet tables of one operator run, each written once and read back."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._count = 0
        self._kept: set[str] = set()
        _made.append(self.path)

    def keep(self, df: DataFrame, name: str, rows: int | None = None, by: str | None = None) -> DataFrame:
        """Writes the rows and reads them back; where about ``rows`` are known to come, in no more files than they need.

        With ``by`` the table is bucketed by that column as a shuffle would deal it, so joins on it shuffle their other side only;
        let the rows come dealt so, or each task writes a file for each bucket.
        """
        self._count += 1
        if rows is not None:
            few, parts = max(LEAST_FILES, -(-rows // ROWS_A_FILE)), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            df = df.coalesce(few) if few < parts else df
        path = f"{self.path}/{self._count:03d}-{name}"
        # The shuffle files of a write that has ended are of no more use: without
        # this they stay until the driver happens to collect its garbage.
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            if by:
                _tables[path] = f"glyphloom_staged_{uuid.uuid4().hex}"
                df.write.bucketBy(int(self.spark.conf.get("spark.sql.shuffle.partitions")), by).sortBy(by).option("compression", "zstd").option("path", path).saveAsTable(_tables[path])
            else:
                df.write.option("compression", "zstd").parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(_CLEANUP)
            else:
                self.spark.conf.set(_CLEANUP, before)
        out = self.spark.table(_tables[path]) if by else self.spark.read.schema(df.schema).parquet(path)
        out._staged = path
        self._kept.add(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes staged tables that nothing reads any more."""
        for t in tables:
            if path := getattr(t, "_staged", None):
                _delete(self.spark, path)

    def drop_but(self, *tables: DataFrame) -> None:
        """Deletes the tables staged here but these."""
        stay = {t._staged for t in tables}
        for path in self._kept - stay:
            _delete(self.spark, path)
        self._kept &= stay


def _stats(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, work: Workspace, most_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """(node, component) for every node of the links (a, b), about ``rows`` of them if that is known; component is the least node reachable.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until the
    links are stars.  Each step is one partial aggregation and one sort-merge
    join, which skew handling may split; nothing goes to the driver but sums.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = work.keep(edges, "links", rows)
    before = _stats(edges)
    for _ in range(most_rounds):
        rows = before[0]
        if rows == 0:
            break
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = work.keep(large, "large", rows)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        after_edges = work.keep(small, "small", rows)
        work.drop(edges, large)
        edges, after = after_edges, _stats(after_edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    leaves = edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return leaves.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

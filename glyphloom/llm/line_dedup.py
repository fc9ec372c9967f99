"""Line dedup over a suffix array of line ids, in DataFrame operations only.

The texts are sequences of line ids (128 hash bits of each line between line
feeds; lines of white space only are not part of the sequence and stay).
Distributed prefix doubling ranks the suffixes: ``rank`` at depth 1 orders the
lines, and the pairs (rank at i, rank at i + d) order the suffixes by twice the
depth.  Suffixes of equal rank form the interval of the suffix array whose
longest common prefix is at least the depth, so each interval is a repeated run.
Suffixes that are alone in their interval take no further part.

Every member of an interval but its first, in order of (doc_id, line), starts a
later copy.  ``line_dedup`` deletes the lines that later copies cover, where a
run counts if it has ``min_lines`` lines, or is one line of ``min_chars``
characters or more.  A longer run is the union of its stretches of ``min_lines``
lines, so the interval at ``min_lines`` decides what goes; doubling then goes on
until no run repeats, and the deepest interval in which a document starts a later
copy says how long a run it repeats (``run_depth``, a power of two).  The lines
deleted side by side are the maximal runs (``n_runs``, ``longest_run``).

Ranks are made without a single-task sort: the different keys are range
partitioned, numbered inside each partition, and shifted by the sizes of the
partitions before it.

Defined results: null text stays null, 0 lines.  Empty text is one blank line.
Null doc_id: unchanged.  Repeated rows: not copies of each other; a doc_id with
several texts orders them by their hash.  Copies within one document: all but the
first go.  Very long texts are taken whole.  An empty table gives an empty table.
Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.llm._stage import Workspace

MIN_LINES = 2
MIN_CHARS = 100


def _place():
    return F.struct("doc_id", "th", "j")


def _ranked(keys: DataFrame, by: list[str], work: Workspace) -> DataFrame:
    """Adds ``rank``, the number of a row in the order of ``by``; keys are different."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = work.keep(keys.repartitionByRange(parts, *by).withColumn("pid", F.spark_partition_id()), "keys")
    sizes = dealt.groupBy("pid").agg(F.count("*").alias("size"))
    # as many rows as partitions: bounded by the session's own setting
    offsets = sizes.withColumn("offset", F.sum("size").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))).select("pid", F.coalesce("offset", F.lit(0)).alias("offset"))
    local = dealt.withColumn("at", F.row_number().over(Window.partitionBy("pid").orderBy(*by)))
    return local.join(F.broadcast(offsets), "pid").withColumn("rank", F.col("at") + F.col("offset")).drop("pid", "at", "offset")


def _intervals(rows: DataFrame, by: list[str], work: Workspace, name: str) -> DataFrame:
    """doc_id, th, j, rank, later (and the other columns) of rows that share their key with another row."""
    groups = rows.groupBy(*by).agg(F.count("*").alias("members"), F.min(_place()).alias("first")).where("members > 1")
    ranked = _ranked(groups.drop("members"), by, work)
    return work.keep(rows.join(ranked, by).withColumn("later", _place() > F.col("first")).drop("first", *by), name)


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, th, i (line), j (place in the sequence), chars, h1, h2 of the lines of the sequences."""
    part = docs.select("doc_id", "th", F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x"))).alias("all")).where("doc_id is not null")
    part = part.select("doc_id", "th", F.posexplode(F.filter("all", lambda s: s["x"].rlike(r"[^\x20\x09-\x0D]"))).alias("j", "s"))
    return part.select("doc_id", "th", "j", F.col("s.i").alias("i"), F.length("s.x").alias("chars"), F.xxhash64(F.col("s.x")).alias("h1"), F.xxhash64(F.lit(1), F.col("s.x")).alias("h2"))


def _prepare(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))


def _double(level: DataFrame, depth: int, reach: int, work: Workspace) -> DataFrame:
    """From ranks at ``depth`` to intervals at ``depth + reach`` lines (reach <= depth)."""
    ahead = Window.partitionBy("doc_id", "th").orderBy("j").rangeBetween(reach, reach)
    pairs = level.select("doc_id", "th", "j", "i", F.col("rank").alias("r1"), F.first("rank").over(ahead).alias("r2")).where("r2 is not null")
    return _intervals(pairs, ["r1", "r2"], work, f"depth-{depth + reach}")


def suffix_ranks(docs: DataFrame, depth: int | None = None) -> list[tuple[int, DataFrame]]:
    """(depth, intervals) at depths 1, 2, 4, ... up to ``depth`` exactly, or until no run is repeated."""
    work = Workspace(docs.sparkSession, "lines")
    level = _intervals(lines(_prepare(docs)).dropDuplicates(["doc_id", "th", "j"]), ["h1", "h2"], work, "depth-1")
    out, d = [(1, level)], 1
    while depth is None or d < depth:
        reach = d if depth is None else min(d, depth - d)
        level = _double(out[-1][1], d, reach, work)
        d += reach
        if depth is None and not level.limit(1).count():
            break
        out.append((d, level))
    return out


def _deciding(levels: list[tuple[int, DataFrame]], min_lines: int, work: Workspace) -> DataFrame | None:
    """The intervals at ``min_lines``, from those at powers of two; none if no such run repeats."""
    depth, level = [x for x in levels if x[0] <= min_lines][-1]
    if depth < min_lines and 2 * depth in (d for d, _ in levels) or depth < min_lines < 2 * depth:
        return _double(level, depth, min_lines - depth, work)
    return level if depth == min_lines else None


def line_dedup(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, keep: list[str] = ()) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs, longest_run, run_depth, text (what is left) for every row of docs (doc_id, text); columns to keep follow, named kept_*."""
    work = Workspace(docs.sparkSession, "lines")
    levels = suffix_ranks(docs)
    gone = levels[0][1].where("later").where(F.col("chars") >= min_chars).select("doc_id", "th", "j")
    if (decides := _deciding(levels, min_lines, work)) is not None:
        gone = gone.union(decides.where("later").select("doc_id", "th", F.explode(F.sequence(F.col("j"), F.col("j") + F.lit(min_lines - 1))).alias("j")))
    places = levels[0][1].select("doc_id", "th", "j", "i")
    gone = places.join(gone.distinct(), ["doc_id", "th", "j"], "left_semi")
    gone = gone.groupBy("doc_id", "th").agg(F.collect_list("i").alias("gone"), F.sort_array(F.collect_list("j")).alias("places"))
    deep = None
    for depth, level in levels:
        one = level.where("later").groupBy("doc_id", "th").agg(F.lit(depth).cast("long").alias("run_depth"))
        deep = one if deep is None else deep.union(one)
    deep = deep.groupBy("doc_id", "th").agg(F.max("run_depth").alias("run_depth"))
    zero = F.lit(0).cast("long")

    def onward(at, j):
        """Places side by side are one run."""
        here = F.when(j == at["last"] + 1, at["here"] + 1).otherwise(zero + 1)
        return F.struct((at["n"] + F.when(here == 1, 1).otherwise(0)).alias("n"), F.greatest(at["longest"], here).alias("longest"), here.alias("here"), j.cast("int").alias("last"))

    runs = F.aggregate("places", F.struct(zero.alias("n"), zero.alias("longest"), zero.alias("here"), F.lit(-2).alias("last")), onward)
    about = deep.join(gone.withColumn("runs", runs).drop("places"), ["doc_id", "th"], "left")
    about = work.keep(about, "removed")
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.split(F.col("text").cast("string"), "\n").alias("lines"), *[F.col(c).alias(f"kept_{c}") for c in keep])
    # what is removed grows with the input: never broadcast, also where it happens to be small
    both = split.join(about.hint("shuffle_merge"), ["doc_id", "th"], "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    return both.select(
        "doc_id",
        F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.coalesce("runs.n", zero).alias("n_runs"),
        F.coalesce("runs.longest", zero).alias("longest_run"),
        F.coalesce("run_depth", zero).alias("run_depth"),
        F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(left, lambda k: F.get("lines", k)), "\n")).alias("text"),
        *[f"kept_{c}" for c in keep],
    )


ORACLE_SQL = f"""
WITH line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL
), seq AS (
  SELECT doc_id, i, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j FROM line WHERE regexp_matches(x, '[^ \\x09-\\x0D]')
), pair AS (
  SELECT doc_id, i, j, x, lead(x) OVER (PARTITION BY doc_id ORDER BY j) AS y, lead(i) OVER (PARTITION BY doc_id ORDER BY j) AS i2 FROM seq
), marked AS (
  SELECT doc_id, i, i2, x, y,
         row_number() OVER (PARTITION BY x, y ORDER BY doc_id, j) > 1 AND y IS NOT NULL AS later_pair,
         row_number() OVER (PARTITION BY x ORDER BY doc_id, j) > 1 AND length(x) >= {MIN_CHARS} AS later_line
  FROM pair
), gone AS (
  SELECT doc_id, i FROM marked WHERE later_pair OR later_line UNION SELECT doc_id, i2 FROM marked WHERE later_pair
), kept AS (
  SELECT line.doc_id, string_agg(x, chr(10) ORDER BY line.i) AS text FROM line ANTI JOIN gone ON line.doc_id = gone.doc_id AND line.i = gone.i GROUP BY 1
), stretch AS (
  SELECT doc_id, b, count(*) AS n
  FROM (SELECT doc_id, j - row_number() OVER (PARTITION BY doc_id ORDER BY j) AS b FROM gone JOIN seq USING (doc_id, i)) GROUP BY 1, 2
), runs AS (
  SELECT doc_id, count(*) AS n_runs, max(n) AS longest_run FROM stretch GROUP BY 1
), whole AS (
  SELECT doc_id, list(md5(x) ORDER BY j) AS xs FROM seq GROUP BY 1
), suffix AS (
  SELECT doc_id, depth, j, md5(array_to_string(xs[j:j + depth - 1], '')) AS run
  FROM (SELECT doc_id, xs, depth, unnest(generate_series(1, len(xs) - depth + 1)) AS j
        FROM whole, (SELECT CAST(pow(2, k) AS BIGINT) AS depth FROM range(20) AS t(k)) WHERE depth <= len(xs))
), deep AS (
  SELECT doc_id, max(depth) AS run_depth FROM (SELECT doc_id, depth, row_number() OVER (PARTITION BY depth, run ORDER BY doc_id, j) AS k FROM suffix) WHERE k > 1 GROUP BY 1
)
SELECT d.doc_id,
       CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines,
       CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(r.n_runs, 0) AS BIGINT) AS n_runs, CAST(coalesce(r.longest_run, 0) AS BIGINT) AS longest_run, CAST(coalesce(e.run_depth, 0) AS BIGINT) AS run_depth,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d
LEFT JOIN kept k ON d.doc_id = k.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) g ON d.doc_id = g.doc_id
LEFT JOIN runs r ON d.doc_id = r.doc_id
LEFT JOIN deep e ON d.doc_id = e.doc_id
"""

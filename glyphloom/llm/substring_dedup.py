"""Substring dedup with a log-structured fingerprint index.

A window is ``window`` consecutive words of one document.  A window is a copy
when its word sequence also starts in a document with a smaller doc_id; the
words that copies cover are removed.  Windows are judged on the input.

Method.  A window's fingerprint is the least hash of its word ``seed``-grams
(winnowing), so equal windows have equal fingerprints, and a stretch of windows
with one fingerprint is a *segment*.  The index holds (fingerprint, doc_id) in
immutable runs, each a table bucketed and sorted by fingerprint.  Batches come
in doc_id order, ``batches`` in one call; a named index stays, and later calls
open it by its name and go on behind the documents that it knows.  For each batch:

1. its fingerprints, aggregated and sorted by the runs' partitioning, are
   merge-joined with every run, without a shuffle of the runs; fingerprints
   that two documents share are hits;
2. hits are verified: the segments of the documents concerned, old and new, are
   compared by 128-bit digests of their windows, first whole segments, then, in
   segments that stay different, window by window;
3. fingerprints that bring a new window become a new run; runs of one level are
   compacted into the next when there are ``fan`` of them.

A group of copies is one row for each member at every step; nothing is emitted
in pairs.  Equality is that of 128-bit digests, two keyed 64-bit hashes of words
mixed by place: for texts not made to meet under those keys, the chance of one
false match among 10^13 different windows is below 10^-12.

Defined results: null or empty text, and text without words: 0 words, nothing
removed, the hash of the empty string.  Null doc_id: neither a copy nor a
source.  Rows that repeat a doc_id are not copies of each other (ties: no row of
the least doc_id loses anything).  Very long texts are taken whole.  An empty
table gives an empty table.  Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm._kernels import Words, as_text, chunks, grams, grams_at, mix, signed, tidy
from glyphloom.llm._stage import Workspace

WINDOW = 13
SEED = 6
# Four runs are added before the last batch, so the query compacts to the second level.
BATCHES = 5
FAN = 2


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of the n entries from each entry on."""
    done = 1
    while done < n and len(x) > 0:
        step = min(done, n - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


class _Windows:
    """The windows of a run of texts: fingerprint, index of text and of first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, seed: int):
        w = self.words = Words(data, offsets)
        h = w.hashes()
        n = len(h) - window + 1
        if n <= 0:
            self.at = np.zeros(0, dtype=np.int64)
            self.fp = np.zeros(0, dtype=np.uint64)
            self.digest = (self.fp, self.fp)
            return
        inside = w.doc[:n] == w.doc[window - 1 :]
        self.at = np.flatnonzero(inside)
        self.fp = sliding_min(grams(h, seed), window - seed + 1)[self.at]
        self._h, self._n = h, window

    def digests(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each of some windows."""
        if not len(some):
            return self.fp[:0], self.fp[:0]
        return tuple(grams_at(h, self._n, self.at[some]) for h in (self._h, self.words.hashes(1)))


def _fingerprints(window: int, seed: int):
    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for i, j, data, offsets in chunks(batch.column(1)):
                w = _Windows(data, offsets, window, seed)
                if not len(w.at):
                    continue
                doc = w.words.doc[w.at]
                new = np.ones(len(w.at), dtype=bool)
                new[1:] = (w.fp[1:] != w.fp[:-1]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(signed(w.fp[new])), pa.array(ids[i:j][doc[new]])], names=["fp", "doc_id"])

    return run


def _hit_windows(batch: pa.RecordBatch, window: int, seed: int):
    """Yields, for chunks of rows (doc_id, th, text, list): rows, windows, and the lists."""
    wanted = batch.column(3)
    for i, j, data, offsets in chunks(batch.column(2)):
        yield i, j, _Windows(data, offsets, window, seed), wanted


def _segments(window: int, seed: int):
    """Segments of hit fingerprints: digest of their windows, fingerprint, place."""

    def run(batches):
        for batch in batches:
            ids, th = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for i, j, w, wanted in _hit_windows(batch, window, seed):
                if not len(w.at):
                    continue
                doc = w.words.doc[w.at]
                hit = np.zeros(len(w.at), dtype=bool)
                edge = np.searchsorted(doc, np.arange(j - i + 1))
                for k in range(j - i):
                    a, b = edge[k], edge[k + 1]
                    if b > a:
                        fps = wanted[i + k].values.to_numpy(zero_copy_only=False).view(np.uint64)
                        hit[a:b] = np.isin(w.fp[a:b], fps)
                if not hit.any():
                    continue
                new = np.ones(len(w.at), dtype=bool)
                new[1:] = (w.fp[1:] != w.fp[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(new)
                size = np.diff(np.append(first, len(w.at)))
                keep = hit[first]
                first, size = first[keep], size[keep]
                # a segment's windows are hit or not together
                with np.errstate(over="ignore"):
                    s1, s2 = (np.add.reduceat(mix(d), np.cumsum(size) - size) for d in w.digests(np.flatnonzero(hit)))
                row = doc[first]
                pos = w.at[first] - w.words.first[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(s1)), pa.array(signed(s2)), pa.array(signed(w.fp[first])), pa.array(ids[i:j][row]), pa.array(th[i:j][row]), pa.array(pos.astype(np.int32)), pa.array(size.astype(np.int32))],
                    names=["s1", "s2", "fp", "doc_id", "th", "pos", "len"],
                )

    return run


def _single_windows(window: int, seed: int):
    """Every window of the given stretches (pos, len), with its digest."""

    def run(batches):
        for batch in batches:
            ids, th = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for i, j, w, wanted in _hit_windows(batch, window, seed):
                if not len(w.at):
                    continue
                doc = w.words.doc[w.at]
                edge = np.searchsorted(doc, np.arange(j - i + 1))
                marks = np.zeros(len(w.at) + 1, dtype=np.int64)
                for k in range(j - i):
                    s = wanted[i + k].values
                    a = edge[k] + s.field("pos").to_numpy(zero_copy_only=False)
                    np.add.at(marks, a, 1)
                    np.add.at(marks, a + s.field("len").to_numpy(zero_copy_only=False), -1)
                keep = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
                d1, d2 = w.digests(keep)
                row = doc[keep]
                pos = w.at[keep] - w.words.first[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(d1)), pa.array(signed(d2)), pa.array(ids[i:j][row]), pa.array(th[i:j][row]), pa.array(pos.astype(np.int32))], names=["d1", "d2", "doc_id", "th", "pos"]
                )

    return run


def _digest_rows(window: int, cut: bool):
    """n_words, n_removed and the hash of the kept words; with ``cut``, less the stretches in the fourth column."""

    def run(batches):
        for batch in batches:
            raw, off = as_text(batch.column(2))
            raw = raw.tobytes()
            n, gone, sha = [], [], []
            for k in range(batch.num_rows):
                words = raw[off[k] : off[k + 1]].split()
                n.append(len(words))
                if cut:
                    s = batch.column(3)[k].values
                    a = s.field("pos").to_numpy(zero_copy_only=False)
                    marks = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(marks, a, 1)
                    np.add.at(marks, a + s.field("len").to_numpy(zero_copy_only=False) + window - 1, -1)
                    drop = np.cumsum(marks[:-1]) > 0
                    words = [w for w, d in zip(words, drop.tolist(), strict=True) if not d]
                gone.append(n[-1] - len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "th", "n_words", "n_removed", "kept_sha256"])

    return run


class FingerprintIndex:
    """Immutable runs of (fp, doc_id), bucketed and sorted by fp; a run of level k+1 is compacted from ``fan`` of level k.

    The runs are tables named after the index, so an index can be opened again by
    its name.  A compacted run is written before its parts are dropped; after a
    crash between the two, both are there, which changes no result.
    """

    def __init__(self, spark: SparkSession, fan: int = FAN, name: str | None = None):
        if name and not re.fullmatch(r"[a-z][a-z0-9_]*", name):
            raise ValueError("an index name has a-z, 0-9 and _ only")
        self.spark, self.fan = spark, fan
        self.name = f"glyphloom_{name or 'run_' + uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        known = (re.fullmatch(rf"{self.name}_level(\d+)_[0-9a-f]{{32}}", t.name) for t in spark.catalog.listTables(pattern=f"{self.name}_level*")) if name else ()
        self.runs: list[tuple[int, str]] = sorted((int(m[1]), m[0]) for m in known if m)

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"{self.name}_level{level}_{uuid.uuid4().hex}"
        rows.repartition(self.buckets, "fp").sortWithinPartitions("fp").write.bucketBy(self.buckets, "fp").sortBy("fp").option("compression", "zstd").saveAsTable(name)
        self.runs.append((level, name))

    def add(self, rows: DataFrame) -> None:
        """Writes a new run, then compacts; a document is in one run only, so compacted rows stay different."""
        self._write(rows, 0)
        level = 0
        while len(same := [r for r in self.runs if r[0] == level]) >= self.fan:
            rows = self.spark.table(same[0][1])
            for _, name in same[1:]:
                rows = rows.union(self.spark.table(name))
            self._write(rows, level + 1)
            self.runs = [r for r in self.runs if r not in same]
            for _, name in same:
                self.spark.sql(f"DROP TABLE {name}")
            level += 1

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for _, name in self.runs]

    def close(self) -> None:
        """Drops the runs."""
        for _, name in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.runs = []


def _copies(batch: DataFrame, upto: DataFrame, index: FingerprintIndex, work: Workspace, last: bool, window: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The copied stretches (doc_id, th, at) of a batch and the texts they lie in; adds the batch to the index unless it is the last."""
    fps = batch.select("doc_id", "text").mapInArrow(tidy(_fingerprints(window, seed)), "fp long, doc_id long")
    seen = fps.groupBy("fp").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    for k, run in enumerate(index.tables()):
        known = run.groupBy("fp").agg(F.lit(True).alias(f"run{k}"))
        seen = seen.join(known, "fp", "left")
    old = [F.col(f"run{k}").isNotNull() for k in range(len(index.runs))]
    hit = F.col("lo") < F.col("hi")
    for o in old:
        hit = hit | o
    seen = work.keep(seen.select("fp", "lo", hit.alias("hit")) if not last else seen.where(hit).select("fp", "lo", F.lit(True).alias("hit")), "seen")
    hits = seen.where("hit").select("fp")

    owners = fps.join(hits, "fp", "left_semi")
    for run in index.tables():
        owners = owners.union(run.join(hits, "fp", "left_semi").select("fp", "doc_id"))
    owners = owners.groupBy("doc_id").agg(F.collect_set("fp").alias("fps"))
    texts = work.keep(upto.join(owners, "doc_id").select("doc_id", "th", "text", "fps").dropDuplicates(["doc_id", "th"]), "texts")

    schema = "s1 long, s2 long, fp long, doc_id long, th long, pos int, len int"
    seg = work.keep(texts.mapInArrow(tidy(_segments(window, seed)), schema), "segments")
    lows = seg.groupBy("s1", "s2").agg(F.min("doc_id").alias("lo"))
    ruled = work.keep(seg.join(lows, ["s1", "s2"]).select("fp", "doc_id", "th", "pos", "len", (F.col("doc_id") > F.col("lo")).alias("copy")), "ruled")
    work.drop(seg)

    first = ruled.where("not copy")
    varied = first.groupBy("fp").agg(F.count("*").alias("c")).where("c > 1").select("fp")
    rest = first.join(varied, "fp", "left_semi").groupBy("doc_id", "th").agg(F.collect_list(F.struct("pos", "len")).alias("at"))
    one = texts.select("doc_id", "th", "text").join(rest, ["doc_id", "th"]).select("doc_id", "th", "text", "at")
    one = work.keep(one.mapInArrow(tidy(_single_windows(window, seed)), "d1 long, d2 long, doc_id long, th long, pos int"), "windows")
    low = one.groupBy("d1", "d2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("d1", "d2", "lo")
    # a join of two tables, so that the rows of a hot window are split between tasks
    low = work.keep(low, "shared-windows")
    single = one.join(low.hint("shuffle_merge"), ["d1", "d2"]).where("doc_id > lo").select("doc_id", "th", "pos", F.lit(1).alias("len"))

    copies = ruled.where("copy").select("doc_id", "th", "pos", "len").union(single)
    copies = copies.join(batch.select("doc_id").distinct(), "doc_id", "left_semi") if index.runs else copies
    copies = work.keep(copies.groupBy("doc_id", "th").agg(F.collect_list(F.struct("pos", "len")).alias("at")), "copies")
    if not last:
        # a fingerprint that is no hit has one row
        index.add(seen.where("not hit").select("fp", F.col("lo").alias("doc_id")).union(first.select("fp", "doc_id").distinct()))
    work.drop(seen, ruled, one, low)
    return copies, texts


def substring_dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED, batches: int = BATCHES, fan: int = FAN, index: str | None = None, since: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs (doc_id, text).

    With the name of an index, all batches are added to it and it stays.  Documents
    up to ``since`` are in it from earlier calls: they are read only to verify hits,
    and the result is that of the later ones.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "substrings")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    ids = docs.where("doc_id is not null")
    fresh = ids if since is None else ids.where(F.col("doc_id") > since)
    cuts = []
    if batches > 1:
        marks = [k / batches for k in range(1, batches)]
        cuts = fresh.agg(F.percentile_approx("doc_id", marks, 1000)).first()[0] or []
    bounds = [since, *sorted(set(cuts)), None]
    runs = FingerprintIndex(spark, fan, index)
    cut = []
    schema = "doc_id long, th long, n_words long, n_removed long, kept_sha256 string"
    try:
        for k, (above, upto) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            until = ids if upto is None else ids.where(F.col("doc_id") <= upto)
            batch = until if above is None else until.where(F.col("doc_id") > above)
            copies, texts = _copies(batch, until, runs, work, index is None and k == len(bounds) - 2, window, seed)
            kept = texts.join(copies, ["doc_id", "th"]).select("doc_id", "th", "text", "at").mapInArrow(tidy(_digest_rows(window, True)), schema)
            cut.append(work.keep(kept, "changed"))
            work.drop(copies, texts)
        changed = cut[0]
        for c in cut[1:]:
            changed = changed.union(c)
    finally:
        if index is None:
            runs.close()
    asked = docs if since is None else docs.where(F.col("doc_id") > since)
    whole = asked.mapInArrow(tidy(_digest_rows(window, False)), schema).drop("n_removed")
    changed = changed.select("doc_id", "th", "n_removed", F.col("kept_sha256").alias("cut_sha256"))
    # changed rows grow with the input: never broadcast
    both = whole.join(changed.hint("shuffle_merge"), ["doc_id", "th"], "left")
    return both.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("cut_sha256", "kept_sha256").alias("kept_sha256"))


ORACLE_SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents
), win AS (
  SELECT doc_id, k, md5(array_to_string(ws[k:k + {WINDOW - 1}], ' ')) AS h FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - {WINDOW - 1})) AS k FROM w)
), lows AS (
  SELECT h, min(doc_id) AS lo FROM win GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, k + o AS p FROM win JOIN lows USING (h), range({WINDOW}) AS t(o) WHERE doc_id > lo
), word AS (
  SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS text FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) g ON w.doc_id = g.doc_id
"""

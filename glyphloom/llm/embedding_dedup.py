"""Embedding near-dedup by randomised-rotation binary codes.

Vectors link when their cosine, in double precision, is ``least`` or more.

* Equal vectors are one class; only classes are compared, weighted by size.
* A seeded random rotation turns a unit vector o into o'; its code is the signs
  of o', x = sign(o') / sqrt(D), stored with the correction factor f = <x, o'>
  and with o' itself rounded to bytes.  For a unit vector q, <x, q'> / f is an
  unbiased estimate of <o, q>, within ``sigmas * sqrt((1 - f^2) / f^2 / (D - 1))``
  (RaBitQ; Gao & Long, SIGMOD 2024), and the rounding adds at most its stored
  length over f.  Only pairs whose upper bound reaches ``least`` are recomputed
  exactly.
* Which pairs are estimated: the sign bits of several rotations are cut into
  bands of ``b`` bits, and vectors meet where a band agrees.  ``b`` follows the
  logarithm of the number of classes, so that chance meetings stay in
  proportion to the input; the number of bands is such that a pair exactly at
  ``least`` meets with probability ``recall`` (0.9995) and closer pairs more surely.
* Codes are computed once and written.  Buckets are dealt with codes alone; only
  members that have a partner left by the bounds get their vectors, for the exact
  cosines.
* A pair is counted in the first band where it meets, so nothing is counted
  twice.  A bucket gives each member's number of links and a spanning forest of
  them, never its pairs.  A bucket over ``block`` members is cut into blocks,
  and each pair of blocks is a task's unit of its own.

Defined results: a vector that is null, empty, zero, or holds null or non-finite
components: no links, its own component, kept.  Null vec_id: no links, null
component, not kept.  Vectors of different length never link.  A cosine that
equals ``least`` (a tie) links.  Repeated rows are vectors like any other: they
link with each other.  Very long vectors are taken whole, with rotations of their
own length.  An empty table gives an empty table.  Other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.llm._kernels import list_array, tidy
from glyphloom.llm._stage import Workspace, components

LEAST = 0.95
RECALL = 0.9995
SIGMAS = 4.0
BLOCK = 768


def bands(classes: int, least: float, recall: float) -> tuple[int, int]:
    """(bits of a band, number of bands)."""
    bits = min(30, max(8, math.ceil(math.log2(max(2, classes))) - 4))
    agree = (1 - math.acos(least) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


@lru_cache(maxsize=8)
def rotations(dim: int, count: int) -> np.ndarray:
    """[count, dim, dim] random orthogonal matrices, the same everywhere."""
    out = np.empty((count, dim, dim))
    for k in range(count):
        q, r = np.linalg.qr(np.random.default_rng((dim, k)).standard_normal((dim, dim)))
        out[k] = q * np.sign(np.diag(r))
    return out


def _clean(batches):
    """vec_id and the vector's bytes (float64), null where it cannot link."""
    for batch in batches:
        rows = []
        for v in batch.column(1):
            raw = None
            if v.is_valid and len(v.values) and not v.values.null_count:
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all() and x.any():
                    raw = (x + 0.0).tobytes()  # no negative zeros
            rows.append(raw)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["vec_id", "vec"])


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _codes(bits: int, count: int):
    """The codes of the classes: keys of the bands, sign bits of the first rotation, correction factor, the rotated vector in bytes, their scale, and the length of what rounding lost."""
    weights = (1 << np.arange(bits, dtype=np.int64)).astype(np.int64)

    def run(batches):
        for batch in batches:
            raw = batch.column(2).to_pylist()
            sizes = np.array([len(r) // 8 for r in raw])
            keys = np.empty((len(raw), count), dtype=np.int32)
            code, rounded = [b""] * len(raw), [b""] * len(raw)
            f, scale, lost = (np.empty(len(raw)) for _ in range(3))
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                x = unit(np.frombuffer(b"".join(raw[i] for i in own), np.float64).reshape(-1, dim))
                turns = rotations(dim, -(-bits * count // dim))
                signs = np.concatenate([x @ r.T > 0 for r in turns], axis=1)[:, : bits * count]
                keys[own] = (signs.reshape(len(own), count, bits) @ weights).astype(np.int32)
                o = x @ turns[0].T
                f[own] = np.abs(o).sum(axis=1) / math.sqrt(dim)
                s = np.abs(o).max(axis=1) / 127
                q = np.rint(o / s[:, None]).astype(np.int8)
                scale[own], lost[own] = s, np.sqrt(((o - q * s[:, None]) ** 2).sum(axis=1))
                packed = np.packbits(o > 0, axis=1)
                for k, i in enumerate(own.tolist()):
                    code[i], rounded[i] = packed[k].tobytes(), q[k].tobytes()
            columns = [batch.column(0), batch.column(1), pa.array(sizes.astype(np.int32)), list_array(keys.ravel(), np.full(len(raw), count)), pa.array(code, pa.binary()), pa.array(rounded, pa.binary()), pa.array(f), pa.array(scale), pa.array(lost)]
            yield pa.RecordBatch.from_arrays(columns, names=CODE)

    return run


CODE = ["cid", "m", "dim", "keys", "code", "rounded", "f", "scale", "lost"]


def possible(code: np.ndarray, f: np.ndarray, q: np.ndarray, lost: np.ndarray, least: float, sigmas: float) -> np.ndarray:
    """Which pairs (row of code, row of q) may have a cosine of ``least``, by the upper bound of the estimate."""
    dim = q.shape[1]
    estimate = (code @ q.T) / f[:, None]
    wide = sigmas * np.sqrt(np.maximum(0.0, 1 - f * f) / (f * f) / max(1, dim - 1)) + 1e-9
    return estimate + wide[:, None] + lost[None, :] / f[:, None] >= least


class _Bucket:
    """The members of a bucket, or of two blocks of one, and the pairs that the bounds leave."""

    def __init__(self, rows: pa.Table, place: tuple, least: float, sigmas: float):
        band, dim, bi, bj = place[0], place[2], place[3], place[4]
        get = lambda n: rows.column(n).to_numpy()
        self.cid, self.own, f, lost = get("cid"), get("own"), get("f"), get("lost")
        code = np.unpackbits(np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(f), -1), axis=1)[:, :dim].astype(np.float32) * 2 - 1
        code /= np.float32(math.sqrt(dim))
        q = np.frombuffer(b"".join(rows.column("rounded").to_pylist()), np.int8).reshape(len(f), dim) * get("scale")[:, None].astype(np.float32)
        keys = rows.column("keys").combine_chunks().flatten().to_numpy().reshape(len(f), band) if band else np.zeros((len(f), 0), np.int32)
        if bi == bj:
            left = right = np.arange(len(f))
            new = np.triu(np.ones((len(f), len(f)), dtype=bool), 1)
        else:
            left, right = np.flatnonzero(self.own == bi), np.flatnonzero(self.own == bj)
            new = np.ones((len(left), len(right)), dtype=bool)
        # single precision costs the estimate 1e-5 at most
        new &= possible(code[left], f[left], q[right], lost[right] + 1e-5, least, sigmas)
        for b in range(band):  # pairs that have met before
            new &= keys[left, b][:, None] != keys[right, b][None, :]
        i, j = np.nonzero(new)
        self.i, self.j = left[i], right[j]

    def members(self) -> np.ndarray:
        return np.unique(np.concatenate([self.i, self.j]))


def _left(rows: pa.Table, place: tuple, least: float, sigmas: float) -> pa.RecordBatch | None:
    """The members of a bucket that have a possible partner."""
    b = _Bucket(rows, place, least, sigmas)
    some = b.members()
    if not len(some):
        return None
    columns = [np.full(len(some), v, dtype=np.int32) for v in place] + [b.own[some], b.cid[some]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*PLACE, "own", "cid"])


def _exact(rows: pa.Table, place: tuple, least: float, sigmas: float) -> pa.RecordBatch | None:
    """(kind, a, b, w): the weights of links of the members of a bucket, and the edges of a forest of them."""
    bucket = _Bucket(rows, place, least, sigmas)
    cid, m = bucket.cid, rows.column("m").to_numpy()
    x = unit(np.frombuffer(b"".join(rows.column("vec").to_pylist()), np.float64).reshape(len(cid), -1))
    i, j = bucket.i, bucket.j
    close = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 65536]], x[j[k : k + 65536]]) >= least for k in range(0, len(i), 65536)]) if len(i) else np.zeros(0, bool)
    i, j = i[close], j[close]
    if not len(i):
        return None
    weight = np.bincount(i, weights=m[j], minlength=len(cid)) + np.bincount(j, weights=m[i], minlength=len(cid))
    root = list(range(len(cid)))

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    edges = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        p, q = find(a), find(b)
        if p != q:
            root[p] = q
            edges.append((int(cid[a]), int(cid[b])))
    some = np.flatnonzero(weight)
    a = np.concatenate([cid[some], np.array([e[0] for e in edges], dtype=np.int64)])
    b = np.concatenate([np.full(len(some), -1), np.array([e[1] for e in edges], dtype=np.int64)])
    kind = np.concatenate([np.zeros(len(some), np.int32), np.ones(len(edges), np.int32)])
    w = np.concatenate([weight[some].astype(np.int64), np.zeros(len(edges), np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a), pa.array(b), pa.array(w)], names=["kind", "a", "b", "w"])


PLACE = ["band", "key", "dim", "bi", "bj"]


def _meet(what, least: float, sigmas: float):
    """``what`` of each bucket of rows sorted by place; a bucket or pair of blocks has a bounded number of rows."""

    def run(batches):
        held, last = [], None

        def done():
            rows = pa.Table.from_batches(held)
            return what(rows, last, least, sigmas) if rows.num_rows > 1 else None

        for batch in batches:
            place = [batch.column(n).to_numpy() for n in PLACE]
            change = np.zeros(batch.num_rows, dtype=bool)
            for p in place:
                change[1:] |= p[1:] != p[:-1]
            edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                here = tuple(int(p[a]) for p in place)
                if held and here != last:
                    if (out := done()) is not None:
                        yield out
                    held = []
                last = here
                held.append(batch.slice(a, b - a))
        if held and (out := done()) is not None:
            yield out

    return run


def embedding_dedup(vectors: DataFrame, least: float = LEAST, recall: float = RECALL, sigmas: float = SIGMAS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    work = Workspace(spark, "embeddings")
    base = work.keep(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).mapInArrow(tidy(_clean), "vec_id long, vec binary"), "vectors")
    classes = work.keep(base.where("vec is not null and vec_id is not null").groupBy("vec").agg(F.min("vec_id").alias("cid"), F.count("*").alias("m")), "classes")
    bits, count = bands(classes.count(), least, recall)
    schema = "cid long, m long, dim int, keys array<int>, code binary, rounded binary, f double, scale double, lost double"
    rows = work.keep(classes.select("cid", "m", "vec").mapInArrow(tidy(_codes(bits, count)), schema), "codes")

    met = rows.select("dim", F.posexplode("keys").alias("band", "key")).groupBy("band", "key", "dim").agg(F.count("*").alias("c")).where("c > 1")
    met = work.keep(met.withColumn("blocks", F.when(F.col("c") > block, F.ceil(F.col("c") / (block / 2))).cast("int")), "buckets")
    each = rows.select(*CODE, F.posexplode("keys").alias("band", "key")).join(met.drop("c").hint("shuffle_merge"), ["band", "key", "dim"])
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    pair = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(-1).alias("bi"), F.lit(-1).alias("bj")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("bi"), F.greatest(k, F.col("own")).alias("bj")))
    )
    each = each.withColumn("own", F.coalesce(own, F.lit(-1))).withColumn("p", F.explode(pair))
    # of the keys only those of earlier bands are wanted
    codes = [F.slice("keys", F.lit(1), F.col("band")).alias("keys") if c == "keys" else F.col(c) for c in CODE if c != "dim"]
    each = each.select("band", "key", "dim", "p.bi", "p.bj", "own", *codes)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df: df.repartition(parts, *PLACE).sortWithinPartitions(*PLACE)
    near = dealt(each).mapInArrow(tidy(_meet(_left, least, sigmas)), "band int, key int, dim int, bi int, bj int, own int, cid long")
    near = work.keep(near, "near")
    # members with a possible partner get their codes again, and their vectors
    full = near.join(rows.drop("dim").hint("shuffle_merge"), "cid").join(classes.select("cid", "vec").hint("shuffle_merge"), "cid")
    full = full.select(*PLACE, "own", *codes, "vec")
    found = dealt(full).mapInArrow(tidy(_meet(_exact, least, sigmas)), "kind int, a long, b long, w long")
    found = work.keep(found, "links")

    degree = found.where("kind = 0").groupBy(F.col("a").alias("cid")).agg(F.sum("w").alias("w"))
    comp = components(found.where("kind = 1").select("a", "b"), work)
    named = classes.join(degree, "cid", "left").join(comp.withColumnRenamed("node", "cid"), "cid", "left")
    named = named.select("vec", (F.col("m") - 1 + F.coalesce("w", F.lit(0))).alias("links"), F.coalesce("component", "cid").alias("comp"))
    out = base.join(named, "vec", "left")
    valid = F.col("vec_id").isNotNull()
    component = F.when(valid, F.coalesce("comp", "vec_id"))
    return out.select("vec_id", F.when(valid, F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


ORACLE_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= {LEAST}
), reach AS (
  SELECT x AS a, y AS b FROM link UNION SELECT reach.a, link.y FROM reach JOIN link ON reach.b = link.x
), low AS (
  SELECT a, min(b) AS b FROM reach GROUP BY 1
)
SELECT e.vec_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(low.b, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(low.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN (SELECT x, count(*) AS n FROM link GROUP BY 1) l ON e.vec_id = l.x LEFT JOIN low ON e.vec_id = low.a
"""

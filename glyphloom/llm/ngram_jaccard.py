"""N-gram Jaccard join by adaptive multi-match prefixes.

A document's set is its distinct word 5-grams (words lower-cased A-Z only; a
document with fewer words has its whole word sequence as its one gram).  Two
documents link when ``|A & B| / |A | B| >= 0.75``, compared in integers.

Method (AdaptJoin; Wang, Li & Feng, SIGMOD 2012, spread over a cluster):

* Equal sets are one class with one representative; only those are joined.
* Grams are ordered by hash.  Two linked sets share at least ``l`` grams in their
  ``l``-prefixes, of ``n - ceil(0.75 n) + l`` grams each.
* A gram that more than ``light`` prefixes hold is *heavy*: the estimated cost of
  its candidates is its count.  A document lengthens its prefix until it has
  fewer than ``l`` heavy grams among ``l``-prefix grams, so a partner must share
  at least one light gram.  Only light grams generate pairs, each at most
  ``light`` per row.
* A pair is verified only when it shares so many prefix grams that the required
  overlap can still be reached, and when the parity sketches of the two sets do
  not differ in more cells than the sets may in members.  Texts are carried only
  for those pairs.
* First each document is compared with the pivot document it shares most grams
  with (a star); pairs inside one component need no further comparison, so a
  group of copies costs one comparison for each member, not all pairs.
  Heavy groups take several turns with other pivots, while that joins components.
* Documents almost wholly made of heavy grams (``>= 0.75 n``) cannot be reached
  through a light gram.  Those that share 1-prefix grams form families, which are
  compared whole, in pairs of blocks of bounded size; a pair of blocks returns a
  spanning forest of its links and never its pairs.

Defined results: null or empty text, or text without words: empty set, linked
with nothing, its own component.  Null ``doc_id``: its own component, null.
Repeated rows: the same row again.  Rows that repeat a doc_id with other texts:
their links are those of the doc_id.  A similarity of exactly 0.75 (a tie) links.
Very long texts are taken whole.  An empty table gives an empty table.  Other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm._kernels import Words, chunks, grams, list_array, mix, signed, tidy
from glyphloom.llm._packed import SCHEMA as PACKED
from glyphloom.llm._packed import packing, shared_rows
from glyphloom.llm._stage import Workspace, components

WORDS = 5
PERCENT = 75
LIGHT = 48
# In lengthened prefixes a gram may be so many times as frequent before it is heavy.
REACH = 2
# Turns of stars at most; a turn's pivots must share so much of a prefix to be tried,
# and one in 1/YIELD of them must link for another turn.  These only save work.
TURNS = 6
SHARE = 0.3
YIELD = 0.02
# Documents of a block, and grams of a matrix, in the comparison of families.
BLOCK = 256
WIDE = 8192
# Cells that tell which grams a later lengthening may bring: a bit each, of up to 1 MB on the driver and in each task; a multiple of 32768.
CELLS = 1 << 23
# Pairs whose sets are compared at once, and how many rows without texts one pair counts for in a task.
SLICE = 512
WEIGHT = 10


def gram_sets(column: pa.Array, words: int = WORDS):
    """The ascending gram hashes of each text, one after another."""
    for _, _, data, offsets in chunks(column):
        w = Words(data, offsets, lower=True)
        h = w.hashes()
        g = grams(h, words)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(g[a : b - words + 1])
            elif b > a:
                yield grams(h[a:b], b - a) ^ np.uint64(b - a)
            else:
                yield np.zeros(0, dtype=np.uint64)


def need(n: int, percent: int = PERCENT) -> int:
    """The least overlap of a set of n grams with any set it links with."""
    return -(-percent * n // 100)


def sketch(s: np.ndarray) -> bytes:
    """The parities of a set's numbers in each of 2 to 4 cells a member, by the low bits of its hashes."""
    cells = max(64, 1 << int(2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells).astype(np.uint8) & 1, bitorder="little").tobytes()


def apart(one: bytes, two: bytes) -> int:
    """No more than the number of members that only one of two sets has: each of them turns one parity."""
    if len(one) < len(two):
        one, two = two, one
    a, cells = int.from_bytes(one, "little"), 8 * len(one)
    while cells > 8 * len(two):
        cells //= 2
        a = (a >> cells) ^ (a & ((1 << cells) - 1))
    return (a ^ int.from_bytes(two, "little")).bit_count()


def _profiles(words: int, percent: int):
    odd = np.uint64(0xC2B2AE3D27D4EB4F)

    def run(batches):
        for batch in batches:
            sizes, c1, c2, prefix, plen, parity = [], [], [], [], [], []
            with np.errstate(over="ignore"):
                for s in gram_sets(batch.column(1), words):
                    n = len(s)
                    sizes.append(n)
                    c1.append(mix(s).sum(dtype=np.uint64))
                    c2.append(mix(s * odd).sum(dtype=np.uint64))
                    p = s[: n - need(n, percent) + 1] if n else s
                    prefix.append(p)
                    plen.append(len(p))
                    parity.append(sketch(s) if n else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(signed(np.array(c1, dtype=np.uint64))), pa.array(signed(np.array(c2, dtype=np.uint64))), list_array(signed(np.concatenate(prefix)) if prefix else np.zeros(0, np.int64), np.array(plen, dtype=np.int64)), pa.array(parity, pa.binary())],
                names=["doc_id", "n", "c1", "c2", "prefix", "sketch"],
            )

    return run


def _prefix_pairs(batch: pa.RecordBatch):
    lists = batch.column(1)
    size = np.diff(np.asarray(lists.offsets))
    yield lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.repeat(np.asarray(batch.column(0)), size)


def _sieve(grams_: DataFrame) -> np.ndarray:
    """A bitmap, of bounded size, of the cells of the grams (tok)."""
    cell = grams_.select(F.col("tok").bitwiseAND(F.lit(CELLS - 1)).alias("c"))
    rows = cell.groupBy(F.shiftright("c", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("c").bitwiseAND(F.lit(32767))).alias("bits")).collect()
    out = np.zeros(CELLS >> 3, dtype=np.uint8)
    for part, bits in rows:
        out[part << 12 : (part + 1) << 12] = np.frombuffer(bits, np.uint8)
    return out


def _inside(sieve: np.ndarray, keys: np.ndarray) -> np.ndarray:
    cell = keys & np.uint64(8 * len(sieve) - 1)
    return (sieve[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _sifted_pairs(sieve: np.ndarray):
    """The pairs whose gram is in the sieve."""

    def pairs(batch):
        for keys, docs in _prefix_pairs(batch):
            some = _inside(sieve, keys)
            yield keys[some], docs[some]

    return pairs


def _outside(sieve: np.ndarray):
    """The rows whose gram, in the first column, is not in the sieve."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(~_inside(sieve, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))

    return run


def _verifier(words: int, percent: int):
    """Keeps the pairs of texts that link; texts of one document come in runs, so sets are reused."""

    def run(batches):
        kept: dict[int, np.ndarray] = {}
        # a batch holds two texts a row: sets are made for a few rows at a time
        for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            x, y = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sets = {}
            new = {}
            for ids, col in ((x, 2), (y, 3)):
                last = [i for i, d in enumerate(ids) if d not in kept and new.setdefault(d, (col, i)) == (col, i)]
                if last:
                    for i, s in zip(last, gram_sets(batch.column(col).take(pa.array(last)), words), strict=True):
                        sets[ids[i]] = s
            sets |= kept
            ok = []
            for a, b in zip(x, y, strict=True):
                p, q = sets[a], sets[b]
                if len(p) > len(q):
                    p, q = q, p
                both = 0
                if len(p) and 100 * len(p) >= percent * len(q):
                    at = np.searchsorted(q, p)
                    at[at == len(q)] = 0
                    both = int((q[at] == p).sum())
                ok.append(100 * both >= percent * (len(p) + len(q) - both) and both > 0)
            kept = {y[-1]: sets[y[-1]]} if y else {}
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


def _possible(percent: int):
    """Keeps the pairs whose sketches let them link."""

    def run(batches):
        for batch in batches:
            size, sketches = (zip(*(batch.column(c).to_pylist() for c in two), strict=True) for two in ((2, 3), (4, 5)))
            ok = [(100 + percent) * apart(p, q) <= (100 - percent) * (m + n) for (m, n), (p, q) in zip(size, sketches, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


# Joins that carry texts never broadcast their other side, as that grows with the input.
def _verify(pairs: DataFrame, texts: DataFrame, sketches: DataFrame, words: int, percent: int, work: Workspace, rows: int) -> DataFrame:
    """The pairs that link.  Sketches rule out most of the others, so that few texts are carried."""
    one, two = (sketches.select(F.col("doc_id").alias(d), F.col("n").alias(f"n_{d}"), F.col("sketch").alias(f"s_{d}")).hint("shuffle_merge") for d in ("x", "y"))
    both = pairs.select("x", "y").join(one, "x").join(two, "y").select("x", "y", "n_x", "n_y", "s_x", "s_y")
    # rows that repeat a doc_id have a sketch each
    left = work.keep(both.mapInArrow(tidy(_possible(percent)), "x long, y long").distinct(), "possible")
    named = left.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct()
    read = work.keep(texts.join(named.hint("shuffle_merge"), "doc_id", "left_semi"), "pair-texts")
    one = read.select(F.col("doc_id").alias("x"), F.col("text").alias("tx"))
    two = read.select(F.col("doc_id").alias("y"), F.col("text").alias("ty"))
    both = left.join(one.hint("shuffle_merge"), "x").join(two.hint("shuffle_merge"), "y").select("x", "y", "tx", "ty")
    out = work.keep(both.mapInArrow(tidy(_verifier(words, percent)), "x long, y long"), "linked", WEIGHT * rows)
    work.drop(left, read)
    return out


def _extend(words: int, percent: int):
    """For each document with ``hot`` heavy grams in its 1-prefix: its prefix, longer by about twice what they call for; all grams if hot < 0."""

    def run(batches):
        for batch in batches:
            hot = batch.column(2).to_pylist()
            out, sizes = [], []
            for i, s in enumerate(gram_sets(batch.column(1), words)):
                p = len(s) - need(len(s), percent) + 1
                more = 2 * hot[i] * p // max(1, p - hot[i]) + 4
                out.append(s if hot[i] < 0 else s[: p + more])
                sizes.append(len(out[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), list_array(signed(np.concatenate(out)), np.array(sizes))], names=["doc_id", "grams"])

    return run


def _resolve(percent: int):
    """The least l-prefix with fewer than l heavy grams: its last gram, heavy grams in it, grams behind it.

    full: the document has no such prefix; open: it may lie beyond the grams given.
    """

    def run(batches):
        for batch in batches:
            last, seen, rest, full, wide = [], [], [], [], []
            for n, grams_, heavy in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                s = grams_.values.to_numpy(zero_copy_only=False).view(np.uint64)
                hot = np.isin(s, heavy.values.to_numpy(zero_copy_only=False).view(np.uint64)) if heavy.is_valid else np.zeros(len(s), dtype=bool)
                # l-1 heavy and p light grams make the wanted l-prefix
                end = int(np.searchsorted(np.cumsum(~hot), n - need(n, percent) + 1)) + 1
                full.append(end > n)
                wide.append(end > len(s) and len(s) < n)
                end = min(end, len(s))
                last.append(s[end - 1])
                seen.append(int(hot[:end].sum()))
                rest.append(n - end)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(signed(np.array(last, dtype=np.uint64))), pa.array(seen, pa.int64()), pa.array(rest, pa.int64()), pa.array(full, pa.bool_()), pa.array(wide, pa.bool_())],
                names=["doc", "last", "hot", "rest", "full", "open"],
            )

    return run


# Unsigned order of the signed hashes, as numpy sorted them.
def _u(c):
    return F.col(c).bitwiseXOR(F.lit(-(1 << 63)))


def _pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y), x < y, from different components that share enough light grams.

    rows: tok, doc, comp, n, last (of its prefix), rest (grams behind the prefix),
    hot (heavy grams in the prefix, which may be shared without being counted).
    """
    a = rows.select("tok", *[F.col(c).alias(f"{c}_x") for c in ("doc", "comp", "n", "last", "rest", "hot")])
    b = rows.select("tok", *[F.col(c).alias(f"{c}_y") for c in ("doc", "comp", "n", "last", "rest", "hot")])
    both = a.join(b, "tok").where("doc_x < doc_y and comp_x <> comp_y").where(F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * percent)
    wanted = F.ceil((F.col("n_x") + F.col("n_y")) * percent / F.lit(100.0 + percent) - F.lit(1e-9))
    behind = F.when(_u("last_x") < _u("last_y"), F.col("rest_x")).otherwise(F.col("rest_y"))
    # what a pair has to share follows from its documents, so its rows carry that one number
    same = both.select(F.col("doc_x").alias("x"), F.col("doc_y").alias("y"), (wanted - F.least("hot_x", "hot_y") - behind).cast("int").alias("lack"))
    return same.groupBy("x", "y").agg(F.count("*").alias("shared"), F.min("lack").alias("lack")).where("shared >= lack").select("x", "y")


def _star(rows: DataFrame, sizes: DataFrame, percent: int, share: float) -> DataFrame:
    """(x, y): each document y of rows (doc, pivot) with the pivot it shares most grams with, at least ``share`` of its prefix."""
    pivot = sizes.select(F.col("doc").alias("pivot"), F.col("n").alias("pivot_n"))
    both = rows.where("doc <> pivot").groupBy("doc", "pivot").agg(F.count("*").alias("k")).join(sizes.select("doc", "n"), "doc").join(pivot, "pivot")
    both = both.where(F.least("n", "pivot_n") * 100 >= F.greatest("n", "pivot_n") * percent).where(F.col("k") >= share * (100 - percent) / 100.0 * F.col("n"))
    return both.groupBy("doc").agg(F.max(F.struct(F.col("k"), (-F.col("pivot")).alias("m"))).alias("best")).select((-F.col("best.m")).alias("x"), F.col("doc").alias("y"))


def _block_links(words: int, percent: int):
    """Links inside a block, or between two, of a family: intersection sizes as a product of 0-1 matrices; a spanning forest of them is returned."""

    def compare(docs: list[tuple[int, int, str]], bi: int, bj: int) -> list[tuple[int, int]]:
        sets = list(gram_sets(pa.array([t for _, _, t in docs], pa.large_string()), words))
        size = np.array([len(s) for s in sets])
        grams_, place = np.unique(np.concatenate(sets), return_inverse=True)
        common = np.bincount(place) > 1  # grams of one document alone meet nothing
        column = np.cumsum(common) - 1
        row = np.repeat(np.arange(len(sets)), size)
        keep = common[place]
        own = np.array([b for _, b, _ in docs])
        left, right = np.flatnonzero(own == bi), np.flatnonzero(own == bj)
        both = np.zeros((len(left), len(right)), dtype=np.float32)
        for lo in range(0, int(common.sum()), WIDE):
            part = keep & (column[place] >= lo) & (column[place] < lo + WIDE)
            m = np.zeros((len(sets), WIDE), dtype=np.float32)
            m[row[part], column[place[part]] - lo] = 1
            both += m[left] @ m[right].T
        both = both.astype(np.int64)
        linked = (100 * both >= percent * (size[left][:, None] + size[right][None, :] - both)) & (both > 0)
        root = list(range(len(docs)))
        out = []

        def find(a: int) -> int:
            while root[a] != a:
                root[a] = root[root[a]]
                a = root[a]
            return a

        for i, j in zip(*np.nonzero(linked), strict=True):
            a, b = int(left[i]), int(right[j])
            p, q = find(a), find(b)
            if p != q:
                root[p] = q
                out.append((docs[a][0], docs[b][0]))
        return out

    def run(batches):
        held, last = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:3] != last:
                    links = compare(held, *last[1:])
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["x", "y"])
                    held = []
                last = row[:3]
                held.append(row[3:])
        if held:
            links = compare(held, *last[1:])
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["x", "y"])

    return run


def _families(hard: DataFrame, texts: DataFrame, parts: int, words: int, percent: int, work: Workspace) -> DataFrame:
    """Links (x, y) among the documents of rows (tok, doc): documents joined by shared grams are a family, compared in pairs of blocks."""
    pivots = hard.groupBy("tok").agg(F.min("doc").alias("b"))
    family = work.keep(components(hard.join(pivots, "tok").select(F.col("doc").alias("a"), "b"), work), "families")
    blocks = family.groupBy("component").agg(F.ceil(F.count("*") / F.lit(float(BLOCK))).cast("int").alias("blocks"))
    placed = family.join(blocks, "component").select(F.col("node").alias("doc_id"), F.col("component").alias("family"), "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("bi"), F.greatest(k, F.col("own")).alias("bj")))
    rows = texts.join(placed, "doc_id").withColumn("p", F.explode(pair)).select("family", "p.bi", "p.bj", "doc_id", "own", "text")
    return rows.repartition(parts, "family", "bi", "bj").sortWithinPartitions("family", "bi", "bj").mapInArrow(tidy(_block_links(words, percent)), "x long, y long")


def _union(tables: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.union, tables)


def jaccard_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, light: int = LIGHT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text)."""
    spark: SparkSession = docs.sparkSession
    work = Workspace(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = work.keep(docs.mapInArrow(tidy(_profiles(words, percent)), "doc_id long, n long, c1 long, c2 long, prefix array<long>, sketch binary"), "profiles")
    classes = work.keep(base.where("n > 0 and doc_id is not null").groupBy("n", "c1", "c2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members")), "classes")
    copies = base.select("doc_id", "n", "c1", "c2").join(classes.where("members > 1"), ["n", "c1", "c2"]).where("doc_id > rep").select("doc_id")
    reps = base.where("n > 0 and doc_id is not null").join(copies.hint("shuffle_merge"), "doc_id", "left_anti")

    # Shared grams, each with its count and a pivot document.
    packed = reps.select("doc_id", "prefix").mapInArrow(tidy(packing(parts, _prefix_pairs)), PACKED)
    rows = work.keep(shared_rows(packed, parts), "shared")
    ends = base.where("n > 0 and doc_id is not null").select(F.col("doc_id").alias("doc"), "n", F.element_at("prefix", -1).alias("last"))
    ends = ends.join(copies.withColumnRenamed("doc_id", "doc").hint("shuffle_merge"), "doc", "left_anti").dropDuplicates(["doc"])
    sizes = work.keep(ends.join(rows.select("doc").distinct(), "doc", "left_semi"), "sizes")

    slim = work.keep(base.drop("prefix", "sketch"), "sets")
    sketches = work.keep(base.where("n > 0 and doc_id is not null").select("doc_id", "n", "sketch").repartition(parts, "doc_id"), "sketches", by="doc_id")
    work.drop(base)

    # Stars: each document with the pivot it shares most grams with, then, in groups
    # of heavy grams, with other pivots as long as that links components.
    texts = work.keep(docs.join(sizes.select(F.col("doc").alias("doc_id")).hint("shuffle_merge"), "doc_id", "left_semi").distinct(), "texts", by="doc_id")
    known_docs = sizes.count()
    star = work.keep(_star(rows, sizes, percent, 0.0), "star", known_docs)
    links = _verify(star, texts, sketches, words, percent, work, known_docs)
    tried, linked = star, links
    # only documents with so many heavy grams can share enough of them with a pivot
    crowded = rows.where(F.col("cnt") > light).select("tok", "doc")
    able = crowded.groupBy("doc").agg(F.count("*").alias("k")).join(sizes.select("doc", "n"), "doc").where(F.col("k") >= SHARE * (100 - percent) / 100.0 * F.col("n")).select("doc")
    crowded = work.keep(crowded.join(able, "doc", "left_semi"), "crowded")
    for turn in range(1, TURNS + 1):
        comp = work.keep(components(linked.select(F.col("x").alias("a"), F.col("y").alias("b")), work, rows=known_docs), "star-components", known_docs)
        about = work.keep(sizes.join(comp.withColumnRenamed("node", "doc"), "doc", "left").select("doc", "n", "last", F.coalesce("component", "doc").alias("comp")), "about", known_docs)
        if turn == TURNS:
            break
        placed = crowded.join(about.select("doc", "comp"), "doc")
        pivots = placed.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct(F.xxhash64("doc", F.lit(turn)).alias("h"), "doc", "comp")).alias("p")).where("lo <> hi")
        again = placed.join(pivots.select("tok", F.col("p.doc").alias("pivot"), F.col("p.comp").alias("pivot_comp")), "tok").where("comp <> pivot_comp")
        star = work.keep(_star(again, sizes, percent, SHARE), "star", known_docs)
        count = star.count()
        if not count:
            break
        links = _verify(star, texts, sketches, words, percent, work, count)
        tried, linked = tried.union(star), linked.union(links)
        if links.count() < YIELD * count:
            comp = work.keep(components(linked.select(F.col("x").alias("a"), F.col("y").alias("b")), work, rows=known_docs), "star-components", known_docs)
            about = work.keep(sizes.join(comp.withColumnRenamed("node", "doc"), "doc", "left").select("doc", "n", "last", F.coalesce("component", "doc").alias("comp")), "about", known_docs)
            break

    # Grams whose documents lie in different components.
    known = work.keep(rows.select("tok", "doc", "cnt").join(about.select("doc", "comp"), "doc"), "known")
    work.drop(rows, crowded)
    split = known.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("tok")
    mixed = work.keep(known.join(split, "tok", "left_semi").select("tok", "doc", "cnt"), "mixed")
    work.drop(known)

    hot = mixed.where(F.col("cnt") > light).groupBy("doc").agg(F.count("*").alias("hot"))
    behind = F.ceil(F.col("n") * percent / F.lit(100.0) - F.lit(1e-9)) - 1
    easy = mixed.where(F.col("cnt") <= light).join(about.join(hot, "doc", "left"), "doc")
    easy = easy.select("tok", "doc", "comp", "n", "last", behind.alias("rest"), F.coalesce("hot", F.lit(0)).alias("hot"))
    found = [_pairs(easy, percent)]

    # Documents with heavy grams: longer prefixes.  A gram is heavy here if more than REACH * light of these prefixes hold it.
    wanted = work.keep(hot.select(F.col("doc").alias("doc_id"), "hot", F.lit(None).cast("long").alias("least")), "heavy", known_docs)
    hard = None
    # Tables of grams by document; what a later one has is left out of those before.
    grams_: list[DataFrame] = []
    extended = None
    while wanted.limit(1).count():
        ext = texts.join(wanted.hint("shuffle_merge"), "doc_id").select("doc_id", "text", "hot").mapInArrow(tidy(_extend(words, percent)), "doc_id long, grams array<long>")
        longer = work.keep(ext, "extended", by="doc_id")
        grams_ = [g.join(wanted.hint("shuffle_merge"), "doc_id", "left_anti") for g in grams_] + [longer]
        pairs = _prefix_pairs
        if extended is not None:
            # only grams behind the old prefixes of the lengthened documents have new counts: the others' rows stay, and are not dealt again
            behind_ = longer.join(wanted.hint("shuffle_merge"), "doc_id").select("least", F.explode("grams").alias("tok")).where(_u("tok") > F.col("least"))
            sieve = _sieve(behind_)
            pairs = _sifted_pairs(sieve)
        packed = _union(grams_).mapInArrow(tidy(packing(parts, pairs)), PACKED)
        rows = work.keep(shared_rows(packed, parts).select("tok", "doc", "cnt").join(about.select("doc", "comp"), "doc").select("tok", "doc", "cnt", "comp"), "extended-rows")
        split = rows.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("tok")
        fresh = rows.join(split, "tok", "left_semi")
        if extended is not None:
            fresh = fresh.union(extended.mapInArrow(tidy(_outside(sieve)), extended.schema))
        before, extended = extended, work.keep(fresh, "extended-mixed")
        work.drop(rows, *([before] if before is not None else []))
        skip = extended.where(F.col("cnt") > REACH * light).groupBy(F.col("doc").alias("doc_id")).agg(F.collect_set("tok").alias("skip"))
        known_n = about.select(F.col("doc").alias("doc_id"), "n")
        sized = _union([g.join(known_n, "doc_id").join(skip, "doc_id", "left").select("doc_id", "n", "grams", "skip") for g in grams_])
        meta = work.keep(sized.mapInArrow(tidy(_resolve(percent)), "doc long, last long, hot long, rest long, full boolean, open boolean"), "resolved")
        # rows that repeat a doc_id are lengthened together
        wide = meta.groupBy(F.col("doc").alias("doc_id")).agg(F.max("open").alias("open"), F.min(_u("last")).alias("least")).where("open")
        wanted = work.keep(wide.select("doc_id", F.lit(-1).cast("long").alias("hot"), "least"), "open", known_docs)
        if wanted.limit(1).count():
            continue
        ready = extended.where(F.col("cnt") <= REACH * light).join(meta, "doc").where(_u("tok") <= _u("last")).join(about.select("doc", "n"), "doc")
        found.append(_pairs(ready.select("tok", "doc", "comp", "n", "last", "rest", "hot"), percent))
        # Nearly all of their grams are heavy: families of documents that share 1-prefix grams, block by block.
        whole = meta.where("full").select("doc")
        hard = work.keep(mixed.join(whole, "doc", "left_semi").select("tok", "doc"), "hard")
        break

    candidates = _union(found)
    tried = tried.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    candidates = work.keep(candidates.distinct().join(tried, ["x", "y"], "left_anti"), "candidates")
    more = _verify(candidates, texts, sketches, words, percent, work, known_docs)
    if hard is not None:
        more = more.union(_families(hard, texts, parts, words, percent, work))
    more = work.keep(more, "more-links", WEIGHT * known_docs)
    both = linked.union(more).select(F.col("x").alias("a"), F.col("y").alias("b"))
    comp = work.keep(components(both, work, rows=known_docs), "components", known_docs)
    work.drop_but(slim, classes, comp)

    member = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("n", "c1", "c2", F.coalesce("component", "rep").alias("component_id"))
    return slim.join(member, ["n", "c1", "c2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )


ORACLE_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents
), gram AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[k:k + {WORDS - 1}], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - {WORDS - 1}, 1))) AS k FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM gram GROUP BY 1
), both_ AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM gram a JOIN gram b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT x, y FROM both_ JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * k >= {PERCENT} * (a.n + b.n - k)
), reach AS (
  SELECT x AS a, y AS b FROM link UNION SELECT y, x FROM link
  UNION
  SELECT reach.a, l.b FROM reach JOIN (SELECT x AS a, y AS b FROM link UNION ALL SELECT y, x FROM link) l ON reach.b = l.a
), low AS (
  SELECT a, min(b) AS b FROM reach GROUP BY 1
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(low.b, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN low ON w.doc_id = low.a
"""

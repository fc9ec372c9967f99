"""Benchmark decontamination: n-gram seeds, an exact word bound, then Smith-Waterman alignment.

Words are runs of ASCII letters and digits and of bytes beyond ASCII, A-Z
lower-cased.  For each benchmark item:

* all of its word ``seed``-grams are seeds, frequent or not: in documents that
  hold the same edited copy, the grams they share are the frequent ones;
* one pass over the documents finds the stretches around shared seeds, and keeps
  those with enough of the item's words for the best alignment to reach the
  limits below: no alignment has more equal words than that;
* these are aligned with the whole item: local alignment, ``MATCH`` for equal
  words, ``MISS`` for others and for gaps.

A document and an item match if the best alignment reaches ``least`` of the
item's full score, and has ``few`` equal words, or all of a shorter item's.

The benchmark is read in slices of at most ``slice_grams`` grams (32 MB), each
broadcast within that bound and followed by a pass whose matches are written
before the next slice is read, so it may have any size; a benchmark of one slice
needs one pass and writes nothing.  The pass is without shuffles of text;
documents of a hot passage are aligned where they lie.

Defined results: null or empty text or item, or one without words: no match.
Items of fewer than ``seed`` words: their whole word sequence is their seed.
Null doc_id or item_id: matched like any other.  Repeated rows: a match each;
repeated item_ids are one match each with the best of its rows.  Of equally good
alignments (ties) one is reported.  Very long texts are searched whole.  An empty
table of documents or items gives no match.  Other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.llm._kernels import _SPACE, Words, chunks, grams, tidy
from glyphloom.llm._stage import Workspace

SEED = 3
LEAST = 0.5
FEW = 8
MATCH, MISS = 2, -1
SLICE_GRAMS = 1_000_000
# Places of seeds that are laid out at once.
TOGETHER = 1 << 18

_NOT_WORD = np.ones(256, dtype=bool)
_NOT_WORD[48:58] = _NOT_WORD[65:91] = _NOT_WORD[97:123] = _NOT_WORD[128:] = False
assert _SPACE.shape == _NOT_WORD.shape


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first word of each text, text of each word)."""
    w = Words(np.where(_NOT_WORD[data], np.uint8(32), data), offsets, lower=True)
    return w.hashes(), w.first, w.doc


class Items:
    """A bounded slice of the benchmark: words and grams of its items."""

    def __init__(self, ids: list, texts: list[str], seed: int):
        column = pa.array([t or "" for t in texts], pa.large_string())
        self.ids, self.words, self.seed = ids, [], seed
        for _, _, data, offsets in chunks(column):
            h, first, _ = word_hashes(data, offsets)
            self.words += [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        gram, item, at = [], [], []
        for k, h in enumerate(self.words):
            g = grams(h, seed) if len(h) >= seed else (grams(h, len(h)) ^ np.uint64(len(h)) if len(h) else h)
            gram.append(g)
            item.append(np.full(len(g), k))
            at.append(np.arange(len(g)))
        self.gram, self.item, self.at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (gram, item, at))
        self.short = sorted({len(h) for h in self.words if 0 < len(h) < seed})

    def document_grams(self, h: np.ndarray, doc: np.ndarray):
        """(gram hashes, first words) of documents at the items' gram lengths."""
        for n in (self.seed, *self.short):
            if len(h) < n:
                continue
            g = grams(h, n)
            ok = np.flatnonzero(doc[: len(g)] == doc[n - 1 :])
            yield (g[ok] if n == self.seed else g[ok] ^ np.uint64(n)), ok


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices of keys that are there, their places)."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    hit = np.flatnonzero(sorted_keys[at] == keys)
    return hit, at[hit]


def align(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int, int]:
    """(score, equal words, start, end in y) of the best local alignment of the whole of x's words with a stretch of y."""
    n = len(y)
    step = -MISS * np.arange(n + 1)
    h = np.zeros(n + 1, dtype=np.int64)
    same = np.zeros(n + 1, dtype=np.int64)
    begin = np.arange(n + 1)
    best = (0, 0, 0, 0)
    for word in x.tolist():
        eq = np.concatenate([[False], y == np.uint64(word)])
        diag = np.full(n + 1, -1, dtype=np.int64)
        diag[1:] = h[:-1] + np.where(eq[1:], MATCH, MISS)
        up = h + MISS
        t = np.maximum(diag, up)
        from_diag = diag >= up
        t_same = np.where(from_diag, np.concatenate([[0], same[:-1]]) + eq, same)
        t_begin = np.where(from_diag, np.concatenate([[0], begin[:-1]]), begin)
        dead = t <= 0
        t[dead], t_same[dead] = 0, 0
        t_begin[dead] = np.arange(n + 1)[dead]
        # gaps in x: the best of what lies to the left, less its distance
        lifted = t + step
        lead = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == lead, np.arange(n + 1), 0))
        h = lead - step
        same, begin = t_same[source], t_begin[source]
        k = int(np.argmax(h))
        if h[k] > best[0]:
            best = (int(h[k]), int(same[k]), int(begin[k]), k)
    return best


def _spans(items: Items, keys: np.ndarray, entry: np.ndarray, first: np.ndarray, h: np.ndarray, start: np.ndarray, doc: np.ndarray):
    """(text, item, first word, end word) of the merged stretches around seeds, by text and item."""
    found = [(ok[hit], place) for g, ok in items.document_grams(h, doc) for hit, place in [_find(keys, g)]]
    word, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in ([f[0] for f in found], [f[1] for f in found]))
    order = np.argsort(word, kind="stable")
    word, place = word[order], place[order]
    times = first[place + 1] - first[place]
    ends = np.append(np.flatnonzero(doc[word[1:]] != doc[word[:-1]]) + 1, len(word)) if len(word) else np.zeros(0, np.int64)
    size = np.array([len(x) for x in items.words], dtype=np.int64)
    done = 0
    for k, stop in enumerate(ends.tolist()):
        # whole texts, about TOGETHER places at a time
        if k + 1 < len(ends) and times[done : ends[k + 1]].sum() <= TOGETHER:
            continue
        n = times[done:stop]
        at = np.repeat(first[place[done:stop]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        e, w = entry[at], np.repeat(word[done:stop], n)
        done = stop
        d, it, m = doc[w], items.item[e], size[items.item[e]]
        lo = np.maximum(w - items.at[e] - m // 2 - 1, start[d])
        hi = np.minimum(w - items.at[e] + m + m // 2 + 1, start[d + 1])
        order = np.lexsort((hi, lo, it, d))
        d, it, lo, hi = d[order], it[order], lo[order], hi[order]
        new = np.ones(len(d), dtype=bool)
        new[1:] = (d[1:] != d[:-1]) | (it[1:] != it[:-1]) | (lo[1:] > hi[:-1])
        a = np.flatnonzero(new)
        yield from zip(d[a].tolist(), it[a].tolist(), lo[a].tolist(), hi[np.append(a[1:], len(d)) - 1].tolist(), strict=True)


def _matches(items: Items, keys: np.ndarray, entry: np.ndarray, first: np.ndarray, least: float, few: int):
    """keys: sorted seeds; entry[first[k] : first[k+1]] are the places in items' grams of seed k."""

    def run(batches):
        for batch in batches:
            rows, item, score, same, begin, end = [], [], [], [], [], []
            for i, _, data, offsets in chunks(batch.column(1)):
                h, start, doc = word_hashes(data, offsets)
                found: dict[tuple[int, int], tuple[int, ...]] = {}
                for d, it, lo, hi in _spans(items, keys, entry, first, h, start, doc):
                    x = items.words[it]
                    m = len(x)
                    # equal words are at most the item's words that occur in the stretch
                    most = int(np.isin(x, h[lo:hi]).sum())
                    if MATCH * most >= least * MATCH * m and most >= min(few, m):
                        found[d, it] = max((*align(x, h[lo:hi]), lo), found.get((d, it), (0,)))
                for (d, it), best in found.items():
                    m = len(items.words[it])
                    if best[0] >= least * MATCH * m and best[1] >= min(few, m):
                        rows.append(i + d)
                        item.append(items.ids[it])
                        score.append(best[0] / (MATCH * m))
                        same.append(best[1])
                        begin.append(best[4] + best[2] - int(start[d]))
                        end.append(best[4] + best[3] - int(start[d]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(item, pa.int64()), pa.array(score, pa.float64()), *[pa.array(c, pa.int64()) for c in (same, begin, end)]], names=["doc_id", "item_id", "score", "n_equal", "word_start", "word_stop"]
            )

    return run


_SCHEMA = "doc_id long, item_id long, score double, n_equal long, word_start long, word_stop long"


def _slices(benchmark: DataFrame, seed: int, slice_grams: int):
    """Items of the benchmark, in slices whose grams are bounded; read by toLocalIterator, a partition at a time."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        n = (len(row[1]) if row[1] else 0) // 2 + 1  # a gram takes a word and a gap
        if ids and size + n > slice_grams:
            yield Items(ids, texts, seed)
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        size += n
    if ids:
        yield Items(ids, texts, seed)


def contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, least: float = LEAST, few: int = FEW, slice_grams: int = SLICE_GRAMS) -> DataFrame:
    """doc_id, item_id, score, n_equal, word_start, word_stop of every matching document (doc_id, text) and item (item_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    done, last, work = [], None, None
    for items in _slices(benchmark, seed, slice_grams):
        if last is not None:
            work = work or Workspace(spark, "contaminated")
            done.append(work.keep(last, "slice"))
        entry = np.argsort(items.gram, kind="stable")
        keys, first = np.unique(items.gram[entry], return_index=True)
        last = docs.mapInArrow(tidy(_matches(items, keys, entry, np.append(first, len(entry)), least, few)), _SCHEMA)
    if last is None:
        return spark.createDataFrame([], _SCHEMA)
    for found in done:
        last = last.union(found)
    return last

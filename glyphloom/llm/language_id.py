"""Language identification by multilingual mixture inference.

A document's byte 4-grams (ASCII letters lower-cased, other ASCII taken as a
separator; a word of one letter is a gram with the separators around it, so any
text with a letter has a gram) are draws from a mixture of the learned languages'
4-gram models.  Expectation-maximisation estimates the document's proportions of
all learned languages; then sets of them, of growing size in order of their
shares, compete by penalised likelihood, and the largest share of the winning set
is the prediction.  Models are add-``alpha`` counts over ``2**bits`` hashed
4-grams, learned from labelled documents.

Training reads a bounded sample: about ``per_language`` documents of each
language, picked by a hash of doc_id.  Every label is learned: the model has at
most ``cells`` floats (32 MB) as there are fewer hash bits the more languages
there are, and so is safe to broadcast.  Everything else reads all documents,
whole.

Defined results: null or empty text, or text without a letter: ``und``, score 0.
No language learned: ``und``, score 0.  Null doc_id: held_out null, predicted
like any other.  Equal shares or likelihoods (ties): the first label in order.
Repeated rows: the same row again.  Very long texts are read whole.  An empty
table gives an empty table.  Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.llm._kernels import chunks, tidy

BITS = 16
PER_LANGUAGE = 2000
CELLS = 1 << 23
ALPHA = 0.02
PENALTY = 3.0

_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 4-grams of each text between separators, and where each text's begin; -1 for grams that say nothing."""
    docs = len(offsets) - 1
    size = np.diff(offsets)
    out = np.full(len(data) + 3 * docs, 32, dtype=np.uint32)
    shift = np.repeat(1 + 3 * np.arange(docs), size)
    out[np.arange(len(data)) + shift] = _FOLD[data]
    if len(out) < 4:
        return np.zeros(0, np.int64), np.zeros(docs + 1, np.int64)
    code = out[:-3] | out[1:-2] << np.uint32(8) | out[2:-1] << np.uint32(16) | out[3:] << np.uint32(24)
    h = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    h = h.astype(np.int64)
    # two or more separators in a row say nothing, but behind a word of one letter
    h[(code & np.uint32(0xFFFF)) == 0x2020] = -1
    h[(code >> np.uint32(16) == 0x2020) & (code & np.uint32(0xFF) != 32)] = -1
    begin = offsets + 3 * np.arange(docs + 1)
    for k in (1, 2, 3):  # grams that reach into the next text
        edge = begin[1:] - k
        h[edge[(edge >= 0) & (edge < len(h))]] = -1
    return h, np.minimum(begin, len(h))


def _count(languages: list[str], bits: int):
    place = {lang: k for k, lang in enumerate(languages)}

    def run(batches):
        total = np.zeros((len(languages), 1 << bits), dtype=np.int64)
        for batch in batches:
            lang = [place[x] for x in batch.column(1).to_pylist()]
            for i, j, data, offsets in chunks(batch.column(0)):
                h, begin = features(data, offsets, bits)
                row = np.repeat(np.array(lang[i:j], dtype=np.int64), np.diff(begin))
                ok = h >= 0
                total += np.bincount((row[ok] << bits) + h[ok], minlength=total.size).reshape(total.shape)
        k, f = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(f.astype(np.int32)), pa.array(total[k, f])], names=["k", "f", "c"])

    return run


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, bits: int = BITS, cells: int = CELLS, alpha: float = ALPHA) -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihoods [2**bits, languages]) from labelled rows (doc_id, text, lang); fewer bits if the table had more than ``cells`` cells."""
    docs = docs.where("text is not null and lang is not null")
    sizes = docs.groupBy("lang").count().collect()
    if not sizes:
        return [], np.zeros((1 << bits, 0), dtype=np.float32)
    while bits > 8 and len(sizes) << bits > cells:
        bits -= 1
    share = F.lit(0.0)
    for row in sizes:
        share = F.when(F.col("lang") == row["lang"], min(1.0, per_language / row["count"])).otherwise(share)
    unit = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("text"))), F.lit(1 << 30)) / float(1 << 30)
    picked = docs.where(unit < share).select("text", "lang")
    languages = sorted(r["lang"] for r in sizes)
    counts = picked.mapInArrow(tidy(_count(languages, bits)), "k int, f int, c long").groupBy("k", "f").agg(F.sum("c").alias("c")).toPandas()
    table = np.zeros((1 << bits, len(languages)))
    table[counts.f.to_numpy(), counts.k.to_numpy()] = counts.c.to_numpy()
    seen = table.sum(axis=0) > 0
    languages, table = [x for x, s in zip(languages, seen, strict=True) if s], table[:, seen]
    return languages, np.log((table + alpha) / (table.sum(axis=0) + alpha * (1 << bits))).astype(np.float32)


def _em(like: np.ndarray, count: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Shares of the columns of ``like`` and the log-likelihood (of likelihoods as given)."""
    n, k = count.sum(), like.shape[1]
    pi = np.full(k, 1.0 / k)
    for _ in range(rounds):
        mass = like @ pi
        new = pi * ((count / mass) @ like) / n
        if np.abs(new - pi).max() < 1e-3:
            pi = new
            break
        pi = new
    return pi, float(count @ np.log(like @ pi))


def mixture(logs: np.ndarray, count: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """(columns of the chosen languages, their shares) for grams with these log-likelihoods and counts."""
    order = np.argsort(-(count @ logs), kind="stable")
    if len(order) == 1:
        return order, np.ones(1)
    logs = logs[:, order]
    top = logs.max(axis=1)
    like = np.exp(logs - top[:, None]).astype(np.float64)
    one = float(count @ (logs[:, 0] - top))
    # a 4-gram overlaps its neighbours, so a text has about a quarter as many independent draws
    cost = penalty * 0.5 * np.log(max(count.sum() / 4.0, 2.0))
    pi, best = _em(like, count)
    if (best - one) / 4.0 <= cost:  # no set can gain more than the full mixture does
        return order[:1], np.ones(1)
    rank = np.argsort(-pi, kind="stable")
    chosen, shares, score = order[:1], np.ones(1), one / 4.0
    for size in range(1, len(order) + 1):
        if best / 4.0 - cost * (size - 1) <= score:  # nor can any larger set
            break
        cols = rank[:size]
        p, ll = _em(like[:, cols], count) if size > 1 else (np.ones(1), float(count @ (logs[:, cols[0]] - top)))
        if ll / 4.0 - cost * (size - 1) > score:
            chosen, shares, score = order[cols], p, ll / 4.0 - cost * (size - 1)
    return chosen, shares


def _predict(languages: list[str], logs: np.ndarray, penalty: float):
    bits = len(logs).bit_length() - 1

    def run(batches):
        for batch in batches:
            letters = batch.column(2).to_pylist()
            pred, score, shares = [], [], []
            for i, j, data, offsets in chunks(batch.column(1)):
                h, begin = features(data, offsets, bits)
                for k in range(j - i):
                    f = h[begin[k] : begin[k + 1]]
                    f = f[f >= 0]
                    if not letters[i + k] or not len(f) or not languages:
                        pred.append("und")
                        score.append(0.0)
                        shares.append([])
                        continue
                    c = np.bincount(f, minlength=1) if len(f) > 20000 else None
                    f, c = (np.flatnonzero(c), c[c > 0]) if c is not None else np.unique(f, return_counts=True)
                    cols, pi = mixture(logs[f], c.astype(np.float64), penalty)
                    o = np.argsort(-pi, kind="stable")
                    pred.append(languages[cols[o[0]]])
                    score.append(float(min(1.0, pi[o[0]])))
                    shares.append([{"lang": languages[cols[x]], "share": float(pi[x])} for x in o])
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            out = [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(shares, kind), *batch.columns[3:]]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "lang_pred", "score", "languages", *batch.schema.names[3:]])

    return run


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str] = (), penalty: float = PENALTY) -> DataFrame:
    """doc_id, lang_pred, score, languages (array of lang and share) for every row of docs (doc_id, text); columns to keep follow, named kept_*."""
    languages, logs = model
    kept = [F.col(c).alias(f"kept_{c}") for c in keep]
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), *kept)
    extra = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in ready.schema.fields[3:])
    return ready.mapInArrow(tidy(_predict(languages, logs, penalty)), "doc_id long, lang_pred string, score double, languages array<struct<lang:string,share:double>>" + extra)


def fold(modulus: int):
    """The remainder of crc32 of doc_id as text."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def language_id(docs: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from documents outside the held-out fold."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    model = train(docs.where(fold(folds) != held))
    return identify(docs, model).select("doc_id", (fold(folds) == held).alias("held_out"), "lang_pred", "score", "languages")

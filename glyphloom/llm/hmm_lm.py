"""Hidden Markov language model: Baum-Welch over partitions, scaled forward scores.

Tokens are a text's words (A-Z lower-cased) and one end token.  ``states``
latent states emit *symbols*: each of the ``head`` most frequent words, the end,
and one of ``classes`` classes that all other words fall into by hash; the word
behind a class is drawn from its class by add-one counts, whatever the state:

    P(text) = forward(symbols) * product over class tokens of (c+1)/(T_k+V_k+1)

with T_k the tokens and V_k the different words of class k in training.  So every
word takes part in the latent chain, and the model is a proper distribution over
token strings, with one share in each class for all its words never seen.
Baum-Welch's expected counts are taken over every training document: a partition
adds up its own, the sums of all partitions re-estimate the model.  All
``rounds`` rounds read all training documents, whose symbols are written once.

The emission table (at most (head + classes) * states floats, 3 MB) is bounded
by parameters and broadcast.  The counts of words are not bounded: there is one
for each different training word, and each document's different class words are
joined to them.

Words are told apart by 64-bit hashes (at 10^8 different words the chance of any
collision is about 3 in 10^4).

Defined results: null or empty text is the end token alone.  Null doc_id: in no
training fold, held_out null, scored like any other.  Repeated rows: the same
row again, each counting in training.  Equally frequent words (ties) enter the
head in order of their hashes.  Very long texts are read whole.  No training
document: N = 0, every probability falls back to the uniform share.  An empty
table gives an empty table.  Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.llm._kernels import Words, chunks, list_array, signed, tidy
from glyphloom.llm._stage import Workspace
from glyphloom.llm.language_id import fold

HEAD = 32768
CLASSES = 1 << 14
STATES = 8
ROUNDS = 5
BUFFER = 1 << 19
# Tokens that go through the recursions together: texts of like length share their steps.
TOGETHER = 1 << 19


def _flush_counts(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(parts), return_counts=True)


def _word_counts(batches):
    """(word, count) of the texts, added up within the task as far as the buffer goes."""
    held, size = [], 0
    for batch in batches:
        for _, _, data, offsets in chunks(batch.column(0)):
            h = Words(data, offsets, lower=True).hashes()
            held.append(h)
            size += len(h)
            if size > BUFFER:
                w, c = _flush_counts(held)
                yield pa.RecordBatch.from_arrays([pa.array(signed(w)), pa.array(c.astype(np.int64))], names=["w", "c"])
                held, size = [], 0
    if size:
        w, c = _flush_counts(held)
        yield pa.RecordBatch.from_arrays([pa.array(signed(w)), pa.array(c.astype(np.int64))], names=["w", "c"])


class Head:
    """The symbols: places of the head words by sorted hash, then the end, then the classes of all other words."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, ends: int, tokens: np.ndarray, kinds: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.logs = np.concatenate([np.log10(np.append(self.counts, ends) + 1.0), np.zeros(len(tokens))])  # none for classes
        self.shares = np.concatenate([np.zeros(len(hashes) + 1), -np.log10(tokens + kinds + 1.0)])
        self.end = len(hashes)
        self.size = self.end + 1 + len(tokens)
        self.shift = np.uint64(64 - (len(tokens).bit_length() - 1))
        self.prior = np.concatenate([self.counts, [ends], tokens]) + 1.0
        self.prior /= self.prior.sum()

    def ids(self, h: np.ndarray) -> np.ndarray:
        other = (h >> self.shift).astype(np.int32) + np.int32(self.end + 1)
        if not self.end:
            return other
        at = np.searchsorted(self.hashes, h)
        at[at == self.end] = 0
        return np.where(self.hashes[at] == h, at, other).astype(np.int32)


def sequences(column: pa.Array, head: Head):
    """(first row, end row, hashes, ids, first token of each text incl. its end token) in chunks."""
    for i, j, data, offsets in chunks(column):
        w = Words(data, offsets, lower=True)
        h = w.hashes()
        docs = j - i
        at = np.arange(len(h)) + w.doc
        ids = np.full(len(h) + docs, head.end, dtype=np.int32)
        ids[at] = head.ids(h)
        yield i, j, w, h, ids, w.first + np.arange(docs + 1)


class Model:
    """start [K], step [K, K] and emit [head size, K] probabilities."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.start, self.step, self.emit = start, step, emit

    @staticmethod
    def first(prior: np.ndarray, states: int, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        emit = prior[:, None] * rng.gamma(2.0, 0.5, (len(prior), states))
        emit /= emit.sum(axis=0)
        step = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(step, 0.9 if states > 1 else 1.0)
        return Model(np.full(states, 1.0 / states), step, emit)

    @staticmethod
    def estimate(start: np.ndarray, step: np.ndarray, emit: np.ndarray, prior: np.ndarray, weight: float = 20.0) -> Model:
        """From expected counts; the prior keeps every head word possible in every state."""
        emit = emit + weight * prior[:, None]
        step = step + 0.1
        start = start + 0.1
        return Model(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def together(chunks_: Iterator[tuple], most: int = TOGETHER) -> Iterator[list[tuple]]:
    """Chunks from ``sequences`` in lists of about ``most`` tokens."""
    held, size = [], 0
    for c in chunks_:
        held.append(c)
        size += len(c[4])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def joined(held: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, begin) of several chunks as one."""
    ids = np.concatenate([c[4] for c in held])
    shift = np.cumsum([0, *[len(c[4]) for c in held]])
    return ids, np.concatenate([*[c[5][:-1] + at for c, at in zip(held, shift, strict=False)], shift[-1:]])


def _groups(begin: np.ndarray, rows: int = 512):
    """Texts of similar length, longest first: (texts, their lengths)."""
    size = np.diff(begin)
    order = np.argsort(-size, kind="stable")
    for k in range(0, len(order), rows):
        yield order[k : k + rows], size[order[k : k + rows]]


def forward(ids: np.ndarray, begin: np.ndarray, model: Model) -> np.ndarray:
    """log10 probability of each text, by the scaled forward recursion over many texts at once."""
    out = np.zeros(len(begin) - 1)
    for docs, size in _groups(begin):
        at = begin[docs]
        alpha = model.start[None, :] * model.emit[ids[at]]
        total = np.zeros(len(docs))
        live = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # texts longer than t
        for t in range(size[0]):
            n = live[t]
            if t:
                alpha = (alpha[:n] @ model.step) * model.emit[ids[at[:n] + t]]
            scale = alpha.sum(axis=1)
            alpha /= scale[:, None]
            total[:n] += np.log10(scale)
        out[docs] = total
    return out


def expected(ids: np.ndarray, begin: np.ndarray, model: Model, sums: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
    """Adds the texts' expected start, step and emission counts to ``sums`` (forward-backward, scaled)."""
    start, step, emit = sums
    k = len(model.start)
    table, move, first = model.emit.astype(np.float32), model.step.astype(np.float32), model.start.astype(np.float32)
    back, one = np.ascontiguousarray(move.T), np.ones(k, dtype=np.float32)
    for docs, size in _groups(begin):
        at, longest = begin[docs], int(size[0])
        live = np.searchsorted(-size, -np.arange(1, longest + 1), side="right").tolist()
        rows = [0, *np.cumsum(live).tolist()]
        order = ids[np.concatenate([at[:n] + t for t, n in enumerate(live)])]
        emits = table[order]
        alphas = np.empty_like(emits)
        scales = np.empty(rows[-1], dtype=np.float32)
        for t in range(longest):
            a, b = rows[t], rows[t + 1]
            x = alphas[a:b]
            if t:
                np.matmul(alphas[rows[t - 1] : rows[t - 1] + b - a], move, out=x)
                x *= emits[a:b]
            else:
                np.multiply(emits[a:b], first, out=x)
            scale = scales[a:b]
            np.matmul(x, one, out=scale)
            x /= scale[:, None]
        # emits turns into what each step hands back: emission * beta / scale
        emits /= scales[:, None]
        betas = np.ones_like(emits)
        for t in range(longest - 2, -1, -1):
            a, b, c = rows[t], rows[t + 1], rows[t + 2]
            carry = emits[b:c]
            carry *= betas[b:c]
            np.matmul(carry, back, out=betas[a : a + c - b])
        if longest > 1:
            before = np.concatenate([np.arange(rows[t], rows[t] + live[t + 1]) for t in range(longest - 1)])
            step += model.step * (alphas[before].T @ emits[rows[1] :]).astype(np.float64)
        alphas *= betas
        alphas /= (alphas @ one)[:, None]
        start += alphas[: rows[1]].sum(axis=0, dtype=np.float64)
        for s in range(k):
            emit[:, s] += np.bincount(order, weights=alphas[:, s], minlength=len(emit))


def _encode(head: Head):
    """The head ids of each text, with its end token."""

    def run(batches):
        for batch in batches:
            for *_, ids, begin in sequences(batch.column(0), head):
                yield pa.RecordBatch.from_arrays([list_array(ids, np.diff(begin))], names=["ids"])

    return run


def encoded(column: pa.Array, most: int = TOGETHER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, begin) of the texts of a column from ``_encode``, about ``most`` tokens at a time."""
    offsets = column.offsets.to_numpy()
    ids = column.values.to_numpy()
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield ids[offsets[i] : offsets[j]], offsets[i : j + 1].astype(np.int64) - offsets[i]
        i = j


def _baum_welch(head: Head, model: Model):
    """One row for each head word with its expected count by state; word -1 has start, -2-s the steps from s."""
    k = len(model.start)

    def run(batches):
        sums = (np.zeros(k), np.zeros((k, k)), np.zeros((head.size, k)))
        for batch in batches:
            for ids, begin in encoded(batch.column(0)):
                expected(ids, begin, model, sums)
        start, step, emit = sums
        used = np.flatnonzero(emit.any(axis=1))
        word = np.concatenate([used, [-1], -2 - np.arange(k)]).astype(np.int32)
        rows = np.vstack([emit[used], start[None, :], step])
        yield pa.RecordBatch.from_arrays([pa.array(word), *[pa.array(rows[:, s]) for s in range(k)]], names=["word", *[f"s{s}" for s in range(k)]])

    return run


def _round(docs: DataFrame, head: Head, model: Model, prior: np.ndarray) -> Model:
    k = len(model.start)
    schema = "word int, " + ", ".join(f"s{s} double" for s in range(k))
    got: pd.DataFrame = docs.mapInArrow(tidy(_baum_welch(head, model)), schema).groupBy("word").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(k)]).toPandas()
    table = np.zeros((head.size + 1 + k, k))
    word = got.word.to_numpy()
    table[np.where(word >= 0, word, head.size - 1 - word)] = got[[f"s{s}" for s in range(k)]].to_numpy()
    return Model.estimate(table[head.size], table[head.size + 1 :], table[: head.size], prior)


def _scores(head: Head, model: Model):
    """Scores of symbols, and each text's different class words with their counts."""

    def run(batches):
        for batch in batches:
            for held in together(sequences(batch.column(1), head)):
                scores = forward(*joined(held), model)
                for i, j, w, h, ids, begin in held:
                    score, scores = scores[: j - i], scores[j - i :]
                    yield one(batch, i, j, w, h, ids, begin, score)

    def one(batch, i, j, w, h, ids, begin, score):
        at = np.arange(len(h)) + w.doc
        mine = ids[at] > head.end
        tail, doc = h[mine], w.doc[mine]
        known = np.add.reduceat(head.logs[ids], begin[:-1])
        score = score + np.add.reduceat(head.shares[ids], begin[:-1])
        order = np.lexsort((tail, doc))
        tail, doc = tail[order], doc[order]
        new = np.ones(len(tail), dtype=bool)
        new[1:] = (tail[1:] != tail[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(tail)))
        sizes = np.bincount(doc[first], minlength=j - i)
        n_tail = np.bincount(doc, minlength=j - i)
        n = np.diff(begin)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).slice(i, j - i), pa.array(n), pa.array(n - n_tail), pa.array(known), pa.array(score), list_array(signed(tail[first]), sizes), list_array(times.astype(np.int64), sizes)],
            names=["doc_id", "n_tokens", "n_head", "head_log", "score", "tail", "times"],
        )

    return run


def hmm_scores(docs: DataFrame, folds: int = 7, held: int = 2, head_size: int = HEAD, classes: int = CLASSES, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text); ``classes`` is a power of two."""
    work = Workspace(docs.sparkSession, "hmm")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    train = docs.where(fold(folds) != held)

    counts = work.keep(train.select("text").mapInArrow(tidy(_word_counts), "w long, c long").groupBy("w").agg(F.sum("c").alias("c")), "counts")
    n_docs = train.count()
    words, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, vocab = words + n_docs, kinds + (1 if n_docs else 0)
    top = counts.orderBy(F.desc("c"), "w").limit(head_size).toPandas()
    # what lies behind the head in that order, by class: at most ``classes`` rows
    tokens, others = np.zeros(classes), np.zeros(classes)
    if len(top):
        least, last = int(top.c.iloc[-1]), int(top.w.iloc[-1])
        rest = counts.where((F.col("c") < least) | ((F.col("c") == least) & (F.col("w") > last)))
        by = F.shiftrightunsigned("w", 64 - (classes.bit_length() - 1)).cast("int")
        for row in rest.groupBy(by.alias("k")).agg(F.sum("c").alias("t"), F.count("*").alias("v")).collect():
            tokens[row.k], others[row.k] = row.t, row.v
    head = Head(top.w.to_numpy(dtype=np.int64).view(np.uint64), top.c.to_numpy(dtype=np.int64), n_docs, tokens, others)

    model = Model.first(head.prior, states)
    if n_docs:
        # written once, as each round would split and hash the words of the whole table again
        texts = work.keep(train.select("text").mapInArrow(tidy(_encode(head)), "ids array<int>"), "ids")
        for _ in range(rounds):
            model = _round(texts, head, model, head.prior)
        work.drop(texts)

    schema = "doc_id long, n_tokens long, n_head long, head_log double, score double, tail array<long>, times array<long>"
    # numbered when written: a row's own number, whatever its doc_id
    scored = docs.mapInArrow(tidy(_scores(head, model)), schema).withColumn("row", F.monotonically_increasing_id())
    scored = work.keep(scored, "scored")
    tails = scored.select("row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("row", F.col("t.tail").alias("w"), F.col("t.times").alias("m"))
    found = tails.join(counts, "w").groupBy("row").agg(F.sum("m").alias("n_tail"), F.sum(F.col("m") * F.log10(F.col("c") + 1.0)).alias("tail_log"))
    both = scored.drop("tail", "times").join(found.hint("shuffle_merge"), "row", "left")
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    return both.select(
        "doc_id",
        (fold(folds) == held).alias("held_out"),
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_tail", F.lit(0)) - F.lit(0 if n_docs else 1)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head_log") + tail_log - F.col("n_tokens") * float(np.log10(total + vocab + 1))).alias("base_score"),
        (F.col("score") + tail_log).alias("score"),
    )

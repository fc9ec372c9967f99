"""Best-fit packing by a grouping genetic algorithm with islands.

A document is its token ids followed by one end id.  Documents longer than a
sequence are cut into full pieces and a rest; full pieces fill a sequence each.
All other pieces are dealt at random into *cells* of about ``cell`` pieces, each
a bin-packing problem of bounded size.  In each cell, ``islands`` populations
evolve apart, as rows and so tasks of their own, and send their elite to the next
island between epochs:

* an individual is a list of groups (bins of pieces);
* crossover injects the best-filled whole bins of one parent into the other,
  removes the bins that hold a duplicate, and puts the pieces displaced by that
  back by best fit, longest first;
* the fitness is the number of bins, then the sum of squared fills: of two
  packings with as many bins, the better one has its gaps in fewer of them.

The pieces of the worst-filled bins of all cells, ``LEFT`` of a cell's bins at
most, are dealt into fewer cells and evolve again, from the bins they had, until
one cell is left.  So cells share their gaps, no level makes a packing worse, and
each level has about ``LEFT`` of the pieces of the one before.

Pieces, populations and bins are tables of the shared folder: a lost executor
costs the tasks since the last one.

Defined results: null or empty text is the end id alone.  Null doc_id and
repeated rows are packed like any other row.  Equal fits (ties): the first bin.
Very long texts are cut into pieces and nothing is dropped.  An empty table gives
an empty table.  Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import bisect
import json
import random
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.llm._kernels import Words, chunks, tidy
from glyphloom.llm._stage import Workspace

CAPACITY = 4096
CELL = 2048
ISLANDS = 2
POPULATION = 4
EPOCHS = 3
GENERATIONS = 12
LEFT = 0.125
# A bin as full as this has no gap worth sharing.
FULL = 0.999
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
# Units of a generation of the encoder's cache.
KNOWN_WORDS = 200_000
# Bytes of text encoded together.
CHUNK = 1 << 19

# 0 white space, 1 letter, 2 digit, 3 other sign, 4 only the whole tokenizer knows
_KIND = np.full(256, 4, dtype=np.int8)
_KIND[33:127] = 3
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[ord("'")] = 4


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies (a rule, not a table)."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(other)}


class Merges:
    """The merges of a byte-level vocabulary, made for many units at once.

    As in the library: of a unit's adjacent pairs the one of least rank is merged,
    the leftmost of equal ones, until no pair has a rank.
    """

    NONE = np.int64(1 << 30)
    # Bytes of a unit at most; the library takes longer ones.
    LONGEST = 64

    def __init__(self, model: dict, letters: dict[int, str]):
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.inner = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        self.final = np.array([vocab[letters[b] + end] for b in range(256)], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.rank = np.argsort(key, kind="stable")
        self.key = key[self.rank]

    @classmethod
    def of(cls, path: str, letters: dict[int, str]) -> Merges | None:
        """None for vocabularies with rules of other kinds."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model["type"] != "BPE" or not model["merges"] or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            return None
        end = model.get("end_of_word_suffix") or ""
        return cls(model, letters) if all(x in model["vocab"] and x + end in model["vocab"] for x in letters.values()) else None

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        return np.where(self.key[at] == key, self.rank[at], self.NONE)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers; no text is empty."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        raw = np.frombuffer(b"".join(texts), np.uint8)
        ids, stop = self.inner[raw], np.cumsum(size)
        ids[stop - 1] = self.final[raw[stop - 1]]
        rank = np.full(len(ids), self.NONE)
        rank[:-1] = self._ranks(ids[:-1], ids[1:])
        rank[stop - 1] = self.NONE
        unit, out = np.arange(len(texts)), [b""] * len(texts)
        while len(unit):
            first = np.cumsum(size) - size
            low = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), first)
            live = low >> 32 < self.NONE
            if not live.all():
                inside = np.repeat(live, size)
                done, ends = ids[~inside].astype("<u4").tobytes(), 4 * np.cumsum(size[~live])
                for k, a, b in zip(unit[~live].tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    out[k] = done[a:b]
                low = low[live] - (np.cumsum(~inside)[low[live] & 0xFFFFFFFF])
                ids, rank, unit, size = ids[inside], rank[inside], unit[live], size[live]
                if not len(unit):
                    break
                first = np.cumsum(size) - size
            at = low & 0xFFFFFFFF
            ids[at] = self.made[low >> 32]
            stay = np.ones(len(ids), dtype=bool)
            stay[at + 1] = False
            ids, rank, size = ids[stay], rank[stay], size - 1
            shift = np.arange(len(unit))
            at, first = at - shift, first - shift
            right = at < first + size - 1
            rank[at] = self.NONE
            rank[at[right]] = self._ranks(ids[at[right]], ids[at[right] + 1])
            left = at[at > first]
            rank[left - 1] = self._ranks(ids[left - 1], ids[left])
        return out


class WordEncoder:
    """Token ids of whole texts, encoding each different pre-token once.

    The vocabulary drops white space and lower-cases, then splits a word into
    runs of letters, single digits and runs of other signs, each coded by itself.
    For words of ASCII and Latin-1 letters, which composition leaves alone, these
    splits are made here on bytes and only the merges are asked for; any other
    word (other scripts, apostrophes, control characters) goes through the whole
    tokenizer, as one unit.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        self.merges = Tokenizer.from_file(path)
        self.merges.encode_special_tokens = True
        self.merges.normalizer = None
        self.merges.pre_tokenizer = None
        self.letters = _byte_letters()
        self.many = Merges.of(path, self.letters)
        self.forget()

    def forget(self) -> None:
        """Two generations of known units, by their bytes, with a space behind words for the whole tokenizer; what the older one still answers moves to the younger."""
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _units(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, word, whole) of the units, in order; whole: a word for the whole tokenizer.  Lower-cases w.data."""
        data = w.data
        n = len(data)
        lead = data == 0xC3
        follows = np.zeros(n, dtype=bool)
        follows[1:] = lead[:-1] & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        latin = follows.copy()
        latin[:-1] |= follows[1:]
        kind = _KIND[data]
        kind[latin] = 1
        odd = np.concatenate([[0], np.cumsum(kind == 4)])
        whole = odd[w.end] > odd[w.start]
        lower = data.copy()
        lower[(data >= 65) & (data <= 90)] += 32
        lower[follows & (data <= 0x9E)] += 32
        # words for the whole tokenizer keep their bytes
        inside = np.zeros(n + 1, dtype=np.int8)
        np.add.at(inside, w.start[whole], 1)
        np.add.at(inside, w.end[whole], -1)
        inside = np.cumsum(inside[:-1]).astype(bool)
        w.data = np.where(inside, data, lower)
        kind[inside] = 1
        cut = np.empty(n, dtype=bool)
        cut[0] = True
        cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        cut[w.start] = True
        start = np.flatnonzero(cut & (kind > 0))
        word = np.searchsorted(w.start, start, side="right") - 1
        edge = np.append(start[1:], n)
        end = np.minimum(edge, w.end[word])
        return start, end, word, whole[word]

    def _learn(self, texts: list[bytes], whole: np.ndarray) -> list[bytes]:
        out = [b""] * len(texts)
        plain = np.flatnonzero(~whole).tolist()
        if self.many:
            short = [i for i in plain if len(texts[i]) <= Merges.LONGEST]
            plain = [i for i in plain if len(texts[i]) > Merges.LONGEST]
            for i, ids in zip(short, self.many.encode([texts[i] for i in short]), strict=True):
                out[i] = ids
        for tokenizer, index, words in (
            (self.full, full := np.flatnonzero(whole).tolist(), [texts[i].decode("utf-8", "replace") for i in full]),
            (self.merges, plain, [texts[i].decode("latin-1").translate(self.letters) for i in plain]),
        ):
            for i, e in zip(index, tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, dtype="<u4").tobytes()
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after another; where each text's ids begin)."""
        if len(self.young) > KNOWN_WORDS:
            self.young, self.old = {}, self.young
        w = Words(data, offsets)
        if not len(w.start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        start, end, word, whole = self._units(w)
        first_unit = np.searchsorted(word, w.first)
        units = Words.__new__(Words)
        units.data, units.start, units.end = w.data, start, end
        # hashes only group equal units within the chunk; the cache is by bytes
        with np.errstate(over="ignore"):
            h = units.hashes() ^ (units.hashes(1) * np.uint64(0x9E3779B97F4A7C15)) ^ whole.astype(np.uint64)
        _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        texts = units.strings(first)
        keys, full = texts.copy(), whole[first]
        for k in np.flatnonzero(full).tolist():
            keys[k] += b" "
        young, old = self.young, self.old
        coded = list(map(young.get, keys))
        new = []
        for k in [k for k, ids in enumerate(coded) if ids is None]:
            if (ids := old.get(keys[k])) is None:
                new.append(k)
            else:
                coded[k] = young[keys[k]] = ids
        if new:
            for k, ids in zip(new, self._learn([texts[k] for k in new], full[new]), strict=True):
                coded[k] = young[keys[k]] = ids
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        flat = np.frombuffer(b"".join(coded), "<u4")
        begin = np.cumsum(sizes) - sizes
        size = sizes[inverse]
        ends = np.cumsum(size)
        index = np.arange(ends[-1]) + np.repeat(begin[inverse] - (ends - size), size)
        return flat[index], np.concatenate([[0], ends])[first_unit]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _pieces(path: str, capacity: int):
    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(1), CHUNK):
                ids, begin = enc.encode(data, offsets)
                row, piece, start, length, crc = [], [], [], [], []
                for k in range(j - i):
                    own = np.append(ids[begin[k] : begin[k + 1]], np.uint32(END_ID)).astype("<u4")
                    for p in range(0, len(own), capacity):
                        part = own[p : p + capacity]
                        row.append(i + k)
                        piece.append(p // capacity)
                        start.append(p)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


Bins = list[list[int]]


def best_fit(bins: Bins, items: list[int], size: list[int], capacity: int) -> Bins:
    """Puts items, longest first, each into the fullest bin that holds it; changes ``bins``."""
    at_size = size.__getitem__
    room = sorted((capacity - sum(map(at_size, b)), k) for k, b in enumerate(bins))
    for i in sorted(items, key=lambda i: (-size[i], i)):
        at = bisect.bisect_left(room, (size[i], -1))
        if at == len(room):
            bins.append([i])
            bisect.insort(room, (capacity - size[i], len(bins) - 1))
        else:
            left, k = room.pop(at)
            bins[k].append(i)
            if left > size[i]:
                bisect.insort(room, (left - size[i], k))
    return bins


def fitness(bins: Bins, size: list[int], capacity: int) -> tuple:
    """Less is better."""
    at_size = size.__getitem__
    return (len(bins), -sum((sum(map(at_size, b)) / capacity) ** 2 for b in bins))


def crossover(one: Bins, two: Bins, size: list[int], capacity: int, rng: random.Random) -> Bins:
    """Bins of ``one``, well filled ones first by odds, injected into ``two``."""
    at_size = size.__getitem__
    filled = sorted(one, key=lambda b: -sum(map(at_size, b)))
    take = filled[: max(1, len(filled) // 2)]
    inject = rng.sample(take, max(1, len(take) * rng.randint(3, 9) // 10))
    taken = {i for b in inject for i in b}
    kept, displaced = [list(b) for b in inject], []
    for b in two:
        if taken.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in taken]
    return best_fit(kept, displaced, size, capacity)


def mutate(bins: Bins, size: list[int], capacity: int, rng: random.Random) -> Bins:
    """Breaks up the least filled bins and a few others, and best-fits their pieces."""
    at_size = size.__getitem__
    order = sorted(bins, key=lambda b: sum(map(at_size, b)))
    gone = order[: max(1, len(order) // 50)] + rng.sample(order, min(len(order), 2))
    ids = {id(b) for b in gone}
    return best_fit([list(b) for b in bins if id(b) not in ids], list({i for b in gone for i in b}), size, capacity)


def found(size: list[int], capacity: int, population: int, rng: random.Random, known: Bins = ()) -> list[Bins]:
    """A first population: the known packing or plain best fit, and best fits after a random quarter of the pieces."""
    people = [[list(b) for b in known] or best_fit([], list(range(len(size))), size, capacity)]
    if known:
        people.append(best_fit([], list(range(len(size))), size, capacity))
    while len(people) < population:
        start = set(rng.sample(range(len(size)), len(size) // 4))
        people.append(best_fit(best_fit([], sorted(start), size, capacity), [i for i in range(len(size)) if i not in start], size, capacity))
    return sorted(people, key=lambda b: fitness(b, size, capacity))


def generations_on(people: list[Bins], generations: int, size: list[int], capacity: int, rng: random.Random) -> list[Bins]:
    """The people, best first, after so many generations; in each, one child takes the place of the worst (the child itself, if it is)."""
    worth = [fitness(b, size, capacity) for b in people]
    for _ in range(generations):
        if len(people) < 2 or len(people[0]) < 2:
            break
        a, b = rng.sample(people, 2)
        child = crossover(a, b, size, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, size, capacity, rng)
        value = fitness(child, size, capacity)
        at = bisect.bisect_right(worth, value)
        people, worth = [*people[:at], child, *people[at:]][:-1], [*worth[:at], value, *worth[at:]][:-1]
    return people


def _written(bins: Bins, n: int) -> bytes:
    """The number of each piece's bin."""
    out = np.zeros(n, dtype="<i4")
    for k, b in enumerate(bins):
        out[b] = k
    return out.tobytes()


def _read(raw: bytes) -> Bins:
    number = np.frombuffer(raw, "<i4")
    order = np.argsort(number, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(number[order])) + 1)]


_ISLAND = "cell long, island int, pieces binary, sizes binary, people array<binary>, bins int, waste double"


def _island(cell: int, island: int, pieces: bytes, sizes: bytes, people: list[Bins], capacity: int) -> pa.RecordBatch:
    size = np.frombuffer(sizes, "<i4").tolist()
    best = fitness(people[0], size, capacity)
    columns = [(cell, pa.int64()), (island, pa.int32()), (pieces, pa.binary()), (sizes, pa.binary()), ([_written(p, len(size)) for p in people], pa.list_(pa.binary())), (best[0], pa.int32()), (best[1], pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in columns], names=["cell", "island", "pieces", "sizes", "people", "bins", "waste"])


def _settle(capacity: int, islands: int, population: int) -> Callable:
    """The islands of each cell of a partition sorted by cell, with first populations; ``was`` is a piece's bin so far, or null."""

    def solve(cell: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        size = table.column("length").to_pylist()
        was: dict[int, list[int]] = {}
        for i, b in enumerate(table.column("was").to_pylist()):
            if b is not None:
                was.setdefault(b, []).append(i)
        pieces, sizes = (np.asarray(table.column(c)).astype(t).tobytes() for c, t in (("pid", "<i8"), ("length", "<i4")))
        for k in range(islands):
            yield _island(cell, k, pieces, sizes, found(size, capacity, population, random.Random(cell * 1000 + k), list(was.values())), capacity)

    def run(batches):
        held: list[pa.RecordBatch] = []
        cell = None
        for batch in batches:
            cells = np.asarray(batch.column(0))
            edges = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if held and cells[a] != cell:
                    yield from solve(cell, pa.Table.from_batches(held))
                    held = []
                cell = int(cells[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from solve(cell, pa.Table.from_batches(held))

    return run


def _epoch(capacity: int, number: int, generations: int) -> Callable:
    """One epoch of each island, after its guest (the elite of the island before) took the place of its worst."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                size = np.frombuffer(row["sizes"], "<i4").tolist()
                people = [_read(p) for p in row["people"]]
                if row["guest"] is not None:
                    people = sorted([*people[:-1], _read(row["guest"])], key=lambda b: fitness(b, size, capacity))
                rng = random.Random((row["cell"] * 1000 + row["island"]) * 100 + number)
                people = generations_on(people, generations, size, capacity, rng)
                yield _island(row["cell"], row["island"], row["pieces"], row["sizes"], people, capacity)

    return run


def _unpack(capacity: int, level: int, last: bool) -> Callable:
    """(pid, sequence_id, offset, again): the pieces of each cell's best packing; again: its bin is to be packed with those of other cells."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                size = np.frombuffer(row["sizes"], "<i4")
                bins = sorted(_read(row["best"]), key=lambda b: int(size[b].sum()))
                again = 0 if last else min(max(1, int(LEFT * len(bins))), sum(int(size[b].sum()) < FULL * capacity for b in bins))
                order = np.concatenate([np.array(b) for b in bins])
                number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
                ends = np.cumsum(size[order].astype(np.int64))
                starts = np.concatenate([[0], ends[:-1]])
                offset = starts - starts[np.searchsorted(number, number)]
                names = (np.int64(level) << np.int64(56)) + (np.int64(row["cell"]) << np.int64(16)) + number
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(row["pieces"], "<i8")[order]), pa.array(size[order].astype(np.int64)), pa.array(np.full(len(order), row["cell"])), pa.array(names), pa.array(offset), pa.array(number < again)],
                    names=["pid", "length", "cell", "sequence_id", "offset", "again"],
                )

    return run


def _solved(loose: DataFrame, level: int, last: bool, parts: int, capacity: int, work: Workspace, islands: int, population: int, epochs: int, generations: int) -> DataFrame:
    """One level: (pid, length, cell, sequence_id, offset, again) of the pieces (cell, pid, length, was)."""
    dealt = loose.repartition(parts, "cell").sortWithinPartitions("cell", "length", "pid")
    state = work.keep(dealt.select("cell", "pid", "length", "was").mapInArrow(tidy(_settle(capacity, islands, population)), _ISLAND), "islands")
    for number in range(epochs):
        # islands are dealt by (cell, island); a guest is one short row
        guests = state.select("cell", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.get("people", F.lit(0)).alias("guest"))
        guests = guests if islands > 1 and number else guests.where("false")
        ready = state.drop("bins", "waste").join(guests.hint("shuffle_merge"), ["cell", "island"], "left").repartition(parts * islands, "cell", "island")
        evolved = work.keep(ready.select("cell", "island", "pieces", "sizes", "people", "guest").mapInArrow(tidy(_epoch(capacity, number, generations)), _ISLAND), "epoch")
        work.drop(state)
        state = evolved
    best = state.groupBy("cell").agg(F.min(F.struct("bins", "waste", "island", "pieces", "sizes", F.get("people", F.lit(0)).alias("best"))).alias("b")).select("cell", "b.pieces", "b.sizes", "b.best")
    out = work.keep(best.mapInArrow(tidy(_unpack(capacity, level, last)), "pid long, length long, cell long, sequence_id long, offset long, again boolean"), "solved")
    work.drop(state)
    return out


def evolve(size: list[int], capacity: int = CAPACITY, seed: int = 0, islands: int = ISLANDS, population: int = POPULATION, epochs: int = EPOCHS, generations: int = GENERATIONS) -> Bins:
    """The best packing found of the pieces of one cell, as lists of their indices: what the islands do, in one place."""
    if not size:
        return []
    worlds = [found(size, capacity, population, random.Random(seed * 1000 + k)) for k in range(islands)]
    for number in range(epochs):
        if number and islands > 1:
            elite = [people[0] for people in worlds]
            worlds = [sorted([*people[:-1], elite[k - 1]], key=lambda b: fitness(b, size, capacity)) for k, people in enumerate(worlds)]
        for k in range(islands):
            rng = random.Random((seed * 1000 + k) * 100 + number)
            worlds[k] = generations_on(worlds[k], generations, size, capacity, rng)
    return min((people[0] for people in worlds), key=lambda b: fitness(b, size, capacity))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, cell: int = CELL, islands: int = ISLANDS, population: int = POPULATION, epochs: int = EPOCHS, generations: int = GENERATIONS) -> DataFrame:
    """One row for each piece of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    work = Workspace(spark, "packing")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    # numbered when written: a piece's own number, whatever its doc_id
    pieces = docs.mapInArrow(tidy(_pieces(tokenizer or default_tokenizer(), capacity)), schema).withColumn("pid", F.monotonically_increasing_id())
    pieces = work.keep(pieces, "pieces")
    loose = pieces.where(F.col("length") < capacity).select("pid", "length", F.col("pid").alias("group"), F.lit(None).cast("long").alias("was"))
    placed, level, n = None, 0, loose.count()
    while n:
        cells = max(1, round(n / cell))
        parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), cells) if cells > 1 else 1
        dealt = loose.select(F.pmod(F.xxhash64("group", F.lit(level)), F.lit(cells)).alias("cell"), "pid", "length", "was")
        solved = _solved(dealt, level, cells == 1, parts, capacity, work, islands, population, epochs, generations)
        done = solved.where("not again").select("pid", "sequence_id", "offset")
        placed = done if placed is None else placed.union(done)
        # what one cell leaves stays together, with its bins
        loose = solved.where("again").select("pid", "length", F.col("cell").alias("group"), F.col("sequence_id").alias("was"))
        level, n = level + 1, loose.count() if cells > 1 else 0
    whole = pieces.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("pid")).withColumn("offset", F.lit(0).cast("long"))
    if placed is None:
        return whole.drop("pid")
    return pieces.where(F.col("length") < capacity).join(placed.hint("shuffle_merge"), "pid").select(whole.columns).union(whole).drop("pid")

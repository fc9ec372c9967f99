"""Which keys do several documents share?  One shuffle of packed arrays.

Most of the (key, doc) rows of a join on n-grams have a key of their own.  They
are sorted out before they become rows: each task packs its pairs, by key range,
into byte strings, and a partition of the packed keys counts them with numpy.
A partition first reads the counts (one entry for each key and task, whatever
its frequency), then streams the pairs and lets those pass whose key is shared;
a hot key costs no more memory than any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.llm._kernels import tidy

FLUSH = 1 << 18
SCHEMA = "part int, kind int, seq long, keys binary, docs binary"


class Packer:
    """Collects (keys, docs) and yields packed rows."""

    def __init__(self, parts: int):
        self.parts, self.held, self.size = parts, [], 0

    def add(self, keys: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((keys, docs))
        self.size += len(keys)
        if self.size >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        keys = np.concatenate([k for k, _ in self.held])
        docs = np.concatenate([d for _, d in self.held])
        self.held, self.size = [], 0
        order = np.argsort(keys, kind="stable")
        keys, docs = keys[order], docs[order]
        part = ((keys >> np.uint64(33)) % np.uint64(self.parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        keys, docs, part = keys[order], docs[order], part[order]
        edges = np.searchsorted(part, np.arange(self.parts + 1))
        new = np.ones(len(keys), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        rows = []
        for p in range(self.parts):
            a, b = edges[p], edges[p + 1]
            if a == b:
                continue
            first = np.flatnonzero(new[a:b])
            count = np.diff(np.append(first, b - a)).astype(np.uint32)
            seq = int(docs[a:b].min())
            rows.append((p, 0, seq, keys[a:b][first].tobytes(), count.tobytes()))
            rows.append((p, 1, seq, keys[a:b].tobytes(), docs[a:b].tobytes()))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        for k in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 64], strict=True), kinds, strict=True)], names=["part", "kind", "seq", "keys", "docs"])


def packing(parts: int, pairs: Callable) -> Callable:
    """A mapInArrow function; ``pairs(batch)`` yields (keys uint64, docs int64)."""

    def run(batches):
        packer = Packer(parts)
        for batch in batches:
            for keys, docs in pairs(batch):
                yield from packer.add(keys, docs)
        yield from packer.flush()

    return run


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(first) else c


def _shared(least: int):
    def run(batches):
        tables = {}
        for batch in batches:
            for part, kind, _, raw, other in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if part not in tables:
                    tables = {part: ([], [])}
                if kind == 0:
                    keys, counts = tables[part]
                    keys.append(np.frombuffer(raw, np.uint64))
                    counts.append(np.frombuffer(other, np.uint32))
                    if len(keys) >= 64:
                        k, c = _merge(keys, counts)
                        keys[:], counts[:] = [k], [c]
                    continue
                if not isinstance(tables[part], dict):
                    k, c = _merge(*tables[part])
                    k, c = k[c >= least], c[c >= least]
                    tables[part] = {"k": k, "c": c, "pivot": np.zeros(len(k), np.int64), "set": np.zeros(len(k), bool)}
                t = tables[part]
                k, d = np.frombuffer(raw, np.uint64), np.frombuffer(other, np.int64)
                if not len(t["k"]):
                    continue
                at = np.searchsorted(t["k"], k)
                at[at == len(t["k"])] = 0
                hit = t["k"][at] == k
                at, k, d = at[hit], k[hit], d[hit]
                if not len(at):
                    continue
                who, first = np.unique(at, return_index=True)
                low = np.minimum.reduceat(d, first)  # keys are sorted, so equal ones adjoin
                fresh = ~t["set"][who]
                t["pivot"][who[fresh]] = low[fresh]
                t["set"][who] = True
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(d), pa.array(t["c"][at]), pa.array(t["pivot"][at])], names=["tok", "doc", "cnt", "pivot"])

    return run


def shared_rows(packed: DataFrame, parts: int, least: int = 2) -> DataFrame:
    """(tok, doc, cnt, pivot) of the pairs whose key occurs ``least`` times or more.

    cnt is the number of pairs with the key; pivot is one of its documents, the
    same for all its rows: the least one of the packed string that has the
    least first document.
    """
    dealt = packed.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind", "seq", F.xxhash64("keys"))
    return dealt.mapInArrow(tidy(_shared(least)), "tok long, doc long, cnt long, pivot long")

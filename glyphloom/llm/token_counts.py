"""Token counts by offset-mapped attribution.

A whole document is encoded once; the tokens' spans, in bytes, follow from the
lengths of the vocabulary's byte strings.  The document's sections are spans
too.  An interval join of the two sorted lists of spans gives each token its
sections; a token that crosses a boundary belongs to the section that holds most
of its bytes, and to the earlier one on a tie.  Bytes between sections belong to
no section; a token with none of its bytes in a section is counted as section -1.

Sections are the lines of a text, each with its line feed (``by_lines``), or
named fields joined by a separator and encoded together (``by_fields``).

A run of white space of ``LONG_SPACE`` characters or more is more than the
vocabulary's matcher can hold.  It is one pre-token but for its last character,
so texts are cut there and the run is merged by itself, with the same tokens.

Defined results: null or empty text: one section of 0 tokens.  Null field: an
empty section.  Null doc_id and repeated rows: rows like any other.  Ties: the
earlier section.  Very long texts are encoded whole.  An empty table gives an
empty table.  Clashing names of other columns do not matter, as only the named
ones are read.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.llm._kernels import as_text, tidy

VOCABULARY = "byte_bpe_50k.tiktoken"
LONG_SPACE = 10_000
# White space as the vocabulary's pattern has it, and the pattern's own end, on which cuts rely.
_RUN = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG_SPACE},}}")
_SPACE_RULE = r"\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    """(encoder, the number of bytes of each token id)."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size


def encode(enc, text: str) -> list[int]:
    """The token ids of a whole text."""
    if len(text) < LONG_SPACE or not enc._pat_str.endswith("|" + _SPACE_RULE) or r"[\r\n]" in enc._pat_str:
        return enc.encode_ordinary(text)
    out, at = [], 0
    for m in _RUN.finditer(text):
        stop = m.end() if m.end() == len(text) else m.end() - 1
        out += enc.encode_ordinary(text[at : m.start()])
        out += enc._core_bpe.encode_single_piece(text[m.start() : stop].encode())
        at = stop
    return out + enc.encode_ordinary(text[at:])


def attribute(token_end: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For tokens that end at ``token_end`` (each starts where the one before ends): its section, and whether it crosses.

    Sections [start, end) are disjoint and ascending; empty ones get no token.
    """
    token_start = np.concatenate([[0], token_end[:-1]])
    full = np.flatnonzero(end > start)
    s, e = start[full], end[full]
    if not len(full):
        return np.full(len(token_end), -1), np.zeros(len(token_end), dtype=bool)
    low = np.searchsorted(e, token_start, side="right")  # first section that ends behind the token's start
    high = np.searchsorted(s, token_end, side="left") - 1  # last one that starts before its end
    section = np.where(low <= high, full[np.minimum(low, len(full) - 1)], -1)
    inside = np.minimum(low, len(full) - 1)
    cross = (high > low) | ((section >= 0) & ((s[inside] > token_start) | (e[inside] < token_end)))
    for t in np.flatnonzero(high > low).tolist():
        k = np.arange(low[t], high[t] + 1)
        held = np.minimum(e[k], token_end[t]) - np.maximum(s[k], token_start[t])
        section[t] = full[k[np.argmax(held)]]
    return section, cross & (section >= 0)


def _count(path: str, pattern: str, fields: int):
    def run(batches):
        enc, size = _encoding(path, pattern)
        for batch in batches:
            data, offsets = as_text(batch.column(1))
            raw = data.tobytes()
            row, section, begin, stop, tokens, crossing = [], [], [], [], [], []
            for k in range(batch.num_rows):
                text = raw[offsets[k] : offsets[k + 1]]
                if fields:
                    cuts = np.cumsum([0, *batch.column(2)[k].values.to_pylist()])
                    start, end = cuts[:-1][::2], cuts[1:][::2]  # sizes of field, separator, field, ...
                else:
                    feeds = np.flatnonzero(data[offsets[k] : offsets[k + 1]] == 10) + 1
                    end = np.append(feeds, len(text)) if not len(feeds) or feeds[-1] < len(text) else feeds
                    start = np.concatenate([[0], end[:-1]])
                ids = np.array(encode(enc, text.decode("utf-8", "replace")), dtype=np.int64)
                which, cross = attribute(np.cumsum(size[ids]), start, end)
                n = np.bincount(which[which >= 0], minlength=len(start))
                x = np.bincount(which[cross], minlength=len(start))
                # places in characters: bytes that do not continue one
                lead = np.concatenate([[0], np.cumsum((data[offsets[k] : offsets[k + 1]] & 0xC0) != 0x80)])
                row += [k] * len(start)
                section += range(len(start))
                begin.append(lead[start])
                stop.append(lead[end])
                tokens.append(n)
                crossing.append(x)
                if (loose := int((which < 0).sum())) > 0:
                    row.append(k)
                    section.append(-1)
                    begin.append(np.array([0]))
                    stop.append(np.array([lead[-1]]))
                    tokens.append(np.array([loose]))
                    crossing.append(np.array([0]))
                if len(row) >= 1 << 16 or k == batch.num_rows - 1:
                    flat = [np.concatenate(c).astype(np.int64) for c in (begin, stop, tokens, crossing)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row, pa.int64())), pa.array(section, pa.int32()), *[pa.array(c) for c in flat]], names=["doc_id", "section", "start", "stop", "n_tokens", "n_crossing"]
                    )
                    row, section, begin, stop, tokens, crossing = [], [], [], [], [], []

    return run


def _vocabulary(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN


_SCHEMA = "doc_id long, section int, start long, stop long, n_tokens long, n_crossing long"


def by_lines(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, section (line), start, stop (characters), n_tokens, n_crossing for the lines of docs (doc_id, text)."""
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ready.mapInArrow(tidy(_count(*_vocabulary(path, pattern), 0)), _SCHEMA)


def by_fields(rows: DataFrame, key: str, fields: list[str], separator: str = "\n", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The same for the named columns of rows, joined by the separator; section is the place in ``fields``."""
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    sizes = []
    for p in parts:
        sizes += [F.octet_length(p).cast("long"), F.lit(len(separator.encode())).cast("long")]
    ready = rows.select(F.col(key).cast("long").alias("doc_id"), F.concat_ws(separator, *parts).alias("text"), F.array(*sizes[:-1]).alias("sizes"))
    return ready.mapInArrow(tidy(_count(*_vocabulary(path, pattern), len(fields))), _SCHEMA)

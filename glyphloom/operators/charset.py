"""Sets of tokens: code-point intervals and multi-code-point clusters, with set algebra.

A set is built once, on the driver, and rendered as a Java character class for
Spark's regular expressions or as a predicate for the parsing machine.
"""

from __future__ import annotations

import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

from glyphloom.operators.segment import clusters

_TOP = sys.maxunicode
_SURROGATES = (0xD800, 0xDFFF)


def _merged(spans: Iterable[tuple[int, int]]) -> tuple[tuple[int, int], ...]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return tuple((lo, hi) for lo, hi in out)


class TokenSet:
    """An immutable set of tokens."""

    __slots__ = ("spans", "clusters", "_lows", "java")

    def __init__(self, spans: Iterable[tuple[int, int]] = (), many: Iterable[str] = (), java: str | None = None):
        self.spans = _merged(spans)
        self.clusters = tuple(sorted(set(many)))
        self._lows = [lo for lo, _ in self.spans]
        # What stands for the code points inside a Java class, where that is shorter than the intervals.
        self.java = java

    # -- construction
    @staticmethod
    def single(x: int | str) -> TokenSet:
        c = x if isinstance(x, int) else ord(x)
        if not 0 <= c <= _TOP:
            raise ValueError(f"not a code point: {x!r}")
        return TokenSet([(c, c)])

    @staticmethod
    def range(lo: int | str, hi: int | str) -> TokenSet:
        a, b = (x if isinstance(x, int) else ord(x) for x in (lo, hi))
        if a > b:
            raise ValueError("the range ends before it begins")
        return TokenSet([(a, b)]) - SURROGATES

    @staticmethod
    def ranges(*pairs: tuple[int | str, int | str]) -> TokenSet:
        out = EMPTY
        for lo, hi in pairs:
            out = out | TokenSet.range(lo, hi)
        return out

    @staticmethod
    def runes(text: str) -> TokenSet:
        """The code points of a text, none of which may combine with its neighbour."""
        if any(len(c) > 1 for c in clusters(text)):
            raise ValueError("neighbouring code points form one token; use graphemes")
        return TokenSet((ord(c), ord(c)) for c in text)

    @staticmethod
    def graphemes(*items: str) -> TokenSet:
        for i in items:
            if len(clusters(i)) != 1:
                raise ValueError(f"not one token: {i!r}")
        return TokenSet(((ord(i), ord(i)) for i in items if len(i) == 1), (i for i in items if len(i) > 1))

    @staticmethod
    def category(*names: str) -> TokenSet:
        """All code points of these general categories ("Lu", or "L" for all of L)."""
        return TokenSet(_by_category(tuple(sorted(names))), java="".join(rf"\p{{{n}}}" for n in sorted(names)))

    # -- algebra
    def __or__(self, other: TokenSet) -> TokenSet:
        java = self._inner() + other._inner() if self.java or other.java else None
        return TokenSet(self.spans + other.spans, self.clusters + other.clusters, java)

    def __and__(self, other: TokenSet) -> TokenSet:
        out, i, j = [], 0, 0
        while i < len(self.spans) and j < len(other.spans):
            (a, b), (c, d) = self.spans[i], other.spans[j]
            if max(a, c) <= min(b, d):
                out.append((max(a, c), min(b, d)))
            i, j = (i + 1, j) if b < d else (i, j + 1)
        return TokenSet(out, set(self.clusters) & set(other.clusters))

    def __sub__(self, other: TokenSet) -> TokenSet:
        out = []
        for lo, hi in self.spans:
            for a, b in other.spans:
                if b < lo or a > hi:
                    continue
                if a > lo:
                    out.append((lo, a - 1))
                lo = b + 1
                if lo > hi:
                    break
            if lo <= hi:
                out.append((lo, hi))
        java = f"[{self.java}&&[^{other._inner()}]]" if self.java and other.spans else self.java
        return TokenSet(out, set(self.clusters) - set(other.clusters), java)

    # -- membership
    def has(self, c: int) -> bool:
        k = bisect_right(self._lows, c) - 1
        return k >= 0 and c <= self.spans[k][1]

    def __contains__(self, token: str) -> bool:
        return self.has(ord(token)) if len(token) == 1 else token in self.clusters

    def __iter__(self) -> Iterator[str]:
        for lo, hi in self.spans:
            yield from map(chr, range(lo, hi + 1))
        yield from self.clusters

    def __bool__(self) -> bool:
        return bool(self.spans or self.clusters)

    def __len__(self) -> int:
        return sum(hi - lo + 1 for lo, hi in self.spans) + len(self.clusters)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, TokenSet) and (self.spans, self.clusters) == (other.spans, other.clusters)

    def __hash__(self) -> int:
        return hash((self.spans, self.clusters))

    def __str__(self) -> str:
        items = [chr(lo) if lo == hi else f"{chr(lo)}-{chr(hi)}" for lo, hi in self.spans] + list(self.clusters)
        return "[" + " ".join(items[:8]) + (f" ...+{len(items) - 8} more" if len(items) > 8 else "") + "]"

    __repr__ = __str__

    # -- normalization
    def normalized(self, form: str) -> tuple[TokenSet, list[str]]:
        """(the set in a normalization form, its members that would become several tokens)."""
        spans, many, bad = [], [], []
        for lo, hi in self.spans:
            if (lo, hi) == (0, _TOP) or hi - lo > 0x20000:
                spans.append((lo, hi))
                continue
            for c in range(lo, hi + 1):
                t = unicodedata.normalize(form, chr(c))
                if t == chr(c):
                    spans.append((c, c))
                elif len(t) == 1:
                    spans.append((ord(t), ord(t)))
                elif len(clusters(t)) == 1:
                    many.append(t)
                else:
                    bad.append(chr(c))
        for item in self.clusters:
            t = unicodedata.normalize(form, item)
            if len(t) == 1:
                spans.append((ord(t), ord(t)))
            elif len(clusters(t)) == 1:
                many.append(t)
            else:
                bad.append(item)
        return TokenSet(spans, many), bad

    def with_equivalents(self, form: str) -> TokenSet:
        """With every code point whose compatibility form is in the set."""
        extra = [(c, c) for c in range(0x80, 0x30000) if not 0xD800 <= c <= 0xDFFF and (t := unicodedata.normalize(form, chr(c))) != chr(c) and len(t) == 1 and self.has(ord(t))]
        return self | TokenSet(extra)

    # -- rendering
    def _inner(self) -> str:
        return self.java or "".join(f"\\x{{{lo:X}}}" + ("" if lo == hi else f"-\\x{{{hi:X}}}") for lo, hi in self.spans)

    def java_class(self) -> str:
        """The code points as a Java character class.

        General categories go by their names, so their last few hundred code
        points follow the JVM's Unicode version and not Python's.
        """
        return f"[{self._inner()}]" if self.spans else "(?!)"


@lru_cache(maxsize=64)
def _by_category(names: tuple[str, ...]) -> tuple[tuple[int, int], ...]:
    return _merged((c, c) for c in range(_TOP + 1) if unicodedata.category(chr(c)).startswith(names))


def _chars(*codes: int) -> TokenSet:
    return TokenSet((c, c) for c in codes)


EMPTY = TokenSet()
SURROGATES = TokenSet([_SURROGATES])
UNIVERSE = TokenSet([(0, _TOP)]) - SURROGATES
REPLACEMENT = _chars(0xFFFD)
# Line ends of the Unicode newline guidelines.
LINE_ENDS = _chars(0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029)


class Ascii:
    """The ASCII sets."""

    LETTERS = TokenSet([(65, 90), (97, 122)])
    DIGITS = TokenSet([(48, 57)])
    INLINE_SPACE = _chars(0x20, 0x09)
    SPACE = _chars(0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
    HEX = TokenSet([(48, 57), (65, 70), (97, 102)])


@lru_cache(maxsize=1)
def letters() -> TokenSet:
    return TokenSet.category("L")


@lru_cache(maxsize=1)
def digits() -> TokenSet:
    return TokenSet.category("Nd")


@lru_cache(maxsize=1)
def inline_space() -> TokenSet:
    return TokenSet.category("Zs") | _chars(0x09)


@lru_cache(maxsize=1)
def any_space() -> TokenSet:
    return inline_space() | LINE_ENDS


# Additions to the category rule of UAX #31 (Other_ID_Start, Other_ID_Continue).
_OTHER_START = _chars(0x1885, 0x1886, 0x2118, 0x212E, 0x309B, 0x309C)
_OTHER_CONTINUE = _chars(0xB7, 0x387, *range(0x1369, 0x1372), 0x19DA, 0x200C, 0x200D, 0x30FB, 0xFF65)


@lru_cache(maxsize=1)
def xid_start() -> TokenSet:
    """XID_Start by its derivation: letters, letter numbers and Other_ID_Start that stay so under NFKC."""
    base = TokenSet.category("L", "Nl") | _OTHER_START
    bad = [c for lo, hi in base.spans for c in range(lo, hi + 1) if not chr(c).isidentifier()]
    return base - _chars(*bad)


@lru_cache(maxsize=1)
def xid_continue() -> TokenSet:
    """XID_Continue by its derivation."""
    base = TokenSet.category("L", "Nl", "Mn", "Mc", "Nd", "Pc") | _OTHER_START | _OTHER_CONTINUE
    bad = [c for lo, hi in base.spans for c in range(lo, hi + 1) if not ("a" + chr(c)).isidentifier()]
    return base - _chars(*bad)

"""Extended grapheme clusters, by the rules of UAX #29 without GB9c (as Java 17 has them)."""

from __future__ import annotations

from functools import lru_cache

import regex

_POST = r"[\p{GCB=Extend}\p{GCB=ZWJ}\p{GCB=SpacingMark}]"
_CLUSTER = regex.compile(
    rf"""
    \r\n
    | [\p{{GCB=Control}}\r\n]
    | \p{{GCB=Prepend}}*
      (?: \p{{GCB=L}}* (?: \p{{GCB=V}}+ | \p{{GCB=LV}} \p{{GCB=V}}* | \p{{GCB=LVT}} ) \p{{GCB=T}}* | \p{{GCB=L}}+ | \p{{GCB=T}}+
        | \p{{GCB=Regional_Indicator}}{{2}}
        | \p{{Extended_Pictographic}} (?: \p{{GCB=Extend}}* \p{{GCB=ZWJ}} \p{{Extended_Pictographic}} )*
        | [^\p{{GCB=Control}}\r\n] )
      {_POST}*
    | \p{{GCB=Prepend}}+ {_POST}*
    | {_POST}+
    | .
    """,
    regex.X | regex.S | regex.V1,
)
# Texts without any of these have one code point a token.
_JOINS = regex.compile(r"[\p{GCB=Extend}\p{GCB=ZWJ}\p{GCB=SpacingMark}\p{GCB=Prepend}\p{GCB=Regional_Indicator}\p{GCB=L}\p{GCB=V}\p{GCB=T}\p{GCB=LV}\p{GCB=LVT}]|\r\n")


def is_simple(text: str) -> bool:
    """Whether each code point is a token of its own."""
    return text.isascii() and "\r\n" not in text or _JOINS.search(text) is None


@lru_cache(maxsize=512)
def _clusters(text: str) -> tuple[str, ...]:
    return tuple(text) if is_simple(text) else tuple(_CLUSTER.findall(text))


def clusters(text: str) -> tuple[str, ...]:
    """The tokens of a text."""
    return _clusters(text) if len(text) < 256 else tuple(text) if is_simple(text) else tuple(_CLUSTER.findall(text))


def ends(text: str) -> list[int] | None:
    """For each place in the text, the end of the token that begins there; None if every code point is a token.

    A place inside a token gets the end of that token.
    """
    if is_simple(text):
        return None
    out: list[int] = []
    for c in _CLUSTER.findall(text):
        out += [len(out) + len(c)] * len(c)
    return out


def floor(text: str, at: int) -> int:
    """The start of the token that holds place ``at``."""
    start = 0
    for c in clusters(text):
        if start + len(c) > at:
            return start
        start += len(c)
    return start

"""Lowering of grammars to Java regular expressions with PEG semantics.

Sequences and choices become atomic groups and repetitions possessive, so a
lowered grammar commits where the grammar does and cannot backtrack into it.  A
rule that matches single tokens must match whole clusters: the guarded form
checks a cluster's first and last code point, the plain form is for texts in
which every code point is a token.
"""

from __future__ import annotations

from glyphloom.operators.charset import TokenSet
from glyphloom.operators.grammar import UNBOUNDED, Rule
from glyphloom.operators.segment import clusters


class NotLowerable(ValueError):
    """The grammar needs the parsing machine."""


def quote(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def nullable(rule: Rule, seen: frozenset = frozenset()) -> bool:
    """Whether the rule can match nothing."""
    if id(rule) in seen:
        return False
    seen = seen | {id(rule)}
    k, a = rule.kind, rule.args
    if k in ("eof", "not", "peek", "scan_eof", "scan_until"):
        return True
    if k == "scan_while":
        return a["minimum"] == 0
    if k == "seq":
        return all(nullable(c, seen) for c in rule.children)
    if k == "choice":
        return any(nullable(c, seen) for c in rule.children)
    if k == "repeat":
        return a["least"] == 0 or nullable(rule.children[0], seen)
    if k in ("alias", "late"):
        return nullable(rule.children[0], seen)
    return k == "custom"


# Where a token begins: not before a mark or joiner that has something to join, nor behind a joiner or inside CRLF.
_TOKEN_START = r"(?:\A|(?<=[\p{Cc}\x{2028}\x{2029}])|(?![\p{M}\x{200C}\x{200D}\x{1F3FB}-\x{1F3FF}])(?<!\x{200D}))(?<!\r(?=\n))"

# ASCII that no other code point becomes under NFC: U+212A, U+037E and U+1FEF turn into these three.
_TURNED = "K;`"


def _steady(text: str) -> bool:
    return text.isascii() and not any(c in _TURNED for c in text)


def prefix(rule: Rule) -> str:
    """What every accepted text begins with, as far as the rules say; empty if that is not ASCII."""
    text = _prefix(rule.target(), frozenset())[0]
    return text if _steady(text) else ""


def _prefix(rule: Rule, seen: frozenset) -> tuple[str, bool]:
    """(what a match begins with, whether it is the whole match)."""
    if id(rule) in seen:
        return "", False
    seen = seen | {id(rule)}
    if rule.kind in ("literal", "token"):
        return rule.args["text"], True
    if rule.kind in ("alias", "late"):
        return _prefix(rule.children[0], seen)
    if rule.kind == "repeat" and rule.args["least"] > 0:
        text, whole = _prefix(rule.children[0], seen)
        return text, whole and rule.args["most"] == 1
    if rule.kind == "seq":
        text = ""
        for c in rule.children:
            part, whole = _prefix(c, seen)
            text += part
            if not whole:
                return text, False
        return text, True
    return "", rule.kind == "eof"


def exact(rule: Rule) -> str | None:
    """The one text that the grammar accepts whole, if it is that and ASCII."""
    text, whole = _prefix(rule.target(), frozenset())
    return text if whole and text and _steady(text) else None


def ascii_only(rule: Rule) -> bool:
    """Whether all texts and sets of the grammar are ASCII, so that accents decide nothing."""
    for r in rule.walk():
        if r.kind in ("custom", "within", "identifier"):
            return False
        for v in r.args.values():
            if isinstance(v, str) and not v.isascii() or isinstance(v, TokenSet) and (v.clusters or v.spans and v.spans[-1][1] > 0x7F):
                return False
    return True


class Lowering:
    """One grammar as a pattern; ``groups`` maps the wanted names to capture groups, ``empty`` says which of them may match nothing."""

    def __init__(self, rule: Rule, names: tuple[str, ...] = (), plain: bool = False):
        if rule.is_recursive():
            raise NotLowerable("the grammar is recursive")
        self.names, self.plain, self.groups, self.empty = set(names), plain, {}, {}
        self.maybe = 0  # how many parts that need not take part are around
        self.pattern = self._body(rule, 0)

    def _one(self, s: TokenSet) -> str:
        cls = s.java_class()
        if self.plain:
            one = cls
        else:
            one = rf"(?={cls})\X(?<={cls})" if s.spans else "(?!)"
        parts = [self._literal(c) for c in sorted(s.clusters, key=len, reverse=True)] + ([one] if s.spans else [])
        return one if not s.clusters else "(?>" + "|".join(parts) + ")"

    def _any(self) -> str:
        return "(?s:.)" if self.plain else r"\X"

    def _literal(self, text: str) -> str:
        if self.plain:
            return quote(text)
        last = clusters(text)[-1]
        head = text[: -len(last)]
        return (quote(head) if head else "") + rf"(?={quote(last)})\X(?<={quote(last)})" if len(last) == 1 else (quote(head) if head else "") + rf"(?={quote(last)}(?!\p{{M}}))\X"

    def _named(self, rule: Rule, make) -> str:
        if rule.name in self.names:
            if rule.name in self.groups:
                raise NotLowerable(f"{rule.name} occurs twice")
            self.groups[rule.name] = len(self.groups) + 1
            self.empty[rule.name] = nullable(rule)
            if self.empty[rule.name] and self.maybe:
                raise NotLowerable(f"{rule.name} may match nothing or take no part, which a pattern cannot tell")
            return "(" + make() + ")"
        return make()

    def _body(self, rule: Rule, repeated: int) -> str:
        if rule.name in self.names and repeated:
            raise NotLowerable(f"{rule.name} is repeated")
        return self._named(rule, lambda: self._plain_body(rule, repeated))

    def _plain_body(self, rule: Rule, repeated: int) -> str:
        k, a, ch = rule.kind, rule.args, rule.children
        if k in ("choice", "not", "peek", "scan_until") or k == "repeat" and a["least"] == 0:
            self.maybe += 1
            try:
                return self._of_kind(rule, repeated)
            finally:
                self.maybe -= 1
        return self._of_kind(rule, repeated)

    def _of_kind(self, rule: Rule, repeated: int) -> str:
        k, a, ch = rule.kind, rule.args, rule.children
        low = lambda r, more=0: self._body(r, repeated + more)
        if k in ("literal", "token"):
            return self._literal(a["text"])
        if k == "literal_ci":
            last = a["text"][-1]
            guard = "" if self.plain else rf"(?={last if last.isalnum() else quote(last)}(?!\p{{M}}|\x{{200D}}))"
            return "(?i:" + (quote(a["text"][:-1]) if len(a["text"]) > 1 else "") + guard + quote(last) + ")"
        if k == "one_of":
            return self._one(a["set"])
        if k == "none_of":
            return rf"(?!{self._one(a['set'])}){self._any()}"
        if k == "any":
            return self._any()
        if k == "scan_while":
            return f"(?:{self._one(a['set'])}){{{a['minimum']},}}+"
        if k == "identifier":
            start, body = a["start"].java_class(), a["body"].java_class()
            if self.plain:
                return f"{start}{body}*+"
            whole = rf"\X(?<={body})"
            return rf"(?={start}){whole}(?>(?={body}){whole})*+"
        if k == "scan_eof":
            return r"(?s:.*+)"
        if k == "eof":
            return r"\z"
        if k == "seq":
            return "(?>" + "".join(low(c) for c in ch) + ")"
        if k == "choice":
            return "(?>" + "|".join(low(c) for c in ch) + ")"
        if k == "repeat":
            least, most = a["least"], a["most"]
            if nullable(ch[0]) and least > 0:
                raise NotLowerable("a counted repetition of what can match nothing")
            one = low(ch[0], 1 if most > 1 else 0)
            if (least, most) == (0, 1):
                return f"(?:{one})?+"
            return f"(?>(?:{one}){{{least},{'' if most >= UNBOUNDED else most}}}+)"
        if k == "not":
            return f"(?!{low(ch[0], 1)})"
        if k == "peek":
            return f"(?={low(ch[0], 1)})"
        if k in ("alias", "late"):
            return low(ch[0])
        if k == "scan_until":
            parts = [low(c, 1) for c in ch]
            stop = parts.pop(0) if a["has_stop"] else self._one(a["set"])
            escape = parts.pop(0) if a["has_escape"] else self._literal(a["escape"]) if a["escape"] else None
            end = parts.pop(0) if parts else None
            close = rf"(?={stop}|\z)" if a["eof"] else f"(?={stop})"
            if escape is None:
                return rf"(?:(?!{stop}){self._any()})*+{close}"
            return rf"(?:(?>{escape}){end}|(?!{escape})(?!{stop}){self._any()})*+(?!{escape}){close}"
        if k == "custom" and a.get("regex"):
            return f"(?>{a['regex']})"
        raise NotLowerable(f"{k} needs the parsing machine")


def lower(rule: Rule, names: tuple[str, ...] = (), plain: bool = False, anchored: bool = True, allow_trailing: bool = False) -> Lowering:
    """The pattern for a whole-text parse, or with ``anchored=False`` for a search."""
    out = Lowering(rule, names, plain)
    if anchored:
        out.pattern = rf"\A{out.pattern}" + ("" if allow_trailing else r"\z")
    elif not plain:
        out.pattern = _TOKEN_START + out.pattern
    return out


def lowerable(rule: Rule, names: tuple[str, ...] = ()) -> bool:
    try:
        Lowering(rule, names)
    except NotLowerable:
        return False
    return True

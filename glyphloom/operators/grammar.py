"""Grammars: rules, their modifiers, and the compile pass.

A grammar is a graph of rules made by the factories below.  ``compile`` checks
and normalizes it once on the driver and seals it; after that it is lowered to
Spark expressions (``regexgen``) or to a parsing machine (``vm``).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from typing import Any

from glyphloom.operators import charset
from glyphloom.operators.charset import TokenSet
from glyphloom.operators.segment import clusters

PRESERVE, FLATTEN, DELETE = "preserve", "flatten", "delete"
CUSTOM_START = 0x200000
BUILTIN_START = 0x110000
UNBOUNDED = 1 << 31

# Kinds that match text by themselves and so make one leaf.
LEAVES = frozenset("literal literal_ci token one_of none_of any scan_while scan_until scan_eof within identifier".split())
_DEFAULT = {k: FLATTEN for k in ("seq", "choice", "repeat", "alias", "late", "custom")} | {k: DELETE for k in ("literal", "literal_ci", "token", "eof", "not", "peek")}


class GrammarError(ValueError):
    """A grammar that cannot be built or compiled."""


class Rule:
    """One node of a grammar.  ``kind`` and ``args`` say what it matches, ``children`` with what."""

    def __init__(self, kind: str, children: tuple[Rule, ...] = (), flatten: str | None = None, **args: Any):
        if any(not isinstance(c, Rule) for c in children):
            raise GrammarError(f"{kind}: a child is not a rule")
        self.kind, self.children, self.args = kind, tuple(children), args
        self.name: str | None = None
        self.id: int | None = None
        self.error: str | None = None
        self.forced = False
        self.form: str | None = None
        self.sealed = self.poisoned = False
        self._flatten = flatten or _DEFAULT.get(kind, PRESERVE)
        self._explicit_flatten = self._explicit_id = False

    # -- modifiers: each is set once, before compiling
    def _open(self) -> None:
        if self.sealed:
            raise GrammarError("the rule is compiled; it cannot change")
        if self.kind == "late":
            raise GrammarError("a late-bound rule takes names and errors from its target")

    def as_(self, name: str | int) -> Rule:
        """Names the rule (a field of the result) or gives it an explicit id; it is then preserved."""
        self._open()
        if self._explicit_flatten and self._flatten != PRESERVE:
            raise GrammarError("a flattened or deleted rule cannot be named")
        if isinstance(name, str):
            if self.name is not None:
                raise GrammarError("the rule has a name")
            if not name:
                raise GrammarError("a name cannot be empty")
            self.name = name
        else:
            if name < CUSTOM_START:
                raise GrammarError(f"explicit ids begin at {CUSTOM_START:#x}")
            if self._explicit_id:
                raise GrammarError("the rule has an id")
            self.id, self._explicit_id = name, True
        self._flatten = PRESERVE
        return self

    def shape(self, flatten: str) -> Rule:
        self._open()
        if flatten not in (PRESERVE, FLATTEN, DELETE):
            raise GrammarError(f"no such shape: {flatten}")
        if (self.name or self._explicit_id) and flatten != PRESERVE:
            raise GrammarError("a named rule is preserved")
        self._flatten, self._explicit_flatten = flatten, True
        return self

    def preserve(self) -> Rule:
        return self.shape(PRESERVE)

    def flatten(self) -> Rule:
        return self.shape(FLATTEN)

    def delete(self) -> Rule:
        return self.shape(DELETE)

    def flatten_by_default(self, flatten: str) -> Rule:
        """Like ``shape``, but a later name still wins."""
        self._open()
        if not self._explicit_flatten and not self.name and not self._explicit_id:
            self._flatten = flatten
        return self

    def with_error(self, message: str, forced: bool = False) -> Rule:
        self._open()
        if self.error is not None:
            raise GrammarError("the rule has an error message")
        self.error, self.forced = message, forced
        return self

    def aliased_as(self, name: str | int) -> Rule:
        return alias(self).as_(name)

    def bind(self, target: Rule) -> Rule:
        """Gives a late-bound rule its target, once."""
        if self.kind != "late":
            raise GrammarError("only a late-bound rule can be bound")
        if self.children:
            raise GrammarError("the rule is bound")
        self.children = (target,)
        return self

    # -- introspection
    @property
    def shape_of(self) -> str:
        return self.target()._flatten if self.kind == "late" else self._flatten

    @property
    def emits_leaf(self) -> bool:
        if self.kind in ("alias", "late") and self.children:
            return self.children[0].emits_leaf
        return self.kind in LEAVES

    def target(self) -> Rule:
        """What a chain of late-bound rules ends in."""
        at, seen = self, set()
        while at.kind == "late":
            if id(at) in seen:
                raise GrammarError("late-bound rules lead in a circle")
            seen.add(id(at))
            if not at.children:
                raise GrammarError("a late-bound rule is not bound")
            at = at.children[0]
        return at

    def walk(self) -> Iterator[Rule]:
        """All rules that can be reached, each once, parents first."""
        seen, stack = set(), [self]
        while stack:
            r = stack.pop()
            if id(r) in seen:
                continue
            seen.add(id(r))
            yield r
            stack.extend(reversed(r.children))

    def names(self) -> list[str]:
        return [r.name for r in self.walk() if r.name]

    def id_of(self, name: str) -> int:
        for r in self.walk():
            if r.name == name:
                return r.id
        raise KeyError(name)

    def name_of(self, id_: int) -> str | None:
        for r in self.walk():
            if r.id == id_:
                return r.name or f"{r.kind}"
        return chr(id_) if id_ < BUILTIN_START else None

    def is_recursive(self) -> bool:
        done, path = set(), set()

        def visit(r: Rule) -> bool:
            if id(r) in path:
                return True
            if id(r) in done:
                return False
            path.add(id(r))
            found = any(visit(c) for c in r.children)
            path.discard(id(r))
            done.add(id(r))
            return found

        return visit(self)

    def explain(self) -> str:
        lines, shown = [], set()

        def show(r: Rule, depth: int) -> None:
            args = ", ".join(f"{k}={v}" for k, v in r.args.items() if v is not None and not callable(v))
            lines.append("  " * depth + f"{r.name + ': ' if r.name else ''}{r.kind}({args}) [{r.shape_of}]" + (" ..." if id(r) in shown and r.children else ""))
            if id(r) not in shown:
                shown.add(id(r))
                for c in r.children:
                    show(c, depth + 1)

        show(self, 0)
        return "\n".join(lines)

    # -- compiling
    def compile(self, form: str | None = "NFC") -> Rule:
        """Checks, numbers, normalizes and seals the grammar; the same form again does nothing."""
        if self.sealed:
            if form != self.form:
                raise GrammarError("the grammar is compiled for another normalization form")
            return self
        rules = list(self.walk())
        for r in rules:
            if r.poisoned:
                raise GrammarError("a rule is part of a grammar that failed to compile")
            if r.sealed:
                raise GrammarError("a rule is part of a compiled grammar")
        try:
            _check_names(rules)
            for r in rules:
                r.target()
                if r.kind == "custom" and (check := r.args.get("validate")):
                    check(r)
            if form:
                _normalize(rules, form)
            _number(rules)
        except Exception:
            for r in rules:
                r.poisoned = True
            raise
        for r in rules:
            r.sealed, r.form = True, form
        return self


def _check_names(rules: list[Rule]) -> None:
    names: dict[str, Rule] = {}
    ids: dict[int, Rule] = {}
    for r in rules:
        if r.name and names.setdefault(r.name, r) is not r:
            raise GrammarError(f"two rules are named {r.name!r}")
        if r._explicit_id and ids.setdefault(r.id, r) is not r:
            raise GrammarError(f"two rules have the id {r.id:#x}")


def name_slot(name: str) -> int:
    """The first id tried for a name: FNV-1a over its UTF-16 bytes, in the custom range."""
    h = 2166136261
    for byte in name.encode("utf-16-le"):
        h = (h ^ byte) * 16777619 & 0xFFFFFFFF
    return CUSTOM_START + (h & 0x7FFFFFFF) % (0x7FFFFFFF - CUSTOM_START)


def _number(rules: list[Rule]) -> None:
    used = {r.id for r in rules if r._explicit_id}

    def next_free(at: int) -> int:
        while at in used:
            at += 1
        used.add(at)
        return at

    for r in rules:
        if r.name and not r._explicit_id:
            r.id = next_free(name_slot(r.name))
    for r in rules:
        if r.id is None:
            one = r.args.get("text")
            r.id = ord(one) if r.kind == "token" and len(one) == 1 else next_free(CUSTOM_START)


def _normalize(rules: list[Rule], form: str) -> None:
    bad: list[str] = []
    for r in rules:
        if r.kind == "custom" and (hook := r.args.get("normalize")):
            bad += hook(form) or []
        for key, value in r.args.items():
            if key in ("text", "escape") and isinstance(value, str) and r.kind != "literal_ci":
                new = unicodedata.normalize(form, value)
                if (r.kind == "token" or key == "escape") and len(clusters(new)) != 1:
                    bad.append(f"{r.kind} {value!r}")
                r.args[key] = new
            elif isinstance(value, TokenSet):
                new_set, offenders = value.normalized(form) if len(value) < 5000 or form in ("NFKC", "NFKD") else (value, [])
                bad += [f"{r.kind} {o!r}" for o in offenders] if r.kind not in ("identifier",) and len(value) < 5000 else []
                r.args[key] = new_set | value if r.kind == "identifier" else new_set
    if bad:
        raise GrammarError(f"under {form} these become several tokens: {', '.join(bad[:10])}")


# -- leaf rules
def token(x: str | int) -> Rule:
    """Exactly one token."""
    text = chr(x) if isinstance(x, int) else x
    if 0xD800 <= (ord(text) if len(text) == 1 else 0) <= 0xDFFF:
        raise GrammarError("a surrogate is not a token")
    if len(clusters(text)) != 1:
        raise GrammarError(f"not one token: {text!r}")
    return Rule("token", text=text)


def literal(text: str) -> Rule:
    """Exactly this text, to a token's end."""
    if not text:
        raise GrammarError("a literal cannot be empty")
    return Rule("literal", text=text)


def literal_ignore_ascii_case(text: str) -> Rule:
    """An ASCII text, A-Z and a-z alike."""
    if not text or not text.isascii():
        raise GrammarError("the text must be ASCII and not empty")
    return Rule("literal_ci", text=text)


def _set(x: TokenSet | str) -> TokenSet:
    return x if isinstance(x, TokenSet) else TokenSet.runes(x)


def one_of(x: TokenSet | str) -> Rule:
    return Rule("one_of", set=_set(x))


def none_of(x: TokenSet | str) -> Rule:
    return Rule("none_of", set=_set(x))


def any_token() -> Rule:
    return Rule("any")


def scan_while(x: TokenSet | str, minimum: int = 1) -> Rule:
    """The longest run of tokens in the set, as one leaf."""
    if minimum < 0:
        raise GrammarError("the least count cannot be negative")
    return Rule("scan_while", set=_set(x), minimum=minimum)


def scan_until(stop: TokenSet | str | Rule, escape: str | Rule | None = None, escape_end: Rule | None = None, eof_ends: bool = False) -> Rule:
    """Everything up to the stopper; an escape start with its escape end is stepped over, and tried before the stopper."""
    if (escape is None) != (escape_end is None):
        raise GrammarError("an escape needs its start and its end")
    parts: dict[str, Any] = {"set": None, "escape": None, "eof": eof_ends, "has_stop": False, "has_escape": False}
    children = []
    if isinstance(stop, Rule):
        children.append(stop)
        parts["has_stop"] = True
    else:
        parts["set"] = _set(stop)
    if isinstance(escape, Rule):
        children.append(escape)
        parts["has_escape"] = True
    elif escape is not None:
        if len(clusters(escape)) != 1:
            raise GrammarError("the escape start is not one token")
        parts["escape"] = escape
    if escape_end is not None:
        children.append(escape_end)
    return Rule("scan_until", tuple(children), **parts)


def scan_until_eof() -> Rule:
    return Rule("scan_eof")


def eof() -> Rule:
    return Rule("eof")


def within_token(inner: Rule) -> Rule:
    """One token whose code points, each a token of its own, the inner rule matches completely."""
    return Rule("within", (inner,))


# -- composite rules
def seq(*rules: Rule) -> Rule:
    if not rules:
        raise GrammarError("a sequence needs a rule")
    return Rule("seq", rules)


def choice(*rules: Rule) -> Rule:
    """The first rule that matches; it is never revisited."""
    if not rules:
        raise GrammarError("a choice needs a rule")
    return Rule("choice", rules)


def between(least: int, most: int, rule: Rule) -> Rule:
    """Greedy and possessive; a match of nothing counts once and ends the run."""
    if least < 0 or most < least:
        raise GrammarError("the counts must satisfy 0 <= least <= most")
    return Rule("repeat", (rule,), least=least, most=most)


def one_or_more(rule: Rule) -> Rule:
    return between(1, UNBOUNDED, rule)


def zero_or_more(rule: Rule) -> Rule:
    return between(0, UNBOUNDED, rule)


def optional(rule: Rule) -> Rule:
    return between(0, 1, rule)


def at_least(n: int, rule: Rule) -> Rule:
    return between(n, UNBOUNDED, rule)


def at_most(n: int, rule: Rule) -> Rule:
    return between(0, n, rule)


def exactly(n: int, rule: Rule) -> Rule:
    return between(n, n, rule)


def not_(rule: Rule) -> Rule:
    return Rule("not", (rule,))


def peek(rule: Rule) -> Rule:
    return Rule("peek", (rule,))


def alias(rule: Rule) -> Rule:
    """The same match under another name."""
    return Rule("alias", (rule,))


def late_bound() -> Rule:
    """A rule whose target comes later, for recursion."""
    return Rule("late")


def custom(match: Callable, *children: Rule, validate: Callable | None = None, regex: str | None = None, normalize: Callable | None = None) -> Rule:
    """A rule of one's own: ``match(cursor, at, children)`` returns the end of the match or None.

    ``cursor`` is a ``vm.Cursor`` (text, tokens); ``children`` are ``vm.Child``
    callables, which can be tried anywhere, probed, and rolled back.  When the
    grammar is compiled, ``validate(rule)`` may raise, and ``normalize(form)``
    turns the rule's own texts to a form and names those it cannot.
    """
    return Rule("custom", children, match=match, validate=validate, regex=regex, normalize=normalize)


def longest(*rules: Rule) -> Rule:
    """The alternative with the longest match, the first of equals."""

    def match(cursor, at: int, children) -> int | None:
        ends = [c.probe(at) for c in children]
        if max(ends) < 0:
            for c in children:  # for their failures
                c(at)
            return None
        return children[ends.index(max(ends))](at)

    return custom(match, *rules)


# -- convenience rules
def integer() -> Rule:
    d = charset.digits()
    return seq(optional(one_of("+-")), scan_while(d))


def float_() -> Rule:
    d = charset.digits()
    return seq(optional(one_of("+-")), scan_while(d), token(".").preserve(), scan_while(d))


def inline_whitespace() -> Rule:
    return scan_while(charset.inline_space()).flatten_by_default(DELETE)


def any_whitespace() -> Rule:
    return one_or_more(choice(end_of_line(), inline_whitespace())).flatten_by_default(DELETE)


def end_of_line(eof_ends: bool = False) -> Rule:
    ends = [token("\r\n"), one_of(charset.LINE_ENDS)]
    return choice(*ends, *([eof()] if eof_ends else [])).flatten_by_default(DELETE)


def identifier(extra_start: TokenSet | str = "", extra_body: TokenSet | str = "") -> Rule:
    """A Unicode identifier: XID_Start, then XID_Continue, with extra characters allowed."""
    start, body = _set(extra_start), _set(extra_body)
    if start.clusters or body.clusters:
        raise GrammarError("extra identifier characters are single code points")
    return Rule("identifier", start=charset.xid_start() | start, body=charset.xid_continue() | start | body)

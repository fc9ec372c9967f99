"""The machine's quick path: accepting a text without keeping track of failures.

Most parses succeed, and of a parse that succeeds only the tree matters.  So a
text whose code points are all tokens of their own is first parsed by closures
that record no failure and in which every part without nodes, and every leaf, is
one compiled pattern with the grammar's commitments.  Only if that parse fails,
or comes near a budget, the exact machine runs, for its diagnostics.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from glyphloom.operators.charset import TokenSet
from glyphloom.operators.grammar import DELETE, FLATTEN, LEAVES, PRESERVE, UNBOUNDED, Rule
from glyphloom.operators.regexgen import nullable

# Repetitions and recursions after which the exact machine decides.
FUEL = 200_000
# The exact machine counts rules and tokens; texts longer than this share of its limit are left to it.
SHARE = 100


class OutOfFuel(Exception):
    """The parse may come near a budget."""


def _class(s: TokenSet) -> str:
    """The code points of a set as a class of Python's patterns."""
    one = lambda c: f"\\U{c:08x}"
    return "[" + "".join(one(lo) + ("" if lo == hi else "-" + one(hi)) for lo, hi in s.spans) + "]" if s.spans else "(?!)"


class Quick:
    """A sealed grammar as patterns and closures; ``slow`` is its exact program."""

    def __init__(self, root: Rule, slow):
        self.slow, self.all = slow, slow.all
        self.steps: dict[int, Callable] = {}
        self.patterns: dict[int, str | None] = {}
        self.height = self._height(root)
        self.run = self._step(root)

    # -- budgets
    def _height(self, root: Rule) -> int:
        """The most rules inside each other without passing a late-bound rule."""
        known: dict[int, int] = {}

        def up(r: Rule) -> int:
            if id(r) not in known:
                known[id(r)] = 1 if r.kind == "late" else 1 + max([up(c) for c in r.children], default=0)
            return known[id(r)]

        return max(up(r) for r in root.walk()) + 1

    # -- patterns
    def _pattern(self, rule: Rule) -> str | None:
        """What the rule matches, as a pattern; None where that cannot be said."""
        if id(rule) not in self.patterns:
            self.patterns[id(rule)] = None  # of a rule inside itself
            self.patterns[id(rule)] = self._body(rule)
        return self.patterns[id(rule)]

    def _body(self, rule: Rule) -> str | None:
        k, a = rule.kind, rule.args
        parts = [self._pattern(c) for c in rule.children]
        if None in parts:
            return None
        if k in ("literal", "token"):
            return re.escape(a["text"])
        if k == "literal_ci":
            return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else re.escape(c) for c in a["text"])
        if k == "one_of":
            return _class(a["set"])
        if k == "none_of":
            return f"(?!{_class(a['set'])})(?s:.)"
        if k == "any":
            return "(?s:.)"
        if k == "scan_while":
            return f"{_class(a['set'])}{{{a['minimum']},}}+"
        if k == "identifier":
            return f"{_class(a['start'])}{_class(a['body'])}*+"
        if k == "scan_eof":
            return "(?s:.*+)"
        if k == "eof":
            return r"\Z"
        if k == "seq":
            return "(?>" + "".join(parts) + ")"
        if k == "choice":
            return "(?>" + "|".join(parts) + ")"
        if k == "repeat":
            least, most = a["least"], a["most"]
            if nullable(rule.children[0]) and least > 0:
                return None
            return f"(?:{parts[0]}){{{least},{'' if most >= UNBOUNDED else most}}}+"
        if k == "not":
            return f"(?!{parts[0]})"
        if k == "peek":
            return f"(?={parts[0]})"
        if k in ("alias", "late"):
            return parts[0]
        if k == "scan_until":
            children = list(rule.children)
            stop = parts.pop(0) if a["has_stop"] else _class(a["set"])
            if a["has_stop"]:
                children.pop(0)
            if a["has_escape"] and nullable(children[0]):
                return None
            escape = parts.pop(0) if a["has_escape"] else re.escape(a["escape"]) if a["escape"] else None
            end = parts.pop(0) if parts else None
            close = rf"(?={stop}|\Z)" if a["eof"] else f"(?={stop})"
            if escape is None:
                return rf"(?:(?!{stop})(?s:.))*+{close}"
            return rf"(?:(?>{escape}){end}|(?!{escape})(?!{stop})(?s:.))*+(?!{escape}){close}"
        return None

    # -- what leaves nodes
    def _shape(self, rule: Rule) -> str:
        return PRESERVE if self.all else rule.shape_of

    def _silent(self, rule: Rule, seen: frozenset = frozenset()) -> bool:
        """Whether the rule never leaves a node."""
        if rule.kind == "late":
            return id(rule) not in seen and self._silent(rule.target(), seen | {id(rule)})
        if self._shape(rule) == DELETE:
            return True
        if rule.kind in LEAVES or rule.kind == "custom":
            return False
        if rule.kind == "alias" and not (rule.name is None and not rule._explicit_id and rule._flatten == FLATTEN):
            return False
        if rule.kind in ("eof", "not", "peek"):
            return self._shape(rule) == FLATTEN
        return self._shape(rule) == FLATTEN and all(self._silent(c, seen) for c in rule.children)

    def _fused(self, rule: Rule) -> tuple[str, list[tuple]] | None:
        """(pattern, nodes it leaves) of a rule that one pattern with groups can do; a node is (rule, whether it goes by its code point, its nodes or None)."""
        pattern = self._pattern(rule)
        if pattern is None:
            return None
        if self._silent(rule):
            return f"(?>{pattern})", []
        k = rule.kind
        if k in LEAVES:
            return f"({pattern})", [(rule, k in ("one_of", "none_of", "any") and rule.name is None and not rule._explicit_id, None)]
        if k == "late":
            return self._fused(rule.target())
        if k == "alias":
            if rule.name is None and not rule._explicit_id and rule._flatten == FLATTEN:
                return self._fused(rule.children[0])
            return (f"({pattern})", [(rule, False, None)]) if rule.emits_leaf else None
        if k not in ("seq", "choice", "repeat") or k == "repeat" and rule.args["most"] != 1:
            return None
        parts = [self._fused(c) for c in rule.children]
        if None in parts:
            return None
        nodes = [n for _, own in parts for n in own]
        text = ("|" if k == "choice" else "").join(p for p, _ in parts)
        text = f"(?>{text})" if k != "repeat" else f"(?:{text})?+" if rule.args["least"] == 0 else text
        return (f"({text})", [(rule, False, nodes)]) if self._shape(rule) == PRESERVE else (text, nodes)

    @staticmethod
    def _grouped(pattern: str, nodes: list[tuple]) -> Callable:
        """A step that matches a fused pattern and makes its nodes."""
        from glyphloom.operators.vm import Node

        number = iter(range(1, 1 << 30))  # groups open in the order of the nodes

        def numbered(some: list[tuple]) -> list[tuple]:
            return [(rule, rune, next(number), None if own is None else numbered(own)) for rule, rune, own in some]

        match, plan = re.compile(pattern).match, numbered(nodes)

        def make(m: re.Match, text: str, some: list[tuple], out: list) -> None:
            for rule, rune, group, own in some:
                a, b = m.span(group)
                if a < 0:
                    continue
                if own is None:
                    out.append(Node(rule, ord(text[a]) if rune else rule.id, a, b, None))
                else:
                    below: list = []
                    make(m, text, own, below)
                    out.append(Node(rule, rule.id, a, b, below))

        def step(c, at: int, out: list | None) -> int:
            m = match(c.text, at)
            if m is None:
                return -1
            if out is not None:
                make(m, c.text, plan, out)
            return m.end()

        return step

    # -- steps: (cursor, place, list for nodes or None) -> end of the match, or -1
    def _step(self, rule: Rule) -> Callable:
        if (known := self.steps.get(id(rule))) is not None:
            return known
        box: list[Callable] = []
        self.steps[id(rule)] = lambda c, at, out: box[0](c, at, out)
        box.append(self._make(rule))
        self.steps[id(rule)] = box[0]
        return box[0]

    @staticmethod
    def _compiled(pattern: str) -> Callable:
        match = re.compile(pattern).match

        def step(c, at: int, out: list | None) -> int:
            m = match(c.text, at)
            return -1 if m is None else m.end()

        return step

    def _make(self, rule: Rule) -> Callable:
        from glyphloom.operators.vm import Node

        pattern = self._pattern(rule)
        if pattern is not None and self._silent(rule):
            return self._compiled(pattern)
        if rule.kind in LEAVES:
            if pattern is None:
                return self.slow._step(rule)
            match = re.compile(pattern).match
            rune = rule.kind in ("one_of", "none_of", "any") and rule.name is None and not rule._explicit_id

            def leaf(c, at: int, out: list | None) -> int:
                m = match(c.text, at)
                if m is None:
                    return -1
                end = m.end()
                if out is not None:
                    out.append(Node(rule, ord(c.text[at]) if rune else rule.id, at, end, None))
                return end

            return leaf
        if (fused := self._fused(rule)) is not None:
            return self._grouped(*fused)
        return getattr(self, f"_{rule.kind}")(rule)

    def _composite(self, rule: Rule, match: Callable) -> Callable:
        from glyphloom.operators.vm import Node

        shape = self._shape(rule)
        if shape == FLATTEN:
            return match
        if shape == DELETE:
            return lambda c, at, out: match(c, at, None)

        def step(c, at: int, out: list | None) -> int:
            if out is None:
                return match(c, at, None)
            own: list = []
            end = match(c, at, own)
            if end >= 0:
                out.append(Node(rule, rule.id, at, end, own))
            return end

        return step

    def _seq(self, rule: Rule) -> Callable:
        steps, run = [], []
        # children side by side that patterns can do are one pattern
        for child in [*rule.children, None]:
            if child is not None and (fused := self._fused(child)) is not None:
                run.append(fused)
                continue
            if run:
                nodes = [n for _, own in run for n in own]
                text = "".join(p for p, _ in run)
                steps.append(self._grouped(text, nodes) if nodes else self._compiled(text))
                run = []
            if child is not None:
                steps.append(self._step(child))

        def match(c, at: int, out: list | None) -> int:
            n = 0 if out is None else len(out)
            for step in steps:
                at = step(c, at, out)
                if at < 0:
                    if out is not None and len(out) > n:
                        del out[n:]
                    return -1
            return at

        return self._composite(rule, match)

    def _first(self, rule: Rule, seen: frozenset = frozenset()) -> TokenSet | None:
        """The code points a match can begin with; None if that is not known or the match can be empty."""
        k, a = rule.kind, rule.args
        if id(rule) in seen or nullable(rule):
            return None
        seen = seen | {id(rule)}
        if k in ("literal", "token"):
            return TokenSet.single(a["text"][0])
        if k == "literal_ci":
            return TokenSet([(ord(c), ord(c)) for c in {a["text"][0].lower(), a["text"][0].upper()}])
        if k in ("one_of", "scan_while"):
            return a["set"]
        if k == "identifier":
            return a["start"]
        if k in ("alias", "late"):
            return self._first(rule.children[0], seen)
        if k == "repeat":
            return self._first(rule.children[0], seen)
        if k == "choice":
            parts = [self._first(c, seen) for c in rule.children]
            return None if None in parts else TokenSet([span for p in parts for span in p.spans])
        if k == "seq":
            spans: list[tuple[int, int]] = []
            for c in rule.children:
                if c.kind in ("not", "peek"):
                    continue
                if not nullable(c):
                    part = self._first(c, seen)
                    return None if part is None else TokenSet([*spans, *part.spans])
                if c.kind != "repeat" or (part := self._first(c.children[0], seen)) is None:
                    return None
                spans += part.spans
        return None

    def _choice(self, rule: Rule) -> Callable:
        steps = [(self._step(x), self._first(x)) for x in rule.children]
        # the alternatives worth a try, by the next character
        known: dict[str, list[Callable]] = {"": [step for step, first in steps if first is None]}

        def match(c, at: int, out: list | None) -> int:
            char = c.text[at : at + 1]
            tries = known.get(char)
            if tries is None:
                tries = known[char] = [step for step, first in steps if first is None or first.has(ord(char))]
            for step in tries:
                end = step(c, at, out)
                if end >= 0:
                    return end
            return -1

        return self._composite(rule, match)

    def _repeat(self, rule: Rule) -> Callable:
        step, least, most = self._step(rule.children[0]), rule.args["least"], rule.args["most"]

        def match(c, at: int, out: list | None) -> int:
            start, n = 0 if out is None else len(out), 0
            while n < most:
                end = step(c, at, out)
                if end < 0:
                    break
                n += 1
                c.fuel -= 1
                if end == at:
                    break
                at = end
            if c.fuel < 0:
                raise OutOfFuel
            if n < least:
                if out is not None and len(out) > start:
                    del out[start:]
                return -1
            return at

        return self._composite(rule, match)

    def _eof(self, rule: Rule) -> Callable:
        return self._composite(rule, lambda c, at, out: at if at >= c.size else -1)

    def _look(self, rule: Rule, wanted: bool) -> Callable:
        step = self._step(rule.children[0])
        return self._composite(rule, lambda c, at, out: at if (step(c, at, None) >= 0) is wanted else -1)

    def _not(self, rule: Rule) -> Callable:
        return self._look(rule, False)

    def _peek(self, rule: Rule) -> Callable:
        return self._look(rule, True)

    def _alias(self, rule: Rule) -> Callable:
        from glyphloom.operators.vm import Node

        step, inner = self._step(rule.children[0]), rule.children[0].target()
        shape, leaf = self._shape(rule), rule.emits_leaf
        transparent = rule.name is None and not rule._explicit_id and rule._flatten == FLATTEN

        def match(c, at: int, out: list | None) -> int:
            if transparent or out is None:
                return step(c, at, out)
            own: list = []
            end = step(c, at, own)
            if end < 0 or shape == DELETE:
                return end
            if leaf:
                out.append(Node(rule, rule.id, at, end, None))
                return end
            lifted = len(own) == 1 and own[0].rule is inner and own[0].children is not None and inner.shape_of != DELETE
            out.append(Node(rule, rule.id, at, end, own[0].children if lifted else own))
            return end

        return match

    def _late(self, rule: Rule) -> Callable:
        target, steps, height = rule.target(), self.steps, self.height
        self._step(target)

        def step(c, at: int, out: list | None) -> int:
            c.depth += 1
            c.fuel -= 1
            if c.fuel < 0 or 0 < c.options.max_depth <= c.depth * height:
                raise OutOfFuel
            end = steps[id(target)](c, at, out)
            c.depth -= 1
            return end

        return step

    def _custom(self, rule: Rule) -> Callable:
        from glyphloom.operators.vm import Children

        children, own = [self._step(x) for x in rule.children], rule.args["match"]

        def match(c, at: int, out: list | None) -> int:
            n = 0 if out is None else len(out)
            end = own(c, at, Children(c, children, out))
            if end is None or end < 0:
                if out is not None and len(out) > n:
                    del out[n:]
                return -1
            return end

        return self._composite(rule, match)

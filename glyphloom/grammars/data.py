"""Data formats: JSON, strings, arithmetic, settings, RESP."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphloom.functions import parsing
from glyphloom.operators import charset, vm
from glyphloom.operators import grammar as g
from glyphloom.operators.charset import Ascii, TokenSet

_JSON_SPACE = " \t\n\r"
_ESCAPES = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


def json_document() -> g.Rule:
    """A JSON text; nodes: object, member, array, string, number, word."""
    value = g.late_bound()
    ws = g.zero_or_more(g.choice(g.token("\r\n"), g.one_of(_JSON_SPACE))).delete()
    escape_end = g.choice(g.seq(g.token("u"), g.exactly(4, g.one_of(Ascii.HEX))), g.one_of('"\\/bfnrt'))
    body = g.scan_until(TokenSet.runes('"') | TokenSet.range(0, 0x1F), "\\", escape_end)
    string = g.seq(g.token('"'), body, g.token('"').with_error("unterminated string")).as_("string")
    digits = g.scan_while(Ascii.DIGITS)
    number = g.seq(g.optional(g.token("-").preserve()), digits, g.optional(g.seq(g.token(".").preserve(), g.scan_while(Ascii.DIGITS))), g.optional(g.seq(g.one_of("eE"), g.optional(g.one_of("+-")), g.scan_while(Ascii.DIGITS)))).as_("number")
    word = g.choice(*[g.literal(w).preserve() for w in ("true", "false", "null")]).as_("word")
    comma = g.seq(ws, g.token(","), ws)
    member = g.seq(string, ws, g.token(":"), ws, value).as_("member")
    obj = g.seq(g.token("{"), ws, g.optional(g.seq(member, g.zero_or_more(g.seq(comma, member)))), ws, g.token("}")).as_("object")
    array = g.seq(g.token("["), ws, g.optional(g.seq(value, g.zero_or_more(g.seq(comma, value)))), ws, g.token("]")).as_("array")
    value.bind(g.choice(obj, array, string, number, word).with_error("expected a value"))
    return g.seq(ws, value, ws)


def unescape(text: str) -> str:
    """The text of a JSON string body."""
    if "\\" not in text:
        return text
    out, k = [], 0
    while k < len(text):
        c = text[k]
        if c != "\\":
            out.append(c)
            k += 1
        elif text[k + 1] == "u":
            out.append(chr(int(text[k + 2 : k + 6], 16)))
            k += 6
        else:
            out.append(_ESCAPES[text[k + 1]])
            k += 2
    return "".join(out).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def text_under(n: vm.Node, text: str) -> str:
    return text[n.start : n.end] if n.children is None else "".join(text_under(c, text) for c in n.children)


def json_python(n: vm.Node, text: str):
    """A node as a Python value; of equal keys the last wins."""
    kind = n.rule.name
    if kind == "object":
        return {unescape(text_under(m.children[0], text)): json_python(m.children[1], text) for m in n.children}
    if kind == "array":
        return [json_python(c, text) for c in n.children]
    if kind == "string":
        return unescape(text_under(n, text))
    if kind == "number":
        word = text[n.start : n.end]
        return float(word) if any(c in word for c in ".eE") else int(word)
    return {"true": True, "false": False, "null": None}[text[n.start : n.end]]


def _shallow_json(depth: int) -> str:
    """JSON texts in ASCII of containers at most ``depth`` deep, without escapes, fractions or exponents, as a pattern."""
    ws, string = r"[ \t\r\n]*+", r'"[ !#-\[\]-~]*+"'
    value = rf"(?>{string}|(?!-0)-?(?>0|[1-9][0-9]{{0,14}}+)|true|false|null)"
    for _ in range(depth):
        member, comma = rf"{string}{ws}:{ws}{value}", f"{ws},{ws}"
        value = rf"(?>{value}|\{{{ws}(?:{member}(?:{comma}{member})*+)?+{ws}\}}|\[{ws}(?:{value}(?:{comma}{value})*+)?+{ws}\])"
    return rf"\A{ws}{value}{ws}\z"


def json_value(text: Column | str) -> Column:
    """The texts as variants; null where they are not JSON.

    Shallow texts that a pattern proves to be JSON go through the JVM's parser,
    which gives them the same value; it rejects equal keys, so those and all other
    texts go through the grammar.
    """
    c = F.col(text) if isinstance(text, str) else text
    known = F.when(c.rlike(_shallow_json(2)), F.try_parse_json(c))
    rest = F.when(known.isNull(), c)
    return F.coalesce(known, parsing.project(rest, json_document(), lambda r: json_python(r.nodes[0], r.parsed), "variant"))


def json_string() -> g.Rule:
    """A JSON string literal whose surrogate escapes must pair, with a message for each mistake."""
    hexs = lambda n: g.exactly(n, g.one_of(Ascii.HEX)).with_error("expected four hexadecimal digits")
    high = g.seq(g.one_of("dD"), g.one_of("89abAB"), g.exactly(2, g.one_of(Ascii.HEX)))
    low = g.seq(g.literal("\\u").with_error("expected a low surrogate"), g.seq(g.one_of("dD"), g.one_of("cdefCDEF"), g.exactly(2, g.one_of(Ascii.HEX))).with_error("expected a low surrogate"))
    lone = g.seq(g.one_of("dD"), g.one_of("cdefCDEF"))
    unicode_escape = g.seq(g.token("u"), g.choice(g.seq(high, low), g.seq(g.not_(g.seq(g.one_of("dD"), g.one_of("89abAB"))), g.not_(lone).with_error("lone low surrogate"), hexs(4))))
    simple = g.one_of('"\\/bfnrt')
    escape = g.seq(g.token("\\"), g.choice(unicode_escape, simple).with_error("unknown escape"))
    plain = g.scan_while(charset.UNIVERSE - TokenSet.range(0, 0x1F) - TokenSet.runes('"\\'))
    body = g.zero_or_more(g.choice(plain, escape))
    return g.seq(g.token('"').with_error("expected a string"), g.alias(body).as_("body"), g.not_(g.one_of(TokenSet.range(0, 0x1F))).with_error("control character in a string"), g.token('"').with_error("unterminated string"))


def json_string_value(text: Column | str) -> Column:
    def value(r: vm.Result) -> str:
        return unescape(r.parsed[1:-1])

    return parsing.project(text, json_string(), value, "string")


def string_literal(style: str) -> g.Rule:
    """The body of a string literal: "json", "python", "python_triple" or "raw"."""
    if style == "json":
        return g.seq(g.token('"'), g.scan_until('"', "\\", g.any_token()).as_("body"), g.token('"'))
    if style == "python":
        quote = lambda q, n: g.seq(g.token(q), g.scan_until(TokenSet.runes(q) | charset.LINE_ENDS, "\\", g.any_token()).as_(n), g.token(q))
        return g.choice(quote("'", "single"), quote('"', "double"))
    if style == "python_triple":
        return g.seq(g.literal('"""'), g.scan_until(g.literal('"""'), "\\", g.any_token()).as_("body"), g.literal('"""'))
    return g.seq(g.literal('r"'), g.scan_until('"').as_("body"), g.token('"'))


def arithmetic() -> g.Rule:
    """Sums and products with parentheses, left-associative; nodes: sum, product, number, op."""
    ws = g.optional(g.inline_whitespace()).delete()
    total = g.late_bound()
    number = g.seq(g.optional(g.token("-").preserve()), g.scan_while(Ascii.DIGITS)).as_("number")
    factor = g.seq(g.choice(number, g.seq(g.token("("), ws, total, ws, g.token(")").with_error("expected ')'"))), ws).with_error("expected a number")
    product = g.seq(factor, g.zero_or_more(g.seq(g.one_of("*/").as_("times"), ws, factor))).as_("product")
    total.bind(g.seq(product, g.zero_or_more(g.seq(g.one_of("+-").as_("plus"), ws, product))).as_("sum"))
    return g.seq(ws, total)


def arithmetic_python(n: vm.Node, text: str) -> int:
    kind = n.rule.name
    if kind == "number":
        return int(text_under(n, text))
    value = arithmetic_python(n.children[0], text)
    for op, right in zip(n.children[1::2], n.children[2::2], strict=True):
        x = arithmetic_python(right, text)
        sign = text[op.start]
        if sign in "+-":
            value = value + x if sign == "+" else value - x
        elif sign == "*":
            value *= x
        else:
            value = abs(value) // abs(x) * (1 if (value < 0) == (x < 0) else -1)  # towards zero
    return value


def arithmetic_value(text: Column | str) -> Column:
    """The values as longs; null where there is none."""
    return parsing.project(text, arithmetic(), lambda r: arithmetic_python(r.nodes[0], r.parsed), "long")


def setting() -> g.Rule:
    """``key = value;``"""
    ws = g.optional(g.inline_whitespace())
    return g.seq(ws, g.identifier().as_("key"), ws, g.token("="), ws, g.scan_until(";").as_("value"), g.token(";").with_error("expected ';'"), g.optional(g.any_whitespace()))


def comment(style: str) -> g.Rule:
    """A comment and its body: "block" (/* */), "line" (//), "hash" (#) or "xml" (<!-- -->)."""
    if style == "block":
        return g.seq(g.literal("/*"), g.scan_until(g.literal("*/")).as_("body"), g.literal("*/"))
    if style == "xml":
        return g.seq(g.literal("<!--"), g.scan_until(g.literal("-->")).as_("body"), g.literal("-->"))
    return g.seq(g.literal("//" if style == "line" else "#"), g.scan_until(charset.LINE_ENDS, eof_ends=True).as_("body"))


def _count(c: vm.Cursor, at: int) -> tuple[int, int] | None:
    """(the number at a place, the place after it and its line end)."""
    end = at
    if end < c.size and c.text[end] == "-":
        end += 1
    while end < c.size and c.text[end] in "0123456789":
        end += 1
    digits = c.text[at:end]
    if not digits.lstrip("-") or c.text[end : end + 2] != "\r\n":
        c.fail(end)
        return None
    return int(digits), end + 2


def counted_text() -> g.Rule:
    def match(c: vm.Cursor, at: int, inner: list) -> int | None:
        got = _count(c, at)
        if got is None or got[0] < 0:
            return None
        left, end = got
        while left > 0 and end < c.size:
            left -= 2 if ord(c.text[end]) > 0xFFFF else 1
            end += 1
        if left or not c.on_boundary(end):
            c.fail(end)
            return None
        return end

    return g.custom(match)


def counted_items(item: g.Rule) -> g.Rule:
    def match(c: vm.Cursor, at: int, inner: list) -> int | None:
        got = _count(c, at)
        if got is None or got[0] < 0:
            return None
        end = got[1]
        for _ in range(got[0]):
            end = inner[0](end)
            if end < 0:
                return None
        return end

    return g.custom(match, item)


def resp() -> g.Rule:
    """A RESP value: simple string, error, integer, bulk string or array."""
    value = g.late_bound()
    line = g.scan_until(g.token("\r\n"))
    end = g.token("\r\n")
    simple = g.seq(g.token("+"), line, end).as_("simple")
    error = g.seq(g.token("-"), g.scan_until(g.token("\r\n")), end).as_("error")
    number = g.seq(g.token(":"), g.seq(g.optional(g.one_of("+-")), g.scan_while(Ascii.DIGITS)), end).as_("integer")
    null = g.seq(g.one_of("$*").delete(), g.literal("-1\r\n")).as_("null")
    bulk = g.seq(g.token("$"), counted_text().as_("data"), end).as_("bulk")
    array = g.seq(g.token("*"), counted_items(value)).as_("array")
    value.bind(g.choice(simple, error, number, null, bulk, array))
    return g.seq(value)


def resp_python(n: vm.Node, text: str):
    kind = n.rule.name
    if kind == "null":
        return None
    if kind == "array":
        return [resp_python(c, text) for c in n.children]
    if kind == "bulk":
        data = n.children[0]
        return text[text.index("\r\n", data.start) + 2 : data.end]
    body = text_under(n, text)
    return int(body) if kind == "integer" else body


def resp_value(text: Column | str) -> Column:
    return parsing.project(text, resp(), lambda r: resp_python(r.nodes[0], r.parsed), "variant")

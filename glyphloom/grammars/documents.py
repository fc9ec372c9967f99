"""Nested documents: markup, style sheets, logic programs, TOML, BibTeX."""

from __future__ import annotations

from pyspark.sql import Column

from glyphloom.functions import parsing
from glyphloom.grammars.data import text_under
from glyphloom.operators import charset, vm
from glyphloom.operators import grammar as g
from glyphloom.operators.charset import Ascii, TokenSet

_WORD = Ascii.LETTERS | Ascii.DIGITS
_NAME = _WORD | TokenSet.runes("-_:.")


def _space() -> g.Rule:
    return g.zero_or_more(g.choice(g.token("\r\n"), g.one_of(" \t\n\r"))).delete()


def _gap() -> g.Rule:
    return g.one_or_more(g.choice(g.token("\r\n"), g.one_of(" \t\n\r"))).delete()


# -- markup
def markup(html: bool = False) -> g.Rule:
    """Elements, attributes, text, comments; tag names are not matched.  HTML adds void elements, bare attributes and a doctype."""
    element = g.late_bound()
    name = g.seq(g.one_of(Ascii.LETTERS | TokenSet.runes("_")), g.scan_while(_NAME, 0))
    quoted = g.choice(g.seq(g.token('"'), g.scan_until('"').as_("double"), g.token('"')), g.seq(g.token("'"), g.scan_until("'").as_("single"), g.token("'")))
    bare = g.scan_while(_WORD | TokenSet.runes("-_./#:%;,")).as_("bare")
    value = g.choice(quoted, bare) if html else quoted
    attribute = g.seq(g.alias(name).as_("key"), g.optional(g.seq(_space(), g.token("="), _space(), value)) if html else g.seq(_space(), g.token("="), _space(), value)).as_("attribute")
    attributes = g.zero_or_more(g.seq(_gap(), attribute))
    comment = g.seq(g.literal("<!--"), g.scan_until(g.literal("-->")), g.literal("-->")).as_("comment")
    text = g.scan_while(charset.UNIVERSE - TokenSet.runes("<")).as_("text")
    content = g.zero_or_more(g.choice(comment, element, text))
    tag = g.alias(name).as_("tag")
    closed = g.literal("/>")
    end = g.seq(g.literal("</"), g.seq(g.one_of(Ascii.LETTERS | TokenSet.runes("_")), g.scan_while(_NAME, 0)).delete(), _space(), g.token(">"))
    rest = g.choice(closed, g.seq(g.token(">"), content, end.with_error("expected an end tag")))
    if html:
        void = g.seq(g.choice(*[g.literal_ignore_ascii_case(v).preserve() for v in ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "wbr")]), g.not_(g.one_of(_NAME)))
        simple = g.seq(g.token("<"), void.as_("void"), g.zero_or_more(g.seq(_gap(), g.alias(attribute))), _space(), g.choice(g.literal("/>"), g.token(">")))
        element.bind(g.choice(simple, g.seq(g.token("<"), tag, attributes, _space(), rest).as_("element")))
        head = g.optional(g.seq(g.literal_ignore_ascii_case("<!doctype"), g.scan_until(">"), g.token(">"), _space()))
    else:
        element.bind(g.seq(g.token("<"), tag, attributes, _space(), rest).as_("element"))
        head = g.optional(g.seq(g.literal("<?xml"), g.scan_until(g.literal("?>")), g.literal("?>"), _space()))
    return g.seq(_space(), head, g.zero_or_more(g.seq(g.alias(comment), _space())), element, _space())


# -- style sheets
def css() -> g.Rule:
    """Rules of selectors and declarations, comments, and at-rules of one level; no recursion."""
    comment = lambda: g.seq(g.literal("/*"), g.scan_until(g.literal("*/")), g.literal("*/"))
    ws = lambda: g.zero_or_more(g.choice(g.token("\r\n"), g.one_of(" \t\n\r\f"), comment())).delete()
    ident = lambda: g.seq(g.optional(g.literal("--")), g.optional(g.token("-")), g.one_of(Ascii.LETTERS | TokenSet.runes("_") | TokenSet.range(0x80, 0x10FFFF)), g.scan_while(_WORD | TokenSet.runes("-_") | TokenSet.range(0x80, 0x10FFFF), 0))
    string = lambda q: g.seq(g.token(q), g.scan_until(TokenSet.runes(q) | charset.LINE_ENDS, "\\", g.any_token()), g.token(q))
    inner = lambda: g.zero_or_more(g.choice(string('"'), string("'"), g.none_of(TokenSet.runes("()\"'"))))
    value = lambda: g.one_or_more(g.choice(string('"'), string("'"), comment(), g.seq(g.token("("), inner(), g.token(")")), g.none_of(TokenSet.runes("()\"'{};"))))
    declaration = lambda: g.seq(ident(), ws(), g.token(":"), ws(), value())
    block = lambda: g.seq(g.token("{"), ws(), g.optional(g.seq(declaration(), g.zero_or_more(g.seq(g.token(";"), ws(), g.optional(declaration()))))), ws(), g.token("}"))
    selector = lambda: g.one_or_more(g.choice(string('"'), string("'"), g.none_of(TokenSet.runes("{};@\"'"))))
    ruleset = lambda: g.seq(selector(), block())
    prelude = lambda: g.zero_or_more(g.choice(string('"'), string("'"), g.none_of(TokenSet.runes("{};\"'"))))
    at_rule = g.seq(g.token("@"), ident(), prelude(), g.choice(g.token(";"), block(), g.seq(g.token("{"), ws(), g.zero_or_more(g.seq(ruleset(), ws())), g.token("}"))))
    return g.seq(ws(), g.zero_or_more(g.seq(g.choice(at_rule, ruleset()), ws())))


# -- logic programs
def prolog(htn: bool = False) -> g.Rule:
    """Facts, rules, lists and comments; the HTN dialect adds ``if``, ``do``, ``del`` and ``add`` clauses."""
    line = lambda: g.seq(g.token("%"), g.scan_until(charset.LINE_ENDS, eof_ends=True))
    block = lambda: g.seq(g.literal("/*"), g.scan_until(g.literal("*/")), g.literal("*/"))
    ws = lambda: g.zero_or_more(g.choice(g.token("\r\n"), g.one_of(" \t\n\r"), line(), block())).delete()
    term = g.late_bound()
    variable = g.seq(g.one_of(TokenSet.range("A", "Z") | TokenSet.runes("_?")), g.scan_while(_WORD | TokenSet.runes("_"), 0)).as_("variable")
    number = g.seq(g.optional(g.token("-").preserve()), g.scan_while(Ascii.DIGITS), g.optional(g.seq(g.token(".").preserve(), g.scan_while(Ascii.DIGITS)))).as_("number")
    quoted = g.seq(g.token("'"), g.scan_until("'", "\\", g.any_token()), g.token("'")).as_("quoted")
    string = g.seq(g.token('"'), g.scan_until('"', "\\", g.any_token()), g.token('"')).as_("string")
    atom = g.seq(g.one_of(TokenSet.range("a", "z")), g.scan_while(_WORD | TokenSet.runes("_-"), 0)).as_("atom")
    symbol = g.choice(*[g.literal(s).preserve() for s in ("=..", "\\==", "\\=", "=:=", "=\\=", "==", "=<", ">=", "->", "is", "=", "<", ">", "+", "-", "*", "/", "!")]).as_("symbol")
    comma = g.seq(ws(), g.token(","), ws())
    arguments = g.seq(g.token("("), ws(), g.optional(g.seq(term, g.zero_or_more(g.seq(comma, term)))), ws(), g.token(")").with_error("expected ')'"))
    lists = g.seq(g.token("["), ws(), g.optional(g.seq(term, g.zero_or_more(g.seq(comma, term)), g.optional(g.seq(ws(), g.token("|"), ws(), term)))), ws(), g.token("]").with_error("expected ']'")).as_("list")
    operand = g.choice(g.seq(g.choice(atom, quoted), g.optional(arguments)).as_("compound"), variable, number, string, lists, g.seq(g.token("("), ws(), term, ws(), g.token(")")), g.token("!").as_("cut"))
    term.bind(g.seq(g.optional(g.seq(g.literal("\\+"), ws())), operand, g.zero_or_more(g.seq(ws(), g.not_(g.literal("!")), symbol, ws(), operand))))
    goals = g.seq(term, g.zero_or_more(g.seq(g.choice(comma, g.seq(ws(), g.token(";"), ws())), term)))
    body = g.seq(ws(), g.literal(":-"), ws(), goals)
    if htn:
        part = lambda w: g.seq(g.literal(w), ws(), arguments)
        clause = g.seq(g.zero_or_more(g.seq(g.choice(g.literal("else"), g.literal("anyOf"), g.literal("allOf"), g.literal("hidden")), ws(), g.token(","), ws())), g.choice(*[part(w) for w in ("if", "do", "del", "add")]))
        body = g.choice(body, g.seq(ws(), g.literal(":-"), ws(), clause, g.zero_or_more(g.seq(comma, clause))))
    statement = g.seq(g.alias(operand).as_("head"), g.optional(body), ws(), g.token(".").with_error("expected '.'"), g.not_(g.one_of(Ascii.DIGITS))).as_("statement")
    query = g.seq(g.literal("?-"), ws(), goals, ws(), g.token(".")).as_("query")
    return g.seq(ws(), g.zero_or_more(g.seq(g.choice(query, statement), ws())))


# -- TOML
def toml() -> g.Rule:
    """A TOML 1.0 document; nodes: pair, table, tables, and values by type."""
    value = g.late_bound()
    blank = lambda: g.scan_while(" \t", 0).delete()
    end = lambda: g.choice(g.token("\r\n"), g.token("\n"))
    control = TokenSet.range(0, 8) | TokenSet.range(0x0A, 0x1F) | TokenSet.single(0x7F)
    comment = lambda: g.seq(g.token("#"), g.zero_or_more(g.none_of(control)).delete()).delete()
    spread = lambda: g.zero_or_more(g.choice(g.one_of(" \t"), end(), comment())).delete()
    hexs = lambda n: g.exactly(n, g.one_of(Ascii.HEX))
    escape = lambda: g.seq(g.token("\\").preserve(), g.choice(g.seq(g.token("u").preserve(), hexs(4)), g.seq(g.token("U").preserve(), hexs(8)), g.one_of('btnfr"\\'))).with_error("unknown escape")
    fold = lambda: g.seq(g.token("\\"), blank(), end(), g.zero_or_more(g.choice(g.one_of(" \t"), end()))).delete()
    basic = g.seq(g.token('"'), g.zero_or_more(g.choice(escape(), g.none_of(control | TokenSet.runes('"\\')))), g.token('"').with_error("unterminated string"))
    lit = g.seq(g.token("'"), g.zero_or_more(g.none_of(control | TokenSet.runes("'"))), g.token("'").with_error("unterminated string"))
    line_text = lambda stop: g.choice(g.token("\r\n").preserve(), g.token("\n").preserve(), g.none_of(control | TokenSet.runes(stop)))
    quotes = lambda q: g.seq(g.choice(g.seq(g.token(q).preserve(), g.token(q).preserve()), g.token(q).preserve()), g.not_(g.token(q)))
    closing = lambda q: g.seq(g.between(0, 2, g.seq(g.peek(g.literal(q * 4)), g.token(q).preserve())), g.literal(q * 3))
    multi = g.seq(g.literal('"""'), g.optional(end()), g.zero_or_more(g.choice(fold(), escape(), line_text('"\\'), quotes('"'))), closing('"').with_error("unterminated string"))
    multi_lit = g.seq(g.literal("'''"), g.optional(end()), g.zero_or_more(g.choice(line_text("'"), quotes("'"))), closing("'").with_error("unterminated string"))
    string = g.choice(multi.as_("multi"), multi_lit.as_("multi_literal"), g.alias(basic).as_("basic"), g.alias(lit).as_("literal"))
    d = lambda n: g.exactly(n, g.one_of(Ascii.DIGITS))
    p = lambda c: g.token(c).preserve()
    date = lambda: g.seq(d(4), p("-"), d(2), p("-"), d(2))
    time = lambda: g.seq(d(2), p(":"), d(2), p(":"), d(2), g.optional(g.seq(p("."), g.scan_while(Ascii.DIGITS))))
    offset = g.choice(g.one_of("Zz"), g.seq(g.one_of("+-"), d(2), p(":"), d(2)))
    when = g.choice(
        g.seq(date(), g.one_of("Tt "), time(), offset).as_("offset_datetime"), g.seq(date(), g.one_of("Tt "), time()).as_("local_datetime"), g.seq(date()).as_("local_date"), g.seq(time()).as_("local_time")
    )
    run = lambda s: g.seq(g.one_of(s), g.zero_or_more(g.seq(g.optional(p("_")), g.one_of(s))))
    whole = lambda: g.seq(g.optional(g.one_of("+-")), g.choice(g.seq(p("0"), g.not_(g.one_of(Ascii.DIGITS | TokenSet.runes("_")))), g.seq(g.not_(p("0")), run(Ascii.DIGITS))))
    exponent = lambda: g.seq(g.one_of("eE"), g.optional(g.one_of("+-")), run(Ascii.DIGITS))
    floating = g.choice(
        g.seq(whole(), g.choice(g.seq(p("."), run(Ascii.DIGITS), g.optional(exponent())), exponent())), g.seq(g.optional(g.one_of("+-")), g.choice(g.literal("inf").preserve(), g.literal("nan").preserve()))
    ).as_("float")
    based = g.choice(g.seq(g.literal("0x").preserve(), run(Ascii.HEX)), g.seq(g.literal("0o").preserve(), run(TokenSet.range("0", "7"))), g.seq(g.literal("0b").preserve(), run(TokenSet.runes("01"))))
    number = g.choice(based, whole()).as_("integer")
    boolean = g.choice(g.literal("true").preserve(), g.literal("false").preserve()).as_("boolean")
    comma = g.seq(spread(), g.token(","), spread())
    array = g.seq(g.token("["), spread(), g.optional(g.seq(value, g.zero_or_more(g.seq(comma, value)), g.optional(comma))), spread(), g.token("]").with_error("expected ']'")).as_("array")
    simple_key = g.choice(g.scan_while(_WORD | TokenSet.runes("-_")).as_("bare"), g.seq(basic).as_("basic_key"), g.seq(lit).as_("literal_key"))
    key = g.seq(simple_key, g.zero_or_more(g.seq(blank(), g.token("."), blank(), simple_key))).as_("key")
    pair = g.seq(key, blank(), g.token("=").with_error("expected '='"), blank(), value).as_("pair")
    inline = g.seq(g.token("{"), blank(), g.optional(g.seq(pair, g.zero_or_more(g.seq(blank(), g.token(","), blank(), pair)))), blank(), g.token("}").with_error("expected '}'")).as_("inline")
    value.bind(g.choice(string, boolean, when, floating, number, array, inline).with_error("expected a value"))
    tables = g.seq(g.literal("[["), blank(), g.alias(key).as_("tables_key"), blank(), g.literal("]]")).as_("tables")
    table = g.seq(g.token("["), blank(), g.alias(key).as_("table_key"), blank(), g.token("]").with_error("expected ']'")).as_("table")
    line = g.seq(blank(), g.optional(g.choice(tables, table, pair)), blank(), g.optional(comment()))
    return g.seq(line, g.zero_or_more(g.seq(end(), line)))


def _toml_unescape(text: str) -> str:
    simple = {"b": "\b", "t": "\t", "n": "\n", "f": "\f", "r": "\r", '"': '"', "\\": "\\"}
    out, k = [], 0
    while k < len(text):
        if text[k] != "\\":
            out.append(text[k])
            k += 1
        elif text[k + 1] in "uU":
            n = 4 if text[k + 1] == "u" else 8
            out.append(chr(int(text[k + 2 : k + 2 + n], 16)))
            k += 2 + n
        else:
            out.append(simple[text[k + 1]])
            k += 2
    return "".join(out)


def _toml_leaf(n: vm.Node, text: str):
    kind, body = n.rule.name, text_under(n, text)
    if kind in ("basic", "multi", "basic_key"):
        return _toml_unescape(body)
    if kind == "boolean":
        return body == "true"
    if kind == "integer":
        return int(body.replace("_", ""), 0) if body[:2] in ("0x", "0o", "0b") else int(body.replace("_", ""))
    if kind == "float":
        f = float(body.replace("_", ""))
        return f if abs(f) != float("inf") and f == f else body  # variants have no such numbers
    return body


def _toml_value(n: vm.Node, text: str):
    kind = n.rule.name
    if kind == "array":
        return [_toml_value(c, text) for c in n.children]
    if kind == "inline":
        out: dict = {}
        for pair in n.children:
            _toml_set(out, [_toml_leaf(k, text) for k in pair.children[0].children], _toml_value(pair.children[1], text))
        return out
    return _toml_leaf(n, text)


def _toml_set(at: dict, keys: list[str], value) -> None:
    for k in keys[:-1]:
        at = at.setdefault(k, {})
        at = at[-1] if isinstance(at, list) else at
        if not isinstance(at, dict):
            raise ValueError(f"{k} is not a table")
    if keys[-1] in at:
        raise ValueError(f"{keys[-1]} is defined twice")
    at[keys[-1]] = value


def toml_python(nodes: list[vm.Node], text: str) -> dict:
    """The document as nested dicts and lists; a key defined twice is an error."""
    root: dict = {}
    here, opened = root, set()
    for n in nodes:
        if n.rule.name == "pair":
            _toml_set(here, [_toml_leaf(k, text) for k in n.children[0].children], _toml_value(n.children[1], text))
            continue
        keys = [_toml_leaf(k, text) for k in n.children[0].children]
        here = root
        for k in keys[:-1]:
            here = here.setdefault(k, {})
            here = here[-1] if isinstance(here, list) else here
            if not isinstance(here, dict):
                raise ValueError(f"{k} is not a table")
        if n.rule.name == "tables":
            rows = here.setdefault(keys[-1], [])
            if not isinstance(rows, list):
                raise ValueError(f"{keys[-1]} is not an array of tables")
            rows.append({})
            here = rows[-1]
        else:
            path = tuple(keys)
            if path in opened or not isinstance(here.get(keys[-1], {}), dict):
                raise ValueError(f"{keys[-1]} is defined twice")
            opened.add(path)
            here = here.setdefault(keys[-1], {})
    return root


def toml_value(text: Column | str) -> Column:
    """The documents as variants; null where they are not TOML."""
    return parsing.project(text, toml(), lambda r: toml_python(r.nodes, r.parsed), "variant")


# -- BibTeX
def bibtex() -> g.Rule:
    """Entries with fields, macros, comments and nested braces; nodes: entry(type, citation, field), macro."""
    ws = lambda: g.zero_or_more(g.choice(g.token("\r\n"), g.one_of(" \t\n\r"))).delete()
    braces = g.late_bound()
    inner = g.zero_or_more(g.choice(braces, g.scan_while(charset.UNIVERSE - TokenSet.runes("{}"))))
    braces.bind(g.seq(g.token("{").preserve(), inner, g.token("}").preserve().with_error("expected '}'")))
    braced = g.seq(g.token("{"), inner, g.token("}").with_error("expected '}'")).as_("braced")
    quoted = g.seq(g.token('"'), g.zero_or_more(g.choice(braces, g.scan_while(charset.UNIVERSE - TokenSet.runes('{}"')))), g.token('"').with_error("unterminated string")).as_("quoted")
    number = g.scan_while(Ascii.DIGITS).as_("number")
    word = charset.UNIVERSE - charset.any_space() - TokenSet.runes("{}(),=\"#%'") - TokenSet.range(0, 0x20)
    macro_name = g.scan_while(word).as_("macro_name")
    piece = g.choice(braced, quoted, number, macro_name)
    value = g.seq(piece, g.zero_or_more(g.seq(ws(), g.token("#"), ws(), piece))).as_("value")
    field = g.seq(g.scan_while(word).as_("field_name"), ws(), g.token("=").with_error("expected '='"), ws(), value).as_("field")
    fields = g.seq(g.zero_or_more(g.seq(g.token(","), ws(), field, ws())), g.optional(g.token(",")), ws())
    either = lambda body: g.choice(g.seq(g.token("{"), body, g.token("}").with_error("expected '}'")), g.seq(g.token("("), body, g.token(")")))
    kind = lambda w: g.seq(g.literal_ignore_ascii_case(w), ws())
    macro = g.seq(kind("string"), either(g.seq(ws(), field, ws(), g.optional(g.token(",")), ws()))).as_("macro")
    preamble = g.seq(kind("preamble"), either(g.seq(ws(), value, ws()))).as_("preamble")
    comment = g.seq(kind("comment"), g.optional(braces)).delete()
    entry = g.seq(g.scan_while(Ascii.LETTERS).as_("type"), ws(), either(g.seq(ws(), g.scan_while(word | TokenSet.runes("'")).as_("citation"), ws(), fields))).as_("entry")
    junk = g.scan_while(charset.UNIVERSE - TokenSet.runes("@")).delete()
    return g.zero_or_more(g.choice(junk, g.seq(g.token("@"), ws(), g.choice(macro, preamble, comment, entry))))


# The month macros every style defines.
_MONTHS = {"jan": "January", "feb": "February", "mar": "March", "apr": "April", "may": "May", "jun": "June", "jul": "July", "aug": "August", "sep": "September", "oct": "October", "nov": "November", "dec": "December"}


def bibtex_python(nodes: list[vm.Node], text: str) -> list[dict]:
    """Entries with macros expanded; field names and types in lower case, the first of equal names wins."""
    macros = dict(_MONTHS)

    def expand(value: vm.Node) -> str:
        return "".join(macros.get(text_under(p, text).lower(), "") if p.rule.name == "macro_name" else text_under(p, text) for p in value.children)

    out = []
    for n in nodes:
        if n.rule.name == "macro":
            name, value = n.children[0].children
            macros[text_under(name, text).lower()] = expand(value)
        elif n.rule.name == "entry":
            kind, citation, *fields = n.children
            row: dict[str, str] = {}
            for f in fields:
                row.setdefault(text_under(f.children[0], text).lower(), " ".join(expand(f.children[1]).split()))
            out.append({"type": text_under(kind, text).lower(), "key": text_under(citation, text), "fields": row})
    return out


def bibtex_value(text: Column | str) -> Column:
    return parsing.project(text, bibtex(), lambda r: bibtex_python(r.nodes, r.parsed), "variant")

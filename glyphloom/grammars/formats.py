"""Line formats: versions, schedules, requirements, filters, commits, numbers, chords, markers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphloom.functions import parsing
from glyphloom.operators import charset, vm
from glyphloom.operators import grammar as g
from glyphloom.operators.charset import Ascii, TokenSet

_WORD = Ascii.LETTERS | Ascii.DIGITS
_LOWER = TokenSet.range("a", "z")


def _space() -> g.Rule:
    return g.scan_while(" \t", 0).delete()


def separated(item: g.Rule, by: g.Rule) -> g.Rule:
    """One or more items with a separator between them."""
    return g.seq(item, g.zero_or_more(g.seq(by, item)))


# -- semantic versions
def no_leading_zero() -> g.Rule:
    return g.choice(g.seq(g.token("0").preserve(), g.not_(g.one_of(Ascii.DIGITS))), g.seq(g.one_of("123456789"), g.scan_while(Ascii.DIGITS, 0)))


def semver() -> g.Rule:
    """Semantic Versioning 2.0.0; nodes: major, minor, patch, pre, build."""
    ident = _WORD | TokenSet.runes("-")
    numeric = g.seq(no_leading_zero(), g.not_(g.one_of(ident)))
    other = g.seq(g.scan_while(Ascii.DIGITS, 0), g.one_of(Ascii.LETTERS | TokenSet.runes("-")), g.scan_while(ident, 0))
    pre = separated(g.choice(numeric, other).with_error("a pre-release part has a leading zero or is empty"), g.token(".").preserve()).as_("pre")
    build = separated(g.scan_while(ident), g.token(".").preserve()).as_("build")
    n = lambda name: g.seq(no_leading_zero()).as_(name)
    return g.seq(n("major"), g.token("."), n("minor"), g.token("."), n("patch"), g.optional(g.seq(g.token("-"), pre)), g.optional(g.seq(g.token("+"), build)))


def semver_value(text: Column | str) -> Column:
    """struct<major,minor,patch,pre,build>; null if it is no version or a number is beyond 32 bits."""
    e = parsing.extract(text, semver())
    number = lambda n: e[n].try_cast("int")
    parts = lambda n: F.when(e[n].isNull(), F.array().cast("array<string>")).otherwise(F.split(e[n], r"\."))
    v = F.struct(number("major").alias("major"), number("minor").alias("minor"), number("patch").alias("patch"), parts("pre").alias("pre"), parts("build").alias("build"))
    return F.when(e.isNotNull() & v["major"].isNotNull() & v["minor"].isNotNull() & v["patch"].isNotNull(), v)


# -- schedules
CRON = ("minute", "hour", "dom", "month", "dow")
CRON_BOUNDS = {"minute": (0, 59), "hour": (0, 23), "dom": (1, 31), "month": (1, 12), "dow": (0, 7)}


def cron_field(name: str) -> g.Rule:
    number = lambda: g.scan_while(Ascii.DIGITS)
    step = g.optional(g.seq(g.token("/").preserve(), number()))
    item = g.choice(g.seq(g.token("*").preserve(), step), g.seq(number(), g.optional(g.seq(g.token("-").preserve(), number(), step))))
    return separated(item, g.token(",").preserve()).as_(name)


def cron() -> g.Rule:
    """Five fields of lists of *, n, n-m, with /step."""
    gap = lambda: g.scan_while(" \t").delete()
    f = [cron_field(n) for n in CRON]
    return g.seq(_space(), f[0], *[x for field in f[1:] for x in (gap(), field)], _space())


def cron_value(text: Column | str) -> Column:
    """struct of the items of each field; null if malformed or a number is out of its field's range."""
    e = parsing.extract(text, cron(), CRON)
    fields, ok = [], e.isNotNull()
    for name in CRON:
        items = F.split(e[name], ",")
        fields.append(items.alias(name))
        ok = ok & F.forall(items, _cron_check(*CRON_BOUNDS[name]))
    return F.when(ok, F.struct(*fields))


def cron_problem(text: Column | str) -> Column:
    """struct<char_index:int,message:string> of the first thing wrong with a schedule, by its place; null for good ones.

    A malformed schedule has the parse's diagnostic; of a well-formed one each
    number out of its field's range, falling range and step below 1 is a problem.
    Good schedules are found in the JVM; only the others are parsed.
    """
    c = F.col(text) if isinstance(text, str) else text
    kind = pa.struct([("char_index", pa.int32()), ("message", pa.string())])

    def row(program: vm.Program, t: str, options: vm.Options) -> dict | None:
        r = vm.parse(program, t, options)
        if not r.success:
            return {"char_index": r.position.char_index, "message": r.message}
        found = [fault for n in r.nodes if n.rule.name in CRON for fault in cron_faults(n.rule.name, r.parsed[n.start : n.end], n.start)]
        return dict(zip(("char_index", "message"), min(found, key=lambda f: f[0]), strict=True)) if found else None

    return parsing.by_machine(F.when(cron_value(c).isNull(), c), cron().compile(), row, kind, "struct<char_index:int,message:string>")


def cron_faults(name: str, field: str, at: int) -> Iterator[tuple[int, str]]:
    """(place, what is wrong) of the items of a field that begins at a place, from left to right."""
    low, high = CRON_BOUNDS[name]
    for item in field.split(","):
        span, _, step = item.partition("/")
        first, _, last = span.partition("-")
        wrong = False
        for k, number in ((0, first), (len(first) + 1, last)):
            if number not in ("", "*") and not low <= int(number) <= high:
                wrong = True
                yield at + k, f"{name} field value '{number}' is out of range ({low}-{high})"
        if last and not wrong and int(first) > int(last):
            yield at, f"{name} field range '{span}' is descending; the start must not be greater than the end"
        if "/" in item and int(step) < 1:
            yield at + len(span) + 1, f"{name} field step '{step}' must be 1 or greater"
        at += len(item) + 1


def _cron_check(low: int, high: int):
    """Whether an item's numbers are in range, its range does not fall and its step is 1 or more."""

    def inside(x: Column) -> Column:
        return F.coalesce(x.between(low, high), F.lit(False))

    def check(item: Column) -> Column:
        n = F.transform(F.regexp_extract_all(F.split_part(item, F.lit("/"), F.lit(1)), F.lit("([0-9]+)"), F.lit(1)), lambda x: x.try_cast("int"))
        step = ~F.contains(item, F.lit("/")) | F.coalesce(F.split_part(item, F.lit("/"), F.lit(2)).try_cast("int") >= 1, F.lit(False))
        return F.forall(n, inside) & F.coalesce(F.get(n, F.lit(0)) <= F.get(n, F.lit(1)), F.lit(True)) & step

    return check


# -- requirements
def requirement() -> g.Rule:
    """A Python requirement; nodes: name, extras, constraints, url, marker."""
    ws = _space
    name_end = _WORD
    name = g.seq(g.one_of(_WORD), g.zero_or_more(g.choice(g.scan_while(name_end), g.seq(g.scan_while("-_."), g.peek(g.one_of(name_end))))))
    ident = lambda: g.seq(g.one_of(_WORD), g.zero_or_more(g.choice(g.scan_while(name_end), g.seq(g.scan_while("-_."), g.peek(g.one_of(name_end))))))
    extras = g.seq(g.token("["), ws(), g.optional(separated(ident(), g.seq(ws(), g.token(",").preserve(), ws()))).as_("extras"), ws(), g.token("]").with_error("expected ']'"))
    op = g.choice(*[g.literal(o).preserve() for o in ("===", "~=", "==", "!=", "<=", ">=", "<", ">")]).with_error("expected a version operator")
    version = g.scan_while(_WORD | TokenSet.runes("-_.*+!")).with_error("expected a version")
    constraints = lambda: separated(g.seq(op, ws(), version), g.seq(ws(), g.token(",").preserve(), ws()))
    listed = constraints().as_("constraints")
    tail = g.choice(
        g.seq(g.token("@"), ws(), g.scan_while(charset.UNIVERSE - charset.any_space()).as_("url")),
        g.seq(g.optional(g.token("(")), ws(), listed, ws(), g.optional(g.token(")"))),
    )
    marker = g.seq(g.token(";"), ws(), g.scan_until_eof().as_("marker"))
    return g.seq(ws(), name.as_("name").with_error("expected a package name"), ws(), g.optional(g.seq(extras, ws())), g.optional(g.seq(tail, ws())), g.optional(marker))


def requirement_value(text: Column | str) -> Column:
    e = parsing.extract(text, requirement())
    some = lambda c, how: F.when(c.isNull(), F.array().cast("array<string>")).otherwise(how(c))
    return F.when(
        e.isNotNull(),
        F.struct(
            e["name"].alias("name"),
            some(e["extras"], lambda c: F.split(c, r"[ \t]*,[ \t]*")).alias("extras"),
            some(e["constraints"], lambda c: F.regexp_extract_all(c, F.lit("([~=!<>]+)"), F.lit(1))).alias("operators"),
            some(e["constraints"], lambda c: F.regexp_extract_all(c, F.lit("[~=!<>]+[ \t]*([^, \t]+)"), F.lit(1))).alias("versions"),
            e["url"].alias("url"),
        ),
    )


# -- filters
FILTER_OPS = ("==", "=~", "!~", "!=", "!#", "<=", ">=", "=", "<", ">", "#", "between")


def filter_expression() -> g.Rule:
    """``attribute op value`` with and, or and parentheses; nodes: comparison(attribute, op, value), and, or."""
    ws = lambda: g.zero_or_more(g.one_of(" \t\n\r")).delete()
    expr = g.late_bound()
    attribute = g.seq(g.one_of(Ascii.LETTERS | TokenSet.runes("_")), g.scan_while(_WORD | TokenSet.runes("_-"), 0)).as_("attribute")
    op = g.choice(*[g.literal(o).preserve() for o in FILTER_OPS]).as_("op").with_error("expected a comparison operator")
    number = g.seq(g.optional(g.token("-").preserve()), g.scan_while(Ascii.DIGITS))
    span = g.seq(number, g.token(":").preserve(), g.seq(g.optional(g.token("-").preserve()), g.scan_while(Ascii.DIGITS))).as_("range")
    string = g.seq(g.token('"'), g.scan_until('"', "\\", g.any_token()), g.token('"')).as_("string")
    plain = g.seq(g.optional(g.token("-").preserve()), g.scan_while(Ascii.DIGITS)).as_("number")
    value = g.choice(string, span, plain).with_error("expected a value")
    comparison = g.seq(attribute, ws(), op, ws(), value).as_("comparison")
    group = g.seq(g.token("("), ws(), expr, ws(), g.token(")").with_error("expected ')'"))
    term = g.choice(group, comparison)
    word = lambda w: g.seq(ws(), g.literal(w).preserve().as_(w), g.peek(g.choice(g.one_of(" \t\n\r("), g.eof())), ws())
    expr.bind(g.seq(term, g.optional(g.seq(g.choice(word("and"), word("or")), expr))).as_("expression"))
    return g.seq(ws(), expr, ws())


def filter_ast(n: vm.Node, text: str):
    """[op, attribute, value] or ["and" | "or", left, right], right-associative."""
    from glyphloom.grammars.data import text_under

    if n.rule.name == "comparison":
        a, op, value = n.children
        kind = value.rule.name
        body = text_under(value, text)
        return [text_under(op, text), text_under(a, text), int(body) if kind == "number" else body]
    parts = n.children
    if len(parts) == 1:
        return filter_ast(parts[0], text)
    return [parts[1].rule.name, filter_ast(parts[0], text), filter_ast(parts[2], text)]


def filter_value(text: Column | str) -> Column:
    return parsing.project(text, filter_expression(), lambda r: filter_ast(r.nodes[0], r.parsed), "variant")


def filter_column(expression: str, columns: dict[str, Column]) -> Column:
    """A filter expression as a Spark predicate over the named columns."""
    r = vm.parse(vm.Program(filter_expression()), expression)
    if not r.success:
        raise ValueError(r.message)

    def build(a) -> Column:
        if a[0] in ("and", "or"):
            left, right = build(a[1]), build(a[2])
            return left & right if a[0] == "and" else left | right
        op, name, value = a
        c = columns[name]
        if op in ("=~", "!~"):
            return c.rlike(value) if op == "=~" else ~c.rlike(value)
        if op in ("#", "!#"):
            inside = F.array_contains(F.split(c.cast("string"), r"\s+"), str(value))
            return inside if op == "#" else ~inside
        if op == "between":
            low, high = map(int, str(value).split(":"))
            return c.between(min(low, high), max(low, high))
        return {"=": c == value, "==": c == value, "!=": c != value, "<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}[op]

    return build(filter_ast(r.nodes[0], r.parsed))


# -- commits
def conventional_commit() -> g.Rule:
    """The header of a conventional commit; nodes: type, scope, bang, subject."""
    return g.seq(
        g.scan_while(_WORD | TokenSet.runes("_-")).as_("type"), g.optional(g.seq(g.token("("), g.scan_until(")").as_("scope"), g.token(")"))), g.optional(g.token("!").as_("bang")), g.token(":"), _space(),
        g.scan_while(charset.UNIVERSE - charset.LINE_ENDS).as_("subject"), g.scan_until_eof().delete(),
    )


def commit_value(text: Column | str) -> Column:
    e, c = parsing.extract(text, conventional_commit()), F.col(text) if isinstance(text, str) else text
    footer = c.rlike(r"(?m)^BREAKING[ -]CHANGE:")
    issues = F.regexp_extract_all(e["subject"], F.lit("#([0-9]+)"), F.lit(1))
    return F.when(e.isNotNull(), F.struct(e["type"].alias("type"), e["scope"].alias("scope"), e["subject"].alias("subject"), (e["bang"].isNotNull() | footer).alias("breaking"), issues.alias("issues")))


# -- numbers in Korean
# Sino-Korean digits, small and large units, and native counts: fixed values of the language.
KOREAN_DIGITS = {"영": 0, "공": 0, "일": 1, "이": 2, "삼": 3, "사": 4, "오": 5, "육": 6, "칠": 7, "팔": 8, "구": 9}
KOREAN_SMALL = {"십": 10, "백": 100, "천": 1000}
KOREAN_LARGE = {"만": 10**4, "억": 10**8, "조": 10**12}
KOREAN_COUNTS = {"하나": 1, "한": 1, "둘": 2, "두": 2, "셋": 3, "세": 3, "넷": 4, "네": 4, "다섯": 5, "여섯": 6, "일곱": 7, "여덟": 8, "아홉": 9}
KOREAN_TENS = {"열": 10, "스물": 20, "스무": 20, "서른": 30, "마흔": 40, "쉰": 50, "예순": 60, "일흔": 70, "여든": 80, "아흔": 90}


def korean_number(money: bool = False) -> g.Rule:
    """Digits and units in groups of ten thousand, each group and unit at most once and falling."""
    digit = g.choice(g.scan_while(Ascii.DIGITS), g.one_of("".join(KOREAN_DIGITS)))
    small = [g.seq(g.optional(digit), g.token(u).preserve()) for u in "천백십"]
    group = lambda: g.seq(*[g.optional(s) for s in small], g.optional(digit))
    parts = [g.optional(g.seq(group(), g.token(u).preserve())) for u in "조억만"]
    whole = g.seq(g.peek(g.any_token()), *parts, group())
    return g.seq(whole.as_("number"), *([g.literal("원")] if money else []))


def korean_python(text: str) -> int:
    total = part = digit = 0
    pending = False
    k = 0
    while k < len(text):
        c = text[k]
        if c.isdigit() and c.isascii():
            end = k
            while end < len(text) and text[end].isdigit():
                end += 1
            digit, pending, k = int(text[k:end]), True, end
            continue
        if c in KOREAN_DIGITS:
            digit, pending = KOREAN_DIGITS[c], True
        elif c in KOREAN_SMALL:
            part, digit, pending = part + (digit if pending else 1) * KOREAN_SMALL[c], 0, False
        else:
            part += digit
            total, part, digit, pending = total + (part if part or pending else 1) * KOREAN_LARGE[c], 0, 0, False
        k += 1
    return total + part + digit


def korean_value(text: Column | str, money: bool = False) -> Column:
    return parsing.project(text, korean_number(money), lambda r: korean_python(r.parsed.removesuffix("원")), "long")


def korean_count() -> g.Rule:
    longest = lambda d: g.choice(*[g.literal(w).preserve() for w in sorted(d, key=len, reverse=True)])
    return g.choice(g.seq(longest(KOREAN_TENS).as_("ten"), g.optional(longest(KOREAN_COUNTS).as_("one"))), longest(KOREAN_COUNTS).as_("single"))


def korean_count_value(text: Column | str) -> Column:
    names = KOREAN_COUNTS | KOREAN_TENS
    return parsing.project(text, korean_count(), lambda r: sum(names[r.parsed[n.start : n.end]] for n in r.nodes), "int")


# -- chords and markers
def chord() -> g.Rule:
    """A chord name: root, accidental, quality, extension, second quality, additions, slash bass."""
    accidental = lambda: g.one_of("#b♯♭x")
    lit = lambda *words: g.choice(*[g.literal(w) for w in words])
    quality = lit("maj", "min", "dim", "aug", "sus2", "sus4", "sus", "m", "M", "°", "o", "+", "ø", "Δ", "5")
    extension = lit("13", "11", "6", "7", "9")
    second = lit("maj", "M", "Δ", "°", "ø", "+")
    addition = g.choice(
        g.seq(g.literal("add"), lit("11", "13", "2", "4", "6", "9")), lit("b5", "#5", "b9", "#9", "#11", "b13"), g.seq(g.literal("no"), lit("3", "5", "7")), lit("sus2", "sus4", "sus"), g.literal("alt")
    )
    root_accidental = g.zero_or_more(g.seq(g.not_(lit("b5", "#5", "b9", "#9", "#11", "b13")), accidental()))
    bass = g.seq(g.token("/"), g.one_of("ABCDEFGabcdefg"), g.optional(accidental()))
    return g.seq(g.one_of("ABCDEFGabcdefg"), root_accidental, g.optional(g.seq(g.not_(g.choice(lit("5", "sus"), g.literal("add"))), quality)), g.optional(g.literal("5")), g.optional(extension), g.optional(second), g.zero_or_more(addition), g.optional(bass))


def block_marker(kind: str) -> g.Rule:
    """Lines of a light markup: "h1", "h2", "bullet" or "rule"."""
    rest = g.scan_until_eof()
    if kind == "h1":
        return g.seq(g.token("#"), g.not_(g.token("#")), rest)
    if kind == "h2":
        return g.seq(g.literal("##"), g.not_(g.token("#")), rest)
    if kind == "bullet":
        return g.seq(g.one_of("-*+"), g.one_of(" \t"), rest)
    return g.choice(*[g.seq(g.at_least(3, g.token(c)), g.eof()) for c in "-*+"])


def any_order(*items: g.Rule) -> g.Rule:
    """Each item exactly once, in any order: each round takes the first item left that matches."""

    def match(c: vm.Cursor, at: int, inner: list) -> int | None:
        left = list(inner)
        while left:
            for k, step in enumerate(left):
                if (end := step(at)) >= 0:
                    at = end
                    del left[k]
                    break
            else:
                return None
        return at

    return g.custom(match, *items)


def lookbehind(inner: g.Rule) -> g.Rule:
    """Consumes nothing; the inner rule must match some stretch that ends here."""

    def match(c: vm.Cursor, at: int, steps: list) -> int | None:
        saved = c.failures()
        found = any(c.on_boundary(start) and steps[0](start) == at for start in range(at, -1, -1))
        c.restore(saved)
        return at if found else None

    return g.custom(match, inner).shape(g.DELETE)


def box() -> g.Rule:
    """width, height and depth, each once, in any order."""
    attribute = lambda n: g.seq(g.optional(g.inline_whitespace()), g.literal(n), g.token("="), g.scan_while(Ascii.DIGITS).as_(n)).with_error(f"expected the '{n}' attribute")
    return g.seq(any_order(attribute("width"), attribute("height"), attribute("depth")).with_error("expected width, height and depth, each exactly once"), g.optional(g.inline_whitespace()), g.eof())


# -- screens and profiles
def screen(kind: str) -> g.Rule:
    """A search rule for text that needs a second look."""
    if kind == "bidi":
        return g.one_of(TokenSet.ranges((0x202A, 0x202E), (0x2066, 0x2069)) | TokenSet.single(0x061C) | TokenSet.ranges((0x200E, 0x200F)))
    if kind == "invisible":
        return g.one_of(TokenSet.ranges((0x200B, 0x200D), (0x2060, 0x2064)) | TokenSet.single(0xFEFF) | TokenSet.single(0xAD))
    if kind == "replacement":
        return g.one_of(charset.REPLACEMENT)
    if kind == "control":
        return g.one_of(TokenSet.category("Cc") - Ascii.SPACE)
    if kind == "non_ascii_digit":
        return g.one_of(charset.digits() - Ascii.DIGITS)
    raise g.GrammarError(f"no such screen: {kind}")


def is_suspicious(text: Column | str) -> Column:
    """A struct of flags, one for each screen, and lookalikes that compatibility normalization would change."""
    from glyphloom.functions.text import is_normalized

    c = F.col(text) if isinstance(text, str) else text
    kinds = ("bidi", "invisible", "replacement", "control", "non_ascii_digit")
    # single code points: plain classes, as marks and joiners are what is looked for
    flags = [c.rlike(screen(k).args["set"].java_class()).alias(k) for k in kinds]
    marks = F.regexp_count(c, F.lit(r"\p{Mn}{3,}+")) > 0
    return F.struct(*flags, marks.alias("stacked_marks"), (~is_normalized(c, "NFKC")).alias("compatibility"))


def identifier_profile(language: str) -> g.Rule:
    """Identifiers of "python", "rust" or "ecmascript"."""
    if language == "python":
        return g.identifier("_", "")
    if language == "rust":
        return g.choice(g.seq(g.token("_").preserve(), g.scan_while(charset.xid_continue())), g.seq(g.not_(g.seq(g.token("_"), g.eof())), g.identifier("_", "")))
    return g.identifier("$_", TokenSet.ranges((0x200C, 0x200D)))

"""Columns from grammars: accept, extract, search and parse.

``matches``, ``extract`` and the search functions are JVM expressions if the
grammar can be lowered, and run the parsing machine in Arrow batches if not;
``parse`` always does.  ``plan`` says which.

A parse is one of the text in the grammar's normalization form, in both tiers.
Texts whose code points are all tokens in NFC (``text.is_simple``) are matched as
they are by the plain pattern, others are normalized and matched by whole
clusters.  ``normalize=False`` matches texts as they are; the column is then
deterministic whatever the grammar (see ``text.normalize``).  Searches read texts
as they are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.functions.text import is_plain, is_simple, normalize as normalized
from glyphloom.operators import vm
from glyphloom.operators.grammar import Rule
from glyphloom.operators.regexgen import NotLowerable, ascii_only, exact, lower, prefix

POSITION = "struct<char_index:int,token_index:int,line:int,char_column:int,token_column:int>"
NODE = "struct<node_id:int,parent_id:int,subtree_end:int,depth:int,ordinal:int,symbol_id:int,name:string,flatten:string,is_leaf:boolean,start:int,end:int,text:string>"
RESULT = f"struct<outcome:string,error_message:string,error:{POSITION},parse_input:string,nodes:array<{NODE}>>"

_POSITION = pa.struct([(n, pa.int32()) for n in ("char_index", "token_index", "line", "char_column", "token_column")])
_NODE = pa.struct(
    [*((n, pa.int32()) for n in ("node_id", "parent_id", "subtree_end", "depth", "ordinal", "symbol_id")), ("name", pa.string()), ("flatten", pa.string()), ("is_leaf", pa.bool_()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]
)
_RESULT = pa.struct([("outcome", pa.string()), ("error_message", pa.string()), ("error", _POSITION), ("parse_input", pa.string()), ("nodes", pa.list_(_NODE))])


def plan(grammar: Rule, names: tuple[str, ...] = (), errors: bool = False) -> str:
    """"regex" if JVM expressions do, "machine" otherwise, "both" if only rejected rows need the machine."""
    try:
        lower(grammar.compile(grammar.form or "NFC") if not grammar.sealed else grammar, names)
    except NotLowerable:
        return "machine"
    return "both" if errors else "regex"


def _ready(grammar: Rule) -> Rule:
    return grammar if grammar.sealed else grammar.compile()


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _split(c: Column, grammar: Rule, use, names: tuple[str, ...] = (), normalize: bool = False, steady: bool = False, **how) -> Column:
    """``use(column, lowering)`` with the plain pattern for simple texts, the guarded one for others; ``steady``: accents decide nothing."""
    other = c
    if normalize and grammar.form:
        # all that NFC turns into ASCII
        other = F.translate(c, "\u212a\u037e\u1fef", "K;`") if steady and grammar.form == "NFC" and ascii_only(grammar) else normalized(c, grammar.form)
    simple = is_simple(c) if grammar.form in (None, "NFC") else is_plain(c)
    return F.when(simple, use(c, lower(grammar, names, plain=True, **how))).otherwise(use(other, lower(grammar, names, **how)))


def matches(text: Column | str, grammar: Rule, allow_trailing: bool = False, normalize: bool = True) -> Column:
    """Whether the grammar accepts the text; null for null.  What all accepted texts begin with is a predicate of its own, which scans take over."""
    grammar, c = _ready(grammar), _col(text)
    if not allow_trailing and (only := exact(grammar)) is not None:
        return c == only if not normalize or not grammar.form or grammar.form == "NFC" else normalized(c, grammar.form) == only
    try:
        ok = _split(c, grammar, lambda x, low: x.rlike(low.pattern), normalize=normalize, steady=True, allow_trailing=allow_trailing)
    except NotLowerable:
        return parse(c, grammar, allow_trailing=allow_trailing)["outcome"] == vm.SUCCESS
    first = prefix(grammar) if grammar.form in (None, "NFC") else ""
    return c.startswith(first) & ok if first else ok


def extract(text: Column | str, grammar: Rule, names: tuple[str, ...] | None = None, allow_trailing: bool = False, normalize: bool = True) -> Column:
    """A struct of the texts that the named rules span, null if the text is rejected; a name that took no part is null, and of several matches the first counts."""
    grammar, c = _ready(grammar), _col(text)
    names = tuple(names or grammar.names())
    try:
        def fields(x: Column, low) -> Column:
            one = lambda n: (lambda v: v if low.empty[n] else F.nullif(v, F.lit("")))(F.regexp_extract(x, low.pattern, low.groups[n]))
            return F.when(x.rlike(low.pattern), F.struct(*[one(n).alias(n) for n in names]))

        return _split(c, grammar, fields, names, normalize, allow_trailing=allow_trailing)
    except (NotLowerable, KeyError):
        kind = pa.struct([(n, pa.string()) for n in names])

        def row(program: vm.Program, t: str, options: vm.Options) -> dict | None:
            r = vm.parse(program, t, options)
            return {n: text_spanned(r, n) for n in names} if r.success else None

        return by_machine(c, grammar, row, kind, "struct<" + ",".join(f"`{n}`:string" for n in names) + ">", allow_trailing=allow_trailing)


def text_spanned(result: vm.Result, name: str) -> str | None:
    """The text that the first node with a name spans, in pre-order; None if there is none."""
    stack = result.nodes[::-1]
    while stack:
        n = stack.pop()
        if n.rule.name == name:
            return result.parsed[n.start : n.end]
        stack += (n.children or ())[::-1]
    return None


def by_machine(c: Column, grammar: Rule, row, arrow: pa.DataType, kind: str, **options) -> Column:
    """``row(program, text, options)`` of each text, null for null."""
    settings, program = vm.Options(**options), None

    def run(column: pa.Array) -> pa.Array:
        nonlocal program
        if program is None:
            program = vm.Program(grammar, settings.preserve_all)
        return pa.array([None if t is None else row(program, t, settings) for t in column.to_pylist()], arrow)

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)(c)


def _found(grammar: Rule, text: Column | str, use, names: tuple[str, ...], row, arrow: pa.DataType, kind: str) -> Column:
    """A search by pattern, or ``row(text, matches)`` of the machine's."""
    grammar, c = _ready(grammar), _col(text)
    try:
        return _split(c, grammar, use, names, anchored=False)
    except (NotLowerable, KeyError):
        return by_machine(c, grammar, lambda program, t, options: row(t, list(vm.search(program, t, options))), arrow, kind)


def extract_all(text: Column | str, grammar: Rule, name: str | None = None) -> Column:
    """The texts of all matches found from left to right, or what one named rule spans in each ('' where it took no part)."""
    use = lambda x, low: F.regexp_extract_all(x, F.lit(low.pattern), F.lit(low.groups[name] if name else 0))
    row = lambda t, found: [(text_spanned(r, name) or "") if name else t[a:b] for a, b, r in found]
    return _found(grammar, text, use, (name,) if name else (), row, pa.list_(pa.string()), "array<string>")


def count_matches(text: Column | str, grammar: Rule) -> Column:
    return _found(grammar, text, lambda x, low: F.regexp_count(x, F.lit(low.pattern)), (), lambda t, found: len(found), pa.int32(), "int")


def find_position(text: Column | str, grammar: Rule) -> Column:
    """The 1-based place of the first match, in code points; 0 if there is none."""
    return _found(grammar, text, lambda x, low: F.regexp_instr(x, F.lit(low.pattern)), (), lambda t, found: found[0][0] + 1 if found else 0, pa.int32(), "int")


def replace_all(text: Column | str, grammar: Rule, by: str = "") -> Column:
    """The text with each match replaced by ``by`` as it stands."""
    quoted = by.replace("\\", "\\\\").replace("$", "\\$")

    def row(t: str, found: list) -> str:
        out, at = [], 0
        for a, b, _ in found:
            out += [t[at:a], by]
            at = b
        return "".join([*out, t[at:]])

    return _found(grammar, text, lambda x, low: F.regexp_replace(x, low.pattern, quoted), (), row, pa.string(), "string")


# -- the machine
def flat_nodes(result: vm.Result) -> Iterator[tuple]:
    """The nodes in pre-order, as tuples of the fields of ``NODE``; leaves carry their text."""
    text, number = result.parsed, 0
    # (node, parent, depth, ordinal); a node's subtree ends where the next one behind it begins, so sizes come first
    sizes: dict[int, int] = {}
    for n in result.nodes:
        for x in vm.bottom_up(n):
            sizes[id(x)] = 1 + sum(sizes[id(c)] for c in x.children or ())
    stack = [(n, -1, 0, k) for k, n in reversed(list(enumerate(result.nodes)))]
    while stack:
        n, parent, depth, ordinal = stack.pop()
        leaf = n.children is None
        yield number, parent, number + sizes[id(n)], depth, ordinal, n.id, n.rule.name or n.rule.kind, n.rule.shape_of, leaf, n.start, n.end, text[n.start : n.end] if leaf else None
        if not leaf:
            stack += [(c, number, depth + 1, k) for k, c in reversed(list(enumerate(n.children)))]
        number += 1


def as_array(results: list[vm.Result | None]) -> pa.Array:
    """Parse results as an Arrow column, made by columns."""
    places = [None if r is None else r.position for r in results]
    error = pa.StructArray.from_arrays([pa.array([getattr(p, f.name) if p else None for p in places], f.type) for f in _POSITION], fields=list(_POSITION), mask=pa.array([p is None for p in places]))
    ends, rows = [0], []
    for r in results:
        if r is not None and r.success:
            rows += flat_nodes(r)
        ends.append(len(rows))
    columns = list(zip(*rows, strict=True)) or [()] * len(_NODE)
    nodes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NODE, strict=True)], fields=list(_NODE)))
    texts = [pa.array([getattr(r, n) if r else None for r in results], pa.string()) for n in ("outcome", "message", "parsed")]
    return pa.StructArray.from_arrays([texts[0], texts[1], error, texts[2], nodes], fields=list(_RESULT), mask=pa.array([r is None for r in results]))


def parse(text: Column | str, grammar: Rule, **options) -> Column:
    """The parse result struct of each text (``RESULT``); null for null.  Options are those of ``vm.Options``."""
    grammar = _ready(grammar)
    settings = vm.Options(**options)
    program = None

    def run(column: pa.Array) -> pa.Array:
        nonlocal program
        if program is None:
            program = vm.Program(grammar, settings.preserve_all)
        return as_array([None if t is None else vm.parse(program, t, settings) for t in column.to_pylist()])

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, RESULT)(_col(text))


def project(text: Column | str, grammar: Rule, value, kind: str, **options) -> Column:
    """``value(result)`` of each accepted text as a column of type ``kind``; null for rejected texts and where ``value`` raises ValueError or ArithmeticError."""
    grammar = _ready(grammar)
    settings = vm.Options(**options)
    program = None

    def one(t: str | None) -> tuple:
        """(value,) of an accepted text, else ()."""
        nonlocal program
        if program is None:
            program = vm.Program(grammar, settings.preserve_all)
        r = None if t is None else vm.parse(program, t, settings)
        try:
            return (value(r),) if r is not None and r.success else ()
        except (ValueError, ArithmeticError):
            return ()

    if kind == "variant":

        def as_json(column: pa.Array) -> pa.Array:
            return pa.array([json.dumps(got[0]) if (got := one(t)) else None for t in column.to_pylist()], pa.string())

        as_json.__annotations__ = {"column": pa.Array, "return": pa.Array}
        return F.try_parse_json(F.arrow_udf(as_json, "string")(_col(text)))
    arrow = {"string": pa.string(), "long": pa.int64(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}[kind]

    def batch(column: pa.Array) -> pa.Array:
        return pa.array([got[0] if (got := one(t)) else None for t in column.to_pylist()], arrow)

    batch.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(batch, kind)(_col(text))


def node_function(grammar: Rule, **options):
    """A table function of the nodes of a text, for lateral joins: ``spark.udtf.register("nodes", node_function(g))``."""
    grammar = _ready(grammar)
    settings = vm.Options(**options)

    class Nodes:
        def __init__(self):
            self.program = vm.Program(grammar, settings.preserve_all)

        def eval(self, text: str):
            if text is not None:
                r = vm.parse(self.program, text, settings)
                if r.success:
                    yield from flat_nodes(r)

    return F.udtf(Nodes, returnType=NODE.removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", ").replace("end int", "`end` int").replace("subtree_`end` int", "subtree_end int"))


def trace(text: Column | str, grammar: Rule, **options) -> Column:
    """The steps of each parse as lines, for debugging grammars."""
    grammar = _ready(grammar)
    settings = vm.Options(**{**options, "trace": True})

    def run(column: pa.Array) -> pa.Array:
        program = vm.Program(grammar, settings.preserve_all)
        return pa.array([None if t is None else vm.parse(program, t, settings).trace for t in column.to_pylist()], pa.list_(pa.string()))

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<string>")(_col(text))


def parse_with_errors(df: DataFrame, text: str, grammar: Rule, into: str = "parsed", **options) -> DataFrame:
    """Adds (accepted, error_message, error); the machine sees only the rows that the pattern rejects."""
    grammar = _ready(grammar)
    if plan(grammar) == "machine":
        r = parse(text, grammar, **options)
        return df.withColumn(into, r).withColumn(into, F.struct((F.col(into)["outcome"] == vm.SUCCESS).alias("accepted"), F.col(into)["error_message"].alias("error_message"), F.col(into)["error"].alias("error")))
    ok = matches(text, grammar, allow_trailing=bool(options.get("allow_trailing")))
    rejected = F.when(~ok, F.col(text))  # null texts give null results at once
    df = df.withColumn(into, parse(rejected, grammar, **options))
    # the machine has the last word, should Unicode versions differ
    accepted = F.col(into).isNull() | (F.col(into)["outcome"] == vm.SUCCESS)
    return df.withColumn(into, F.when(F.col(text).isNotNull(), F.struct(accepted.alias("accepted"), F.col(into)["error_message"].alias("error_message"), F.col(into)["error"].alias("error"))))

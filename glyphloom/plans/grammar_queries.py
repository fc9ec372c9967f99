"""Golden corpora of the grammar library as queries.

Each corpus is a small table of literals; its oracle lists the expected rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.functions import parsing, text
from glyphloom.grammars import data, documents, formats
from glyphloom.operators import charset, tree
from glyphloom.operators import grammar as g

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (int, float)):
        return repr(x)
    # characters that quote badly go by number
    parts = "".join(c if " " <= c != "'" else f"' || chr({ord(c)}) || '" for c in x)
    return f"'{parts}'"


def _corpus(spark: SparkSession, cases: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(cases)), "case_id bigint, input string")


def golden(name: str, cases: dict[str, object], column: Callable[[str], Column], kind: str) -> None:
    """Registers a query of (case_id, input, value) and the rows it must give."""
    inputs = list(cases)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _corpus(spark, inputs).select("case_id", "input", column("input").alias("value"))

    run.__name__ = name
    QUERIES[name] = run
    rows = ", ".join(f"({k}, {_literal(i)}, {_literal(v)})" for k, (i, v) in enumerate(cases.items()))
    ORACLES[name] = f"SELECT CAST(case_id AS BIGINT) AS case_id, input, CAST(value AS {kind}) AS value FROM (VALUES {rows}) AS t(case_id, input, value)"


def accepts(name: str, rule: Callable[[], g.Rule], good: list[str], bad: list[str]) -> None:
    golden(name, {i: True for i in good} | {i: False for i in bad}, lambda c: parsing.matches(c, rule()), "BOOLEAN")


def _json(c: Column) -> Column:
    return F.to_json(c)


def _parts(*columns: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])


accepts("chord", formats.chord, ["A", "C#", "Cbb", "Cm7", "Cmaj7#11", "Cm7b5", "C7sus4", "D/F#", "C♯m", "Bø7", "C7Δ", "Csus2"], ["", "H", "Hello", "m7", "#C", "Csus3", "Cadd3", "C14", "C/", "/G"])
accepts("block_h1", lambda: formats.block_marker("h1"), ["# Title", "#Title", "#"], ["## Not an H1", "  # Indented", "", "Title"])
accepts("block_h2", lambda: formats.block_marker("h2"), ["## Section", "##"], ["# No", "### No", ""])
accepts("block_bullet", lambda: formats.block_marker("bullet"), ["- item", "* item", "+ \titem"], ["-item", "---", ""])
accepts("block_rule", lambda: formats.block_marker("rule"), ["---", "****", "+++"], ["--", "-*+", ""])
accepts("css", documents.css, ["", "a{color:red}", "a,b > c { x: url(a;b)!important }", "@media x { a{b:c} }", "/* c */"], ["a{", "a{b}", "}"])
accepts("xml", documents.markup, ["<a></b>", '<a x="1"><b/>t<!-- c --></a>', '<?xml version="1.0"?><a/>'], ["<a>", "<a x=1></a>", "x"])
accepts("html", lambda: documents.markup(True), ["<!DOCTYPE html><p>a<br>b</p>", '<div class=x hidden><img src="a"></div>'], ["<p>", "text"])
accepts("prolog", documents.prolog, ["foo.", "foo(X,[1,2|T]) :- bar(X), \\+ baz(T), X is Y + 1. % c", "?- a(b)."], ["foo", "foo("])
accepts("prolog_htn", lambda: documents.prolog(True), ["travel(?x) :- if(a(?x)), do(b(?x))."], ["a :- if(."])
golden("arithmetic", {"1+2": "3", "2*(3+4)-5": "9", "-7/2": "-3", "8/2/2": "2", "1+": None, "1/0": None, " 4 * 5 ": "20"}, lambda c: data.arithmetic_value(c).cast("string"), "VARCHAR")
golden(
    "semver",
    {"1.2.3": "1|2|3||", "1.0.0-alpha.1+b.5": "1|0|0|alpha,1|b,5", "01.2.3": None, "1.2": None, "1.2.3-01": None, "99999999999.0.0": None},
    lambda c: (lambda v: F.when(v.isNotNull(), _parts(v["major"], v["minor"], v["patch"], F.array_join(v["pre"], ","), F.array_join(v["build"], ","))))(formats.semver_value(c)),
    "VARCHAR",
)
golden(
    "cron",
    {"*/5 0 1,15 * 1-5": "*/5 0 1,15 * 1-5", "60 * * * *": None, "* * * *": None, "5-1 * * * *": None, "0 0 1 1 7": "0 0 1 1 7"},
    lambda c: (lambda v: F.when(v.isNotNull(), F.concat_ws(" ", *[F.array_join(v[n], ",") for n in formats.CRON])))(formats.cron_value(c)),
    "VARCHAR",
)
golden(
    "requirement",
    {"requests": "requests|||", "requests[security,tests] >= 2.8.1, == 2.8.*": "requests|security,tests|>=,==|2.8.1,2.8.*", "a@http://x.y/z": "a|||", "": None, ">=1": None},
    lambda c: (lambda v: F.when(v.isNotNull(), _parts(v["name"], F.array_join(v["extras"], ","), F.array_join(v["operators"], ","), F.array_join(v["versions"], ","))))(formats.requirement_value(c)),
    "VARCHAR",
)
golden(
    "filter_expression",
    {'a = "b"': '["=","a","b"]', "a >= 3": '[">=","a",3]', 'a = "b" and b = "c" or c = "d"': '["and",["=","a","b"],["or",["=","b","c"],["=","c","d"]]]', "a": None, "v between -1:5": '["between","v","-1:5"]'},
    lambda c: _json(formats.filter_value(c)),
    "VARCHAR",
)
golden("korean_number", {"이백": "200", "천삼백이십": "1320", "팔억구천삼백이": "800009302", "12만8천": "128000", "만": "10000", "만일": "10001", "백만백": "1000100", "x": None}, lambda c: formats.korean_value(c).cast("string"), "VARCHAR")
golden("korean_money", {"오천육백원": "5600", "10만원": "100000", "백": None}, lambda c: formats.korean_value(c, money=True).cast("string"), "VARCHAR")
golden("korean_count", {"하나": "1", "열": "10", "스물둘": "22", "아홉": "9", "백": None}, lambda c: formats.korean_count_value(c).cast("string"), "VARCHAR")
golden(
    "conventional_commit",
    {"feat(core)!: add x": "feat|core|add x|true|", "fix: subject #64 text": "fix||subject #64 text|false|64", "nothing": None, "fix: a\n\nBREAKING CHANGE: b": "fix||a|true|"},
    lambda c: (lambda v: F.when(v.isNotNull(), _parts(v["type"], v["scope"], v["subject"], v["breaking"], F.array_join(v["issues"], ","))))(formats.commit_value(c)),
    "VARCHAR",
)
def _box(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _corpus(spark, ["width=4 height=5 depth=6", "depth=1 width=2 height=3", "width=4 width=5 depth=6"]).withColumn("r", parsing.parse("input", formats.box()))
    n = F.col("r.nodes")
    value = F.when(F.col("r.outcome") == "Success", _parts(*[tree.text_of(n, tree.find(n, w)) for w in ("width", "height", "depth")]))
    return cases.select("case_id", "input", value.alias("value"))


QUERIES["box"] = _box
ORACLES["box"] = "SELECT CAST(case_id AS BIGINT) AS case_id, input, value FROM (VALUES (0, 'width=4 height=5 depth=6', '4|5|6'), (1, 'depth=1 width=2 height=3', '2|3|1'), (2, 'width=4 width=5 depth=6', NULL)) AS t(case_id, input, value)"
golden("json_tree", {"1e3": "1000", '{"a":[1,{"b":null}]}': '{"a":[1,{"b":null}]}', "[1,]": None, ' "x\\n" ': '"x\\n"', '{"a":1,"a":2}': '{"a":2}'}, lambda c: _json(data.json_value(c)), "VARCHAR")
golden("json_string", {'"a\\u00e9"': "aé", '"\\ud83d\\ude00"': "😀", '"\\ud83d"': None, '"\\q"': None, '"': None}, data.json_string_value, "VARCHAR")
golden("resp", {":-5\r\n": "-5", "+OK\r\n": '"OK"', "$2\r\nab\r\n": '"ab"', "*2\r\n:1\r\n$-1\r\n": "[1,null]", "*1\r\n": None}, lambda c: _json(data.resp_value(c)), "VARCHAR")
golden(
    "toml",
    {"a = 1\n[b]\nc = [true, 'x']": '{"a":1,"b":{"c":[true,"x"]}}', "[[t]]\nh = 0xFF\r\n[[t]]\nd = 1979-05-27": '{"t":[{"h":255},{"d":"1979-05-27"}]}', "a = 01": None, "a = 1\na = 2": None},
    lambda c: _json(documents.toml_value(c)),
    "VARCHAR",
)
golden(
    "bibtex",
    {'@string{j = "J"} @article{张2019, title = {A {B}}, journal = j # " X", year = 2019,}': '[{"fields":{"journal":"J X","title":"A {B}","year":"2019"},"key":"张2019","type":"article"}]', "@article{x, title = {A": None},
    lambda c: _json(documents.bibtex_value(c)),
    "VARCHAR",
)
golden("setting", {"setting = 5;": "setting|5", "a=b c;": "a|b c", "setting = 5": None}, lambda c: (lambda v: F.when(v.isNotNull(), _parts(F.trim(v["key"]), v["value"])))(parsing.extract(c, data.setting())), "VARCHAR")
golden("string_json", {'"hello"': "hello", '"a\\"b"': 'a\\"b', '"open': None}, lambda c: parsing.extract(c, data.string_literal("json"))["body"], "VARCHAR")
golden("string_triple", {'"""a"b"""': 'a"b', '"""open"': None}, lambda c: parsing.extract(c, data.string_literal("python_triple"))["body"], "VARCHAR")
golden("string_raw", {'r"a\\b"': "a\\b", '"a"': None}, lambda c: parsing.extract(c, data.string_literal("raw"))["body"], "VARCHAR")
golden("comment_block", {"/* a */": " a ", "/**/x": None, "/* open": None}, lambda c: parsing.extract(c, data.comment("block"))["body"], "VARCHAR")
accepts("identifier_python", lambda: formats.identifier_profile("python"), ["a_1", "_x", "é"], ["1a", "a-b", ""])
accepts("identifier_rust", lambda: formats.identifier_profile("rust"), ["a_1", "_x"], ["_", "1a", ""])
accepts("identifier_ecmascript", lambda: formats.identifier_profile("ecmascript"), ["$a", "_x1"], ["1a", "a b"])
accepts("no_leading_zero", formats.no_leading_zero, ["0", "10", "907"], ["01", "", "a"])
# Clusters: e + U+0301 is one token, as are CRLF, a flag and a joined emoji.
accepts("cluster_token", lambda: g.seq(g.token("e"), g.token("x")), ["ex"], ["éx", "xe", "e"])
golden("cluster_count", {"éx": 2, "\r\n": 1, "\U0001f1e9\U0001f1ea": 1, "\U0001f468\u200d\U0001f469": 1, "": 0, "ab": 2}, lambda c: text.grapheme_count(c).cast("long"), "BIGINT")
golden("cluster_first_length", {"éx": 2, "\U0001f600a": 2, "": 0}, lambda c: text.first_cluster_length(c).cast("long"), "BIGINT")
golden("cluster_floor", {"aéx": 1, "abcd": 2}, lambda c: text.floor_to_cluster_start(c, 2).cast("long"), "BIGINT")
golden("normalized_match", {"é": True, "é": True, "e": False}, lambda c: parsing.matches(c, g.literal("é"), normalize=True), "BOOLEAN")
golden("scan_escape", {'"a\\"b"': True, '"a\\': False, '"\\x"': False, '"ab"': True}, lambda c: parsing.matches(c, g.seq(g.token('"'), g.scan_until('"', "\\", g.one_of('"\\')), g.token('"'))), "BOOLEAN")
golden("scan_eof", {"a:bc": "bc", "a:": None}, lambda c: F.nullif(parsing.extract(c, g.seq(g.literal("a:"), g.scan_until_eof().as_("rest")))["rest"], F.lit("")), "VARCHAR")
golden("committed_choice", {"a": True, "ab": False}, lambda c: parsing.matches(c, g.choice(g.literal("a"), g.literal("ab"))), "BOOLEAN")
golden("nullable_count", {"a": False, "aa": True, "aaa": True}, lambda c: parsing.matches(c, g.at_least(3, g.optional(g.token("a")))), "BOOLEAN")
golden("within_token", {"e\u0301": True, "e": False, "e\u0300": False}, lambda c: parsing.matches(c, _accented().compile(None)), "BOOLEAN")
golden("integer", {"-12": True, "+7": True, "12.5": False, "": False}, lambda c: parsing.matches(c, g.integer()), "BOOLEAN")
golden("float", {"-1.5": True, "1.": False, "1": False}, lambda c: parsing.matches(c, g.float_()), "BOOLEAN")
golden("whitespace", {" \t": True, " \n": True, "a": False, "": False}, lambda c: parsing.matches(c, g.any_whitespace()), "BOOLEAN")
golden("aliased", {"2024-11": "2024|11", "2024": None}, lambda c: (lambda v: F.when(v.isNotNull(), _parts(v["year"], v["month"])))(parsing.extract(c, _year_month())), "VARCHAR")
golden("set_algebra", {"b": True, "a": False, "z": True, "1": False}, lambda c: parsing.matches(c, g.one_of((charset.Ascii.LETTERS & charset.TokenSet.range("a", "z")) - charset.TokenSet.runes("a"))), "BOOLEAN")


def _accented() -> g.Rule:
    return g.within_token(g.seq(g.token("e"), g.one_of(charset.TokenSet.single(0x301))))


def _year_month() -> g.Rule:
    n = lambda: g.scan_while(charset.Ascii.DIGITS)
    return g.seq(n().aliased_as("year"), g.token("-"), n().aliased_as("month"))


def _messages(name: str, rule: Callable[[], g.Rule], cases: dict[str, str], **options) -> None:
    golden(name, cases, lambda c: parsing.parse(c, rule(), **options)["error_message"], "VARCHAR")


_messages("error_named", lambda: g.choice(g.literal("=="), g.literal("=~")).with_error("expected equality operator"), {"=!": "expected equality operator at line 1, column 2.", "==": None})
_messages("error_positional", lambda: g.seq(g.literal("ab"), g.token("c")), {"abd": "Unexpected 'd' at line 1, column 3.", "ab": "Unexpected end of input at line 1, column 3.", "ab\n": "Unexpected 'U+000A' at line 1, column 3."})
_messages("error_forced", lambda: g.seq(g.literal("a").with_error("needs an a", forced=True), g.literal("bcd")), {"x": "needs an a at line 1, column 1.", "abcx": "Unexpected 'x' at line 1, column 4."})
_messages("error_lookahead", lambda: g.seq(g.not_(g.literal("abc")), g.token("x")), {"abx": "Unexpected 'a' at line 1, column 1.", "x": None})
_messages("error_template", lambda: g.token("a"), {"b": "0:b"}, positional="{charIndex}:{character}")


def budget_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left recursion and deep nesting end in a defined outcome."""
    left = g.late_bound()
    left.bind(g.choice(g.seq(left, g.token("a")), g.token("a")))
    return _corpus(spark, ["aa", "a"]).select("case_id", "input", parsing.parse("input", left, max_depth=100)["outcome"].alias("value"))


QUERIES["budget_depth"] = budget_depth
ORACLES["budget_depth"] = "SELECT CAST(case_id AS BIGINT) AS case_id, input, 'DepthLimitExceeded' AS value FROM (VALUES (0, 'aa'), (1, 'a')) AS t(case_id, input)"


def tree_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = g.seq(g.scan_while(charset.Ascii.LETTERS).as_("key"), g.token("="), g.scan_while(charset.Ascii.DIGITS).as_("value")).as_("pair")
    return _corpus(spark, ["a=1"]).withColumn("r", parsing.parse("input", rule)).select("case_id", "input", tree.print_tree(F.col("r.nodes")).alias("value"))


QUERIES["tree_print"] = tree_print
ORACLES["tree_print"] = """SELECT CAST(0 AS BIGINT) AS case_id, 'a=1' AS input, 'pair' || chr(10) || '  key: "a"' || chr(10) || '  value: "1"' AS value"""


def tree_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw tree with shapes applied afterwards has the nodes of the production tree."""
    def rule() -> g.Rule:
        item = g.seq(g.token("("), g.scan_while(charset.Ascii.DIGITS).as_("n"), g.token(")"))
        return g.one_or_more(item).as_("list")

    cases = _corpus(spark, ["(1)(22)", "(3)"]).withColumn("raw", parsing.parse("input", rule(), preserve_all=True)).withColumn("made", parsing.parse("input", rule()))
    names = lambda c: F.array_join(F.transform(c, lambda n: n["name"]), ",")
    return cases.select("case_id", "input", names(tree.flattened(F.col("raw.nodes"))).alias("flattened"), names(F.col("made.nodes")).alias("made"))


QUERIES["tree_flatten"] = tree_flatten
ORACLES["tree_flatten"] = "SELECT CAST(case_id AS BIGINT) AS case_id, input, v AS flattened, v AS made FROM (VALUES (0, '(1)(22)', 'list,n,n'), (1, '(3)', 'list,n')) AS t(case_id, input, v)"


def rule_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of named rules are a hash of the name; those of anonymous single code points are the code point."""
    rule = g.seq(g.scan_while(charset.Ascii.DIGITS).as_("number"), g.one_of("+-")).compile()
    rows = [("number", rule.id_of("number"))]
    parsed = spark.createDataFrame([("1+",)], "input string").withColumn("r", parsing.parse("input", rule)).select(F.explode("r.nodes").alias("n")).select(F.col("n.text").alias("name"), F.col("n.symbol_id").cast("long").alias("id"))
    return parsed.where("name = '+'").union(spark.createDataFrame(rows, "name string, id long"))


QUERIES["rule_ids"] = rule_ids
# The id of "number": FNV-1a over its UTF-16 bytes, in the custom range; worked out by hand.
ORACLES["rule_ids"] = "SELECT name, CAST(id AS BIGINT) AS id FROM (VALUES ('+', 43), ('number', 612008334)) AS t(name, id)"


def screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Security screens over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", formats.is_suspicious("text").alias("s"))
    return docs.select("doc_id", "s.bidi", "s.invisible", "s.replacement", "s.non_ascii_digit", "s.stacked_marks")


QUERIES["screens"] = screens
ORACLES["screens"] = r"""
SELECT doc_id, regexp_matches(text, '[\x{202A}-\x{202E}\x{2066}-\x{2069}\x{61C}\x{200E}\x{200F}]') AS bidi, regexp_matches(text, '[\x{200B}-\x{200D}\x{2060}-\x{2064}\x{FEFF}\x{AD}]') AS invisible,
       contains(text, chr(65533)) AS replacement, regexp_matches(regexp_replace(text, '[0-9]', '', 'g'), '\p{Nd}') AS non_ascii_digit, regexp_matches(text, '\p{Mn}{3,}') AS stacked_marks
FROM documents
"""


def filter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter expression compiled to a Spark predicate, which the scan takes over."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    rule = 'size between 5:10 and ( brand =~ "#1" or name # "red" )'
    return part.where(formats.filter_column(rule, {"size": F.col("p_size"), "brand": F.col("p_brand"), "name": F.col("p_name")})).select("p_partkey", "p_size")


QUERIES["filter_rows"] = filter_rows
ORACLES["filter_rows"] = "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 10 AND (contains(p_brand, '#1') OR list_contains(string_split_regex(p_name, '\\s+'), 'red'))"

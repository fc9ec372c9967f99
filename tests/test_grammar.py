"""Rules, compile pass, machine, lowering and trees."""

import random

import pytest
from glyphloom.functions import parsing, text
from glyphloom.operators import charset, segment, tree, vm
from glyphloom.operators import grammar as g
from glyphloom.operators.charset import Ascii, TokenSet
from glyphloom.operators.regexgen import NotLowerable, lower, lowerable


def run(rule, s, **options):
    o = vm.Options(**options)
    return vm.parse(vm.Program(rule, o.preserve_all), s, o)


def shape(result):
    out = lambda n: (n.rule.name or n.rule.kind, result.parsed[n.start : n.end], None if n.children is None else [out(c) for c in n.children])
    return [out(n) for n in result.nodes]


LEAF = [
    (lambda: g.token("a"), "a", "b", 0), (lambda: g.literal("abc"), "abc", "abx", 2), (lambda: g.literal_ignore_ascii_case("AbC"), "aBc", "ab-", 2),
    (lambda: g.one_of("xy"), "y", "z", 0), (lambda: g.none_of("xy"), "z", "x", 0), (lambda: g.any_token(), "q", "", 0),
    (lambda: g.scan_while("ab", 2), "abab", "ac", 1), (lambda: g.scan_until(";", eof_ends=True), "abc", None, 0), (lambda: g.eof(), "", "x", 0),
    (lambda: g.identifier(), "é1_x", "1a", 0), (lambda: g.within_token(g.seq(g.token("e"), g.any_token())), "e̓", "e", 0),
]


@pytest.mark.parametrize("case", range(len(LEAF)))
def test_leaf_success_failure_position(case):
    make, good, bad, at = LEAF[case]
    assert run(make(), good).success
    if bad is not None:
        r = run(make(), bad)
        assert r.outcome == vm.MISMATCH and r.at == at
        named = run(make().with_error("wanted it"), bad)
        assert named.message == f"wanted it at line 1, column {at + 1}."


def test_messages():
    assert run(g.literal("ab"), "ax").message == "Unexpected 'x' at line 1, column 2."
    assert run(g.literal("ab"), "a").message == "Unexpected end of input at line 1, column 2." or run(g.literal("ab"), "a").at == 1
    assert run(g.seq(g.literal("a\n"), g.token("b")), "a\n\u2028").message == "Unexpected 'U+2028' at line 2, column 1."
    assert run(g.token("a"), "a\ufffe").outcome == vm.MALFORMED
    assert run(g.token("a"), "b", positional="{charIndex}/{tokenIndex}/{line}/{lineNumber}/{character}/{other}").message == "0/0/0/1/b/{other}"


def test_deepest_failure_ranking():
    inner = g.seq(g.token('"'), g.zero_or_more(g.none_of('"')), g.token('"').with_error("unterminated"))
    assert run(g.choice(inner, g.literal("null")).with_error("expected a value"), '"abc').message.startswith("unterminated at line 1, column 5")
    assert run(g.choice(g.literal("=="), g.literal("=~")).with_error("operator"), "=!").message == "operator at line 1, column 2."
    assert run(g.seq(g.literal("a").with_error("forced", forced=True), g.literal("bcd")), "x").message.startswith("forced")
    assert run(g.seq(g.not_(g.literal("abc")), g.any_token()), "abc").at == 0
    assert run(g.seq(g.optional(g.literal("abc").with_error("near miss")), g.token("z")), "abx").message.startswith("near miss at line 1, column 3")
    assert run(g.token("a"), "ab").at == 1  # what is left over


def test_peg_semantics():
    assert not run(g.choice(g.literal("a"), g.literal("ab")), "ab").success
    assert not run(g.seq(g.zero_or_more(g.token("a")), g.token("a")), "aaa").success
    assert not run(g.at_least(3, g.optional(g.token("a"))), "a").success and run(g.at_least(3, g.optional(g.token("a"))), "aa").success
    assert run(g.between(2, 3, g.token("a")), "aaa").success and not run(g.between(2, 3, g.token("a")), "aaaa").success
    assert run(g.token("a"), "ab", allow_trailing=True).success
    with pytest.raises(g.GrammarError):
        g.between(3, 2, g.token("a"))


def test_scan_until_escapes():
    q = lambda: g.seq(g.token('"'), g.scan_until('"', "\\", g.one_of('"\\')), g.token('"'))
    assert run(q(), r'"a\"b"').success and not run(q(), r'"a\x"').success and run(q(), r'"a\x"').at == 3
    assert run(g.seq(g.scan_until(g.literal("-->")), g.literal("-->")), "a-b-->").success
    assert not run(g.scan_until(";"), "abc").success and run(g.scan_until(g.eof()), "abc").success


def test_tree_shapes():
    make = lambda: g.seq(g.token("("), g.one_or_more(g.scan_while(Ascii.DIGITS).as_("n")), g.token(")")).as_("list")
    assert shape(run(make(), "(12)")) == [("list", "(12)", [("n", "12", None)])]
    assert len(run(make(), "(12)", preserve_all=True).nodes[0].children) == 3
    named = g.seq(g.scan_while(Ascii.DIGITS).aliased_as("year"))
    assert shape(run(named, "2024")) == [("year", "2024", None)]
    item = g.seq(g.scan_while(Ascii.DIGITS).as_("d")).as_("inner")
    assert shape(run(g.alias(item).as_("outer"), "5")) == [("outer", "5", [("d", "5", None)])]
    assert shape(run(g.seq(g.not_(g.token("b")), g.one_of("a")), "a")) == [("one_of", "a", None)]


def test_modifiers_and_compile():
    with pytest.raises(g.GrammarError):
        g.token("a").as_("x").as_("y")
    with pytest.raises(g.GrammarError):
        g.token("a").delete().as_("x")
    with pytest.raises(g.GrammarError):
        g.seq(g.token("a").as_("x"), g.token("b").as_("x")).compile()
    with pytest.raises(g.GrammarError):
        g.late_bound().compile()
    r = g.token("a").compile()
    assert r.compile() is r
    for change in (lambda: r.compile("NFD"), lambda: r.as_("x"), lambda: g.seq(r).compile()):
        with pytest.raises(g.GrammarError):
            change()
    bad = g.one_of(TokenSet.single("\ufb01"))
    with pytest.raises(g.GrammarError):
        bad.compile("NFKC")
    with pytest.raises(g.GrammarError):
        bad.compile("NFC")  # a failed compile leaves the rule unusable
    x = g.seq(g.scan_while("a").as_("name"), g.scan_while("b").as_(0x200005), g.scan_while("c")).compile()
    assert x.id_of("name") == g.name_slot("name") >= g.CUSTOM_START and x.children[1].id == 0x200005
    assert "name: scan_while" in x.explain()


def test_recursion_and_budgets():
    e = g.late_bound()
    e.bind(g.choice(g.seq(g.token("("), e, g.token(")")), g.token("x")))
    assert run(e, "(" * 200 + "x" + ")" * 200, max_depth=1000).success
    assert run(e, "(" * 600 + "x" + ")" * 600, max_depth=500).outcome == vm.DEPTH
    many = g.zero_or_more(g.token("a"))
    assert run(many, "a" * 5000, rule_count_limit=2000).outcome == vm.COUNT
    assert run(g.zero_or_more(g.token("a")), "a", cancel=lambda: True).outcome == vm.CANCELED
    assert any("token at 0" in x for x in run(g.seq(g.token("a")), "a", trace=True).trace)


def test_normalization_and_positions():
    assert run(g.literal("é"), "e\u0301").success and not run(g.literal("é").compile(None), "e\u0301").success
    r = run(g.seq(g.literal("éa"), g.token("b")), "e\u0301ax")
    assert r.at == 3 and r.position == vm.Position(3, 2, 0, 3, 2)
    assert vm.Position.of("a\r\nb\U0001f600c", 5) == vm.Position(6, 4, 1, 3, 2)
    assert vm.to_original("ﬁx", "fix", 2, "NFKC") == 1


def test_segmentation():
    assert segment.clusters("e\u0301\r\nक्षa") == ("e\u0301", "\r\n", "क्", "ष", "a") and segment.floor("xe\u0301", 2) == 1
    assert not run(g.token("e"), "e\u0301", allow_trailing=True).success


def test_charset_algebra():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ({rng.randint(40, 90) for _ in range(20)} for _ in range(2))
        x, y = TokenSet((c, c) for c in a), TokenSet((c, c) for c in b)
        for got, want in ((x | y, a | b), (x & y, a & b), (x - y, a - b)):
            assert {ord(c) for c in got} == want and got == TokenSet((c, c) for c in want) and len(got) == len(want)
    assert "e\u0301" in TokenSet.graphemes("e\u0301") and str(TokenSet.range("a", "c")) == "[a-c]" and not charset.EMPTY
    assert ord("٣") in [ord("٣")] and charset.digits().has(ord("٣")) and not charset.UNIVERSE.has(0xD800)
    with pytest.raises(ValueError):
        TokenSet.runes("e\u0301")
    assert "Ａ" in TokenSet.runes("A").with_equivalents("NFKC")


def random_rule(rng, depth=0):
    leaf = [lambda: g.literal(rng.choice(["a", "ab", "b", "é"])), lambda: g.one_of("abé"), lambda: g.none_of("ab"), lambda: g.any_token(), lambda: g.scan_while("ab", rng.randint(0, 2)), lambda: g.eof()]
    if depth > 2 or rng.random() < 0.3:
        return rng.choice(leaf)()
    sub = lambda: random_rule(rng, depth + 1)
    return rng.choice(
        [lambda: g.seq(sub(), sub()), lambda: g.choice(sub(), sub()), lambda: g.zero_or_more(sub()), lambda: g.optional(sub()), lambda: g.between(rng.randint(0, 2), 3, sub()), lambda: g.not_(sub()), lambda: g.peek(sub()), lambda: g.alias(sub())]
    )()


def test_pattern_agrees_with_machine(spark):
    """Random grammars on texts of their own letters: both tiers accept the same."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    texts = ["", "a", "b", "ab", "ba", "aab", "abab", "é", "aé", "e\u0301", "ae\u0301b", "bb", "c", "abc", "éa", "\r\n", "aaa", "bab"]
    rules = []
    while len(rules) < 60:
        r = random_rule(rng).compile()
        if lowerable(r):
            rules.append(r)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", *[parsing.matches("t", r, normalize=True).alias(f"r{k}") for k, r in enumerate(rules)]).collect()
    for row in got:
        for k, r in enumerate(rules):
            assert row[f"r{k}"] == run(r, row.t).success, (r.explain(), row.t)
    assert df.select(F.count("t")).first()[0] == len(texts)


def test_fuzz_properties():
    """Determinism, neutral wrappers, and the raw tree flattened equals the production tree."""
    for seed in range(300):
        mk = lambda wrap=lambda r: r: wrap(random_rule(random.Random(seed)))
        for t in ("", "a", "ab", "abab", "aéb", "bba"):
            one = run(mk(), t)
            assert shape(one) == shape(run(mk(), t)) and one.at == run(mk(), t).at
            for wrap in (g.alias, g.seq, lambda r: g.late_bound().bind(r) or r):
                other = run(mk(wrap), t)
                assert other.success == one.success and (not one.success or "".join(c[1] for c in shape(other)) == "".join(c[1] for c in shape(one)))


def test_not_lowerable():
    e = g.late_bound()
    e.bind(g.choice(g.seq(g.token("("), e, g.token(")")), g.token("x")))
    with pytest.raises(NotLowerable):
        lower(e)
    assert parsing.plan(e) == "machine" and parsing.plan(g.token("a")) == "regex" and parsing.plan(g.token("b"), errors=True) == "both"


def test_columns_and_trees(spark):
    from pyspark.sql import functions as F

    pair = lambda: g.seq(g.scan_while(Ascii.LETTERS).as_("key"), g.token("="), g.scan_while(Ascii.DIGITS).as_("value")).as_("pair")
    rule = g.seq(pair(), g.zero_or_more(g.seq(g.token(","), g.literal("more"))))
    df = spark.createDataFrame([(1, "a=1"), (2, "b=22,more"), (3, "x"), (4, None)], "id long, t string").withColumn("r", parsing.parse("t", rule))
    n = F.col("r.nodes")
    rows = {r.id: r for r in df.select("id", "r", tree.text_of(n, tree.find(n, "value")).alias("v"), F.size(tree.children(n, tree.find(n, "pair"))).alias("c"), tree.source_text(F.col("r.parse_input"), tree.find(n, "pair")).alias("s"), tree.tree(n)["name"].alias("top")).collect()}
    assert rows[1].v == "1" and rows[1].c == 2 and rows[1].s == "a=1" and rows[1].top == "pair" and rows[4].r is None
    assert rows[3].r.outcome == "GrammarMismatch" and rows[3].r.error.char_index == 1
    table = tree.node_table(df, "id", n)
    assert {(r.id, r.text) for r in tree.descendants(table, "id", "pair", "value").collect()} == {(1, "1"), (2, "22")}
    got = parsing.parse_with_errors(df.select("id", "t"), "t", g.seq(g.literal("a="), g.scan_while(Ascii.DIGITS))).orderBy("id").collect()
    assert [None if r.parsed is None else r.parsed.accepted for r in got] == [True, False, False, None] and got[1].parsed.error.char_index == 0
    p = spark.createDataFrame([("a\nbe\u0301",)], "t string").select(text.position("t", 4).alias("p"), text.utf16_length("t").alias("u"), text.is_normalized("t").alias("n")).first()
    assert p.p.line == 1 and p.u == 5 and p.n is False


def test_table_function_trace_and_lookbehind(spark):
    from glyphloom.grammars.formats import lookbehind

    word = g.scan_while(Ascii.LETTERS).as_("word")
    spark.udtf.register("nodes_of", parsing.node_function(g.seq(word, g.zero_or_more(g.seq(g.token(" "), g.alias(word))))))
    spark.createDataFrame([(1, "a bc"), (2, "1"), (3, None)], "id long, t string").createOrReplaceTempView("texts_in")
    got = spark.sql("SELECT id, n.text, n.start FROM texts_in, LATERAL nodes_of(t) n").collect()
    assert {(r.id, r.text, r.start) for r in got} == {(1, "a", 0), (1, "bc", 2)}
    steps = spark.table("texts_in").where("id = 2").select(parsing.trace("t", g.token("a")).alias("x")).first().x
    assert steps == ["token at 0: failed"]
    after_b = g.seq(g.scan_while("abc"), lookbehind(g.literal("b")), g.token("!"))
    assert run(after_b, "acb!").success and not run(after_b, "abc!").success


def test_stream_and_sources(spark, tmp_path):
    from glyphloom.sources import texts
    from pyspark.sql import functions as F
    from glyphloom.streaming import parse_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("k=1\nbad\nx=22\n")
    rule = lambda: g.seq(g.scan_while(Ascii.LETTERS).as_("key"), g.token("="), g.scan_while(Ascii.DIGITS).as_("value"))
    stream = parse_stream.text_stream(spark, str(tmp_path / "in"))
    for name, df, n in (("good", parse_stream.accepted(stream, "value", rule()), 2), ("bad", parse_stream.rejected(stream, "value", rule()), 1)):
        q = df.writeStream.format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() == n
    assert texts.read_lines(spark, str(tmp_path / "in")).count() == 3 and texts.read_files(spark, str(tmp_path / "in")).count() == 1
    assert texts.read_bytes(spark, str(tmp_path / "in")).first().valid
    nodes = tree.node_table(texts.read_lines(spark, str(tmp_path / "in")).withColumn("r", parsing.parse("text", rule())), "path", F.col("r.nodes"))
    texts.write_nodes(nodes, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("name = 'key'").count() == 2


def library():
    """(grammar, texts) of the library: accepted ones, broken ones and ones cut short."""
    from glyphloom.grammars import data, documents, formats

    return [
        (data.json_document, ['{"a":[1,{"b":null}],"c":"x\\n\\u00e9"}', " [1.5e3 , -2,true]\n", '{"a":1,}', '"é"', "[" * 300 + "]" * 300, "[" * 30 + "1" + "]" * 30]),
        (data.json_string, ['"a\\u00e9\\ud83d\\ude00"', '"\\q"', '"a\tb"', '"open']),
        (data.arithmetic, ["1+2*(3-4)/-5", " 4 * 5 ", "1+", "((((1))))"]),
        (documents.css, ["a,b > c { x: url(a;b)!important }", "@media x { a{b:c} }", "/* c */ a{", "a{}"]),
        (documents.markup, ['<a x="1"><b/>t<!-- c --></a>', '<?xml version="1.0"?><a/>', "<a><b></a>"]),
        (lambda: documents.markup(True), ["<!DOCTYPE html><p>a<br>b</p>", '<div class=x hidden><img src="a"></div>', "<p>"]),
        (documents.prolog, ["foo(X,[1,2|T]) :- bar(X), \\+ baz(T), X is Y + 1. % c", "foo("]),
        (documents.toml, ["a = 1\n[b]\nc = [true, 'x']", "[[t]]\nh = 0xFF\r\n[[t]]\nd = 1979-05-27", "a = 01", 'k = """x\ny"""']),
        (documents.bibtex, ['@string{j = "J"} @article{张2019, title = {A {B}}, journal = j # " X", year = 2019,}', "@article{x, title = {A"]),
        (data.resp, ["*2\r\n:1\r\n$-1\r\n", "+OK\r\n", "$2\r\nab\r\n", "*1\r\n"]),
        (formats.filter_expression, ['a = "b" and b = "c" or c = "d"', "a >= 3", "a"]),
        (formats.semver, ["1.0.0-alpha.1+b.5", "01.2.3"]),
        (formats.requirement, ["requests[security,tests] >= 2.8.1, == 2.8.*", "a@http://x.y/z", ">=1"]),
        (formats.conventional_commit, ["feat(core)!: add x", "fix: a\n\nBREAKING CHANGE: b", "nothing"]),
        (formats.box, ["width=4 height=5 depth=6", "width=4 width=5 depth=6"]),
        (formats.chord, ["Cmaj7#11", "D/F#", "H"]),
    ]


def same(quick, slow):
    tree_of = lambda r: [(x.rule, x.id, x.start, x.end, x.children is None) for n in r.nodes for x in vm.bottom_up(n)]
    assert (quick.outcome, quick.message, quick.at, tree_of(quick)) == (slow.outcome, slow.message, slow.at, tree_of(slow)), quick.text


def test_quick_path_is_the_exact_machine():
    """On the library, with texts cut short and changed, and on random grammars; a timeout keeps the exact machine."""
    rng = random.Random(8)
    for make, texts in library():
        for raw in (False, True):
            program = vm.Program(make(), raw)
            for t in texts:
                variants = [t, t[: len(t) // 2], t + t, t.replace("a", "é"), *["".join(rng.sample(t, len(t)))[:40] for _ in range(3)]]
                variants += [t[:k] + rng.choice(['"', "{", "x", " ", "1", "]", "\n"]) + t[k + 1 :] for k in rng.sample(range(len(t)), min(len(t), 8))]
                for v in variants:
                    same(vm.parse(program, v, vm.Options(preserve_all=raw)), vm.parse(program, v, vm.Options(preserve_all=raw, timeout=1e6)))
    for seed in range(400):
        program = vm.Program(random_rule(random.Random(seed)))
        for t in ("", "a", "ab", "abab", "aéb", "bba", "é", "a\r\nb"):
            for trailing in (False, True):
                same(vm.parse(program, t, vm.Options(allow_trailing=trailing)), vm.parse(program, t, vm.Options(allow_trailing=trailing, timeout=1e6)))


def test_extract_and_search_in_the_machine(spark):
    """Repeated names, recursion and empty matches; a pattern's answers where both tiers can give them."""
    from pyspark.sql import functions as F

    repeated = lambda: g.seq(g.token("t"), g.zero_or_more(g.one_of("123").as_("d")))
    nested = g.late_bound()
    nested.bind(g.seq(g.token("("), g.optional(g.choice(nested, g.scan_while(Ascii.LETTERS).as_("word"))), g.token(")")))
    df = spark.createDataFrame([(0, "t12"), (1, "t"), (2, "x"), (3, None), (4, "((ab))"), (5, "a(b)((c))(")], "id long, t string")
    got = {r.id: r for r in df.select("id", parsing.extract("t", repeated(), ("d",)).alias("e"), parsing.extract("t", nested, ("word",)).alias("w")).collect()}
    assert [None if got[k].e is None else got[k].e.d for k in range(4)] == ["1", None, None, None] and got[1].e is not None and got[2].e is None
    assert got[4].w.word == "ab" and got[5].w is None
    found = {r.id: r for r in df.select("id", parsing.extract_all("t", nested).alias("a"), parsing.extract_all("t", nested, "word").alias("w"), parsing.count_matches("t", nested).alias("n"), parsing.find_position("t", nested).alias("p"), parsing.replace_all("t", nested, "$1\\").alias("r")).collect()}
    assert found[5].a == ["(b)", "((c))"] and found[5].w == ["b", "c"] and found[5].n == 2 and found[5].p == 2 and found[5].r == "a$1\\$1\\("
    assert found[2].n == 0 and found[2].p == 0 and found[2].r == "x" and found[3].a is None
    texts = ["aab", "", "b", "aXa", "éa", "éa"]
    for rule in (lambda: g.scan_while("a", 0), lambda: g.seq(g.token("a"), g.optional(g.token("b"))), lambda: g.none_of("b")):
        made = rule().compile()
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        for r in df.select("t", parsing.extract_all("t", made).alias("a"), parsing.count_matches("t", made).alias("n"), parsing.replace_all("t", made, "a$b").alias("r")).collect():
            machine = [r.t[a:b] for a, b, _ in vm.search(vm.Program(made), r.t)]
            assert r.a == machine and r.n == len(machine) and (r.r.count("$") == len(machine)), (r.t, machine)
    empty = spark.createDataFrame([("a:",), ("a:b",)], "t string").select(parsing.extract("t", g.seq(g.literal("a:"), g.scan_until_eof().as_("rest"))).alias("e"), parsing.parse("t", g.seq(g.literal("a:"), g.scan_until_eof().as_("rest"))).alias("r"))
    assert [(r.e.rest, r.r.nodes[0].text) for r in empty.collect()] == [("", ""), ("b", "b")]
    assert F is not None


def test_tiers_agree_on_the_golden_cases(spark):
    """``matches`` is ``parse`` on every golden case of the library, decomposed and other texts too."""
    from glyphloom.plans import grammar_queries as q

    for make, texts in [*library(), (lambda: g.literal("é"), ["é", "é", "e"]), (lambda: g.literal("K;"), ["K;", "K;", "k;"]), (lambda: g.scan_while("aK`"), ["aK", "aK`", "á"]), (lambda: g.seq(g.one_of(charset.letters()), g.eof()), ["Å", "Å", "Å", "가", "가", "1"])]:
        rule = make().compile()
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        for r in df.select("t", parsing.matches("t", rule).alias("m"), parsing.parse("t", rule)["outcome"].alias("o")).collect():
            assert r.m == (r.o == vm.SUCCESS), (rule.explain(), r.t)
    assert len(q.QUERIES) > 50


def test_literals_are_pushed_down(spark, tmp_path):
    spark.createDataFrame([("red apple",), ("blue",)], "t string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = lambda c: df.where(c)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(t,red )" in plan(parsing.matches("t", g.literal("red "), allow_trailing=True))
    assert "StringStartsWith(t,r)" in plan(parsing.matches("t", g.seq(g.token("r"), g.scan_while(charset.letters())), allow_trailing=True))
    assert "EqualTo(t,blue)" in plan(parsing.matches("t", g.seq(g.literal("blue"), g.eof())))
    assert df.where(parsing.matches("t", g.literal("red "), allow_trailing=True)).count() == 1


def test_custom_rules_probe_and_roll_back():
    """A part can be probed without a trace, its nodes taken back, and a rule's own texts normalized."""
    word = g.scan_while(Ascii.LETTERS).as_("word")
    seen = []

    def twice(cursor, at, children):
        mark = children.mark()
        assert children[0].probe(at) == children[0](at)
        children.rollback(mark)
        seen.append((cursor.token(at), cursor.token_length(cursor.size)))
        return children[0](at)

    r = run(g.custom(twice, word), "ab")
    assert r.success and shape(r) == [("word", "ab", None)] and seen[0] == ("a", 0)
    assert shape(run(g.longest(g.literal("a").preserve(), g.literal("ab").preserve()), "ab")) == [("literal", "ab", None)]
    assert run(g.longest(g.literal("ax"), g.literal("abx")), "abz").at == 2
    forms = []
    g.custom(twice, g.scan_while("a"), normalize=lambda form: forms.append(form)).compile("NFC")
    assert forms == ["NFC"]
    with pytest.raises(g.GrammarError):
        g.custom(twice, g.scan_while("a"), normalize=lambda form: ["one of mine"]).compile("NFC")

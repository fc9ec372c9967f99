"""Queries of single rules, modifiers, sets, budgets, trees and relational plans over parsed columns, on the tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphloom.functions import parsing, text
from glyphloom.grammars import data, formats
from glyphloom.operators import charset, tree
from glyphloom.operators import grammar as g
from glyphloom.operators.charset import TokenSet
from glyphloom.plans.grammar_queries import golden

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- leaves
@query("SELECT doc_id, NOT regexp_matches(text, '^[aeiouAEIOU]') AS otherwise FROM documents WHERE text <> ''")
def none_of_text(spark, sf_dir):
    return _t(spark, sf_dir, "documents").where("text <> ''").select("doc_id", parsing.matches("text", g.none_of("aeiouAEIOU"), allow_trailing=True).alias("otherwise"))


@query("SELECT conv_id, turn, CAST(length_grapheme(text) AS BIGINT) AS n FROM conversations")
def any_token(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", parsing.count_matches("text", g.any_token()).cast("long").alias("n"))


@query("SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) AS base FROM pages")
def scan_until_end(spark, sf_dir):
    """A scan that the end of the text may stop."""
    rule = g.scan_until("?#", eof_ends=True).as_("base")
    return _t(spark, sf_dir, "pages").select("page_id", parsing.extract("url", rule, allow_trailing=True)["base"].alias("base"))


@query("SELECT doc_id, regexp_extract(text, '^((?:,.|[^ ,])*) ', 1, 's') AS head FROM documents WHERE regexp_matches(text, '^(?:,.|[^ ,])* ', 's')")
def scan_escape_rule(spark, sf_dir):
    """Up to a space, where a comma escapes what follows it; the escape is a rule."""
    rule = g.scan_until(" ", g.token(","), g.any_token()).as_("head")
    return _t(spark, sf_dir, "documents").select("doc_id", parsing.extract("text", g.seq(rule, g.token(" ")), allow_trailing=True)["head"].alias("head")).where("head is not null")


@query("SELECT doc_id, regexp_extract(text, '^((?:,.|[^,])*?) (?:the|der|la) ', 1, 's') AS head FROM documents WHERE regexp_matches(text, '^(?:,.|[^,])*? (?:the|der|la) ', 's')")
def scan_rule_and_escape(spark, sf_dir):
    """Up to one of three words; both the stopper and the escape are rules."""
    stop = lambda: g.seq(g.token(" "), g.choice(*map(g.literal, ("the ", "der ", "la "))))
    rule = g.seq(g.scan_until(stop(), g.token(","), g.any_token()).as_("head"), stop())
    return _t(spark, sf_dir, "documents").select("doc_id", parsing.extract("text", rule, allow_trailing=True)["head"].alias("head")).where("head is not null")


@query("SELECT c_custkey, regexp_full_match(c_name, 'Customer#0{0,5}[1-9][0-9]*') AS few_zeros FROM customer")
def at_most(spark, sf_dir):
    rule = g.seq(g.literal("Customer#"), g.at_most(5, g.token("0")), g.one_of("123456789"), g.scan_while(charset.Ascii.DIGITS, 0), g.eof())
    return _t(spark, sf_dir, "customer").select("c_custkey", parsing.matches("c_name", rule).alias("few_zeros"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[.][\p{Zs}\t]+\p{Lu}')) AS BIGINT) AS n FROM documents")
def inline_whitespace(spark, sf_dir):
    rule = g.seq(g.token("."), g.inline_whitespace(), g.one_of(TokenSet.category("Lu")))
    return _t(spark, sf_dir, "documents").select("doc_id", parsing.count_matches("text", rule).cast("long").alias("n"))


@query("SELECT n_nationkey, n_name FROM nation WHERE regexp_full_match(n_name, '.*[13579]')")
def lookbehind(spark, sf_dir):
    rule = g.seq(g.scan_while(charset.UNIVERSE), formats.lookbehind(g.one_of("13579")), g.eof())
    return _t(spark, sf_dir, "nation").where(parsing.matches("n_name", rule)).select("n_nationkey", "n_name")


# -- token sets
@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\p{P}+')) AS BIGINT) AS n FROM documents")
def set_category(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", parsing.count_matches("text", g.scan_while(TokenSet.category("P"))).cast("long").alias("n"))


@query("""
SELECT chr(CAST(c AS INT)) AS token, CAST(c AS BIGINT) AS code, c BETWEEN 97 AND 102 AS lower_hex
FROM (SELECT range AS c FROM range(48, 58) UNION ALL SELECT range FROM range(97, 103))
""")
def set_members(spark, sf_dir):
    """A set is enumerated, asked for members and compared."""
    made = charset.Ascii.HEX - TokenSet.range("A", "Z")
    low = TokenSet.range("a", "f")
    if not (made == TokenSet.ranges(("a", "f"), ("0", "9")) and hash(made) == hash(low | charset.Ascii.DIGITS) and str(low) == "[a-f]" and len(made) == 16):
        return spark.createDataFrame([], "token string, code long, lower_hex boolean")
    return spark.createDataFrame([(t, ord(t), t in low) for t in made], "token string, code long, lower_hex boolean")


@query("""SELECT DISTINCT nfc_normalize(chr(CAST(range AS INT))) AS token FROM range(8486, 8512) WHERE length(nfc_normalize(chr(CAST(range AS INT)))) = 1""")
def set_normalized(spark, sf_dir):
    """A set in a normalization form: the Kelvin, Ohm and Angstrom signs become letters."""
    return spark.createDataFrame([(t,) for t in TokenSet.range(8486, 8511).normalized("NFC")[0]], "token string")


golden("set_equivalents", {"A": True, "Ａ": True, "ⓐ": False, "B": False}, lambda c: parsing.matches(c, g.one_of(TokenSet.runes("A").with_equivalents("NFKC")).compile(None)), "BOOLEAN")
golden("set_graphemes", {"é": True, "x": True, "e": False, "é": False}, lambda c: parsing.matches(c, g.one_of(TokenSet.graphemes("é", "x")).compile(None)), "BOOLEAN")


# -- normalization and positions
@query("SELECT doc_id, nfc_normalize(text) AS composed, length(text) AS n FROM documents WHERE text IS NOT NULL")
def normalize_round_trip(spark, sf_dir):
    """Decomposed and composed again, with the code points counted in between."""
    docs = _t(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.normalize("text", "NFD").alias("d"))
    # a decomposed text has its marks besides
    return docs.select("doc_id", text.normalize("d", "NFC").alias("composed"), (F.char_length("d") - F.regexp_count("d", F.lit(r"\p{Mn}"))).cast("long").alias("n"))


golden("normalize_compatible", {"ﬁn": "fin", "Ａ①": "A1", "x²": "x2", "é": "é"}, lambda c: text.normalize(c, "NFKC"), "VARCHAR")
golden("normalize_decomposed", {"é": "é", "가": "가", "ﬁ": "fi"}, lambda c: text.normalize(c, "NFKD"), "VARCHAR")


# -- modifiers, ids and introspection
@query("SELECT CAST(2097409 AS BIGINT) AS symbol_id, count(*) AS n FROM pages WHERE regexp_matches(url, '^[a-z]+://')")
def explicit_id(spark, sf_dir):
    rule = g.seq(g.scan_while(TokenSet.range("a", "z")).as_(0x200101), g.literal("://"), g.scan_until_eof().delete())
    nodes = _t(spark, sf_dir, "pages").select("page_id", F.explode(parsing.parse("url", rule)["nodes"]).alias("n"))
    return nodes.groupBy(F.col("n.symbol_id").cast("long").alias("symbol_id")).agg(F.count("*").alias("n"))


@query(r"SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '[\p{Zs}\t\n]+')) AS BIGINT) AS named, CAST(0 AS BIGINT) AS unnamed FROM conversations")
def flatten_by_default(spark, sf_dir):
    """White space goes by default, and stays under a name."""
    def words(space: g.Rule) -> g.Rule:
        return g.zero_or_more(g.choice(g.scan_while(charset.UNIVERSE - charset.any_space()).delete(), space))

    count = lambda rule: F.size(tree.top_level(parsing.parse("text", rule)["nodes"])).cast("long")
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", count(words(g.any_whitespace().as_("ws"))).alias("named"), count(words(g.any_whitespace())).alias("unnamed"))


@query("""
SELECT * FROM (VALUES ('names', 'key,value'), ('recursive', 'false'), ('leaf', 'true'), ('plan', 'regex'), ('plan_recursive', 'machine'), ('plan_errors', 'both'),
  ('explain', 'seq() [flatten]'), ('sealed', 'GrammarError'), ('unbound', 'GrammarError'), ('twice', 'GrammarError')) AS t(what, said)
""")
def introspection(spark, sf_dir):
    """What a grammar says about itself, and the errors of building a wrong one."""
    rule = g.seq(g.scan_while(charset.Ascii.LETTERS).as_("key"), g.token("="), g.scan_while(charset.Ascii.DIGITS).as_("value"))
    nested = g.late_bound()
    nested.bind(g.choice(g.seq(g.token("("), nested, g.token(")")), g.token("x")))

    def error(make: Callable) -> str:
        try:
            make()
        except g.GrammarError as e:
            return type(e).__name__
        return "none"

    said = [
        ("names", ",".join(rule.names())), ("recursive", str(rule.is_recursive()).lower()), ("leaf", str(g.token("a").emits_leaf).lower()), ("plan", parsing.plan(rule)), ("plan_recursive", parsing.plan(nested)),
        ("plan_errors", parsing.plan(g.token("a"), errors=True)), ("explain", rule.explain().split("\n")[0]), ("sealed", error(lambda: g.token("a").compile().as_("late"))), ("unbound", error(lambda: g.late_bound().compile())),
        ("twice", error(lambda: g.seq(g.token("a").as_("n"), g.token("b").as_("n")).compile())),
    ]
    return spark.createDataFrame(said, "what string, said string")


# -- budgets and diagnostics
@query("SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN length_grapheme(text) + 1 >= 2048 THEN 'RuleCountLimitExceeded' ELSE 'Success' END AS outcome FROM documents")
def budget_count(spark, sf_dir):
    """A scan counts its tokens; the count is looked at every 1024."""
    return _t(spark, sf_dir, "documents").select("doc_id", parsing.parse("text", g.scan_while(charset.UNIVERSE, 0), rule_count_limit=2000)["outcome"].alias("outcome"))


@query("SELECT r_regionkey, 'Timeout' AS timeout, 'Canceled' AS canceled FROM region")
def budget_time(spark, sf_dir):
    """A parse that would not end stops at its deadline; a cancelled one does not begin."""
    slow = g.scan_until(g.literal("never"), g.token("x"), g.seq(g.zero_or_more(g.seq(g.not_(g.eof()), g.any_token())), g.not_(g.token("x"))), eof_ends=True)
    long = F.repeat(F.lit("ab"), 40_000)
    regions = _t(spark, sf_dir, "region")
    return regions.select("r_regionkey", parsing.parse(long, slow, timeout=1e-9)["outcome"].alias("timeout"), parsing.parse("r_name", g.token("A"), cancel=_always)["outcome"].alias("canceled"))


def _always() -> bool:
    return True


@query("""SELECT o_orderkey, CAST(2 AS BIGINT) AS char_index, 'Unexpected ''' || substr(o_orderpriority, 3, 1) || ''' at line 1, column 3.' AS message FROM orders""")
def error_trailing(spark, sf_dir):
    """What is left over behind a match is where the parse failed."""
    r = parsing.parse("o_orderpriority", g.seq(g.one_of(charset.Ascii.DIGITS), g.token("-")))
    return _t(spark, sf_dir, "orders").select("o_orderkey", r.alias("r")).select("o_orderkey", F.col("r.error.char_index").cast("long").alias("char_index"), F.col("r.error_message").alias("message"))


@query("""
SELECT n_nationkey, CASE WHEN length(rest) = 0 THEN 'Unexpected end of input' ELSE 'Unexpected ''' || rest[1] || '''' END || ' at line 1, column ' || (length(n_name) - length(rest) + 1) || '.' AS message
FROM (SELECT n_nationkey, n_name, regexp_replace(n_name, '^[A-Z]+', '') AS rest FROM nation)
""")
def error_leaf(spark, sf_dir):
    """A leaf that fails behind a scan records its place, at the end of the text too."""
    rule = g.seq(g.scan_while(TokenSet.range("A", "Z")), g.token("!"))
    return _t(spark, sf_dir, "nation").select("n_nationkey", parsing.parse("n_name", rule)["error_message"].alias("message"))


@query("SELECT r_regionkey, 'scan_while at 0: ''' || regexp_extract(r_name, '^[A-Z]+') || '''' AS step FROM region")
def trace(spark, sf_dir):
    rule = g.scan_while(TokenSet.range("A", "Z"))
    return _t(spark, sf_dir, "region").select("r_regionkey", F.get(parsing.trace("r_name", rule, allow_trailing=True), F.lit(0)).alias("step"))


golden(
    "cron_problem",
    {"0 0 * * *": None, "60 * * * *": "0: minute field value '60' is out of range (0-59)", "0 5-1 * * *": "2: hour field range '5-1' is descending; the start must not be greater than the end",
     "*/0 * * * *": "2: minute field step '0' must be 1 or greater", "1,2,99 25 * * *": "4: minute field value '99' is out of range (0-59)", "0 0 1-40 13 *": "6: dom field value '40' is out of range (1-31)",
     "0 0 * *": "7: Unexpected end of input at line 1, column 8.", "x * * * *": "0: Unexpected 'x' at line 1, column 1."},
    lambda c: (lambda p: F.when(p.isNotNull(), F.concat(p["char_index"].cast("string"), F.lit(": "), p["message"])))(formats.cron_problem(c)),
    "VARCHAR",
)


# -- trees
def _phrase() -> g.Rule:
    word = g.scan_while(charset.Ascii.LETTERS).as_("word")
    return g.seq(word, g.zero_or_more(g.seq(g.token(" "), word))).as_("phrase")


@query("""
SELECT p_partkey, CAST(len(string_split(p_name, ' ')) AS BIGINT) AS n_children, replace(p_name, ' ', '') AS text, p_name AS source, CAST(length(p_name) AS BIGINT) AS stop,
       string_split(p_name, ' ')[2] AS second, CAST(len(string_split(p_name, ' ')) + 1 AS BIGINT) AS n_below, 'phrase' AS top, CAST(1 AS BIGINT) AS n_top
FROM part
""")
def tree_queries(spark, sf_dir):
    """Children, descendants, text with and without what the tree dropped, and the single node at the top."""
    parts = _t(spark, sf_dir, "part").select("p_partkey", parsing.parse("p_name", _phrase()).alias("r")).select("p_partkey", F.col("r.nodes").alias("n"), F.col("r.parse_input").alias("t"))
    n, top = F.col("n"), tree.tree(F.col("n"))
    return parts.select(
        "p_partkey", F.size(tree.children(n, top)).cast("long").alias("n_children"), tree.text_of(n, top).alias("text"), tree.source_text(F.col("t"), top).alias("source"), top["end"].cast("long").alias("stop"),
        tree.text_of(n, F.get(tree.find_all(n, "word", top), F.lit(1))).alias("second"), F.size(tree.subtree(n, top)).cast("long").alias("n_below"), top["name"].alias("top"), F.size(tree.top_level(n)).cast("long").alias("n_top"),
    )


@query("""
SELECT n_nationkey, 'name#2097153 [0, ' || length(n_name) || ')' || chr(10) || '  word#2097154 [0, 6) "NATION"' || chr(10) || '  number#2097155 [7, ' || length(n_name) || ') "' || substr(n_name, 8) || '"' AS dump FROM nation
""")
def tree_dump(spark, sf_dir):
    """A tree with its ids and spans."""
    rule = g.seq(g.alias(g.literal("NATION")).as_("word").as_(0x200002), g.token("_"), g.scan_while(charset.Ascii.DIGITS).as_("number").as_(0x200003)).as_("name").as_(0x200001)
    return _t(spark, sf_dir, "nation").select("n_nationkey", tree.debug_tree(parsing.parse("n_name", rule)["nodes"]).alias("dump"))


@query("SELECT p_partkey, regexp_extract(p_name, '^(?:[a-z]+ )*[a-z]+') AS taken FROM part")
def longest_match(spark, sf_dir):
    """A rule of one's own, which probes its alternatives and takes the longest."""
    word = lambda: g.scan_while(TokenSet.range("a", "z"))
    rule = g.alias(g.longest(word(), g.seq(word(), g.zero_or_more(g.seq(g.token(" "), word()))), g.literal("red"))).as_("taken")
    return _t(spark, sf_dir, "part").select("p_partkey", parsing.extract("p_name", rule, allow_trailing=True)["taken"].alias("taken"))


@query("""
SELECT props, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2
""")
def extract_recursive(spark, sf_dir):
    """Named rules of a recursive grammar, which the machine extracts."""
    value = parsing.extract("props", data.json_document(), ("member", "number"))
    return _t(spark, sf_dir, "events").select("props", value["number"].cast("long").alias("k")).groupBy("props", "k").agg(F.count("*").alias("n"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<p>[^<]*</p>')) AS BIGINT) AS n, replace(regexp_replace(html, '<p>[^<]*</p>', '$1', 'g'), chr(0), '') AS html FROM pages")
def search_recursive(spark, sf_dir):
    """Searching and replacing with a grammar that has no pattern."""
    inner = g.late_bound()
    inner.bind(g.choice(g.seq(g.literal("<p>"), g.zero_or_more(g.none_of("<")), g.literal("</p>")), g.seq(g.token("\x00"), inner)))
    pages = _t(spark, sf_dir, "pages")
    return pages.select("page_id", parsing.count_matches("html", inner).cast("long").alias("n"), parsing.replace_all("html", inner, "$1").alias("html"))


# -- relational plans over parsed columns
def _brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = g.seq(g.literal("Brand#"), g.one_of(charset.Ascii.DIGITS).as_("maker"), g.one_of(charset.Ascii.DIGITS).as_("line"), g.eof())
    b = parsing.extract("p_brand", rule)
    return _t(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", b["maker"].alias("maker"), b["line"].alias("line")).where("maker is not null")


@query("""
SELECT maker, line, p_partkey, CAST(place AS BIGINT) AS place FROM (
  SELECT p_brand[7] AS maker, p_brand[8] AS line, p_partkey, row_number() OVER (PARTITION BY p_brand[7] ORDER BY p_retailprice DESC, p_partkey) AS place FROM part WHERE regexp_full_match(p_brand, 'Brand#[0-9]{2}')
) WHERE place <= 3
""")
def window_rank(spark, sf_dir):
    """The three dearest parts of each maker, who is parsed from the brand."""
    place = F.row_number().over(Window.partitionBy("maker").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return _brands(spark, sf_dir).withColumn("place", place.cast("long")).where("place <= 3").select("maker", "line", "p_partkey", "place")


@query("SELECT p_brand[7] AS maker, p_brand[8] AS line, CAST(sum(p_size) AS BIGINT) AS size FROM part WHERE regexp_full_match(p_brand, 'Brand#[0-9]{2}') GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 5")
def top_k(spark, sf_dir):
    """The five makers' lines with the largest sizes in all (the limit is the query)."""
    return _brands(spark, sf_dir).groupBy("maker", "line").agg(F.sum("p_size").alias("size")).orderBy(F.desc("size"), "maker", "line").limit(5)


@query("""
SELECT p_brand[7] AS maker, p_brand[8] AS line, CAST(count(*) AS BIGINT) AS n, CAST(max(p_size) AS BIGINT) AS largest
FROM part WHERE regexp_full_match(p_brand, 'Brand#[0-9]{2}') GROUP BY GROUPING SETS ((1, 2), (1), ())
""")
def grouping_sets(spark, sf_dir):
    return _brands(spark, sf_dir).rollup("maker", "line").agg(F.count("*").alias("n"), F.max("p_size").cast("long").alias("largest"))


@query("""
SELECT word, 'both' AS found FROM (SELECT regexp_extract(text, '^([a-zA-Z]+) ', 1) AS word FROM documents WHERE lang = 'en' INTERSECT SELECT regexp_extract(text, '^([a-zA-Z]+) ', 1) FROM documents WHERE lang = 'de') WHERE word <> ''
UNION ALL
SELECT word, 'en' FROM (SELECT regexp_extract(text, '^([a-zA-Z]+) ', 1) AS word FROM documents WHERE lang = 'en' EXCEPT SELECT regexp_extract(text, '^([a-zA-Z]+) ', 1) FROM documents WHERE lang = 'de') WHERE word <> ''
""")
def set_operations(spark, sf_dir):
    """First words of English documents that German ones begin with too, or do not."""
    rule = g.seq(g.scan_while(charset.Ascii.LETTERS).as_("word"), g.token(" "))
    words = _t(spark, sf_dir, "documents").select("lang", parsing.extract("text", rule, allow_trailing=True)["word"].alias("word")).where("word is not null")
    en, de = (words.where(F.col("lang") == x).select("word") for x in ("en", "de"))
    return en.intersect(de).withColumn("found", F.lit("both")).union(en.subtract(de).withColumn("found", F.lit("en")))


@query("""
SELECT CAST(year(o_orderdate) AS BIGINT) AS year, CAST(month(o_orderdate) AS BIGINT) AS month, count(*) AS n, strftime(max(o_orderdate), '%Y-%m-%d') AS last FROM orders GROUP BY 1, 2
""")
def dates(spark, sf_dir):
    """Dates parsed from texts by a grammar, made dates again."""
    digits = lambda n: g.exactly(n, g.one_of(charset.Ascii.DIGITS))
    rule = g.seq(g.alias(digits(4)).as_("y"), g.token("-"), g.alias(digits(2)).as_("m"), g.token("-"), g.alias(digits(2)).as_("d"))
    d = parsing.extract(F.date_format("o_orderdate", "yyyy-MM-dd"), rule)
    rows = _t(spark, sf_dir, "orders").select(d.alias("d")).select(F.make_date(F.col("d.y").cast("int"), F.col("d.m").cast("int"), F.col("d.d").cast("int")).alias("day"))
    return rows.groupBy(F.year("day").cast("long").alias("year"), F.month("day").cast("long").alias("month")).agg(F.count("*").alias("n"), F.date_format(F.max("day"), "yyyy-MM-dd").alias("last"))


@query("""
SELECT strftime(time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS week, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) // 25 AS BIGINT) AS quarter, count(*) AS n FROM events GROUP BY 1, 2
""")
def time_windows(spark, sf_dir):
    """Tumbling windows of a parsed column, as a stream would have them."""
    events = _t(spark, sf_dir, "events").select("ts", data.json_value("props").alias("v"))
    rows = events.select(F.window("ts", "7 days")["start"].alias("w"), F.floor(F.expr("variant_get(v, '$.k', 'bigint')") / 25).cast("long").alias("quarter"))
    return rows.groupBy(F.date_format("w", "yyyy-MM-dd").alias("week"), "quarter").agg(F.count("*").alias("n"))


@query("""
SELECT event_type, strftime(time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS week, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1, 2
""")
def stream_windows(spark, sf_dir):
    """The events as a stream, in one go: parsed, watermarked and summed by tumbling windows; the sums are the sink's rows."""
    path = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")
    events = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day").select("event_type", "ts", data.json_value("props").alias("v"))
    events = events.select("event_type", F.window("ts", "7 days")["start"].alias("w"), F.expr("variant_get(v, '$.k', 'bigint')").alias("k"))
    sums = events.groupBy("event_type", F.date_format("w", "yyyy-MM-dd").alias("week")).agg(F.count("*").alias("n"), F.sum("k").alias("total"))
    name = f"stream_windows_{uuid.uuid4().hex}"
    run = sums.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


@query("""SELECT event_type, median(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS middle, CAST(count(DISTINCT json_extract_string(props, '$.k')) AS BIGINT) AS kinds FROM events GROUP BY 1""")
def quantiles(spark, sf_dir):
    """Exact quantiles and distinct counts of a parsed column."""
    events = _t(spark, sf_dir, "events").select("event_type", data.json_value("props").alias("v")).select("event_type", F.expr("variant_get(v, '$.k', 'bigint')").alias("k"))
    return events.groupBy("event_type").agg(F.median("k").alias("middle"), F.count_distinct("k").alias("kinds"))


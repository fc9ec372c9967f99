"""The registered grammar queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.functions import parsing, text
from glyphloom.operators import charset, tree
from glyphloom.operators import grammar as g

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _brand() -> g.Rule:
    return g.seq(g.literal("Brand#"), g.integer().as_("brand_no"), g.eof())


@query("""
SELECT CAST(regexp_extract(p_brand, '^Brand#([0-9]+)$', 1) AS BIGINT) AS brand_no, count(*) AS n_lines,
       CAST(round(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))), 2) AS DOUBLE) AS revenue
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE regexp_matches(p_brand, '^Brand#[0-9]+$') GROUP BY 1
""")
def brand_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parse, project, join and aggregate: revenue by the number in the brand."""
    part = _t(spark, sf_dir, "part").select("p_partkey", parsing.extract("p_brand", _brand()).alias("b")).where("b is not null")
    part = part.select("p_partkey", F.expr("try_cast(b.brand_no as bigint)").alias("brand_no"))
    lines = _t(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("r"))
    return lines.join(part, lines.l_partkey == part.p_partkey).groupBy("brand_no").agg(F.count("*").alias("n_lines"), F.round(F.sum("r"), 2).cast("double").alias("revenue"))


@query("SELECT event_type, count(*) AS n FROM events WHERE starts_with(event_type, 'c') GROUP BY 1")
def token(spark, sf_dir):
    return _t(spark, sf_dir, "events").where(parsing.matches("event_type", g.token("c"), allow_trailing=True)).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'red ')")
def literal(spark, sf_dir):
    return _t(spark, sf_dir, "part").where(parsing.matches("p_name", g.literal("red "), allow_trailing=True)).select("p_partkey", "p_name")


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'household'")
def literal_ignore_case(spark, sf_dir):
    return _t(spark, sf_dir, "customer").where(parsing.matches("c_mktsegment", g.seq(g.literal_ignore_ascii_case("Household"), g.eof()))).select("c_custkey")


@query(r"SELECT doc_id, regexp_matches(text, '^\p{L}') AS starts_with_letter FROM documents")
def one_of(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", parsing.matches("text", g.one_of(charset.letters()), allow_trailing=True).alias("starts_with_letter"))


@query(r"SELECT doc_id, regexp_matches(text, '^[^\p{L}]') AS starts_otherwise FROM documents")
def none_of(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", parsing.matches("text", g.none_of(charset.letters()), allow_trailing=True).alias("starts_otherwise"))


@query("SELECT doc_id, CAST(length_grapheme(text) AS BIGINT) AS n_graphemes FROM documents")
def grapheme_count(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.grapheme_count("text").cast("long").alias("n_graphemes"))


@query(r"SELECT doc_id, regexp_extract(text, '^(\p{L}+)', 1) AS first_word FROM documents WHERE regexp_matches(text, '^\p{L}')")
def scan_while(spark, sf_dir):
    rule = g.scan_while(charset.letters()).as_("word")
    return _t(spark, sf_dir, "documents").select("doc_id", parsing.extract("text", rule, allow_trailing=True)["word"].alias("first_word")).where("first_word is not null")


@query("SELECT page_id, split_part(url, '://', 1) AS scheme FROM pages WHERE contains(url, '://')")
def scan_until(spark, sf_dir):
    rule = g.seq(g.scan_until(g.literal("://")).as_("scheme"), g.literal("://"))
    return _t(spark, sf_dir, "pages").select("page_id", parsing.extract("url", rule, allow_trailing=True)["scheme"].alias("scheme")).where("scheme is not null")


@query("""
SELECT page_id, regexp_extract(url, '^([a-z]+)://([^/?#]+)([^?#]*)', 1) AS scheme, regexp_extract(url, '^([a-z]+)://([^/?#]+)([^?#]*)', 2) AS host,
       nullif(regexp_extract(url, '^([a-z]+)://([^/?#]+)([^?#]*)', 3), '') AS path FROM pages WHERE regexp_matches(url, '^[a-z]+://[^/?#]+')
""")
def url_parts(spark, sf_dir):
    lower_case = charset.TokenSet.range("a", "z")
    rule = g.seq(
        g.scan_while(lower_case).as_("scheme"), g.literal("://"), g.scan_while(charset.UNIVERSE - charset.TokenSet.runes("/?#")).as_("host"), g.scan_while(charset.UNIVERSE - charset.TokenSet.runes("?#"), 0).as_("path")
    )
    e = parsing.extract("url", rule, allow_trailing=True)
    return _t(spark, sf_dir, "pages").select("page_id", e.alias("e")).where("e is not null").select("page_id", "e.scheme", "e.host", F.expr("nullif(e.path, '')").alias("path"))


@query("SELECT o_orderkey, regexp_extract(o_orderpriority, '^[0-9]-(URGENT|HIGH|MEDIUM|NOT SPECIFIED|LOW)$', 1) AS priority FROM orders WHERE regexp_matches(o_orderpriority, '^[0-9]-(URGENT|HIGH|MEDIUM|NOT SPECIFIED|LOW)$')")
def choice(spark, sf_dir):
    rule = g.seq(g.one_of(charset.Ascii.DIGITS), g.token("-"), g.choice(*map(g.literal, ("URGENT", "HIGH", "MEDIUM", "NOT SPECIFIED", "LOW"))).as_("priority"), g.eof())
    return _t(spark, sf_dir, "orders").select("o_orderkey", parsing.extract("o_orderpriority", rule)["priority"].alias("priority")).where("priority is not null")


@query("SELECT c_custkey, regexp_full_match(c_name, 'Customer#[0-9]{9}') AS well_formed FROM customer")
def exactly(spark, sf_dir):
    rule = g.seq(g.literal("Customer#"), g.exactly(9, g.one_of(charset.Ascii.DIGITS)), g.eof())
    return _t(spark, sf_dir, "customer").select("c_custkey", parsing.matches("c_name", rule).alias("well_formed"))


@query("SELECT c_custkey, regexp_full_match(c_name, 'Customer#0{1,4}[0-9]*') AS up_to_four FROM customer")
def between(spark, sf_dir):
    rule = g.seq(g.literal("Customer#"), g.between(1, 4, g.token("0")), g.scan_while(charset.Ascii.DIGITS, 0), g.eof())
    return _t(spark, sf_dir, "customer").select("c_custkey", parsing.matches("c_name", rule).alias("up_to_four"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<b[^a-z]')) AS BIGINT) AS n FROM pages")
def not_rule(spark, sf_dir):
    rule = g.seq(g.literal("<b"), g.not_(g.one_of(charset.TokenSet.range("a", "z"))))
    return _t(spark, sf_dir, "pages").select("page_id", parsing.count_matches("html", rule).cast("long").alias("n"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\p{L}+[.]')) AS BIGINT) AS n FROM documents")
def peek(spark, sf_dir):
    rule = g.seq(g.scan_while(charset.letters()), g.peek(g.token(".")))
    return _t(spark, sf_dir, "documents").select("doc_id", parsing.count_matches("text", rule).cast("long").alias("n"))


@query("SELECT conv_id, turn, CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS n_line_ends FROM conversations")
def end_of_line(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", parsing.count_matches("text", g.end_of_line()).cast("long").alias("n_line_ends"))


@query(r"SELECT doc_id, regexp_extract(text, '^([\p{L}\p{Nl}][\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}]*)', 1) AS ident FROM documents WHERE regexp_matches(text, '^[\p{L}\p{Nl}]')")
def identifier(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", parsing.extract("text", g.identifier().as_("ident"), allow_trailing=True)["ident"].alias("ident")).where("ident is not null")



def _href() -> g.Rule:
    return g.seq(g.literal('href="'), g.scan_until('"').as_("target"), g.token('"'))


@query("""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages""")
def find_all(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.explode(parsing.extract_all("html", _href(), "target")).alias("target"))


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY 1")
def tag_histogram(spark, sf_dir):
    name = g.seq(g.one_of(charset.TokenSet.range("a", "z")), g.scan_while(charset.TokenSet.ranges(("a", "z"), ("0", "9")), 0)).as_("tag")
    tags = _t(spark, sf_dir, "pages").select(F.explode(parsing.extract_all("html", g.seq(g.token("<"), name), "tag")).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n"))


@query("SELECT page_id, regexp_replace(html, '<!--.*?-->', '', 'gs') AS html FROM pages")
def strip_comments(spark, sf_dir):
    rule = g.seq(g.literal("<!--"), g.scan_until(g.literal("-->")), g.literal("-->"))
    return _t(spark, sf_dir, "pages").select("page_id", parsing.replace_all("html", rule).alias("html"))


@query("SELECT doc_id, CAST(instr(text, ' the ') AS BIGINT) AS at FROM documents")
def find_position(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", parsing.find_position("text", g.literal(" the ")).cast("long").alias("at"))


@query("""
SELECT doc_id, CAST(length(p) AS BIGINT) AS char_index, CAST(length_grapheme(p) AS BIGINT) AS token_index, CAST(length(p) - length(replace(p, chr(10), '')) AS BIGINT) AS line,
       CAST(length(regexp_extract(p, '([^\n]*)$', 1)) AS BIGINT) AS char_column
FROM (SELECT doc_id, text AS p FROM documents)
""")
def source_position(spark, sf_dir):
    """The place of the end of each whole text, in all units."""
    p = text.position("text", F.char_length("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", *[p[c].cast("long").alias(c) for c in ("char_index", "token_index", "line", "char_column")])


@query("""
SELECT doc_id, nfc_normalize(text) AS nfc FROM documents
""")
def normalize(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.normalize("text", "NFC").alias("nfc"))


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS n_runes, CAST(unicode(left(text, 1)) AS BIGINT) AS first_rune FROM documents WHERE text <> ''")
def runes(spark, sf_dir):
    return _t(spark, sf_dir, "documents").where("text <> ''").select("doc_id", text.rune_count("text").cast("long").alias("n_runes"), F.get(text.runes(F.left("text", F.lit(1))), F.lit(0)).cast("long").alias("first_rune"))




@query("""SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY 1""")
def json_projection(spark, sf_dir):
    """The machine's JSON tree of each row as a variant, then a typed aggregate."""
    from glyphloom.grammars import data

    events = _t(spark, sf_dir, "events").select("event_type", data.json_value("props").alias("v"))
    return events.groupBy("event_type").agg(F.sum(F.expr("variant_get(v, '$.k', 'bigint')")).alias("total"), F.count("*").alias("n"))


@query("""SELECT o_orderpriority, count(*) AS n FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[0-9]-[A-Z]+$') GROUP BY 1""")
def rejected_rows(spark, sf_dir):
    rule = g.seq(g.one_of(charset.Ascii.DIGITS), g.token("-"), g.scan_while(charset.TokenSet.range("A", "Z")))
    return _t(spark, sf_dir, "orders").where(~parsing.matches("o_orderpriority", rule)).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey, strpos(o_orderpriority, ' ') - 1 AS char_index,
       'Unexpected '' '' at line 1, column ' || strpos(o_orderpriority, ' ') || '.' AS message
FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[0-9]-[A-Z]+$')
""")
def deepest_failure(spark, sf_dir):
    """Diagnostics of the rejected rows only: the pattern decides, the machine explains."""
    rule = g.seq(g.one_of(charset.Ascii.DIGITS), g.token("-"), g.scan_while(charset.TokenSet.range("A", "Z")))
    rows = parsing.parse_with_errors(_t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", rule).where("not parsed.accepted")
    return rows.select("o_orderkey", F.col("parsed.error.char_index").cast("long").alias("char_index"), F.col("parsed.error_message").alias("message"))


@query(r"""
SELECT page_id, CAST(len(regexp_extract_all(url, '[^/?#]+', 0)) AS BIGINT) AS n_parts, 'part' AS name FROM pages WHERE url IS NOT NULL
""")
def node_table(spark, sf_dir):
    """Parse trees as a node table, counted by rule."""
    part = g.scan_while(charset.UNIVERSE - charset.TokenSet.runes("/?#")).as_("part")
    rule = g.one_or_more(g.choice(part, g.scan_while("/?#").delete()))
    parsed = _t(spark, sf_dir, "pages").where("url is not null").select("page_id", parsing.parse("url", rule).alias("r"))
    nodes = tree.node_table(parsed, "page_id", F.col("r.nodes"))
    return nodes.groupBy("page_id", "name").agg(F.count("*").alias("n_parts"))


def queries() -> dict:
    from glyphloom.plans import grammar_queries, rule_queries

    return QUERIES | grammar_queries.QUERIES | rule_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    from glyphloom.plans import grammar_queries, rule_queries

    return ORACLES | grammar_queries.ORACLES | rule_queries.ORACLES

"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its tags with their path of element names and classes, and
its text blocks.  The occurrence vector of a token counts it on every different
page of its host.  Tokens with equal vectors form an equivalence class (ExAlg;
Arasu & Garcia-Molina, SIGMOD 2003).  Classes nest by paths: the room of a token
is the pages that have the element around it (all of the host's for outermost
ones), and a token is valid if it occurs on ``support`` of its room, which must
be ``pages`` or more; so a notice in an element that only some pages have is
measured within them.  A class nests in the class of the element around its
tokens.  The valid classes are the host's template; text blocks that belong to it
(menus, notices, imprints that repeat) go, and what lies in its remaining slots
is read.

Near copies of a page repeat its text without being a template, so they share one
vote: pages meet by ``BANDS`` bands of ``ROWS`` min-hashes of the 3-word shingles
of their content, and a page in a group of n counts 1/n, by its largest group.

Vectors are not built: equal vectors have equal sums of count * hash(page), which
aggregate map-side, so a host with a third of all pages is no more than one row
for each of its tokens and tasks.

Slots are content or not by the template's element names: those that HTML itself
reserves for navigation, page headers and footers, asides and forms, and those
with a class, id or role made of such names alone (a fixed list of words; a class
like ``social-history`` says nothing).  If a page has article or main elements,
its text is theirs, less the template's blocks in them.

A text block ends at any tag that is not inline.  Character references are
decoded, white space in a block becomes one space, blocks are joined in page
order by one space.  A page is read once from start to end: a tag ends at the
first ``>`` outside its quoted values; after the first tag that does not end so,
quotes no longer count, and a ``<`` without any ``>`` behind it is text.  Paths
are hashes made from the hash of the path around, so deep pages cost no more.

Defined results: null or empty html: empty text.  Null url: the page is its own
host's only one.  Null page_id and repeated rows: rows like any other; exact
copies of a page count once in the vectors, pages without tags or text not at
all.  Equal support (ties) is valid.  Very long pages take time in proportion to
their length.  An empty table gives an empty table.  Columns with other names,
also those used here, are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.llm._kernels import Words, chunks, grams, list_array, mix, signed, tidy
from glyphloom.llm._stage import Workspace

SUPPORT = 0.9
PAGES = 5
BANDS, ROWS = 8, 4
_MULTIPLIERS = np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_OPEN = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*))", re.S)
_MARK = re.compile(r"""[>"']""")
_ATTR = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_SPACE = re.compile(r"\s+")

# Fixed by HTML.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_CLOSED_BY_SAME = frozenset("p li dt dd tr td th option".split())
_HOLDS = frozenset("ul ol dl table div section article main body td aside nav".split())
_CLOSES = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _RAW}
# Elements that hold no article text.
_OUT = frozenset("head script style noscript template nav footer aside form button select textarea iframe object svg math dialog menu".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements sponsor sponsored promo promotion banner menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars "
    "footer header masthead cookie cookies consent notice notices alert popup modal newsletter subscribe subscription signup login comment comments disqus share sharing "
    "social related recommended widget toolbar pagination pager copyright".split()
)
# Words that say nothing beside one of those.
_NEUTRAL = frozenset("area bar block box button buttons column container content footer group header inner item items link links list main module outer page panel post posts section site slot text top unit wrap wrapper left right bottom article articles form field icon icons".split())
_CONTENT = frozenset("article main".split())


class Block:
    """A text block, the hash of the path around it, and whether its place is ruled out, or content."""

    __slots__ = ("text", "path", "out", "content")

    def __init__(self, text: str, path: int, out: bool, content: bool):
        self.text, self.path, self.out, self.content = text, path, out, content


def _ruled_out(value: str) -> bool:
    """Whether one of the names in a class, id or role is made of words for what is no article."""
    for name in value.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if any(w in _NAMES for w in words) and all(w in _NAMES or w in _NEUTRAL for w in words):
            return True
    return False


def _label(name: str, attrs: str) -> tuple[str, bool, str]:
    """(element name with its classes, whether class, id or role rule it out, role)."""
    classes, out, role = "", False, ""
    for m in _ATTR.finditer(attrs):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "class":
            classes = value
        if m[1].lower() == "role":
            role = value.strip().lower()
        out = out or _ruled_out(value)
    return f"{name}.{classes}" if classes else name, out or role in ("complementary", "contentinfo", "search"), role


def _tag_end(page: str, at: int, quoted: bool) -> int:
    """The place of the ``>`` that ends a tag whose attributes begin at ``at``, -1 if there is none."""
    while quoted and (m := _MARK.search(page, at)) is not None:
        if m[0] == ">":
            return m.start()
        at = page.find(m[0], m.end()) + 1
        if not at:
            return -1
    return -1 if quoted else page.find(">", at)


def parse(page: str) -> tuple[list[Block], dict[int, tuple[int, int]]]:
    """The text blocks of a page, and (occurrences, hash of the path around) of its tags by the hash of their path."""
    blocks: list[Block] = []
    tags: dict[int, tuple[int, int]] = {}
    stack: list[tuple[str, int, bool, bool]] = []  # name, hash of the path, ruled out, content
    inside: Counter = Counter()  # names on the stack
    held: list[str] = []

    def end_block() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
        held.clear()
        if text:
            blocks.append(Block(text, *(stack[-1][1:] if stack else (0, False, False))))

    def cut(k: int) -> None:
        for s in stack[k:]:
            inside[s[0]] -= 1
        del stack[k:]

    def push(*entry) -> None:
        inside[entry[0]] += 1
        stack.append(entry)

    at, n, quoted = 0, len(page), True
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            held.append(page[at:])
            break
        held.append(page[at:lt])
        m = _OPEN.match(page, lt)
        if m is None:
            held.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        gt = _tag_end(page, at, quoted)
        if gt < 0 and quoted:
            quoted, gt = False, page.find(">", at)
        if gt < 0:
            held.append(page[lt:])
            break
        attrs, at = page[at:gt], gt + 1
        name = m[2].lower()
        if name in _INLINE and not attrs.strip():
            if not m[1] or not inside[name]:
                continue
        if name not in _INLINE:
            end_block()
        if m[1]:
            if not inside[name]:
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name in _INLINE and stack[k][2]:
                        end_block()
                    cut(k)
                    break
                if name in _INLINE and stack[k][0] not in _INLINE:
                    break
            continue
        label, out, role = _label(name, attrs)
        around = stack[-1][1] if stack else 0
        path = xxhash.xxh64_intdigest(label, around)
        if name in _INLINE:
            # an inline element matters only if its names rule it out
            if out:
                end_block()
                push(name, path, True, False)
            continue
        if name in _CLOSED_BY_SAME and inside[name]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    cut(k)
                    around = stack[-1][1] if stack else 0
                    path = xxhash.xxh64_intdigest(label, around)
                    break
                if stack[k][0] in _HOLDS:
                    break
        above_out, above_content = (stack[-1][2], stack[-1][3]) if stack else (False, False)
        content = above_content or name in _CONTENT or role in _CONTENT
        out = above_out or out or name in _OUT or (name == "header" and not above_content)
        tags[path] = (tags[path][0] + 1 if path in tags else 1, around)
        if name in _RAW:
            close = _CLOSES[name].search(page, at)
            at = close.start() if close else n
            push(name, path, True, False)
            continue
        if name not in _VOID:  # a slash closes nothing in HTML
            push(name, path, out, content and not out)
    end_block()
    return blocks, tags


def _key(path: int, text: str) -> int:
    return xxhash.xxh64_intdigest("\0" + text, path)


def page_tokens(blocks: list[Block], tags: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int, bool]]:
    """(occurrences, hash of the element around, whether a text block) of each token, by its hash."""
    out: dict[int, tuple[int, int, bool]] = {}
    for b in blocks:
        key = _key(b.path, b.text)
        out[key] = (out[key][0] + 1 if key in out else 1, b.path, True)
    for path, (n, around) in tags.items():
        out[path] = (n, around, False)
    return out


def _content(blocks: list[Block]) -> list[Block]:
    """The blocks of the slots that are content."""
    read = [b for b in blocks if not b.out]
    return [b for b in read if b.content] or read


def bands(texts: list[str]) -> pa.Array:
    """The keys of the bands of min-hashes of each text; none for a text without words."""
    values, sizes = [], []
    for i, j, data, offsets in chunks(pa.array(texts, pa.large_string())):
        w = Words(data, offsets)
        h = w.hashes()
        g = grams(h, 3)
        n = np.diff(w.first)
        # texts of one or two words are their words
        g = np.append(g, h[len(g) :])
        start = w.first[:-1]
        within = np.arange(len(h)) - np.repeat(start, n) <= np.maximum(np.repeat(n, n) - 3, 0)
        short = np.repeat(n < 3, n)
        g = np.where(short, h, g)[within | short]
        some = np.flatnonzero(n)
        first = np.concatenate([[0], np.cumsum(np.where(n < 3, n, n - 2))])[some]
        keys = np.zeros((len(some), BANDS), dtype=np.uint64)
        for k, by in enumerate(_MULTIPLIERS if len(some) else ()):
            low = np.minimum.reduceat(g * by, first)
            keys[:, k // ROWS] = mix(keys[:, k // ROWS] + low + np.uint64(k // ROWS))
        values.append(keys.ravel())
        sizes.append(np.where(n > 0, BANDS, 0))
    return list_array(signed(np.concatenate(values)), np.concatenate(sizes)) if values else pa.array([[] for _ in texts], pa.list_(pa.int64()))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _tokens(batches):
    for batch in batches:
        hashes, texts, columns = [], [], ([], [], [], [])
        for page in batch.column(1).to_pylist():
            blocks, tags = parse(page or "")
            t = page_tokens(blocks, tags)
            texts.append(" ".join(b.text for b in _content(blocks)))
            hashes.append(_signed(xxhash.xxh64_intdigest(page or "")))
            for column, x in zip(columns, ([_signed(k) for k in t], [v[0] for v in t.values()], [_signed(v[1]) for v in t.values()], [v[2] for v in t.values()]), strict=True):
                column.append(x)
        types = (pa.int64(), pa.int32(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.int64()), bands(texts), *[pa.array(c, pa.list_(t)) for c, t in zip(columns, types, strict=True)]], names=["host", "page", "bands", "keys", "counts", "around", "block"])


def main_text(page: str, template: np.ndarray) -> str:
    """The text of the slots that are content, less the template's own blocks (sorted hashes)."""
    known = set(template.tolist())
    return " ".join(b.text for b in _content(parse(page)[0]) if _signed(_key(b.path, b.text)) not in known)


def _extract(batches):
    none = np.zeros(0, dtype=np.int64)
    for batch in batches:
        text = []
        for k, page in enumerate(batch.column(2).to_pylist()):
            t = batch.column(3)[k]
            text.append(main_text(page or "", t.values.to_numpy(zero_copy_only=False) if t.is_valid else none))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def _hosted(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.col("url").cast("string"), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.nullif(host, F.lit("")).alias("host"))


def templates(pages: DataFrame, support: float = SUPPORT, least_pages: int = PAGES) -> DataFrame:
    """host, class (of equal occurrence vectors), parent (the class it nests in, null for outermost ones), tokens, blocks (arrays of hashes; blocks are those of text) of the valid tokens."""
    work = Workspace(pages.sparkSession, "templates")
    seen = _hosted(pages).where("host is not null").select("host", "html").mapInArrow(tidy(_tokens), "host string, page long, bands array<long>, keys array<long>, counts array<int>, around array<long>, block array<boolean>")
    columns = ["bands", "keys", "counts", "around", "block"]
    different = work.keep(seen.where(F.size("keys") > 0).groupBy("host", "page").agg(*[F.first(c).alias(c) for c in columns]), "pages")
    # a page's vote: one for each group of near copies
    band = different.select("host", "page", F.explode("bands").alias("band"))
    groups = band.groupBy("host", "band").agg(F.count("*").alias("size")).where("size > 1")
    votes = work.keep(band.join(groups.hint("shuffle_merge"), ["host", "band"]).groupBy("host", "page").agg((1 / F.max("size")).alias("vote")), "votes")
    voted = different.drop("bands").join(votes.hint("shuffle_merge"), ["host", "page"], "left").withColumn("vote", F.coalesce("vote", F.lit(1.0)))
    each = voted.select("host", "page", "vote", F.explode(F.arrays_zip("keys", "counts", "around", "block")).alias("t"))
    each = each.select("host", "page", "vote", F.col("t.keys").alias("token"), F.col("t.counts").alias("n"), F.col("t.around").alias("around"), F.col("t.block").alias("block"))
    # votes are added in any order: rounded, so that thresholds do not depend on it
    on = F.round(F.sum("vote"), 6).alias("on")
    # two sums of count * hash(page): equal vectors, equal sums (in decimals: no overflow)
    vector = [F.sum(F.col("n") * F.xxhash64(F.lit(s), "page").cast("decimal(20,0)")).alias(f"v{s}") for s in (1, 2)]
    tokens = each.groupBy("host", "token").agg(F.min("around").alias("around"), F.max("block").alias("block"), on, *vector)
    tokens = work.keep(tokens.where(F.col("on") >= support * least_pages), "tokens")
    whole = different.select("host", "page").join(votes.hint("shuffle_merge"), ["host", "page"], "left").groupBy("host").agg(F.round(F.sum(F.coalesce("vote", F.lit(1.0))), 6).alias("room"))
    own = F.xxhash64("v1", "v2")
    outermost = whole.select("host", F.lit(0).cast("long").alias("around"), "room", F.lit(None).cast("long").alias("parent"))
    rooms = tokens.where("not block").select("host", F.col("token").alias("around"), F.col("on").alias("room"), own.alias("parent")).union(outermost)
    rooms = work.keep(rooms.where(F.col("room") >= least_pages), "rooms")
    valid = tokens.join(rooms.hint("shuffle_merge"), ["host", "around"]).where(F.col("on") >= F.round(support * F.col("room"), 6))
    # tokens with equal vectors under different elements are classes of their own
    return valid.groupBy("host", own.alias("class"), "parent").agg(F.collect_list("token").alias("tokens"), F.collect_list(F.when(F.col("block"), F.col("token"))).alias("blocks"))


def extract(pages: DataFrame, support: float = SUPPORT, least_pages: int = PAGES) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""
    work = Workspace(pages.sparkSession, "extraction")
    # the blocks of a template take up support * least_pages votes each
    template = work.keep(templates(pages, support, least_pages).where(F.size("blocks") > 0).groupBy("host").agg(F.flatten(F.collect_list("blocks")).alias("template")), "templates")
    # the templates grow with the hosts: never broadcast; the pages of a hot host are split between tasks
    return _hosted(pages).join(template.hint("shuffle_merge"), "host", "left").select("page_id", "url", "html", "template").mapInArrow(tidy(_extract), "page_id long, url string, text string, n_chars long")

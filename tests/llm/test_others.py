"""Operators on pages and embeddings, and the pipeline."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from glyphloom.llm import embedding_dedup as emb
from glyphloom.llm import html_extraction as htm
from glyphloom.llm._stage import Workspace, components


@pytest.mark.parametrize("block", [768, 8])
def test_embedding_dedup(spark, block):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 16))
    rows = []
    for k in range(150):
        v = base[k % 40] + rng.standard_normal(16) * rng.choice([0, 0.1, 0.3])
        rows.append((k, [float(x) for x in np.float32(v * rng.choice([1.0, 3.0]))]))
    rows += [(200 + k, rows[0][1]) for k in range(20)]  # a group of exact copies
    rows += [(300, None), (301, []), (302, [0.0] * 16), (303, [1.0] * 15 + [None]), (304, [math.nan] + [1.0] * 15), (305, [math.inf] + [1.0] * 15), (306, [1.0] * 8), (307, [1.0] * 8), (None, rows[1][1]), rows[2], rows[2]]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, cid int, m int")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in emb.embedding_dedup(df, block=block).collect())
    good = [i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v) for i, v in rows]
    links, root = [set() for _ in rows], {i: i for i, _ in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if good[a] and good[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], dtype=np.float32).astype(float) for k in (a, b))
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.95:
                    links[a].add(b)
                    links[b].add(a)
                    p, q = find(rows[a][0]), find(rows[b][0])
                    root[max(p, q)] = min(p, q)
    want = Counter()
    for k, (i, _) in enumerate(rows):
        c = None if i is None else find(i)
        want[(i, len(links[k]), c, c == i and i is not None)] += 1
    assert got == want


def test_estimate_is_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    dim = 64
    x, y = emb.unit(rng.standard_normal((400, dim))), emb.unit(rng.standard_normal((400, dim)))
    r = emb.rotations(dim, 1)[0]
    assert np.allclose(r @ r.T, np.eye(dim))
    ox, oy = x @ r.T, y @ r.T
    code = np.where(ox > 0, 1, -1) / math.sqrt(dim)
    f = (code * ox).sum(axis=1)
    error = (code @ oy.T) / f[:, None] - x @ y.T
    wide = emb.SIGMAS * np.sqrt((1 - f * f) / (f * f) / (dim - 1))
    assert abs(error.mean()) < 0.002 and (np.abs(error) <= wide[:, None]).mean() > 0.9995


def test_rounded_codes_bound_the_cosine():
    """No pair at the threshold is left out by the bounds of stored codes; most pairs far from it are."""
    rng = np.random.default_rng(3)
    dim, n = 64, 600
    x = emb.unit(rng.standard_normal((n, dim)))
    y = emb.unit(x + rng.standard_normal((n, dim)) * 0.04)
    batch = pa.RecordBatch.from_arrays([pa.array(range(2 * n)), pa.array([1] * 2 * n), pa.array([v.tobytes() for v in np.vstack([x, y])], pa.binary())], names=["cid", "m", "vec"])
    [rows] = emb._codes(8, 4)([batch])
    code = np.unpackbits(np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(2 * n, -1), axis=1)[:, :dim] * 2.0 - 1
    q = np.frombuffer(b"".join(rows.column("rounded").to_pylist()), np.int8).reshape(2 * n, dim) * rows.column("scale").to_numpy()[:, None]
    assert np.allclose(q @ emb.rotations(dim, 1)[0], np.vstack([x, y]), atol=0.01) and (rows.column("lost").to_numpy() < 0.02).all()
    may = emb.possible(code / math.sqrt(dim), rows.column("f").to_numpy(), q, rows.column("lost").to_numpy(), 0.95, emb.SIGMAS)
    cosine = np.vstack([x, y]) @ np.vstack([x, y]).T
    assert may[cosine >= 0.95].mean() > 0.999 and may[cosine < 0.3].mean() < 0.05 and (cosine >= 0.95).sum() > 2 * n


def test_embedding_recall_on_many_links(spark):
    """Measured against brute force: at the threshold itself nearly all links are found, none below it."""
    rng = np.random.default_rng(6)
    base = emb.unit(rng.standard_normal((300, 32)))
    near = np.vstack([emb.unit(base + rng.standard_normal((300, 32)) * s) for s in (0.03, 0.05, 0.06)])
    x = emb.unit(np.vstack([base, near]))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in emb.embedding_dedup(df).collect()}
    want = (x @ x.T >= 0.95).sum(axis=1) - 1
    assert all(got[k] <= want[k] for k in got)
    assert sum(got.values()) >= 0.999 * want.sum() and want.sum() > 1000


def test_embeddings_empty(spark):
    assert emb.embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(400 + k, 401 + k) for k in range(60)] + [(500, 600 + k) for k in range(80)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test")).collect()}
    root = {n: n for e in edges for n in e}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}


def test_staged_tables_are_cleared(spark, tmp_path):
    import os

    from glyphloom.llm import _stage

    work = Workspace(spark, "cleared")
    kept = work.keep(spark.range(10), "ten")
    folder = kept._staged.removeprefix("file:")
    assert kept.count() == 10 and os.path.isdir(folder)
    assert _stage.clear(spark) > 0 and not os.path.exists(folder) and _stage.clear(spark) == 0


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var x="</p><article>no</article>";</script></head>
<body class="page"><header><h2>Site</h2></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad banner">Buy</div>
<div id="cookie-notice">We use cookies</div><!-- <article>hidden</article> --><article class="post"><header><h1>Head&shy;line &#8212; one</h1></header><p>First <b>bold</b>ly
 said &lt;tag&gt;.<p>Second<br>third&nbsp;x</p><form><input value="q"><button>Go</button></form><aside>See also</aside>
<table><tr><td>cell</td><td>two</td></tr></table><p>1 < 2 and 3 > 2</article><section class="comments"><article>First!</article></section><aside>Side</aside><footer>&copy; me</footer></body></html>"""


def test_main_text():
    none = np.zeros(0, dtype=np.int64)
    assert htm.main_text(PAGE, none) == "Head\xadline — one First boldly said <tag>. Second third x cell two 1 < 2 and 3 > 2"
    assert htm.main_text("", none) == "" and htm.main_text("plain text", none) == "plain text"
    assert htm.main_text("<p>a<p>b<div>c", none) == "a b c" and htm.main_text("<!-- open", none) == "" and htm.main_text("a <b", none) == "a <b"
    assert htm.main_text("<script>never closed", none) == "" and htm.main_text("<div class='sidebar'>x</div><div>y</div>", none) == "y"


def test_names_in_class_attributes():
    """A class, id or role rules an element out only if it is made of such names."""
    none = np.zeros(0, dtype=np.int64)
    wrap = lambda names: f"<article><p>Text</p><div class='{names}'>other</div></article>"
    for names in ("social-history", "comment-on-economy", "ad-hoc", "bannerman", "subscription-models in-depth"):
        assert htm.main_text(wrap(names), none) == "Text other", names
    for names in ("ad", "ad-box", "newsletter-signup wide", "related_posts", "commentList", "share-buttons"):
        assert htm.main_text(wrap(names), none) == "Text", names


def test_long_pages_take_time_in_proportion():
    import time

    began = time.time()
    for page in ("<a " * 200000, '<a "' * 200000, "<div>" * 50000, "<div>" * 20000 + "</x>" * 200000, "<x>" * 20000 + "<p>" * 20000, '<a "x <b> y" ' * 50000, "<li>" * 50000, "<" * 1000000, "<!--" * 100000, "<p>x" * 100000):
        blocks, tags = htm.parse(page)
        assert len(htm.page_tokens(blocks, tags)) <= len(page)
    assert time.time() - began < 60
    assert htm.parse("<p title='a>b'>c</p><p \"d>e</p>")[0][0].text == "c"


def test_html_templates_inside_articles(spark):
    """Blocks of the template go inside article too, also in elements that few pages have; near copies of a page are no template."""
    rng = np.random.default_rng(5)
    story = lambda: " ".join(f"w{rng.integers(0, 5000)}" for _ in range(60))
    wrap = lambda x: f"<html><body><article>{x}</article></body></html>"
    stories = [story() for _ in range(20)]
    rows = [(k, "http://a.example/x", wrap(f"<p>Subscribers read more</p><p>{x}</p>" + ("<div class='x'>Also on paper</div>" if k % 3 == 0 else ""))) for k, x in enumerate(stories)]
    copied = story()
    near = [f"<p>{copied} number {k}</p><p>A last line of the copied story</p>" for k in range(40)]
    rows += [(100 + k, "http://b.example/x", wrap(x)) for k, x in enumerate(near)]
    rows += [(200 + k, "http://c.example/x", wrap(f"<p>Subscribers read more</p>{x}")) for k, x in enumerate(near)]
    rows += [(300 + k, "http://c.example/y", wrap(f"<p>Subscribers read more</p><p>{x}</p>")) for k, x in enumerate(stories)]
    got = {r.page_id: r.text for r in htm.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == got[300 + k] == x for k, x in enumerate(stories))
    assert all(got[100 + k] == got[200 + k] == f"{copied} number {k} A last line of the copied story" for k in range(40))


def test_html_templates(spark):
    """Without article elements, blocks that a host's pages share are template; what varies is text."""
    page = lambda k: f"<html><body><div>Welcome to our site</div><div>story {k} about {k * 7}</div><p>All rights kept</p></body></html>"
    rows = [(k, "http://Host.example/x", page(k)) for k in range(8)] + [(50 + k, "http://host.example/copy", page(0)) for k in range(30)]
    rows += [(90, "http://other.example/1", page(1)), (91, None, page(2)), (92, "http://host.example/e", ""), (93, "http://host.example/n", None), (None, "x", "<p>q</p>")]
    df = spark.createDataFrame([(*r, "h", "t") for r in rows], "page_id long, url string, html string, host string, template string")
    got = {r.page_id: r for r in htm.extract(df).collect()}
    assert all(got[k].text == f"story {k} about {k * 7}" for k in range(8)) and got[55].text == "story 0 about 0"
    assert got[90].text == got[90].text and "Welcome" in got[90].text and "Welcome" in got[91].text  # too few pages to tell
    assert got[92].text == got[93].text == "" and got[93].n_chars == 0 and got[None].text == "q" and got[90].url == "http://other.example/1"
    classes = htm.templates(df).collect()
    assert {r.host for r in classes} == {"host.example"} and max(len(r.tokens) for r in classes) >= 3
    # html is outermost; the class of body and of what it holds nests in it
    named = {r["class"] for r in classes}
    assert {r.parent for r in classes if r.parent is not None} <= named and any(r.parent is None for r in classes)
    assert htm.extract(df.limit(0)).count() == 0


def test_template_classes_by_brute_force(spark):
    """Classes are the valid tokens with equal occurrence vectors under one element, counted page by page."""
    rng = np.random.default_rng(12)
    story = lambda: " ".join(f"w{rng.integers(0, 9000)}" for _ in range(40))
    pages = []
    for k in range(24):
        extra = "<div class='x'><p>On some pages</p><i>x</i></div>" if k % 2 else ""
        lists = "".join(f"<li>{story()[:9]}</li>" for _ in range(int(rng.integers(1, 4))))
        pages.append((k, f"http://h{k % 2}.example/{k}", f"<html><body><div class='top'>Welcome</div>{extra}<ul>{lists}</ul><article><p>{story()}</p><p>Read on</p></article></body></html>"))
    got = {(r.host, frozenset(r.tokens)): frozenset(r.blocks) for r in htm.templates(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    want, signed = {}, lambda x: x - (1 << 64) if x >= 1 << 63 else x
    for host in ("h0.example", "h1.example"):
        own = [htm.page_tokens(*htm.parse(h)) for _, u, h in pages if host in u]
        vectors = {t: tuple(p[t][0] if t in p else 0 for p in own) for p in own for t in p}
        about = {t: p[t][1:] for p in own for t in p}
        classes: dict = {}
        for t, v in vectors.items():
            around, block = about[t]
            room = sum(x > 0 for x in vectors[around]) if around else len(own)
            if room >= htm.PAGES and sum(x > 0 for x in v) >= htm.SUPPORT * room:
                classes.setdefault((v, vectors[around] if around else None), []).append((t, block))
        for some in classes.values():
            want[(host, frozenset(signed(t) for t, _ in some))] = frozenset(signed(t) for t, block in some if block)
    assert got == want and sum(map(bool, want.values())) >= 3


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline as p

    bench = spark.createDataFrame([(0, "zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau")], "item_id long, text string")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    leak = spark.createDataFrame([(5000, "some words before zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau and after", "en", "s", 0)], docs.select(columns).schema)
    docs.select(columns).union(leak).write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    sizes = [at.count()]
    for name, stage in p.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == columns, name
        at.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        sizes.append(at.count())
    assert sizes == sorted(sizes, reverse=True)
    ids = [r.doc_id for r in at.collect()]
    assert 5000 not in ids and 1001 not in ids and 1007 not in ids and len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    assert {r.lang for r in at.select("lang").distinct().collect()} == {"en", "de"}
    out = p.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == set(ids)


def test_pipeline_of_nothing(spark, empty, tmp_path):
    import corpus_pipeline as p

    empty.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0

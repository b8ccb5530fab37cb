import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from webloom.functions import dom
from webloom.operators import batches, chunks, links, nodes, sections
from webloom.operators.nodes import explode_nodes, parse_nodes

BASE = "https://shop.example.com/a/b?c=1"
LINK_CASES = {
    '<a href="x"><a href="/x"><a href="//cdn.example.com/x">': [
        ("links", "https://shop.example.com/a/x"), ("links", "https://shop.example.com/x"),
        ("links", "//cdn.example.com/x")],
    '<a href="#t"><a href="mailto:a"><a href="tel:1"><a href="javascript:x"><a href="">': [],
    '<a href="/x"><a href="/y"><a href="/x">': [
        ("links", "https://shop.example.com/x"), ("links", "https://shop.example.com/y")],
    '<a href="/p?a=1&amp;b=2">': [("links", "https://shop.example.com/p?a=1&b=2")],
    '<img src="data:image/png;base64,AA">': [],
    '<source srcset="/0.png"><img srcset="/1.png 1x, /2.png 2x" src="/3.png">': [
        ("images", "https://shop.example.com/3.png"), ("images", "https://shop.example.com/0.png"),
        ("images", "https://shop.example.com/1.png"), ("images", "https://shop.example.com/2.png")],
    '<link rel="shortcut icon" href="/f.ico"><link rel="next" href="/n">': [
        ("stylesheets", "https://shop.example.com/f.ico")],
    '<link rel="canonical" href="/c">': [("other", "https://shop.example.com/c")],
    """<div style="background-image: url('/bg.png')">""": [("other", "https://shop.example.com/bg.png")],
    '<meta http-equiv="Refresh" content="5; url=/n">': [("other", "https://shop.example.com/n")],
    '<form action="/s"><iframe src="/i"></iframe><video src="/v"></video><source src="/w">': [
        ("forms", "https://shop.example.com/s"), ("media", "https://shop.example.com/v"),
        ("media", "https://shop.example.com/w"), ("iframes", "https://shop.example.com/i")],
    """<script src="/s.js">var t="<a href='/no'>";</script>""": [("scripts", "https://shop.example.com/s.js")],
    "<p><b>open<p>again</div>": [],
}


def random_html(rng):
    tags = ["div", "p", "b", "span", "nav", "footer", "aside", "main", "article", "svg", "form"]
    attrs = ["", "", ' class="menu"', ' class="icon  content"', ' id="price"', ' role="main"', ' data-price="1"',
             ' class="sidebar" title="a &quot;b&quot; \'c\'"', ' name="prices" style="x"']
    out = [rng.choice(["<!DOCTYPE html><html>", "<!DOCTYPE html>\n <body>", "", "<body>"])]
    for _ in range(rng.randint(0, 25)):
        roll = rng.random()
        if roll < 0.4:
            out.append(f"<{rng.choice(tags)}{rng.choice(attrs)}>")
        elif roll < 0.7:
            out.append(f"</{rng.choice(tags)}>")
        else:
            out.append(rng.choice(["text", " ", "\n ", "Price &amp; more", "a < b", "<br>", '<img alt="" src="/x">',
                                   "<input name='q'>", "<!-- price -->", "<hr/>", "longer words here"]))
    return "".join(out)


@pytest.fixture(scope="module")
def random_pages(spark):
    rng = random.Random(3)
    rows = [(i, BASE, random_html(rng)) for i in range(300)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)


def pages_of(spark, htmls):
    return spark.createDataFrame([(i, BASE, h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def test_link_rules(spark):
    rows = links.url_extract(pages_of(spark, LINK_CASES)).collect()
    order = {c: i for i, c in enumerate(links.CATEGORIES)}
    for i, (html, expected) in enumerate(LINK_CASES.items()):
        got = sorted((order[r.category], r.pos, r.category, r.url) for r in rows if r.page_id == i)
        assert [(c, u) for _, _, c, u in got] == sorted(expected, key=lambda e: order[e[0]]), html


def test_all_urls_is_the_distinct_of_all_categories(spark):
    pages = pages_of(spark, LINK_CASES)
    extracted = {(r.page_id, r.url) for r in links.url_extract(pages).collect()}
    listed = links.all_urls(pages).orderBy("page_id", "pos").collect()
    assert [(r.page_id, r.url) for r in listed] == sorted(extracted)


def test_without_base_links_stay_as_written(spark):
    rows = links.url_extract(pages_of(spark, ['<a href=" /x "><a href="y">']), base=None).orderBy("pos").collect()
    assert [r.url for r in rows] == ["/x", "y"]


def test_null_page_gives_no_nodes(spark):
    assert parse_nodes(pages_of(spark, [None])).first().nodes == []


def test_nodes_agree_with_a_plain_tree(random_pages):
    rows, df = random_pages
    parsed = {r.page_id: r for r in parse_nodes(df).select(
        "page_id", "nodes", F.expr(dom.render_html("nodes")).alias("html"),
        F.expr(dom.rendered_length("nodes")).alias("n")).collect()}
    for page_id, _, html in rows:
        tree, row = brute.parse(html), parsed[page_id]
        expected = [(n.kind, n.tag if n.kind == "element" else None) for n in tree.walk()]
        assert [(n.kind, n.tag if n.kind == "element" else None) for n in row.nodes[1:]] == expected, html
        assert row.html == tree.html() and row.n == len(row.html), html
        for n in row.nodes[1:]:
            parent = row.nodes[n.parent_id]
            assert parent.id < n.id <= n.last_id <= parent.last_id and n.depth == parent.depth + 1


def test_rendered_pages_parse_back_to_themselves(random_pages):
    _, df = random_pages
    once = parse_nodes(df).selectExpr("page_id", f"{dom.render_html('nodes')} AS html")
    twice = parse_nodes(once).selectExpr("page_id", f"{dom.render_html('nodes')} AS html2")
    # The line end a doctype is written with may join white space behind it, so white space is left out.
    differ = r"regexp_replace(html, '[ \n]', '') <> regexp_replace(html2, '[ \n]', '')"
    assert once.join(twice, "page_id").filter(differ).count() == 0


# Sections of a page for the field ``price``, written by hand.
SECTION_CASES = {
    '<html><body><div id="price-box"><b>1</b></div><p>other</p></body></html>': '<div id="price-box"><b>1</b></div>',
    '<body><form action="/s"><input name="q"></form></body>':
        '<form action="/s"><input name="q"/></form>\n<input name="q"/>',
    "<html><body><p>a</p></body></html>": "<body><p>a</p></body>",
    "<p>a</p>": "<p>a</p>",
    "<body><div><section><p>the PRICE is 3</p></section></div></body>":
        "<div><section><p>the PRICE is 3</p></section></div>",
    '<body><main><i class="price">1</i></main></body>': '<i class="price">1</i>\n<main><i class="price">1</i></main>',
    '<body><div class="content"><article id="content">x</article></div></body>':
        '<div class="content"><article id="content">x</article></div>\n<article id="content">x</article>',
    '<body><p name="prices">1</p><p role="main">2</p></body>': '<p name="prices">1</p>\n<p role="main">2</p>',
}
# Filtered pages for the field ``price``: (page, budget in tokens, expected HTML, whether the end was cut).
LONG = "n" * 80
FILTER_CASES = [
    ('<main data-x="1" class="a" href="/x"><a href="/l" title="t">x</a></main>', 99,
     '<main class="a"><a title="t">x</a></main>', False),
    ('<main data-price-old="1" data-field="f" style="s"><img src="/i" alt="cup"></main>', 99,
     '<main data-price-old="1" data-field="f"><img alt="cup"/></main>', False),
    (f"<main><nav>{LONG}</nav><p>keep</p></main>", 10, "<main><p>keep</p></main>", False),
    (f"<main><footer>{LONG}</footer><svg>s</svg><p>keep</p></main>", 10, "<main><p>keep</p></main>", False),
    (f"<main><nav>short</nav><p>{LONG}</p></main>", 10, f"<main><p>{'n' * 31}...", True),
    (f'<main><img alt="" src="/x"><p>{"k" * 20}</p><nav>last</nav></main>', 14,
     f"<main><p>{'k' * 20}</p><nav>last</nav></main>", False),
    (f'<main><div class="sidebar">{LONG}<nav>n</nav></div><p>keep</p></main>', 10, "<main><p>keep</p></main>", False),
    ("<script>x</script><main>a<!-- b --></main>", 99, "<main>a</main>", False),
]


def test_relevant_sections(spark):
    got = {r.page_id: r.html for r in sections.relevant_sections(pages_of(spark, list(SECTION_CASES)), ["price"]).collect()}
    assert got == dict(enumerate(SECTION_CASES.values()))


@pytest.mark.parametrize("page,budget,expected,cut", FILTER_CASES)
def test_filter_html(spark, page, budget, expected, cut):
    row = sections.filter_html(pages_of(spark, [page]), ["price"], budget).first()
    assert (row.html, row.truncated) == (expected, cut)


def test_an_element_with_a_keyword_is_not_removed(spark):
    page = f'<main><nav>{LONG}</nav><aside id="a">the price</aside><aside id="b">{LONG}</aside></main>'
    html = sections.filter_html(pages_of(spark, [page]), ["price"], 40).first().html
    assert 'id="a"' in html and 'id="b"' not in html and "<nav>" not in html


@pytest.mark.parametrize("budget", [10, 30, 60, 20_000])
def test_filtered_pages_hold_what_they_promise(random_pages, budget):
    _, df = random_pages
    fields = ["price", "image_url"]
    whole = {r.page_id: r for r in sections.filter_html(df, fields, 10 ** 6).collect()}
    got = {r.page_id: r for r in sections.filter_html(df, fields, budget).collect()}
    allowed = {*dom.KEPT_ATTRIBUTES, "data-price", "data-image_url"}
    assert set(got) == set(whole)
    for page_id, row in got.items():
        full = whole[page_id].html
        assert len(row.html) <= 4 * budget + 3 * row.truncated
        assert row.truncated == row.html.endswith("...") or not row.truncated
        tree = brute.parse(row.html if not row.truncated else full)
        assert all(set(n.attrs) <= allowed for n in tree.walk() if n.kind == "element")
        if len(full) <= 4 * budget:
            assert row.html == full and not row.truncated
        elif not row.truncated:
            # What is left stood there before, in the same order.
            rest = iter(full)
            assert all(char in rest for char in row.html)
            assert ("price" in brute.parse(full).string().lower()) == ("price" in tree.string().lower())


def test_drop_subtrees_leaves_exactly_the_outside(random_pages):
    _, df = random_pages
    nodes = explode_nodes(parse_nodes(df)).select("page_id", "id", "last_id", "tag", "kind")
    bad = nodes.filter("kind = 'element' AND tag IN ('div', 'p')").selectExpr(
        "page_id", "id AS lo", "last_id AS hi")
    expected = nodes.join(bad, (nodes.page_id == bad.page_id) & (nodes.id >= bad.lo) & (nodes.id <= bad.hi),
                          "left_anti").select("page_id", "id")
    got = explode_nodes(sections.drop_subtrees(df, dom.by_tag("div", "p"))).select("page_id", "id")
    assert got.exceptAll(expected).count() == 0 and expected.exceptAll(got).count() == 0


def test_data_values_are_searched_only_on_request(spark):
    pages = pages_of(spark, ['<i data-k="price">1</i><b>2</b>'])
    assert sections.relevant_nodes(pages, ["price"]).count() == 0
    assert [r.tag for r in sections.relevant_nodes(pages, ["price"], data_values=True).collect()] == ["i"]


def test_html_to_text(spark):
    html = ("<title>no</title><nav><p>no</p></nav><div> one\n two <!-- no --><script>no</script><span>three</span>"
            "<header>no</header></div><section>no<p>four &amp; five</p></section><ul><li>item</li></ul>")
    pages = pages_of(spark, [html])
    assert chunks.html_to_text(pages).first().text == "one two three four & five"
    assert chunks.html_to_text(pages, chunks.TEXT_FILE_TAGS).first().text == "one two three four & five item"


@pytest.mark.parametrize("size,overlap", [(10, 3), (25, 10), (7, 0), (60, 20)])
def test_chunks_agree_with_the_slow_version(spark, size, overlap):
    rng = random.Random(size)
    alphabet = ["a", "bb", "ccc", " ", " ", "\n", "\n\n", "longwordwithoutend", "é"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "page_id long, text string")
    got = {}
    for r in chunks.chunk_text(df, size=size, overlap=overlap).orderBy("page_id", "chunk_no").collect():
        got.setdefault(r.page_id, []).append(r.chunk)
    for i, text in enumerate(texts):
        assert got.get(i, []) == brute.chunks(text, size, overlap), repr(text)
        assert all(len(c) <= size for c in got.get(i, []))


def test_product_chunk_filter(spark):
    df = spark.createDataFrame([(1, "a $5"), (2, "ADD TO CART"), (3, "an item"), (4, "nothing")], "id int, chunk string")
    assert [r.id for r in chunks.filter_product_chunks(df).orderBy("id").collect()] == [1, 2]
    more = chunks.filter_product_chunks(df, chunks.PRODUCT_FILE_INDICATORS)
    assert [r.id for r in more.orderBy("id").collect()] == [1, 2, 3]


def test_plain_reader_and_parser_build_the_same_tree():
    from webloom.operators import nodes as N

    def tree(page, read):
        rows, last_ids = [], []
        built = N._Tree(rows, last_ids, True, {"p": 1, "b": 2})
        done = read(page, built)
        built.finish()
        return done, rows, last_ids

    def with_parser(page, built):
        parser = N._Events(built)
        parser.feed(page)
        parser.close()
        return True

    atoms = ["<p>", "</p>", '<b class="a  b">', "<B>", "</B >", "<br/>", "<img src=x>", '<img src="/x" alt="">',
             "<i a='1' b>", "text", "&amp;", "&amp", "&", "&copy;", "&#65;", "&#x41", "<", ">", "a<b", "<!-- c -->",
             "<!-- a--b -->", "<!---->", "<!-->", "<!DOCTYPE html>", "<script>", "</script>", "<SCRIPT>x</SCRIPT>",
             '<script>var a="</p>";</script>', "<style>p</style>", "<title>a &amp; b</title>", "<title><b></title>",
             '<a href="/x?a=1&amp;b=2">', '<a href="/x?a=1&copy=2">', "\n", " ", "<x-y>", "<a/>", "<p / >", "<?php x?>",
             "<![CDATA[x]]>", "</>", '<a b="1"c="2">', '<a b=">">', "\xa0", "<a B='X' b=\"y\">", "<textarea>\n x</textarea>"]
    rng = random.Random(9)
    plain = 0
    for _ in range(20_000):
        page = "".join(rng.choice(atoms) for _ in range(rng.randint(0, 6)))
        done, *quick = tree(page, N._read_plain)
        plain += done
        if done:
            assert quick == list(tree(page, with_parser)[1:]), page
    assert plain > 3000


def test_a_piece_holds_little_whatever_the_table():
    """A worker parses pieces of a large batch: what it holds for one of them does not grow with the batch."""
    page = "<body>" + "".join(f'<div class="card" data-id="{k}"><h2>n {k}</h2><p>b</p></div>' for k in range(200)) + "</body>"
    batch = pa.RecordBatch.from_arrays([pa.array([page] * 150)], ["html"])
    tracemalloc.start()
    sizes = [len(nodes._nodes_array(p.column(0), True, {}, True)) for p in batches.pieces(iter([batch]), 0)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == 150 and peak < 25e6

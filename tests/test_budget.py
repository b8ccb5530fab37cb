"""Budget removal against the plain one-by-one version, and its growth with the number of candidates."""

import math
import random
import time

import pytest

from webloom.functions import dom
from webloom.operators import sections
from webloom.operators.nodes import parse_nodes

TAGS = ("div", "span", "section", "nav", "aside", "footer", "svg", "p")
CLASSES = ("", "icon", "menu", "sidebar", "footer", "decoration", "plain", "navigation main", "breadcrumb", "aside")
WORDS = ("price", "pr", "ice", "home", "cart", "sale", "PRICE", "icon")


def random_page(rng, depth=0):
    parts = []
    for _ in range(rng.randint(1, 4)):
        roll = rng.random()
        if roll < 0.35 or depth > 4:
            parts.append(" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 3))))
        elif roll < 0.45:
            parts.append('<img alt="" src="a.png">' if rng.random() < 0.7 else '<img alt="x">')
        else:
            tag, cls = rng.choice(TAGS), rng.choice(CLASSES)
            attr = f' class="{cls}"' if cls else ""
            parts.append(f"<{tag}{attr}>{random_page(rng, depth + 1)}</{tag}>")
    return "".join(parts)


def plain_budget(nodes, lens, keywords, max_tokens):
    """Ids of the nodes that stay: candidates in group order, each removed unless the page fits or it is gone."""
    whole = sum(lens)
    if math.ceil(whole / 4) <= max_tokens:
        return [n["id"] for n in nodes]

    def cls(n, name):
        return f" {name} " in f" {(n['attrs'] or {}).get('class') or ''} "

    def tag(n, *names):
        return n["kind"] == "element" and n["tag"] in names

    groups = [
        [lambda n: tag(n, "svg"), lambda n: tag(n, "img") and (n["attrs"] or {}).get("alt") == "",
         lambda n: cls(n, "icon"), lambda n: cls(n, "decoration")],
        [lambda n: tag(n, "nav"), lambda n: cls(n, "navigation"), lambda n: cls(n, "menu"), lambda n: cls(n, "breadcrumb")],
        [lambda n: tag(n, "footer"), lambda n: cls(n, "footer")],
        [lambda n: cls(n, "sidebar"), lambda n: cls(n, "aside"), lambda n: tag(n, "aside")],
    ]
    some = [n for n in nodes if n["kind"] == "element" and (n["attrs"] or n["tag"] in ("svg", "nav", "footer", "aside"))]

    def text(n):
        inner = nodes[n["id"]:n["last_id"] + 1]
        return "".join(t["text"] for t in inner if t["kind"] in ("text", "cdata") and t["tag"] not in ("script", "style")).lower()

    candidates = [c for group in groups for test in group for c in some if test(c)]
    candidates = [c for c in candidates if not any(w in text(c) for w in keywords)]
    chars, gone = whole, []
    for c in candidates:
        if math.ceil(chars / 4) <= max_tokens:
            break
        if any(a <= c["id"] <= b for a, b, _ in gone):
            continue
        freed = sum(lens[c["id"]:c["last_id"] + 1]) - sum(f for a, _, f in gone if c["id"] <= a <= c["last_id"])
        chars -= freed
        gone.append((c["id"], c["last_id"], freed))
    return [n["id"] for n in nodes if not any(a <= n["id"] <= b for a, b, _ in gone)]


def fitted(spark, htmls, keywords, max_tokens):
    pages = spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string")
    parsed = parse_nodes(pages, keep=("page_id",)).selectExpr(
        "page_id", "nodes", f"transform(nodes, n -> length({dom.open_token('n')}) + length({dom.close_token('n')})) AS lens")
    words = f"array({', '.join(repr(w) for w in keywords)})" if keywords else "cast(array() AS array<string>)"
    return sections.fit_to_budget(parsed, "nodes", words, max_tokens, "fitted").selectExpr(
        "page_id", "nodes", "lens", "transform(fitted, n -> n.id) AS kept")


@pytest.mark.parametrize("keywords", [(), ("price",), ("price", "ice", "cart")])
def test_budget_removal_agrees_with_the_plain_version(spark, keywords):
    rng = random.Random(len(keywords))
    htmls = [random_page(rng) for _ in range(150)] + ["", "<p>pr<b>ice</b></p><nav>pr</nav><nav>ice</nav>" * 30]
    rows = fitted(spark, htmls, keywords, 12).collect()
    assert len(rows) == len(htmls)
    for r in rows:
        nodes = [n.asDict() for n in r["nodes"]]
        assert r["kept"] == plain_budget(nodes, r["lens"], keywords, 12), r["page_id"]


def test_budget_removal_grows_with_the_page(spark):
    """8,000 -> 16,000 decorative images at most doubles the time above a tiny page's (half a second of noise allowed:
    both stay near the fixed time of a job; a quadratic removal took 7 s for 8,000)."""
    def timed(n):
        html = "<main><p>price 10</p>" + '<img alt="" src="i.png">' * n + "</main>"
        started = time.time()
        row = fitted(spark, [html], ("price",), 10).first()
        return time.time() - started, row

    timed(10)
    base, _ = timed(10)
    small, row = timed(8000)
    large, row = timed(16000)
    assert len(row["kept"]) < 16000
    assert large - base <= 2.2 * max(small - base, 0.05) + 0.5, (base, small, large)

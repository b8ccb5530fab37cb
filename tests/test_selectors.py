"""Selector texts against a plain walk of the tree."""

import random
import re

import pytest
from pyspark.sql import functions as F

import brute
from test_documents import random_html
from webloom.functions import dom
from webloom.operators.nodes import parse_nodes

SELECTORS = ["div", "div p", "div > p", "nav .menu", "main > div.content, aside", "[data-price]", "#price",
             "div [name^=pri]", "* > b", ".icon.content", "form input[name='q']", "body > div > p, span b",
             "[class~=content]", "[title$='c\\'']", "p, p"]


def _matches(node, compound):
    if node.kind != "element":
        return False
    for m in dom._PART.finditer(compound):
        if m["tag"] and m["tag"] != "*" and node.tag != m["tag"].lower():
            return False
        classes = (node.attrs.get("class") or "").split()
        if m["cls"] and m["cls"] not in classes:
            return False
        if m["id"] and node.attrs.get("id") != m["id"]:
            return False
        if m["attr"]:
            name, op, value = m["attr"].lower(), m["op"], m["value"]
            if value and value[0] in "\"'":
                value = value[1:-1]
            have = node.attrs.get(name)
            if have is None:
                return False
            if op == "=" and have != value or op == "*=" and (not value or value not in have) \
                    or op == "^=" and (not value or not have.startswith(value)) \
                    or op == "$=" and (not value or not have.endswith(value)) or op == "~=" and value not in have.split(" "):
                return False
    return True


def plain_select(tree, selector):
    nodes = list(tree.walk())
    chosen = set()
    for group in selector.split(","):
        tokens = re.findall(r">|[^\s>]+", group.strip())
        chain, combinator = [], ""
        for t in tokens:
            if t == ">":
                combinator = ">"
                continue
            chain.append((combinator if chain else "", t))
            combinator = " "

        def ok(node, k):
            if not _matches(node, chain[k][1]):
                return False
            if k == 0:
                return True
            up = node.parent
            if chain[k][0] == ">":
                return up is not None and ok(up, k - 1)
            while up is not None:
                if ok(up, k - 1):
                    return True
                up = up.parent
            return False

        chosen |= {i for i, n in enumerate(nodes) if ok(n, len(chain) - 1)}
    return sorted(chosen)


@pytest.mark.parametrize("selector", SELECTORS)
def test_selectors_agree_with_a_plain_walk(spark, selector):
    rng = random.Random(11)
    rows = [(i, random_html(rng)) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, html string")
    got = {r.page_id: [n - 1 for n in r.ids] for r in parse_nodes(df, keep=("page_id",)).select(
        "page_id", F.expr(f"transform({dom.select_css('nodes', selector)}, n -> n.id)").alias("ids")).collect()}
    for page_id, html in rows:
        assert got[page_id] == plain_select(brute.parse(html), selector), (selector, html)


def test_bad_selectors_are_refused():
    for bad in ("", "div,", "a[", "p::after"):
        with pytest.raises(ValueError):
            dom.select_css("nodes", bad)

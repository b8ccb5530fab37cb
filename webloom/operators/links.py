"""URLs of pages: twelve extraction rules, first-seen order, categories and product links.

A page's links are collected, normalised and deduplicated inside its row, so none of this shuffles; only totals over
many pages do, after partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import dom
from webloom.functions.sql import bind, strip, text, texts
from webloom.functions.text import PRODUCT_URL_WORDS, contains_any
from webloom.functions.urls import is_valid_url, normalize_url
from webloom.operators.nodes import parse_nodes

# The categories, in report order.
CATEGORIES = ("links", "images", "scripts", "stylesheets", "forms", "media", "iframes", "other")
# URLs inside style, srcset and refresh attributes.
BACKGROUND_IMAGE = r"""(?i)background-image\s*:\s*url\(["']?([^"')\s]+)["']?\)"""
SRCSET = r"([^\s,]+)(?:\s+[0-9.]+[wx])?"
REFRESH = r"(?i)url=([^;]+)"

_HREF, _REL = dom.attr("n", "href"), dom.attr("n", "rel")
_STYLE, _SRCSET = dom.attr("n", "style"), dom.attr("n", "srcset")
_CONTENT = dom.attr("n", "content")


def _all(value: str, pattern: str) -> str:
    return f"regexp_extract_all({value}, {text(pattern)}, 1)"


def _tag_value(attribute: str, *tags: str) -> tuple[str, str]:
    value = dom.attr("n", attribute)
    return f"{dom.by_tag(*tags)('n')} AND {value} <> ''", f"array({value})"


# The rules in the order they are applied: category, which elements, and the raw links of one element.
RULES: tuple[tuple[str, str, str], ...] = (
    ("links", *_tag_value("href", "a")),
    ("images", *_tag_value("src", "img")),
    ("scripts", *_tag_value("src", "script")),
    ("stylesheets", f"n.tag = 'link' AND {_HREF} <> '' AND lower({_REL}) RLIKE 'stylesheet|icon'", f"array({_HREF})"),
    ("forms", *_tag_value("action", "form")),
    ("media", *_tag_value("src", "video", "audio")),
    ("media", *_tag_value("src", "source")),
    ("iframes", *_tag_value("src", "iframe")),
    ("other", f"{_STYLE} <> ''", _all(_STYLE, BACKGROUND_IMAGE)),
    ("images", f"n.tag IN ('img', 'source') AND {_SRCSET} <> ''", _all(_SRCSET, SRCSET)),
    ("other", f"n.tag = 'meta' AND lower({dom.attr('n', 'http-equiv')}) LIKE '%refresh%' "
              f"AND {_CONTENT} RLIKE {text(REFRESH)}",
     f"array({strip(f'regexp_extract({_CONTENT}, {text(REFRESH)}, 1)')})"),
    ("other", f"n.tag = 'link' AND {_HREF} <> '' AND array_contains(split({_REL}, ' '), 'canonical')",
     f"array({_HREF})"),
)


def raw_links(nodes: str) -> str:
    """Array of raw links, rule by rule, each rule in document order. The first character of an entry is the number of
    its category: plain strings are what Spark deduplicates by hash."""
    parts = [
        f"transform(flatten(transform(filter({nodes}, n -> {where}), n -> {links})), "
        f"r -> concat('{CATEGORIES.index(category)}', r))"
        for category, where, links in RULES
    ]
    return f"concat({', '.join(parts)})"


def page_links(pages: DataFrame, base: str | None = "url", keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns plus ``links``: the valid URLs of each page as (category, url), first occurrences only."""
    valid = bind(normalize_url("substring(r, 2)", base), "u", f"if({is_valid_url('u')}, concat(left(r, 1), u), NULL)")
    names = "array(" + texts(CATEGORIES) + ")"
    # Only elements with attributes can hold a link; the rules then scan a short array.
    return (
        parse_nodes(pages, keep=keep, with_text=False, bare=False)
        .selectExpr(*keep, f"array_distinct({raw_links('nodes')}) AS raw")
        .selectExpr(*keep, f"array_distinct(array_compact(transform(raw, r -> {valid}))) AS found")
        .selectExpr(*keep, f"transform(found, f -> named_struct('category', get({names}, cast(left(f, 1) AS INT)), "
                           "'url', substring(f, 2))) AS links")
    )


def _of_category(category: str) -> str:
    return f"transform(filter(links, u -> u.category = '{category}'), u -> u.url)"


def url_extract(pages: DataFrame, base: str | None = "url") -> DataFrame:
    """Rows (page_id, category, pos, url); ``pos`` counts from 0 within page and category."""
    groups = ", ".join(f"named_struct('category', '{c}', 'urls', {_of_category(c)})" for c in CATEGORIES)
    return (
        page_links(pages, base)
        .selectExpr("page_id", f"explode(array({groups})) AS g")
        .selectExpr("page_id", "g.category AS category", "posexplode(g.urls) AS (pos, url)")
    )


def urls_by_page(pages: DataFrame, base: str | None = "url") -> DataFrame:
    """(page_id, urls): a map from each of the eight categories to its URLs."""
    entries = ", ".join(f"'{c}', {_of_category(c)}" for c in CATEGORIES)
    return page_links(pages, base).selectExpr("page_id", f"map({entries}) AS urls")


def sorted_urls(links: str = "links") -> str:
    """Every distinct URL of a page's links, sorted by code point."""
    return f"sort_array(array_distinct(transform({links}, u -> u.url)))"


def all_urls(pages: DataFrame, base: str | None = "url") -> DataFrame:
    """(page_id, pos, url): every distinct URL of a page, sorted by code point."""
    return page_links(pages, base).selectExpr("page_id", f"posexplode({sorted_urls()}) AS (pos, url)")


def filter_product_urls(urls: DataFrame, url: str = "url") -> DataFrame:
    return urls.filter(contains_any(url, PRODUCT_URL_WORDS))


def product_urls(pages: DataFrame, base: str | None = "url") -> DataFrame:
    """(page_id, url): links with a product word, and every image."""
    wanted = (f"filter(links, u -> u.category = 'images' OR "
              f"(u.category = 'links' AND {contains_any('u.url', PRODUCT_URL_WORDS)}))")
    return page_links(pages, base).selectExpr("page_id", f"explode({sorted_urls(wanted)}) AS url")


def url_counts_by_page(pages: DataFrame, base: str | None = "url") -> DataFrame:
    """(page_id, one count per category, total), counted inside the row."""
    counts = [f"size({_of_category(c)}) AS {c}" for c in CATEGORIES]
    return page_links(pages, base).selectExpr("page_id", *counts, "size(links) AS total")


def url_counts_by_category(pages: DataFrame, base: str | None = "url") -> DataFrame:
    """(category, n_urls, n_pages) over all pages, with a ``total`` row from the same pass."""
    names = (*CATEGORIES, "total")
    sums = url_counts_by_page(pages, base).agg(
        *[F.expr(f"sum({c}) AS {c}_urls") for c in names], *[F.expr(f"count_if({c} > 0) AS {c}_pages") for c in names])
    rows = ", ".join(f"named_struct('category', '{c}', 'n_urls', {c}_urls, 'n_pages', {c}_pages)" for c in names)
    return sums.selectExpr(f"inline(array({rows}))")

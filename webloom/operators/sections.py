"""Page sections that matter for target fields, and pages cut to a token budget.

Each page is parsed once. Sections are chosen as node numbers, copied into one renumbered document in hit order, and
every later stage works on that document inside the row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import dom
from webloom.functions.sql import bind, text, text_array, texts
from webloom.functions.text import (
    DEFAULT_TOKEN_BUDGET, count_tokens, field_keywords, strip_irrelevant_html, tokens_for, truncate_budget,
)
from webloom.operators.nodes import explode_nodes, parse_nodes

# Form fields, and where the main content of a page is.
FORM_TAGS = ("form", "input", "select", "textarea", "label")
CONTENT_TAGS = ("main", "article")
CONTENT_SELECTORS = (
    dom.by_tag("main"), dom.with_attr("role", "main"), dom.by_class("main-content"), dom.by_id("main-content"),
    dom.by_class("content"), dom.by_id("content"), dom.by_tag("article"), dom.by_class("article"),
)
FIELD_ATTRIBUTES = ("id", "class", "name")


def keywords_sql(fields: Sequence[str]) -> str:
    return field_keywords(text_array(fields))


def relevant_ids(fields: Sequence[str], data_values: bool = False, nodes: str = "nodes") -> str:
    """SQL array of node numbers, each once, in first-hit order: field attributes, forms, main content, and the
    surroundings of texts that hold a field keyword. ``data_values`` also searches the values of data attributes."""

    def listed(predicate: dom.Predicate) -> str:
        return f"transform({dom.select_elements('some', predicate)}, h -> h.id)"

    by_field = []
    for field in (f.lower() for f in fields):
        by_field += [listed(dom.attr_contains(a, field)) for a in FIELD_ATTRIBUTES]
        if data_values:
            by_field.append(listed(dom.data_attr_contains(field)))
    # Every selector needs an attribute or one of a few tags; the many plain elements are looked at once.
    some = (f"filter({nodes}, n -> n.kind = 'element' AND (size(n.attrs) > 0 OR "
            f"n.tag IN ({texts((*FORM_TAGS, *CONTENT_TAGS))})))")
    chosen = bind(some, "some", "concat(" + ", ".join(
        [*by_field, listed(dom.by_tag(*FORM_TAGS)), *[listed(s) for s in CONTENT_SELECTORS]]) + ")")
    around = (f"transform(filter({nodes}, n -> {dom.text_contains(keywords_sql(fields))('n')}), "
              f"t -> {dom.ancestor_context(nodes, 't')})")
    return f"array_distinct(concat({chosen}, {around}))"


def body_id(nodes: str = "nodes") -> str:
    """Number of the body element, NULL where there is none."""
    return f"get({dom.select_elements(nodes, dom.by_tag('body'))}, 0).id"


def assembled(hits: str, nodes: str = "nodes") -> str:
    """One document of the subtrees of the given nodes, in order, a line end between them, numbered anew."""
    empty = "cast(NULL AS map<string,string>)"
    spans = f"transform({hits}, h -> named_struct('lo', greatest(h, 1), 'hi', get({nodes}, h).last_id))"
    starts = ("aggregate(spans, named_struct('next', 1, 'starts', cast(array() AS array<int>)), (a, s) -> named_struct("
              "'next', a.next + s.hi - s.lo + 2, 'starts', array_append(a.starts, a.next)), a -> a.starts)")
    line_end = (f"named_struct('id', o - 1, 'last_id', o - 1, 'parent_id', 0, 'depth', 1, 'kind', 'text', "
                f"'tag', cast(NULL AS string), 'attrs', {empty}, 'text', '\\n')")
    moved = (f"transform(slice({nodes}, s.lo + 1, s.hi - s.lo + 1), n -> named_struct("
             f"'id', n.id - s.lo + o, 'last_id', n.last_id - s.lo + o, "
             f"'parent_id', if(n.id = s.lo OR n.parent_id < s.lo, 0, n.parent_id - s.lo + o), "
             f"'depth', n.depth - get({nodes}, s.lo).depth + 1, "
             f"'kind', n.kind, 'tag', n.tag, 'attrs', n.attrs, 'text', n.text))")
    inner = f"flatten(zip_with(spans, {starts}, (s, o) -> if(o = 1, {moved}, concat(array({line_end}), {moved}))))"
    root = (f"named_struct('id', 0, 'last_id', size(inner), 'parent_id', cast(NULL AS int), 'depth', 0, "
            f"'kind', 'document', 'tag', cast(NULL AS string), 'attrs', {empty}, 'text', cast(NULL AS string))")
    return bind(spans, "spans", bind(inner, "inner", f"concat(array({root}), inner)"))


def reread(document: str) -> str:
    """An assembled document as it is once its HTML is parsed again: neighbouring white space texts are one, and so is
    the line end a doctype is written with. Numbers stay, so texts that went are empty."""

    def space(node: str) -> str:
        return f"({node}.kind = 'text' AND {node}.parent_id = n.parent_id AND {node}.text RLIKE '^[ \\\\n\\\\t\\\\r\\\\f]+$')"

    before, after = f"get({document}, i - 1)", f"get({document}, i + 1)"
    doctype = "(n.kind = 'doctype' AND n.parent_id = 0)"
    joins = f"coalesce({space(before)} OR ({before}.kind = 'doctype' AND {before}.parent_id = n.parent_id), false)"
    value = f"""CASE
        WHEN {doctype} THEN concat('<!DOCTYPE ', n.text, '>\\n\\n')
        WHEN NOT coalesce({space('n')}, false) THEN n.text
        WHEN {joins} THEN ''
        WHEN coalesce({space(after)} AND contains({after}.text, '\\n'), false) THEN '\\n' ELSE n.text END"""
    return (f"transform({document}, (n, i) -> named_struct('id', n.id, 'last_id', n.last_id, 'parent_id', n.parent_id, "
            f"'depth', n.depth, 'kind', if({doctype}, 'raw', n.kind), 'tag', n.tag, 'attrs', n.attrs, "
            f"'text', {value}))")


def select_elements(pages: DataFrame, predicate: dom.Predicate) -> DataFrame:
    """(page_id, node columns) of the elements that match."""
    parsed = parse_nodes(pages, keep=("page_id",))
    return explode_nodes(parsed.selectExpr("page_id", f"{dom.select_elements('nodes', predicate)} AS nodes"))


def select_css(pages: DataFrame, selector: str) -> DataFrame:
    """(page_id, node columns) of the elements a selector text matches (groups, compound parts, child and descendant),
    each once, in document order."""
    parsed = parse_nodes(pages, keep=("page_id",))
    return explode_nodes(parsed.selectExpr("page_id", f"{dom.select_css('nodes', selector)} AS nodes"))


def match_keyword_text(pages: DataFrame, words: Sequence[str]) -> DataFrame:
    """(page_id, id, text) of texts and comments that hold a keyword of the words."""
    parsed = parse_nodes(pages, keep=("page_id",)).selectExpr(
        "page_id", f"filter(nodes, n -> {dom.text_contains(keywords_sql(words))('n')}) AS nodes")
    return explode_nodes(parsed).select("page_id", "id", "text")


def elements_by_field(pages: DataFrame, fields: Sequence[str],
                      attributes: Sequence[str] = FIELD_ATTRIBUTES) -> DataFrame:
    """(page_id, field, attribute, tag, n): elements whose attribute names a field."""
    hits = ", ".join(
        f"transform({dom.select_elements('nodes', dom.attr_contains(a, f))}, "
        f"n -> named_struct('field', {text(f)}, 'attribute', {text(a)}, 'tag', n.tag))"
        for f in fields for a in attributes)
    rows = parse_nodes(pages, keep=("page_id",), with_text=False).selectExpr(
        "page_id", f"explode_outer(concat({hits})) AS hit").filter("hit IS NOT NULL").select("page_id", "hit.*")
    return rows.groupBy("page_id", "field", "attribute", "tag").agg(F.count("*").alias("n"))


def count_elements(pages: DataFrame, selectors: dict[str, dom.Predicate]) -> DataFrame:
    """(page_id, selector, n) of the selectors with a hit; all of them look at one parse."""
    counts = ", ".join(f"named_struct('selector', {text(name)}, 'n', size({dom.select_elements('nodes', p)}))"
                       for name, p in selectors.items())
    return (
        parse_nodes(pages, keep=("page_id",), with_text=False)
        .selectExpr("page_id", f"inline(array({counts}))").filter("n > 0")
    )


def drop_subtrees(pages: DataFrame, predicate: dom.Predicate) -> DataFrame:
    """(page_id, nodes) without the matching elements and everything inside them."""
    bad = dom.select_elements("nodes", predicate)
    return parse_nodes(pages, keep=("page_id",)).selectExpr(
        "page_id", f"{dom.drop_subtrees('nodes', bad)} AS nodes")


def relevant_nodes(pages: DataFrame, fields: Sequence[str], data_values: bool = False) -> DataFrame:
    """(page_id, pos, node_id, tag) of the relevant sections, in first-hit order."""
    tag = "get(nodes, h).tag"
    return (
        parse_nodes(pages, keep=("page_id",))
        .selectExpr("page_id", f"{relevant_ids(fields, data_values)} AS hits", "nodes")
        .selectExpr("page_id", f"posexplode_outer(transform(hits, h -> named_struct('id', h, 'tag', {tag}))) AS (pos, hit)")
        .filter("pos IS NOT NULL")
        .selectExpr("page_id", "pos", "hit.id AS node_id", "hit.tag AS tag")
    )


def _with_sections(pages: DataFrame, fields: Sequence[str], keep: Sequence[str], html: str) -> DataFrame:
    hits = bind(relevant_ids(fields), "found", f"if(size(found) > 0, found, array(coalesce({body_id()}, 0)))")
    return (
        parse_nodes(pages, html=html, keep=keep)
        .selectExpr(*keep, "nodes", f"{hits} AS hits")
        .selectExpr(*keep, f"{assembled('hits')} AS sections")
    )


def relevant_sections(pages: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(page_id, html): the relevant sections of each page; the body where nothing is relevant, else the page."""
    return _with_sections(pages, fields, ("page_id",), "html").selectExpr(
        "page_id", f"{dom.render_html('sections')} AS html")


def compress_attributes(pages: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(page_id, html) with attributes cut to those that can name or describe a field."""
    return (
        parse_nodes(pages, keep=("page_id",))
        .selectExpr("page_id", f"{dom.compress_attributes('nodes', fields)} AS nodes")
        .selectExpr("page_id", f"{dom.render_html('nodes')} AS html")
    )


def fit_to_budget(df: DataFrame, nodes: str, keywords: str, max_tokens: int, out: str, chars: str | None = None) -> DataFrame:
    """``df`` with column ``out``: the nodes of column ``nodes`` after budget removal (``dom.budget_steps``)."""
    steps = dom.budget_steps(nodes, keywords, max_tokens, chars)
    for name, expr in steps:
        df = df.withColumn(name, F.expr(expr))
    return df.withColumnRenamed(steps[-1][0], out).drop(*[name for name, _ in steps[:-1]])


def filter_html_stages(pages: DataFrame, fields: Sequence[str], max_tokens: int = DEFAULT_TOKEN_BUDGET) -> DataFrame:
    """(page_id, html, tokens after each stage, truncated) of pages cleaned, cut to relevant sections and fitted to a
    budget. ``truncated`` tells where removing elements was not enough and the end of the page was cut."""
    keep = ("page_id", "original", "stripped")
    cleaned = (
        pages.selectExpr("page_id", f"{count_tokens('html')} AS original", f"{strip_irrelevant_html('html')} AS html")
        .selectExpr("page_id", "original", f"{count_tokens('html')} AS stripped", "html")
    )
    compact = (
        _with_sections(cleaned, fields, keep, "html")
        .selectExpr(*keep, f"{tokens_for(dom.rendered_length('sections'))} AS relevant",
                    f"{dom.compress_attributes(reread('sections'), fields)} AS compact")
        .selectExpr(*keep, "relevant", f"{dom.rendered_length('compact')} AS compact_chars", "compact")
        .selectExpr(*keep, "relevant", f"{tokens_for('compact_chars')} AS compressed", "compact", "compact_chars")
    )
    fitted = fit_to_budget(compact, "compact", keywords_sql(fields), max_tokens, "fitted", "compact_chars")
    return (
        fitted.selectExpr(*keep, "relevant", "compressed", f"{dom.render_html('fitted')} AS full_html")
        .selectExpr(*keep, "relevant", "compressed", f"{truncate_budget('full_html', max_tokens)} AS html",
                    f"{count_tokens('full_html')} > {max_tokens} AS truncated")
        .selectExpr("page_id", "html", "original", "stripped", "relevant", "compressed",
                    f"{count_tokens('html')} AS final", "truncated")
    )


def filter_html(pages: DataFrame, fields: Sequence[str], max_tokens: int = DEFAULT_TOKEN_BUDGET) -> DataFrame:
    """(page_id, html, truncated): each page reduced to what can hold the fields, within the token budget."""
    return filter_html_stages(pages, fields, max_tokens).select("page_id", "html", "truncated")


STAGES = ("original", "stripped", "relevant", "compressed", "final")


def stage_token_stats(stages: DataFrame, names: Sequence[str] = STAGES) -> DataFrame:
    """(stage, n_pages, tokens) over all pages, one pass."""
    sums = stages.agg(*[F.sum(n).alias(n) for n in names], F.count("*").alias("n_pages"))
    rows = ", ".join(f"named_struct('stage', '{n}', 'n_pages', n_pages, 'tokens', {n})" for n in names)
    return sums.selectExpr(f"inline(array({rows}))")


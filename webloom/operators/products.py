"""Product sections and product records of pages and texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import dom
from webloom.functions.sql import bind, strip, text
from webloom.functions.text import NAME_LABELS, PRICE_TEXT, clean_product_name, product_matches, unfenced
from webloom.operators.chunks import CHUNK_FILE_CHARS, product_chunks
from webloom.operators.nodes import explode_nodes, parse_nodes
from webloom.schemas import PRODUCT_LIST

# Selectors of product elements in the order tried, and how many sections a page gives at most.
PRODUCT_SELECTORS = (
    dom.by_class("product-item"), dom.by_class("product-card"), dom.by_class("product-tile"),
    dom.with_attr("data-product-id"), dom.by_class("search-result-item"),
)
MAX_SECTIONS = 50
#: Repeated siblings that count as product records where no selector hits, at least.
MIN_RECORDS = 2
# Attributes that hold a product number, in the order tried.
ID_ATTRIBUTES = ("data-product-id", "data-sku", "sku")
HEADING_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6")
PRICE_OR_RANGE = r"\$\d+(?:\.\d{2})?(?:\s*-\s*\$\d+(?:\.\d{2})?)?"

_PRODUCT_TYPE = "struct<name:string,price:string,id:string,image_url:string,description:string>"


def first_matching(nodes: str = "nodes", selectors: Sequence[dom.Predicate] = PRODUCT_SELECTORS) -> str:
    """SQL array of at most one (selector_no, found): the hits of the first selector that has any."""
    tried = ", ".join(f"named_struct('selector_no', {i}, 'found', {dom.select_elements(nodes, s)})"
                      for i, s in enumerate(selectors))
    return f"slice(filter(array({tried}), c -> size(c.found) > 0), 1, 1)"


def match_price_text(pages: DataFrame, pattern: str = PRICE_TEXT) -> DataFrame:
    """(page_id, node_id, parent_id, text) of text nodes that show a price."""
    parsed = parse_nodes(pages, keep=("page_id",)).selectExpr(
        "page_id", f"filter(nodes, n -> {dom.text_matches(pattern)('n')}) AS nodes")
    return explode_nodes(parsed).selectExpr("page_id", "id AS node_id", "parent_id", "text")


def repeated_records(nodes: str = "nodes", least: int = MIN_RECORDS) -> str:
    """SQL array of the product records of a page found by structure: sibling elements of one shape (the tag paths of
    their subtrees) that hold a price text, the longest such run of siblings, at least ``least`` of them; empty where
    there is none. Price texts are counted by a prefix sum, and runs by one pass over candidates sorted by (parent,
    shape), so a page costs n times its depth at most."""
    shape = ("xxhash64(array_join(transform(filter(slice(nodes_, n.id + 1, n.last_id - n.id + 1), "
             "e -> e.kind = 'element'), e -> concat(e.depth - n.depth, ':', e.tag)), ','))")
    price = f"transform(nodes_, t -> if({dom.text_matches(PRICE_TEXT)('t')}, 1L, 0L))"
    counts = dom.scan(price, lambda a, b: f"{a} + {b}")
    candidates = ("transform(filter(nodes_, n -> n.kind = 'element' AND n.id > 0 AND seen[n.last_id] - seen[n.id] > 0), "
                  f"n -> named_struct('parent', n.parent_id, 'shape', {shape}, 'id', n.id))")
    best = ("aggregate(array_sort(cands), named_struct('parent', -1, 'shape', 0L, 'n', 0, 'bp', -1, 'bs', 0L, 'bn', 0, "
            "'bid', 0), (s, c) -> bind_step, s -> s)")
    step = ("transform(array(if(c.parent = s.parent AND c.shape = s.shape, s.n + 1, 1)), k -> named_struct("
            "'parent', c.parent, 'shape', c.shape, 'n', k, "
            "'bp', if(k > s.bn, c.parent, s.bp), 'bs', if(k > s.bn, c.shape, s.bs), 'bn', greatest(k, s.bn), 'bid', 0))[0]")
    chosen = (f"if(b.bn >= {least}, transform(filter(cands, c -> c.parent = b.bp AND c.shape = b.bs), "
              "c -> nodes_[c.id]), slice(nodes_, 1, 0))")
    body = bind(best.replace("bind_step", step), "b", chosen)
    return bind(nodes, "nodes_", bind(counts, "seen", bind(candidates, "cands", body)))


def _with_sections(pages: DataFrame, limit: int | None) -> DataFrame:
    """(page_id, nodes, sections): hits of the first matching selector, else records found by structure (repeated
    siblings of one shape that hold prices), else the elements around price texts."""
    priced = (f"transform(filter(nodes, n -> {dom.text_matches(PRICE_TEXT)('n')}), t -> get(nodes, t.parent_id))")
    found = f"coalesce(get(hits, 0).found, if(size(records) > 0, records, {priced}))"
    return (
        parse_nodes(pages, keep=("page_id",))
        .selectExpr("page_id", "nodes", f"{first_matching()} AS hits")
        .selectExpr("page_id", "nodes", "hits", f"if(size(hits) = 0, {repeated_records()}, slice(nodes, 1, 0)) AS records")
        .selectExpr("page_id", "nodes", f"{found if limit is None else f'slice({found}, 1, {limit})'} AS sections")
    )


def first_matching_selector(pages: DataFrame) -> DataFrame:
    """(page_id, selector_no, n_hits) of the selector used for a page; no row where only price texts can be used."""
    return (
        parse_nodes(pages, keep=("page_id",), with_text=False)
        .selectExpr("page_id", f"explode({first_matching()}) AS hit")
        .selectExpr("page_id", "hit.selector_no AS selector_no", "size(hit.found) AS n_hits")
    )


def extract_product_sections(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """(page_id, pos, node_id, section): the product elements of each page as HTML, all or the first ``limit``."""
    rendered = (f"transform(sections, s -> named_struct('node_id', s.id, "
                f"'section', {dom.render_html(dom.subtree('nodes', 's'))}))")
    return _with_sections(pages, limit).selectExpr("page_id", f"posexplode_outer({rendered}) AS (pos, s)") \
        .filter("pos IS NOT NULL").select("page_id", "pos", "s.*")


def limit_products(pages: DataFrame, limit: int = MAX_SECTIONS) -> DataFrame:
    """The first ``limit`` product sections of each page."""
    return extract_product_sections(pages, limit)


def extract_product_fields(pages: DataFrame, limit: int | None = None, labels: str = NAME_LABELS) -> DataFrame:
    """(page_id, pos, name, price, id, image_url, description) of each product section; what is not there is NULL.
    ``labels`` is the pattern of what is cut from names."""
    heading = f"get({dom.select_elements('part', dom.by_tag(*HEADING_TAGS))}, 0)"
    name = bind(heading, "hd", f"if(hd IS NULL, NULL, {clean_product_name(dom.text_of(dom.subtree('nodes', 'hd')), labels)})")
    number = ", ".join(f"get(transform({dom.select_elements('part', dom.with_attr(a))}, i -> {dom.attr('i', a)}), 0)"
                       for a in ID_ATTRIBUTES)
    image = f"get(filter({dom.select_elements('part', dom.by_tag('img'))}, i -> {dom.attr('i', 'src')} <> ''), 0)"
    paragraphs = (f"transform({dom.select_elements('part', dom.by_tag('p'))}, "
                  f"p -> {strip(dom.text_of(dom.subtree('nodes', 'p')))})")
    longest = ("aggregate(paragraphs, cast(NULL AS string), (best, p) -> "
               "if(p <> '' AND length(p) > coalesce(length(best), 0), p, best))")
    product = f"""named_struct('name', nullif({name}, ''),
        'price', regexp_extract_all({dom.text_of('part')}, {text(PRICE_OR_RANGE)}, 0),
        'id', coalesce({number}), 'image_url', {dom.attr(image, 'src')},
        'description', {bind(paragraphs, 'paragraphs', longest)})"""
    products = f"transform(sections, s -> {bind(dom.subtree('nodes', 's'), 'part', product)})"
    return (
        _with_sections(pages, limit)
        .selectExpr("page_id", f"posexplode_outer({products}) AS (pos, p)").filter("pos IS NOT NULL")
        .selectExpr("page_id", "pos", "p.name AS name", "get(p.price, 0) AS price", "p.id AS id",
                    "p.image_url AS image_url", "p.description AS description")
    )


def extract_products_text(texts: DataFrame, value: str = "text", keep: Sequence[str] = ("id",)) -> DataFrame:
    """``keep`` columns plus (pos, name, price) for every product line of a text."""
    return texts.selectExpr(*keep, f"posexplode_outer({product_matches(value)}) AS (pos, p)") \
        .filter("pos IS NOT NULL").selectExpr(*keep, "pos", "p.name AS name", "p.price AS price")


def _as_products(value: str) -> str:
    missing = "cast(NULL AS string)"
    return (f"transform({product_matches(value)}, m -> named_struct('name', m.name, 'price', m.price, "
            f"'id', {missing}, 'image_url', {missing}, 'description', {missing}))")


def parse_product_response(answers: DataFrame, keep: Sequence[str], response: str = "response",
                           chunk: str = "chunk") -> DataFrame:
    """``keep`` columns plus (products, from_text): the typed product list of an answer, or the products found in the
    chunk itself where the answer is missing or not a product list. An answer may stand in a code fence."""
    schema = PRODUCT_LIST.simpleString()
    parsed = f"from_json({unfenced(response)}, '{schema}').products"
    return (
        answers.selectExpr(*keep, f"{parsed} AS parsed", f"{_as_products(chunk)} AS found")
        .selectExpr(*keep, f"coalesce(parsed, cast(found AS array<{_PRODUCT_TYPE}>)) AS products",
                    "parsed IS NULL AS from_text")
    )


def products(pages: DataFrame, answers: DataFrame | None = None, size: int = CHUNK_FILE_CHARS) -> DataFrame:
    """(page_id, chunk_no, pos, name, price, id, image_url, description) of pages.

    ``answers`` are typed answers per chunk, (page_id, chunk_no, response); chunks without one are read as text.
    """
    chunks = product_chunks(pages, size, from_file=True)
    if answers is None:
        answered = chunks.withColumn("response", F.lit(None).cast("string"))
    else:
        answered = chunks.join(answers.select("page_id", "chunk_no", "response"), ["page_id", "chunk_no"], "left")
    # An outer explode with a filter behind it: a plain one would filter on the list first and build it twice.
    return (
        parse_product_response(answered, ["page_id", "chunk_no"])
        .selectExpr("page_id", "chunk_no", "posexplode_outer(products) AS (pos, p)")
        .filter("pos IS NOT NULL")
        .select("page_id", "chunk_no", "pos", "p.*")
    )

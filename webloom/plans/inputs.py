"""Tables the queries start from, derived by Spark from the given parquet tables.

The test pages hold no products, forms or prices and no robots files, so these are built: a shop page per 60 parts,
product texts per 20 parts, a robots file per host, sitemaps per 100 pages of a host, and a crawl log line per page.
Every table has a SQL twin in ``oracle``, so results can be stated from the given tables alone.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.urls import url_host, url_origin
from webloom.sources import pages as page_source

DEAL_SETTING = "spark.webloom.input.partitions"
PARTS_PER_PAGE = 60
PARTS_PER_TEXT = 20
PAGES_PER_SITEMAP = 100
AGENT = "Mozilla/5.0 (X11; Linux x86_64)"
INTERESTS = ("the", "de", "en/1")

# One shop page: what stands before and after the cards. N is the page number.
SHOP_HEAD = (
    '<!DOCTYPE html><html><head><title>List N</title><link rel="stylesheet" href="/css/N.css">'
    '<link rel="canonical" href="/list/N"><meta http-equiv="refresh" content="5; url=/next/N">'
    '<script src="/js/N.js"></script></head><body><nav class="menu"><a href="/home">Home</a></nav>'
    '<form action="/search/N"><input name="q"></form><main>'
)
SHOP_TAIL = (
    '</main><iframe src="/frame/N"></iframe><video src="/v/N.mp4"></video><source src="/s/N.mp4">'
    '<div style="background-image: url(/bg/N.png)"></div><footer>End</footer></body></html>'
)
# One card. K is the part key; the element around it depends on the page.
CARD_OPEN = ('<div class="product-card" data-product-id="K">', '<div class="product-tile" data-product-id="K">',
             '<div data-product-id="K">', '<div>')
CARD_BODY = (
    '<a href="/p/K"><img src="/img/K.jpg" srcset="/img/K.jpg 1x, /img/K-2.jpg 2x" alt=""></a><h2>NAME</h2>'
    '<p>BRAND TYPE</p><span>$PRICE</span></div>'
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dealt(page_source.read_pages(spark, f"{sf_dir}/pages.parquet"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dealt(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt out to as many partitions as the session asks for, where it does: a test table is one row group, which
    only one core can read. Without the setting rows stay where they are read."""
    asked = rows.sparkSession.conf.get(DEAL_SETTING, None)
    return rows.repartition(int(asked)) if asked else rows


def grouped(rows: DataFrame, key: str) -> DataFrame:
    """Rows placed by the key they are about to be grouped by, on as many partitions as the session asks for: what is
    built from a few bytes here is costly to parse later, and a small shuffle would be merged into too few tasks."""
    asked = rows.sparkSession.conf.get(DEAL_SETTING, None)
    return rows.repartition(int(asked), key) if asked else rows


def url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, url): the page addresses as a list to crawl."""
    return table(spark, sf_dir, "pages").selectExpr("page_id AS pos", "url")


def card_sql(page: str, price: str) -> str:
    """SQL text of one card; runs on Spark and on the engine of the check alike."""
    opens = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CARD_OPEN[:3]))
    body = f"replace(replace(replace('{CARD_BODY}', 'NAME', p_name), 'BRAND', p_brand), 'TYPE', p_type)"
    html = f"(CASE {page} % 4 {opens} ELSE '{CARD_OPEN[3]}' END || replace({body}, 'PRICE', {price}))"
    return f"replace({html}, 'K', cast(p_partkey AS {'STRING' if 'format_string' in price else 'VARCHAR'}))"


def shop_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html): list pages of 60 parts each."""
    price = "format_string('%.2f', p_retailprice)"
    cards = table(spark, sf_dir, "part").selectExpr(
        f"p_partkey DIV {PARTS_PER_PAGE} AS page_id", "p_partkey",
        f"{card_sql(f'(p_partkey DIV {PARTS_PER_PAGE})', price)} AS card")
    built = grouped(cards, "page_id").groupBy("page_id").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(p_partkey, card))), c -> c.card), '')")
        .alias("cards"))
    return built.selectExpr(
        "page_id", "concat('https://shop.example.com/list/', page_id) AS url",
        f"concat(replace('{SHOP_HEAD}', 'N', page_id), cards, replace('{SHOP_TAIL}', 'N', page_id)) AS html")


def product_line_sql(price: str) -> str:
    """SQL text of the name and price of a product line, with labels and ranges mixed in."""
    name = ("CASE WHEN p_partkey % 5 = 0 THEN p_name || ' Top Rated' "
            "WHEN p_partkey % 5 = 1 THEN p_name || ' Save 20%' ELSE p_name END")
    return f"'- ' || {name} || '$' || CASE WHEN p_partkey % 7 = 0 THEN {price} || ' - $' || {price} ELSE {price} END"


def product_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(text_id, text): product lines of 20 parts each."""
    lines = table(spark, sf_dir, "part").selectExpr(
        f"p_partkey DIV {PARTS_PER_TEXT} AS text_id", "p_partkey",
        f"{product_line_sql('format_string(\'%.2f\', p_retailprice)')} AS line")
    return grouped(lines, "text_id").groupBy("text_id").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(p_partkey, line))), l -> l.line), '\\n')")
        .alias("text"))


# The robots file of a host H; hosts with a name of even length also close their German pages.
ROBOTS_BODY = (
    "'# rules' || chr(10) || 'Sitemap: https://' || host || '/sitemap.xml' || chr(10) || chr(10) || "
    "'User-agent: *' || chr(10) || 'Disallow: /fr' || chr(10) || 'Allow: /fr/1' || chr(10) || 'Disallow: /en/2' || "
    "CASE WHEN length(host) % 2 = 0 THEN chr(10) || 'Disallow: /de/' ELSE '' END || chr(10) || chr(10) || "
    "'User-agent: BotA' || chr(10) || 'User-agent: BotB' || chr(10) || 'Disallow: /' || chr(10) || 'Allow: /en' || "
    "chr(10) || 'Crawl-delay: 5 # seconds' || chr(10) || 'no colon here'"
)
ROBOTS_STATUS = "CASE length(host) % 11 WHEN 0 THEN 403 WHEN 1 THEN 404 WHEN 2 THEN NULL ELSE 200 END"


def robots_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(robotstxt_url, body, http_status), one per scheme and host of the pages."""
    hosts = table(spark, sf_dir, "pages").selectExpr(f"{url_origin('url')} AS origin", f"{url_host('url')} AS host").distinct()
    return hosts.selectExpr("origin || '/robots.txt' AS robotstxt_url", f"{ROBOTS_BODY} AS body",
                            f"{ROBOTS_STATUS} AS http_status")


# The log line of a page; every third page was fetched, others ended in some other way or were not tried.
LOG_LINE = (
    "CASE WHEN page_id % 3 = 0 THEN url || ' --> 200 --> crawl/' || page_id || '.html' "
    "WHEN page_id % 15 = 1 THEN url || ' --> 200 --> ERROR_SAVING_HTML' "
    "WHEN page_id % 15 = 2 THEN url || ' --> forbidden by robotstxt for AgentX' "
    "WHEN page_id % 15 = 4 THEN url || ' --> ERROR: 403 Client Error' "
    "WHEN page_id % 15 = 5 THEN url || ' --> ERROR: Read timed out (ReadTimeoutError)' "
    "WHEN page_id % 15 = 7 THEN url || ' --> ERROR: connection reset' "
    "WHEN page_id % 15 = 8 THEN url || ' --> Unreachable' "
    "WHEN page_id % 15 = 10 THEN url || ' --> UNEXPECTED_ERROR: boom' "
    "ELSE 'not tried ' || url END"
)


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, value): one log line per page."""
    return table(spark, sf_dir, "pages").selectExpr("page_id", f"{LOG_LINE} AS value")


def sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sitemap_url, body): XML sitemaps of the pages of a host, at most 100 addresses each."""
    entry = ("concat('<url><loc> ', replace(url, '&', '&amp;'), ' </loc>"
             "<lastmod>2025-06-20T09:33:37.000-07:00</lastmod></url>')")
    listed = table(spark, sf_dir, "pages").selectExpr(
        f"{url_host('url')} AS host", f"page_id DIV {PAGES_PER_SITEMAP} AS part", "page_id", f"{entry} AS entry")
    bodies = listed.groupBy("host", "part").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(page_id, entry))), e -> e.entry), '')")
        .alias("entries"))
    return bodies.selectExpr(
        "concat('https://', host, '/sitemap-', part, '.xml') AS sitemap_url",
        "concat('<?xml version=\"1.0\" encoding=\"UTF-8\"?>', "
        "'<urlset xmlns=\"http://www.sitemaps.org/schemas/sitemap/0.9\">', entries, '</urlset>') AS body")


def work_folder(spark: SparkSession) -> str:
    """A new folder in the shared storage the cluster names. A local one serves only where Spark itself is local: on a
    cluster executors would write to disks that nobody else reads."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="webloom-")
    return os.path.join(shared, uuid.uuid4().hex)

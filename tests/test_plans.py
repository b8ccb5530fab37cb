"""The plans are the ones the operators promise."""

import pytest
from pyspark.sql import functions as F

from webloom.functions import dom
from webloom.operators import chunks, crawl, links, navigate, products, robots, sections
from webloom.sources.pages import read_pages


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages") / "p")
    spark.range(2000).selectExpr("id AS page_id", "concat('https://h', id % 7, '.com/', id) AS url",
                                 "'<p>- a$1.00</p>' AS html").write.parquet(path)
    return read_pages(spark, path)


@pytest.mark.parametrize("build", [
    links.url_extract, links.all_urls, links.product_urls, links.urls_by_page, products.extract_product_sections,
    products.extract_product_fields, products.products, chunks.product_chunks, navigate.page_features,
    lambda p: sections.filter_html(p, ["price"]), lambda p: sections.relevant_sections(p, ["price"]),
    lambda p: navigate.build_prompts(p, "{web_resource}"),
])
def test_page_operators_parse_once_and_do_not_shuffle(pages, build):
    text = plan(build(pages))
    assert "Exchange" not in text
    assert text.count("MapInArrow parse") == 1


def test_link_extraction_reads_only_what_it_needs(pages):
    assert "ReadSchema: struct<page_id:bigint,url:string,html:string>" in plan(links.all_urls(pages))
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan(chunks.html_to_text(pages))


def test_ranking_cuts_before_it_shuffles(pages):
    urls = pages.selectExpr("cast(page_id % 3 AS string) AS site", "url")
    text = plan(navigate.top_urls(navigate.relevant_urls(urls, ["h1"])))
    assert text.count("WindowGroupLimit") == 2


def test_answer_scans_its_input_once(spark, pages):
    urls = pages.selectExpr("cast(page_id % 3 AS string) AS site", "url")
    df = navigate.next_urls(urls, ["h1"])
    assert [len(r.urls) for r in df.collect()] == [10] * 3
    final = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in final or final.split("Initial Plan")[0].count("FileScan") == 1


SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
}


@pytest.fixture
def shuffled(spark):
    before = {k: spark.conf.get(k, None) for k in SKEW}
    for key, value in SKEW.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture(scope="module")
def hot_urls(spark, tmp_path_factory):
    """A third of the rows on one host, a third with one URL."""
    path = str(tmp_path_factory.mktemp("hot") / "u")
    spark.range(200_000).selectExpr("id AS pos", """CASE id % 3 WHEN 0 THEN concat('https://hot.com/', id)
        WHEN 1 THEN 'https://one.com/same' ELSE concat('https://h', id % 5000, '.com/', id) END AS url""") \
        .repartition(8).write.parquet(path)
    return spark.read.parquet(path)


def test_a_hot_host_is_split_in_the_robots_join(shuffled, hot_urls):
    files = hot_urls.selectExpr("regexp_extract(url, '//([^/]+)', 1) AS h").distinct().selectExpr(
        "concat('https://', h, '/robots.txt') AS robotstxt_url", "'User-agent: *\nDisallow: /1' AS body",
        "200 AS http_status")
    df = robots.robots_allowed(hot_urls, files, "Bot").select("pos", "allowed")
    assert df.toArrow().num_rows == 200_000
    assert "skew=true" in plan(df)


def test_a_hot_url_is_split_in_the_visited_join(shuffled, hot_urls):
    log = hot_urls.selectExpr("pos", "if(pos % 2 = 0, url, concat(url, 'x')) AS url")
    df = crawl.unvisited_urls(hot_urls, log).select("pos")
    expected = hot_urls.filter("pos % 2 = 1 AND url <> 'https://one.com/same'").count()
    assert df.toArrow().num_rows == expected
    assert "skew=true" in plan(df)


def test_a_hot_host_is_split_in_the_page_limit(shuffled, hot_urls):
    outcomes = hot_urls.selectExpr("pos", "regexp_extract(url, '//([^/]+)', 1) AS host",
                                   "if(pos % 2 = 0, 'fetched', 'error') AS status")
    df = crawl.max_pages(outcomes, 3).select("pos", "host", "status")
    table = df.toArrow()
    assert "skew=true" in plan(df)
    per_host = df.filter("status = 'fetched'").groupBy("host").count()
    assert per_host.agg(F.max("count")).first()[0] == 3 and table.num_rows > 3


@pytest.mark.parametrize("build", [
    lambda p: sections.drop_subtrees(p, dom.by_tag("nav")).select(F.explode_outer("nodes")),
    lambda p: sections.match_keyword_text(p, ["price"]), products.match_price_text,
    lambda p: sections.select_elements(p, dom.by_class("ad")), products.extract_product_sections,
])
def test_arrays_are_built_once(pages, build):
    assert "(size(" not in "".join(line for line in plan(build(pages)).splitlines() if "Filter" in line)


def test_per_run_limit_has_no_join(pages):
    outcomes = pages.selectExpr("page_id AS pos", "'fetched' AS status")
    df = crawl.max_pages(outcomes, 7, keys=())
    assert df.count() == 7 and "Join" not in plan(df)

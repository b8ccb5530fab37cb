"""The queries: every operator, run over whole tables.

Each function takes (spark, sf_dir) and returns a DataFrame. ``oracle`` states the same results in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import dom
from webloom.functions import robots as R
from webloom.functions import text as X
from webloom.functions import urls as U
from webloom.functions.sql import text
from webloom.operators import chunks, crawl, links, navigate, products, robots, sections
from webloom.operators.nodes import explode_nodes, parse_nodes
from webloom.plans import inputs as I
from webloom.sources import crawl_log, sitemap
from webloom.sources import pages as page_source
from webloom.sources import robots as robots_source
from webloom.streaming import frontier

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FIELDS = ("price", "image_url")
SHOP_WORDS = ("ring", "bolt")
BUDGET = 1000
SHOP_BUDGET = 4000
MAX_PAGES = 3
PROMPT = "Interests: {interests}\nResources: {web_resource}"
EXTRACTION_PROMPT = "HTML: {html_content}\nFormat: {format_instructions}"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__.removeprefix("q_")] = fn
    return fn


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return crawl_log.parse_crawl_log(I.log_lines(spark, sf), pos="page_id")


# --- sources and sinks ----------------------------------------------------------------------------------------------

@query
def q_read_pages(spark, sf):
    return I.pages(spark, sf).selectExpr("page_id", "url", "length(html) AS html_chars", "md5(html) AS html_md5")


@query
def q_read_robots(spark, sf):
    return robots.robots_lines(I.robots_files(spark, sf))


@query
def q_read_sitemap(spark, sf):
    return sitemap.read_sitemap(I.sitemaps(spark, sf)).selectExpr(
        "sitemap_url", "pos", "loc", "unix_seconds(lastmod) AS lastmod_seconds")


@query
def q_read_sitemap_malformed(spark, sf):
    """Sitemaps with a bare ampersand in each address, addresses in CDATA inside prefixed tags with attributes, and the
    end cut off inside a last entry."""
    bare = "replace(replace(body, '</loc>', '?a=1&b=2</loc>'), ' ?a', '?a')"
    cdata = f"replace(replace({bare}, '<loc> ', '<s:loc kind=\"page\"><![CDATA['), '?a=1&b=2</loc>', '?a=1&b=2]]></s:loc>')"
    prefixed = f"replace(replace({cdata}, '<url>', '<s:url>'), '</url>', '</s:url>')"
    broken = I.sitemaps(spark, sf).selectExpr("sitemap_url", f"replace({prefixed}, '</urlset>', '<url><loc>http') AS body")
    return sitemap.read_sitemap(broken).select("sitemap_url", "pos", "loc", "malformed")


@query
def q_read_crawl_log(spark, sf):
    return _log(spark, sf)


@query
def q_read_crawl_json(spark, sf):
    """Results stored as one JSON array per file, an object over several lines."""
    folder = I.work_folder(spark)
    item = ("concat('{\"url\": \"', url, '\",\\n \"crawl_time\": \"2025-06-20 21:41:50\",\\n "
            "\"errors\": \"took longer: ', page_id, '\"}')")
    arrays = I.table(spark, sf, "pages").selectExpr("page_id DIV 1000 AS part", f"{item} AS item") \
        .groupBy("part").agg(F.expr("concat('[', array_join(collect_list(item), ',\\n'), ']')").alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(folder)
    return crawl_log.read_crawl_results(spark, folder).selectExpr(
        "url", "date_format(crawl_time, 'yyyy-MM-dd HH:mm:ss') AS crawl_time", "errors")


@query
def q_write_robots_jsonl(spark, sf):
    folder = I.work_folder(spark)
    rows = robots.robots_rows(I.robots_files(spark, sf), F.expr("timestamp_seconds(1750449787)"))
    robots_source.write_robots_jsonl(rows, folder)
    return robots_source.read_robots_jsonl(spark, folder).selectExpr(
        "directive", "content", "robotstxt_url", "unix_seconds(download_date) AS download_seconds")


@query
def q_write_crawl_log(spark, sf):
    folder = I.work_folder(spark)
    crawl_log.write_crawl_log(_log(spark, sf), folder)
    return crawl_log.read_crawl_log(spark, folder).select("url", "status", "http_status", "file", "detail")


@query
def q_write_pages(spark, sf):
    folder = I.work_folder(spark)
    page_source.write_pages(I.pages(spark, sf).selectExpr("url", "html", "page_id % 3 AS crawl_ts"), folder)
    return spark.read.parquet(folder).selectExpr(
        "page_key", "url", "md5(html) AS html_md5", "cast(crawl_ts AS bigint) AS crawl_ts")


# --- scalar projections ---------------------------------------------------------------------------------------------

# References made of a page's number (P) and its address (U), tried against the address as base.
REFERENCES = ("/a/P", "?q=P", "#f", "x/P", "../up", "./same", "https://other.example/P", "//cdn.example.com/P",
              "  /pad  ", "mailto:P@example.com", "#", "javascript:void(P)")


def _references(spark, sf):
    refs = ", ".join(text(r) for r in REFERENCES)
    return I.url_list(spark, sf).selectExpr("pos AS page_id", "url AS base", f"posexplode(array({refs})) AS (i, r)") \
        .selectExpr("page_id", "base", "i", "replace(r, 'P', page_id) AS ref")


@query
def q_normalize_url(spark, sf):
    return _references(spark, sf).selectExpr("page_id", "i", f"{U.normalize_url('ref', 'base')} AS url")


@query
def q_resolve_url(spark, sf):
    return _references(spark, sf).selectExpr("page_id", "i", f"{U.resolve_url('ref', 'base')} AS url")


@query
def q_is_valid_url(spark, sf):
    return _references(spark, sf).selectExpr("page_id", "i", f"{U.is_valid_url('ref')} AS valid")


@query
def q_strip_irrelevant_html(spark, sf):
    return I.pages(spark, sf).selectExpr("page_id", f"{X.strip_irrelevant_html('html')} AS html") \
        .selectExpr("page_id", "length(html) AS chars", "md5(html) AS html_md5")


@query
def q_html_to_text(spark, sf):
    return chunks.html_to_text(I.pages(spark, sf)).selectExpr("page_id", "length(text) AS chars", "md5(text) AS text_md5")


@query
def q_compress_attributes(spark, sf):
    return sections.compress_attributes(I.shop_pages(spark, sf), ["product"])


@query
def q_render_html(spark, sf):
    return parse_nodes(I.shop_pages(spark, sf), keep=("page_id",)).selectExpr(
        "page_id", f"{dom.render_html('nodes')} AS html")


@query
def q_count_tokens(spark, sf):
    return I.documents(spark, sf).selectExpr("doc_id", f"{X.count_tokens('text')} AS tokens")


@query
def q_truncate_budget(spark, sf):
    return I.documents(spark, sf).selectExpr("doc_id", f"{X.truncate_budget('text', 500)} AS text")


@query
def q_field_keywords(spark, sf):
    fields = I.table(spark, sf, "part").selectExpr(
        "p_partkey", "array(replace(p_name, ' ', '_'), concat(p_type, '-', p_brand)) AS fields")
    return fields.selectExpr("p_partkey", f"explode({X.field_keywords('fields')}) AS keyword")


@query
def q_clean_product_name(spark, sf):
    names = I.table(spark, sf, "part").selectExpr(
        "p_partkey", "concat(if(p_partkey % 2 = 0, 'Top Rated ', ''), p_name, ' Save ', p_size, '%') AS name")
    return names.selectExpr("p_partkey", f"{X.clean_product_name('name')} AS name")


@query
def q_product_price(spark, sf):
    return I.table(spark, sf, "part").selectExpr(
        "p_partkey", f"{X.product_price('format_string(\'%.2f\', p_retailprice)')} AS price")


@query
def q_parse_robots_line(spark, sf):
    lines = robots.robots_lines(I.robots_files(spark, sf))
    return lines.selectExpr("robotstxt_url", "line_no", f"{R.parse_robots_line('value')} AS p").selectExpr(
        "robotstxt_url", "line_no", "p.directive AS directive", "p.content AS content")


@query
def q_robots_url(spark, sf):
    return I.url_list(spark, sf).selectExpr("pos", f"{U.robots_url('concat(' + U.url_origin('url') + ', \'//\')')} AS robots_url")


@query
def q_sitemap_candidates(spark, sf):
    return I.url_list(spark, sf).selectExpr(f"{U.url_origin('url')} AS site").distinct().selectExpr(
        "site", f"posexplode({U.sitemap_candidates('site')}) AS (candidate_no, sitemap_url)")


@query
def q_strip_slashes(spark, sf):
    return I.url_list(spark, sf).selectExpr("pos", f"{U.strip_slashes('concat(\'//\', url, \'/\')')} AS url")


@query
def q_classify_error(spark, sf):
    return _log(spark, sf).filter("status = 'error'").selectExpr(
        "pos", "detail", f"{X.classify_error('detail')} AS error_class")


@query
def q_parse_crawl_line(spark, sf):
    lines = I.log_lines(spark, sf).selectExpr("page_id", f"{crawl_log.parse_crawl_line('value')} AS p")
    return lines.selectExpr("page_id", "p.url AS url", "p.status AS status", "p.http_status AS http_status")


@query
def q_build_prompts(spark, sf):
    return navigate.build_prompts(I.pages(spark, sf), PROMPT, I.INTERESTS)


@query
def q_build_extraction_prompts(spark, sf):
    cut = chunks.chunk_fixed(I.documents(spark, sf), keep=("doc_id",), size=chunks.CHUNK_FILE_CHARS)
    return navigate.build_extraction_prompts(cut, EXTRACTION_PROMPT, "JSON").select("doc_id", "chunk_no", "prompt")


@query
def q_build_url_prompts(spark, sf):
    return navigate.build_url_prompts(_sites(spark, sf), PROMPT, I.INTERESTS, per_prompt=4).selectExpr(
        "site", f"explode(split(replace(prompt, 'Resources: ', '\n'), '\n')) AS line").filter("line LIKE 'http%'")


@query
def q_build_sitemap_prompts(spark, sf):
    located = navigate.sitemap_urls(I.sitemaps(spark, sf))
    return navigate.build_url_prompts(located, PROMPT, I.INTERESTS, per_prompt=10 ** 6).select("site", "prompt")


@query
def q_parse_nav_response(spark, sf):
    """Answers written from page addresses; every fourth lacks its rules and every fifth is no JSON."""
    full = "concat('{\"urls\":[\"', url, '\"],\"rules\":[\"/a\",\"/b\"],\"reasoning\":[\"r', pos, '\"]}')"
    partial = "concat('{\"urls\":[\"', url, '\"],\"reasoning\":[]}')"
    answers = I.url_list(spark, sf).selectExpr(
        "pos", f"CASE WHEN pos % 5 = 0 THEN url WHEN pos % 4 = 0 THEN {partial} ELSE {full} END AS response")
    return navigate.parse_nav_response(answers, ["pos"]).selectExpr(
        "pos", "get(urls, 0) AS url", "array_join(rules, ',') AS rules", "get(reasoning, 0) AS reason", "valid")


@query
def q_parse_product_response(spark, sf):
    """Answers written from parts, every fourth in a code fence; every third is plain text, so its product comes from
    the chunk."""
    price = "format_string('%.2f', p_retailprice)"
    typed = (f"concat(if(p_partkey % 4 = 1, 'Here:\\n```json\\n', ''), '{{\"products\":[{{\"name\":\"', p_name, "
             f"'\",\"price\":\"$', {price}, '\"}}]}}', if(p_partkey % 4 = 1, '\\n```', ''))")
    answers = I.table(spark, sf, "part").selectExpr(
        "p_partkey", f"if(p_partkey % 3 = 0, 'no idea', {typed}) AS response",
        f"{I.product_line_sql(price)} AS chunk")
    return products.parse_product_response(answers, ["p_partkey"]).selectExpr(
        "p_partkey", "from_text", "inline_outer(products)")


# --- filters and predicates -----------------------------------------------------------------------------------------

@query
def q_filter_product_chunks(spark, sf):
    return chunks.filter_product_chunks(chunks.chunk_fixed(I.documents(spark, sf), keep=("doc_id",)))


@query
def q_filter_product_urls(spark, sf):
    everything = links.all_urls(I.shop_pages(spark, sf), base=None).unionByName(links.all_urls(I.pages(spark, sf)))
    return links.filter_product_urls(everything.select("url").distinct())


@query
def q_filter_in_list(spark, sf):
    return crawl.filter_in_list(I.table(spark, sf, "customer"), "c_nationkey", [1, 3, 5]).select(
        "c_custkey", "c_nationkey", "c_mktsegment")


@query
def q_filter_in_list_empty(spark, sf):
    return crawl.filter_in_list(I.table(spark, sf, "nation"), "n_name", [])


@query
def q_filter_directive(spark, sf):
    rows = robots.robots_rows(I.robots_files(spark, sf))
    return robots.filter_directive(rows, "Disallow").select("robotstxt_url", "line_no", "content")


@query
def q_select_elements(spark, sf):
    return sections.select_elements(I.pages(spark, sf), dom.by_class("ad")).select("page_id", "id", "tag")


@query
def q_count_elements(spark, sf):
    return sections.count_elements(I.pages(spark, sf), {
        "nav": dom.by_tag("nav"), "footer": dom.by_tag("footer"), "article": dom.by_tag("article"),
        ".ad": dom.by_class("ad")})


@query
def q_match_price_text(spark, sf):
    return products.match_price_text(I.shop_pages(spark, sf))


@query
def q_match_keyword_text(spark, sf):
    return sections.match_keyword_text(I.shop_pages(spark, sf), SHOP_WORDS)


# --- joins ----------------------------------------------------------------------------------------------------------

@query
def q_unvisited_urls(spark, sf):
    return crawl.unvisited_urls(I.url_list(spark, sf), _log(spark, sf))


@query
def q_robots_allowed(spark, sf):
    return robots.robots_allowed(I.url_list(spark, sf), I.robots_files(spark, sf), I.AGENT)


@query
def q_robots_allowed_written_otherwise(spark, sf):
    """Hosts in capitals, with their usual port or a user, under the other scheme, and addresses that are relative;
    half of the sites also have a second file, which was not found."""
    files = I.robots_files(spark, sf)
    second = files.filter("length(robotstxt_url) % 2 = 0 AND http_status = 200").selectExpr(
        "concat(robotstxt_url, '?again') AS robotstxt_url", "body", "403 AS http_status")
    urls = I.url_list(spark, sf).selectExpr("pos", f"""CASE pos % 5
        WHEN 0 THEN concat('HTTPS://', upper({U.url_host('url')}), {U.url_path('url')})
        WHEN 1 THEN concat('https://', {U.url_host('url')}, ':443', {U.url_path('url')})
        WHEN 2 THEN concat('https://me:pw@', {U.url_host('url')}, {U.url_path('url')})
        WHEN 3 THEN concat('http://', {U.url_host('url')}, {U.url_path('url')})
        ELSE {U.url_path('url')} END AS url""")
    return robots.robots_allowed(urls, files.unionByName(second), I.AGENT)


@query
def q_select_css(spark, sf):
    """Elements of a selector text with groups, child and descendant combinators and attribute tests; no SQL twin (the
    tests hold it against a plain walk of the tree)."""
    return sections.select_css(I.pages(spark, sf), "body div > a[href^='/'], nav a, main p, [data-product-id] span").select(
        "page_id", "id", "tag")


@query
def q_robots_group_for_agent(spark, sf):
    files = I.robots_files(spark, sf)
    groups = [robots.robots_group_for_agent(files, agent).withColumn("agent", F.lit(agent))
              for agent in (I.AGENT, "BotB/1.0")]
    return groups[0].unionByName(groups[1]).selectExpr(
        "site", "agent", "group_no", "array_join(agents, ',') AS agents", "size(rules) AS n_rules")


@query
def q_ancestor_context(spark, sf):
    words = sections.keywords_sql(SHOP_WORDS)
    contexts = (f"transform(filter(nodes, n -> {dom.text_contains(words)('n')}), t -> named_struct("
                f"'text_id', t.id, 'context_id', {dom.ancestor_context('nodes', 't')}))")
    return parse_nodes(I.shop_pages(spark, sf), keep=("page_id",)).selectExpr("page_id", f"inline({contexts})")


@query
def q_drop_subtrees(spark, sf):
    kept = sections.drop_subtrees(I.pages(spark, sf), dom.by_tag("nav", "head", "footer", "article"))
    return explode_nodes(kept).filter("kind = 'element'").select("page_id", "id", "tag")


@query
def q_elements_by_field(spark, sf):
    return sections.elements_by_field(I.shop_pages(spark, sf), ("product", "menu", "q"))


# --- aggregations ---------------------------------------------------------------------------------------------------

@query
def q_robots_summary(spark, sf):
    lists = ("user_agents", "disallowed_paths", "allowed_paths", "sitemaps", "crawl_delay")
    return robots.robots_summary(I.robots_files(spark, sf)).selectExpr(
        "robotstxt_url", "total_rules", *[f"array_join({name}, '|') AS {name}" for name in lists])


@query
def q_url_counts_by_category(spark, sf):
    return links.url_counts_by_category(I.shop_pages(spark, sf))


@query
def q_url_counts_by_page(spark, sf):
    return links.url_counts_by_page(I.pages(spark, sf))


@query
def q_urls_by_page(spark, sf):
    return links.urls_by_page(I.shop_pages(spark, sf)).selectExpr("page_id", "explode_outer(urls) AS (category, list)") \
        .selectExpr("page_id", "category", "array_join(list, ' ') AS urls")


@query
def q_crawl_summary(spark, sf):
    return crawl.crawl_summary(I.url_list(spark, sf), _log(spark, sf))


@query
def q_stage_token_stats(spark, sf):
    stages = sections.filter_html_stages(I.pages(spark, sf), ("ad",), BUDGET)
    return sections.stage_token_stats(stages, ("original", "stripped"))


@query
def q_stage_token_stats_all(spark, sf):
    return sections.stage_token_stats(sections.filter_html_stages(I.pages(spark, sf), ("ad",), BUDGET))


@query
def q_distinct_urls(spark, sf):
    return links.all_urls(I.pages(spark, sf)).select("url").distinct()


# --- windows, sorts, limits -----------------------------------------------------------------------------------------

@query
def q_first_seen_urls(spark, sf):
    return links.url_extract(I.shop_pages(spark, sf))


@query
def q_dedupe_elements(spark, sf):
    return sections.relevant_nodes(I.shop_pages(spark, sf), ("product", "menu"))


@query
def q_first_matching_selector(spark, sf):
    return products.first_matching_selector(I.shop_pages(spark, sf))


@query
def q_first_valid_sitemap(spark, sf):
    """Every sitemap address of a page's site was tried; which ones were found depends on the page."""
    tried = I.url_list(spark, sf).selectExpr(
        "concat(pos, '.example.com') AS site", "pos", "posexplode(array('a.xml', 'b.xml', 'c.xml')) AS (candidate_no, name)")
    fetched = tried.selectExpr("site", "candidate_no", "concat(site, '/', name) AS sitemap_url",
                               "if(candidate_no >= pos % 4, 200, 404) AS http_status",
                               "concat('body ', candidate_no) AS body")
    return sitemap.first_valid_sitemap(fetched)


@query
def q_limit_products(spark, sf):
    sections_ = products.limit_products(I.shop_pages(spark, sf))
    return sections_.groupBy("page_id").agg(F.count("*").alias("n_sections"), F.max("pos").alias("last_pos"))


@query
def q_max_pages(spark, sf):
    outcomes = _log(spark, sf).withColumn("host", F.expr(U.url_host("url")))
    return crawl.max_pages(outcomes, MAX_PAGES).select("pos", "host", "url", "status")


@query
def q_max_pages_per_run(spark, sf):
    return crawl.max_pages(_log(spark, sf), MAX_PAGES, keys=()).select("pos", "url", "status")


@query
def q_max_pages_not_reached(spark, sf):
    """A limit beyond the number of pages keeps every row."""
    return crawl.max_pages(_log(spark, sf), 10 ** 6, keys=()).select("pos", "url", "status")


@query
def q_budget_removal(spark, sf):
    """Elements that stay on the test pages under a tight budget: the navigation goes first, then the footer."""
    parsed = parse_nodes(I.pages(spark, sf), keep=("page_id",))
    kept = sections.fit_to_budget(parsed, "nodes", sections.keywords_sql(("nosuchword",)), BUDGET, "fitted").selectExpr(
        "page_id", "fitted AS nodes")
    return kept.selectExpr("page_id", f"exists(nodes, n -> {dom.by_tag('nav')('n')}) AS has_nav",
                           f"exists(nodes, n -> {dom.by_tag('footer')('n')}) AS has_footer",
                           f"{dom.rendered_length('nodes')} AS chars")


@query
def q_sort_urls(spark, sf):
    return links.all_urls(I.pages(spark, sf))


# --- set operations -------------------------------------------------------------------------------------------------

@query
def q_all_urls(spark, sf):
    return links.all_urls(I.shop_pages(spark, sf)).select("page_id", "url")


@query
def q_product_urls(spark, sf):
    return links.product_urls(I.shop_pages(spark, sf), base=None)


@query
def q_relevant_sections(spark, sf):
    return sections.relevant_sections(I.shop_pages(spark, sf), ("menu",)).selectExpr(
        "page_id", "html")


@query
def q_url_extract(spark, sf):
    return links.url_extract(I.pages(spark, sf))


@query
def q_url_extract_rules(spark, sf):
    return links.url_extract(I.shop_pages(spark, sf)).select("page_id", "category", "url")


# --- chunks and products --------------------------------------------------------------------------------------------

@query
def q_parse_nodes(spark, sf):
    """Nodes of every kind per page: elements by tag, the others (document, doctype, comment, text) by kind alone."""
    nodes = explode_nodes(parse_nodes(I.pages(spark, sf), keep=("page_id",)))
    tag = F.when(F.col("kind") == "element", F.col("tag")).alias("tag")
    return nodes.groupBy("page_id", "kind", tag).agg(F.count("*").alias("n"))


@query
def q_chunk_text(spark, sf):
    lines = I.documents(spark, sf).selectExpr("doc_id", f"{X.collapse_lines('text')} AS text")
    return chunks.chunk_text(lines, keep=("doc_id",)).selectExpr(
        "doc_id", "chunk_no", "length(chunk) AS chars", "md5(chunk) AS chunk_md5")


@query
def q_chunk_text_lines(spark, sf):
    return chunks.chunk_text(I.documents(spark, sf), keep=("doc_id",), size=chunks.CHUNK_FILE_CHARS)


@query
def q_chunk_fixed(spark, sf):
    return chunks.chunk_fixed(I.documents(spark, sf), keep=("doc_id",))


@query
def q_extract_products_text(spark, sf):
    return products.extract_products_text(I.product_texts(spark, sf), keep=("text_id",))


@query
def q_extract_product_sections(spark, sf):
    return products.extract_product_sections(I.shop_pages(spark, sf))


@query
def q_extract_product_fields(spark, sf):
    return products.extract_product_fields(I.shop_pages(spark, sf))


# --- navigation -----------------------------------------------------------------------------------------------------

def _sites(spark, sf):
    return I.url_list(spark, sf).selectExpr(f"{U.url_host('url')} AS site", "url")


@query
def q_score_urls(spark, sf):
    return navigate.score_urls(_sites(spark, sf), I.INTERESTS).select("site", "url", "score")


@query
def q_content_density(spark, sf):
    return navigate.page_features(I.pages(spark, sf)).selectExpr("page_id", "round(content_density, 6) AS density")


@query
def q_structural_score(spark, sf):
    return navigate.page_features(I.pages(spark, sf)).select("page_id", "structural_score")


@query
def q_top_urls(spark, sf):
    return navigate.top_urls(navigate.relevant_urls(_sites(spark, sf), I.INTERESTS)).select(
        "site", "rank", "url", "score")


@query
def q_top_urls_with_features(spark, sf):
    relevant = navigate.relevant_urls(_sites(spark, sf), I.INTERESTS)
    features = navigate.features_of_relevant(I.pages(spark, sf), relevant)
    return navigate.top_urls(relevant, features).select(
        "site", "rank", "url", "score")


@query
def q_derive_rules(spark, sf):
    return navigate.derive_rules(navigate.relevant_urls(_sites(spark, sf), I.INTERESTS))


@query
def q_derive_rules_deep(spark, sf):
    return navigate.derive_deep_rules(navigate.relevant_urls(_sites(spark, sf), I.INTERESTS))


@query
def q_explain_choice(spark, sf):
    return navigate.relevant_urls(_sites(spark, sf), I.INTERESTS).selectExpr(
        "site", "url", f"{navigate.explain_choice()} AS reason")


def _answer(df: DataFrame) -> DataFrame:
    return df.selectExpr("site", "array_join(urls, ' ') AS urls", "array_join(rules, ' ') AS rules",
                         "array_join(reasoning, '; ') AS reasoning")


@query
def q_nav_from_sitemap(spark, sf):
    return _answer(navigate.nav_from_sitemap(I.sitemaps(spark, sf), I.INTERESTS))


@query
def q_nav_from_urls(spark, sf):
    return _answer(navigate.nav_from_urls(I.url_list(spark, sf), I.INTERESTS))


@query
def q_nav_from_pages(spark, sf):
    return _answer(navigate.nav_from_pages(I.pages(spark, sf), I.INTERESTS))


# --- composite pipelines --------------------------------------------------------------------------------------------

@query
def q_filter_html(spark, sf):
    return sections.filter_html(I.shop_pages(spark, sf), ("menu",), SHOP_BUDGET)


@query
def q_filter_html_pages(spark, sf):
    return sections.filter_html(I.pages(spark, sf), FIELDS, BUDGET)


@query
def q_product_chunks(spark, sf):
    return chunks.product_chunks(I.shop_pages(spark, sf), size=1000)


@query
def q_products(spark, sf):
    """Typed answers for the chunks of even pages; the others are read as text."""
    pages = I.product_texts(spark, sf).selectExpr("text_id AS page_id", "concat('<p>', text, '</p>') AS html")
    answers = pages.filter("page_id % 2 = 0").selectExpr(
        "page_id", "0 AS chunk_no", "concat('{\"products\":[{\"name\":\"page ', page_id, '\"}]}') AS response")
    return products.products(pages, answers)


@query
def q_crawl_frontier(spark, sf):
    return crawl.crawl_frontier(I.url_list(spark, sf), _log(spark, sf), I.robots_files(spark, sf), I.AGENT, MAX_PAGES)


@query
def q_crawl_frontier_run(spark, sf):
    return crawl.crawl_frontier(I.url_list(spark, sf), _log(spark, sf), I.robots_files(spark, sf), I.AGENT, MAX_PAGES,
                                keys=())


@query
def q_forbidden_outcomes(spark, sf):
    decided = crawl.crawl_decisions(I.url_list(spark, sf), _log(spark, sf), I.robots_files(spark, sf), I.AGENT)
    return crawl.forbidden_outcomes(decided, I.AGENT).selectExpr(f"{crawl_log.crawl_log_line()} AS line")


@query
def q_robots_report(spark, sf):
    folder = I.work_folder(spark)
    files = I.robots_files(spark, sf)
    robots_source.write_robots_jsonl(robots.robots_rows(files), folder)
    return robots.robots_report(files, robots_source.read_robots_jsonl(spark, folder))


# --- streaming ------------------------------------------------------------------------------------------------------

@query
def q_incremental_frontier(spark, sf):
    """Two runs over two deliveries that overlap; every URL passes once."""
    folder = I.work_folder(spark)
    urls = links.all_urls(I.pages(spark, sf)).select("url", "page_id")
    for half in (0, 1):
        urls.filter(f"page_id % 2 = {half} OR page_id % 3 = 0").select("url").write.mode("append").parquet(f"{folder}/in")
        frontier.incremental_frontier(spark, f"{folder}/in", f"{folder}/passed", f"{folder}/checkpoint") \
            .awaitTermination()
    return frontier.passed_urls(spark, f"{folder}/passed").select("url")

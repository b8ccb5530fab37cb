"""Which URLs of a site to visit next for given interests, and the tables around a model that answers the same.

URLs are (site, url). Scores are row-local; the ranking cuts every site to its first rows before it shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import dom
from webloom.functions.sql import text, text_array
from webloom.functions.text import field_keywords, unfenced
from webloom.functions.urls import url_host, url_path
from webloom.operators.chunks import SKIPPED_TAGS, TEXT_FILE_TAGS
from webloom.operators.links import page_links, sorted_urls
from webloom.operators.nodes import parse_nodes
from webloom.operators.ranking import ranked_per_key
from webloom.schemas import NAVIGATION
from webloom.sources.sitemap import read_sitemap

# Default interests, and how many URLs and rules an answer holds.
INTERESTS = ("climbing", "camping", "hiking")
MAX_URLS = 10
MAX_RULES = 3
MIN_RULE_COUNT = 2
URLS_PER_PROMPT = 500


def _words(interests: Sequence[str]) -> str:
    return field_keywords(text_array(interests))


def score_urls(urls: DataFrame, interests: Sequence[str] = INTERESTS) -> DataFrame:
    """``urls`` plus ``hits``, the interest words a URL contains, and ``score``, how many."""
    return urls.withColumn("hits", F.expr(f"filter({_words(interests)}, w -> contains(lower(url), w))")) \
        .withColumn("score", F.expr("size(hits)"))


def relevant_urls(urls: DataFrame, interests: Sequence[str] = INTERESTS) -> DataFrame:
    """Distinct (site, url) with a direct hit, plus ``hits`` and ``score``.

    Only the two plain columns are shuffled, and words are looked up again behind the shuffle; so ranking and rules
    share one exchange however often this is used.
    """
    direct = urls.select("site", "url").filter(f"exists({_words(interests)}, w -> contains(lower(url), w))")
    return score_urls(direct.distinct(), interests)


def page_features(pages: DataFrame) -> DataFrame:
    """(page_id, url, structural_score, content_density): main or article elements, and reader text per HTML length."""
    sized = pages.selectExpr("page_id", "url", "html", "length(html) AS html_chars")
    structural = f"exists(nodes, n -> {dom.by_tag('main', 'article')('n')})"
    groups = (TEXT_FILE_TAGS, SKIPPED_TAGS)
    return parse_nodes(sized, keep=("page_id", "url", "html_chars"), groups=groups).selectExpr(
        "page_id", "url", f"cast({structural} AS int) AS structural_score",
        f"try_divide(length({dom.html_to_text('nodes')}), html_chars) AS content_density")


def features_of_relevant(pages: DataFrame, relevant: DataFrame) -> DataFrame:
    """``page_features`` of the pages that some site finds relevant; the others are not parsed."""
    wanted = relevant.select("url").distinct()
    return page_features(pages.join(wanted, "url", "left_semi").select("page_id", "url", "html"))


def top_urls(relevant: DataFrame, features: DataFrame | None = None, n: int = MAX_URLS) -> DataFrame:
    """The first ``n`` relevant URLs of each site: (site, rank, url, score, hits).

    Ties go to pages with main or article elements, then to denser ones where ``features`` knows the page, then to
    the smaller URL.
    """
    order = [F.desc("score"), F.asc("url")]
    if features is not None:
        known = features.groupBy("url").agg(F.max("structural_score").alias("structural_score"),
                                            F.max("content_density").alias("content_density"))
        relevant = relevant.join(known, "url", "left")
        order[1:1] = [F.desc_nulls_last("structural_score"), F.desc_nulls_last("content_density")]
    return ranked_per_key(relevant, ["site"], order, n).select("site", "rank", "url", "score", "hits")


def derive_rules(relevant: DataFrame, n: int = MAX_RULES, min_count: int = MIN_RULE_COUNT) -> DataFrame:
    """(site, rank, rule, n_urls): the commonest first path segments among the relevant URLs of a site."""
    segment = f"regexp_extract({url_path('url')}, '^(/[^/]+)', 1)"
    counts = (
        relevant.selectExpr("site", f"{segment} AS rule").filter("rule <> ''")
        .groupBy("site", "rule").agg(F.count("*").alias("n_urls"))
        .filter(F.col("n_urls") >= min_count)
    )
    return ranked_per_key(counts, ["site"], [F.desc("n_urls"), F.asc("rule")], n) \
        .select("site", "rank", "rule", "n_urls")


def derive_deep_rules(relevant: DataFrame, n: int = MAX_RULES, min_count: int = MIN_RULE_COUNT) -> DataFrame:
    """(site, rank, rule, depth, n_urls): the deepest path prefixes that still hold ``min_count`` relevant URLs.

    Every path gives its prefixes by whole segments (``/a``, ``/a/b``, ...), counted per site and depth in one
    aggregation; a prefix is kept where it has enough URLs and none of its children has, so a branch ends at its
    deepest supported directory. Ranked per site by URLs, then rule.
    """
    segments = f"regexp_extract_all({url_path('url')}, '(/[^/]+)', 1)"
    prefixes = ("transform(sequence(1, size(segs)), k -> named_struct('depth', k, 'rule', "
                "array_join(slice(segs, 1, k), '')))")
    counted = (
        relevant.selectExpr("site", f"{segments} AS segs").filter("size(segs) > 0")
        .selectExpr("site", f"inline({prefixes})")
        .groupBy("site", "rule", "depth").agg(F.count("*").alias("n_urls"))
        .filter(F.col("n_urls") >= min_count)
    )
    parents = counted.filter("depth > 1").selectExpr(
        "site AS p_site", "regexp_replace(rule, '/[^/]+$', '') AS p_rule").distinct()
    leaves = counted.join(parents, (F.col("site") == F.col("p_site")) & (F.col("rule") == F.col("p_rule")), "left_anti")
    return ranked_per_key(leaves, ["site"], [F.desc("n_urls"), F.asc("rule")], n) \
        .select("site", "rank", "rule", "depth", "n_urls")


def explain_choice(hits: str = "hits") -> str:
    """SQL text: why a URL was chosen."""
    return f"concat('matches ', array_join({hits}, ', '))"


def next_urls(urls: DataFrame, interests: Sequence[str] = INTERESTS, features: DataFrame | None = None) -> DataFrame:
    """(site, urls, rules, reasoning): the answer for every site with a relevant URL."""
    relevant = relevant_urls(urls, interests)
    chosen = top_urls(relevant, features).selectExpr("site", "rank", "url", f"{explain_choice()} AS reason")
    chosen = chosen.groupBy("site").agg(F.sort_array(F.collect_list(F.struct("rank", "url", "reason"))).alias("c"))
    rules = derive_rules(relevant).groupBy("site").agg(
        F.sort_array(F.collect_list(F.struct("rank", "rule"))).alias("r"))
    return chosen.join(rules, "site", "left").selectExpr(
        "site", "transform(c, x -> x.url) AS urls",
        "coalesce(transform(r, x -> x.rule), cast(array() AS array<string>)) AS rules",
        "transform(c, x -> x.reason) AS reasoning")


def nav_from_urls(urls: DataFrame, interests: Sequence[str] = INTERESTS) -> DataFrame:
    """Answer from a URL table; the site of a URL is its host."""
    return next_urls(urls.selectExpr(f"{url_host('url')} AS site", "url"), interests)


def nav_from_sitemap(sitemaps: DataFrame, interests: Sequence[str] = INTERESTS) -> DataFrame:
    """Answer from the locations of sitemaps; the site is the host of the sitemap."""
    return next_urls(sitemap_urls(sitemaps), interests)


def nav_from_pages(pages: DataFrame, interests: Sequence[str] = INTERESTS) -> DataFrame:
    """Answer from the links of pages; the site is the host of the page. Ties between URLs that are pages of the table go
    to better structured and denser pages."""
    links = page_links(pages).selectExpr(f"{url_host('url')} AS site", f"explode_outer({sorted_urls()}) AS url")
    links = links.filter("url IS NOT NULL")
    return next_urls(links, interests, features_of_relevant(pages, relevant_urls(links, interests)))


def _filled(template: str, values: dict[str, str]) -> str:
    filled = text(template)
    for name, value in values.items():
        filled = f"replace({filled}, '{{{name}}}', {value})"
    return filled


def build_prompts(pages: DataFrame, template: str, interests: Sequence[str] = INTERESTS) -> DataFrame:
    """(page_id, prompt): one request per page, the template filled with ``{interests}`` and the sorted URLs of the
    page as ``{web_resource}``. A page's URLs are joined inside its row."""
    prompt = _filled(template, {"interests": text(", ".join(interests)),
                                "web_resource": f"array_join({sorted_urls()}, '\\n')"})
    return page_links(pages).selectExpr("page_id", f"{prompt} AS prompt")


def build_url_prompts(urls: DataFrame, template: str, interests: Sequence[str] = INTERESTS,
                      per_prompt: int = URLS_PER_PROMPT) -> DataFrame:
    """(site, prompt_no, prompt): requests over lists of (site, url), such as URL files or sitemap locations. The
    distinct URLs of a site are sorted and dealt out to prompts of about ``per_prompt``, by hash, so a site of any size
    is many small groups and every URL is in one prompt."""
    distinct = urls.select("site", "url").filter("url IS NOT NULL").distinct()
    sizes = distinct.groupBy("site").agg(F.ceil(F.count("*") / per_prompt).alias("n_prompts"))
    dealt = distinct.join(sizes, "site").withColumn("prompt_no", F.expr("pmod(crc32(encode(url, 'UTF-8')), n_prompts)"))
    prompt = _filled(template, {"interests": text(", ".join(interests)), "web_resource": "array_join(listed, '\\n')"})
    return dealt.groupBy("site", "prompt_no").agg(F.sort_array(F.collect_list("url")).alias("listed")).selectExpr(
        "site", "prompt_no", f"{prompt} AS prompt")


def sitemap_urls(sitemaps: DataFrame) -> DataFrame:
    """(site, url) of the locations of sitemaps; the site is the host of the sitemap."""
    return read_sitemap(sitemaps).selectExpr(f"{url_host('sitemap_url')} AS site", "loc AS url")


def build_extraction_prompts(chunks: DataFrame, template: str, format_instructions: str = "") -> DataFrame:
    """``chunks`` plus ``prompt``: the template filled with the chunk as ``{html_content}``. Chunks are shown whole, so
    their size is the size of a prompt."""
    prompt = _filled(template, {"format_instructions": text(format_instructions), "html_content": "chunk"})
    return chunks.withColumn("prompt", F.expr(prompt))


def parse_nav_response(answers: DataFrame, keep: Sequence[str], response: str = "response") -> DataFrame:
    """``keep`` columns plus (urls, rules, reasoning, valid); an answer is valid if all three lists are there."""
    parsed = f"from_json({unfenced(response)}, '{NAVIGATION.simpleString()}')"
    complete = "a.urls IS NOT NULL AND a.rules IS NOT NULL AND a.reasoning IS NOT NULL"
    return answers.selectExpr(*keep, f"{parsed} AS a").selectExpr(
        *keep, "a.urls AS urls", "a.rules AS rules", "a.reasoning AS reasoning",
        f"coalesce({complete}, false) AS valid")

"""The results of the queries, stated in SQL over the given tables.

Where a query works on derived pages, robots files or logs, the SQL states what must come out from the tables the
input was derived from, instead of repeating the work.
"""

from __future__ import annotations

from webloom.plans import catalog as C
from webloom.plans import inputs as I

PRICE = "printf('%.2f', p_retailprice)"
# What must be cut from raw HTML, and the words that mark products in texts and URLs. They are written
# here as they must be, not taken from the code under test.
IRRELEVANT_HTML = (
    "(?is)<script[^>]*>.*?</script>", "(?is)<style[^>]*>.*?</style>", "(?s)<!--.*?-->", "(?i)<meta[^>]*>",
    "(?i)<link[^>]*>", "(?is)<noscript[^>]*>.*?</noscript>", "(?is)<iframe[^>]*>.*?</iframe>",
)
PRODUCT_INDICATORS = ("$", "price", "buy", "add to cart", ".95", ".99", "product")
PRODUCT_URL_WORDS = ("product", "item", "detail", "p/", "/p/", "catalog", "shop", "buy", "purchase", "goods",
                     "merchandise", "listing")


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# One row per part on its shop page: page n, place i on the page, c cards on the page.
PARTS = f"""parts AS (
    SELECT *, p_partkey // {I.PARTS_PER_PAGE} AS n, {PRICE} AS price,
        row_number() OVER (PARTITION BY p_partkey // {I.PARTS_PER_PAGE} ORDER BY p_partkey) - 1 AS i,
        count(*) OVER (PARTITION BY p_partkey // {I.PARTS_PER_PAGE}) AS c
    FROM part)"""
SHOP = f"""{PARTS}, cards AS (
    SELECT n AS page_id, string_agg({I.card_sql('n', PRICE)}, '' ORDER BY p_partkey) AS cards FROM parts GROUP BY n),
shop AS (
    SELECT page_id, replace({_quoted(I.SHOP_HEAD)}, 'N', page_id::VARCHAR) || cards
        || replace({_quoted(I.SHOP_TAIL)}, 'N', page_id::VARCHAR) AS html FROM cards)"""
SHOP_SITE = "'https://shop.example.com'"
# HTML of the shop pages as a parsed tree gives it back.
RENDERED = ("regexp_replace(replace(html, '<!DOCTYPE html>', '<!DOCTYPE html>' || chr(10)), "
            "'(<(link|meta|input|img|source)[^>]*)>', '\\1/>', 'g')")


def without_attributes(html: str, names: str) -> str:
    return f"regexp_replace({html}, ' ({names})=\"[^\"]*\"', '', 'g')"


def shop_url(path: str) -> str:
    return f"{SHOP_SITE} || {path}"


HOST = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"
ORIGIN = "regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)"
PATH = "regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)"
ROBOTS = f"""hosts AS (SELECT DISTINCT {ORIGIN} AS origin, {HOST} AS host FROM pages),
robots AS (SELECT host, origin || '/robots.txt' AS robotstxt_url, {I.ROBOTS_BODY} AS body,
    {I.ROBOTS_STATUS} AS http_status FROM hosts),
lines AS (SELECT robotstxt_url, unnest(string_split(body, chr(10))) AS value,
    generate_subscripts(string_split(body, chr(10)), 1) AS line_no FROM robots),
directives AS (SELECT robotstxt_url, line_no, lower(trim(split_part(value, ':', 1))) AS directive,
    trim(substr(value, strpos(value, ':') + 1)) AS content
    FROM lines WHERE contains(value, ':') AND NOT starts_with(trim(value), '#'))"""
# Outcome of a page in the crawl log, stated from its number.
STATUS = """CASE WHEN page_id % 3 = 0 THEN 'fetched' WHEN page_id % 15 = 1 THEN 'save_error'
    WHEN page_id % 15 = 2 THEN 'forbidden' WHEN page_id % 15 IN (4, 5, 7) THEN 'error'
    WHEN page_id % 15 = 8 THEN 'unreachable' WHEN page_id % 15 = 10 THEN 'unexpected' END"""
LOG = f"""outcomes AS (
    SELECT page_id AS pos, url, {HOST} AS host, {STATUS} AS status,
        CASE WHEN page_id % 3 = 0 OR page_id % 15 = 1 THEN 200 END AS http_status,
        CASE WHEN page_id % 3 = 0 THEN 'crawl/' || page_id || '.html' END AS file,
        CASE page_id % 15 WHEN 2 THEN 'AgentX' WHEN 4 THEN '403 Client Error'
            WHEN 5 THEN 'Read timed out (ReadTimeoutError)' WHEN 7 THEN 'connection reset'
            WHEN 10 THEN 'boom' END AS detail
    FROM pages),
log AS (SELECT * FROM outcomes WHERE status IS NOT NULL)"""
ALLOWED = f"""CASE length({HOST}) % 11 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN false ELSE
    NOT (starts_with({PATH}, '/fr') OR starts_with({PATH}, '/en/2')
         OR (length({HOST}) % 2 = 0 AND starts_with({PATH}, '/de/'))) END"""
# Links of the test pages: every href, made absolute, with its place on the page.
HREFS = f"""hrefs AS (
    SELECT page_id, {ORIGIN} || unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS url,
        generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS place, {HOST} AS site FROM pages),
page_urls AS (SELECT page_id, site, url, min(place) AS place FROM hrefs GROUP BY ALL)"""
SITEMAP_ROWS = f"""located AS (
    SELECT 'https://' || {HOST} || '/sitemap-' || (page_id // {I.PAGES_PER_SITEMAP}) || '.xml' AS sitemap_url,
        {HOST} AS site, url, page_id FROM pages)"""


def stripped(html: str) -> str:
    for pattern in IRRELEVANT_HTML:
        html = f"regexp_replace({html}, {_quoted(pattern)}, '', 'g')"
    return html


def plain(html: str) -> str:
    """Entities of the test pages decoded."""
    for entity, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "\x01"), ("&amp", "\x01"),
                         ("\x01", "&")):
        html = f"replace({html}, '{entity}', '{char}')"
    return html


def counted(pattern: str, value: str = "html") -> str:
    return f"len(regexp_extract_all({value}, {_quoted(pattern)}))"


# Reader text of the test pages: the advertisement and the article, tag by tag and line by line.
TEXTS = f"""parts_of_text AS (
    SELECT page_id, unnest(string_split(regexp_replace(
            regexp_extract(html, '(?s)<div class="ad">(.*)</article>', 1), '<[^>]*>', chr(10), 'g'), chr(10))) AS line,
        generate_subscripts(string_split(regexp_replace(
            regexp_extract(html, '(?s)<div class="ad">(.*)</article>', 1), '<[^>]*>', chr(10), 'g'), chr(10)), 1) AS k
    FROM pages),
texts AS (
    SELECT page_id, string_agg(regexp_replace({plain('line')}, '^\\s+|\\s+$', '', 'g'), ' ' ORDER BY k)
        FILTER (regexp_matches(line, '\\S')) AS text
    FROM parts_of_text GROUP BY page_id)"""
# Length of the test pages as the tree gives them back: void tags, missing end tags and entities.
ENTITY_TEXT = f"replace({plain('html')}, '&', '&amp;')"
RENDERED_CHARS = f"""(length({ENTITY_TEXT}) + 1 + {counted('<br>')} + {counted('<meta ')}
    + 4 * ({counted('<p>')} - ({counted('</p>')} - 1)) + 4 * ({counted('<b>')} - {counted('</b>')})
    + CASE WHEN contains(html, '</body>') THEN 0 ELSE 7 END + CASE WHEN contains(html, '</html>') THEN 0 ELSE 7 END)"""


def part_chars(pattern: str) -> str:
    return f"length(regexp_extract({ENTITY_TEXT}, {_quoted(pattern)}, 0))"


def chunked(source: str, key: str, size: int, overlap: int = 200) -> str:
    """Greedy chunks of one-line texts: rows (key, chunk_no, chunk). ``source`` is a CTE (key, text)."""
    return f"""ends AS (
        SELECT {key}, (sum(length(w) + 1) OVER (PARTITION BY {key} ORDER BY k) - 1)::BIGINT AS b FROM (
            SELECT {key}, unnest(string_split(text, ' ')) AS w,
                generate_subscripts(string_split(text, ' '), 1) AS k FROM {source})),
    cuts AS (SELECT {key}, b, coalesce(lead(b) OVER (PARTITION BY {key} ORDER BY b), b) AS next_b FROM (
        SELECT {key}, b FROM ends UNION ALL SELECT {key}, 0 FROM {source})),
    cut AS ({_recursion(key, size, overlap, source)})"""


def _recursion(key: str, size: int, overlap: int, source: str) -> str:
    return f"""SELECT * FROM (
        WITH RECURSIVE step({key}, chunk_no, s, e) AS (
            SELECT {key}, 0, 0::BIGINT, max(b) FROM cuts WHERE b <= {size} GROUP BY {key}
            UNION ALL
            SELECT {key}, chunk_no + 1, s2, (SELECT max(b) FROM cuts c WHERE c.{key} = t.{key} AND b - s2 <= {size})
            FROM (SELECT p.{key}, p.chunk_no, (SELECT min(b) FROM cuts c WHERE c.{key} = p.{key} AND b >= p.s
                      AND p.e - b <= {overlap} AND (b = p.e OR
                      (SELECT min(b) FROM cuts d WHERE d.{key} = p.{key} AND d.b > p.e) - b <= {size})) AS s2
                  FROM step p
                  WHERE p.e < (SELECT max(b) FROM cuts m WHERE m.{key} = p.{key})) t)
        SELECT {key}, chunk_no, trim(substr(text, s + 1, e - s)) AS chunk FROM step JOIN {source} USING ({key}))"""


FIXED_CHUNKS = """fixed AS (
    SELECT doc_id, k AS chunk_no, substr(text, k * 3800 + 1, 4000) AS chunk FROM (
        SELECT doc_id, text, unnest(range(0, greatest(ceil((length(text) - 200) / 3800.0)::BIGINT, 1))) AS k
        FROM documents WHERE length(text) > 0))"""
HAS_INDICATOR = " OR ".join(f"contains(lower(chunk), {_quoted(w)})" for w in PRODUCT_INDICATORS)
HAS_URL_WORD = " OR ".join(f"contains(lower(url), {_quoted(w)})" for w in PRODUCT_URL_WORDS)
SCORE = " + ".join(f"contains(lower(url), {_quoted(w)})::INT" for w in I.INTERESTS)
REASON = "'matches ' || array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN contains(lower(url), {_quoted(w)}) THEN {_quoted(w)} END" for w in I.INTERESTS
) + "], lambda x: x IS NOT NULL), ', ')"
REFS = ", ".join(_quoted(r) for r in C.REFERENCES)
REFERENCES = f"""refs AS (
    SELECT page_id, url, k - 1 AS i, replace(r, 'P', page_id::VARCHAR) AS ref, {ORIGIN} AS origin, {PATH} AS path,
        regexp_replace({PATH}, '[^/]*$', '') AS folder, regexp_extract(url, '[?][^#]*', 0) AS query
    FROM (SELECT page_id, url, unnest([{REFS}]) AS r, generate_subscripts([{REFS}], 1) AS k FROM pages))"""
RESOLVED = """CASE i WHEN 0 THEN origin || ref WHEN 1 THEN origin || path || ref WHEN 2 THEN origin || path || query || ref
    WHEN 3 THEN origin || folder || ref WHEN 4 THEN origin || regexp_replace(folder, '[^/]+/$', '') || 'up'
    WHEN 5 THEN origin || folder || 'same' WHEN 6 THEN ref
    WHEN 7 THEN regexp_extract(url, '^[a-z]+:', 0) || ref WHEN 8 THEN origin || '/pad  ' WHEN 10 THEN regexp_extract(url, '^[^#]*')
    ELSE ref END"""


def ranking(source: str, ties: str = "") -> str:
    """CTEs for the answer on the relevant URLs of a CTE (site, url); ``ties`` orders equal scores before the URL."""
    return f"""relevant AS (SELECT DISTINCT site, url, {SCORE} AS score FROM {source} WHERE {SCORE} > 0),
    best AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY score DESC, {ties}url) AS rank FROM relevant
        QUALIFY rank <= 10),
    segments AS (SELECT site, regexp_extract(url, '^[a-z]+://[^/?#]+(/[^/?#]+)', 1) AS rule FROM relevant),
    rule_counts AS (SELECT site, rule, count(*) AS n_urls FROM segments WHERE rule <> '' GROUP BY site, rule
        HAVING count(*) >= 2),
    rules AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n_urls DESC, rule) AS rank FROM rule_counts
        QUALIFY rank <= 3)"""


ANSWER = f"""SELECT b.site, string_agg(url, ' ' ORDER BY rank) AS urls,
    coalesce((SELECT string_agg(rule, ' ' ORDER BY rank) FROM rules r WHERE r.site = b.site), '') AS rules,
    string_agg({REASON}, '; ' ORDER BY rank) AS reasoning FROM best b GROUP BY b.site"""
NAV_CARDS = "string_agg({card}, '' ORDER BY p_partkey)"
# A card as the tree gives it back, with the attributes that stay under different rules.
CARD_IMAGE = "'<img src=\"/img/' || p_partkey || '.jpg\" srcset=\"/img/' || p_partkey || '.jpg 1x, /img/' || p_partkey " \
             "|| '-2.jpg 2x\" alt=\"\"/>'"
CARD_TEXTS = "'<h2>' || p_name || '</h2><p>' || p_brand || ' ' || p_type || '</p><span>$' || price || '</span></div>'"
CARD_TAG = """CASE n % 4 WHEN 0 THEN '<div class="product-card" data-product-id="' || p_partkey || '">'
    WHEN 1 THEN '<div class="product-tile" data-product-id="' || p_partkey || '">'
    WHEN 2 THEN '<div data-product-id="' || p_partkey || '">' ELSE '<div>' END"""
CARD_HTML = f"{CARD_TAG} || '<a href=\"/p/' || p_partkey || '\">' || {CARD_IMAGE} || '</a>' || {CARD_TEXTS}"
SMALL_CARD = f"""CASE n % 4 WHEN 0 THEN '<div class="product-card">' WHEN 1 THEN '<div class="product-tile">'
    ELSE '<div>' END || '<a><img alt=""/></a>' || {CARD_TEXTS}"""
PRODUCT_NAME = "p_name"
RANGE_PRICE = "'$' || price || CASE WHEN p_partkey % 7 = 0 THEN ' - $' || price ELSE '' END"
SHOP_URLS = f"""shop_urls AS (
    SELECT n AS page_id, 'links' AS category, '/home' AS path, 0 AS pos FROM parts GROUP BY n
    UNION ALL SELECT n, 'links', '/p/' || p_partkey, i + 1 FROM parts
    UNION ALL SELECT n, 'images', '/img/' || p_partkey || '.jpg', i FROM parts
    UNION ALL SELECT n, 'images', '/img/' || p_partkey || '-2.jpg', c + i FROM parts
    UNION ALL SELECT n, category, replace(path, 'N', n::VARCHAR), pos FROM (SELECT DISTINCT n FROM parts), (VALUES
        ('scripts', '/js/N.js', 0), ('stylesheets', '/css/N.css', 0), ('forms', '/search/N', 0),
        ('media', '/v/N.mp4', 0), ('media', '/s/N.mp4', 1), ('iframes', '/frame/N', 0),
        ('other', '/bg/N.png', 0), ('other', '/next/N', 1), ('other', '/list/N', 2)) t(category, path, pos))"""

_RESULTS: dict[str, str] = {
    "read_pages": "SELECT page_id, url, length(html) AS html_chars, md5(html) AS html_md5 FROM pages",
    "read_robots": f"WITH {ROBOTS} SELECT robotstxt_url, line_no, value FROM lines",
    "read_sitemap": f"""WITH {SITEMAP_ROWS} SELECT sitemap_url,
        row_number() OVER (PARTITION BY sitemap_url ORDER BY page_id) - 1 AS pos, url AS loc,
        1750437217 AS lastmod_seconds FROM located""",
    "read_crawl_log": f"WITH {LOG} SELECT pos, url, status, http_status, file, detail FROM log",
    "read_crawl_json": """SELECT url, '2025-06-20 21:41:50' AS crawl_time, 'took longer: ' || page_id AS errors
        FROM pages""",
    "write_robots_jsonl": f"""WITH {ROBOTS} SELECT directive, content, robotstxt_url, 1750449787 AS download_seconds
        FROM directives""",
    "write_crawl_log": f"WITH {LOG} SELECT url, status, http_status, file, detail FROM log",
    "write_pages": """SELECT sha256(url) AS page_key, url, md5(html) AS html_md5, page_id % 3 AS crawl_ts FROM pages""",
    "normalize_url": f"""WITH {REFERENCES} SELECT page_id, i, CASE WHEN i IN (2, 9, 10, 11) THEN NULL
        WHEN i = 7 THEN ref WHEN i = 8 THEN origin || '/pad' ELSE {RESOLVED} END AS url FROM refs""",
    "resolve_url": f"WITH {REFERENCES} SELECT page_id, i, {RESOLVED} AS url FROM refs",
    "is_valid_url": f"WITH {REFERENCES} SELECT page_id, i, i IN (0, 3, 4, 5, 6, 7, 8) AS valid FROM refs",
    "strip_irrelevant_html": f"""SELECT page_id, length(h) AS chars, md5(h) AS html_md5
        FROM (SELECT page_id, {stripped('html')} AS h FROM pages)""",
    "html_to_text": f"WITH {TEXTS} SELECT page_id, length(text) AS chars, md5(text) AS text_md5 FROM texts",
    "compress_attributes": f"""WITH {SHOP} SELECT page_id, {without_attributes(
        RENDERED, 'rel|href|http-equiv|content|src|action|srcset|style')} AS html FROM shop""",
    "render_html": f"WITH {SHOP} SELECT page_id, {RENDERED} AS html FROM shop",
    "count_tokens": "SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens FROM documents",
    "truncate_budget": """SELECT doc_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '...' ELSE text END
        AS text FROM documents""",
    "field_keywords": """WITH fields AS (
            SELECT p_partkey, lower(replace(p_name, ' ', '_')) AS f FROM part
            UNION ALL SELECT p_partkey, lower(p_type || '-' || p_brand) FROM part)
        SELECT DISTINCT p_partkey, keyword FROM (
            SELECT p_partkey, unnest([f, replace(f, '_', '-'), replace(f, '-', '_')]) AS keyword FROM fields
            UNION ALL SELECT p_partkey, w FROM (SELECT p_partkey, unnest(string_split(f, '_')) AS w FROM fields)
            WHERE length(w) > 2)""",
    "clean_product_name": "SELECT p_partkey, p_name AS name FROM part",
    "product_price": f"SELECT p_partkey, '$' || {PRICE} AS price FROM part",
    "parse_robots_line": f"""WITH {ROBOTS} SELECT robotstxt_url, line_no, directive, content
        FROM lines LEFT JOIN directives USING (robotstxt_url, line_no)""",
    "robots_url": f"SELECT page_id AS pos, {ORIGIN} || '/robots.txt' AS robots_url FROM pages",
    "sitemap_candidates": f"""SELECT site, candidate_no, site || path AS sitemap_url
        FROM (SELECT DISTINCT {ORIGIN} AS site FROM pages), (VALUES (0, '/sitemap.xml'), (1, '/sitemap_index.xml'),
        (2, '/sitemap/sitemap.xml')) t(candidate_no, path)""",
    "strip_slashes": "SELECT page_id AS pos, rtrim(url, '/') AS url FROM pages",
    "classify_error": f"""WITH {LOG} SELECT pos, detail, CASE pos % 15 WHEN 4 THEN 'access_denied' WHEN 5 THEN 'timeout'
        ELSE 'other' END AS error_class FROM log WHERE status = 'error'""",
    "parse_crawl_line": f"""WITH {LOG} SELECT pos AS page_id, CASE WHEN status IS NOT NULL THEN url END AS url, status,
        http_status FROM outcomes""",
    "build_prompts": f"""WITH {HREFS} SELECT page_id, 'Interests: {", ".join(I.INTERESTS)}' || chr(10) || 'Resources: '
        || coalesce(string_agg(url, chr(10) ORDER BY url), '') AS prompt
        FROM pages p LEFT JOIN (SELECT page_id, url FROM page_urls) u USING (page_id) GROUP BY page_id"""
    .replace("string_agg(url", "string_agg(u.url").replace("ORDER BY url)", "ORDER BY u.url)"),
    "build_extraction_prompts": f"""WITH {FIXED_CHUNKS.replace('3800', '2800').replace('4000', '3000')}
        SELECT doc_id, chunk_no, 'HTML: ' || chunk || chr(10) || 'Format: JSON' AS prompt FROM fixed""",
    "parse_nav_response": """SELECT page_id AS pos, CASE WHEN page_id % 5 > 0 THEN url END AS url,
        CASE WHEN page_id % 5 > 0 AND page_id % 4 > 0 THEN '/a,/b' END AS rules,
        CASE WHEN page_id % 5 > 0 AND page_id % 4 > 0 THEN 'r' || page_id END AS reason,
        page_id % 5 > 0 AND page_id % 4 > 0 AS valid FROM pages""",
    "parse_product_response": f"""WITH {PARTS} SELECT p_partkey, p_partkey % 3 = 0 AS from_text, {PRODUCT_NAME} AS name,
        CASE WHEN p_partkey % 3 = 0 THEN {RANGE_PRICE} ELSE '$' || price END AS price, NULL::VARCHAR AS id,
        NULL::VARCHAR AS image_url, NULL::VARCHAR AS description FROM parts""",
    "filter_product_chunks": f"WITH {FIXED_CHUNKS} SELECT * FROM fixed WHERE {HAS_INDICATOR}",
    "filter_product_urls": f"""WITH {PARTS}, {SHOP_URLS}, {HREFS} SELECT DISTINCT url FROM (
        SELECT path AS url FROM shop_urls UNION ALL SELECT url FROM page_urls) WHERE {HAS_URL_WORD}""",
    "filter_in_list": """SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_nationkey IN (1, 3, 5)""",
    "filter_in_list_empty": "SELECT * FROM nation",
    "filter_directive": f"""WITH {ROBOTS} SELECT robotstxt_url, line_no, content FROM directives
        WHERE directive = 'disallow'""",
    "select_elements": f"""SELECT page_id, 14 + 3 * {counted('<a href=')}
        + CASE WHEN contains(html, '<title></title>') THEN 0 ELSE 1 END AS id, 'div' AS tag FROM pages""",
    "count_elements": """SELECT page_id, selector, len(regexp_extract_all(html, pattern)) AS n
        FROM pages, (VALUES ('nav', '<nav[ >]'), ('footer', '<footer[ >]'), ('article', '<article[ >]'),
            ('.ad', '<[a-z]+ class="([^"]* )?ad( [^"]*)?"')) t(selector, pattern)
        WHERE regexp_matches(html, pattern)""",
    "match_price_text": f"""WITH {PARTS} SELECT n AS page_id, 25 + 9 * i AS node_id, 24 + 9 * i AS parent_id,
        '$' || price AS text FROM parts""",
    "match_keyword_text": f"""WITH {PARTS} SELECT n AS page_id, 21 + 9 * i AS id, p_name AS text FROM parts
        WHERE contains(p_name, 'ring') OR contains(p_name, 'bolt')""",
    "unvisited_urls": f"WITH {LOG} SELECT pos, url FROM outcomes WHERE status IS NULL",
    "robots_allowed": f"SELECT page_id AS pos, url, {ALLOWED} AS allowed FROM pages",
    "robots_allowed_written_otherwise": f"""WITH kinds AS (SELECT page_id % 5 AS k, page_id AS pos, {HOST} AS host,
            {PATH} AS path, {ALLOWED} AND CASE WHEN page_id % 5 < 3 THEN 'https://' ELSE 'http://' END || {HOST}
                IN (SELECT {ORIGIN} FROM pages) AS allowed FROM pages)
        SELECT pos, CASE k WHEN 0 THEN 'HTTPS://' || upper(host) || path WHEN 1 THEN 'https://' || host || ':443' || path
            WHEN 2 THEN 'https://me:pw@' || host || path WHEN 3 THEN 'http://' || host || path ELSE path END AS url,
            k < 4 AND allowed AS allowed FROM kinds""",
    "max_pages_per_run": f"""WITH {LOG} SELECT pos, url, status FROM log QUALIFY coalesce(sum(
        (status = 'fetched')::INT) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        < {C.MAX_PAGES}""",
    "max_pages_not_reached": f"WITH {LOG} SELECT pos, url, status FROM log",
    "crawl_frontier_run": f"""WITH {LOG} SELECT host, pos, url FROM outcomes WHERE status IS NULL AND {ALLOWED}
        ORDER BY pos LIMIT {C.MAX_PAGES}""",
    "build_url_prompts": f"SELECT DISTINCT {HOST} AS site, url AS line FROM pages",
    "build_sitemap_prompts": f"""SELECT {HOST} AS site, 'Interests: {', '.join(I.INTERESTS)}' || chr(10) || 'Resources: '
        || string_agg(DISTINCT url, chr(10) ORDER BY url) AS prompt FROM pages GROUP BY 1""",
    "read_sitemap_malformed": f"""WITH {SITEMAP_ROWS} SELECT sitemap_url,
        row_number() OVER (PARTITION BY sitemap_url ORDER BY page_id) - 1 AS pos,
        replace(url, '&', '&amp;') || '?a=1&b=2' AS loc, true AS malformed FROM located
        UNION ALL SELECT sitemap_url, count(*) AS pos, 'http' AS loc, true AS malformed FROM located GROUP BY sitemap_url""",
    "robots_group_for_agent": f"""WITH {ROBOTS} SELECT lower(origin) AS site, agent, group_no, agents,
        n_rules + CASE WHEN group_no = 0 AND length(host) % 2 = 0 THEN 1 ELSE 0 END AS n_rules
        FROM hosts, (VALUES ('{I.AGENT}', 0, '*', 3), ('BotB/1.0', 1, 'BotA,BotB', 2))
        t(agent, group_no, agents, n_rules)""",
    "ancestor_context": f"""WITH {PARTS} SELECT n AS page_id, 21 + 9 * i AS text_id, 16 AS context_id FROM parts
        WHERE contains(p_name, 'ring') OR contains(p_name, 'bolt')""",
    "drop_subtrees": f"""WITH shape AS (SELECT page_id, {counted('<a href=')} AS k,
            CASE WHEN contains(html, '<title></title>') THEN 0 ELSE 1 END AS t FROM pages)
        SELECT page_id, unnest([2, 10 + t, 14 + t + 3 * k]) AS id, unnest(['html', 'body', 'div']) AS tag FROM shape""",
    "elements_by_field": f"""WITH {PARTS} SELECT n AS page_id, 'product' AS field, 'class' AS attribute, 'div' AS tag,
            count(*) AS n FROM parts p WHERE p.n % 4 < 2 GROUP BY p.n
        UNION ALL SELECT DISTINCT n, 'menu', 'class', 'nav', 1 FROM parts
        UNION ALL SELECT DISTINCT n, 'q', 'name', 'input', 1 FROM parts""",
    "robots_summary": f"""WITH {ROBOTS} SELECT robotstxt_url, count(*) AS total_rules,
        string_agg(content, '|' ORDER BY line_no) FILTER (directive = 'user-agent') AS user_agents,
        string_agg(content, '|' ORDER BY line_no) FILTER (directive = 'disallow') AS disallowed_paths,
        string_agg(content, '|' ORDER BY line_no) FILTER (directive = 'allow') AS allowed_paths,
        string_agg(content, '|' ORDER BY line_no) FILTER (directive = 'sitemap') AS sitemaps,
        string_agg(content, '|' ORDER BY line_no) FILTER (directive = 'crawl-delay') AS crawl_delay
        FROM directives GROUP BY robotstxt_url""",
    "url_counts_by_category": f"""WITH {PARTS}, {SHOP_URLS}
        SELECT category, count(*) AS n_urls, count(DISTINCT page_id) AS n_pages FROM shop_urls GROUP BY category
        UNION ALL SELECT 'total', count(*), count(DISTINCT page_id) FROM shop_urls""",
    "url_counts_by_page": f"""WITH {HREFS} SELECT page_id, count(u.url) AS links, 0 AS images, 0 AS scripts,
        0 AS stylesheets, 0 AS forms, 0 AS media, 0 AS iframes, 0 AS other, count(u.url) AS total
        FROM pages p LEFT JOIN page_urls u USING (page_id) GROUP BY page_id""",
    "urls_by_page": f"""WITH {PARTS}, {SHOP_URLS} SELECT page_id, category,
        string_agg({shop_url('path')}, ' ' ORDER BY pos) AS urls FROM shop_urls GROUP BY ALL""",
    "crawl_summary": f"""WITH {LOG} SELECT status, count(*) AS n_urls FROM log GROUP BY status
        UNION ALL SELECT 'skipped_visited', count(*) FROM log""",
    "stage_token_stats": f"""SELECT 'original' AS stage, count(*) AS n_pages,
            sum(ceil(length(html) / 4.0))::BIGINT AS tokens FROM pages
        UNION ALL SELECT 'stripped', count(*), sum(ceil(length({stripped('html')}) / 4.0))::BIGINT FROM pages""",
    "distinct_urls": f"WITH {HREFS} SELECT DISTINCT url FROM hrefs",
    "first_seen_urls": f"""WITH {PARTS}, {SHOP_URLS} SELECT page_id, category, pos, {shop_url('path')} AS url
        FROM shop_urls""",
    "dedupe_elements": f"""WITH {PARTS} SELECT n AS page_id, i AS pos, 17 + 9 * i AS node_id, 'div' AS tag FROM parts
            WHERE n % 4 < 2
        UNION ALL SELECT DISTINCT n, CASE WHEN n % 4 < 2 THEN c ELSE 0 END + k, id, tag FROM parts,
            (VALUES (0, 11, 'nav'), (1, 14, 'form'), (2, 15, 'input'), (3, 16, 'main')) t(k, id, tag)""",
    "first_matching_selector": f"""WITH {PARTS} SELECT n AS page_id, n % 4 + 1 AS selector_no, count(*) AS n_hits
        FROM parts WHERE n % 4 < 3 GROUP BY n""",
    "first_valid_sitemap": """SELECT site, site || '/' || chr((97 + k)::INT) || '.xml' AS sitemap_url, 'body ' || k AS body
        FROM (SELECT page_id || '.example.com' AS site, page_id % 4 AS k FROM pages) WHERE k < 3""",
    "limit_products": f"""WITH {PARTS} SELECT n AS page_id, least(count(*), 50) AS n_sections,
        least(count(*), 50) - 1 AS last_pos FROM parts GROUP BY n""",
    "max_pages": f"""WITH {LOG} SELECT pos, host, url, status FROM log QUALIFY coalesce(sum(
        (status = 'fetched')::INT) OVER (PARTITION BY host ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND
        1 PRECEDING), 0) < {C.MAX_PAGES}""",
    "budget_removal": f"""WITH sized AS (SELECT page_id, {RENDERED_CHARS} AS r,
            {part_chars('(?s)<nav>.*</nav>')} AS nav, {part_chars('(?s)<footer>.*</footer>')} AS footer FROM pages)
        SELECT page_id, r <= {4 * C.BUDGET} AS has_nav, r - nav <= {4 * C.BUDGET} AS has_footer,
            CASE WHEN r <= {4 * C.BUDGET} THEN r WHEN r - nav <= {4 * C.BUDGET} THEN r - nav
            ELSE r - nav - footer END AS chars FROM sized""",
    "sort_urls": f"""WITH {HREFS} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY url) - 1 AS pos, url
        FROM page_urls""",
    "all_urls": f"WITH {PARTS}, {SHOP_URLS} SELECT DISTINCT page_id, {shop_url('path')} AS url FROM shop_urls",
    "product_urls": f"""WITH {PARTS}, {SHOP_URLS} SELECT DISTINCT page_id, path AS url FROM shop_urls
        WHERE category = 'images' OR (category = 'links' AND path <> '/home')""",
    "relevant_sections": f"""WITH {PARTS} SELECT n AS page_id, '<nav class="menu"><a href="/home">Home</a></nav>' || chr(10)
        || '<form action="/search/' || n || '"><input name="q"/></form>' || chr(10) || '<input name="q"/>' || chr(10)
        || '<main>' || string_agg({CARD_HTML}, '' ORDER BY p_partkey) || '</main>' AS html FROM parts GROUP BY n""",
    "url_extract": f"""WITH {HREFS} SELECT page_id, 'links' AS category,
        row_number() OVER (PARTITION BY page_id ORDER BY place) - 1 AS pos, url FROM page_urls""",
    "url_extract_rules": f"""WITH {PARTS}, {SHOP_URLS} SELECT page_id, category, {shop_url('path')} AS url
        FROM shop_urls""",
    "parse_nodes": """SELECT page_id, 'element' AS kind, tag, count(*) AS n FROM (
        SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)<script>.*?</script>', '<script>', 'g'),
            '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY ALL
        UNION ALL SELECT page_id, kind, NULL AS tag, n FROM (SELECT page_id, 1 AS document,
            len(regexp_extract_all(html, '<!--')) AS comment, len(regexp_extract_all(html, '(?i)<!doctype')) AS doctype,
            len(regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '<c>', 'g'),
                '(?s)<(script|style)[^>]*>.*?</(script|style)>', '<s>x</s>', 'g'), '>[^<]+')) AS text FROM pages)
        UNPIVOT (n FOR kind IN (document, comment, doctype, text)) WHERE n > 0""",
    "chunk_text": f"""WITH line_parts AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
        one_line AS (SELECT doc_id, string_agg(trim(line), ' ' ORDER BY k) FILTER (trim(line) <> '') AS text
            FROM line_parts GROUP BY doc_id),
        {chunked('one_line', 'doc_id', 4000)}
        SELECT doc_id, chunk_no, length(chunk) AS chars, md5(chunk) AS chunk_md5 FROM cut""",
    "chunk_fixed": f"WITH {FIXED_CHUNKS} SELECT * FROM fixed",
    "extract_products_text": f"""WITH {PARTS} SELECT p_partkey // {I.PARTS_PER_TEXT} AS text_id,
        row_number() OVER (PARTITION BY p_partkey // {I.PARTS_PER_TEXT} ORDER BY p_partkey) - 1 AS pos,
        {PRODUCT_NAME} AS name, {RANGE_PRICE} AS price FROM parts""",
    # Pages of plain cards (n % 4 = 3) give their records by structure where they hold two cards or more.
    "extract_product_sections": f"""WITH {PARTS} SELECT n AS page_id, i AS pos,
        17 + 9 * i + CASE WHEN n % 4 = 3 AND c < 2 THEN 7 ELSE 0 END AS node_id,
        CASE WHEN n % 4 = 3 AND c < 2 THEN '<span>$' || price || '</span>' ELSE {CARD_HTML} END AS section
        FROM parts""",
    "extract_product_fields": f"""WITH {PARTS} SELECT n AS page_id, i AS pos,
        CASE WHEN n % 4 < 3 OR c >= 2 THEN p_name END AS name,
        '$' || price AS price, CASE WHEN n % 4 < 3 THEN p_partkey::VARCHAR END AS id,
        CASE WHEN n % 4 < 3 OR c >= 2 THEN '/img/' || p_partkey || '.jpg' END AS image_url,
        CASE WHEN n % 4 < 3 OR c >= 2 THEN p_brand || ' ' || p_type END AS description FROM parts""",
    "score_urls": f"SELECT {HOST} AS site, url, {SCORE} AS score FROM pages",
    "content_density": f"""WITH {TEXTS} SELECT page_id, round(length(text) / length(html)::DOUBLE, 6) AS density
        FROM pages JOIN texts USING (page_id)""",
    "structural_score": """SELECT page_id, regexp_matches(html, '<(main|article)[ >]')::INT AS structural_score FROM pages""",
    "top_urls": f"""WITH sites AS (SELECT {HOST} AS site, url FROM pages), {ranking('sites')}
        SELECT site, rank, url, score FROM best""",
    "top_urls_with_features": f"""WITH {TEXTS},
        sites AS (SELECT {HOST} AS site, url, length(text) / length(html)::DOUBLE AS density, {SCORE} AS score
            FROM pages JOIN texts USING (page_id) WHERE {SCORE} > 0)
        SELECT site, rank, url, score FROM (SELECT *, row_number() OVER (
            PARTITION BY site ORDER BY score DESC, density DESC, url) AS rank FROM sites) WHERE rank <= 10""",
    "derive_rules": f"""WITH sites AS (SELECT {HOST} AS site, url FROM pages), {ranking('sites')}
        SELECT site, rank, rule, n_urls FROM rules""",
    "derive_rules_deep": f"""WITH sites AS (SELECT {HOST} AS site, url FROM pages), {ranking('sites')},
        segs AS (SELECT site, regexp_extract_all({PATH}, '(/[^/]+)', 1) AS s FROM relevant),
        depths AS (SELECT site, s, unnest(range(1, len(s) + 1)) AS depth FROM segs WHERE len(s) > 0),
        counted AS (SELECT site, array_to_string(s[1:depth], '') AS rule, depth, count(*) AS n_urls FROM depths
            GROUP BY ALL HAVING count(*) >= 2),
        leaves AS (SELECT * FROM counted c WHERE NOT EXISTS (SELECT 1 FROM counted d WHERE d.site = c.site
            AND d.depth = c.depth + 1 AND regexp_replace(d.rule, '/[^/]+$', '') = c.rule))
        SELECT site, row_number() OVER (PARTITION BY site ORDER BY n_urls DESC, rule) AS rank, rule, depth, n_urls
        FROM leaves QUALIFY rank <= 3""",
    "explain_choice": f"""SELECT DISTINCT {HOST} AS site, url, {REASON} AS reason FROM pages WHERE {SCORE} > 0""",
    "nav_from_sitemap": f"WITH {SITEMAP_ROWS}, {ranking('located')} {ANSWER}",
    "nav_from_urls": f"WITH sites AS (SELECT {HOST} AS site, url FROM pages), {ranking('sites')} {ANSWER}",
    "nav_from_pages": f"""WITH {HREFS}, {TEXTS}, known AS (
        SELECT url AS known_url, max(length(text) / length(html)::DOUBLE) AS density FROM pages JOIN texts USING (page_id)
        GROUP BY url),
        {ranking('page_urls', '(SELECT density FROM known WHERE known_url = url) DESC NULLS LAST, ')} {ANSWER}""",
    "filter_html": f"""WITH {PARTS} SELECT n AS page_id, '<nav class="menu"><a>Home</a></nav>' || chr(10)
        || '<form><input name="q"/></form>' || chr(10) || '<input name="q"/>' || chr(10)
        || '<main>' || string_agg({SMALL_CARD}, '' ORDER BY p_partkey) || '</main>' AS html, false AS truncated FROM parts GROUP BY n""",
    "product_chunks": f"""WITH {PARTS}, shop_text AS (SELECT n AS page_id, string_agg(
            p_name || ' ' || p_brand || ' ' || p_type || ' $' || price, ' ' ORDER BY p_partkey) AS text
            FROM parts GROUP BY n),
        {chunked('shop_text', 'page_id', 1000)}
        SELECT page_id, chunk_no, chunk FROM cut""",
    "products": f"""WITH {PARTS}, texts AS (SELECT *, p_partkey // {I.PARTS_PER_TEXT} AS t,
            row_number() OVER (PARTITION BY p_partkey // {I.PARTS_PER_TEXT} ORDER BY p_partkey) - 1 AS k FROM parts)
        SELECT t AS page_id, 0 AS chunk_no, k AS pos, {PRODUCT_NAME} AS name, {RANGE_PRICE} AS price,
            NULL::VARCHAR AS id, NULL::VARCHAR AS image_url, NULL::VARCHAR AS description FROM texts WHERE t % 2 = 1
        UNION ALL SELECT DISTINCT t, 0, 0, 'page ' || t, NULL, NULL, NULL, NULL FROM texts WHERE t % 2 = 0""",
    "crawl_frontier": f"""WITH {LOG}, fresh AS (SELECT host, pos, url FROM outcomes
            WHERE status IS NULL AND {ALLOWED})
        SELECT host, pos, url FROM fresh QUALIFY row_number() OVER (PARTITION BY host ORDER BY pos) <= {C.MAX_PAGES}""",
    "forbidden_outcomes": f"""WITH {LOG} SELECT url || ' --> forbidden by robotstxt for {I.AGENT}' AS line FROM outcomes
        WHERE status IS NULL AND NOT ({ALLOWED})""",
    "robots_report": f"""WITH {ROBOTS} SELECT robotstxt_url, count(*) AS stored_rows, count(*) AS total_rules,
        count(*) FILTER (directive = 'disallow') AS n_disallowed FROM directives GROUP BY robotstxt_url""",
    "incremental_frontier": f"WITH {HREFS} SELECT DISTINCT url FROM hrefs",
}

# Result columns that are 32-bit or 64-bit integers in the queries and come out wider or narrower in the SQL.
_INTEGERS = {
    "read_pages": "html_chars", "read_robots": "line_no", "read_sitemap": "pos", "read_sitemap_malformed": "pos", "normalize_url": "i",
    "resolve_url": "i", "is_valid_url": "i", "strip_irrelevant_html": "chars", "html_to_text": "chars",
    "parse_robots_line": "line_no", "build_extraction_prompts": "chunk_no", "filter_product_chunks": "chunk_no",
    "filter_directive": "line_no", "select_elements": "id", "count_elements": "n", "match_price_text": "node_id parent_id", "match_keyword_text": "id",
    "ancestor_context": "text_id", "drop_subtrees": "id", "robots_summary": "total_rules",
    "url_counts_by_page": "links total", "first_seen_urls": "pos", "dedupe_elements": "pos node_id",
    "first_matching_selector": "selector_no n_hits", "limit_products": "last_pos", "sort_urls": "pos",
    "url_extract": "pos", "chunk_text": "chars", "chunk_fixed": "chunk_no", "extract_products_text": "pos",
    "extract_product_sections": "pos node_id", "extract_product_fields": "pos", "top_urls": "rank",
    "top_urls_with_features": "rank", "derive_rules": "rank", "derive_rules_deep": "rank depth", "products": "pos",
    "robots_report": "total_rules n_disallowed",
}
_BIGINTS = {"read_sitemap": "lastmod_seconds", "write_robots_jsonl": "download_seconds"}


def _typed(name: str, sql: str) -> str:
    casts = [f"CAST({c} AS INTEGER) AS {c}" for c in _INTEGERS.get(name, "").split()]
    casts += [f"CAST({c} AS BIGINT) AS {c}" for c in _BIGINTS.get(name, "").split()]
    return f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql}) r" if casts else sql


ORACLE: dict[str, str] = {name: _typed(name, sql) for name, sql in _RESULTS.items()}

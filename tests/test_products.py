from pyspark.sql import functions as F

from webloom.functions import text as X
from webloom.functions.sql import text_array
from webloom.operators import navigate, products
from webloom.sources import pages as page_source
from webloom.sources import robots as robots_source
from webloom.sources import sitemap
from webloom.operators import robots


def test_products_in_text(spark):
    df = spark.createDataFrame([(1, "- Tent Save 30% $19.95 - $39.95 - Rope$5"), (2, "- Hat $7.5"), (3, "no dash $5"),
                                (4, "- Top Rated Mug\r $1.00")], "id int, text string")
    got = [(r.id, r.pos, r.name, r.price) for r in products.extract_products_text(df).orderBy("id", "pos").collect()]
    assert got == [(1, 0, "Tent", "$19.95 - $39.95"), (1, 1, "Rope", "$5"), (2, 0, "Hat", "$7"), (4, 0, "Mug", "$1.00")]


def test_field_keywords(spark):
    def words(*fields):
        return set(spark.range(1).selectExpr(f"{X.field_keywords(text_array(fields))} AS k").first().k)

    assert words("image_url") == {"image_url", "image-url", "image", "url"}
    assert words("id") == {"id"}
    assert words("Sale-Price", "in_x") == {"sale-price", "sale_price", "in_x", "in-x"}


def test_strip_is_idempotent_and_ordered(spark):
    html = "<SCRIPT a>x\n</script>a<!-- <p> -->b<style>c</STYLE><meta x><link y><noscript>n</noscript><iframe>i</iframe>d"
    once = X.strip_irrelevant_html("h")
    row = spark.createDataFrame([(html,)], "h string").selectExpr(
        f"{once} AS a", f"{X.strip_irrelevant_html(once)} AS b").first()
    assert row.a == row.b == "abd"
    # Styles go before comments, so a style that opens in a comment takes the end of the comment with it.
    odd = spark.createDataFrame([("a<!-- <style> -->b<style>c</style>d",)], "h string").selectExpr(f"{once} AS a").first()
    assert odd.a == "a<!-- d"


def test_truncate(spark):
    row = spark.createDataFrame([("x" * 41,)], "h string").selectExpr(
        f"{X.truncate_budget('h', 10)} AS cut", f"{X.truncate_budget('h', 11)} AS whole").first()
    assert row.cut == "x" * 40 + "..." and row.whole == "x" * 41


CARD = ('<div class="product-card" data-product-id="7"><img src="/i.jpg"><h2>Top Rated Tent</h2><p>short</p>'
        "<p>a longer description</p><span>$19.95 - $39.95</span></div>")


def pages(spark, *htmls):
    return spark.createDataFrame([(i, "https://a.com/", h) for i, h in enumerate(htmls)],
                                 "page_id long, url string, html string")


def test_product_fields(spark):
    df = pages(spark, f"<main>{CARD}<div class='product-card'>nothing</div></main>")
    first, second = products.extract_product_fields(df).orderBy("pos").collect()
    assert (first.name, first.price, first.id, first.image_url, first.description) == (
        "Tent", "$19.95 - $39.95", "7", "/i.jpg", "a longer description")
    assert (second.name, second.price, second.id, second.image_url, second.description) == (None,) * 5


def test_first_selector_wins_and_price_fallback(spark):
    df = pages(spark, '<i data-product-id="1">a</i><i class="product-item">b</i>', "<b>$1.00</b><i>$2</i><u>$3.50</u>",
               "nothing", "<p>$1.00</p>" * 60)
    rows = products.extract_product_sections(df).orderBy("page_id", "pos").collect()
    by_page = {i: [r.section for r in rows if r.page_id == i] for i in range(4)}
    assert by_page[0] == ['<i class="product-item">b</i>']
    assert by_page[1] == ["<b>$1.00</b>", "<u>$3.50</u>"] and by_page[2] == []
    assert by_page[3] == ["<p>$1.00</p>"] * 60
    assert products.limit_products(df).filter("page_id = 3").count() == 50


def test_product_answers(spark):
    rows = [(1, '{"products":[{"name":"A","price":"$1"},{"id":"2"}]}', "- B$2"), (2, "sorry", "- B$2"),
            (3, None, "- B$2"), (4, '{"products":[]}', "- B$2"), (5, '{"other":1}', "- B$2 - C$3")]
    df = spark.createDataFrame(rows, "id int, response string, chunk string")
    got = {r.id: r for r in products.parse_product_response(df, ["id"]).collect()}
    assert [(p.name, p.price, p.id) for p in got[1].products] == [("A", "$1", None), (None, None, "2")]
    assert [p.name for p in got[2].products] == [p.name for p in got[3].products] == ["B"]
    assert got[4].products == [] and not got[4].from_text
    assert [p.name for p in got[5].products] == ["B", "C"] and got[5].from_text


def test_navigation_answers(spark):
    rows = [(1, '{"urls":["u"],"rules":[],"reasoning":["r"]}'), (2, '{"urls":["u"],"reasoning":["r"]}'), (3, "no"), (4, None)]
    got = {r.id: r.valid for r in navigate.parse_nav_response(
        spark.createDataFrame(rows, "id int, response string"), ["id"]).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}


def test_next_urls(spark):
    urls = [f"https://s.com/camp-camping/{i}" for i in range(3)] + ["https://s.com/hiking/boots", "https://s.com/about"]
    answer = navigate.nav_from_urls(spark.createDataFrame([(u,) for u in urls * 2], "url string")).collect()
    assert len(answer) == 1
    assert answer[0].urls == urls[:4] and answer[0].rules == ["/camp-camping"]
    assert answer[0].reasoning == ["matches camping"] * 3 + ["matches hiking"]


def test_top_urls_prefers_structure_then_density(spark):
    urls = spark.createDataFrame([("s", f"https://s.com/hiking/{i}") for i in "abc"], "site string, url string")
    features = spark.createDataFrame([("https://s.com/hiking/b", 1, 0.1), ("https://s.com/hiking/c", 1, 0.5)],
                                     "url string, structural_score int, content_density double")
    top = navigate.top_urls(navigate.relevant_urls(urls, ["hiking"]), features).orderBy("rank").collect()
    assert [r.url[-1] for r in top] == ["c", "b", "a"]


def test_extraction_prompts_show_whole_chunks(spark):
    df = spark.createDataFrame([("x" * 3500,)], "chunk string")
    prompt = navigate.build_extraction_prompts(df, "{html_content}|{format_instructions}", "J").first().prompt
    assert prompt == "x" * 3500 + "|J"


def test_sitemaps(spark):
    urlset = ('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://a.com/1?x=1&amp;y=2 </loc>'
              "<lastmod>2025-06-20T09:33:37.436-07:00</lastmod></url><url><loc>https://a.com/2</loc></url>"
              "<url><loc>https://a.com/2</loc></url></urlset>")
    index = "<sitemapindex><sitemap><loc>https://a.com/s.xml</loc></sitemap></sitemapindex>"
    df = spark.createDataFrame([("u", urlset), ("i", index), ("b", "<urlset><url><loc>x"), ("n", "none"), ("z", None)],
                               "sitemap_url string, body string")
    rows = sitemap.read_sitemap(df).orderBy("sitemap_url", "pos").collect()
    # A body cut off inside its last entry still gives that entry's location.
    assert [(r.sitemap_url, r.pos, r.loc) for r in rows] == [
        ("b", 0, "x"), ("i", 0, "https://a.com/s.xml"), ("u", 0, "https://a.com/1?x=1&y=2"), ("u", 1, "https://a.com/2"),
        ("u", 2, "https://a.com/2")]
    assert str(rows[2].lastmod) == "2025-06-20 16:33:37.436000"


def test_sitemaps_read_leniently(spark):
    bodies = [
        ("amp", "<urlset><url><loc><![CDATA[http://a/1?x=1&y=2]]></loc></url><url><loc>http://a/2 & b</loc></url></urlset>"),
        ("cdata", "<urlset><url><loc><![CDATA[http://a/1]]></loc></url></urlset>"),
        ("cut", "<urlset><url><loc>http://a/1</loc></url><url><loc>http://a/2</loc></url><url><loc>http://a/3"),
        ("prefix", '<ns:urlset xmlns:ns="http://www.sitemaps.org/schemas/sitemap/0.9"><ns:url><ns:loc>http://a/1</ns:loc>'
                   "</ns:url><ns:url><ns:loc>http://a/2</ns:loc></ns:url></ns:urlset>"),
        ("attr", '<urlset><url><loc id="x">http://a/1</loc><lastmod>2020-01-01</lastmod></url><url><loc>http://a/2</loc></url></urlset>'),
        ("open", "<urlset><url><loc>http://a/1</loc><url><loc>http://a/2</loc></urlset>"),
    ]
    rows = sitemap.read_sitemap(spark.createDataFrame(bodies, "sitemap_url string, body string")).collect()
    got = {(r.sitemap_url, r.pos, r.loc, r.malformed) for r in rows}
    assert got == {("amp", 0, "http://a/1?x=1&y=2", True), ("amp", 1, "http://a/2 & b", True), ("cdata", 0, "http://a/1", False),
                   ("cut", 0, "http://a/1", True), ("cut", 1, "http://a/2", True), ("cut", 2, "http://a/3", True),
                   ("prefix", 0, "http://a/1", True), ("prefix", 1, "http://a/2", True), ("attr", 0, "http://a/1", False),
                   ("attr", 1, "http://a/2", False), ("open", 0, "http://a/1", True), ("open", 1, "http://a/2", True)}


def test_first_valid_sitemap(spark):
    rows = [("s", 0, "a", 404, "A"), ("s", 1, "b", 200, "B"), ("s", 2, "c", 200, "C"), ("t", 0, "d", 500, "D")]
    df = spark.createDataFrame(rows, "site string, candidate_no int, sitemap_url string, http_status int, body string")
    assert [tuple(r) for r in sitemap.first_valid_sitemap(df).collect()] == [("s", "b", "B")]


def test_file_sources(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.html").write_text("<p>a\nb</p>")
    (tmp_path / "s.xml").write_text("<urlset><url><loc>https://a.com/1</loc></url></urlset>")
    (tmp_path / "robots.txt").write_text("User-agent: *\nDisallow: /x\n")
    page = page_source.read_page_files(spark, str(tmp_path / "p")).first()
    assert page.html == "<p>a\nb</p>" and page.url.endswith("/p/a.html")
    assert [r.loc for r in sitemap.read_sitemap_files(spark, str(tmp_path / "s.xml")).collect()] == ["https://a.com/1"]
    files = robots_source.read_robots_files(spark, str(tmp_path / "robots.txt"))
    rows = robots.robots_rows(files, F.expr("timestamp'2025-06-20 20:03:07.191'"))
    robots_source.write_robots_jsonl(rows, str(tmp_path / "jl"))
    stored = robots_source.read_robots_jsonl(spark, str(tmp_path / "jl")).orderBy("content").collect()
    assert [(r.directive, r.content, str(r.download_date)) for r in stored] == [
        ("user-agent", "*", "2025-06-20 20:03:07.191000"), ("disallow", "/x", "2025-06-20 20:03:07.191000")]


def test_pages_are_saved_by_address(spark, tmp_path):
    df = spark.createDataFrame([("https://a.com/1", "<p>1</p>", 5), ("https://a.com/2", "<p>2</p>", 6)],
                               "url string, html string, crawl_ts long")
    page_source.write_pages(df, str(tmp_path / "out"))
    saved = spark.read.parquet(str(tmp_path / "out"))
    assert saved.filter("crawl_ts = 6").first().html == "<p>2</p>" and saved.select("page_key").distinct().count() == 2


def test_records_by_structure_where_no_selector_hits(spark):
    """Cards with class names no selector knows give every product; a lone price keeps the element around it."""
    cards = "".join(f"<div class='x{i}'><a href='/p/{i}'><img src='/i/{i}.jpg'></a><h2>Item {i}</h2><p>about {i}</p>"
                    f"<span>${i}.99</span></div>" for i in range(5))
    html = f"<html><body><div class='grid'>{cards}</div><p>Total $3.00</p><ul><li>a</li><li>b</li></ul></body></html>"
    df = spark.createDataFrame([(1, "https://a.com/", html), (2, "https://a.com/x", "<p>only $1.00</p>")],
                               "page_id long, url string, html string")
    got = [tuple(r) for r in products.extract_product_fields(df).orderBy("page_id", "pos").collect()]
    assert got == [(1, i, f"Item {i}", f"${i}.99", None, f"/i/{i}.jpg", f"about {i}") for i in range(5)] + [
        (2, 0, None, "$1.00", None, None, "only $1.00")]

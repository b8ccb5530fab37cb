import random
from urllib.robotparser import RobotFileParser

from pyspark.sql import functions as F

from webloom.operators import robots
from webloom.sources.robots import read_robots_files

FIXTURE = """# comment only
Sitemap: https://shop.example.com/sitemap.xml
User-agent: *
Disallow: /cart
Disallow: /b/*q=
Allow: /cart/help
Disallow:

User-agent: BotA
User-agent: BotB
Disallow: /
Crawl-delay: 5
no colon here"""
BROWSER = "Mozilla/5.0 (X11)"
VALUES = ["", "/", "/a", "/a/b", "/a?", "/a?x=1", "/b*", "*", "/é", "/%C3%A9", "/a b", "/%7Eu", "/~u", "/a#c", "/a;p",
          "/a/%2F", "/p%", "/a%20b", "/a+b"]
PATHS = ["", "/", "/a", "/a/b/c", "/a?x=1", "/a?", "/b1", "/b*", "/é", "/%C3%A9x", "/a b", "/~u", "/%7Eu/x", "/a#c",
         "/a;p", "/a//", "/p%", "/p%zz", "/a+b", "//a", "/zz", "/a%2520b", "/A"]


def files(spark, rows):
    return spark.createDataFrame(rows, "robotstxt_url string, body string, http_status int")


def random_line(rng):
    roll = rng.random()
    if roll < 0.25:
        return rng.choice(["User-agent: ", "user-agent:", "USER-AGENT : "]) + rng.choice(
            ["*", "BotA", "BotB", "bot", "mozilla", "Moz", "%2A"])
    if roll < 0.65:
        return rng.choice(["Disallow: ", "Allow:", "disallow:"]) + rng.choice(VALUES)
    return rng.choice(["", "", "  ", "# c", "Crawl-delay: 5", "Sitemap: http://x/y", "junk", "Request-rate: 1/5"])


def test_verdicts_agree_with_robotparser(spark):
    rng = random.Random(5)
    rows, urls = [], []
    for i in range(250):
        body = rng.choice(["\n", "\r\n"]).join(random_line(rng) for _ in range(rng.randint(0, 14)))
        rows.append((f"https://h{i}.com/robots.txt", body, rng.choice([200] * 8 + [401, 403, 404, 500, None])))
        urls += [(f"https://h{i}.com{p}",) for p in rng.sample(PATHS, 8)]
    parsers = {}
    for url, body, status in rows:
        parser = RobotFileParser()
        if status in (401, 403):
            parser.disallow_all = True
        elif status and 400 <= status < 500:
            parser.allow_all = True
        elif status == 200:
            parser.parse(body.splitlines())
        parsers[url.split("/")[2]] = parser
    for agent in (BROWSER, "BotA/1", "BotB", "zzz"):
        got = robots.robots_allowed(spark.createDataFrame(urls, "url string"), files(spark, rows), agent).collect()
        wrong = [r for r in got if r.allowed != parsers[r.url.split("/")[2]].can_fetch(agent, r.url)]
        assert len(got) == len(urls) and not wrong, wrong[:3]


def test_fixture_rows_summary_and_groups(spark):
    df = files(spark, [("https://shop.example.com/robots.txt", FIXTURE, 200)])
    rows = robots.robots_rows(df, F.expr("timestamp'2025-06-20 20:03:07'")).orderBy("line_no").collect()
    assert len(rows) == 10
    assert (rows[0].directive, rows[0].content, rows[0].line_no) == ("sitemap", "https://shop.example.com/sitemap.xml", 2)
    summary = robots.robots_summary(df).first()
    assert summary.total_rules == 10
    assert summary.user_agents == ["*", "BotA", "BotB"]
    assert summary.disallowed_paths == ["/cart", "/b/*q=", "", "/"]
    assert (summary.allowed_paths, summary.crawl_delay) == (["/cart/help"], ["5"])
    group = robots.robots_group_for_agent(df, "BotB/1.0").first()
    assert (group.group_no, group.agents) == (1, ["BotA", "BotB"])
    assert robots.robots_group_for_agent(df, BROWSER).first().agents == ["*"]


def test_fixture_verdicts(spark):
    urls = ["/cart", "/cart/help", "/b/1q=2", "/"]
    df = spark.createDataFrame([("https://shop.example.com" + u,) for u in urls], "url string")
    for status, expected in ((200, [False, False, True, True]), (403, [False] * 4), (404, [True] * 4),
                             (None, [False] * 4)):
        rows = robots.robots_allowed(df, files(spark, [("https://shop.example.com/robots.txt", FIXTURE, status)]), BROWSER)
        assert {r.url[24:]: r.allowed for r in rows.collect()} == dict(zip(urls, expected))
    unknown = robots.robots_allowed(df, files(spark, [("https://other.com/robots.txt", FIXTURE, 200)]), BROWSER)
    assert [r.allowed for r in unknown.collect()] == [False] * 4


def test_empty_file_has_no_summary_and_no_rows(spark):
    df = files(spark, [("https://a.com/robots.txt", "# nothing\n\n", 200)])
    assert robots.robots_summary(df).count() == 0 and robots.robots_rows(df).count() == 0


def test_sites_meet_however_they_are_written(spark):
    files = spark.createDataFrame([
        ("https://shop.com/robots.txt", "User-agent: *\nDisallow: /no", 200),
        ("HTTPS://Shop.com:443/robots.txt", "", 403), ("http://shop.com/robots.txt", "", 404), (None, "", 200),
        ("robots.txt", "", 200)], "robotstxt_url string, body string, http_status int")
    cases = {"https://Shop.com/a": True, "https://shop.com:443/no": False, "https://me@shop.com/a": True,
             "http://shop.com:80/no": True, "https://shop.com:444/a": False, "/relative": False, "": False}
    urls = spark.createDataFrame([(u,) for u in cases] + [(None,)], "url string")
    got = [(r.url, r.allowed) for r in robots.robots_allowed(urls, files, "Bot").collect()]
    assert len(got) == len(cases) + 1 and {u: a for u, a in got if u is not None} == cases


def test_stored_robots_files_have_their_folder_as_host(spark, tmp_path):
    for host, body in (("a.com", "User-agent: *\nDisallow: /"), ("b.com", "User-agent: *\nDisallow: /x")):
        (tmp_path / host).mkdir()
        (tmp_path / host / "robots.txt").write_text(body)
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "notes.txt").write_text("Disallow: /")
    files = read_robots_files(spark, f"{tmp_path}/*/*.txt")
    urls = spark.createDataFrame([("https://a.com/y",), ("https://b.com/y",), ("https://b.com/x",)], "url string")
    got = {r.url: r.allowed for r in robots.robots_allowed(urls, files, "Bot").collect()}
    assert got == {"https://a.com/y": False, "https://b.com/y": True, "https://b.com/x": False}


def _many_rules(n):
    rng = random.Random(n)
    lines = ["User-agent: *"]
    for i in range(n):
        depth = rng.randint(1, 4)
        path = "".join(f"/d{rng.randint(0, 30)}" for _ in range(depth))
        lines.append(f"{rng.choice(['Allow', 'Disallow'])}: {path}")
    return "\n".join(lines)


def test_many_rules_agree_with_robotparser_and_scale(spark):
    """A site's rules are indexed once and each URL is a binary search: 500 -> 5,000 rules at most 1.5 x the time."""
    import time

    rng = random.Random(7)
    paths = ["".join(f"/d{rng.randint(0, 30)}" for _ in range(rng.randint(1, 5))) for _ in range(4000)]
    urls = spark.createDataFrame([(f"https://big.com{p}",) for p in paths], "url string")
    times = {}
    for n in (500, 5000):
        body = _many_rules(n)
        table = files(spark, [("https://big.com/robots.txt", body, 200)])
        parser = RobotFileParser()
        parser.parse(body.splitlines())
        started = time.time()
        got = {r["url"]: r["allowed"] for r in robots.robots_allowed(urls, table, "bot").collect()}
        times[n] = time.time() - started
        assert got == {f"https://big.com{p}": parser.can_fetch("bot", f"https://big.com{p}") for p in paths}
    assert times[5000] <= 1.5 * times[500] + 0.5, times


def test_group_for_agent_is_one_row_per_site(spark):
    rows = [("https://Shop.com/robots.txt", "User-agent: *\nDisallow: /a", 200),
            ("https://shop.com:443/robots.txt", "User-agent: *\nDisallow: /b\nDisallow: /c", 200),
            ("http://shop.com/robots.txt", "User-agent: BotB\nAllow: /", 404)]
    got = {r.site: r for r in robots.robots_group_for_agent(files(spark, rows), "BotB/1.0").collect()}
    assert set(got) == {"https://shop.com", "http://shop.com"}
    assert [x.path for x in got["https://shop.com"].rules] == ["/a"] and got["http://shop.com"].agents == ["BotB"]

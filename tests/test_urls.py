import random
import urllib.parse

import pytest
from pyspark.sql import functions as F

from webloom.functions import urls as U

BASES = ["https://shop.example.com/a/b?c=1", "http://h.com", "http://h.com/", "http://h.com/a/b/",
         "https://h.com/a/../b;p?q#f", "http://h.com/a//b/c", ""]
ATOMS = ["/", "..", ".", "a", "b", "?", "#", ";", "x=1", "//", "http:", "https:", "ftp:", "h.com", " ", "é", "%20", "&",
         "foo", "[", ":", "@", "+", "*", "~", "\t", "%zz", "]"]


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(1)
    rows = [(rng.choice(BASES), "".join(rng.choice(ATOMS) for _ in range(rng.randint(0, 6)))) for _ in range(4000)]
    rows = [(b, u) for b, u in rows if not ("[" in u and "]" in u)]
    return spark.createDataFrame(rows, "b string, u string")


def attempt(call, *args):
    try:
        return call(*args)
    except ValueError:
        return None


def test_resolution_agrees_with_urljoin(samples):
    rows = samples.select("b", "u", F.expr(U.resolve_url("u", "b")).alias("r")).collect()
    wrong = [(r.b, r.u, r.r) for r in rows if r.r != attempt(urllib.parse.urljoin, r.b, r.u)]
    assert not wrong, wrong[:5]


def test_validity_agrees_with_urlparse(samples):
    def valid(url):
        if not url or url.startswith(("data:", "#", "javascript:", "mailto:", "tel:")):
            return False
        parsed = attempt(urllib.parse.urlparse, url)
        return bool(parsed and (parsed.netloc or parsed.path))

    rows = samples.select("u", F.expr(U.is_valid_url("u")).alias("v")).collect()
    wrong = [(r.u, r.v) for r in rows if r.v != valid(r.u)]
    assert not wrong, wrong[:5]


def test_quoting_agrees_with_urllib(samples):
    rows = samples.select("u", F.expr(U.quote("u")).alias("q"), F.expr(U.unquote("u")).alias("d")).collect()
    assert all(r.q == urllib.parse.quote(r.u) and r.d == urllib.parse.unquote(r.u) for r in rows)


def test_normalize(spark):
    cases = {
        "x": "https://h.com/a/x", "/x": "https://h.com/x", "//cdn.com/x": "//cdn.com/x", "  /x ": "https://h.com/x",
        " ": "https://h.com/a/b", "": None, "#t": None, "mailto:a": None, "tel:1": None, "javascript:x": None,
        " #t": "https://h.com/a/b#t", "HTTP://o.com/": "HTTP://o.com/", "ftp://o.com/x": "ftp://o.com/x",
    }
    df = spark.createDataFrame([(k, "https://h.com/a/b") for k in cases], "u string, b string")
    rows = df.select("u", F.expr(U.normalize_url("u", "b")).alias("n"),
                     F.expr(U.normalize_url("u")).alias("plain")).collect()
    got = {r.u: r.n for r in rows}
    cases["HTTP://o.com/"] = urllib.parse.urljoin("https://h.com/a/b", "HTTP://o.com/")
    assert got == cases
    assert {r.u: r.plain for r in rows}["  /x "] == "/x"


def test_small_url_functions(spark):
    row = spark.range(1).selectExpr(
        f"{U.robots_url(chr(39) + 'https://h.com//' + chr(39))} AS r",
        f"{U.sitemap_candidates(chr(39) + 'https://h.com/' + chr(39))} AS s",
        f"{U.strip_slashes(chr(39) + '//x/y//' + chr(39))} AS t",
        f"{U.url_host(chr(39) + 'https://h.com:80/x' + chr(39))} AS h").first()
    assert row.r == "https://h.com/robots.txt"
    assert row.s == ["https://h.com/sitemap.xml", "https://h.com/sitemap_index.xml", "https://h.com/sitemap/sitemap.xml"]
    assert (row.t, row.h) == ("x/y", "h.com:80")

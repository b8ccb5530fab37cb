"""Sitemaps: locations in document order, from text columns or stored files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.sql import strip, text

_ENTRY = "ARRAY<STRUCT<loc: STRING, lastmod: STRING>>"
_SCHEMA = f"url {_ENTRY}, sitemap {_ENTRY}"


# Names may carry a namespace prefix, and tags attributes.
_PREFIX = r"(?:[\w.-]+:)?"


def _field(entry: str, name: str) -> str:
    """Text of one field of an entry, NULL where it is missing. A CDATA section is taken as it stands; other text runs to
    the next tag or the end of a cut-off body, with the five entities of XML decoded."""
    pattern = rf"(?s)<{_PREFIX}{name}(?:\s[^>]*)?>\s*(?:<!\[CDATA\[(.*?)(?:\]\]>|$)|([^<]*))"
    value = f"regexp_extract({entry}, {text(pattern)}, 2)"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        value = f"replace({value}, '{entity}', {text(char)})"
    return f"nullif(coalesce(nullif(regexp_extract({entry}, {text(pattern)}, 1), ''), {value}), '')"


def read_sitemap(sitemaps: DataFrame) -> DataFrame:
    """(sitemap_url, pos, loc, lastmod, malformed) of sitemaps (sitemap_url, body): trimmed, in order, duplicates kept.

    An index file gives the addresses of its sitemaps, which are not followed. A body that is not sound XML, such as
    one that was cut off or holds a bare ``&``, or whose names carry a namespace prefix, is read entry by entry instead,
    and its rows are ``malformed``: an entry ends at its end tag, the next entry or the end of the body; CDATA is taken
    as it stands; attributes on tags are passed over.
    """
    # The XML reader gives no entry, or only those before a fault, for a body with a fault anywhere.
    entries = "concat(coalesce(x.url, array()), coalesce(x.sitemap, array()))"
    # An entry ends at its end tag, at the next entry, or where a cut-off body ends.
    entry = text(rf"(?s)<{_PREFIX}(?:url|sitemap)(?:\s[^>]*)?>(.*?)"
                 rf"(?:</{_PREFIX}(?:url|sitemap)\s*>|(?=<{_PREFIX}(?:url|sitemap)[\s>])|$)")
    loose = (f"transform(regexp_extract_all(body, {entry}, 1), e -> named_struct("
             f"'loc', {_field('e', 'loc')}, 'lastmod', {_field('e', 'lastmod')}))")
    return (
        sitemaps.select("sitemap_url", "body", F.from_xml("body", _SCHEMA).alias("x"))
        .selectExpr("sitemap_url", "body", f"{entries} AS strict", f"{loose} AS loose")
        # The XML reader may also stop early without a word; where both readers do not count alike, entries count.
        .selectExpr("sitemap_url", "size(strict) = 0 OR size(strict) <> size(loose) AS malformed", "strict", "loose")
        .selectExpr("sitemap_url", "malformed", "if(malformed, loose, strict) AS entries")
        .selectExpr("sitemap_url", "malformed", "posexplode_outer(entries) AS (pos, entry)")
        .selectExpr("sitemap_url", "pos", f"{strip('entry.loc')} AS loc",
                    f"try_to_timestamp({strip('entry.lastmod')}) AS lastmod", "malformed")
        .filter("loc IS NOT NULL")
    )


def read_sitemap_files(spark: SparkSession, path: str) -> DataFrame:
    """Locations of stored sitemap files; a sitemap is at most 50 MB by its protocol, so one file is one row."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("sitemap_url"), F.col("value").alias("body"))
    return read_sitemap(files)


def first_valid_sitemap(fetched: DataFrame) -> DataFrame:
    """Per site the best candidate that was found: (site, sitemap_url, body) from
    (site, candidate_no, sitemap_url, http_status, body)."""
    found = fetched.filter("http_status = 200")
    best = found.groupBy(F.col("site").alias("best_site")).agg(F.min("candidate_no").alias("best_no"))
    return found.join(best, found["site"].eqNullSafe(best["best_site"]) & (found["candidate_no"] == best["best_no"])) \
        .select("site", "sitemap_url", "body")

"""What to crawl next, and what came of it.

URL lists are (pos, url) tables; ``pos`` is the place in the list. Limits work per host, because a list is normally
about one site and a table holds many lists.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.urls import url_host
from webloom.operators.ranking import first_per_key
from webloom.operators.robots import robots_allowed

_SALTS = 64


def filter_in_list(df: DataFrame, column: str, codes: Sequence | None) -> DataFrame:
    """Rows whose column is in the list; no list or an empty one keeps everything."""
    return df.filter(F.col(column).isin(*codes)) if codes else df


def visited_urls(log: DataFrame) -> DataFrame:
    """URLs of a log without most repetitions, as a join side.

    Deduplicating by (url, slice) folds a URL that fills a large part of the log before it moves, and leaves the join
    to place its own exchange, which AQE can split when a URL is frequent on the other side.
    """
    slice_no = F.pmod(F.xxhash64(*log.columns), F.lit(_SALTS))
    return log.select(F.col("url").alias("visited"), slice_no.alias("slice")).distinct().select("visited")


def unvisited_urls(urls: DataFrame, log: DataFrame) -> DataFrame:
    """Rows whose URL is not in the log, whatever its outcome there; positions and repetitions stay."""
    visited = visited_urls(log)
    return urls.join(visited, urls["url"] == visited["visited"], "left_anti")


def crawl_decisions(urls: DataFrame, log: DataFrame, robots_files: DataFrame, agent: str) -> DataFrame:
    """Unvisited URLs with ``host`` and ``allowed``; the forbidden ones are for the log."""
    fresh = unvisited_urls(urls, log).withColumn("host", F.expr(url_host("url")))
    return robots_allowed(fresh, robots_files, agent)


def forbidden_outcomes(decisions: DataFrame, agent: str) -> DataFrame:
    """Log rows of the URLs the robots rules forbid."""
    return decisions.filter("NOT allowed").select(
        "pos", "url", F.lit("forbidden").alias("status"), F.lit(None).cast("int").alias("http_status"),
        F.lit(None).cast("string").alias("file"), F.lit(agent).alias("detail"))


def crawl_frontier(urls: DataFrame, log: DataFrame, robots_files: DataFrame, agent: str,
                   max_pages: int = 50, keys: Sequence[str] = ("host",)) -> DataFrame:
    """The first ``max_pages`` allowed and unvisited URLs of every host, or of the whole run without ``keys``:
    (host, pos, url)."""
    allowed = crawl_decisions(urls, log, robots_files, agent).filter("allowed").select("host", "pos", "url")
    return first_per_key(allowed, keys, [F.col("pos")], max_pages)


def max_pages(outcomes: DataFrame, limit: int = 50, keys: Sequence[str] = ("host",), pos: str = "pos",
              counted: Column | str = "status = 'fetched'") -> DataFrame:
    """Outcomes up to and including the ``limit``-th counted one of each key, or of the whole run without keys;
    forbidden and failed rows do not count. A key with fewer counted rows keeps all its rows.

    The place of that row is found from counted rows alone, cut to ``limit`` per key before they move; then every row
    is compared with the place of its key.
    """
    if limit <= 0:
        return outcomes.limit(0)
    condition = F.expr(counted) if isinstance(counted, str) else counted
    hits = outcomes.filter(condition).select(*[F.col(k).alias(f"stop_{k}") for k in keys], F.col(pos).alias("stop_pos"))
    stop_keys = [f"stop_{k}" for k in keys]
    stops = (
        first_per_key(hits, stop_keys, [F.col("stop_pos")], limit)
        .groupBy(*stop_keys)
        .agg(F.max("stop_pos").alias("stop_pos"), F.count("*").alias("stop_count"))
        .filter(F.col("stop_count") == limit)
    )
    if not keys:
        # One value, or null where the limit is not reached.
        stop = stops.select("stop_pos").scalar()
        return outcomes.filter(stop.isNull() | (F.col(pos) <= stop))
    on = [outcomes[k].eqNullSafe(stops[f"stop_{k}"]) for k in keys]
    joined = outcomes.join(stops, on, "left")
    kept = joined.filter(F.col("stop_pos").isNull() | (F.col(pos) <= F.col("stop_pos")))
    return kept.select(*[outcomes[c] for c in outcomes.columns])


def crawl_summary(urls: DataFrame, log: DataFrame) -> DataFrame:
    """(status, n_urls): log entries per outcome, and listed URLs that are skipped because they were visited."""
    visited = visited_urls(log)
    skipped = urls.join(visited, urls["url"] == visited["visited"], "left_semi").select(
        F.lit("skipped_visited").alias("status"))
    return log.select("status").unionByName(skipped).groupBy("status").agg(F.count("*").alias("n_urls"))

"""Robots files as tables, and which URLs they let an agent fetch.

Input is one row per robots file, (robotstxt_url, body, http_status). Everything about a file is row-local. Deciding on
URLs is one join by host that keeps the URL rows as they are: a small policy table is broadcast by Spark on its
measured size, a large one is shuffled, and because both sides of that shuffle are plain exchanges, AQE can split a
host that holds a large share of all URLs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import robots as R
from webloom.functions.urls import host_key, url_host


def robots_lines(files: DataFrame) -> DataFrame:
    """Every line of every file: (robotstxt_url, line_no, value); lines count from 1."""
    return files.selectExpr("robotstxt_url", f"posexplode({R.lines('body')}) AS (i, value)").selectExpr(
        "robotstxt_url", "i + 1 AS line_no", "value")


def robots_rows(files: DataFrame, download_date: Column | None = None) -> DataFrame:
    """One row per directive: (directive, content, robotstxt_url, download_date, line_no)."""
    date = F.current_timestamp() if download_date is None else download_date
    return (
        files.selectExpr("robotstxt_url", f"inline({R.parsed_lines('body')})")
        .select("directive", "content", "robotstxt_url", date.alias("download_date"), "line_no")
    )


def filter_directive(rows: DataFrame, directive: str) -> DataFrame:
    return rows.filter(F.col("directive") == directive.lower())


def robots_summary(files: DataFrame) -> DataFrame:
    """One row per robots file that holds a directive: counts and lists in file order."""
    return (
        files.selectExpr("robotstxt_url", f"{R.parsed_lines('body')} AS entries")
        .selectExpr("robotstxt_url", f"{R.robots_summary('entries')} AS summary")
        .filter("summary IS NOT NULL")
        .select("robotstxt_url", "summary.*")
    )


def robots_report(files: DataFrame, stored: DataFrame) -> DataFrame:
    """(robotstxt_url, stored_rows, total_rules, n_disallowed): files next to the rows stored of them."""
    rows = stored.groupBy("robotstxt_url").agg(F.count("*").alias("stored_rows"))
    return robots_summary(files).join(rows, "robotstxt_url").selectExpr(
        "robotstxt_url", "stored_rows", "total_rules", "size(disallowed_paths) AS n_disallowed")


def robots_rules(files: DataFrame) -> DataFrame:
    """Long form of the policy: (host, group_no, agents, rule_no, allow, path)."""
    return (
        files.selectExpr(f"{url_host('robotstxt_url')} AS host", f"inline({R.agent_groups('body')})")
        .selectExpr("host", "group_no", "agents", "inline(rules)")
    )


def robots_group_for_agent(files: DataFrame, agent: str) -> DataFrame:
    """(site, host, http_status, group_no, agents, rules) of the group that applies to the agent, one row per site as
    ``host_key`` has it (``Shop.com`` and ``shop.com`` are one); NULLs where no group does. Of several files of a site
    the one that counts for verdicts is shown: found first, then the least address, then the least rules."""
    chosen = (
        files.selectExpr(f"{host_key('robotstxt_url')} AS site", f"{url_host('robotstxt_url')} AS host", "robotstxt_url",
                         "http_status", f"{R.agent_groups('body')} AS groups")
        .filter("site IS NOT NULL").withColumn("agent", F.lit(agent))
        .selectExpr("site", "host", "robotstxt_url", "http_status", f"{R.group_for_agent('groups', 'agent')} AS g")
    )
    order = "struct(if(http_status = 200, 0, 1), robotstxt_url, to_json(g.rules), http_status)"
    best = chosen.groupBy("site").agg(F.expr(f"min_by(struct(host, http_status, g), {order})").alias("best"))
    return best.selectExpr("site", "best.host AS host", "best.http_status AS http_status", "best.g.group_no AS group_no",
                           "best.g.agents AS agents", "best.g.rules AS rules")


def _policies(files: DataFrame, agent: str) -> DataFrame:
    """(site, policy): status and rules for the agent of the one file of each site that counts."""
    group = R.group_for_agent("groups", "agent")
    read = (
        files.selectExpr(f"{host_key('robotstxt_url')} AS site", "robotstxt_url", "http_status",
                         f"{R.agent_groups('body')} AS groups")
        .filter("site IS NOT NULL").withColumn("agent", F.lit(agent))
        .selectExpr("site", "robotstxt_url", "http_status", f"{group} AS g")
    )
    order = "struct(if(http_status = 200, 0, 1), robotstxt_url, to_json(g.rules), http_status)"
    return read.groupBy("site").agg(F.expr(
        f"min_by(struct(http_status AS status, g.rules AS rules), {order})").alias("policy"))


def robots_allowed(urls: DataFrame, files: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """``urls`` plus ``allowed``, a row for each row of ``urls``.

    URLs and files meet by scheme and host as ``host_key`` has it. Of several files of a site one counts: a file that
    was found before others, then the one with the least address, then the one with the least rules. A URL whose site
    has no file, or that is not absolute, was never cleared and is not allowed.
    """
    policies = _policies(files, agent)
    # The key is written anew, so the join places its own exchange, which AQE can split where a host is frequent.
    policy = policies.selectExpr("concat(site, '') AS policy_site", "policy.status AS policy_status",
                                 f"{R.rule_index('coalesce(policy.rules, array())')} AS policy_rules")
    joined = urls.withColumn("policy_key", F.expr(host_key(url))).join(
        policy, F.col("policy_key") == F.col("policy_site"), "left")
    verdict = R.robots_verdict("policy_status", "policy_rules", "policy_target")
    return (
        joined.withColumn("policy_target", F.expr(R.url_target(url)))
        .withColumn("allowed", F.expr(verdict))
        .drop("policy_key", "policy_site", "policy_status", "policy_rules", "policy_target")
    )

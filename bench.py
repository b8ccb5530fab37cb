"""Wall time of the headline queries. Prints one JSON line.

BENCH_SF_DIR  tables to read (default /root/testdata/sf0.1)
BENCH_CPUS    cores (default: all)
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from webloom.plans import catalog  # noqa: E402

HEADLINE = (
    "url_extract", "all_urls", "url_counts_by_category", "filter_html_pages", "html_to_text", "product_chunks",
    "chunk_text", "extract_product_fields", "robots_allowed", "crawl_frontier", "max_pages", "unvisited_urls",
    "nav_from_pages", "top_urls", "products", "stage_token_stats_all", "read_sitemap", "budget_removal",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.webloom.input.partitions", cpus)  # a test table is one row group
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    cold, warm = {}, {}
    for name in HEADLINE:
        for times in (cold, warm):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_wall", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm,
        "cold": cold, "sf": os.path.basename(sf_dir).removeprefix("sf"), "cpus": int(cpus), "pages": pages,
        "pages_per_sec": {n: round(pages / warm[n]) for n in ("url_extract", "filter_html_pages", "html_to_text")},
    }))


if __name__ == "__main__":
    main()

"""Pages in and out: tables, folders of HTML files, and saved crawls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages from a parquet table (page_id, url, html)."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def read_page_files(spark: SparkSession, path: str) -> DataFrame:
    """Pages from a file or a folder of HTML files, one row per file: (page_id, url, html).

    ``url`` is the file address. ``page_id`` is a hash of it, so it does not depend on the order files are listed in.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))
    return files.select(F.xxhash64("url").alias("page_id"), "url", "html")


def write_pages(fetched: DataFrame, path: str) -> None:
    """Append fetched pages (url, html, crawl_ts), one folder per crawl, each page keyed by the hash of its URL."""
    rows = fetched.select(F.sha2("url", 256).alias("page_key"), "url", "html", "crawl_ts")
    rows.write.mode("append").partitionBy("crawl_ts").parquet(path)

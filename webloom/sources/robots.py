"""Robots files and the robots table as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.schemas import ROBOTS

_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"


def read_robots_files(spark: SparkSession, path: str, scheme: str = "https",
                      host: str = r"([^/]+)/robots\.txt$") -> DataFrame:
    """Stored robots files, one row per file: (robotstxt_url, body, http_status).

    The host is the first group of the pattern ``host`` in the file's path, by default the folder a ``robots.txt`` lies
    in. A file whose path does not match has no address and clears nothing.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    found = F.regexp_extract("path", host, 1)
    address = F.when(found != "", F.concat(F.lit(f"{scheme}://"), found, F.lit("/robots.txt")))
    return files.select(address.alias("robotstxt_url"), "body", F.lit(200).alias("http_status"))


def write_robots_jsonl(rows: DataFrame, path: str) -> None:
    """Robots rows as JSON lines with ISO dates. An empty table writes no data file."""
    rows.select(*ROBOTS.names).write.mode("append").option("timestampFormat", _ISO).json(path)


def read_robots_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROBOTS).option("timestampFormat", _ISO).json(path)

"""Crawl logs and crawl results: text lines of fields joined by an arrow, and JSON objects."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.functions.sql import bind, strip
from webloom.schemas import CRAWL_RESULT

# The separator and the outcome texts of the log format.
ARROW = " --> "
SAVE_ERROR = "ERROR_SAVING_HTML"
FORBIDDEN = "forbidden by robotstxt for "
ERROR = "ERROR: "
UNREACHABLE = "Unreachable"
UNEXPECTED = "UNEXPECTED_ERROR: "


def parse_crawl_line(line: str) -> str:
    """SQL struct (url, status, http_status, file, detail) of a log line, NULL for a line that is no log entry."""
    rest = f"array_join(slice(p, 2, size(p)), '{ARROW}')"
    fields = f"""named_struct(
        'url', {strip('p[0]')},
        'status', CASE
            WHEN p[1] RLIKE '^[0-9]+$' THEN if(get(p, 2) = '{SAVE_ERROR}', 'save_error', 'fetched')
            WHEN startswith(p[1], 'forbidden by robotstxt') THEN 'forbidden'
            WHEN startswith(p[1], '{UNEXPECTED}') THEN 'unexpected'
            WHEN startswith(p[1], '{ERROR}') THEN 'error'
            WHEN p[1] = '{UNREACHABLE}' THEN 'unreachable'
            ELSE 'unknown' END,
        'http_status', try_cast(p[1] AS INT),
        'file', if(p[1] RLIKE '^[0-9]+$', nullif(get(p, 2), '{SAVE_ERROR}'), NULL),
        'detail', CASE
            WHEN startswith(p[1], '{FORBIDDEN}') THEN substring({rest}, {len(FORBIDDEN) + 1})
            WHEN startswith(p[1], '{UNEXPECTED}') THEN substring({rest}, {len(UNEXPECTED) + 1})
            WHEN startswith(p[1], '{ERROR}') THEN substring({rest}, {len(ERROR) + 1}) END)"""
    return bind(strip(line), "l",
                f"if(contains(l, '{ARROW}'), {bind(f'split(l, {ARROW!r})', 'p', fields)}, NULL)")


def crawl_log_line(url: str = "url") -> str:
    """SQL text of the log line of an outcome (url, status, http_status, file, detail)."""
    outcome = f"""CASE status
        WHEN 'fetched' THEN concat(http_status, '{ARROW}', file)
        WHEN 'save_error' THEN concat(http_status, '{ARROW}{SAVE_ERROR}')
        WHEN 'forbidden' THEN concat('{FORBIDDEN}', coalesce(detail, ''))
        WHEN 'error' THEN concat('{ERROR}', coalesce(detail, ''))
        WHEN 'unexpected' THEN concat('{UNEXPECTED}', coalesce(detail, ''))
        ELSE '{UNREACHABLE}' END"""
    return f"concat({url}, '{ARROW}', {outcome})"


def parse_crawl_log(lines: DataFrame, value: str = "value", pos: str | None = None) -> DataFrame:
    """(pos, url, status, http_status, file, detail), one row per log entry. Without a position column, positions
    follow the order of the input files and splits."""
    order = F.col(pos).cast("bigint") if pos else F.monotonically_increasing_id()
    entries = lines.select(order.alias("pos"), F.col(value).alias("line")).filter(f"contains({strip('line')}, '{ARROW}')")
    return entries.select("pos", F.expr(parse_crawl_line("line")).alias("entry")).select("pos", "entry.*")


def in_file_order(lines: DataFrame, value: str = "value") -> DataFrame:
    """(pos, value) of lines read from files: positions in the order of file names, then of places in a file.

    Lines are counted per split first (one row per split), and a prefix sum over splits in (file, offset) order gives
    each split its first position; a line adds its place within the split. Spark may pack files into a partition in any
    order; the positions do not depend on it.
    """
    marked = lines.select(F.col("_metadata.file_path").alias("log_file"), F.col("_metadata.file_block_start").alias("log_offset"),
                          F.monotonically_increasing_id().alias("log_row"), F.col(value).alias(value))
    splits = marked.groupBy("log_file", "log_offset").agg(F.min("log_row").alias("log_first"), F.count("*").alias("log_lines"))
    earlier = Window.orderBy("log_file", "log_offset").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("log_file", "log_offset", "log_first",
                           F.coalesce(F.sum("log_lines").over(earlier), F.lit(0)).alias("log_start"))
    return marked.join(starts, ["log_file", "log_offset"]).select(
        (F.col("log_start") + F.col("log_row") - F.col("log_first")).alias("pos"), value)


def read_crawl_log(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a log file or folder; no log yet means no entries. Positions count lines in the order of file names
    and of lines in a file."""
    try:
        lines = in_file_order(spark.read.text(path))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = spark.createDataFrame([], "pos long, value string")
    return parse_crawl_log(lines, pos="pos")


def write_crawl_log(outcomes: DataFrame, path: str) -> None:
    """Append one line per outcome; earlier entries stay."""
    outcomes.selectExpr(f"{crawl_log_line()} AS value").write.mode("append").text(path)


def read_crawl_results(spark: SparkSession, path: str) -> DataFrame:
    """Crawl results stored as JSON objects that may run over several lines."""
    return spark.read.schema(CRAWL_RESULT).option("multiLine", True).option(
        "timestampFormat", "yyyy-MM-dd HH:mm:ss").json(path)

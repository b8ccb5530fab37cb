"""The crawl frontier as a stream: every URL passes once, ever.

State is a table of passed URLs in shared storage, so memory does not grow with the crawl and a lost executor or a
restarted query finds it again. Batch folders are merged in tiers (``FANOUT`` units of a size class into one of the
next), so the folders and files to list grow with the logarithm of the batches.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

URLS = "url STRING"
_TABLE = f"{URLS}, source STRING, batch_id BIGINT, slice INT"
#: Folders a batch's URLs are dealt into by hash.
SLICES = 256


#: Units (single batches or merged ranges) of one size class that are merged into one of the next class.
FANOUT = 8
_MERGED = "_merged"


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, folder = _hadoop(spark, path)
    if not fs.exists(folder):
        return []
    return [status.getPath().getName() for status in fs.listStatus(folder) if status.isDirectory()]


def _complete(spark: SparkSession, path: str) -> bool:
    fs, folder = _hadoop(spark, f"{path}/_SUCCESS")
    return bool(fs.exists(folder))


def _units(spark: SparkSession, table: str, source: str) -> list[tuple[int, int, str]]:
    """(first batch, last batch, folder) of what holds a source's URLs now, oldest first: complete merged ranges that
    no larger complete range covers, and batch folders that no complete range covers. A merged range counts only once
    it is whole, so a merge cut off at any point changes nothing."""
    merged = []
    for name in _children(spark, f"{table}/{_MERGED}/source={source}"):
        lo, hi = (int(x) for x in name.split("=", 1)[1].split("-"))
        path = f"{table}/{_MERGED}/source={source}/{name}"
        if _complete(spark, path):
            merged.append((lo, hi, path))
    merged = [m for m in merged if not any(o[0] <= m[0] and m[1] <= o[1] and o[:2] != m[:2] for o in merged)]
    batches = []
    for name in _children(spark, f"{table}/source={source}"):
        b = int(name.split("=", 1)[1])
        if not any(lo <= b <= hi for lo, hi, _ in merged):
            batches.append((b, b, f"{table}/source={source}/{name}"))
    return sorted(merged + batches)


def passed_urls(spark: SparkSession, table: str) -> DataFrame:
    """(url, source, batch_id, slice) of URLs that passed so far; no table yet means none."""
    sources = [name.split("=", 1)[1] for name in _children(spark, table) if name.startswith("source=")]
    parts = []
    for source in sources:
        for lo, hi, path in _units(spark, table, source):
            if lo == hi and f"/source={source}/batch_id=" in path:
                rows = spark.read.schema("url STRING, slice INT").parquet(path).select(
                    "url", F.lit(source).alias("source"), F.lit(lo).cast("bigint").alias("batch_id"), "slice")
            else:
                rows = spark.read.schema(_TABLE).parquet(path)
            parts.append(rows)
    if not parts:
        return spark.createDataFrame([], _TABLE)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def compact(spark: SparkSession, table: str, source: str, fanout: int = FANOUT) -> None:
    """Merge the newest ``fanout`` units of one size class (a batch is class 0; a range of n batches class
    floor(log n / log fanout)) into one of the next, as often as that applies: a source keeps at most ``fanout`` units
    of each class, so the number of folders grows with the logarithm of the batches. Merged rows keep their batch
    number, and merged folders are dropped only after the range that holds them is whole."""
    import math

    # Batch folders that a whole merged range covers (left by a cut-off merge or a batch run again) go first.
    listed = {path for _, _, path in _units(spark, table, source)}
    for name in _children(spark, f"{table}/source={source}"):
        path = f"{table}/source={source}/{name}"
        if path not in listed:
            fs, folder = _hadoop(spark, path)
            fs.delete(folder, True)
    while True:
        units = _units(spark, table, source)
        classes = [int(math.log(hi - lo + 1) / math.log(fanout) + 1e-9) for lo, hi, _ in units]
        run = None
        for end in range(len(units), fanout - 1, -1):
            window = classes[end - fanout:end]
            if len(set(window)) == 1:
                run = units[end - fanout:end]
                break
        if run is None:
            return
        lo, hi = run[0][0], run[-1][1]
        rows = None
        for a, b, path in run:
            if a == b and f"/source={source}/batch_id=" in path:
                part = spark.read.schema("url STRING, slice INT").parquet(path).select(
                    "url", F.lit(source).alias("source"), F.lit(a).cast("bigint").alias("batch_id"), "slice")
            else:
                part = spark.read.schema(_TABLE).parquet(path)
            rows = part if rows is None else rows.unionByName(part)
        target = f"{table}/{_MERGED}/source={source}/range={lo}-{hi}"
        rows.repartition("slice").write.mode("overwrite").partitionBy("slice").parquet(target)
        for _, _, path in run:
            fs, folder = _hadoop(spark, path)
            fs.delete(folder, True)


def pass_batch(batch: DataFrame, batch_id: int, table: str, source: str, fanout: int = FANOUT) -> None:
    """Write the new URLs of one batch. A batch that runs again replaces its own rows and nothing else.

    The batch is deduplicated once. Only the slices its URLs fall into are read of the table, and these are cut to the
    URLs of the batch, so a small batch reads a small part of a long history.
    """
    slice_no = F.pmod(F.xxhash64("url"), F.lit(SLICES)).cast("int")
    urls = batch.select("url").where("url IS NOT NULL").dropDuplicates(["url"]).withColumn("slice", slice_no).persist()
    touched = [r["slice"] for r in urls.select("slice").distinct().collect()]  # at most SLICES
    own = (F.col("source") == source) & (F.col("batch_id") >= batch_id)
    before = passed_urls(batch.sparkSession, table).filter(F.col("slice").isin(touched) & ~own).select("url")
    known = before.join(urls, "url", "left_semi")
    fresh = urls.join(known, "url", "left_anti")
    fresh.write.mode("overwrite").partitionBy("slice").parquet(f"{table}/source={source}/batch_id={batch_id}")
    urls.unpersist()
    compact(batch.sparkSession, table, source, fanout)


def incremental_frontier(spark: SparkSession, folder: str, table: str, checkpoint: str,
                         files_per_batch: int | None = None) -> StreamingQuery:
    """Pass the URLs of new parquet files in ``folder`` on to ``table``, then stop. Several streams with checkpoints of
    their own can take turns on one table."""
    source = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    reader = spark.readStream.schema(URLS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (
        reader.parquet(folder).writeStream
        .foreachBatch(lambda batch, batch_id: pass_batch(batch, batch_id, table, source))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

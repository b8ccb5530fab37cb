"""What several operators share: stored intermediate tables, words, and text batches of bounded size."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: the ASCII characters 0x20 and 0x09 to 0x0D.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see.

    It lies in the folder the cluster names in ``spark.checkpoint.dir``. A local folder serves only where Spark itself
    is local; elsewhere a missing setting is an error, since executors would write to disks that nobody else reads.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="webloom-llm-")
    return os.path.join(named, uuid.uuid4().hex)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: later steps neither compute it again nor depend on the
    executors that made it."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def one_space(text: Column) -> Column:
    """Text with each run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bits that a screen has per key, those of one bitmap of Spark, and the most of all (32 MB).
_BITS_PER_KEY, _BITMAP, _MOST_BITS = 16, 32768, 1 << 28


def screened(rows: DataFrame, key: str, keys: DataFrame, maybe: str) -> DataFrame:
    """``rows`` plus a boolean column ``maybe``, false only where no row of ``keys`` has the key.

    ``key`` names a column of 64-bit hashes in both; ``keys`` is stored and holds each key once. The bits of the keys are
    broadcast, so rows are told apart without moving and only the others need an exact join. About one in sixteen other
    rows passes; more do where ``keys`` has over 2 ** 24 rows, for which the bits are the most of all.
    """
    bits = min(_MOST_BITS, max(_BITMAP, 1 << (_BITS_PER_KEY * keys.count() - 1).bit_length()))
    place = F.pmod(F.col(key), F.lit(bits).cast("long"))
    inside = F.pmod(place, F.lit(_BITMAP).cast("long"))
    # Keys move before they become bitmaps, so no task sends bitmaps of a few bits.
    bitmaps = keys.select(F.floor(place / _BITMAP).alias("__block"), inside.alias("__inside")).repartition("__block") \
        .groupBy("__block").agg(F.bitmap_construct_agg("__inside").alias("__bitmap"))
    byte = F.conv(F.hex(F.substring(F.col("__bitmap"), F.floor(inside / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.getbit(byte, F.pmod(inside, F.lit(8).cast("long")).cast("int"))
    joined = rows.join(F.broadcast(bitmaps), F.floor(place / _BITMAP) == F.col("__block"), "left")
    return joined.withColumn(maybe, F.coalesce(bit == 1, F.lit(False))).drop("__block", "__bitmap")

"""Table and column types shared by readers and operators."""

from __future__ import annotations

from pyspark.sql import types as T

NODE = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("last_id", T.IntegerType()),
    T.StructField("parent_id", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("kind", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("text", T.StringType()),
    T.StructField("marks", T.IntegerType()),
])
NODES = T.ArrayType(NODE)

# Elements without content or end tag.
VOID_TAGS = ("area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr", "image", "img",
             "input", "isindex", "keygen", "link", "menuitem", "meta", "nextid", "param", "source", "spacer", "track",
             "wbr")

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])
ROBOTS = T.StructType([
    T.StructField("directive", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("robotstxt_url", T.StringType()),
    T.StructField("download_date", T.TimestampType()),
])
CRAWL_RESULT = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("crawl_time", T.TimestampType()),
    T.StructField("errors", T.StringType()),
])
PRODUCT = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "price", "id", "image_url", "description")])
PRODUCT_LIST = T.StructType([T.StructField("products", T.ArrayType(PRODUCT))])
NAVIGATION = T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in ("urls", "rules", "reasoning")])

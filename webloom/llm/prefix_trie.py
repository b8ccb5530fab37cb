"""Conversation prefix trie by fixed-length block hashing.

Turns are cut into blocks of ``BLOCK`` turns. A conversation carries a chain of block digests: each digests the one
before and the turns of its block, so equal digests at depth j * BLOCK mean equal conversations up to there. Spark
groups conversations by (block number, digest of all blocks before); a group whose members all hold the same block (same
next digest) has one chain of nodes inside it, named by that digest and an offset, and no text of it is hashed again.
Only in groups where siblings diverge are turn boundaries refined: digests of each prefix inside the block.

Per node the members are conversations; subtree sums come from members alone: over a node's subtree the sum of
n_convs * bytes is the members' byte sums from that depth on, and each node of the subtree is counted once through its
smallest member. So every total is a group sum over (member, depth) rows; no node visits its ancestors, and no group is
gathered in one place. The digest of members that end at a node is streamed over them in id order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
#: Contract values: conversations are rebuilt on the one that ``c - c % BASE`` names, sharing its first crc32 % HEADS turns.
BASE, HEADS = 5, 9


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): turns ordered by turn, null first, ties by role and text; null role or text becomes empty.
    Rows without conv_id are left out."""
    turn = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"),
                    F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return (conversations.filter(F.col("conv_id").isNotNull())
            .groupBy(F.col("conv_id").cast("long").alias("conv_id"))
            .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
            .select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the first h turns of conversation c - c % 5 (floor modulo), then c's own turns after its first h,
    with h = crc32(decimal c) % 9."""
    own = ordered_turns(conversations)
    base = own.select(F.col("conv_id").alias("base_id"), F.col("turns").alias("base_turns"))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    joined = own.join(base, (F.col("conv_id") - F.pmod("conv_id", F.lit(BASE))) == F.col("base_id"), "left")
    head = F.coalesce(F.slice(F.col("base_turns"), 1, h), F.array().cast("array<struct<role:string,text:string>>"))
    tail = F.when(F.size("turns") > h, F.slice("turns", h + 1, F.size("turns"))).otherwise(
        F.array().cast("array<struct<role:string,text:string>>"))
    return joined.select("conv_id", F.concat(head, tail).alias("turns"))


def _content(turns) -> F.Column:
    """An injective text of some turns: each role and text with its length in front."""
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.length(t["role"]).cast("string"), F.lit(":"), t["role"], F.length(t["text"]).cast("string"), F.lit(":"), t["text"])), "")


def _member_rows(convs: DataFrame) -> DataFrame:
    """(conv_id, n_turns, depth, key, parent_key, bytes): one row per conversation and node on its path, root included."""
    n = F.size("turns")
    blocks = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int"))
    chain = F.aggregate(
        blocks, F.array(F.lit("")).cast("array<string>"),
        lambda acc, j: F.concat(acc, F.array(F.sha2(F.concat(F.element_at(acc, -1), _content(
            F.slice("turns", (j - 1) * BLOCK + 1, BLOCK))), 256))))
    per_block = (
        convs.filter(n > 0)
        .select("conv_id", n.alias("n_turns"), "turns", chain.alias("chain"), F.posexplode(blocks).alias("b", "j"))
        .filter(F.col("n_turns") > F.col("b") * BLOCK)
        .select("conv_id", "n_turns", "j", F.element_at("chain", F.col("j")).alias("prev"),
                F.element_at("chain", F.col("j") + 1).alias("cur"),
                F.slice("turns", (F.col("j") - 1) * BLOCK + 1, BLOCK).alias("block")))
    # Groups of the same block number and past: one next digest means one chain of nodes, and no refinement.
    groups = per_block.groupBy(F.col("j").alias("g_j"), F.col("prev").alias("g_prev")).agg(
        (F.min("cur") == F.max("cur")).alias("uniform"))
    marked = per_block.join(groups, (F.col("j") == F.col("g_j")) & (F.col("prev") == F.col("g_prev")))
    offsets = F.sequence(F.lit(1), F.size("block"))
    refined = F.aggregate(  # digests of each prefix inside the block, only where siblings diverge
        offsets, F.array().cast("array<string>"),
        lambda acc, o: F.concat(acc, F.array(F.when(
            F.col("uniform") & (o < F.size("block")), F.concat(F.col("cur"), F.lit("#"), o.cast("string")))
            .when(o == F.size("block"), F.col("cur"))
            .otherwise(F.sha2(F.concat(F.col("prev"), _content(F.slice("block", 1, o))), 256)))))
    turns = (
        marked.select("conv_id", "n_turns", "j", "prev", "block", refined.alias("keys"), F.posexplode("block").alias("o", "turn"))
        .select("conv_id", "n_turns", ((F.col("j") - 1) * BLOCK + F.col("o") + 1).alias("depth"),
                F.element_at("keys", F.col("o") + 1).alias("key"),
                F.when(F.col("o") == 0, F.col("prev")).otherwise(F.element_at("keys", F.col("o"))).alias("parent_key"),
                F.octet_length(F.col("turn.text")).cast("long").alias("bytes")))
    root = convs.select("conv_id", n.alias("n_turns"), F.lit(0).alias("depth"), F.lit("").alias("key"),
                        F.lit(None).cast("string").alias("parent_key"), F.lit(0).cast("long").alias("bytes"))
    return turns.unionByName(root)


def _stream_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined ids of each key, over rows sorted by (key, conv_id); state is one digest at a time."""
    keys, digests = [], []
    current, sha, sep = None, None, b""
    for batch in batches:
        for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key != current:
                if current is not None:
                    keys.append(current)
                    digests.append(sha.hexdigest())
                current, sha, sep = key, hashlib.sha256(), b""
            sha.update(sep + str(conv).encode())
            sep = b","
    if current is not None:
        keys.append(current)
        digests.append(sha.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(digests, pa.string())], ["e_key", "ends_sha256"])


def prefix_trie(conversations: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, key).

    Conversations (conv_id, turn, role, text) are rebuilt as :func:`rebuilt` says. The root (depth 0) holds every
    rebuilt conversation, turnless ones too; a node of depth d is a distinct sequence of first d (role, text) turns.
    ``conv_id`` is the smallest member, ``parent_conv_id`` the parent's (null for the root), ``n_leaves`` counts childless
    nodes of the subtree (the node itself included), ``saved_tokens`` sums (n_convs - 1) * UTF-8 bytes of the last text
    over the subtree, and ``ends_sha256`` digests the comma-joined ids, ascending, of members with exactly d turns (the
    empty string's digest when none). An empty table gives no rows; other columns are not read; repeated rows are
    repeated turns.
    """
    spark = conversations.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _member_rows(rebuilt(conversations.select("conv_id", "turn", "role", "text")))
    nodes = rows.groupBy("key").agg(
        F.min("depth").alias("depth"), F.max("parent_key").alias("parent_key"), F.count("*").alias("n_convs"),
        F.min("conv_id").alias("node_conv"), F.max("bytes").alias("last_bytes"))
    children = rows.select(F.col("parent_key").alias("c_parent"), F.col("key").alias("c_key")).filter(
        F.col("c_parent").isNotNull()).distinct().groupBy("c_parent").agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, F.col("key") == F.col("c_parent"), "left").select(
        "key", "depth", "parent_key", "n_convs", "node_conv", "last_bytes",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"))
    # Each member row learns whether it is its node's smallest member and whether the node is a leaf.
    flags = nodes.select(F.col("key").alias("f_key"), "node_conv", (F.col("n_children") == 0).alias("leaf"))
    member = rows.join(flags, F.col("key") == F.col("f_key")).withColumn("rep", F.col("conv_id") == F.col("node_conv"))
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = member.select(
        "key", "conv_id", "depth", "n_turns",
        F.sum("bytes").over(below).alias("all_bytes"),
        F.sum(F.when(F.col("rep"), F.col("bytes")).otherwise(0)).over(below).alias("rep_bytes"),
        F.sum(F.when(F.col("rep") & F.col("leaf"), 1).otherwise(0)).over(below).alias("rep_leaves"))
    totals = sums.groupBy(F.col("key").alias("t_key")).agg(
        (F.sum("all_bytes") - F.sum("rep_bytes")).cast("long").alias("saved_tokens"),
        F.sum("rep_leaves").cast("long").alias("n_leaves"))
    ends = (sums.filter(F.col("depth") == F.col("n_turns")).select("key", "conv_id")
            .repartition(parts, "key").sortWithinPartitions("key", "conv_id")
            .mapInArrow(_stream_ends, "e_key string, ends_sha256 string"))
    parents = nodes.select(F.col("key").alias("p_key"), F.col("node_conv").alias("parent_conv_id"))
    return (nodes.join(totals, F.col("key") == F.col("t_key"))
            .join(ends, F.col("key") == F.col("e_key"), "left")
            .join(parents, F.col("parent_key") == F.col("p_key"), "left")
            .select(F.col("node_conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"),
                    F.col("parent_conv_id").cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                    "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"), "key"))

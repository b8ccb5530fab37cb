"""Secrets by pattern and by how widely the corpus shares them.

Candidates are found in each text with patterns. Their hashes are counted over the corpus by distinct repositories and
owners: a value that several owners publish is an example that people copy, one that a single owner has looks live.
Unlabelled opaque strings are reported only where they look live; matches of the other patterns are always reported.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import stored


class Kind(NamedTuple):
    """A pattern, the group that holds the value, the least length of the value, and expressions it must also match."""

    name: str
    pattern: str
    group: int
    least: int
    also: tuple[str, ...] = ()


BASE = (
    Kind("assign",
         r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"""
         r"""[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20),
    Kind("hex", r"[0-9a-f]+", 0, 24),
)
#: Long strings that mix digits with capital and small letters, whatever stands before them.
OPAQUE = Kind("opaque", r"[A-Za-z0-9+/_=-]{20,}", 0, 20, ("[0-9]", "[a-z]", "[A-Z]"))
MAX_OWNERS = 2
MAX_REPOSITORIES = 3
_CHUNK = 256


def _running(lengths: str) -> str:
    """Sums of an array up to each place, in chunks, so the work per place does not grow with the array."""
    chunks = (f"transform(sequence(0, (size({lengths}) - 1) DIV {_CHUNK}), c -> slice({lengths}, c * {_CHUNK} + 1, "
              f"{_CHUNK}))")
    inner = ("aggregate(part, cast(array() AS array<bigint>), (a, x) -> "
             "array_append(a, x + coalesce(try_element_at(a, -1), 0L)))")
    sums = f"transform({chunks}, part -> {inner})"
    totals = ("aggregate(sums, cast(array(0) AS array<bigint>), (a, part) -> "
              "array_append(a, element_at(a, -1) + element_at(part, -1)))")
    placed = f"flatten(transform(sums, (part, i) -> transform(part, x -> x + element_at({totals}, i + 1))))"
    # ``sums`` is bound once by a lambda over a one-element array.
    return f"element_at(transform(array({sums}), sums -> {placed}), 1)"


def _spans(docs: DataFrame, kinds: Sequence[Kind]) -> DataFrame:
    """``docs`` with the column ``spans``: array of struct(start, kind_no, end, value) of all kinds. Columns f0, g0,
    v0 and so on are dropped again."""
    found = docs
    for i, kind in enumerate(kinds):
        # A longer pattern than the hex run's own would be tried at each letter; the length is tested here instead.
        pattern = f"{kind.pattern[:-1]}{{{kind.least},}}" if kind.name == "hex" else kind.pattern
        found = found.withColumn(f"f{i}", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
        found = found.withColumn(f"v{i}", F.when(F.size(f"f{i}") > 0, F.regexp_extract_all(
            "text", F.lit(pattern), F.lit(kind.group))) if kind.group else F.col(f"f{i}"))
        found = found.withColumn(f"g{i}", F.when(F.size(f"f{i}") > 0, F.split("text", pattern, -1)))
    for i in range(len(kinds)):
        steps = f"zip_with(g{i}, f{i}, (g, f) -> cast(coalesce(length(g), 0) + coalesce(length(f), 0) AS bigint))"
        found = found.withColumn(f"s{i}", F.expr(steps)).withColumn(
            f"e{i}", F.expr(f"CASE WHEN size(f{i}) > 0 THEN {_running(f's{i}')} END"))
    arrays = []
    for i, kind in enumerate(kinds):
        fits = " AND ".join([f"length(v{i}[j]) >= {kind.least}", *(f"v{i}[j] RLIKE '{p}'" for p in kind.also)])
        # The step of the last gap, after the last match, has no match.
        arrays.append(
            f"transform(filter(CASE WHEN size(f{i}) > 0 THEN sequence(0, size(f{i}) - 1) ELSE array() END, j -> {fits}), "
            f"j -> named_struct('start', e{i}[j] - length(f{i}[j]), 'kind_no', {i}, 'end', e{i}[j], "
            f"'value', sha2(v{i}[j], 256)))")
    keep = [F.col(c) for c in docs.columns if c != "text"]
    return found.select(*keep, F.expr(f"concat({', '.join(arrays)})").alias("spans"))


def _joined(spans: str, kinds: Sequence[Kind]) -> Column:
    """kind:start:end of an array of spans, by start, then by kind, comma-joined."""
    names = ", ".join(f"'{k.name}'" for k in kinds)
    return F.expr(f"array_join(transform(array_sort({spans}), s -> concat(array({names})[s.kind_no], ':', s.start, ':', "
                  f"s.end)), ',')")


def secret_scan(docs: DataFrame, owner: Column, repository: Column, id_column: str = "doc_id",
                text_column: str = "text", max_owners: int = MAX_OWNERS,
                max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """One row per document: (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example).

    Offsets are code points, end exclusive. ``spans`` lists the spans of the base kinds and the live-looking opaque
    ones that no base span touches. A null text counts as empty and has none; a null owner or repository is one of its
    own. Rows that repeat an id are scanned each. Texts are scanned whole. An empty table gives an empty result.
    """
    kinds = (*BASE, OPAQUE)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
                       F.coalesce(repository.cast("string"), F.lit("")).alias("repository"),
                       F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    scanned = _spans(rows, kinds)
    no = len(BASE)
    apart = (f"filter(spans, s -> s.kind_no < {no} OR NOT exists(spans, b -> b.kind_no < {no} AND b.start < s.end AND "
             f"s.start < b.end))")
    # The number of a row is stored with it, so it stays the same however often the table is read.
    scanned = stored(scanned.withColumn("spans", F.expr(apart)).withColumn("row_no", F.monotonically_increasing_id()))
    single = scanned.filter("size(spans) > 0").select(
        "row_no", "owner", "repository", F.explode_outer("spans").alias("span"))
    shared = single.groupBy(F.col("span.value").alias("shared_value")).agg(
        F.count_distinct("owner").alias("n_owners"), F.count_distinct("repository").alias("n_repositories"))
    live = F.expr(f"n_owners <= {max_owners} AND n_repositories <= {max_repositories}")
    judged = single.join(shared, F.col("span.value") == F.col("shared_value")).withColumn("live", live)
    per_row = judged.groupBy(F.col("row_no").alias("judged_row")).agg(
        F.collect_list(F.when((F.col("span.kind_no") == no) & F.col("live"), F.col("span"))).alias("added"),
        F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_example"))
    base = f"filter(spans, s -> s.kind_no < {no})"
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind_no = {i})) AS bigint)").alias(f"n_{k.name}")
              for i, k in enumerate(BASE)]
    full = f"concat({base}, coalesce(added, array()))"
    return scanned.join(per_row, F.col("row_no") == F.col("judged_row"), "left").select(
        "doc_id", *counts, F.sha2(_joined(base, kinds), 256).alias("base_sha256"), _joined(full, kinds).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"))

"""Chat formatting with a checked grammar.

A conversation is its turns in order. A user turn is ``[INST] text [/INST]``, an assistant turn `` text </s>`` after
``<s>``, a system turn ``[SYS] text [/SYS]``, any other role ``[ROLE] name [AS] text [/ROLE]``. Each turn is rendered,
read again by a deterministic parser and compared with its source; while they differ, control strings inside it are
escaped. An escape puts a backslash behind the first character of a control string, one more where backslashes stand
there already, so it can always be taken back.

Rendering is row-local. Only reading back needs the turns of a conversation in order; that is one sorted pass that
holds a turn at a time, so a conversation of any length fits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import shared_folder
from webloom.operators.batches import pieces

# What opens and closes a turn of a role.
OPEN = {"user": "[INST] ", "assistant": "<s> ", "system": "[SYS] "}
CLOSE = {"user": " [/INST]", "assistant": " </s>", "system": " [/SYS]"}
OTHER_OPEN, OTHER_AS, OTHER_CLOSE = "[ROLE] ", " [AS] ", " [/ROLE]"
CONTROL = ("[INST]", "[/INST]", "<s>", "</s>", "[SYS]", "[/SYS]", "[ROLE]", "[AS]", "[/ROLE]")
_ESCAPABLE = re.compile("|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in CONTROL))
_ESCAPED = re.compile("|".join(re.escape(c[0]) + r"\\+" + re.escape(c[1:]) for c in CONTROL))
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_FORMATTED = "conv_id long, turn long, place long, formatted string, mask_start long, mask_end long"
_READ = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
         "formatted_chars long")


def escape(text: str) -> str:
    return _ESCAPABLE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def _render(role: str, text: str) -> tuple[str, int]:
    """A turn, and where its text begins in it."""
    if role in OPEN:
        return OPEN[role] + text + CLOSE[role], len(OPEN[role])
    head = OTHER_OPEN + role + OTHER_AS
    return head + text + OTHER_CLOSE, len(head)


def parse_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of one rendered turn; fails where the grammar does not allow it."""
    for role, begin in OPEN.items():
        if formatted.startswith(begin):
            head, close = len(begin), CLOSE[role]
            break
    else:
        if not formatted.startswith(OTHER_OPEN):
            raise ValueError("a turn begins with no known mark")
        end = formatted.find(OTHER_AS, len(OTHER_OPEN))
        if end < 0:
            raise ValueError("a role has no end")
        role, head, close = unescape(formatted[len(OTHER_OPEN):end]), end + len(OTHER_AS), OTHER_CLOSE
    if len(formatted) < head + len(close) or not formatted.endswith(close):
        raise ValueError("a turn has no end")
    body = formatted[head:len(formatted) - len(close)]
    if _CONTROL.search(body):
        raise ValueError("a control string inside a turn")
    return role, unescape(body)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn that reads back as its source, and the span of its text under the loss mask (empty unless assistant)."""
    shown_role, shown = role, text
    for _ in range(2):
        formatted, begin = _render(shown_role, shown)
        try:
            same = parse_turn(formatted) == (role, text)
        except ValueError:
            same = False
        if same:
            return (formatted, begin, begin + len(shown)) if role == "assistant" else (formatted, 0, 0)
        shown_role, shown = role if role in OPEN else escape(role), escape(text)
    raise ValueError("a turn does not read back as its source")


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, place, formatted, mask_start, mask_end), one row per row of (conv_id, turn, role, text).

    A null role or text counts as empty. ``place`` orders rows that repeat a turn by role and text; null turns and
    conversations are values of their own, first in order. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4):
            turns = [render_turn(r, t) for r, t in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([t[0] for t in turns], pa.string()),
                 pa.array([t[1] for t in turns], pa.int64()), pa.array([t[2] for t in turns], pa.int64())],
                ["conv_id", "turn", "place", "formatted", "mask_start", "mask_end"])

    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.xxhash64(role, text).alias("place"), role.alias("role"), text.alias("text")) \
        .mapInArrow(run, _FORMATTED)


def write_chats(conversations: DataFrame, folder: str) -> None:
    format_turns(conversations).write.parquet(folder)


def read_chats(spark: SparkSession, folder: str) -> DataFrame:
    """Per conversation, from the formatted turns alone: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars). Digests run over role, line break, text, line break per turn, and over the text under the mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: list = []
        done: list[tuple] = []

        def close() -> None:
            if current:
                conv, n, turns, chars, loss, shown = current
                done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), shown))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done))
            done.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(),
                                                          pa.int64()))],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in pieces(batches, 1):
            for conv, formatted, a, b in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if not current or current[0] != conv:
                    close()
                    current[:] = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_turn(formatted)
                lost = unescape(formatted[a:b])
                current[1] += 1
                current[2].update(f"{role}\n{text}\n".encode())
                current[3] += len(lost)
                current[4].update(lost.encode())
                current[5] += len(formatted)
            if done:
                yield flush()
        close()
        if done:
            yield flush()

    turns = spark.read.schema(_FORMATTED).parquet(folder)
    order = ["conv_id", "turn", "place", "formatted"]
    return turns.repartition("conv_id").sortWithinPartitions(*order) \
        .select("conv_id", "formatted", "mask_start", "mask_end").mapInArrow(run, _READ)


def chat_format(conversations: DataFrame) -> DataFrame:
    """Write all conversations in the format to the shared folder and read them back."""
    folder = shared_folder(conversations.sparkSession)
    write_chats(conversations, folder)
    return read_chats(conversations.sparkSession, folder)

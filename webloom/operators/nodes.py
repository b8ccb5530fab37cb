"""One parse per page: HTML text to preorder-numbered nodes.

Everything else about documents is array work on ``nodes`` inside the row, or joins and windows once exploded, so a
page crosses into Python once and is never shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.operators.batches import pieces
from webloom.schemas import NODE, NODES, VOID_TAGS

# Attributes that hold a list of words.
WORD_LISTS = frozenset(("class", "rel", "rev", "accept-charset", "headers", "accesskey", "dropzone"))
# Elements whose white space is kept.
PREFORMATTED = frozenset(("pre", "textarea"))

_VOID = frozenset(VOID_TAGS)


class _Tree:
    """Appends parser events to flat columns.

    An end tag closes up to the nearest open element of its name, an unmatched one is ignored, and elements left open
    run to the end of their parent. ``tag`` of a text node is the tag around it.
    """

    def __init__(self, rows: list[tuple], last_ids: list[int], with_text: bool, marks: dict[str, int]) -> None:
        self.rows = rows
        self.marks = marks
        self.open_marks: list[int] = []
        self.last_ids = last_ids
        self.with_text = with_text
        self.first = len(rows)
        self.open_ids: list[int] = []
        self.open_tags: list[str | None] = []
        self.pending: list[str] = []
        self.append("document", None, None, None)
        self.open_ids.append(0)
        self.open_tags.append(None)
        self.open_marks.append(0)

    def append(self, kind: str, tag: str | None, attrs: list | None, text: str | None) -> int:
        number = len(self.rows) - self.first
        depth = len(self.open_ids)
        marks = self.open_marks[-1] if depth else 0
        if kind == "element":
            marks |= self.marks.get(tag, 0)
        self.rows.append((number, self.open_ids[-1] if depth else None, depth, kind, tag, attrs, text, marks))
        self.last_ids.append(number)
        return number

    def end_text(self) -> None:
        text = "".join(self.pending)
        self.pending.clear()
        if not self.with_text:
            return
        if text.isspace() and not text.strip(" \n\t\f\r") and not PREFORMATTED.intersection(self.open_tags):
            text = "\n" if "\n" in text else " "
        self.append("text", self.open_tags[-1], None, text)

    def start(self, tag: str, attrs: list[tuple[str, str | None]], alone: bool = False) -> None:
        if self.pending:
            self.end_text()
        held: list = []
        if attrs:
            values = {name: value or "" for name, value in attrs}
            for name in WORD_LISTS.intersection(values):
                values[name] = " ".join(values[name].split())
            held = list(values.items())
        number = self.append("element", tag, held, None)
        if not alone and tag not in _VOID:
            self.open_ids.append(number)
            self.open_tags.append(tag)
            self.open_marks.append(self.open_marks[-1] | self.marks.get(tag, 0))

    def end(self, tag: str) -> None:
        if self.pending:
            self.end_text()
        if tag in self.open_tags:
            depth = len(self.open_tags) - 1
            while self.open_tags[depth] != tag:
                depth -= 1
            self.close_to(depth)

    def close_to(self, depth: int) -> None:
        end = len(self.rows) - self.first - 1
        for number in self.open_ids[depth:]:
            self.last_ids[self.first + number] = end
        del self.open_ids[depth:], self.open_tags[depth:], self.open_marks[depth:]

    def text(self, data: str) -> None:
        self.pending.append(data)

    def aside(self, kind: str, text: str) -> None:
        if self.pending:
            self.end_text()
        if self.with_text:
            self.append(kind, self.open_tags[-1], None, text)

    def doctype(self, decl: str) -> None:
        self.aside("doctype", decl[8:] if decl[:8].lower() == "doctype " else decl)

    def finish(self) -> None:
        if self.pending:
            self.end_text()
        self.close_to(0)


class _Events(HTMLParser):
    """The standard parser, wired to a tree."""

    def __init__(self, tree: _Tree) -> None:
        super().__init__(convert_charrefs=True)
        self.handle_starttag = tree.start
        self.handle_startendtag = lambda tag, attrs: tree.start(tag, attrs, True)
        self.handle_endtag = tree.end
        self.handle_data = tree.text
        self.handle_comment = lambda data: tree.aside("comment", data)
        self.handle_decl = tree.doctype
        self.unknown_decl = lambda data: tree.aside("cdata", data[6:] if data[:6].upper() == "CDATA[" else data)
        self.handle_pi = lambda data: tree.aside("instruction", data)

    def updatepos(self, i: int, j: int) -> int:
        return j


_SPACE = r"[ \t\n\r\f]"
_ATTRS = rf"""((?:{_SPACE}+[a-zA-Z_:][-a-zA-Z0-9_:.]*(?:{_SPACE}*={_SPACE}*(?:"[^"]*"|'[^']*'))?)*){_SPACE}*"""
# Markup that reads the same in every version of the standard parser. Groups: text, tag and attributes and slash, end
# tag, raw element and attributes and body, comment, doctype.
_PLAIN = re.compile(
    rf"([^<]+)|<(?!(?i:script|style|title|textarea|iframe|noembed|noframes|noscript|xmp|plaintext)\b)"
    rf"([a-zA-Z][a-zA-Z0-9]*){_ATTRS}(/?)>"
    rf"|</([a-zA-Z][a-zA-Z0-9]*){_SPACE}*>"
    rf"|<(script|style){_ATTRS}>([^<]*(?:<(?!/{_SPACE}*(?i:script|style)|!--)[^<]*)*)</\6>"
    rf"|<(title|textarea){_ATTRS}>([^<]*)</\9>"
    r"|<!--(?!-?>)([^-]*(?:-[^-]+)*)-->|<!((?i:doctype)[^>]*)>"
)
_ATTR = re.compile(rf"""{_SPACE}+([^ \t\n\r\f=]+)(?:{_SPACE}*={_SPACE}*(?:"([^"]*)"|'([^']*)'))?""")
_UNSURE_ENTITY = re.compile(r"&(?![a-zA-Z0-9]+;|#[0-9]+;|#[xX][0-9a-fA-F]+;|[ \t\n\r\f]|$)")


def _attributes(source: str) -> list[tuple[str, str | None]]:
    if not source:
        return []
    return [(name.lower(), unescape(one or two)) for name, one, two in _ATTR.findall(source)]


def _read_plain(page: str, tree: _Tree) -> bool:
    """Read a page of plain markup with one pattern, several times faster than the parser does. Says no, and touches
    nothing, if any part of the page is not plain."""
    tokens = list(_PLAIN.finditer(page))
    if sum(m.end() - m.start() for m in tokens) != len(page) or "\0" in page:
        return False
    for m in tokens:
        source = m[3] or m[7] or m[10]
        if source and "&" in source and _UNSURE_ENTITY.search(source):
            return False
    for m in tokens:
        kind = m.lastindex
        if kind == 1:
            tree.text(unescape(m[1]))
        elif kind == 4:
            tree.start(m[2].lower(), _attributes(m[3]), bool(m[4]))
        elif kind == 5:
            tree.end(m[5].lower())
        elif kind in (8, 11):
            tag, source, body = m.group(6, 7, 8) if kind == 8 else m.group(9, 10, 11)
            tree.start(tag, _attributes(source))
            if body:
                tree.text(body if kind == 8 else unescape(body))
            tree.end(tag)
        elif kind == 12:
            tree.aside("comment", m[12])
        else:
            tree.doctype(m[13])
    return True


def _nodes_array(html: pa.Array, with_text: bool, marks: dict[str, int], bare: bool) -> pa.Array:
    rows: list[tuple] = []
    last_ids: list[int] = []
    offsets = [0]
    for page in html.to_pylist():
        if page is not None:
            tree = _Tree(rows, last_ids, with_text, marks)
            if not _read_plain(page, tree):
                parser = _Events(tree)
                parser.feed(page)
                parser.close()
            tree.finish()
        offsets.append(len(rows))
    if not bare:
        kept = [i for i, row in enumerate(rows) if row[5]]
        offsets = [bisect_left(kept, o) for o in offsets]
        rows, last_ids = [rows[i] for i in kept], [last_ids[i] for i in kept]
    columns = list(zip(*rows)) if rows else [()] * 8
    columns.insert(1, last_ids)
    types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(),
             pa.map_(pa.string(), pa.string()), pa.string(), pa.int32())
    arrays = [pa.array(column, kind) for column, kind in zip(columns, types)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(arrays, NODE.names))


def parse_nodes(pages: DataFrame, html: str = "html", keep: Sequence[str] = ("page_id", "url"),
                with_text: bool = True, groups: Sequence[Sequence[str]] = (), bare: bool = True) -> DataFrame:
    """``keep`` columns plus ``nodes``, one row per page. Bit k of a node's ``marks`` tells that it lies in, or is, an
    element whose tag is in the k-th of ``groups``.

    ``with_text=False`` leaves text and comments out, for operators that read tags and attributes only; node numbers
    are then dense over elements. ``bare=False`` gives only elements that have attributes, so the many plain ones never
    leave the parser; numbers then have gaps. A NULL page gives an empty array.
    """
    keep = [c for c in keep if c in pages.columns]
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField("nodes", NODES)])

    marks: dict[str, int] = {}
    for bit, tags in enumerate(groups):
        for tag in tags:
            marks[tag] = marks.get(tag, 0) | 1 << bit

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, len(keep)):
            nodes = _nodes_array(part.column(len(keep)), with_text, marks, bare)
            yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], nodes], [*keep, "nodes"])

    return pages.select(*keep, html).mapInArrow(parse, schema)


def explode_nodes(parsed: DataFrame, keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """Long form, one row per node, for work across pages. The explode is an outer one with a filter behind it: a plain
    one would filter on the array first and build it twice."""
    return parsed.select(*keep, F.explode_outer("nodes").alias("node")).filter("node IS NOT NULL").select(*keep, "node.*")

"""Slow and plain versions of the document operators, one page at a time, to compare with."""

from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


class Node:
    def __init__(self, kind, tag=None, attrs=None, text=None, parent=None):
        self.kind, self.tag, self.attrs, self.text, self.parent = kind, tag, attrs or {}, text, parent
        self.children = []

    def walk(self):
        for child in self.children:
            yield child
            yield from child.walk()

    def string(self):
        return "".join(n.text for n in self.walk() if n.kind == "text" and n.parent.tag not in ("script", "style"))

    def html(self):
        inner = "".join(c.html() for c in self.children)
        if self.kind == "document":
            return inner
        if self.kind == "text":
            return self.text if self.parent.tag in ("script", "style") else escape(self.text)
        if self.kind == "comment":
            return f"<!--{self.text}-->"
        if self.kind == "doctype":
            return f"<!DOCTYPE {self.text}>\n"
        start = self.tag + "".join(f" {k}={quoted(v)}" for k, v in self.attrs.items())
        return f"<{start}/>" if self.tag in VOID else f"<{start}>{inner}</{self.tag}>"


def escape(text):
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def quoted(value):
    value = escape(value)
    if '"' not in value:
        return f'"{value}"'
    return f"'{value}'" if "'" not in value else '"' + value.replace('"', "&quot;") + '"'


class Builder(HTMLParser):
    def __init__(self):
        super().__init__()
        self.root = self.at = Node("document")
        self.data = ""

    def add(self, node):
        self.flush()
        node.parent = self.at
        self.at.children.append(node)
        return node

    def flush(self):
        text, self.data = self.data, ""
        if text:
            if not text.strip(" \n\t\f\r"):
                text = "\n" if "\n" in text else " "
            self.add(Node("text", text=text))

    def handle_starttag(self, tag, attrs):
        values = {k: v or "" for k, v in attrs}
        if "class" in values:
            values["class"] = " ".join(values["class"].split())
        node = self.add(Node("element", tag, values))
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        self.flush()
        node = self.at
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data):
        self.data += data

    def handle_comment(self, data):
        self.add(Node("comment", text=data))

    def handle_decl(self, decl):
        self.add(Node("doctype", text=decl[8:]))


def parse(html):
    builder = Builder()
    builder.feed(html)
    builder.close()
    builder.flush()
    return builder.root


def chunks(text, size, overlap, separators=("\n\n", "\n", " ", "")):
    """Greedy chunks, written as the rule says: pieces one by one, and a window that drops pieces from its front."""
    mark = next(s for s in separators if s in text)
    rest = separators[separators.index(mark) + 1:]
    pieces = list(text) if not mark else [
        (mark if i else "") + p for i, p in enumerate(text.split(mark)) if p or i]
    out, short = [], []

    def join():
        window = []
        for piece in short:
            if window and len("".join(window)) + len(piece) > size:
                out.append("".join(window).strip())
                while window and (len("".join(window)) > overlap or len("".join(window)) + len(piece) > size):
                    window.pop(0)
            window.append(piece)
        out.append("".join(window).strip())
        short.clear()

    for piece in pieces:
        if len(piece) < size:
            short.append(piece)
        else:
            join()
            out.extend(chunks(piece, size, overlap, rest) if rest else [piece])
    join()
    return [c for c in out if c]

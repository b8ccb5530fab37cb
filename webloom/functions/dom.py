"""Document expressions: predicates and array work on the ``nodes`` of a page.

``nodes`` is in preorder and ``id`` is the position in the array, so the subtree of a node is one slice and a contains
test is an interval test. Everything stays inside the row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from webloom.functions.sql import any_of, bind, strip, text, texts
from webloom.functions.text import CHARS_PER_TOKEN, contains_any_of
from webloom.schemas import VOID_TAGS

Predicate = Callable[[str], str]

RAW_TEXT_TAGS = ("script", "style")
_INTERVALS = "cast(array() AS array<struct<id:int,last_id:int>>)"


# --- selectors: predicates on one node -------------------------------------------------------------------------------

def attr(node: str, name: str) -> str:
    return f"{node}.attrs[{text(name)}]"


def is_element(node: str) -> str:
    return f"{node}.kind = 'element'"


def by_tag(*tags: str) -> Predicate:
    return lambda n: f"({n}.kind = 'element' AND {n}.tag IN ({texts(tags)}))"


def by_class(name: str) -> Predicate:
    return lambda n: (f"({n}.kind = 'element' AND contains(concat(' ', coalesce({attr(n, 'class')}, ''), ' '), "
                      f"{text(f' {name} ')}))")


def with_attr(name: str, value: str | None = None, tag: str | None = None) -> Predicate:
    """Has the attribute, with this value if one is given, on this tag if one is given."""

    def test(n: str) -> str:
        held = f"{attr(n, name)} IS NOT NULL" if value is None else f"{attr(n, name)} <=> {text(value)}"
        on_tag = f" AND {n}.tag = {text(tag)}" if tag else ""
        return f"({n}.kind = 'element' AND {held}{on_tag})"

    return test


def by_id(name: str) -> Predicate:
    return with_attr("id", name)


def attr_contains(name: str, part: str) -> Predicate:
    """Attribute contains ``part``; an empty part matches nothing."""
    if not part:
        return lambda n: "false"
    return lambda n: f"({n}.kind = 'element' AND contains(coalesce({attr(n, name)}, ''), {text(part)}))"


def data_attr_contains(part: str) -> Predicate:
    """Any ``data-`` attribute whose value contains ``part``."""
    return lambda n: (f"({n}.kind = 'element' AND exists(map_entries({n}.attrs), "
                      f"e -> startswith(e.key, 'data-') AND contains(e.value, {text(part)})))")


def _is_string(n: str) -> str:
    return f"{n}.kind NOT IN ('element', 'document')"


def text_matches(pattern: str) -> Predicate:
    """Text, comment and doctype nodes that match a regular expression."""
    return lambda n: f"({_is_string(n)} AND {n}.text RLIKE {text(pattern)})"


def text_contains(words: str) -> Predicate:
    """Text, comment and doctype nodes that contain one word of an array of lower-case words."""
    return lambda n: f"({_is_string(n)} AND {contains_any_of(f'{n}.text', words)})"


def select_elements(nodes: str, predicate: Predicate) -> str:
    return f"filter({nodes}, n -> {predicate('n')})"


# --- subtrees -------------------------------------------------------------------------------------------------------

def subtree(nodes: str, node: str) -> str:
    """The node and everything inside it."""
    return f"slice({nodes}, {node}.id + 1, {node}.last_id - {node}.id + 1)"


def inside(node: str, outer: str) -> str:
    return f"({outer}.id <= {node}.id AND {node}.id <= {outer}.last_id)"


def outermost(nodes: str) -> str:
    """Intervals of the nodes that lie in no other node of the list (list in document order).

    The fold fills short runs and closes them when full, so a page of many thousand hits does not copy its whole list
    for each of them.
    """
    return f"""aggregate(transform({nodes}, o -> named_struct('id', o.id, 'last_id', o.last_id)),
        named_struct('last', -1, 'run', {_INTERVALS}, 'full', cast(array() AS array<array<struct<id:int,last_id:int>>>)),
        (k, o) -> CASE WHEN o.id <= k.last THEN k
            WHEN size(k.run) >= 256 THEN
                named_struct('last', o.last_id, 'run', array(o), 'full', array_append(k.full, k.run))
            ELSE named_struct('last', o.last_id, 'run', array_append(k.run, o), 'full', k.full) END,
        k -> flatten(array_append(k.full, k.run)))"""


def drop_subtrees(nodes: str, bad: str) -> str:
    """Nodes without the given elements and everything inside them: the slices between the outermost bad intervals."""
    starts = "concat(array(0), transform(gone, g -> g.last_id + 1))"
    ends = f"concat(transform(gone, g -> g.id), array(size({nodes})))"
    return bind(outermost(bad), "gone",
                f"flatten(zip_with({starts}, {ends}, (s, e) -> slice({nodes}, s + 1, e - s)))")


def text_of(nodes: str) -> str:
    """Text of the given nodes as a reader sees it: no comments, no script or style bodies."""
    return (f"array_join(transform(filter({nodes}, t -> t.kind IN ('text', 'cdata') AND "
            f"coalesce(t.tag NOT IN ({texts(RAW_TEXT_TAGS)}), true)), t -> t.text), '')")


def ancestor_context(nodes: str, node: str, levels: int = 2) -> str:
    """From the parent of a text node up to ``levels`` more parents, stopping at the document node."""
    number = f"{node}.parent_id"
    for level in range(levels):
        name = f"up{level}"
        number = bind(number, name, f"if({name} > 0, get({nodes}, {name}).parent_id, {name})")
    return number


def html_to_text(nodes: str) -> str:
    """Text inside wanted elements and outside unwanted ones, trimmed and on one line. The nodes are marked with the
    wanted tags as first group and the unwanted ones as second."""
    kept = f"filter({nodes}, n -> n.kind = 'text' AND n.marks = 1)"
    lines = f"flatten(transform({kept}, t -> split(t.text, '\\n')))"
    trimmed = f"transform({lines}, line -> {strip('line')})"
    return f"array_join(filter({trimmed}, line -> line <> ''), ' ')"


# --- back to HTML ---------------------------------------------------------------------------------------------------

def _escaped(value: str) -> str:
    return f"replace(replace(replace({value}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _attribute(entry: str) -> str:
    quoted = """CASE WHEN NOT contains(v, '"') THEN concat('"', v, '"')
        WHEN NOT contains(v, '\\'') THEN concat('\\'', v, '\\'')
        ELSE concat('"', replace(v, '"', '&quot;'), '"') END"""
    return f"concat(' ', {entry}.key, '=', {bind(_escaped(f'{entry}.value'), 'v', quoted)})"


_IS_VOID = f"({texts(VOID_TAGS)})"


def open_token(n: str) -> str:
    """What a node puts before its children."""
    return f"""CASE {n}.kind
        WHEN 'element' THEN concat('<', {n}.tag,
            if(size({n}.attrs) > 0, array_join(transform(map_entries({n}.attrs), a -> {_attribute('a')}), ''), ''),
            if({n}.tag IN {_IS_VOID}, '/>', '>'))
        WHEN 'text' THEN if({n}.tag IN ({texts(RAW_TEXT_TAGS)}), {n}.text, {_escaped(f'{n}.text')})
        WHEN 'comment' THEN concat('<!--', {n}.text, '-->')
        WHEN 'doctype' THEN concat('<!DOCTYPE ', {n}.text, '>\\n')
        WHEN 'cdata' THEN concat('<![CDATA[', {n}.text, ']]>')
        WHEN 'raw' THEN {n}.text
        WHEN 'instruction' THEN concat('<?', {n}.text, '>')
        ELSE '' END"""


def close_token(n: str) -> str:
    return f"if({n}.kind = 'element' AND {n}.tag NOT IN {_IS_VOID}, concat('</', {n}.tag, '>'), '')"


def render_html(nodes: str) -> str:
    """HTML of a run of nodes: start tokens at ``id`` and end tokens at ``last_id``, inner ends first."""
    opens = (f"transform({nodes}, n -> named_struct('position', n.id, 'ending', 0, 'rank', n.id, "
             f"'token', {open_token('n')}))")
    closes = (f"transform(filter({nodes}, n -> n.kind = 'element' AND n.tag NOT IN {_IS_VOID}), n -> named_struct("
              f"'position', n.last_id, 'ending', 1, 'rank', -n.id, 'token', {close_token('n')}))")
    return f"array_join(transform(sort_array(concat({opens}, {closes})), k -> k.token), '')"


def rendered_length(nodes: str) -> str:
    """Length of ``render_html`` without building it."""
    return (f"aggregate({nodes}, 0L, (total, n) -> total + length({open_token('n')}) + length({close_token('n')}))")


# --- attributes -----------------------------------------------------------------------------------------------------

# Attributes that can name or describe a field.
KEPT_ATTRIBUTES = ("id", "class", "name", "for", "value", "placeholder", "title", "alt", "aria-label", "data-field",
                   "data-name")


def keeps_attribute(name: str, fields: Sequence[str]) -> str:
    low = [f.lower() for f in fields]
    named = any_of(f"contains(lower({name}), {text(f)})" for f in low)
    return (f"({name} IN ({texts((*KEPT_ATTRIBUTES, *(f'data-{f}' for f in low)))}) "
            f"OR (startswith({name}, 'data-') AND {named}))")


def compress_attributes(nodes: str, fields: Sequence[str]) -> str:
    """Nodes whose attributes are cut to those that can name or describe a field."""
    return (f"transform({nodes}, n -> named_struct('id', n.id, 'last_id', n.last_id, 'parent_id', n.parent_id, "
            f"'depth', n.depth, 'kind', n.kind, 'tag', n.tag, "
            f"'attrs', map_filter(n.attrs, (k, v) -> {keeps_attribute('k', fields)}), 'text', n.text))")


# --- token budget ---------------------------------------------------------------------------------------------------

# What may go when a page is over budget, least valuable group first.
REMOVAL_TAGS = ("svg", "nav", "footer", "aside")
REMOVAL_GROUPS = (
    (by_tag("svg"), with_attr("alt", "", tag="img"), by_class("icon"), by_class("decoration")),
    (by_tag("nav"), by_class("navigation"), by_class("menu"), by_class("breadcrumb")),
    (by_tag("footer"), by_class("footer")),
    (by_class("sidebar"), by_class("aside"), by_tag("aside")),
)


def scan(values: str, combine: Callable[[str, str], str]) -> str:
    """Inclusive prefix scan of an array (sums, maxima) by doubling: ceil(log2(size)) passes of one ``transform``
    each, so n values cost n log n steps and no array is copied per element."""
    steps = ("if(size(xs) > 1, sequence(0, cast(ceil(log2(size(xs))) AS int) - 1), cast(array() AS array<int>))")
    body = (f"aggregate({steps}, xs, (acc, k) -> transform(acc, (v, i) -> "
            f"if(i >= shiftleft(1, k), {combine('v', 'acc[i - shiftleft(1, k)]')}, v)))")
    return bind(values, "xs", body)


def _readable(n: str) -> str:
    return f"({n}.kind IN ('text', 'cdata') AND coalesce({n}.tag NOT IN ({texts(RAW_TEXT_TAGS)}), true))"


def _let(body: str, prefix: str) -> str:
    """``body`` with each ``@name`` bound once to column ``prefix + name``. Spark may fold a step's column into the next
    step; a reference inside a lambda would then be computed for every element, so each is bound first."""
    names = sorted(set(re.findall(r"@(\w+)", body)))
    body = re.sub(r"@(\w+)", r"v_\1", body)
    for name in names:
        body = bind(f"{prefix}{name}", f"v_{name}", body)
    return body


def budget_steps(nodes: str, keywords: str, max_tokens: int, chars: str | None = None,
                 prefix: str = "_budget_") -> list[tuple[str, str]]:
    """Nodes after removing candidates one by one until the page fits its token budget, as (column, expression)
    steps; the last step's column holds the nodes. ``chars`` is the rendered length of the nodes where it is known.

    What an earlier removal took is not counted again when an element around it goes. Removing the first k candidates
    removes every node whose first covering candidate is among them, so the chars freed by k are a prefix sum over the
    nodes ordered by that candidate, and the first k that fits is one pass over it. A candidate whose text holds a
    keyword is left out; a keyword that spans two text nodes of it counts. Every step is a sort, a scan by doubling or a
    pass of lookups, so a page of n nodes costs n log n, however many candidates nest. Steps are columns, so each
    expression stays shallow.
    """
    def plus(a: str, b: str) -> str:
        return f"{a} + {b}"

    readable_low = f"transform({nodes}, n -> if({_readable('n')}, lower(n.text), ''))"
    words = f"array_sort(filter({keywords}, w -> w <> ''), (a, b) -> length(a) - length(b))"
    pattern = "concat('(?=(', array_join(transform(@words, w -> concat('\\\\Q', w, '\\\\E')), '|'), '))')"
    text_lengths = "transform(@low, t -> cast(length(t) AS bigint))"
    piece_lengths = "transform(split(@page, @re, -1), p -> cast(length(p) AS bigint))"
    starts = "transform(@caps, (w, k) -> if(size(@cuts) = size(@caps), if(k = 0, 0L, @cuts[k - 1]), @cuts[k]))"
    occurrences = "transform(@caps, (w, k) -> named_struct('at', @starts[k] + length(w), 'kind', 0, 'p', @starts[k]))"
    bounds = "transform(@offsets, (o, j) -> named_struct('at', o, 'kind', 1, 'p', cast(j AS bigint)))"
    running = scan("transform(@merged, e -> if(e.kind = 0, e.p, -1L))", lambda a, b: f"greatest({a}, {b})")
    guard = "filter(transform(@merged, (e, i) -> if(e.kind = 1, best[i], NULL)), g -> g IS NOT NULL)"
    lists = ", ".join(f"filter(some, c -> {p('c')})" for group in REMOVAL_GROUPS for p in group)
    some = f"filter({nodes}, n -> n.kind = 'element' AND (size(n.attrs) > 0 OR n.tag IN ({texts(REMOVAL_TAGS)})))"
    ordered = (f"transform({bind(some, 'some', f'concat({lists})')}, (c, i) -> "
               "named_struct('id', c.id, 'last_id', c.last_id, 'idx', i))")
    allowed = "filter(@cands, c -> NOT (@guard[c.last_id + 1] >= @offsets[c.id]))"
    entries = ("array_sort(concat(transform(@allowed, c -> named_struct('id', c.id, 'kind', 0, 'idx', c.idx)), "
               f"transform({nodes}, n -> named_struct('id', n.id, 'kind', 1, 'idx', -1))))")
    places = "filter(transform(@entries, (e, i) -> if(e.kind = 1, i, -1)), i -> i >= 0)"
    own = ("transform(@places, (p, x) -> if(p - if(x = 0, -1, @places[x - 1]) > 1, "
           "@entries[if(x = 0, -1, @places[x - 1]) + 1].idx, NULL))")
    start = f"transform({nodes}, (n, x) -> named_struct('t', @own[x], 'up', coalesce(n.parent_id, -1)))"
    passes = f"sequence(0, cast(ceil(log2(greatest(2, array_max(transform({nodes}, n -> n.depth)) + 2))) AS int))"
    firsts = (f"transform(aggregate({passes}, {start}, (acc, k) -> transform(acc, e -> named_struct("
              "'t', least(e.t, if(e.up >= 0, acc[e.up].t, NULL)), 'up', if(e.up >= 0, acc[e.up].up, -1)))), e -> e.t)")
    lens = f"transform({nodes}, n -> cast(length({open_token('n')}) + length({close_token('n')}) AS bigint))"
    order = "array_sort(filter(transform(@firsts, (t, x) -> named_struct('t', t, 'len', @lens[x])), e -> e.t IS NOT NULL))"
    freed = scan("transform(@order, e -> e.len)", plus)
    fit = (f"filter(transform(@freed, (f, j) -> if(ceil((@whole - f) / {CHARS_PER_TOKEN}) <= {max_tokens}, j, NULL)), "
           "j -> j IS NOT NULL)")
    stop = "if(size(@order) = 0, -1, if(size(@fit) > 0, @order[@fit[0]].t, @order[size(@order) - 1].t))"
    kept = f"if(@over, filter({nodes}, (n, x) -> @firsts[x] IS NULL OR @firsts[x] > @stop), {nodes})"
    steps = [
        ("whole", chars or rendered_length(nodes)),
        ("over", f"ceil(@whole / {CHARS_PER_TOKEN}) > {max_tokens}"),
        ("low", readable_low),
        ("offsets", f"concat(array(0L), {scan(text_lengths, plus)})"),
        ("words", words),
        ("page", "array_join(@low, '')"),
        ("re", pattern),
        ("caps", "if(size(@words) = 0, cast(array() AS array<string>), regexp_extract_all(@page, @re, 1))"),
        ("cuts", f"if(size(@words) = 0, cast(array() AS array<bigint>), {scan(piece_lengths, plus)})"),
        ("starts", starts),
        ("merged", f"array_sort(concat({occurrences}, {bounds}))"),
        ("guard", bind(running, "best", guard)),
        ("cands", ordered),
        ("allowed", allowed),
        ("entries", entries),
        ("places", places),
        ("own", own),
        ("firsts", firsts),
        ("lens", lens),
        ("order", order),
        ("freed", freed),
        ("fit", fit),
        ("stop", stop),
    ]
    # Only pages over budget do the work; the others keep their nodes.
    gated = [(name, expr if name in ("whole", "over") else f"if(@over, {expr}, NULL)") for name, expr in steps]
    return [(prefix + name, _let(expr, prefix)) for name, expr in gated + [("kept", kept)]]


# --- selector text ----------------------------------------------------------------------------------------------------

_PART = re.compile(r"""(?P<tag>\*|[A-Za-z][\w-]*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)
    |\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[*^$~]?=)\s*(?P<value>"[^"]*"|'[^']*'|[^\]\s]*)\s*)?\]""", re.X)


def _compound(text_: str) -> Predicate:
    """Predicate of one compound selector: tag or ``*``, ``.class``, ``#id``, ``[a]``, ``[a=v]``, ``[a*=v]``,
    ``[a^=v]``, ``[a$=v]``, ``[a~=v]``; every part must hold."""
    tests: list[Predicate] = [is_element]
    at = 0
    while at < len(text_):
        m = _PART.match(text_, at)
        if not m or m.end() == at:
            raise ValueError(f"cannot read selector part {text_[at:]!r}")
        at = m.end()
        if m["tag"] and m["tag"] != "*":
            tests.append(by_tag(m["tag"].lower()))
        elif m["cls"]:
            tests.append(by_class(m["cls"]))
        elif m["id"]:
            tests.append(by_id(m["id"]))
        elif m["attr"]:
            name, op, value = m["attr"].lower(), m["op"], m["value"]
            if value and value[0] in "\"'":
                value = value[1:-1]
            if not op:
                tests.append(with_attr(name))
            elif op == "=":
                tests.append(with_attr(name, value))
            elif op == "*=":
                tests.append(attr_contains(name, value))
            else:
                check = {"^=": "startswith(v, {w})", "$=": "endswith(v, {w})",
                         "~=": "array_contains(split(v, ' '), {w})"}[op].format(w=text(value))
                empty = op != "~=" and not value
                tests.append(lambda n, name=name, check=check, empty=empty: "false" if empty else (
                    f"({n}.kind = 'element' AND coalesce({bind(attr(n, name), 'v', check)}, false))"))
    return lambda n: "(" + " AND ".join(t(n) for t in tests) + ")"


def parse_selector(selector: str) -> list[list[tuple[str, Predicate]]]:
    """Groups (split at commas) of chains [(combinator, predicate)]; the first combinator is empty, then ``>`` (child)
    or `` `` (descendant)."""
    groups = []
    for group in selector.split(","):
        tokens = re.findall(r">|[^\s>]+", group.strip())
        if not tokens:
            raise ValueError(f"empty selector in {selector!r}")
        chain, combinator = [], ""
        for token in tokens:
            if token == ">":
                combinator = ">"
                continue
            chain.append((combinator if chain else "", _compound(token)))
            combinator = " "
        groups.append(chain)
    return groups


def _has_ancestor_in(nodes: str, flags: str) -> str:
    """For each node, whether any ancestor's flag is set: OR over the ancestor chain by pointer jumping."""
    start = (f"transform({nodes}, n -> named_struct('v', if(coalesce(n.parent_id, -1) >= 0, {flags}[n.parent_id], false), "
             "'up', coalesce(n.parent_id, -1)))")
    passes = f"sequence(0, cast(ceil(log2(greatest(2, array_max(transform({nodes}, n -> n.depth)) + 2))) AS int))"
    return (f"transform(aggregate({passes}, {start}, (acc, k) -> transform(acc, e -> named_struct("
            "'v', e.v OR if(e.up >= 0, acc[e.up].v, false), 'up', if(e.up >= 0, acc[e.up].up, -1)))), e -> e.v)")


def select_css(nodes: str, selector: str) -> str:
    """Nodes that a selector text matches, each once, in document order. Groups, compound selectors and the child and
    descendant combinators; a descendant test is pointer jumping over ancestors, so a page costs n log depth."""
    group_flags = []
    for chain in parse_selector(selector):
        flags = None
        for combinator, predicate in chain:
            own = f"transform({nodes}, n -> {predicate('n')})"
            if flags is None:
                flags = own
            elif combinator == ">":
                flags = bind(flags, "prev", f"transform({nodes}, n -> {predicate('n')} AND "
                                            "if(coalesce(n.parent_id, -1) >= 0, prev[n.parent_id], false))")
            else:
                flags = bind(flags, "prev", bind(_has_ancestor_in(nodes, "prev"), "above",
                                                 f"transform({nodes}, (n, i) -> {predicate('n')} AND above[i])"))
        group_flags.append(flags)
    names = [f"g{i}" for i in range(len(group_flags))]
    body = f"filter({nodes}, (n, i) -> {' OR '.join(f'{g}[i]' for g in names)})"
    for name, flags in zip(reversed(names), reversed(group_flags)):
        body = bind(flags, name, body)
    return body

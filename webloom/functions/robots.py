"""Robots expressions: lines, agent groups and the verdict on a URL.

A robots file is one row's text. Its groups are cut out of the line array with slices, without a shuffle. The rules
of a site are indexed once (sorted paths and the first rule over each path's prefixes), and a verdict is a binary
search in that index.
"""

from __future__ import annotations

from webloom.functions.sql import bind, strip, text
from webloom.functions.urls import quote, unquote

_BEFORE_COLON, _AFTER_COLON = "split(v, ':', 2)[0]", "split(v, ':', 2)[1]"
_RULE_KINDS = ("disallow", "allow", "crawl-delay", "request-rate")


def lines(body: str) -> str:
    """Array of lines, for any line ending; a final line ending adds no line."""
    return f"split(regexp_replace({body}, {text(r'\r\n?|\n')}, '\\n'), '\\n')"


def parse_robots_line(line: str) -> str:
    """Struct of lower-cased directive and content, NULL for blank lines, comments and lines without a colon.

    A comment behind the content stays part of it.
    """
    parts = "split(trimmed, ':', 2)"
    return bind(strip(line), "trimmed",
                f"if(trimmed LIKE '#%' OR NOT contains(trimmed, ':'), NULL, named_struct("
                f"'directive', lower({strip(parts + '[0]')}), 'content', {strip(parts + '[1]')}))")


def parsed_lines(body: str) -> str:
    """Array of (line_no, directive, content) of the lines that hold a directive, in file order; lines count from 1."""
    entry = bind(parse_robots_line("line"), "p", "if(p IS NULL, NULL, named_struct("
                 "'line_no', i + 1, 'directive', p.directive, 'content', p.content))")
    return f"filter(transform({lines(body)}, (line, i) -> {entry}), e -> e IS NOT NULL)"


def robots_summary(entries: str) -> str:
    """Counts and lists of one robots file from its parsed lines; NULL for a file without directives."""

    def contents(directive: str) -> str:
        return f"transform(filter({entries}, e -> e.directive = '{directive}'), e -> e.content)"

    return (f"if(size({entries}) = 0, NULL, named_struct('total_rules', size({entries}), "
            f"'user_agents', array_distinct({contents('user-agent')}), "
            f"'disallowed_paths', {contents('disallow')}, 'allowed_paths', {contents('allow')}, "
            f"'sitemaps', {contents('sitemap')}, 'crawl_delay', {contents('crawl-delay')}))")


def rule_path(content: str) -> str:
    """Rule path in the form it is compared in: decoded, without empty query or fragment marks, encoded again."""
    plain = f"regexp_replace({unquote(content)}, {text(r'^[\x00-\x20]+|[\t\r\n]')}, '')"
    tidy = f"regexp_replace(regexp_replace({plain}, '^([^?#]*)[?](?=#|$)', '$1'), '^([^#]*)#$', '$1')"
    return bind(tidy, "path", quote("path"))


def url_target(url: str) -> str:
    """What of a URL the rules are compared with: everything behind the host, decoded and encoded again."""
    plain = f"regexp_replace({unquote(url)}, {text(r'^[\x00-\x20]+|[\t\r\n]')}, '')"
    tail = f"regexp_replace({plain}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?', '')"
    tidy = f"regexp_replace(regexp_replace({tail}, '^([^?#]*)[?](?=#|$)', '$1'), '^([^#]*)#$', '$1')"
    return bind(tidy, "rest", f"if(rest = '', '/', {quote('rest')})")


def _events(body: str) -> str:
    """Lines that shape the groups: agents, rules and truly empty lines. Comments are cut at ``#`` here."""
    value = strip("regexp_replace(line, '#.*', '')")
    kind = bind(f"lower({strip(_BEFORE_COLON)})", "k",
                f"""CASE WHEN line = '' THEN 'blank' WHEN NOT contains(v, ':') THEN 'other'
                    WHEN k = 'user-agent' THEN 'agent'
                    WHEN k IN ({', '.join(f"'{k}'" for k in _RULE_KINDS)}) THEN k ELSE 'other' END""")
    event = bind(value, "v", f"named_struct('kind', {kind}, "
                             f"'value', if(contains(v, ':'), {strip(_AFTER_COLON)}, ''))")
    return f"filter(transform({lines(body)}, line -> {event}), e -> e.kind <> 'other')"


def agent_groups(body: str) -> str:
    """Array of (group_no, agents, rules) in file order; rules are (rule_no, allow, path).

    A group opens at an agent line that does not follow another agent line directly and ends at an empty line. Groups
    without any rule line do not count. ``Disallow`` without a path allows everything.
    """
    starts = ("filter(transform(ev, (e, i) -> if(e.kind = 'agent' AND coalesce(get(ev, i - 1).kind <> 'agent', true), "
              "i, NULL)), i -> i IS NOT NULL)")
    section = "slice(ev, s + 1, coalesce(get(starts, k + 1), size(ev)) - s)"
    to_blank = ("slice(section, 1, if(array_position(transform(section, e -> e.kind), 'blank') > 0, "
                "CAST(array_position(transform(section, e -> e.kind), 'blank') AS INT) - 1, size(section)))")
    allow = "(e.kind = 'allow' OR e.value = '')"
    rules = ("transform(filter(part, e -> e.kind IN ('allow', 'disallow')), (e, n) -> named_struct("
             f"'rule_no', n, 'allow', {allow}, 'path', {rule_path('e.value')}))")
    agents = f"transform(filter(part, e -> e.kind = 'agent'), e -> {unquote('e.value')})"
    group = bind(section, "section", bind(to_blank, "part", f"named_struct('group_no', k, 'agents', {agents}, "
                 f"'ruled', exists(part, e -> e.kind <> 'agent'), 'rules', {rules})"))
    groups = f"filter(transform(starts, (s, k) -> {group}), g -> g.ruled)"
    slim = f"transform({groups}, g -> named_struct('group_no', g.group_no, 'agents', g.agents, 'rules', g.rules))"
    return bind(_events(body), "ev", bind(starts, "starts", slim))


def group_for_agent(groups: str, agent: str) -> str:
    """The group that applies to an agent: the first that names part of it, else the first for ``*``, else NULL.

    The agent counts up to its first slash, in lower case.
    """
    token = f"lower(split({agent}, '/', 2)[0])"
    named = (f"filter({groups}, g -> NOT array_contains(g.agents, '*') AND "
             f"exists(g.agents, a -> contains({token}, lower(a))))")
    return f"coalesce(get({named}, 0), get(filter({groups}, g -> array_contains(g.agents, '*')), 0))"


def rules_verdict(rules: str, target: str) -> str:
    """First matching rule in file order decides; no rule, no objection."""
    return f"coalesce(get(filter({rules}, r -> startswith({target}, r.path)), 0).allow, true)"


def last_at_most(paths: str, target: str) -> str:
    """Position (from 0) of the last path not above ``target`` in a sorted array, -1 if none: a binary search."""
    steps = f"sequence(0, cast(ceil(log2(size({paths}) + 1)) AS int))"
    step = bind("cast((s.lo + s.hi + 1) div 2 AS int)", "mid",
                f"if({paths}[mid] <= {target}, named_struct('lo', mid, 'hi', s.hi), named_struct('lo', s.lo, 'hi', mid - 1))")
    return (f"aggregate({steps}, named_struct('lo', -1, 'hi', size({paths}) - 1), "
            f"(s, k) -> if(s.lo >= s.hi, s, {step}), s -> s.lo)")


def common_prefix(a: str, b: str) -> str:
    """Length of the longest common prefix of two texts, by a binary search over lengths."""
    steps = f"sequence(0, cast(ceil(log2(least(length({a}), length({b})) + 1)) AS int))"
    step = bind("cast((s.lo + s.hi + 1) div 2 AS int)", "mid",
                f"if(left({a}, mid) = left({b}, mid), named_struct('lo', mid, 'hi', s.hi), named_struct('lo', s.lo, 'hi', mid - 1))")
    return (f"aggregate({steps}, named_struct('lo', 0, 'hi', least(length({a}), length({b}))), "
            f"(s, k) -> if(s.lo >= s.hi, s, {step}), s -> s.lo)")


def deepest_prefix(paths: str, target: str) -> str:
    """Position of the longest path of a sorted array that is a prefix of ``target``, -1 if none.

    Every path that is a prefix of the target lies at or before the last path not above it, and is a prefix of that
    path too; so where that path is no prefix, the search goes on with the common part of both, which is shorter each
    time. Mostly one or two binary searches."""
    found = bind(last_at_most(paths, "st.cur"), "i", f"""if(i < 0, named_struct('cur', st.cur, 'found', -1),
        if(startswith(st.cur, {paths}[i]), named_struct('cur', st.cur, 'found', i),
           named_struct('cur', left(st.cur, {common_prefix(f'{paths}[i]', 'st.cur')}), 'found', -2)))""")
    return (f"aggregate(sequence(0, length({target})), named_struct('cur', {target}, 'found', -2), "
            f"(st, k) -> if(st.found <> -2, st, {found}), st -> if(st.found = -2, -1, st.found))")


def rule_index(rules: str) -> str:
    """(paths, best) of a group's rules, built once per site: paths sorted, each once with its first rule, and for each
    the first rule in file order among all paths that are prefixes of it (an array trie). The parent of a path is the
    longest other path that is a prefix of it; the first rule over all ancestors comes by pointer jumping."""
    ordered = f"array_sort(transform({rules}, r -> named_struct('path', r.path, 'rule_no', r.rule_no, 'allow', r.allow)))"
    once = "filter(sorted, (r, i) -> i = 0 OR sorted[i - 1].path <> r.path)"
    parents = ("transform(once, r -> if(length(r.path) = 0, -1, "
               f"{deepest_prefix('paths', 'left(r.path, length(r.path) - 1)')}))")
    start = ("transform(once, (r, i) -> named_struct('best', named_struct('rule_no', r.rule_no, 'allow', r.allow), "
             "'up', ups[i]))")
    passes = "sequence(0, cast(ceil(log2(size(once) + 1)) AS int))"
    jumped = (f"aggregate({passes}, {start}, (acc, k) -> transform(acc, e -> named_struct("
              "'best', if(e.up >= 0, least(e.best, acc[e.up].best), e.best), 'up', if(e.up >= 0, acc[e.up].up, -1))))")
    index = bind(parents, "ups", f"named_struct('paths', paths, 'best', transform({jumped}, e -> e.best))")
    return bind(ordered, "sorted", bind(once, "once", bind("transform(once, r -> r.path)", "paths", index)))


def index_verdict(index: str, target: str) -> str:
    """``rules_verdict`` by the index of ``rule_index``: a search for the longest rule path that prefixes the target,
    and the first rule of its ancestors."""
    return bind(deepest_prefix(f"{index}.paths", target), "i", f"coalesce(if(i >= 0, {index}.best[i].allow, true), true)")


def robots_verdict(status: str, index: str, target: str) -> str:
    """Verdict with the outcome of fetching the robots file: 401 and 403 close the site, other 4xx open it, and a
    file that was never read (NULL, 5xx) closes it. ``index`` is the ``rule_index`` of the rules that apply."""
    return (f"CASE WHEN {status} IN (401, 403) THEN false WHEN {status} BETWEEN 400 AND 499 THEN true "
            f"WHEN {status} IS NULL OR {status} >= 500 THEN false ELSE {index_verdict(index, target)} END")

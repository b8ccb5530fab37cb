"""URL expressions: splitting, resolving, normalising and validating.

Everything is built from Spark's own functions, so URL work stays in the JVM. Resolution follows RFC 3986 the way
``urllib.parse.urljoin`` does; the tests compare the two.
"""

from __future__ import annotations

from webloom.functions.sql import bind, strip, text, texts

# A link with one of these prefixes is not a page address.
SKIPPED_LINK = "^(javascript:|mailto:|tel:|#)"
SKIPPED_URL = "^(data:|javascript:|mailto:|tel:|#)"
# Schemes whose references can be relative.
RELATIVE_SCHEMES = ("ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms",
                    "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss")
# Schemes whose last path segment may end in ``;parameters``.
PARAMETER_SCHEMES = ("", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps", "rtspu", "sip", "sips",
                     "mms", "sftp", "tel")
# Where a site keeps its sitemap, in the order tried.
SITEMAP_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap/sitemap.xml")

_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*:"


def _part(url: str, pattern: str) -> str:
    return f"regexp_extract({url}, {text('(?s)' + pattern)}, 1)"


def strip_slashes(url: str) -> str:
    """Drop every leading and trailing slash."""
    return f"btrim({url}, '/')"


def url_host(url: str) -> str:
    """``host[:port]`` of an absolute URL, empty for anything else. No error on malformed input."""
    return _part(url, f"^{_SCHEME}//([^/?#]+)")


def host_key(url: str) -> str:
    """``scheme://host[:port]`` under which URLs of a site meet: lower case, without user information and the port a
    scheme has anyway. NULL for anything but an absolute URL."""
    low = f"lower({_part(url, f'^({_SCHEME}//[^/?#]+)')})"
    plain = f"regexp_replace({low}, {text('^([a-z][a-z0-9+.-]*://)[^@]*@')}, '$1')"
    for scheme, port in (("http", 80), ("https", 443)):
        plain = f"regexp_replace({plain}, {text(rf'^({scheme}://(?:[^:\[]+|\[.*\])):(?:{port})?$')}, '$1')"
    return f"nullif({plain}, '')"


def url_origin(url: str) -> str:
    return _part(url, f"^({_SCHEME}//[^/?#]+)")


def url_path(url: str) -> str:
    return _part(url, f"^(?:{_SCHEME})?(?://[^/?#]*)?([^?#]*)")


def url_parts(url: str) -> str:
    """Struct of the parts of a URL, each with its own mark (``scheme:``, ``//host``, ``;x``, ``?x``, ``#x``), so that
    concatenating them gives the URL back. Absent and empty parts are empty strings."""
    parts = f"""named_struct(
        'scheme', lower({_part('clean', f'^({_SCHEME})')}),
        'host', {_part('clean', f'^(?:{_SCHEME})?(//[^/?#]+)')},
        'path', {_part('clean', f'^(?:{_SCHEME})?(?://[^/?#]*)?((?:[^?#]*/)?[^?#;/]*)')},
        'params', {_part('clean', f'^(?:{_SCHEME})?(?://[^/?#]*+)?+(?:[^?#]*/)?[^?#;/]*(;[^?#/]+)(?=[?#]|$)')},
        'query', {_part('clean', '^[^?#]*([?][^#]+)')},
        'fragment', {_part('clean', '^[^#]*(#.+)')})"""
    return bind(f"regexp_replace({url}, {text(r'^[\x00-\x20]+|[\t\r\n]')}, '')", "clean", parts)


def _bad_host(parts: str) -> str:
    return f"(contains({parts}.host, '[') <> contains({parts}.host, ']'))"


def _merged_path(own: str, base: str) -> str:
    """Path of a relative reference below the folder of the base path, without dot segments."""
    joined = f"""CASE WHEN startswith({own}, '/') THEN {own}
        ELSE regexp_replace(concat(regexp_extract({base}, '(?s)^(.*/)?', 0), {own}), '(?<=.)/+(?=/)', '') END"""
    walked = """aggregate(seg, cast(array() AS array<string>), (done, s) ->
        CASE WHEN s = '..' THEN slice(done, 1, greatest(size(done) - 1, 0))
             WHEN s = '.' THEN done ELSE array_append(done, s) END)"""
    path = f"array_join(if(element_at(seg, -1) IN ('.', '..'), array_append({walked}, ''), {walked}), '/')"
    return bind(f"split({joined}, '/')", "seg", f"concat(if(startswith({path}, '/'), '', '/'), {path})")


def resolve_url(url: str, base: str) -> str:
    """Resolve a reference against an absolute base URL; NULL where the reference is malformed.

    Root-relative references without dot segments, nearly all links of real pages, take one short branch.
    """
    plain = text(r"^/(?!/)[^?#;\s\x00-\x20]*(?:[?][^#\s\x00-\x20]+)?(?:#[^\s\x00-\x20]+)?$")
    plain_base = text(r"^https?://[^/?#\[\]]+")
    general = f"""CASE
        WHEN {_bad_host('u')} OR {_bad_host('b')} THEN NULL
        WHEN b.host = '' OR (u.scheme <> '' AND u.scheme <> b.scheme)
            OR rtrim(':', b.scheme) NOT IN ({texts(RELATIVE_SCHEMES)}) THEN u.original
        WHEN u.host <> '' THEN concat(b.scheme, u.host, u.path, u.params, u.query, u.fragment)
        WHEN u.path = '' AND u.params = '' THEN
            concat(b.scheme, b.host, b.path, b.params, if(u.query <> '', u.query, b.query), u.fragment)
        ELSE concat(b.scheme, b.host, {_merged_path('u.path', 'b.path')}, u.params, u.query, u.fragment) END"""
    general = bind(url_parts(base), "b", general.replace("u.original", "link.l"))
    general = bind(url_parts("link.l"), "u", general)
    return bind(f"named_struct('l', {url})", "link", f"""CASE
        WHEN {base} = '' THEN link.l
        WHEN link.l = '' THEN {base}
        WHEN link.l RLIKE {plain} AND NOT contains(link.l, '/.') AND {base} RLIKE {plain_base}
            THEN concat({url_origin(base)}, link.l)
        ELSE {general} END""")


def normalize_url(url: str, base: str | None = None) -> str:
    """Trimmed and, where a base is given, absolute form of a link; NULL for links that are not addresses."""
    link = strip(url)
    if base is not None:
        link = bind(link, "trimmed", f"""CASE
            WHEN {base} IS NULL OR {base} = '' OR trimmed RLIKE '^(https?:)?//' THEN trimmed
            ELSE {resolve_url('trimmed', base)} END""")
    return f"CASE WHEN {url} <> '' AND NOT {url} RLIKE '{SKIPPED_LINK}' THEN {link} END"


def is_valid_url(url: str) -> str:
    """True for a URL with a host or a path that is not a data, script, mail or phone address."""
    place = f"""(p.host <> '' OR p.path <> '' OR
        (p.params <> '' AND rtrim(':', p.scheme) NOT IN ({texts(PARAMETER_SCHEMES)}))) AND NOT {_bad_host('p')}"""
    return f"""CASE
        WHEN {url} IS NULL OR {url} = '' THEN false
        WHEN {url} RLIKE {text(r'^https?://[^/?#\[\]]+(?:[/?#]|$)')} THEN true
        WHEN {url} RLIKE '{SKIPPED_URL}' THEN false
        ELSE {bind(url_parts(url), 'p', place)} END"""


def robots_url(site: str) -> str:
    return f"concat(rtrim('/', {site}), '/robots.txt')"


def sitemap_candidates(site: str) -> str:
    """The places a sitemap may be, best first."""
    return "array(" + ", ".join(f"concat(rtrim('/', {site}), '{path}')" for path in SITEMAP_PATHS) + ")"


def unquote(value: str) -> str:
    """Decode percent escapes; a percent sign that starts no escape stays, and so does ``+``."""
    guarded = f"replace(regexp_replace({value}, '%(?![0-9A-Fa-f]{{2}})', '%25'), '+', '%2B')"
    return f"if(contains({value}, '%'), url_decode({guarded}), {value})"


def quote(value: str) -> str:
    """Percent-encode all but letters, digits, ``_.-~`` and ``/``."""
    form = f"url_encode({value})"
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        form = f"replace({form}, '{old}', '{new}')"
    return f"if({value} RLIKE '^[A-Za-z0-9_.~/-]*$', {value}, {form})"

"""Small helpers for writing SQL expressions."""

from __future__ import annotations

from collections.abc import Iterable


# Characters that count as white space at the ends of a text.
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

def text(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def texts(values: Iterable[str]) -> str:
    """Comma-separated string literals, for IN lists."""
    return ", ".join(text(v) for v in values)


def text_array(values: Iterable[str]) -> str:
    values = list(values)
    return f"array({texts(values)})" if values else "cast(array() AS array<string>)"


def bind(value: str, name: str, body: str) -> str:
    """Evaluate ``value`` once and use it under ``name`` in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def any_of(conditions: Iterable[str]) -> str:
    conditions = list(conditions)
    return "(" + " OR ".join(conditions) + ")" if conditions else "false"


def strip(value: str) -> str:
    """Text without white space at its ends, Unicode white space included."""
    return f"btrim({value}, {text(WHITE_SPACE)})"

"""Tokens of the pattern language."""

from __future__ import annotations

import re
from dataclasses import dataclass


class QueryError(ValueError):
    """A query that does not lex, parse or bind; carries the position where known."""


@dataclass(frozen=True)
class Token:
    kind: str
    value: str
    at: int


KEYWORDS = {"match", "where", "return", "limit", "and", "or", "not", "has"}
_PATTERN = re.compile(
    r"""(?P<space>\s+)
    |(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
    |(?P<number>-?\d+(?:\.\d+)?(?!\.\d))
    |(?P<word>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<op><-\[|\]->|-\[|\]-|\.\.|=~|!=|<=|>=|[=<>()\[\]:,.*])""",
    re.X,
)


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _PATTERN.match(text, at)
        if m is None:
            raise QueryError(f"unexpected character {text[at]!r} at {at}")
        kind, value = m.lastgroup, m.group()
        # "*1..3": the number must not take the first dot of the range.
        if kind == "word" and value.lower() in KEYWORDS:
            out.append(Token(value.lower(), value, at))
        elif kind == "string":
            out.append(Token("string", re.sub(r"\\(.)", r"\1", value[1:-1]), at))
        elif kind != "space":
            out.append(Token("op:" + value if kind == "op" else kind, value, at))
        at = m.end()
    out.append(Token("end", "", at))
    return out

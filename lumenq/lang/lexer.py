"""Tokens of the dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass

from lumenq.errors import LexError

_TOKEN = re.compile(
    r"""
    (?P<skip>\s+|--[^\n]*|/\*.*?\*/)
  | (?P<number>\d+(?:\.\d*)?|\.\d+)
  | (?P<word>[^\W\d]\w*)
  | (?P<param>\$\d+)
  | (?P<text>'(?:[^']|'')*')
  | (?P<quoted>"[^"]*"|`[^`]*`)
  | (?P<command>\\[A-Za-z]+)
  | (?P<op><=|>=|<>|!=|[-+*/=<>!(),.;])
    """,
    re.X | re.S,
)


@dataclass(frozen=True)
class Token:
    """kind: word, quoted, text, int, float, param, command, op or end."""

    kind: str
    value: object
    at: int

    @property
    def upper(self) -> str:
        return str(self.value).upper() if self.kind in ("word", "op") else ""


def tokenize(sql: str) -> list[Token]:
    """All tokens of a text, comments skipped, with an end token last."""
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise LexError(f"unexpected character {sql[at]!r} at {at}")
        kind, raw = m.lastgroup, m.group()
        if kind == "number":
            out.append(Token("float", float(raw), at) if "." in raw else Token("int", int(raw), at))
        elif kind == "text":
            out.append(Token("text", raw[1:-1].replace("''", "'"), at))
        elif kind == "quoted":
            out.append(Token("quoted", raw[1:-1], at))
        elif kind in ("param", "command"):
            out.append(Token(kind, int(raw[1:]) if kind == "param" else raw[1:], at))
        elif kind != "skip":
            out.append(Token(kind, raw, at))
        at = m.end()
    return [*out, Token("end", "", at)]

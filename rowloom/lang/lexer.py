"""Tokens of program text."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""
    (?P<space>\s+)
  | (?P<comment>/\*.*?\*/)
  | (?P<string>'(?:[^']|'')*'|"(?:[^"]|"")*")(?P<suffix>(?:dt|d|t|x|n)\b)?
  | (?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
  | (?P<name>[A-Za-z_][A-Za-z0-9_]*)
  | (?P<op>\*\*|\|\||<>|<=|>=|\^=|~=|!=|=:|[-+*/=<>()\[\]{},.;:|&^~!?$@%\#])
    """,
    re.X | re.S | re.I,
)


@dataclass(frozen=True)
class Token:
    kind: str  # num, str, name, op, end
    text: str
    value: object
    at: int
    end: int

    @property
    def low(self) -> str:
        return self.text.lower()


class ProgramError(Exception):
    """A program that can't be understood or run."""


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    fresh = True  # at the start of a statement, where * begins a comment
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ProgramError(f"unexpected character {text[at]!r} near {text[max(0, at - 20) : at + 20]!r}")
        kind = m.lastgroup if m.lastgroup != "suffix" else "string"
        if fresh and m.group() == "*" or m.group() == "%" and text.startswith("%*", at):
            end = text.find(";", at)
            at = len(text) if end < 0 else end + 1
            continue
        at = m.end()
        if kind in ("space", "comment"):
            continue
        if kind == "string":
            quote, body = m["string"][0], m["string"][1:-1]
            out.append(Token("str", m.group(), (body.replace(quote * 2, quote), (m["suffix"] or "").lower()), m.start(), at))
        elif kind == "num":
            t = m["num"]
            out.append(Token("num", t, int(t) if t.isdigit() else float(t), m.start(), at))
        else:
            out.append(Token(kind, m.group(), m.group(), m.start(), at))
        fresh = m.group() == ";"
    out.append(Token("end", "", None, len(text), len(text)))
    return out

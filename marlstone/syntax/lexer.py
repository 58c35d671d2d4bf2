"""Tokens of the language, with byte spans into the normalised source."""

from __future__ import annotations

import re
from dataclasses import dataclass

Span = tuple[int, int]


class SyntaxFault(ValueError):
    """A source that isn't in the language; ``span`` covers the place."""

    def __init__(self, message: str, span: Span):
        super().__init__(f"{message} at {span[0]}..{span[1]}")
        self.message, self.span = message, span


@dataclass(frozen=True)
class Token:
    kind: str  # ident, number, string, punct, end
    text: str
    start: int
    end: int

    @property
    def span(self) -> Span:
        return self.start, self.end


_RULES = re.compile(
    r"(?P<gap>\s+|\#[^\n]*)"
    r"|(?P<string>\"(?:[^\"\\\n]|\\.)*\")"
    r"|(?P<number>0[xX][0-9A-Fa-f_]+|\d[\d_]*(?:\.\d+)?)"
    r"|(?P<ident>[^\W\d]\w*)"
    r"|(?P<punct>::|=>|->|==|!=|<=|>=|&&|\|\||@@|[-.,;:(){}\[\]<>=!+*/%&?@])"
)


def normalise(source: str) -> str:
    return source.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")


def tokens(source: str) -> list[Token]:
    """Tokens of a normalised source, ``end`` last."""
    out, at, byte = [], 0, 0
    while at < len(source):
        m = _RULES.match(source, at)
        if not m or "\0" in m.group():
            raise SyntaxFault("unexpected character", (byte, byte + len(source[at].encode())))
        size = len(m.group().encode())
        if m.lastgroup != "gap":
            out.append(Token(m.lastgroup or "", m.group(), byte, byte + size))
        at, byte = m.end(), byte + size
    out.append(Token("end", "", byte, byte))
    return out

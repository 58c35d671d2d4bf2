"""For editors and other hosts: JSON in and out, and never an exception."""

from __future__ import annotations

import json

from .catalog import projection
from .catalog.model import Rejected
from .catalog.types import Model
from .syntax import formatter
from .syntax.lexer import SyntaxFault


def _envelope(problems: list, **more: object) -> str:
    shown = [{"code": p.code, "message": p.message, "span": p.span, "hint": p.hint} for p in problems]
    return json.dumps({"ok": not problems, "diagnostics": shown} | more, ensure_ascii=False)


def check(source: str) -> str:
    """Schema problems, those of references and types among them."""
    problems = projection.check(source)
    if not problems:
        try:
            Model.of(source)
        except Rejected as e:
            problems = e.problems
    return _envelope(problems)


def format(source: str, mode: str = "canonical") -> str:
    """The formatted text; if it can't be parsed, the text as it is, and why."""
    try:
        text = (formatter.canonical if mode == "canonical" else formatter.preserve)(source)
    except SyntaxFault as e:
        return _envelope([projection.Problem("SCH001", e.message, e.span)], formatted=source)
    return _envelope([], formatted=text)


def catalog(source: str) -> str:
    return json.dumps(projection.catalog_json(source), ensure_ascii=False)

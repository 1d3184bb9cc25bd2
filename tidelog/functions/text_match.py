"""Substring predicates of the text filter.

The filter is ``LIKE '%text%'``, in which ``%`` and ``_`` inside the text keep their
meaning and a backslash makes them ordinary. A plain LIKE tries every split of the
message over the parts between the ``%``, which takes quadratic time on long messages.
Here each part is settled at its first occurrence after the one before, which finds the
same rows in one pass.
"""

from __future__ import annotations

import re

from pyspark.sql import Column

_TOKEN = re.compile(r"\\[%_\\]|.", re.DOTALL)
_ANY_CHAR = None


def like_parts(pattern: str) -> list[list[str | None]]:
    """The parts of a LIKE pattern between its ``%``: literal characters, and None for
    ``_``. A backslash before an ordinary character stands for itself."""
    parts: list[list[str | None]] = [[]]
    for token in _TOKEN.findall(pattern):
        if token == "%":
            parts.append([])
        else:
            parts[-1].append(_ANY_CHAR if token == "_" else token[-1])
    return parts


def _literals(part: list[str | None]) -> list[str]:
    runs = [""]
    for char in part:
        if char is _ANY_CHAR:
            runs.append("")
        else:
            runs[-1] += char
    return [run for run in runs if run]


def literal_runs(text: str) -> list[str]:
    """Runs of characters that every message with ``LIKE '%text%'`` holds."""
    _, *parts = like_parts(f"%{text}%")
    return [run for part in parts for run in _literals(part)]


def _regex(part: list[str | None]) -> str:
    return "".join("." if char is _ANY_CHAR else re.sub(r"([^\w\s]|_)", r"\\\1", char, flags=re.ASCII) for char in part)


def like_predicate(column: Column, text: str) -> Column:
    """``column LIKE '%text%'``."""
    _, *inner, last = like_parts(f"%{text}%")
    inner = [part for part in inner if part]
    if not inner and not last:
        return column.isNotNull()
    longest = max((run for part in [*inner, last] for run in _literals(part)), key=len, default="")
    if len(inner) == 1 and not last and _ANY_CHAR not in inner[0]:
        return column.contains(longest)
    regex = r"(?s)\A" + "".join(f"(?>.*?{_regex(part)})" for part in inner)
    if last:  # a text that ends in a backslash turns the closing % into a character
        regex += f".*{_regex(last)}\\z"
    return column.contains(longest) & column.rlike(regex) if longest else column.rlike(regex)


def text_predicate(column: Column, text: str, mode: str = "like") -> Column:
    if mode == "like":
        return like_predicate(column, text)
    if mode == "literal":
        return column.contains(text)
    raise ValueError(f"text mode must be 'like' or 'literal', not {mode!r}")

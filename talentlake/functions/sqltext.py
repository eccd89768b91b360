"""Helpers that render fixed word lists as SQL text."""

from __future__ import annotations

from collections.abc import Iterable


def quoted(words: Iterable[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)

"""Counts over a text's words and lines that rules and labellers share."""

from __future__ import annotations

import re

import numpy as np

# Characters that count as symbols.
_SYMBOL = re.compile("[#*$%&|<>]")
_CAPS = re.compile(r"[^\W\d_]{2,}")
#: Measures of a text, all whole numbers.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps", "n_exclaims", "n_distinct")


def split_words(text: str) -> list[str]:
    """What ASCII white space separates."""
    return [w.decode("utf-8", "replace") for w in text.encode("utf-8", "replace").split()]


def _names(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Equal pairs get equal numbers."""
    return np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1]


def repeat_words(ids: np.ndarray, window: int = 5) -> int:
    """Words within windows that occur twice or more; windows are named by doubling (2, 4, then one more word)."""
    if window != 5:
        raise ValueError("windows of five words")
    if len(ids) <= window:
        return 0
    two = _names(ids[:-1], ids[1:])
    if two.max() + 1 == len(two):
        return 0
    four = _names(two[:-2], two[2:])
    five = _names(four[:-1], ids[4:])
    often = np.flatnonzero(np.bincount(five)[five] > 1)
    marks = np.zeros(len(ids) + 1, np.int64)
    np.add.at(marks, often, 1)
    np.add.at(marks, often + window, -1)
    return int((np.cumsum(marks) > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    """The ``COUNTS`` of a text."""
    words = split_words(text)
    index: dict[str, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    return (
        len(words),
        sum(map(len, words)),
        len(_SYMBOL.findall(text)),
        len(lines) - len(set(lines)),
        repeat_words(ids),
        len(lines),
        sum(1 for w in _CAPS.findall(text) if w.isupper()),
        text.count("!"),
        len(index),
    )


def columns(texts: list[str | None]) -> dict[str, list[int]]:
    got = [measure(t or "") for t in texts]
    return {name: [g[i] for g in got] for i, name in enumerate(COUNTS)}

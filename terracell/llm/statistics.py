"""Statistics of a whole text, from its UTF-8 bytes."""

from __future__ import annotations

from collections import Counter

import numpy as np

SYMBOLS = b"#*$%&|<>"
_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_SPACE, _TAIL = b" \t\n\x0b\x0c\r", bytes(range(0x80, 0xC0))
_LEAD = bytes(range(0xC0, 0x100))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
WINDOW = 5

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("word_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "digit_share", "exclaim_share", "stop_share", "comma_share", "line_words", "short_share", "bar_share", "other_share")


def _number(text: bytes, of: bytes) -> int:
    return len(text) - len(text.translate(None, of))


def repeat_words(words: list[bytes]) -> int:
    """Words that stand in a WINDOW-word window found twice or more, its first place included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    keys = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        keys = (keys ^ h[k : k + n]) * _MIX[k]
    ordered = np.sort(keys)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    windows = list(zip(*(words[k : k + n] for k in range(WINDOW)), strict=True))
    found = Counter(windows)
    marks = np.zeros(len(words) + 1, np.int64)
    again = np.array([found[w] > 1 for w in windows])
    starts = np.flatnonzero(again)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + WINDOW, -1)
    return int((np.cumsum(marks[:-1]) > 0).sum())


def base(text: bytes) -> tuple[int, int, int, int, int]:
    """BASE of a text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    chars = len(text) - _number(text, _TAIL) - _number(text, _SPACE)
    return len(words), chars, _number(text, SYMBOLS), len(lines) - len(set(lines)), repeat_words(words)


def measure(text: bytes) -> tuple[float, ...]:
    """BASE, then RATIOS, of a text; every ratio of an empty text is 0."""
    n, chars, symbols, dup, repeat = counts = base(text)
    if not n:
        return (*counts, *([0.0] * len(RATIOS)))
    words, lines = text.split(), text.count(b"\n") + 1
    upper, lower, digits = _number(text, _UPPER), _number(text, _LOWER), _number(text, _DIGITS)
    marks, letters = text.count(b"!"), _number(text, _LEAD)
    stops = text.count(b".") + text.count(b"?")
    commas, bars = text.count(b",") + text.count(b";") + text.count(b":"), text.count(b"|")
    short = sum(map((1).__eq__, map(len, words)))
    other = chars - upper - lower - digits - letters - marks - stops - commas - symbols
    return (
        *counts,
        chars / n, symbols / chars, dup / lines, repeat / n, len(set(words)) / n, upper / max(1, upper + lower), digits / chars, marks / chars,
        stops / n, commas / n, n / lines, short / n, bars / chars, max(0, other) / chars,
    )

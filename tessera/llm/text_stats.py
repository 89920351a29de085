"""Transformed statistics of a text, shared by the classifiers; none of them uses language, source or id."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np

NAMES = ["length", "word_length", "symbols", "variety", "top_word", "adjacent", "dup_lines", "upper", "marks", "length2"]
_SYMBOL = re.compile(r"[#*$%&|<>]")
_UPPER = re.compile(r"[A-Z]")
_MARK = re.compile(r"[!?;:=_]")


def statistics(text: str) -> list[float]:
    """Finite numbers for any text, zeros for one without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    size = sum(map(len, words))
    same = sum(map(str.__eq__, words, words[1:]))
    length = math.log1p(n)
    short = min(1.0, n / 20)  # shares of a few words say little
    return [
        length,
        short * (math.log(size / n) - 1.6),
        math.log1p(20 * len(_SYMBOL.findall(text)) / n),
        math.log(len(counts) / n) + 0.12 * max(0.0, length - 3),
        short * math.log1p(10 * max(counts.values()) / n),
        math.log1p(20 * same / n),
        math.log1p(10 * (len(lines) - len(set(lines))) / max(1, len(lines))),
        short * math.log1p(10 * len(_UPPER.findall(text)) / size),
        short * math.log1p(10 * len(_MARK.findall(text)) / n),
        (length - 5.5) ** 2 / 4,
    ]


def matrix(texts: list[str]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), len(NAMES))

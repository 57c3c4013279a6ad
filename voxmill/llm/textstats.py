"""Rule statistics of whole texts, for the quality rules and the heuristic labellers."""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

from .common import WORD_CLASS

WORDS = re.compile(WORD_CLASS)
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\v\f\r"


class Statistics(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    n_chars: int
    n_lines: int
    n_upper_words: int
    n_distinct_words: int
    n_shouted: int
    n_sentence_ends: int


#: Ratios that the forest splits on; none of them depends on the length of a text.
RATIOS = ("symbols", "upper", "repeats", "dup_lines", "variety", "word_length", "shouted")


def repeat_words(words: list[str]) -> int:
    """Words in 3-word windows that occur twice or more, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    covered = end = 0
    for i, window in enumerate(windows):
        if times[window] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def statistics(text: str | None, words: list[str] | None = None) -> Statistics:
    """A null text has no words; so has an empty one.  ``words`` are those of the text, if they are known already."""
    text = text or ""
    words = WORDS.findall(text) if words is None else words
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    return Statistics(
        len(words),
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(text),
        len(lines),
        sum(map(str.isupper, words)),
        len(set(words)),
        sum(x.endswith("!") for x in words) if "!" in text else 0,
        sum(x[-1] in ".!?" for x in words),
    )


def ratios(s: Statistics) -> list[float]:
    """The values named in RATIOS."""
    n = max(1, s.n_words)
    variety = math.log(max(1, s.n_distinct_words)) / math.log(n) if s.n_words > 1 else 1.0
    return [
        s.n_symbols / max(1, s.n_chars),
        s.n_upper_words / n,
        s.n_repeat_words / n,
        s.n_dup_lines / max(1, s.n_lines),
        variety,
        s.word_chars / n,
        s.n_shouted / n,
    ]

"""Dense text features: what several classifiers read from a whole text."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\W_]+")
MIXED = re.compile(r"\b[^\W\d_]+[0-9@$!*|]+[^\W\d_]+\b|\b(?:[^\W\d_][.*_-]){3,}[^\W\d_]\b")
# Digits and signs that stand for letters; words that address someone.
LEET = str.maketrans("013457@$!|", "oieastasil", "*._-")
SECOND = frozenset("you your yours yourself u ur ye du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes ti tus vosotros".split())

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_JUNK = b"#$%&*+=<>^~@\\{}[]"
_STOP = b".,;:"

SHAPE = ("log_bytes", "log_words", "word_length", "distinct", "upper", "digit", "junk", "stops", "bang", "question", "bar", "high", "line_words", "repeated_lines", "top_word", "mixed", "second")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Slots(dict):
    """A word -> its place among `n` hashed counts, remembered up to `kept` words."""

    def __init__(self, n: int, kept: int = 150_000):
        super().__init__()
        self.n, self.kept = n, kept

    def __missing__(self, word: str) -> int:
        if len(self) >= self.kept:
            self.clear()
        self[word] = at = zlib.crc32(word.encode("utf-8", "surrogatepass")) % self.n
        return at

    def rates(self, words: list[str]) -> np.ndarray:
        """Square roots of the shares of the words that fall on each place."""
        return np.sqrt(np.bincount([self[w] for w in words], minlength=self.n) / max(1, len(words)))


def shape(text: str, words: list[str]) -> list[float]:
    """Rates that don't name any word; an empty text has zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    n, k = max(1, len(raw)), max(1, len(words))
    rate = lambda drop: (len(raw) - len(raw.translate(None, drop))) / n
    upper, lower = rate(_UPPER), rate(_LOWER)
    lines = [x for x in text.split("\n") if x]
    counts = Counter(words)
    return [
        np.log1p(len(raw)), np.log1p(len(words)), sum(map(len, words)) / k, len(counts) / k, upper / max(upper + lower, 1e-9), rate(_DIGIT), rate(_JUNK), rate(_STOP), raw.count(b"!") / k, raw.count(b"?") / k, raw.count(b"|") / k, rate(bytes(range(128, 256))),
        np.log1p(len(words) / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), max(counts.values(), default=0) / k, len(MIXED.findall(text)) / k, sum(counts[s] for s in SECOND if s in counts) / k,
    ]

"""Hashed terms of a text: whole words and their beginnings."""

from __future__ import annotations

import re
import zlib

import numpy as np

WORD = re.compile(r"[^\W\d_]+")
#: Beginnings of words that count as terms besides the word itself.
STEMS = (4, 5, 6, 7)


class TermHasher:
    """Maps a text to the sorted distinct ids of its terms, below ``dims``.

    Words are runs of letters, lower-cased. What a word gives is remembered for
    up to ``remember`` words, after which the memory starts anew.
    """

    def __init__(self, dims: int, remember: int = 400_000):
        self.dims, self.remember, self.known = dims, remember, {}

    def of_word(self, word: str) -> tuple[int, ...]:
        terms = [word, *(f"{word[:k]}*" for k in STEMS if len(word) > k)]
        return tuple(zlib.crc32(t.encode()) % self.dims for t in terms)

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        known, ids = self.known, set()
        for word in set(WORD.findall(text.lower())):
            got = known.get(word)
            if got is None:
                if len(known) >= self.remember:
                    known.clear()
                got = known[word] = self.of_word(word)
            ids.update(got)
        return np.sort(np.fromiter(ids, np.int32, len(ids)))

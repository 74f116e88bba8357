"""Words and shingles of many texts at once, as 64-bit hashes in numpy arrays.

A word is a maximal run of letters, digits and other characters beyond ASCII; the punctuation and white space of ASCII
separate words. The hash of a word is a polynomial over its bytes modulo 2 ** 64, taken from running sums, and mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import mix64

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
IS_WORD = np.array([i >= 128 or chr(i).isalnum() for i in range(256)])
NOT_SPACE = np.array([not (9 <= i <= 13 or i == 32) for i in range(256)])
#: Bytes of text handled at once, about.
CHUNK = 1 << 20
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i below n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * CHUNK)
        _powers[:] = []
        for b in (BASE, INVERSE):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers[0][:n], _powers[1][:n]


def chunks(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, in lists of about CHUNK characters; a longer text is a list of its own."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > CHUNK:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def hashed_words(texts: list[str], table: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Hashes of all words, the index of each text's first word (and the end), the words' first and end bytes in the
    joined texts, and the texts' bytes. Texts are joined by a line feed."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    b = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    up, down = powers(len(b))
    word = table[b]
    turn = np.flatnonzero(np.diff(word, prepend=False))
    start, end = turn[::2], turn[1::2]
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    h = (total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    offsets = np.cumsum([0, *(len(r) + 1 for r in raw)])
    return mix64(h), np.searchsorted(start, offsets), start, end, raw


ROLL = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def shingles(words: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of width words within a text, and the text of each; a shorter text that has words is one shingle."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    size = np.diff(first)[of]
    h = np.zeros(n, np.uint64)
    step = lambda x: (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    for i in range(width):
        k = max(0, n - i)  # words that have an i-th after them
        part = words[i:] * ROLL[i % 5]
        h[:k] = step(h[:k]) + np.where(of[i:] == of[:k], part, np.uint64(i))
        h[k:] = step(h[k:]) + np.uint64(i)
    at = np.arange(n) - first[of]
    whole = (at + width <= size) | (at == 0) & (size < width)
    return mix64(h[whole]), of[whole]

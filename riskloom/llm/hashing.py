"""Words of many texts as hashes, without a Python object per word."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from riskloom.llm.common import lower_az

_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes that share one factor of the powers.
ROW = 2_048


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.uint64, np.uint64]:
    """Powers 1 to ROW of the base and 0 to ROW - 1 of its inverse (modulo 2**64), and the ROWth power of either."""
    up, down = (np.cumprod(np.full(ROW, b, np.uint64)) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return up, np.append(np.uint64(1), down[:-1]), up[-1], down[-1]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, start and length of each word in ``data`` (bytes, A-Z lower-cased).

    A word's hash is the sum of its bytes (plus one) times ascending powers of the base. The sums come as differences of one running
    sum over all bytes, whose powers go on from word to word, times the power of the inverse that leads back to the word's start.
    """
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = (data != 32) & (data - np.uint8(9) > 4)
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    up, down, up_row, down_row = _powers()
    rows = -(-len(data) // ROW)
    term = np.zeros(rows * ROW + 1, np.uint64)
    body = term[1:].reshape(rows, ROW)
    term[1:len(data) + 1] = data
    body += np.uint64(1)
    body *= up
    jump = np.cumprod(np.append(np.uint64(1), np.full(rows - 1, up_row, np.uint64)))
    body *= jump[:, None]
    np.cumsum(term, out=term)
    back = np.cumprod(np.append(np.uint64(1), np.full(rows - 1, down_row, np.uint64)))
    return mix((term[end] - term[begin]) * down[begin % ROW] * back[begin // ROW]), begin, end - begin


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word of ``texts`` (A-Z lower-cased) in order: a 64-bit hash, the index of its line among all lines of all texts;
    and for each text the index of its first line (one more at the end). A text has one line more than line feeds."""
    raw = [lower_az(t) for t in texts]
    first = np.cumsum([0] + [r.count(b"\n") + 1 for r in raw])
    data = np.frombuffer(b"\n".join(raw), np.uint8)
    h, start, _ = word_spans(data)
    before = np.searchsorted(start, np.flatnonzero(data == 10))  # words before each line's end
    return h, np.repeat(np.arange(len(before) + 1), np.diff(before, prepend=0, append=len(start))), first


def counted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and how often each occurs."""
    h = np.sort(h)
    begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[begin], np.diff(np.append(begin, len(h)))

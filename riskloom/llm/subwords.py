"""Subword ids of texts, with a table of words.

The vocabulary file's normaliser and its pre-tokeniser work inside white-space separated words (no merge, and no added
token, spans white space) and lower-case, so the ids of a text are those of its words one after another, whatever the case
of A-Z (but for texts with an added token's opening, which go word by word). Words repeat, texts hardly do: each worker keeps
the ids of the words that it has met, in numpy arrays behind an open-addressed table of 64-bit word hashes, and looks all
words of a group of texts up at once. Only new words become Python objects. The signs after a word's letters are pieces of
their own, and words of letters are encoded many at a time, parted by the tokens that end a word.
"""

from __future__ import annotations

from array import array
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np

from riskloom.llm.common import lower_az, text_groups
from riskloom.llm.hashing import word_spans

#: Slots of the table; where a third would be full, it begins anew with the words met often.
SLOT_BITS = 22
JOINED = 20_000
ADDED = b"<|"
#: Signs that may follow a word's letters as a piece of their own (quotes can join letters, angles can open an added token).
SIGNS = b"!#$%&()*+,-./:;=?@[\\]^_`{|}~"


class WordEncoder:
    """Texts -> ids (uint16)."""

    def __init__(self, path: str, slot_bits: int = SLOT_BITS):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        if self.size > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        self.ends = np.zeros(self.size, bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.ends[k] = token.endswith("</w>")
        self.slot_bits = slot_bits
        self._clear()

    def _clear(self) -> None:
        self.shift, self.mask = np.uint64(64 - self.slot_bits), (1 << self.slot_bits) - 1
        self.slot = np.full(1 << self.slot_bits, -1, np.int32)   # word numbers
        self.hash = np.zeros(0, np.uint64)
        self.start, self.length, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)
        self.met = np.zeros(0, np.uint8)   # in how many groups since the table began

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Word numbers of hashes, -1 where not known."""
        out = np.full(len(h), -1, np.int32)
        if not len(self.hash):
            return out
        at, todo = (h >> self.shift).astype(np.int64), np.arange(len(h))
        while len(todo):
            number = self.slot[at]
            same = (self.hash[number] == h[todo]) & (number >= 0)
            out[todo[same]] = number[same]
            on = ~same & (number >= 0)
            todo, at = todo[on], (at[on] + 1) & self.mask
        return out

    def _place(self, h: np.ndarray, first: int) -> None:
        """Enter distinct new hashes as word numbers from ``first``."""
        at, todo = (h >> self.shift).astype(np.int64), np.arange(len(h))
        while len(todo):
            free = self.slot[at] < 0
            self.slot[at[free]] = first + todo[free]   # of several for one slot, the last stays
            on = self.slot[at] != first + todo
            todo, at = todo[on], (at[on] + 1) & self.mask

    def _add(self, h: np.ndarray, ids: list[bytes], now: np.ndarray) -> None:
        """Enter distinct new words. A full table begins anew with the words of this group (``now``) and those met in two
        groups or more, or with the former alone; it grows only where a group has more words than fit."""
        if 3 * (len(self.hash) + len(h)) > len(self.slot):
            often = now | (self.met >= 2)
            kept = np.flatnonzero(often if 4 * (np.count_nonzero(often) + len(h)) <= len(self.slot) else now)
            old, length, flat = self.hash[kept], self.length[kept], self._gather(kept)
            while 3 * (len(kept) + len(h)) > len(self.slot):
                self.slot_bits += 1
                self.slot = np.zeros(1 << self.slot_bits, np.int32)
            self._clear()
            self._append(old, length, flat)
        self._append(h, np.array([len(i) // 2 for i in ids], np.int64), np.frombuffer(b"".join(ids), np.uint16))

    def _append(self, h: np.ndarray, length: np.ndarray, flat: np.ndarray) -> None:
        self._place(h, len(self.hash))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(length) - length])
        self.hash, self.length = np.concatenate([self.hash, h]), np.concatenate([self.length, length])
        self.flat, self.met = np.concatenate([self.flat, flat]), np.concatenate([self.met, np.zeros(len(h), np.uint8)])

    def _gather(self, words: np.ndarray) -> np.ndarray:
        """The ids of words (by number), one after another."""
        length = self.length[words]
        ahead = np.cumsum(length) - length
        return self.flat[np.repeat(self.start[words] - ahead, length) + np.arange(int(length.sum()))]

    def _encode(self, words: list[bytes]) -> list[bytes]:
        return [array("H", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def _encode_letters(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of lower-case letters: one piece each, closed by one word-end token."""
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, np.uint16)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            return self._encode(words)
        raw, ends = ids.tobytes(), (ends * 2).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def word_ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words."""
        letters, whole, parts = {}, {}, []
        for word in words:
            stem = word.rstrip(SIGNS)
            if not _letters(stem):
                whole[word] = b""
                parts.append((None, word))
                continue
            letters[stem] = b""
            sign = word[len(stem):]
            if sign:
                whole[sign] = b""
            parts.append((stem, sign))
        for table, encode in ((letters, self._encode_letters), (whole, self._encode)):
            keys = list(table)
            for k in range(0, len(keys), JOINED):
                part = keys[k:k + JOINED]
                table.update(zip(part, encode(part)))
        whole[b""] = b""
        return [whole[sign] if stem is None else letters[stem] + whole[sign] for stem, sign in parts]

    def __call__(self, texts: list[str | None], lower: bool = False) -> list[np.ndarray]:
        """Ids of each text; ``lower``: of the text with A-Z lower-cased, which differs for added tokens alone."""
        out: list[np.ndarray] = []
        for own in text_groups(texts):
            out += self._group(texts[own], lower)
        return out

    def _group(self, texts: list[str | None], lower: bool) -> list[np.ndarray]:
        raw = [lower_az(t) for t in texts]
        odd = {} if lower else {k: texts[k] for k, r in enumerate(raw) if ADDED in r}
        for k in odd:
            raw[k] = b""
        joined = b"\n".join(raw)
        h, start, size = word_spans(np.frombuffer(joined, np.uint8))
        number = self._find(h)
        new = np.flatnonzero(number < 0)
        if len(new):
            hashes, at = np.unique(h[new], return_index=True)
            at = new[at]
            words = [joined[a:b] for a, b in zip(start[at].tolist(), (start[at] + size[at]).tolist())]
            now = np.zeros(len(self.hash), bool)
            now[number[number >= 0]] = True
            self._add(hashes, self.word_ids(words), now)
            number = self._find(h)
        now = np.zeros(len(self.hash), bool)
        now[number] = True
        self.met += now & (self.met < 255)
        ids = self._gather(number)
        ends = np.concatenate([[0], np.cumsum(self.length[number])])
        text_ends = np.cumsum([len(r) + 1 for r in raw])
        cut = ends[np.searchsorted(start, text_ends)]
        out = np.split(ids, cut[:-1])
        for k, text in odd.items():
            words = text.encode("utf-8", "replace").split()
            own = list(dict.fromkeys(words))
            out[k] = np.frombuffer(b"".join(map(dict(zip(own, self._encode(own))).__getitem__, words)), np.uint16)
        return out


def _letters(word: bytes) -> bool:
    if word.isascii():
        return word.isalpha()
    text = word.decode()
    return text.isalpha() and text == text.lower() and is_normalized("NFC", text)


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)

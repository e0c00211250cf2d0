"""Byte-level BPE by the sentencepiece library: a model file written straight from a vocabulary of byte strings and ranks.

Each byte b of a piece becomes the character U+0100 + b, so a piece is a string without white space; its score is its negative
rank, and the normaliser is the identity. sentencepiece merges the best-scored pair, leftmost first: that is the lowest rank,
so a pre-token (a match of the split pattern) gets the ids that a byte-pair merge by ranks gives. A pre-token that is itself
in the vocabulary is that id, whether or not merges lead there. Ids of decoded pieces go back byte by byte through the inverse table.

Documents are encoded where they are (no shuffle); each worker keeps the ids of short pre-tokens that it has met, in a table of
bounded size. Null text counts as empty (no ids, no bytes); rows that repeat give equal rows; extra columns are left out.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from riskloom.llm.common import GROUP_CHARS, for_python, text_groups

#: First of the 256 characters that stand for bytes: letters, none of them white space.
BASE = 0x100
_MAP = {b: BASE + b for b in range(256)}
#: Pre-tokens that a worker remembers, and the longest of them in characters.
KNOWN, KNOWN_CHARS = 1 << 19, 48
#: Pre-tokens of a long text taken together.
RUN = 1 << 18


def vocabulary(path: str) -> dict[bytes, int]:
    """Byte strings and their ranks (0, 1, 2, ... without gaps) of a rank file."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, file))}
    if sorted(ranks.values()) != list(range(len(ranks))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must run from 0 without gaps, and hold all single bytes")
    return ranks


def mapped(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_MAP)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protobuf field: varint, 32-bit float or bytes."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


def model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model: piece k is the byte string of rank k; one more stands for unknown characters (there are none)."""
    # field numbers and enum values of sentencepiece_model.proto, fixed values:
    # pieces 1 (piece 1, score 2, type 3: normal 1, unknown 2), trainer_spec 2 (model_type 3: BPE 2, vocab_size 4, unk_id 40,
    # bos_id 41, eos_id 42, pad_id 43), normalizer_spec 3 (name 1, add_dummy_prefix 3, remove_extra_whitespaces 4, escape_whitespaces 5)
    pieces = [_field(1, mapped(p).encode()) + _field(2, float(-r)) + _field(3, 1) for p, r in sorted(ranks.items(), key=lambda x: x[1])]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(ranks)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class Coder:
    """Texts <-> ids, as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, pattern: str, known: int = KNOWN):
        import regex
        import sentencepiece
        ranks = vocabulary(path)
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model(ranks))
        self.pattern = regex.compile(pattern)
        self.whole = {p: struct.pack("<I", r) for p, r in ranks.items()}
        self.known_most, self.known = known, {}
        strings = [bytes(ord(c) - BASE for c in self.pieces.id_to_piece(k)) for k in range(len(ranks))]
        self.size = np.array([len(s) for s in strings], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(strings), np.uint8)

    def _new(self, tokens: set[str]) -> dict[str, bytes]:
        """Ids of pre-tokens."""
        out, rest = {}, []
        for token in tokens:
            raw = token.encode()
            if raw in self.whole:
                out[token] = self.whole[raw]
            else:
                rest.append((token, mapped(raw)))
        ids = self.pieces.encode([m for _, m in rest], out_type=int, num_threads=1)
        out.update((token, np.array(own, "<u4").tobytes()) for (token, _), own in zip(rest, ids))
        return out

    def _ids(self, found: list[list[str]]) -> list[bytes]:
        """Ids of lists of pre-tokens."""
        tokens = set().union(*found)
        if len(self.known) + len(tokens) > self.known_most:
            self.known = {}
        new = self._new(tokens - self.known.keys())
        self.known.update(new)
        out = [b"".join(map(self.known.__getitem__, f)) for f in found]
        for token in new:
            if len(token) > KNOWN_CHARS:
                del self.known[token]
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(texts) == 1 and len(texts[0] or "") > GROUP_CHARS:   # a long text, some pre-tokens at a time
            found = map(itemgetter(0), self.pattern.finditer(texts[0]))
            return [b"".join(self._ids([run])[0] for run in iter(lambda: list(islice(found, RUN)), []))]
        return self._ids([self.pattern.findall(t) if t else [] for t in texts])

    def decode(self, ids: bytes) -> bytes:
        k = np.frombuffer(ids, "<u4").astype(np.int64)
        size = self.size[k]
        ahead = np.cumsum(size) - size
        return self.flat[np.repeat(self.start[k] - ahead, size) + np.arange(int(size.sum()))].tobytes()


@lru_cache(2)
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit integers) of each document's whole text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = coder(path, pattern)
        for batch in batches:
            texts = batch["text"].tolist()
            for k in text_groups(texts):
                ids = own.encode(texts[k])
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[k], "n_tokens": [len(i) // 4 for i in ids], "ids": ids})
    kind = dict(docs.dtypes)["doc_id"]
    return for_python(docs.select("doc_id", "text")).mapInPandas(run, f"doc_id {kind}, n_tokens long, ids binary")


#: Ids decoded at once (about 40 bytes of memory each).
DECODED = 1 << 20


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """``tokens`` (doc_id, n_tokens, ids) with the decoded bytes of each document."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = coder(path, pattern)
        for batch in batches:
            batch["decoded"] = [b"".join(own.decode(ids[4 * k:4 * (k + DECODED)]) for k in range(0, len(ids) // 4, DECODED)) for ids in batch["ids"]]
            yield batch
    kind = dict(tokens.dtypes)["doc_id"]
    return for_python(tokens.select("doc_id", "n_tokens", "ids")).mapInPandas(run, f"doc_id {kind}, n_tokens long, ids binary, decoded binary")

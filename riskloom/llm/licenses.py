"""Licence scan by fuzzy short-notice search.

Texts become lower-case words joined by single spaces. A notice of n characters may differ by k = n // 10 edits, five at
most; cut into k + 2 pieces, at least two pieces must occur unchanged (pigeonhole), and the notice's start as told by either lies within
k characters of the true one. An Aho-Corasick automaton finds all pieces of all notices in one pass; where two pieces agree,
the ``regex`` library matches the whole notice with at most k errors between word boundaries.
Beside that, the base phrases are found as consecutive words.

Defined cases: null or empty text has no words, places or labels, and score 0; equal notices in one text are each reported;
rows that repeat stay; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import for_python

# Phrases whose places are counted, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Short notices, as words.
NOTICES = (
    ("gpl", "gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "licensed under a creative commons attribution"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "cc0 1 0 universal public domain dedication"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("epl", "eclipse public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("boost", "boost software license version 1 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("rights-reserved", "all rights reserved"),
)

MAX_EDITS = 5

#: Bytes of text to words: A-Z lower-cased, ASCII other than letters and digits to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

SPANS = "array<struct<label: string, first_word: long, last_word: long, errors: int>>"
FOUND = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPANS}"


def allowed(notice: str) -> int:
    return min(MAX_EDITS, len(notice) // 10)


def pieces(notice: str) -> list[tuple[int, str]]:
    """(offset, piece) of the k + 2 pieces."""
    k = allowed(notice) + 2
    edge = [len(notice) * i // k for i in range(k + 1)]
    return [(a, notice[a:b]) for a, b in zip(edge, edge[1:])]


@lru_cache(4)
def _matcher(notices: tuple[tuple[str, str], ...]):
    import ahocorasick
    import regex
    seeds: dict[str, list[tuple[int, int]]] = {}
    for i, (_, notice) in enumerate(notices):
        for offset, piece in pieces(notice):
            seeds.setdefault(piece, []).append((i, offset))
    automaton = ahocorasick.Automaton()
    for piece, uses in seeds.items():
        automaton.add_word(piece, (len(piece), uses))
    automaton.make_automaton()
    patterns = [regex.compile(f"(?e)(?<= )(?:{regex.escape(notice, literal_spaces=True)}){{e<={allowed(notice)}}}(?= )") for _, notice in notices]
    return automaton, patterns


def _neighbours(told: list[tuple[int, int]], reach: int) -> Iterator[tuple[tuple[int, int], tuple[int, int]]]:
    """Each start with the first later start, at most ``reach`` away, that another piece told."""
    for at, one in enumerate(told):
        for other in told[at + 1:at + 2 + reach]:
            if other[0] - one[0] > reach:
                break
            if other[1] != one[1]:
                yield one, other
                break


def notice_spans(text: str, notices: tuple[tuple[str, str], ...] = NOTICES) -> list[tuple[int, int, int, int]]:
    """(notice, start, end, errors) of notices in ``text`` (words parted, preceded and followed by one space)."""
    automaton, patterns = _matcher(notices)
    starts: dict[int, list[tuple[int, int]]] = {}
    for end, (size, uses) in automaton.iter(text):
        for i, offset in uses:
            starts.setdefault(i, []).append((end + 1 - size - offset, offset))
    regions: dict[int, list[list[int]]] = {}
    for i, told in starts.items():
        k, n = allowed(notices[i][1]), len(notices[i][1])
        if len(told) < 2:
            continue
        told.sort()
        for (a, _), (b, _) in _neighbours(told, 2 * k):
            lo, hi = max(0, a - 2 * k - 1), b + n + 2 * k + 1
            own = regions.setdefault(i, [])
            if own and lo <= own[-1][1]:
                own[-1][1] = max(hi, own[-1][1])
            else:
                own.append([lo, hi])
    out = []
    for i, own in regions.items():
        seen = -1
        for lo, hi in own:
            for m in patterns[i].finditer(text, max(lo, seen), min(hi, len(text))):
                out.append((i, m.start(), m.end(), sum(m.fuzzy_counts)))
                seen = m.end()
    return sorted(out, key=lambda x: x[1:])


def scan_text(text: str | None, notices: tuple[tuple[str, str], ...] = NOTICES) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of one text."""
    words = (text or "").encode("utf-8", "replace").translate(_FOLD).split()
    line = (b" " + b" ".join(words) + b" ").decode()
    word_at = lambda p: line.count(" ", 0, p) - 1  # noqa: E731  index of the word that starts at p
    starts, base = [], set()
    for phrase, label in BASE.items():
        at = line.find(f" {phrase} ")
        while at >= 0:
            starts.append(word_at(at + 1))
            base.add(label)
            at = line.find(f" {phrase} ", at + 1)
    labels, score, spans = set(base), float(bool(base)), []
    for i, a, b, errors in notice_spans(line, notices):
        label, notice = notices[i]
        labels.add(label)
        score = max(score, 1 - errors / len(notice))
        spans.append({"label": label, "first_word": word_at(a), "last_word": word_at(b + 1) - 1, "errors": errors})
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), score, spans)


def scan(docs: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """One row per document: counts, word places, labels, score (1: exact) and the notices' spans with their edits."""
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = pd.DataFrame([scan_text(t, notices) for t in part["text"]], columns=names, index=part.index)
            out = out.astype({"first_word": "Int64", "last_word": "Int64"})
            yield out.assign(doc_id=part["doc_id"])[["doc_id", *names]]
    return for_python(docs).select(F.col("doc_id").cast("long"), "text").mapInPandas(run, FOUND)

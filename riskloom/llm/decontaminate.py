"""Benchmark decontamination by latent semantic retrieval.

1. Documents are reduced once to the positions and ids of the words that occur in the benchmark (checkpointed); words
   outside it can neither match an item nor add to a dot product with one.
2. Document frequencies over all documents give TF-IDF weights; terms in more than ``STOP_SHARE`` of the documents are
   stop words of the retrieval (not of the later checks), unless they are among the ``RAREST`` rarest terms of an item. A
   term counts in at most as many documents as it has contexts (two benchmark words before and after it), so a passage or
   paraphrase that a third of all documents share doesn't make its words common.
3. All passages (``2 * HALF`` words, every ``HALF`` words) and the benchmark's items, as heavy as all passages together, are
   the rows of a matrix A. A randomised SVD takes two passes: each task adds up its share of A'(A Omega), and then of
   (A Q)'(A Q); the tasks' small matrices meet in a tree. Both have as many rows as the benchmark has terms.
4. Passages whose cosine with an item in the latent space reaches ``MIN_COSINE`` are candidates.
5. In the document's words around a candidate passage, the longest common subsequence with the item is computed (bit
   parallel) and the tightest span that holds it. An item is leaked if the share of its words in that subsequence reaches
   ``VERBATIM``, or ``PARAPHRASE`` with its answer (its last sentence; at least its last quarter) also there to ``ANSWER``.

The benchmark is handled in blocks of ``ITEM_BLOCK`` items, so what tasks hold is bounded whatever its size.

Defined cases: null or empty texts and items match nothing; items of fewer than ``MIN_ITEM_WORDS`` words, which share
single words with any text, match where all their words stand one after another (items of fewer than ``LEAST_WORDS``, which no
text is free of, match nothing); items with equal texts are reported each; rows that repeat are reported each;
extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import cut_lineage, for_python, row_hash, small, whole_row

HALF = 16
STOP_SHARE = 0.05
RAREST = 8
#: Registers of a term's count of contexts (HyperLogLog, about 6.5 % error).
REGISTERS = 256
RANK = 96
OVERSAMPLE = 16
MIN_COSINE = 0.45
VERBATIM = 0.75
PARAPHRASE = 0.6
ANSWER = 0.8
MIN_ITEM_WORDS, LEAST_WORDS = 6, 3
ITEM_BLOCK = 2_000
GROUP_WORDS = 50_000
SEED = 7

#: Bytes of text to words: A-Z lower-cased, ASCII other than letters and digits to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")

COMPACT = "doc_id long, row_hash long, n_words long, pos binary, ids binary"
FOUND = "doc_id long, row_hash long, item_id long, cosine double, lcs long, item_words long, overlap double, answer_overlap double, first_word long, last_word long"


def fold(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


class Items:
    """A block of benchmark items: vocabulary, word ids, answers; with idf, their TF-IDF rows."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.vocab: dict[bytes, int] = {}
        self.item_ids: list[int | None] = []
        self.words: list[np.ndarray] = []
        self.answers: list[np.ndarray] = []
        self.short: list[tuple[int | None, np.ndarray]] = []   # searched word for word
        for item_id, text in rows:
            words = fold(text)
            if len(words) < MIN_ITEM_WORDS:
                if len(words) >= LEAST_WORDS:
                    self.short.append((item_id, np.array([self.vocab.setdefault(w, len(self.vocab)) for w in words], np.int32)))
                continue
            last = fold([s for s in _SENTENCE.split(text) if fold(s)][-1])
            last = words[-max(len(last), -(-len(words) // 4)):] if len(last) < len(words) else words[-(-3 * len(words) // 4):]
            ids = lambda ws: np.array([self.vocab.setdefault(w, len(self.vocab)) for w in ws], np.int32)
            self.item_ids.append(item_id)
            self.words.append(ids(words))
            self.answers.append(ids(last))

    def idf(self, df: np.ndarray, n_docs: int) -> np.ndarray:
        """Weight of each term, zero for stop words."""
        idf = np.log1p(n_docs / np.maximum(df, 1)).astype(np.float32)
        keep = df <= STOP_SHARE * n_docs
        for w in self.words:
            own = np.unique(w)
            keep[own[np.argsort(df[own], kind="stable")[:RAREST]]] = True
        return np.where(keep, idf, np.float32(0))

    def tfidf(self, idf: np.ndarray) -> np.ndarray:
        a = np.zeros((len(self.words), len(idf)), np.float32)
        for i, w in enumerate(self.words):
            np.add.at(a[i], w, idf[w])
        return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)


def compact(docs: DataFrame, vocab: dict[bytes, int]) -> DataFrame:
    """Positions and ids of vocabulary words, two int32 arrays a document."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = vocab.get
        for part in parts:
            n, pos, ids = [], [], []
            for text in part["text"]:
                words = fold(text)
                own = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
                at = np.flatnonzero(own >= 0)
                n.append(len(words))
                pos.append(at.astype(np.int32).tobytes())
                ids.append(own[at].tobytes())
            yield pd.DataFrame({"doc_id": part["doc_id"], "row_hash": part["row_hash"], "n_words": n, "pos": pos, "ids": ids})
    own = docs.select(F.col("doc_id").cast("long"), row_hash().alias("row_hash"), "text")
    return for_python(own).mapInPandas(run, COMPACT)


def _contexts(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term, register and rank of every occurrence in documents, from a hash of the two terms before and after it."""
    gap = np.full(2, -1, np.int64)
    flat = np.concatenate([gap, *[x for own in ids for x in (own.astype(np.int64), gap)]])
    h = np.zeros(len(flat) - 4, np.uint64)
    for k in (0, 1, 3, 4):
        h = (h ^ (flat[k:k + len(h)] + 2).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    term = flat[2:-2]
    own = term >= 0
    register = (h[own] % np.uint64(REGISTERS)).astype(np.int64)
    rank = 41 - np.frexp((h[own] >> np.uint64(24)).astype(float))[1]
    return term[own], register, rank.astype(np.uint8)


def _distinct(registers: np.ndarray) -> np.ndarray:
    """HyperLogLog estimate for each row of registers."""
    m = registers.shape[1]
    raw = 0.7213 / (1 + 1.079 / m) * m * m / np.exp2(-registers.astype(float)).sum(1)
    empty = (registers == 0).sum(1)
    return np.where((raw <= 2.5 * m) & (empty > 0), m * np.log(m / np.maximum(empty, 1)), raw)


def document_frequency(docs: DataFrame, n_terms: int) -> tuple[np.ndarray, int]:
    """The number of documents with each term, at most that of its contexts; and of all documents."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, seen = np.zeros(n_terms + 1, np.int64), np.zeros(n_terms * REGISTERS, np.uint8)
        for part in parts:
            df[n_terms] += len(part)
            held, size = [], 0
            for raw in part["ids"]:
                held.append(np.frombuffer(raw, np.int32))
                df[np.unique(held[-1])] += 1
                size += len(held[-1])
                if size > 2_000_000:
                    term, register, rank = _contexts(held)
                    np.maximum.at(seen, term * REGISTERS + register, rank)
                    held, size = [], 0
            term, register, rank = _contexts(held)
            np.maximum.at(seen, term * REGISTERS + register, rank)
        yield pd.DataFrame({"df": [df.tobytes()], "seen": [seen.tobytes()]})
    blobs = docs.select("ids").mapInPandas(run, "df binary, seen binary").rdd.map(lambda r: (np.frombuffer(r.df, np.int64), np.frombuffer(r.seen, np.uint8)))
    if blobs.getNumPartitions() == 0:
        return np.zeros(n_terms, np.int64), 0
    df, seen = blobs.treeReduce(lambda a, b: (a[0] + b[0], np.maximum(a[1], b[1])), depth=3)
    contexts = np.ceil(_distinct(seen.reshape(n_terms, REGISTERS))).astype(np.int64)
    return np.minimum(df[:n_terms], contexts), int(df[n_terms])


def _passages(part: pd.DataFrame, idf: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """For groups of documents of about GROUP_WORDS words (arrays that fit in cache): (document index of each half block, entries' half block, term, weight)."""
    rows = list(zip(part["n_words"], part["pos"], part["ids"]))
    start = 0
    while start < len(rows):
        owner, blk, term, n_blk, end, n = [], [], [], 0, start, 0
        while end < len(rows) and (end == start or n + rows[end][0] <= GROUP_WORDS):
            words, pos, ids = rows[end]
            ids = np.frombuffer(ids, np.int32)
            at = np.flatnonzero(idf[ids] > 0)
            count = -(-words // HALF) + 1  # one empty half block parts this document from the next
            blk.append(np.frombuffer(pos, np.int32)[at] // HALF + n_blk)
            term.append(ids[at])
            owner.append(np.full(count, end))
            n_blk, n, end = n_blk + count, n + words, end + 1
        term = np.concatenate(term)
        yield np.concatenate(owner), np.concatenate(blk), term, idf[term]
        start = end


def _passage_rows(n_blk: int, blk: np.ndarray, term: np.ndarray, weight: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Rows of A @ matrix for the passages (half block i and i + 1), not yet normalised."""
    half = np.zeros((n_blk + 1, matrix.shape[1]), np.float32)
    if len(blk):
        first = np.flatnonzero(np.diff(blk, prepend=-1))
        half[blk[first]] = np.add.reduceat(matrix[term] * weight[:, None], first, axis=0)
    return half[:-1] + half[1:]


def _norms(n_blk: int, blk: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """TF-IDF length of each passage; a term in both halves counts with its summed weight."""
    entry = np.concatenate([blk, blk - 1]).astype(np.int64)
    both = np.concatenate([term, term]).astype(np.int64)
    own = entry >= 0
    key, inverse = np.unique(entry[own] * (1 << 32) + both[own], return_inverse=True)
    w = np.bincount(inverse, np.concatenate([weight, weight])[own], len(key))
    return np.sqrt(np.bincount(key >> 32, w * w, n_blk)) + 1e-12


def _tree_sum(docs: DataFrame, task, shape: tuple[int, int]) -> np.ndarray:
    """Sum over all tasks of the matrix that ``task`` makes of a task's documents."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(shape)
        for part in parts:
            task(part, out)
        yield pd.DataFrame({"m": [out.astype(np.float32).tobytes()]})
    blobs = docs.select("n_words", "pos", "ids").mapInPandas(run, "m binary").rdd.map(lambda r: np.frombuffer(r.m, np.float32))
    if blobs.getNumPartitions() == 0:
        return np.zeros(shape)
    return blobs.treeReduce(lambda a, b: a + b, depth=3).reshape(shape).astype(np.float64)


def latent_basis(docs: DataFrame, items: Items, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Terms x rank matrix of the right singular vectors of A by randomised SVD."""
    n_terms, rng = len(idf), np.random.default_rng(SEED)
    b = items.tfidf(idf)
    width = min(n_terms, rank + OVERSAMPLE)
    omega = rng.standard_normal((n_terms, width)).astype(np.float32)

    def sketch(part: pd.DataFrame, out: np.ndarray) -> None:
        for owner, blk, term, weight in _passages(part, idf):
            y = _passage_rows(len(owner), blk, term, weight, omega) / (_norms(len(owner), blk, term, weight)[:, None] ** 2).astype(np.float32)
            y[1:] += y[:-1].copy()  # a word of half block i is in passages i - 1 and i
            order = np.argsort(term, kind="stable")
            t = term[order]
            if len(t):
                first = np.flatnonzero(np.diff(t, prepend=-1))
                out[t[first]] += np.add.reduceat(y[blk[order]] * weight[order][:, None], first, axis=0)

    def gram(part: pd.DataFrame, out: np.ndarray) -> None:
        for owner, blk, term, weight in _passages(part, idf):
            y = _passage_rows(len(owner), blk, term, weight, q) / _norms(len(owner), blk, term, weight)[:, None].astype(np.float32)
            out += y.T @ y

    z = _tree_sum(docs, sketch, (n_terms, width))
    own = b.T @ (b @ omega)
    z += own * (np.linalg.norm(z) / max(np.linalg.norm(own), 1e-12))
    q = np.linalg.qr(z)[0].astype(np.float32)
    g = _tree_sum(docs, gram, (q.shape[1], q.shape[1]))
    own = (b @ q).T @ (b @ q)
    g += own * (np.trace(g) / max(np.trace(own), 1e-12))
    values, vectors = np.linalg.eigh(g)
    return np.ascontiguousarray(q @ vectors[:, np.argsort(values)[::-1][:rank]], np.float32)


def lcs_mask(item: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


def lcs(mask: dict[int, int], n: int, words: list[int]) -> list[int]:
    """Length of the longest common subsequence after each of ``words`` (bit-parallel)."""
    full, s, out = (1 << n) - 1, (1 << n) - 1, []
    for w in words:
        if w in mask:
            u = s & mask[w]
            s = ((s + u) | (s - u)) & full
        out.append(n - s.bit_count())
    return out


def leak(item: np.ndarray, answer: np.ndarray, pos: np.ndarray, ids: np.ndarray) -> tuple[int, float, int, int] | None:
    """(subsequence length, answer's share, first and last word) of the tightest span found, or None without a common word."""
    n = len(item)
    run = lcs(lcs_mask(item), n, ids.tolist())
    best = run[-1] if run else 0
    if not best:
        return None
    last = next(i for i, x in enumerate(run) if x == best)
    back = lcs(lcs_mask(item[::-1]), n, ids[:last + 1][::-1].tolist())
    first = last - next(i for i, x in enumerate(back) if x == best)
    own = ids[first:last + 1].tolist()
    answered = lcs(lcs_mask(answer), len(answer), own)[-1] / len(answer)
    return best, answered, int(pos[first]), int(pos[last])


def proof(item: np.ndarray, answer: np.ndarray, pos: np.ndarray, ids: np.ndarray) -> tuple[int, float, int, int] | None:
    """``leak`` if it passes the checks; where its span is too wide, of the first narrower window that does."""
    n = len(item)

    def passes(found) -> bool:
        return found is not None and (found[0] >= VERBATIM * n or found[0] >= PARAPHRASE * n and found[1] >= ANSWER)
    found = leak(item, answer, pos, ids)
    if not passes(found):
        return None
    if found[3] - found[2] + 1 <= 2 * n:
        return found
    for lo in range(int(pos[0]), int(pos[-1]) + 1, max(1, n // 2)):
        a, z = np.searchsorted(pos, (lo, lo + 2 * n))
        found = leak(item, answer, pos[a:z], ids[a:z])
        if passes(found):
            return found
    return None


def _runs(docs: np.ndarray, items: np.ndarray, blocks: np.ndarray, cosine: np.ndarray, reach: np.ndarray) -> Iterator[tuple]:
    """Candidates in order of document, item and half block, joined where they follow within the item's reach: (document, item,
    (first, last half block), best cosine)."""
    k = 0
    while k < len(docs):
        end = k + 1
        while end < len(docs) and docs[end] == docs[k] and items[end] == items[k] and blocks[end] <= blocks[k] + reach[items[k]]:
            end += 1
        yield int(docs[k]), int(items[k]), (int(blocks[k]), int(blocks[end - 1])), float(cosine[k:end].max())
        k = end


def search(docs: DataFrame, items: Items, idf: np.ndarray, basis: np.ndarray, min_cosine: float = MIN_COSINE) -> DataFrame:
    """Leaks (doc, item): the best candidate passage of each pair that passes the checks."""
    targets = items.tfidf(idf) @ basis
    targets /= np.maximum(np.linalg.norm(targets, axis=1, keepdims=True), 1e-12)
    lengths = np.array([len(w) for w in items.words])
    reach = -(-lengths // HALF)
    counts = [Counter(w.tolist()) for w in items.words]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            doc_id, hashes = part["doc_id"].to_numpy(dtype=object), part["row_hash"].to_numpy()
            poss, idss = part["pos"].tolist(), part["ids"].tolist()
            best: dict[tuple[int, int], tuple] = {}
            for owner, blk, term, weight in _passages(part, idf):
                first_blk = np.flatnonzero(np.diff(owner, prepend=-1))
                offset = np.repeat(first_blk, np.diff(np.append(first_blk, len(owner))))
                p = _passage_rows(len(owner), blk, term, weight, basis)
                p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
                cosine = p @ targets.T
                at, item = np.nonzero(cosine >= min_cosine)
                order = np.lexsort((at, item, owner[at]))
                for d, i, blocks, c in _runs(owner[at[order]], item[order], at[order] - offset[at[order]], cosine[at[order], item[order]], reach):
                    pos = np.frombuffer(poss[d], np.int32)
                    a, z = np.searchsorted(pos, ((blocks[0] - reach[i]) * HALF, (blocks[1] + reach[i] + 2) * HALF))
                    ids = np.frombuffer(idss[d], np.int32)[a:z]
                    here = counts[i].keys() & set(ids.tolist())
                    if sum(map(counts[i].__getitem__, here)) < PARAPHRASE * lengths[i]:
                        continue  # too few of the item's words for any subsequence to pass
                    found = proof(items.words[i], items.answers[i], pos[a:z], ids)
                    if found is not None:
                        length, answered, first, last = found
                        row = (length, c, -first, length / int(lengths[i]), answered, first, last)
                        if row > best.get((d, i), ()):
                            best[d, i] = row
            rows = [(doc_id[d], hashes[d], items.item_ids[i], r[1], r[0], int(lengths[i]), r[3], r[4], r[5], r[6]) for (d, i), r in best.items()]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])
            yield out.astype({"doc_id": "Int64", "item_id": "Int64"})
    return docs.mapInPandas(run, FOUND)


def short_items(docs: DataFrame, items: Items) -> DataFrame:
    """Leaks of the short items: the first place of each in a document where its words stand one after another."""
    by_first: dict[int, list[tuple[int | None, np.ndarray]]] = {}
    for item_id, words in items.short:
        by_first.setdefault(int(words[0]), []).append((item_id, words))
    starts = np.array(list(by_first), np.int32)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for doc_id, row_hash_, pos, ids in zip(part["doc_id"].to_numpy(dtype=object), part["row_hash"], part["pos"], part["ids"]):
                pos, ids, found = np.frombuffer(pos, np.int32), np.frombuffer(ids, np.int32), set()
                for k in np.flatnonzero(np.isin(ids, starts)).tolist():
                    for n, (item_id, words) in enumerate(by_first[int(ids[k])]):
                        m = len(words)
                        if (int(ids[k]), n) in found or k + m > len(ids) or pos[k + m - 1] - pos[k] != m - 1 or not np.array_equal(ids[k:k + m], words):
                            continue
                        found.add((int(ids[k]), n))
                        rows.append((doc_id, row_hash_, item_id, 1.0, m, m, 1.0, 1.0, int(pos[k]), int(pos[k]) + m - 1))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])
            yield out.astype({"doc_id": "Int64", "item_id": "Int64"})
    return docs.mapInPandas(run, FOUND)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs of a document and a benchmark item that it leaks, with cosine, overlap and span (in words from 0)."""
    out = docs.sparkSession.createDataFrame([], FOUND)
    for rows in _blocks(benchmark):
        items = Items(rows)
        if not items.vocab:
            continue
        own = cut_lineage(compact(docs, items.vocab))
        if items.short:
            out = out.unionByName(cut_lineage(short_items(own, items)))
        if not items.words:
            continue
        df, n_docs = document_frequency(own, len(items.vocab))
        idf = items.idf(df, n_docs)
        basis = latent_basis(own, items, idf)
        out = out.unionByName(cut_lineage(search(own, items, idf, basis)))
    return out


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    block: list[tuple[int, str]] = []
    for r in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        block.append((r.item_id, r.text))
        if len(block) == ITEM_BLOCK:
            yield block
            block = []
    if block:
        yield block


def drop_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    bad = cut_lineage(leaks(docs, benchmark).select(F.col("row_hash").alias("bad_hash")).distinct())
    rows = docs.select(whole_row(docs), row_hash().alias("row_hash"))
    return rows.join(small(bad), F.col("row_hash") == F.col("bad_hash"), "left_anti").select("row.*")

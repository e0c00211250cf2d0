"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each read as a word of the perfect binary
(23, 12) Golay code. Two fingerprints that differ in at most two bits have, by the pigeonhole principle, an equal
segment Z whose successor W differs in at most one bit (for the three pairs (0,1), (1,2), (2,0)). A word at
distance three from its codeword has five further codewords at distance four, all others have none; two words that
differ in one bit therefore always have the codeword of the one among the (one or six) codewords of the other.
Each fingerprint is looked up under one key (pair, Z, codeword of W) and stored under up to six, per pair. The join
compares distinct fingerprints only, so copies never meet each other, and every candidate is verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from riskloom.llm.common import cut_lineage, folded_words, for_python, row_hash, small, take_rows
from riskloom.llm.components import connected_components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: (shift, bits) of the three segments.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
PAIRS = ((0, 1), (1, 2), (2, 0))
#: Generator polynomial x^11+x^9+x^7+x^6+x^5+x+1 of the cyclic Golay code.
GENERATOR = 0b101011100011


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash: bit set if it is set in over half of the shingles' hashes; no words: zero."""
    words = folded_words(text)
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*[words[k:] for k in range(shingle)]))
    h64 = xxhash.xxh64_intdigest
    hashes = np.array([h64(p, SEED) for p in parts], dtype=">u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        block = hashes[k:k + 65536]
        ones += np.unpackbits(block.view(np.uint8).reshape(len(block), 8), axis=1).sum(0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


@F.pandas_udf(LongType())
def fingerprint_udf(text: pd.Series, shingle: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t, k) for t, k in zip(text, shingle)], dtype="int64")


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit polynomials modulo the generator."""
    r = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        r ^= np.where((r >> bit) & 1 == 1, GENERATOR << (bit - 11), 0)
    return r


@lru_cache(1)
def golay() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome: the error pattern of at most three bits, and the offsets to the five codewords at distance four
    (zero-filled where the pattern has fewer than three bits)."""
    patterns = np.array([sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(23), n)])
    error = np.zeros(2048, np.int64)
    error[_syndrome(patterns)] = patterns
    data = np.arange(4096) << 11
    code = data ^ _syndrome(data)
    sevens = code[np.bitwise_count(code.astype(np.uint32)) == 7]
    further = np.zeros((2048, 5), np.int64)
    for p in patterns[np.bitwise_count(patterns.astype(np.uint32)) == 3]:
        further[_syndrome(np.array([p]))[0]] = sevens[(sevens & p) == p]
    return error, further


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest codeword of each word, and (n, 6) indices of all codewords within distance four
    (the nearest repeated where there are fewer)."""
    error, further = golay()
    s = _syndrome(words)
    nearest = words ^ error[s]
    near = np.concatenate([nearest[:, None], nearest[:, None] ^ further[s]], axis=1)
    return nearest >> 11, near >> 11


def _key_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, fp, probe): one probe row and one to six stored rows for each pair of segments."""
    for part in parts:
        fp = part["fp"].to_numpy(np.int64)
        seg = [(fp.view(np.uint64) >> np.uint64(s)).astype(np.int64) & ((1 << n) - 1) for s, n in SEGMENTS]
        for k, (z, w) in enumerate(PAIRS):
            one, six = golay_keys(seg[w])
            head = ((k << 22) | seg[z]) << 12
            yield pd.DataFrame({"key": head | one, "fp": fp, "probe": True})
            for j in range(6):
                own = slice(None) if j == 0 else six[:, j] != one
                yield pd.DataFrame({"key": (head | six[:, j])[own], "fp": fp[own], "probe": False})


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints (column fp) within ``max_bits`` (at most two) bits."""
    if not 0 <= max_bits <= 2:
        raise ValueError("three segments prove links of at most two bits")
    keys = cut_lineage(fps.select("fp").distinct().mapInPandas(_key_rows, "key long, fp long, probe boolean"))
    probe = keys.where("probe").select("key", F.col("fp").alias("p"))
    stored = keys.where("not probe").select("key", F.col("fp").alias("q"))
    near = F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) <= max_bits
    pairs = probe.join(stored, "key").where((F.col("p") != F.col("q")) & near)
    return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, row_hash, fp (long), fingerprint (16 hex digits), component_id.

    Documents with equal fingerprints are one class; classes are linked, and ``component_id`` is the smallest doc_id
    of all classes reachable. Null or empty text has fingerprint zero and links like any other; a null doc_id never
    counts as smallest, so a component without any id has a null component_id. Rows that repeat stay. Extra columns are
    ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = cut_lineage(for_python(docs).select("doc_id", row_hash().alias("row_hash"),
                                  fingerprint_udf(text, F.lit(shingle)).alias("fp")))
    edges = cut_lineage(links(own, max_bits))
    roots = connected_components(edges)
    classes = own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_hash")).alias("best"))
    classes = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = cut_lineage(classes)
    heads = classes.groupBy("root").agg(F.min("first").alias("component_id"), F.min("best").alias("keep"))
    classes = cut_lineage(classes.select("fp", "root").join(heads, "root").select(
        "fp", "component_id", F.col("keep.row_hash").alias("keep_hash")))
    out = own.join(small(classes), "fp")
    return out.select("doc_id", "row_hash", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "keep_hash")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns (rows that repeat: one)."""
    found = near_duplicates(docs, shingle, max_bits)
    plan = found.where(F.col("row_hash") == F.col("keep_hash")).groupBy("row_hash").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    return take_rows(docs, cut_lineage(plan.withColumn("times", F.lit(1))))

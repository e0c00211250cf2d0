"""Token ids in files of range-asymmetric-numeral-system (rANS) blocks.

Documents are laid out by ascending doc_id (nulls last, equal ids by text) over range partitions, tokenised, and cut into
blocks of whole documents with at least ``BLOCK_TOKENS`` ids. One static frequency table, counted over all ids, is shared by
all blocks; every symbol of the vocabulary has a frequency of at least one. Within a block ``LANES`` coder states take turns
(id i belongs to lane i mod LANES) and share one stream of 32-bit words. Every ``CHECKPOINT`` turns the block records the
lanes' states and the stream's position, so a block can be decoded from each checkpoint independently; numpy decodes all
checkpoints of many blocks side by side. Each block has a CRC-32 of its ids.

The files are Parquet tables below one folder: ``frequencies`` (symbol, frequency), ``blocks`` (part, block, doc_ids, lengths,
n_tokens, crc32, checkpoints, words), and ``raw``, the ids before coding. Spark writes them, so a lost task is simply written
again.

Defined cases: null or empty text is the end id alone; rows that repeat are stored each; extra columns are ignored; an empty
table gives empty files. A damaged block raises ValueError.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import cut_lineage, for_python, small
from riskloom.llm.subwords import encoder

LANES = 64
CHECKPOINT = 256
BLOCK_TOKENS = 1 << 16
SCALE = 20
LOW = np.uint64(1 << 31)
END_ID = 2
#: Padded ids that numpy codes side by side.
BATCH_TOKENS = 1 << 22

RAW = "part int, block int, doc_ids array<long>, lengths array<int>, ids binary, counts binary"
BLOCK = "part int, block int, doc_ids array<long>, lengths array<int>, n_tokens long, crc32 long, checkpoints binary, words binary"
DECODED = "part int, block int, doc_id long, offset long, n_tokens long, ids_crc32 long"


def scaled(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies of at least one that sum to 2**scale, in proportion to ``counts``."""
    total, room = max(1, int(counts.sum())), (1 << scale) - len(counts)
    freq = 1 + (counts.astype(object) * room // total).astype(np.int64)
    freq[int(np.argmax(counts))] += (1 << scale) - int(freq.sum())
    return freq


class Coder:
    def __init__(self, freq: np.ndarray, scale: int = SCALE):
        self.scale = np.uint64(scale)
        self.mask = np.uint64((1 << scale) - 1)
        self.freq = freq.astype(np.uint64)
        self.cum = (np.cumsum(freq) - freq).astype(np.uint64)
        self.limit = self.freq << np.uint64(63 - scale)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint16), freq)

    def encode(self, blocks: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
        """(checkpoints, words) of each block."""
        out: list = [None] * len(blocks)
        for group in _alike([len(b) for b in blocks]):
            for k, x in zip(group, self._encode([blocks[k] for k in group])):
                out[k] = x
        return out

    def _encode(self, blocks: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
        n = np.array([len(b) for b in blocks])
        turns = -(-n // LANES)
        top = int(turns.max(initial=0))
        ids = np.zeros((len(blocks), top * LANES), np.uint16)
        for k, b in enumerate(blocks):
            ids[k, :len(b)] = b
        ids = ids.reshape(len(blocks), top, LANES)
        lane = np.arange(LANES)
        x = np.full((len(blocks), LANES), LOW)
        words, count, states = [None] * top, np.zeros((top, len(blocks)), np.int64), {}
        whole = int(n.min(initial=0)) // LANES  # turns in which every lane of every block has an id
        for t in range(top - 1, -1, -1):
            s = ids[:, t]
            f = self.freq[s]
            full = x >= self.limit[s]
            live = None if t < whole else (t * LANES + lane)[None, :] < n[:, None]
            if live is not None:
                full &= live
            words[t] = x[full].astype("<u4")  # the low 32 bits
            count[t] = np.count_nonzero(full, axis=1)
            np.right_shift(x, np.uint64(32), out=x, where=full)
            q = x // f
            y = x - q * f
            y += q << self.scale
            y += self.cum[s]
            x = y if live is None else np.where(live, y, x)
            if t % CHECKPOINT == 0:
                states[t // CHECKPOINT] = x.copy()
        before = np.concatenate([np.zeros((1, len(blocks)), np.int64), np.cumsum(count, 0)])
        stream = np.concatenate(words) if top else np.zeros(0, "<u4")
        owner = np.repeat(np.tile(np.arange(len(blocks)), top), count.ravel())
        stream = stream[np.argsort(owner, kind="stable")]
        ends = np.cumsum(before[-1])
        out = []
        for k in range(len(blocks)):
            marks = range(-(-int(turns[k]) // CHECKPOINT))
            head = b"".join(np.append(np.uint64(before[c * CHECKPOINT, k]), states[c][k]).astype("<u8").tobytes() for c in marks)
            out.append((head, stream[ends[k] - before[-1, k]:ends[k]].tobytes()))
        return out

    def decode(self, blocks: list[tuple[int, bytes, bytes]]) -> list[np.ndarray]:
        """Ids of blocks (n_tokens, checkpoints, words); all their checkpoints are decoded side by side."""
        out: list = [None] * len(blocks)
        for group in _alike([b[0] for b in blocks]):
            for k, x in zip(group, self._decode([blocks[k] for k in group])):
                out[k] = x
        return out

    def _decode(self, blocks: list[tuple[int, bytes, bytes]]) -> list[np.ndarray]:
        marks = [np.frombuffer(c, "<u8").reshape(-1, LANES + 1) for _, c, _ in blocks]
        sizes = np.array([len(w) // 4 for _, _, w in blocks])
        base = np.cumsum(sizes) - sizes
        stream = np.concatenate([np.frombuffer(b"".join(w for _, _, w in blocks), "<u4"), np.zeros(1, "<u4")]).astype(np.uint64)
        owner = np.repeat(np.arange(len(blocks)), [len(m) for m in marks])
        mark = np.concatenate(marks) if marks else np.zeros((0, LANES + 1), np.uint64)
        n = np.array([b[0] for b in blocks], np.int64)
        turn0 = np.concatenate([np.arange(len(m)) * CHECKPOINT for m in marks]) if marks else np.zeros(0, np.int64)
        left = n[owner] - turn0 * LANES
        at = base[owner] + mark[:, 0].astype(np.int64)
        ids = np.zeros((len(mark), CHECKPOINT, LANES), np.uint16)
        whole = left >= CHECKPOINT * LANES
        for jobs in (np.flatnonzero(whole), np.flatnonzero(~whole)):
            if len(jobs):
                ids[jobs] = self._turns(mark[jobs, 1:], at[jobs], left[jobs], stream)
        ids = ids.reshape(len(mark), CHECKPOINT * LANES)
        first = np.cumsum([0] + [len(m) for m in marks])
        return [ids[first[k]:first[k + 1]].reshape(-1)[:n[k]] for k in range(len(blocks))]

    def _turns(self, x: np.ndarray, at: np.ndarray, left: np.ndarray, stream: np.ndarray) -> np.ndarray:
        """Up to CHECKPOINT turns from states ``x`` and stream positions ``at``; ``left`` ids at most."""
        lane = np.arange(LANES)
        ids = np.zeros((len(x), CHECKPOINT, LANES), np.uint16)
        whole = int(left.min()) // LANES
        for t in range(min(CHECKPOINT, -(-int(left.max()) // LANES))):
            slot = x & self.mask
            s = self.symbol[slot.view(np.int64)]
            ids[:, t] = s
            y = self.freq[s] * (x >> self.scale)
            y += slot
            y -= self.cum[s]
            low = y < LOW
            live = None if t < whole else (t * LANES + lane)[None, :] < left[:, None]
            if live is not None:
                low &= live
            rank = np.cumsum(low, 1)
            word = np.take(stream, (at[:, None] + rank - 1)[low], mode="clip")
            y[low] = (y[low] << np.uint64(32)) | word
            x = y if live is None else np.where(live, y, x)
            at = at + rank[:, -1]
        return ids


def _alike(lengths: list[int]) -> Iterator[list[int]]:
    """Groups of blocks of similar length whose padded size is bounded (a longer block is a group of its own)."""
    group: list[int] = []
    for k in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        if group and (len(group) + 1) * (lengths[group[0]] + LANES) > BATCH_TOKENS:
            yield group
            group = []
        group.append(k)
    if group:
        yield group


def raw_blocks(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Blocks of ids, not yet coded, in ascending (part, block) order of doc_id; and a row for each part with the counts of its ids."""
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    own = for_python(docs).select(F.col("doc_id").cast("long"), "text").repartitionByRange(order[0]).sortWithinPartitions(*order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end, block = encoder(tokenizer), np.array([end_id], np.uint16), 0
        part, doc_ids, ids, n = None, [], [], 0

        counts = np.zeros(encode.size, np.int64)

        def row() -> pd.DataFrame:
            own = np.concatenate(ids)
            np.add(counts, np.bincount(own, minlength=len(counts)), out=counts)
            return pd.DataFrame({"part": [part], "block": [block], "doc_ids": [doc_ids], "lengths": [[len(x) for x in ids]],
                                 "ids": [own.astype("<u2").tobytes()], "counts": [None]})
        for batch in batches:
            for k in range(0, len(batch), 200):
                some = batch[k:k + 200]
                part = int(some["part"].iloc[0])
                for doc_id, x in zip(some["doc_id"], encode(some["text"].tolist())):
                    doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                    ids.append(np.concatenate([x, end]))
                    n += len(x) + 1
                    if n >= BLOCK_TOKENS:
                        yield row()
                        block, doc_ids, ids, n = block + 1, [], [], 0
        if ids:
            yield row()
        if part is not None:
            yield pd.DataFrame({"part": [part], "block": [-1], "doc_ids": [[]], "lengths": [[]], "ids": [None], "counts": [counts.astype("<i8").tobytes()]})
    return own.withColumn("part", F.spark_partition_id()).mapInPandas(run, RAW)


def frequencies(raw: DataFrame, size: int) -> np.ndarray:
    """Counts of all ids: the sum of the parts' counts."""
    counts = raw.where("block < 0").select("counts").rdd.map(lambda r: np.frombuffer(r.counts, "<i8"))
    return np.zeros(size, np.int64) if counts.isEmpty() else counts.treeReduce(lambda a, b: a + b, depth=3)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode ``docs`` into new files below ``folder``."""
    size = encoder(tokenizer).size
    spark = docs.sparkSession
    raw_blocks(docs, tokenizer, end_id).write.option("compression", "lz4_raw").parquet(f"{folder}/raw")
    raw = spark.read.parquet(f"{folder}/raw")
    freq = scaled(frequencies(raw, size))
    raw = raw.where("block >= 0").drop("counts")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(freq)
        for batch in batches:
            for k in range(0, len(batch), 64):
                some = batch[k:k + 64]
                ids = [np.frombuffer(b, "<u2") for b in some["ids"]]
                coded = coder.encode(ids)
                yield pd.DataFrame({
                    "part": some["part"], "block": some["block"], "doc_ids": some["doc_ids"], "lengths": some["lengths"],
                    "n_tokens": [len(x) for x in ids], "crc32": [zlib.crc32(b) for b in some["ids"]],
                    "checkpoints": [c for c, _ in coded], "words": [w for _, w in coded]}, index=some.index)
    spark.createDataFrame([(s, int(f)) for s, f in enumerate(freq)], "symbol int, frequency int").coalesce(1).write.parquet(f"{folder}/frequencies")
    raw.mapInPandas(run, BLOCK).write.parquet(f"{folder}/blocks")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Decode the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of little-endian uint32 ids)."""
    rows = spark.read.parquet(f"{folder}/frequencies").collect()
    freq = np.zeros(len(rows), np.int64)
    for r in rows:
        freq[r.symbol] = r.frequency
    blocks = spark.read.parquet(f"{folder}/blocks")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(freq)
        for batch in batches:
            for k in range(0, len(batch), 64):
                some = batch[k:k + 64]
                out = []
                decoded = coder.decode(list(zip(some["n_tokens"], some["checkpoints"], some["words"])))
                for part, block, doc_ids, lengths, crc, ids in zip(some["part"], some["block"], some["doc_ids"], some["lengths"], some["crc32"], decoded):
                    if zlib.crc32(ids.astype("<u2").tobytes()) != crc:
                        raise ValueError(f"block {part}/{block} is damaged")
                    wide, at = ids.astype("<u4"), 0
                    for doc_id, n in zip(doc_ids, lengths):
                        out.append((part, block, doc_id, at, n, zlib.crc32(wide[at:at + n].tobytes())))
                        at += n
                yield pd.DataFrame(out, columns=[c.split()[0] for c in DECODED.split(", ")]).astype({"doc_id": "Int64"})
    docs = blocks.mapInPandas(run, DECODED)
    # where each block starts: sums of parts, then of blocks within a part
    sums = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    prior = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.select("part", F.coalesce(F.sum("n").over(prior.orderBy("part")), F.lit(0)).alias("part_start"))
    own = prior.partitionBy("part").orderBy("block")
    starts = blocks.select("part", "block", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)).alias("block_start")).join(parts, "part")
    starts = cut_lineage(starts.select("part", "block", (F.col("part_start") + F.col("block_start")).alias("block_start")))
    return docs.join(small(starts), ["part", "block"]).select(
        "doc_id", (F.col("block_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")

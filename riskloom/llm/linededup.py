"""Line dedup by an exact set-similarity join.

A line counts by its set of words (A-Z lower-cased); lines without a word are left alone. Two lines match if the Jaccard
similarity of their sets is at least ``SIMILARITY``. Lines come in order of doc_id (nulls last) and line number, and a line that
matches any earlier line is removed.

1. Each line gives the hashes of its words (44 bits) and of their set (64 bits). Lines with equal sets form a class; only the class's first line is compared.
2. Word hashes are counted in BUCKETS buckets over all lines, and each set's words are ordered by rarity (bucket count, then
   hash). Any order that all sets share is right, so a bucket shared by two words costs time only.
3. The first n - ceil(t n) + 1 words of a set are its prefix; sets that match share a word of their prefixes. Prefix words meet in
   their task by a shuffle on the word, one row per set, and are compared with the earlier sets there. (Rows travel packed, by parts
   of about PART_ROWS rows that hold whole words; beyond MOST_ROWS rows, where parts would be too large, as rows of Spark's.) Pairs must pass
   the length filter, the positional filter (what is left after the shared word must suffice), the shorter set's word must lie
   within n - ceil(2t / (1 + t) n) + 1, and parity bitmaps of the sets must not differ in more bits than the sets may in words.
4. A set is removed as soon as one earlier match is verified, so of the pairs left each set passes on the first FIRST per prefix
   word, and the pair that shares most prefix words is verified first, the others only if it fails; groups of thousands of
   near copies never make all their pairs. Should all of a set's pairs fail and more be left, these sets are run again with
   all their pairs.
5. Pairs are verified on the words themselves.
6. Where more than BLOCK sets share a prefix word, they are first compared in blocks of BLOCK only (words of very many lines are
   dealt over tasks), which finds a match for most of a group of near copies. The sets without one are compared under two shared
   words: with a prefix that is one word longer, sets that match share two words of it, the first of them in the shorter prefix.
   Where two words still join very many sets, both sides are dealt over cells of bounded size. No task holds a whole group.

Defined cases: null or empty text has no lines; rows equal in doc_id, source and text are treated alike; rows that differ in
the source alone come in order of their row hash; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import byte_batches, cut_lineage, for_python, lower_az, row_hash, small, text_groups
from riskloom.llm.hashing import hashed_words, mix
from riskloom.session import checkpoint_dir, freed_shuffles

SIMILARITY = 0.8
#: A line's number in a run of lines and a word's hash share 64 bits.
HASH_BITS = 44
RUN_LINES = 1 << (64 - HASH_BITS)
BUCKET_BITS = 20
FIRST = 4
#: Sets of one prefix word that are compared with each other at a time, and lines of a word from which its rows are dealt over tasks.
BLOCK = 1_024
DEAL_BITS = 17
#: Up to EXACT lines a word's rarity is their number, beyond it grows with the logarithm.
EXACT = 1 << 19
ALL = 1 << 62
WORD_MASK = (1 << HASH_BITS) - 1
PAIRS = 1_000_000
LAST_DOC = (1 << 63) - 1
#: Up to so many words are sent to the tasks that pick their rows; the driver holds them.
FEW_WORDS = 1 << 17
#: Rows of sorted postings that a task compares at a time (whole blocks; a block may go on beyond them).
COMPARE_ROWS = 1 << 16
#: Rows of postings of a part that a task holds, on average; most parts; rows that a task packs at once. Beyond MOST_ROWS, rows go unpacked.
PART_ROWS, MOST_PARTS, PACK_ROWS = 1 << 17, 1 << 13, 1 << 18
MOST_ROWS = 8 * MOST_PARTS * PART_ROWS
#: Largest table with an array a row that is broadcast: bytes, 48 for a row and 24 for an item.
FLAG_BYTES = 1 << 26

LINES = "doc_key long, row_hash long, line int, set long, size int, counts binary"
#: ``token``: a word's rarity (20 bits) and part of its hash (24); above them one more than the number of its deal, if it is dealt.
POSTING = "token long, set long, doc_key long, line int, size int, at int, b0 long, b1 long"
EPS = 1e-9


def _sorted_by_line(line: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``values`` (HASH_BITS bits) of ascending lines from 0, sorted with the line above them: for each run of RUN_LINES lines its
    first line and the sorted numbers, lines counted from there."""
    for lo in range(0, int(line[-1]) + 1 if len(line) else 0, RUN_LINES):
        a, z = np.searchsorted(line, (lo, lo + RUN_LINES))
        yield lo, np.sort(((line[a:z].astype(np.int64) - lo).astype(np.uint64) << np.uint64(HASH_BITS)) | values[a:z])


def line_sets(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """For the lines with words of ``texts``: index of the text, line number, set size, start in the word hashes, set hash; and
    the word hashes (44 bits, ascending) of all sets, line by line."""
    h, line, first = hashed_words(texts)
    fresh = np.diff(line, prepend=-1) > 0
    lines, of_line = line[fresh], np.cumsum(fresh) - 1
    words, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo, both in _sorted_by_line(of_line, h >> np.uint64(64 - HASH_BITS)):
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
        words.append(both & np.uint64((1 << HASH_BITS) - 1))
        owners.append((both >> np.uint64(HASH_BITS)).astype(np.int64) + lo)
    words, of_line = np.concatenate(words), np.concatenate(owners)
    size = np.bincount(of_line, minlength=len(lines))
    start = np.cumsum(size) - size
    owner = np.searchsorted(first, lines, "right") - 1
    sets = np.add.reduceat(mix(words), start) if len(lines) else np.zeros(0, np.uint64)
    return owner, lines - first[owner], size, start, sets, words


def _texts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for group in text_groups(part["text"].tolist()):
            yield part[group]


def rarity(lines: np.ndarray) -> np.ndarray:
    """20 bits that grow with a word's number of lines."""
    return np.where(lines <= EXACT, lines, EXACT + 8192 * (np.log2(np.maximum(lines, 1).astype(float)) - 19)).astype(np.uint32)


def deals(code: np.ndarray) -> np.ndarray:
    """Number of parts that the rows of a word of this rarity are dealt into."""
    lines = np.where(code <= EXACT, code.astype(float), np.exp2((code.astype(float) - EXACT) / 8192 + 19))
    return np.clip(lines / (1 << DEAL_BITS), 1, EXACT - 2).astype(np.int64)


def lines_table(docs: DataFrame, folder: str) -> tuple[DataFrame, np.ndarray]:
    """All lines with words (doc_key, row_hash, line, set, size), written once; and the counts of word-hash buckets."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << BUCKET_BITS, np.uint32)
        for some in _texts(parts):
            owner, number, size, _, sets, h = line_sets(some["text"].tolist())
            np.add.at(total, h >> np.uint64(HASH_BITS - BUCKET_BITS), np.uint32(1))
            yield pd.DataFrame({"doc_key": some["doc_key"].to_numpy()[owner], "row_hash": some["row_hash"].to_numpy()[owner], "line": number,
                                "set": sets.view(np.int64), "size": size, "counts": None})
        yield pd.DataFrame({"doc_key": [0], "row_hash": [0], "line": [-1], "set": [0], "size": [0], "counts": [total.tobytes()]})
    docs.mapInPandas(run, LINES).write.option("compression", "zstd").parquet(f"{folder}/lines")
    table = docs.sparkSession.read.parquet(f"{folder}/lines")
    blobs = table.where("line < 0").select("counts").rdd.map(lambda r: np.frombuffer(r.counts, np.uint32).astype(np.uint64))
    counts = blobs.treeReduce(lambda a, b: a + b, depth=3) if not blobs.isEmpty() else np.zeros(1 << BUCKET_BITS, np.uint64)
    return table.where("line >= 0").drop("counts"), rarity(counts)


def small_lists(df: DataFrame, column: str) -> DataFrame:
    """Hint a broadcast of a materialised table where its rows and the items of its arrays take FLAG_BYTES at most."""
    size = df.agg(F.sum(F.size(column) * F.lit(24) + F.lit(48))).first()[0] or 0
    return F.broadcast(df) if size <= FLAG_BYTES else df


def prefix_length(n: np.ndarray, t: float) -> np.ndarray:
    return n - np.ceil(t * n - EPS).astype(np.int64) + 1


def _ordered(texts: list[str | None], counts: np.ndarray) -> dict[str, np.ndarray]:
    """The lines of ``texts`` with their sets: index of the text, line number, size, start, set, bitmaps; ``token``: their words by rarity."""
    owner, number, size, start, sets, h = line_sets(texts)
    line = np.repeat(np.arange(len(sets)), size)
    rare = counts[h >> np.uint64(HASH_BITS - BUCKET_BITS)].astype(np.uint64)
    # line, rarity, part of the hash: sorting the values themselves orders the words of each line
    order = [x for _, x in _sorted_by_line(line, (rare << np.uint64(24)) | (h & np.uint64(0xFFFFFF)))]
    bit = np.uint64(1) << ((h >> np.uint64(24)) & np.uint64(63))
    high = (h >> np.uint64(30)) & np.uint64(1) == 1
    b0, b1 = (np.bitwise_xor.reduceat(np.where(on, bit, np.uint64(0)), start) if len(sets) else np.zeros(0, np.uint64) for on in (~high, high))
    token = np.concatenate(order) & np.uint64(WORD_MASK) if order else np.zeros(0, np.uint64)
    return {"owner": owner, "number": number, "size": size, "start": start, "set": sets, "b0": b0, "b1": b1, "token": token}


def postings(docs: DataFrame, counts: np.ndarray, t: float, only: np.ndarray | None = None) -> DataFrame:
    """A row per prefix word of each set: word, set, first line, size, place in the set, bitmap.

    A word whose bucket holds one line alone matches nothing and is left out. Sets that a task has seen before are too, if
    they come again later in order. With ``only`` (ascending), rows of these words alone.
    """
    return docs.mapInPandas(_posted(counts, t, only), POSTING)


def _posted(counts: np.ndarray, t: float, only: np.ndarray | None = None):
    parts_of = deals(np.arange(1 << 20))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, tuple[int, int]] = {}
        for some in _texts(parts):
            x = _ordered(some["text"].tolist(), counts)
            sets, size = x["set"], x["size"]
            if not len(sets):
                continue
            key = some["doc_key"].to_numpy()[x["owner"]]
            if len(seen) > 2_000_000:
                seen.clear()
            fresh = np.zeros(len(sets), bool)
            for k, at in enumerate(zip(sets.tolist(), key.tolist(), x["number"].tolist())):
                old = seen.get(at[0])
                if old is None or at[1:] < old:
                    seen[at[0]] = at[1:]
                    fresh[k] = True
            at = np.arange(len(x["token"])) - np.repeat(x["start"], size)
            pick = np.flatnonzero((at < np.repeat(prefix_length(size, t), size)) & (x["token"] >> np.uint64(24) > 1) & np.repeat(fresh, size))
            own, token = np.repeat(np.arange(len(sets)), size)[pick], x["token"][pick].astype(np.int64)
            dealt = parts_of[token >> 24]
            token |= np.where(dealt > 1, 1 + (sets[own] % dealt.astype(np.uint64)).astype(np.int64), 0) << HASH_BITS
            if only is not None:
                here = np.searchsorted(only, token, "right") > np.searchsorted(only, token)
                own, token, pick = own[here], token[here], pick[here]
            yield pd.DataFrame({"token": token, "set": sets.view(np.int64)[own], "doc_key": key[own], "line": x["number"][own],
                                "size": size[own], "at": at[pick], "b0": x["b0"].view(np.int64)[own], "b1": x["b1"].view(np.int64)[own]})
    return run


def n_parts(rows: int) -> int:
    """Parts (a power of two) that this number of postings is packed into."""
    return min(MOST_PARTS, 1 << max(0, (rows - 1) // PART_ROWS).bit_length())


def _packed(rows: dict[str, np.ndarray], parts: int) -> Iterator[tuple[int, int, bytes]]:
    """Part, number of rows and packed rows. A part's words share the low bits of their hash, and lines stay in order, so that what differs
    little between rows takes little."""
    token = rows["token"]
    part = (token + (token >> HASH_BITS) * 0x9E3779B1) & (parts - 1)   # a dealt word's rows go to many parts
    order = np.argsort(part, kind="stable")
    rows = {c: v[order] for c, v in rows.items()}
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    for k in np.flatnonzero(np.diff(ends)):
        own = {c: v[ends[k]:ends[k + 1]] for c, v in rows.items()}
        doc = np.diff(own["doc_key"].view(np.uint64), prepend=np.uint64(0))
        columns = [own["token"].astype("<u8"), doc.astype("<u8"), *(own[c].astype("<i4") for c in ("line", "size", "at")),
                   own["set"].astype("<i8"), own["b0"].astype("<i8"), own["b1"].astype("<i8")]
        planes = b"".join(v.view(np.uint8).reshape(len(v), -1).T.tobytes() for v in columns)
        yield int(k), len(doc), pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def _unpacked(n: int, packed: bytes) -> dict[str, np.ndarray]:
    planes, at, out = np.frombuffer(pa.Codec("zstd").decompress(packed, 52 * n), np.uint8), 0, {}
    for c, kind in (("token", "<i8"), ("doc_key", "<u8"), ("line", "<i4"), ("size", "<i4"), ("at", "<i4"), ("set", "<i8"), ("b0", "<i8"), ("b1", "<i8")):
        width = int(kind[-1])
        out[c] = np.ascontiguousarray(planes[at:at + n * width].reshape(width, n).T).view(kind).ravel()
        at += n * width
    return out | {"doc_key": np.cumsum(out["doc_key"]).view(np.int64)}


def packed_postings(docs: DataFrame, counts: np.ndarray, t: float, parts: int) -> DataFrame:
    """The rows of ``postings`` by parts, all rows of a word (and deal) in one: part, n, and the n rows, packed. They take half the bytes
    of rows of Spark's and are sorted in numpy."""
    posted = _posted(counts, t)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for some in posted(batches):
            held.append({c: some[c].to_numpy() for c in some})
            n += len(some)
            if n >= PACK_ROWS:
                yield pd.DataFrame(_packed(_arrays(held), parts), columns=["part", "n", "packed"])
                held, n = [], 0
        if n:
            yield pd.DataFrame(_packed(_arrays(held), parts), columns=["part", "n", "packed"])
    return docs.mapInPandas(run, "part int, n int, packed binary")


def _of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The postings of each part, sorted by word, set and line; rows come by part."""
    held, part = [], None
    for b in batches:
        for k, n, packed in zip(*(b.column(c).to_pylist() for c in ("part", "n", "packed"))):
            if k != part and held:
                yield _by_word(_arrays(held))
                held = []
            part = k
            held.append(_unpacked(n, packed))
    if held:
        yield _by_word(_arrays(held))


def _by_word(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    token, sets = rows["token"], rows["set"]
    order = np.lexsort((sets, token))
    same = (token[order][1:] == token[order][:-1]) & (sets[order][1:] == sets[order][:-1])
    more = np.flatnonzero(np.append(same, False) | np.append(False, same))   # sets of several lines: the earliest first
    own = order[more]
    order[more] = own[np.lexsort((rows["line"][own], rows["doc_key"][own], sets[own], token[own]))]
    return {c: v[order] for c, v in rows.items()}


def _earlier(t: float, first: int, block: int):
    """Compares the rows of each word with the earlier ones, in blocks of ``block`` sets; rows come sorted by word, set and line.

    Gives pairs (kind 0, or 1 where x has more than ``first`` under this word) and, for words of several blocks, (set, word) as kind 2.
    """
    def compare(rows: dict[str, np.ndarray], begin: np.ndarray, hot: np.ndarray) -> Iterator[pd.DataFrame]:
        if hot.any():
            yield pd.DataFrame({"x": rows["set"][hot], "y": rows["token"][hot], "kind": np.int8(2)})
        order = np.lexsort((rows["set"], rows["line"], rows["doc_key"], begin))
        rows = {k: v[order] for k, v in rows.items()}
        before = np.arange(len(order)) - begin
        size, at = rows["size"].astype(np.int64), rows["at"].astype(np.int64)
        b0, b1 = rows["b0"].view(np.uint64), rows["b1"].view(np.uint64)  # numpy counts the bits of a signed number's magnitude
        index_prefix = prefix_length(size, 2 * t / (1 + t))
        asked = before > 0 if "asked" not in rows else (before > 0) & rows["asked"].astype(bool)
        todo = np.flatnonzero(asked)
        ends = np.cumsum(before[todo])
        lo = 0
        while lo < len(todo):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS)))
            x = np.repeat(todo[lo:hi], before[todo[lo:hi]])
            y = np.arange(len(x)) - np.repeat(np.cumsum(before[todo[lo:hi]]) - before[todo[lo:hi]], before[todo[lo:hi]]) + begin[x]
            m, n = size[x], size[y]
            ok = np.minimum(m, n) >= t * np.maximum(m, n) - EPS
            x, y, m, n = x[ok], y[ok], m[ok], n[ok]
            need = np.ceil(t / (1 + t) * (m + n) - EPS)
            ok = np.minimum(m - at[x], n - at[y]) >= need
            ok &= np.where(m < n, at[x] < index_prefix[x], at[y] < index_prefix[y]) | (m == n)
            ok &= np.bitwise_count(b0[x] ^ b0[y]).astype(np.int64) + np.bitwise_count(b1[x] ^ b1[y]) <= m + n - 2 * need
            x, y = x[ok], y[ok]
            nth = np.arange(len(x)) - np.searchsorted(x, x)
            more = np.searchsorted(x, x, "right") - np.searchsorted(x, x) > first
            ok = nth < first
            yield pd.DataFrame({"x": rows["set"][x[ok]], "y": rows["set"][y[ok]], "kind": more[ok].astype(np.int8)})
            lo = hi

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict[str, np.ndarray]] = []
        going = -1  # the word that the block before belonged to
        for rows in _gathered(parts):
            rows = _arrays([*held, rows])
            # one row per (word, set): the earliest line
            keep = np.ones(len(rows["token"]), bool)
            keep[1:] = (rows["token"][1:] != rows["token"][:-1]) | (rows["set"][1:] != rows["set"][:-1])
            rows = {k: v[keep] for k, v in rows.items()}
            begin, hot = _blocks(rows["token"], block, going)
            cut = int(begin[-1])  # the last block may go on in the next batch
            if cut:
                yield from compare({k: v[:cut] for k, v in rows.items()}, begin[:cut], hot[:cut])
                going = int(rows["token"][cut - 1])
            held = [{k: v[cut:] for k, v in rows.items()}]
        if held:
            begin, hot = _blocks(held[0]["token"], block, going)
            yield from compare(held[0], begin, hot)
    return run


def _blocks(token: np.ndarray, block: int, going: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted words: where the block of each row begins, and whether its word has other blocks."""
    begin = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    length = np.diff(np.append(begin, len(token)))
    hot = (np.repeat(length > block, length) | (token == going) | (token >> HASH_BITS > 0)) & (block < ALL)
    begin = np.repeat(begin, length)
    return begin + (np.arange(len(token)) - begin) // block * block, hot


def _arrays(parts: list) -> dict[str, np.ndarray]:
    return {c: np.concatenate([np.asarray(p[c]) for p in parts]) for c in parts[-1]}


def _gathered(parts: Iterator) -> Iterator[dict[str, np.ndarray]]:
    """Columns of tables that come one after the other, in runs of COMPARE_ROWS rows or a little more."""
    some, n = [], 0
    for part in parts:
        some.append(part)
        n += len(part["token"])
        if n >= COMPARE_ROWS:
            yield _arrays(some)
            some, n = [], 0
    if n:
        yield _arrays(some)


def candidates(posts: DataFrame, t: float, first: int, block: int) -> DataFrame:
    """(x, y, hot, words, more): y an earlier set that x may match, under so many prefix words; ``more`` if x has others under one of
    them that are not passed on. Where ``hot``, x is a set of the word y, of which it has met one block only. ``posts``: postings, or
    packed ones."""
    earlier = _earlier(t, first, block)
    if "packed" in posts.columns:
        posts, parts = byte_batches(posts.repartition("part").sortWithinPartitions("part")), _of_parts
    else:
        cols = ["token", "set", *([F.desc("asked")] if "asked" in posts.columns else []), "doc_key", "line"]
        posts = posts.repartition("token").sortWithinPartitions(*cols)
        parts = lambda batches: ({c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names} for b in batches)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in earlier(parts(batches)):
            yield pa.RecordBatch.from_pydict({c: out[c].to_numpy() for c in ("x", "y", "kind")})
    rows = posts.mapInArrow(run, "x long, y long, kind byte")
    return rows.groupBy("x", "y", (F.col("kind") == 2).alias("hot")).agg(F.count(F.lit(1)).alias("words"), (F.max("kind") == 1).alias("more"))


def two_words(docs: DataFrame, hot: DataFrame, firsts: DataFrame, counts: np.ndarray, t: float) -> DataFrame:
    """Postings of the sets in ``hot`` (set, token) under pairs of words: a hot word and each that follows it in the prefix that is one
    word longer."""
    where = hot.select("set", F.col("token").bitwiseAND(F.lit(WORD_MASK)).alias("word")).distinct().join(firsts, "set")
    where = cut_lineage(where.groupBy("row_hash").agg(F.collect_list(F.struct("line", "word")).alias("asked")).withColumnRenamed("row_hash", "w_hash"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in _texts(parts):
            x = _ordered(some["text"].tolist(), counts)
            place = {at: k for k, at in enumerate(zip(x["owner"].tolist(), x["number"].tolist()))}
            asked = [(place[k, r["line"]], r["word"]) for k, rows in enumerate(some["asked"]) for r in rows]
            line, word = np.array([a[0] for a in asked], np.int64), np.array([a[1] for a in asked], np.uint64)
            size = x["size"][line]
            width = np.minimum(prefix_length(size, t) + 1, size)
            each = np.repeat(np.arange(len(line)), width)
            at = np.arange(len(each)) - np.repeat(np.cumsum(width) - width, width)
            second = x["token"][x["start"][line][each] + at]
            here = np.full(len(line), 1 << 40)
            np.minimum.at(here, each[second == word[each]], at[second == word[each]])
            pick = np.flatnonzero((at > here[each]) & (second >> np.uint64(24) > 1))
            each, second = each[pick], second[pick]
            own = line[each]
            yield pd.DataFrame({"token": mix(mix(word[each]) + second).view(np.int64), "set": x["set"].view(np.int64)[own],
                                "doc_key": some["doc_key"].to_numpy()[x["owner"][own]], "line": x["number"][own], "size": x["size"][own],
                                "at": here[each], "b0": x["b0"].view(np.int64)[own], "b1": x["b1"].view(np.int64)[own]})
    texts = docs.join(small_lists(where, "asked"), F.col("row_hash") == F.col("w_hash")).select("doc_key", "text", "asked")
    return texts.mapInPandas(run, POSTING).dropDuplicates(["token", "set"])


def crowded_pairs(docs: DataFrame, hot: DataFrame, gone: DataFrame, firsts: DataFrame, counts: np.ndarray, t: float, block: int) -> DataFrame:
    """(x, y) candidates of the sets in ``hot`` that are not ``gone`` yet, under two words that both sets share."""
    posts = two_words(docs, hot, firsts, counts, t).join(gone.select(F.col("set").alias("g_set")), F.col("set") == F.col("g_set"), "left")
    posts = cut_lineage(posts.withColumn("asked", F.isnull("g_set")).drop("g_set"))
    parts = lambda n: F.ceil(n / F.lit(block)).cast("long")
    wanted = posts.groupBy(F.col("token").alias("k_token")).agg(F.count(F.lit(1)).alias("n"), F.count_if("asked").alias("n_asked"))
    wanted = cut_lineage(wanted.where("n > 1 AND n_asked > 0").select("k_token", parts(F.col("n")).alias("r"), parts(F.col("n_asked")).alias("a")))
    posts = posts.join(small(wanted), F.col("token") == F.col("k_token"))
    # the sets of two words lie in r blocks, those that ask in a blocks; each cell is a block of either
    others = posts.withColumns({"asked": F.lit(False), "r": F.pmod(F.xxhash64("set"), "r"), "a": F.explode(F.sequence(F.lit(0), F.col("a") - 1))})
    asking = posts.where("asked").withColumns({"a": F.pmod(F.xxhash64("set"), "a"), "r": F.explode(F.sequence(F.lit(0), F.col("r") - 1))})
    cells = others.unionByName(asking).withColumn("token", F.xxhash64("token", "r", "a")).drop("k_token", "r", "a")
    return candidates(cells, t, ALL, ALL).select("x", "y")


def verified(docs: DataFrame, pairs: DataFrame, firsts: DataFrame, t: float) -> DataFrame:
    """``pairs`` with ``match``: whether the Jaccard similarity of the two sets of words reaches ``t``."""
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("set")).distinct().join(firsts, "set")
    wanted = wanted.groupBy("row_hash").agg(F.collect_list(F.struct("line", "set")).alias("w"))
    wanted = cut_lineage(wanted.select(F.col("row_hash").alias("w_hash"), F.col("w.line").alias("w_lines"), F.col("w.set").alias("w_sets")))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in _texts(parts):
            sets, words = [], []
            for text, w_lines, w_sets in zip(some["text"], some["w_lines"], some["w_sets"]):
                own = lower_az(text).split(b"\n")
                sets += list(w_sets)
                words += [b" ".join(set(own[n].split())).decode() for n in w_lines]
            yield pd.DataFrame({"set": np.array(sets, np.int64), "words": words})
    texts = docs.join(small_lists(wanted, "w_lines"), F.col("row_hash") == F.col("w_hash")).select("text", "w_lines", "w_sets")
    words = cut_lineage(texts.mapInPandas(run, "set long, words string").dropDuplicates(["set"]))
    both = pairs.join(words.select(F.col("set").alias("x"), F.col("words").alias("xw")), "x")
    both = both.join(words.select(F.col("set").alias("y"), F.col("words").alias("yw")), "y")
    both = both.select("x", "y", F.split("xw", " ").alias("xw"), F.split("yw", " ").alias("yw"))
    common = F.size(F.array_intersect("xw", "yw"))
    return both.select("x", "y", (common >= t * (F.size("xw") + F.size("yw") - common) - EPS).alias("match"))


def removals(docs: DataFrame, lines: DataFrame, counts: np.ndarray, t: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(set, row_hash, line) of each set's first line, and the sets whose first line has an earlier match."""
    if not 0.5 < t <= 1:
        raise ValueError("similarity must be above 0.5 and at most 1")
    firsts = lines.groupBy("set").agg(F.min(F.struct("doc_key", "line", "row_hash")).alias("f"))
    firsts = cut_lineage(firsts.select("set", F.col("f.doc_key").alias("doc_key"), F.col("f.line").alias("line"), F.col("f.row_hash").alias("row_hash")))
    most = lines.agg(F.sum(F.col("size") - F.ceil(F.col("size") * t - EPS) + 1)).first()[0] or 0
    posts = packed_postings(docs, counts, t, n_parts(most)) if most <= MOST_ROWS else postings(docs, counts, t)
    found = cut_lineage(candidates(posts, t, FIRST, BLOCK))
    pairs, hot = found.where("NOT hot"), found.where("hot").select(F.col("x").alias("set"), F.col("y").alias("token"))
    # the pair that shares most prefix words first, a set's other pairs only if that one fails
    best = cut_lineage(pairs.groupBy("x").agg(F.max_by("y", F.struct("words", "y")).alias("y"), F.max("more").alias("more")))
    gone = _matched(docs, best, firsts, t)
    rest = cut_lineage(pairs.join(gone.select(F.col("set").alias("x")), "x", "left_anti").join(best, ["x", "y"], "left_anti"))
    gone = cut_lineage(gone.union(_matched(docs, rest, firsts, t)))
    if not hot.isEmpty():
        gone = cut_lineage(gone.union(_matched(docs, cut_lineage(crowded_pairs(docs, hot, gone, firsts, counts, t, BLOCK)), firsts, t)).distinct())
    again = best.where("more").join(gone.select(F.col("set").alias("x")), "x", "left_anti")
    again = cut_lineage(again.select(F.col("x").alias("a_set"), F.lit(True).alias("asked")))
    if not again.isEmpty():
        texts = docs.join(small(cut_lineage(again.join(firsts, F.col("a_set") == F.col("set")).select(F.col("row_hash").alias("a_hash")).distinct())),
                          F.col("row_hash") == F.col("a_hash")).select(docs.columns)
        words = postings(texts, counts, t).join(small(again), F.col("set") == F.col("a_set")).select(F.col("token").alias("a_token")).distinct()
        words = cut_lineage(words.join(hot.select(F.col("token").alias("a_token")).distinct(), "a_token", "left_anti"))
        # few words' rows are picked where they are made, before they become rows of Spark's
        few = words.limit(FEW_WORDS + 1).toPandas()["a_token"].to_numpy(np.int64)
        asked = postings(docs, counts, t, np.sort(few) if len(few) <= FEW_WORDS else None)
        asked = asked.join(small(words), F.col("token") == F.col("a_token")).drop("a_token")
        asked = asked.join(small(again), F.col("set") == F.col("a_set"), "left").drop("a_set").withColumn("asked", F.coalesce("asked", F.lit(False)))
        gone = cut_lineage(gone.union(_matched(docs, cut_lineage(candidates(asked, t, ALL, ALL)), firsts, t)).distinct())
    return firsts, gone


def _matched(docs: DataFrame, pairs: DataFrame, firsts: DataFrame, t: float) -> DataFrame:
    """(set): the x of the pairs that are verified."""
    return cut_lineage(verified(docs, pairs.select("x", "y"), firsts, t).where("match").select(F.col("x").alias("set")).distinct())


def dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, n_lines (with words), n_removed, n_near (removed that equal no earlier line), text left."""
    folder = f"{checkpoint_dir(docs.sparkSession)}/lines-{uuid4().hex}"
    own = for_python(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_DOC)).alias("doc_key"),
                      row_hash().alias("row_hash"), "text")
    keyed = own.select("doc_key", "row_hash", "text")
    lines, counts = lines_table(keyed, folder)
    with freed_shuffles(docs.sparkSession):
        firsts, gone = removals(keyed, lines, counts, similarity)
    flagged = firsts.join(gone.withColumn("near", F.lit(True)), "set", "left").select(
        F.col("row_hash").alias("f_hash"), F.col("line").alias("f_line"), "near")
    # joined by the line's place, as a common line's set would be a hot key; only documents that lose lines are joined with their texts
    rows = lines.select("row_hash", "line").distinct().join(flagged, (F.col("row_hash") == F.col("f_hash")) & (F.col("line") == F.col("f_line")), "left")
    rows = rows.where("f_hash IS NULL OR near")
    lost = rows.groupBy("row_hash").agg(F.count_if(F.coalesce("near", F.lit(False))).alias("n_near"), F.array_sort(F.collect_list("line")).alias("removed"))
    lost = cut_lineage(lost.withColumnRenamed("row_hash", "s_hash"))
    out = own.join(small_lists(lost, "removed"), F.col("row_hash") == F.col("s_hash"), "left")
    text = F.coalesce("text", F.lit(""))
    n_lines = F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    kept = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.when(~F.array_contains("removed", i), x)), lambda x: x.isNotNull())
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select("doc_id", n_lines.cast("long").alias("n_lines"), zero(F.size("removed")).alias("n_removed"), zero(F.col("n_near")).alias("n_near"),
                      F.when(F.isnull("removed"), text).otherwise(F.array_join(kept, "\n")).alias("text"))

import random
import re

import numpy as np

from riskloom.llm import hashing, linededup
from riskloom.llm.hashing import hashed_words

WORDS = re.compile("[^\x20\x09-\x0d]+")
LOW = {c: c + 32 for c in range(65, 91)}


def brute(rows, t=0.8):
    """Rows equal in id and text count once."""
    seen, out = [], {}
    for doc_id, text, source in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        kept, n, gone, near = [], 0, 0, 0
        for line in (text or "").split("\n"):
            s = frozenset(WORDS.findall(line.translate(LOW)))
            if not s:
                kept.append(line)
                continue
            n += 1
            if s in seen:
                gone += 1
                continue
            match = any(len(s & x) >= t * len(s | x) - 1e-9 for x in seen)
            seen.append(s)
            gone, near = gone + match, near + match
            if not match:
                kept.append(line)
        out[doc_id, text, source] = (doc_id, n, gone, near, "\n".join(kept))
    return sorted((out[r] for r in rows), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def lines(seed, n_docs):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([1, 2, 4, 5, 9, 15, 30]))] for _ in range(40)]
    rows = []
    for k in range(n_docs):
        own = []
        for _ in range(rng.randint(0, 6)):
            words = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocab + ["new" + str(k)])
            own.append(" ".join(w.upper() if rng.random() < 0.1 else w for w in words))
        rows.append((k * 7 % n_docs, "\n".join(own), "s"))
    return rows


def test_against_brute_force(make_docs):
    for seed in (1, 2):
        rows = lines(seed, 150)
        assert got(linededup.dedup(make_docs(rows))) == brute(rows)


def test_second_run_where_first_pairs_fail(make_docs, monkeypatch):
    monkeypatch.setattr(linededup, "FIRST", 1)
    monkeypatch.setattr(linededup, "PAIRS", 7)
    rows = lines(3, 150)
    assert got(linededup.dedup(make_docs(rows))) == brute(rows)


def test_large_group_of_near_copies(make_docs):
    words = [f"v{k}" for k in range(30)]
    rows = [(k, " ".join(words[:k % 30] + [f"x{k}"] + words[k % 30 + 1:]), "s") for k in range(400)]
    assert got(linededup.dedup(make_docs(rows))) == brute(rows)


def test_crowded_words(make_docs, monkeypatch):
    """Words of more sets than a block, dealt words, and cells: the same removals."""
    rows = lines(5, 150)
    monkeypatch.setattr(linededup, "BLOCK", 3)
    assert got(linededup.dedup(make_docs(rows))) == brute(rows)
    monkeypatch.setattr(linededup, "DEAL_BITS", 3)
    monkeypatch.setattr(linededup, "FIRST", 1)
    assert got(linededup.dedup(make_docs(rows))) == brute(rows)


def test_crowded_words_of_a_small_vocabulary(make_docs, monkeypatch):
    monkeypatch.setattr(linededup, "BLOCK", 8)
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(24)]
    rows = [(k, "\n".join(" ".join(rng.sample(vocab, rng.choice([5, 9, 10, 11, 14]))) for _ in range(4)), "s") for k in range(250)]
    assert got(linededup.dedup(make_docs(rows))) == brute(rows)


def test_word_of_200_000_sets_is_linear():
    """One word's rows in one task, none of them alike: time and what a task holds follow the rows, not their square."""
    import time

    import pandas as pd
    rng = np.random.default_rng(1)

    def spent(n):
        sets = np.sort(rng.integers(-1 << 62, 1 << 62, n))
        bits = rng.integers(-1 << 62, 1 << 62, (2, n))
        table = pd.DataFrame({"token": 5 << 24, "set": sets, "doc_key": np.arange(n), "line": 0, "size": 10, "at": 1, "b0": bits[0], "b1": bits[1]})
        begin, out = time.process_time(), 0
        for part in linededup._earlier(0.8, 4, linededup.BLOCK)(table[k:k + 2000] for k in range(0, n, 2000)):
            out += len(part)
        assert out >= n  # each set is reported as one of a crowded word
        return time.process_time() - begin
    few, many = spent(20_000), spent(200_000)
    assert many < 25 * few and many < 120


def test_blocks():
    token = np.array([1, 1, 1, 1, 1, 2, 2, 3])
    begin, hot = linededup._blocks(token, 2, -1)
    assert begin.tolist() == [0, 0, 2, 2, 4, 5, 5, 7] and hot.tolist() == [True] * 5 + [False] * 3
    assert linededup._blocks(token, 9, 1)[1].tolist() == [True] * 5 + [False] * 3
    assert not linededup._blocks(token, linededup.ALL, 1)[1].any()
    code = linededup.rarity(np.array([0, 1, 1 << 19, 1 << 20, 1 << 40], np.uint64))
    assert code[:3].tolist() == [0, 1, 1 << 19] and (np.diff(code.astype(int)) > 0).all() and code[-1] < 1 << 20
    assert linededup.deals(code).tolist() == [1, 1, 4, 8, (1 << 19) - 2]


def test_odd(make_docs, clashing, odd_rows):
    assert got(linededup.dedup(clashing)) == brute(odd_rows)
    assert linededup.dedup(make_docs([])).count() == 0
    none = [(1, None, "a"), (2, " \n ", "b")]
    assert got(linededup.dedup(make_docs(none))) == brute(none)


def test_hashes_follow_words():
    texts = ["One  two\nTHREE\x1cx\n\n é", None, "", " \t", "one two", "\n" + "a" * 5000 + " é"]
    h, line, first = hashed_words(texts)
    words, at = [], []
    for k, t in enumerate(texts):
        for n, x in enumerate((t or "").split("\n")):
            for w in WORDS.findall(x.translate(LOW)):
                words.append(w)
                at.append(first[k] + n)
    assert line.tolist() == at and len(set(h.tolist())) == len(set(words)) and len(first) == len(texts) + 1
    assert all((h[i] == h[j]) == (words[i] == words[j]) for i in range(len(h)) for j in range(len(h)))
    assert not len(hashed_words([])[0]) and np.array_equal(hashed_words([])[2], [0])


def test_text_of_more_lines_than_a_run():
    n = linededup.RUN_LINES + 3
    owner, number, size, start, sets, words = linededup.line_sets(["b a", "\n".join(f"w{k} x" for k in range(n))])
    assert len(sets) == n + 1 == len(np.unique(sets)) and (size == 2).all() and len(words) == 2 * (n + 1)
    assert (number == np.append(0, np.arange(n))).all() and (owner == np.append(0, np.ones(n))).all() and (start == 2 * np.arange(n + 1)).all()
    assert linededup.line_sets([f"w{n - 1} x"])[4][0] == sets[-1] and linededup.line_sets(["w0 x"])[4][0] == sets[1]


def test_runs_of_lines_sort_alike(monkeypatch):
    line = np.repeat(np.arange(9), 3)
    values = np.random.default_rng(2).integers(0, 1 << 40, 27).astype(np.uint64)
    (_, whole), = linededup._sorted_by_line(line, values)
    monkeypatch.setattr(linededup, "RUN_LINES", 4)
    runs = [(lo, x & np.uint64((1 << 44) - 1), (x >> np.uint64(44)).astype(int) + lo) for lo, x in linededup._sorted_by_line(line, values)]
    assert [lo for lo, *_ in runs] == [0, 4, 8]
    assert (np.concatenate([x for _, x, _ in runs]) == whole & np.uint64((1 << 44) - 1)).all() and (np.concatenate([o for *_, o in runs]) == line).all()


def test_postings_of_some_words(make_docs):
    """Rows of given words alone: those that a filter on all rows leaves."""
    from pyspark.sql import functions as F
    docs = make_docs(lines(6, 60)).select(F.col("doc_id").alias("doc_key"), F.col("doc_id").alias("row_hash"), "text")
    counts = np.full(1 << linededup.BUCKET_BITS, 5, np.uint32)
    every = got(linededup.postings(docs, counts, 0.8))
    only = np.array(sorted({r[0] for r in every})[::3])
    for some in (only, only[:0]):
        assert got(linededup.postings(docs, counts, 0.8, some)) == [r for r in every if r[0] in some]


def test_small_batches_are_compared_together(monkeypatch):
    """Pairs don't depend on the batches, and many small ones make few runs."""
    import pandas as pd
    rng = np.random.default_rng(4)
    n = 3000
    table = pd.DataFrame({"token": np.sort(rng.integers(0, 300, n)) << 24, "set": rng.permutation(n), "doc_key": rng.permutation(n), "line": 0, "size": 10,
                          "at": 0, "b0": 0, "b1": 0}).sort_values(["token", "set"], ignore_index=True)
    cut = lambda size: [table[k:k + size] for k in range(0, n, size)]
    assert len(list(linededup._gathered(cut(20)))) == 1
    pairs = lambda size: sorted(map(tuple, pd.concat(linededup._earlier(0.8, 4, linededup.BLOCK)(iter(cut(size)))).to_numpy().tolist()))
    whole = pairs(n)
    monkeypatch.setattr(linededup, "COMPARE_ROWS", 64)
    assert pairs(20) == pairs(500) == whole and len(whole) > n


def test_word_hashes_by_plain_sums():
    """Across the rows of the running sum, at the ends and in words longer than a row."""
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcxyz09") for _ in range(rng.choice([1, 3, 8, 5000]))) for _ in range(60)).encode()
    for raw in (text, b" " + text + b"\n", b"a" * hashing.ROW, b"a" * (hashing.ROW - 1) + b" b", b"", b" \t"):
        h, start, size = hashing.word_spans(np.frombuffer(raw, np.uint8))
        words = [raw[a:a + n] for a, n in zip(start.tolist(), size.tolist())]
        assert words == raw.split()
        sums = [sum((c + 1) * pow(hashing._BASE, k + 1, 1 << 64) for k, c in enumerate(w)) % (1 << 64) for w in words]
        assert (h == hashing.mix(np.array(sums, np.uint64))).all()


def some_postings(seed, n):
    rng = np.random.default_rng(seed)
    deal = np.where(rng.random(n) < 0.3, rng.integers(1, 9, n), 0) << linededup.HASH_BITS
    sets = rng.integers(-1 << 62, 1 << 62, 40)[rng.integers(0, 40, n)]
    bits = rng.integers(-1 << 62, 1 << 62, (2, n))
    doc = np.sort(rng.integers(0, 300, n))
    doc[-3:] = linededup.LAST_DOC, -5, 7
    return {"token": (rng.integers(2, 90, n) << 24 | rng.integers(0, 4, n)) + deal, "set": sets, "doc_key": doc, "line": rng.integers(0, 1 << 20, n).astype(np.int32),
            "size": rng.integers(1, 1 << 17, n).astype(np.int32), "at": rng.integers(0, 90, n).astype(np.int32), "b0": bits[0], "b1": bits[1]}


def test_packed_rows_come_back():
    """All rows, those of a word and deal in one part, sorted; in fewer bytes than a row of Spark's takes in a shuffle (45)."""
    import pyarrow as pa
    rows = some_postings(1, 20_000)
    packed = list(linededup._packed(rows, 4))
    halves = [x for k in range(0, 20_000, 10_000) for x in linededup._packed({c: v[k:k + 10_000] for c, v in rows.items()}, 4)]
    assert len(packed) == 4 and sum(n for _, n, _ in packed) == 20_000 and sum(len(b) for *_, b in packed) < 32 * 20_000
    by_part = sorted(halves, key=lambda x: x[0])
    batches = [pa.RecordBatch.from_pydict(dict(zip(("part", "n", "packed"), zip(*by_part[k:k + 3])))) for k in range(0, len(by_part), 3)]
    parts = list(linededup._of_parts(iter(batches)))
    assert len(parts) == 4 and not any(set(a["token"].tolist()) & set(b["token"].tolist()) for i, a in enumerate(parts) for b in parts[:i])
    for p in parts:
        key = list(zip(p["token"].tolist(), p["set"].tolist(), p["doc_key"].tolist(), p["line"].tolist()))
        same = [a[:2] == b[:2] for a, b in zip(key, key[1:])]
        assert [k[:2] for k in key] == sorted(k[:2] for k in key) and all(a <= b for a, b, s in zip(key, key[1:], same) if s)
    columns = ("token", "set", "doc_key", "line", "size", "at", "b0", "b1")
    back = sorted(zip(*(np.concatenate([p[c] for p in parts]).tolist() for c in columns)))
    assert back == sorted(zip(*(rows[c].tolist() for c in columns)))


def test_number_of_parts():
    n = linededup.PART_ROWS
    assert [linededup.n_parts(k) for k in (0, 1, n, n + 1, 3 * n, 1 << 40)] == [1, 1, 1, 2, 4, linededup.MOST_PARTS]


def test_packed_and_plain_postings_give_the_same(make_docs, monkeypatch):
    rows = lines(9, 150)
    for name, value in (("PART_ROWS", 16), ("PACK_ROWS", 100), ("MOST_ROWS", -1)):
        monkeypatch.setattr(linededup, name, value)
        assert got(linededup.dedup(make_docs(rows))) == brute(rows)


def test_shuffle_files_are_freed(make_docs, spark):
    """The steps of the search are run with shuffle files freed after each; the session's setting is as before."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old, seen = spark.conf.get(key), []
    cut = linededup.cut_lineage
    try:
        linededup.cut_lineage = lambda df: seen.append(spark.conf.get(key)) or cut(df)
        linededup.dedup(make_docs(lines(10, 40))).collect()
    finally:
        linededup.cut_lineage = cut
    assert seen.count("true") > 5 and spark.conf.get(key) == old == "false"

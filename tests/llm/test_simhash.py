import random

import numpy as np
import xxhash

from riskloom.llm import simhash
from riskloom.llm.components import connected_components


def roots(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def brute(rows, max_bits=2):
    fps = {}
    for _, text, _ in rows:
        fps.setdefault(simhash.fingerprint(text), None)
    fps = list(fps)
    root = roots([(a, b) for a in fps for b in fps if bin((a ^ b) & (1 << 64) - 1).count("1") <= max_bits], fps)
    least = {}
    for doc_id, text, _ in rows:
        r = root[simhash.fingerprint(text)]
        least[r] = min(filter(lambda x: x is not None, (least.get(r), doc_id)), default=None)
    return sorted(((d, f"{simhash.fingerprint(t) & (1 << 64) - 1:016x}", least[root[simhash.fingerprint(t)]]) for d, t, _ in rows), key=str)


def got(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_fingerprint_by_definition():
    text = "The cat sat on the cat sat on a mat"
    words = text.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(words[k:k + 3]).encode(), 42) for k in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    assert simhash.fingerprint(text) & (1 << 64) - 1 == want
    assert simhash.fingerprint("a b") & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_golay_code_is_perfect():
    error, _ = simhash.golay()
    words = np.arange(1 << 23)
    nearest = words ^ error[simhash._syndrome(words)]
    assert np.bitwise_count((words ^ nearest).astype(np.uint32)).max() == 3
    assert not simhash._syndrome(nearest).any()


def test_one_bit_apart_shares_a_key():
    words = np.random.default_rng(1).integers(0, 1 << 23, 2000)
    for bit in range(23):
        one, _ = simhash.golay_keys(words)
        _, six = simhash.golay_keys(words ^ (1 << bit))
        assert (six == one[:, None]).any(1).all()


def test_links_against_brute_force(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(150)]
    fps = set(base)
    for f in base:
        for _ in range(4):
            fps.add(f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) * rng.randrange(2))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for bits in (0, 1, 2):
        want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= bits}
        assert {tuple(r) for r in simhash.links(df, bits).collect()} == want


def test_documents(make_docs, odd_rows, clashing):
    text = " ".join(f"t{k}" for k in range(400))
    rows = [(10 + k, text.replace(f"t{k * 7}", "zz"), "s") for k in range(12)] + odd_rows
    assert got(simhash.near_duplicates(make_docs(rows))) == brute(rows)
    assert got(simhash.near_duplicates(clashing)) == brute(odd_rows)
    kept = simhash.keep_first(clashing)
    assert kept.columns == clashing.columns
    want = brute(odd_rows)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in want})
    assert simhash.near_duplicates(make_docs([])).count() == 0


def test_components(spark):
    rng = random.Random(3)
    pairs = [(k, k + 1) for k in range(60)] + [(1000, k) for k in range(1001, 1200)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(160)]
    df = connected_components(spark.createDataFrame(pairs, "a long, b long"))
    want = roots([p for p in pairs], {x for p in pairs if p[0] != p[1] for x in p})
    assert {r.node: r.root for r in df.collect()} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0

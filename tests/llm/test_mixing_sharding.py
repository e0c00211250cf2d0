import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from riskloom.llm import mixing, sharding

WORDS = re.compile("[^\x20\x09-\x0d]+")


def bits(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def brute_targets(sizes):
    """Share by weight, stop at twice the size, reshare what is over until nothing is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left / total * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: left / total * weight[s] for s in open_}
        out |= {s: 2.0 * sizes[s] for s in over}
        left, open_ = left - sum(2 * sizes[s] for s in over), open_ - over
    return out


def brute_mix(rows):
    sizes, own = Counter(), defaultdict(list)
    for doc_id, text, source in rows:
        text = text or ""
        n = len(WORDS.findall(text))
        sizes[source] += n
        symbols = sum(text.count(c) for c in "#*$%&|<>")
        u = (bits(f"{mixing.SEED}:{'' if doc_id is None else doc_id}:{text}") + 0.5) / 2 ** 60
        own[source].append((-math.log(u) / max(0.1, 1 - symbols / max(n, 1)), n, doc_id))
    goal, out = brute_targets(sizes), []
    for source, docs in own.items():
        epochs = math.floor(goal[source] / sizes[source]) if sizes[source] else 0
        run = 0
        for _, n, doc_id in sorted(docs, key=lambda d: d[:2]):
            run += n
            more = n > 0 and run - n / 2 <= goal[source] - epochs * sizes[source]
            out.append((doc_id, n, sizes[source], round(goal[source], 6), (epochs + more) * n))
    return sorted(out, key=str)


def got_mix(df):
    return sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect()), key=str)


@pytest.fixture()
def many():
    return [(k, " ".join(["w"] * (k * k % 23 + 1)) + " #" * (k % 3), f"s{k % 7 if k % 2 else 0}") for k in range(700)]


def test_mix_against_brute_force(make_docs, many, odd_rows, clashing, monkeypatch):
    monkeypatch.setattr(mixing, "SORT_ROWS", 5)  # slices are cut again and again
    monkeypatch.setattr(mixing, "SLICES", 8)
    assert got_mix(mixing.mix(make_docs(many))) == brute_mix(many)
    assert got_mix(mixing.mix(clashing)) == brute_mix(odd_rows)


def test_mix_takes_what_it_says(make_docs, many, odd_rows, clashing):
    df = make_docs(many)
    plan = {r.doc_id: r.times for r in mixing.mix(df).collect()}
    assert Counter(r.doc_id for r in mixing.mixed(df).collect()) == Counter({k: v for k, v in plan.items() if v})
    out = mixing.mixed(clashing)
    assert out.columns == clashing.columns
    times = Counter()
    for r in mixing.mix(clashing).collect():
        times[r.doc_id] += r.times
    assert Counter(r.doc_id for r in out.collect()) == +times


def test_mix_empty(make_docs):
    assert mixing.mix(make_docs([])).count() == 0
    assert mixing.mixed(make_docs([(1, None, None), (2, " ", "a")])).count() == 0


def brute_shards(rows, limit):
    own = [(doc_id, len((t or "").encode()), bits(f"{'' if doc_id is None else doc_id}:{t or ''}")) for doc_id, t, _ in rows]
    out = []
    for doc_id, n, h in own:
        for depth in range(61):
            mates = [b for _, b, x in own if x >> 60 - depth == h >> 60 - depth]
            if sum(mates) <= limit or len(mates) == 1 or depth == 60:
                out.append((doc_id, n, f"{h >> 60 - depth:0{depth}b}" if depth else "", depth, sum(mates), len(mates), sum(mates) > limit))
                break
    return sorted(out, key=str)


def test_shards_against_brute_force(make_docs, many, odd_rows, clashing):
    for rows, df, limit in ((many, make_docs(many), 300), (many, make_docs(many), 10 ** 6), (odd_rows, clashing, 200), (odd_rows, clashing, 40)):
        assert sorted((tuple(r) for r in sharding.shards(df, limit).collect()), key=str) == brute_shards(rows, limit)


def test_sharded_keeps_every_row(clashing, make_docs):
    out = sharding.sharded(clashing, 40)
    assert out.columns == [*clashing.columns, "shard_info"]
    assert out.count() == clashing.count()
    assert sharding.sharded(make_docs([])).count() == 0 and sharding.shards(make_docs([])).count() == 0

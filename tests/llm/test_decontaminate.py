import random

from riskloom.llm import decontaminate as dc


def corpus(seed=4, n_items=20, n_docs=240):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("a", "ema", "iro", "onu", "uki", "alos", "etra")]
    word = lambda: vocab[min(int(rng.expovariate(0.06)), len(vocab) - 1)]
    items = [(k, ". ".join(" ".join(word() for _ in range(rng.randint(8, 14))) for _ in range(2)) + f" answer{k} is {word()}{k}.") for k in range(n_items)]
    docs = [" ".join(word() for _ in range(rng.randint(5, 300))) for _ in range(n_docs)]
    return rng, items, docs, word


def pairs(df):
    return {(r.doc_id, r.item_id) for r in df.collect()}


def test_planted_leaks(spark, make_docs):
    rng, items, docs, word = corpus()
    rows, want = [(1000 + k, t, "s") for k, t in enumerate(docs)], set()
    for k, (item, text) in enumerate(items):
        words = text.split()
        for kind in range(3):
            own = list(words)
            if kind == 1:  # paraphrase: every eighth word replaced, others inserted
                own = [word() + "x" if j % 8 == 3 else w for j, w in enumerate(own)]
                own.insert(5, "rather")
            host = docs[k * 3 + kind].split()
            at = rng.randrange(len(host) + 1)
            text2 = " ".join(host[:at] + own + host[at:])
            rows.append((k * 10 + kind, text2.upper() if kind == 2 else text2, "s"))
            want.add((k * 10 + kind, item))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = dc.leaks(make_docs(rows), bench)
    assert pairs(found) == want
    spans = {(r.doc_id, r.item_id): (r.first_word, r.last_word) for r in found.collect()}
    by_id = dict((r[0], r[1]) for r in rows)
    for (d, i), (a, b) in spans.items():
        if d % 10 == 0:
            assert dc.fold(" ".join(x.decode() for x in dc.fold(by_id[d])[a:b + 1])) == dc.fold(dict(items)[i])
    left = dc.drop_leaking(make_docs(rows), bench)
    assert {r.doc_id for r in left.collect()} == {r[0] for r in rows} - {d for d, _ in want}


def test_shared_by_a_third(spark, make_docs):
    """A passage that a third of all documents hold makes its words common; it must be found all the same."""
    _, items, docs, _ = corpus(5)
    rows = [(k, t + ("\n" + items[0][1] if k % 3 == 0 else ""), "s") for k, t in enumerate(docs)]
    assert pairs(dc.leaks(make_docs(rows), spark.createDataFrame(items, "item_id long, text string"))) == {(k, 0) for k in range(0, len(docs), 3)}


def test_paraphrase_shared_by_a_third(spark, make_docs):
    """A third of all documents hold a paraphrase in which the item's eight rarest words are replaced."""
    _, items, docs, _ = corpus(8, n_docs=900)
    rng = random.Random(9)
    usual, rare = [f"usual{k}" for k in range(120)], [f"rare{k}" for k in range(8)]
    words = rng.sample(usual, 30)
    for k, w in enumerate(rare):
        words.insert(4 * k + 2, w)
    items[0] = (0, " ".join(words))
    passage = " ".join("another" if w in rare else w for w in words)
    rows = []
    for k, text in enumerate(docs):
        own = [rng.choice(usual) for _ in range(2)] + ([rare[k]] if k < 8 else [])
        rows.append((k, f"{text} {' then '.join(own)}" + ("\n" + passage if k % 3 == 0 else ""), "s"))
    found = dc.leaks(make_docs(rows), spark.createDataFrame(items, "item_id long, text string"))
    assert pairs(found) == {(k, 0) for k in range(0, len(docs), 3)}


def test_contexts_are_counted():
    import numpy as np
    rng = np.random.default_rng(1)
    same = [np.array([5, 1, 2, 3, 6])] * 4000
    term, register, rank = dc._contexts(same + [np.array([a, b, 4, c, d]) for a, b, c, d in rng.integers(7, 1000, (4000, 4))])
    seen = np.zeros((1000, dc.REGISTERS), np.uint8)
    np.maximum.at(seen, (term, register), rank)
    n = dc._distinct(seen)
    assert round(n[2]) == 1 and 3000 < n[4] < 5000


def test_odd(spark, make_docs, clashing, odd_rows):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "too short here"), (None, "One two. Three four five six seven"), (5, odd_rows[2][1][:20_000])], "item_id long, text string")
    assert pairs(dc.leaks(clashing, bench)) == {(3, 5), (8, 5)}
    assert dc.drop_leaking(clashing, bench).columns == clashing.columns
    none = bench.where("false")
    assert dc.leaks(clashing, none).count() == 0 and dc.leaks(make_docs([]), bench).count() == 0
    assert dc.drop_leaking(clashing, none).count() == clashing.count()


def test_blocks_of_items(spark, make_docs, monkeypatch):
    monkeypatch.setattr(dc, "ITEM_BLOCK", 7)
    _, items, docs, _ = corpus(6)
    rows = [(k, docs[k] + " " + items[k][1], "s") for k in range(len(items))]
    assert pairs(dc.leaks(make_docs(rows), spark.createDataFrame(items, "item_id long, text string"))) == {(k, k) for k in range(len(items))}


def test_subsequence():
    import numpy as np
    item, ids = np.array([1, 2, 3, 4, 2]), np.array([9, 1, 7, 2, 2, 4, 8, 2, 1])
    assert dc.leak(item, item[-2:], np.arange(len(ids)) * 10, ids) == (4, 1.0, 10, 70)
    assert dc.leak(item, item[-2:], np.arange(2), np.array([8, 9])) is None


def test_short_items_word_for_word(spark, make_docs):
    bench = spark.createDataFrame([(1, "Is it really so?"), (2, "one two three four five"), (3, "so"), (4, "one two three four five"), (None, "it is so")], "item_id long, text string")
    rows = [(1, "well, IS it -- really so! one two three five four", "s"), (2, "one two three four, five one two three four five", "s"), (3, "is it really not so one two x three four five", "s"),
            (4, None, "s"), (5, "It is so.", "s")]
    found = dc.leaks(make_docs(rows), bench)
    assert sorted(((r.doc_id, r.item_id, r.first_word, r.last_word) for r in found.collect()), key=str) == [(1, 1, 1, 4), (2, 2, 0, 4), (2, 4, 0, 4), (5, None, 0, 2)]
    assert {r.doc_id for r in dc.drop_leaking(make_docs(rows), bench).collect()} == {3, 4}


def test_replaced_words_against_all_pairs(spark, make_docs):
    """Items with 15, 25 and 35 per cent of their words replaced (the answer kept) in documents of their own: found are
    exactly the pairs that the checks pass when they are put to every document and item, without any retrieval."""
    rng, items, docs, _ = corpus(11)
    rows = [(k, t, "s") for k, t in enumerate(docs)]
    for share in (15, 25, 35):
        for item_id, text in items:
            words = text.split()
            answer = len(text.split(". ")[-1].split())   # the last sentence stays
            for at in rng.sample(range(len(words) - answer), min(len(words) - answer, len(words) * share // 100)):
                words[at] = f"other{rng.randrange(10**6)}"
            rows.append((1000 + share * 100 + item_id, f"{docs[item_id]} {' '.join(words)} {docs[item_id + 1]}", "s"))
    import numpy as np
    block = dc.Items(items)
    want = set()
    for doc_id, text, _ in rows:
        words = dc.fold(text)
        at = [(k, block.vocab[w]) for k, w in enumerate(words) if w in block.vocab]
        import numpy as np
        pos, ids = np.array([a for a, _ in at], np.int32), np.array([b for _, b in at], np.int32)
        for item_id, own, answer in zip(block.item_ids, block.words, block.answers):
            if len(pos) and dc.proof(own, answer, pos, ids):
                want.add((doc_id, item_id))
    assert pairs(dc.leaks(make_docs(rows), spark.createDataFrame(items, "item_id long, text string"))) == want
    assert len(want) >= 0.9 * 3 * len(items)

import zlib
from uuid import uuid4

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from riskloom.llm import rans, subwords
from riskloom.session import checkpoint_dir

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def brute(rows):
    """By ascending id, nulls last, equal ids by text."""
    out, start = [], 0
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] is not None, r[1] or ""))):
        own = [*ids(text), 2]
        out.append((doc_id, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    return sorted(out, key=str)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 3000), max_size=12), st.integers(0, 5))
def test_round_trip(sizes, seed):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 50, 300) ** 3
    coder = rans.Coder(rans.scaled(counts))
    blocks = [rng.choice(300, n, p=(counts + 1) / (counts + 1).sum()).astype(np.uint16) for n in [*sizes, 20_000 * (seed % 2)]]
    coded = coder.encode(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, coder.decode([(len(b), *c) for b, c in zip(blocks, coded)])))


def test_each_checkpoint_decodes_alone():
    rng = np.random.default_rng(1)
    coder = rans.Coder(rans.scaled(np.ones(500, int)))
    block = rng.integers(0, 500, 30_000).astype(np.uint16)
    (marks, words), step = coder.encode([block])[0], 8 * (rans.LANES + 1)
    for k in range(len(marks) // step):
        at = k * rans.CHECKPOINT * rans.LANES
        n = min(len(block) - at, rans.CHECKPOINT * rans.LANES)
        assert np.array_equal(coder.decode([(n, marks[k * step:(k + 1) * step], words)])[0], block[at:at + n])


def test_near_entropy():
    p = 1 / np.arange(1, 1001)
    block = np.random.default_rng(2).choice(1000, 200_000, p=p / p.sum()).astype(np.uint16)
    counts = np.bincount(block, minlength=49_408)
    q = counts[counts > 0] / counts.sum()
    marks, words = rans.Coder(rans.scaled(counts)).encode([block])[0]
    assert len(words) * 8 / len(block) < 1.02 * -(q * np.log2(q)).sum() + 0.1
    assert len(marks) < 0.05 * len(words)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from(" \t\n\x0b\x1c\x85 'sΣİé<|endoftext|>"), max_size=40), max_size=5))
def test_words_give_the_texts_ids(texts):
    texts += ["<|endoftext|> a<|startoftext|>b it's ΑΣ é ́x"]
    assert [x.tolist() for x in subwords.encoder(PATH)(texts)] == [ids(t) for t in texts]


def test_files(spark, make_docs, odd_rows, clashing, monkeypatch):
    monkeypatch.setattr(rans, "BLOCK_TOKENS", 500)
    rows = odd_rows + [(1000 - k, f"text number {k} " * (k % 40), "s") for k in range(120)]
    for df, want in ((make_docs(rows), rows), (clashing, odd_rows), (make_docs([]), [])):
        folder = f"{checkpoint_dir(spark)}/test-{uuid4().hex}"
        rans.write(df, folder, PATH)
        got = rans.read(spark, folder)
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(want)


def test_damage_is_seen(spark, make_docs):
    from pyspark.sql import functions as F
    folder = f"{checkpoint_dir(spark)}/test-{uuid4().hex}"
    rans.write(make_docs([(k, "some words of text " * 50, "s") for k in range(20)]), folder, PATH)
    blocks = spark.read.parquet(f"{folder}/blocks")
    flip = F.expr("concat(substring(words, 1, 100), x'ff00ff', substring(words, 104))")
    blocks.withColumn("words", flip).write.parquet(f"{folder}-2/blocks")
    spark.read.parquet(f"{folder}/frequencies").write.parquet(f"{folder}-2/frequencies")
    with pytest.raises(Exception, match="damaged"):
        rans.read(spark, f"{folder}-2").collect()

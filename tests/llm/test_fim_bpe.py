import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.llm import byte_bpe, fim

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from(" \t\n\r\x0b\x1c\x85 's't　aé漢9"), max_size=60)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def cut_by_hand(doc_id, text):
    text = text or ""
    h = [int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k:8 * k + 8], 16) for k in range(4)]
    units = regex.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    return (n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}") if h[3] % 100 < 50 else (n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}")


EXTRA = ["a\r\n\n\nb", "\n", "\n\n", "😀\n$1\\n<\n<S\nP>", "x<M>y", "<P", "é\n" * 50, "no feed", " a\x85\nb", "long\n" * 200_000 + "y" * 500_000]


def test_cut_and_restored(spark, make_docs, odd_rows, clashing):
    rows = odd_rows + [(100 + 40 * k + j, t, "s") for k, t in enumerate(EXTRA) for j in range(12 if len(t) < 1000 else 2)]
    for df, want in ((make_docs(rows), rows), (clashing.withColumn("a.b", F.lit(1)), odd_rows), (make_docs([]), [])):
        got = fim.cut(df).select("*", fim.restored().alias("again")).collect()
        assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.again) for r in got), key=str) == sorted(
            ((i, *cut_by_hand(i, t), t or "") for i, t, _ in want), key=str)


def test_rates_and_units(spark, make_docs):
    rows = [(k, f"50% one two three {k}", "s") for k in range(400)]
    forms = {r.form: r["count"] for r in fim.cut(make_docs(rows), rate=40, spm=10).groupBy("form").count().collect()}
    assert 180 < forms["plain"] < 300 and forms["spm"] < forms["psm"]
    got = fim.cut(make_docs(rows), unit=r"(?:[^ %]*+[ %]|[^ %]++)").select("n", fim.restored().alias("t")).collect()
    assert {r.n for r in got} == {6} and {r.t for r in got} == {t for _, t, _ in rows}


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXTS, max_size=6))
def test_ids_are_the_librarys(library, texts):
    own = byte_bpe.coder(PATH, public_tokenizers.PATTERN)
    ids = own.encode(texts)
    assert [np.frombuffer(i, "<u4").tolist() for i in ids] == [library.encode_ordinary(t) for t in texts]
    assert [own.decode(i) for i in ids] == [t.encode() for t in texts]


def test_every_character(library):
    own = byte_bpe.coder(PATH, public_tokenizers.PATTERN)
    chars = [chr(c) for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1{c} {c}\n" for c in chars[k:k + 500]) for k in range(0, len(chars), 500)]
    assert [np.frombuffer(i, "<u4").tolist() for i in own.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_a_full_table_and_long_texts(library, monkeypatch):
    own = byte_bpe.Coder(PATH, public_tokenizers.PATTERN, known=50)
    monkeypatch.setattr(byte_bpe, "GROUP_CHARS", 1000)
    monkeypatch.setattr(byte_bpe, "RUN", 7)
    for text in ["".join(f"word{k % 301} {k}, " for k in range(800)), "a" * 30_000, " " * 20_000 + "x", "short ones"]:
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)
        assert len(own.known) <= 50 + 7 and all(len(t) <= byte_bpe.KNOWN_CHARS for t in own.known)


def test_a_whole_pre_token_is_its_id(tmp_path):
    """Rank 258 is out of the merges' reach ('bc' is no entry): as a whole pre-token it is one id, inside another one it is not."""
    ranks = [bytes([b]) for b in range(256)] + [b"ab", b"cd", b"abcd", b"xyz"]
    path = tmp_path / "ranks"
    path.write_text("".join(f"{base64.b64encode(p).decode()} {k}\n" for k, p in enumerate(ranks)))
    own = byte_bpe.Coder(str(path), r"\S+|\s+")
    library = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks={p: k for k, p in enumerate(ranks)}, special_tokens={})
    for text in ("abcd", "xyz", "xyza", "abcdxyz ab cdab", "ababcd"):
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)


def test_gaps_are_refused(tmp_path):
    (tmp_path / "ranks").write_text("YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError, match="ranks"):
        byte_bpe.vocabulary(str(tmp_path / "ranks"))


def test_query_rows(spark, make_docs, odd_rows, clashing, library):
    for df, want in ((make_docs(odd_rows), odd_rows), (clashing.withColumn("a.b", F.lit(1)), odd_rows), (make_docs([]), [])):
        got = byte_bpe.decode(byte_bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN).collect()
        expected = [(i, len(ids := library.encode_ordinary(t or "")), np.array(ids, "<u4").tobytes(), (t or "").encode()) for i, t, _ in want]
        assert sorted(((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in got), key=str) == sorted(expected, key=str)

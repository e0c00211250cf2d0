import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """DataFrame of documents from (doc_id, text, source) rows."""
    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)
    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"w{k % 977} of the" for k in range(30_000))
    return [(1, None, "a"), (2, "", None), (3, long, "a"), (4, "One two.\nThree", "a"), (4, "One two.\nThree", "a"), (None, "One two.\nThree", "b"),
            (5, "  \t\n ", "b"), (6, "One two.\nThree", None), (7, "É\x1cü ñandú 漢字 🙂 <b>", "b"), (8, long + " x", "c")]


@pytest.fixture(scope="session")
def clashing(make_docs, odd_rows):
    """The same with extra columns named like the operators' own."""
    from pyspark.sql import functions as F
    names = "row row_hash size key words lines set n times copies hash cell s shard bytes fp root component_id kept host line ids held"
    df = make_docs(odd_rows)
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate([*names.split(), "a.b", "t`ick"])])

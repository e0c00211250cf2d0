"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import cut_lineage

#: A word is a run of characters other than these six ASCII white-space characters.
WHITE = "[\\x09-\\x0D ]+"

#: Largest number of small fixed-width rows (about 32 bytes each) that is broadcast; beyond it, joins shuffle.
BROADCAST_ROWS = 1_000_000

#: Bytes of UTF-8: A-Z to a-z, all else as it is.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch sent to Python: texts can be long, and a batch is held whole, twice.
BATCH_ROWS = 2_000


def for_python(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches at most BATCH_ROWS rows."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


#: Bytes of an Arrow batch of rows that are large (Spark's own limit is 2 GB).
BATCH_BYTES = 1 << 26


def byte_batches(df: DataFrame) -> DataFrame:
    """``for_python``, with the session's Arrow batches at most BATCH_BYTES too (a batch may go beyond it by a row)."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(key).rstrip("b")) <= BATCH_BYTES:   # Spark gives it back as bytes, "67108864b"
        conf.set(key, str(BATCH_BYTES))
    return for_python(df)


#: Characters of texts that numpy takes apart at once (about 40 bytes each while it does).
GROUP_CHARS = 1_500_000


def text_groups(texts: Sequence[str | None], chars: int = GROUP_CHARS) -> Iterator[slice]:
    """Runs of texts of about ``chars`` characters; a longer text is a run of its own."""
    start = total = 0
    for k, text in enumerate(texts):
        n = len(text or "")
        if total and total + n > chars:
            yield slice(start, k)
            start, total = k, 0
        total += n + 1
    if start < len(texts):
        yield slice(start, len(texts))


def lower_az(text: str | None) -> bytes:
    """UTF-8 of ``text`` (null: empty) with A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").translate(_LOWER)


def folded_words(text: str | None) -> list[bytes]:
    """The words of ``text``, A-Z lower-cased, as UTF-8. ``bytes.split`` parts at just the six white-space characters."""
    return lower_az(text).split()


def words_array(text: Column) -> Column:
    """Array of the words of a text column, on the JVM."""
    return F.array_remove(F.split(text, WHITE), "")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast where the (already materialised) table has at most ``rows`` rows; else leave it to shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def row_hash() -> Column:
    """Identity of a document row: hash of doc_id, source and text (null text counts as empty)."""
    return F.xxhash64("doc_id", F.isnull("source"), "source", F.coalesce(F.col("text"), F.lit("")))


def whole_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as a struct; names may hold dots and backticks."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row")


def take_rows(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns kept, as often as ``plan`` says.

    ``plan`` (materialised) has row_hash, copies (input rows with that hash) and times (output rows for all of them, at
    least 1). Rows whose hash occurs once are taken where they are; only rows that repeat are grouped.
    """
    rows = docs.select(whole_row(docs), row_hash().alias("row_hash"))
    rows = rows.join(small(plan.select(F.col("row_hash").alias("plan_hash"), "copies", "times")), F.col("row_hash") == F.col("plan_hash"))
    once = rows.where("copies = 1").select("row", "times")
    again = rows.where("copies > 1").groupBy("row_hash", "times").agg(F.min("row").alias("row")).select("row", "times")
    both = once.unionByName(again)
    return both.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("n")).select("row.*")


def md5_bits(text: Column) -> Column:
    """The first 60 bits of the MD5 of a string, as a non-negative long."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


__all__ = ["WHITE", "table", "lower_az", "folded_words", "for_python", "byte_batches", "text_groups", "words_array", "small", "row_hash", "take_rows", "whole_row", "md5_bits", "cut_lineage"]

"""Quality rules with cross-document line frequency, on DataFrame functions only.

A line is normalised (lower case, digits to 0, white space to one space, trimmed) and hashed. For each host
(``source``) the distinct documents that carry a line are counted, and all its distinct documents. Documents whose
normalised lines are the same are copies and count once in both.
Lines carried by more than ``max(min_docs, share of the host's documents)`` are boilerplate; a document that loses more
than ``depleted_pct`` percent of its words by them is rejected. ``verdicts`` counts the words on them, ``keep_good``
returns the documents that stay without them.

Defined cases: null text counts as empty (no words, hence ``base_failed``); a null host is a host of its own;
rows that repeat each get a row in the result; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import WHITE, cut_lineage, row_hash, small, whole_row, words_array

MIN_WORDS = 10
MAX_REPEAT_PCT = 20
WINDOW = 5
MIN_DOCS = 8
HOST_SHARE_PCT = 5
DEPLETED_PCT = 70
#: Rows with an array of line numbers each that are broadcast.
PLAN_ROWS = 400_000

_HAS_WORD = "[^\\x20\\x09-\\x0D]"


def _line_hashes(lines: Column) -> Column:
    norm = F.transform(lines, lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "[0-9]", "0"), WHITE, " ")))
    return F.transform(norm, lambda x: F.substring(F.md5(x), 1, 16))


def _base(docs: DataFrame) -> DataFrame:
    """One row per input row: id, row hash, host, text, its lines with a word and their hashes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", F.col("source").alias("host"), row_hash().alias("row_hash"), text.alias("text"),
                     F.filter(F.split(text, "\n"), lambda x: x.rlike(_HAS_WORD)).alias("lines"))
    return df.select("doc_id", "host", "row_hash", "text", "lines", _line_hashes(F.col("lines")).alias("hashes"))


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, host_share_pct: int = HOST_SHARE_PCT) -> DataFrame:
    """Lines above the limit: (host, line, n_docs).

    The counts are partial-aggregated by (host, line, document) before they meet, so a line that a third of all
    documents share is counted by many tasks.
    """
    own = _base(docs).select("host", "hashes", F.xxhash64("hashes").alias("copy"))
    lines = own.select("host", "copy", F.explode(F.array_distinct("hashes")).alias("line"))
    counts = lines.groupBy("host", "line").agg(F.count_distinct("copy").alias("n_docs")).where(F.col("n_docs") > min_docs)
    hosts = own.groupBy(F.col("host").alias("total_host")).agg(F.count_distinct("copy").alias("host_docs"))
    return (counts.join(hosts, F.col("host").eqNullSafe(F.col("total_host")))
            .where(F.col("n_docs") * 100 > F.col("host_docs") * host_share_pct).select("host", "line", "n_docs"))


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words covered by 5-word windows that occur at least twice in the text.

    Every step reads the array of the step before more than once, which keeps Catalyst from inlining it into a lambda.
    """
    at = lambda i: F.get("words", i)
    hashed = F.transform(F.slice("words", F.lit(1), F.greatest(F.size("words") - (WINDOW - 1), F.lit(0))),
                         lambda w, i: F.xxhash64(w, *[at(i + k) for k in range(1, WINDOW)]))
    df = df.withColumn("win", F.when(F.size("words") >= WINDOW, hashed).otherwise(F.array().cast("array<bigint>")))
    repeats = F.size(F.array_distinct("win")) < F.size("win")
    by_hash = F.when(repeats, F.sort_array(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("by_hash", by_hash).drop("win")
    near = lambda j: F.get("by_hash", j)["h"]
    twice = F.filter("by_hash", lambda e, j: ((j > 0) & near(F.greatest(j - 1, F.lit(0))).eqNullSafe(e["h"])) | near(j + 1).eqNullSafe(e["h"]))
    df = df.withColumn("starts", F.sort_array(F.transform(twice, lambda e: e["i"]))).drop("by_hash")
    gaps = F.transform("starts", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", j + 1) - p, F.lit(WINDOW))))
    total = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("starts")


def verdicts(docs: DataFrame, frequent: DataFrame | None = None, depleted_pct: int = DEPLETED_PCT,
             min_docs: int = MIN_DOCS, host_share_pct: int = HOST_SHARE_PCT) -> DataFrame:
    """One row per document: base counts, words on removed lines, verdict, and ``row_hash`` (of id, host and text)."""
    if frequent is None:
        frequent = cut_lineage(frequent_lines(docs, min_docs, host_share_pct))
    df = _base(docs).withColumn("words", words_array(F.col("text")))
    df = df.select(
        "doc_id", "host", "row_hash", "words",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        F.arrays_zip(F.transform("lines", lambda x: F.size(words_array(x))).alias("n"), F.col("hashes").alias("line")).alias("lines"))
    df = _repeat_words(df).drop("words")
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    df = df.select("doc_id", "host", "row_hash", *base, "n_lines", F.explode_outer("lines").alias("l"))
    df = df.select("doc_id", "host", "row_hash", *base, "n_lines", F.col("l.n").alias("line_words"), F.col("l.line").alias("line"))
    hit = small(frequent.select(F.col("host").alias("f_host"), F.col("line").alias("f_line"), F.lit(True).alias("hit")))
    df = df.join(hit, F.col("host").eqNullSafe(F.col("f_host")) & (F.col("line") == F.col("f_line")), "left")
    df = df.groupBy("doc_id", "row_hash", *base, "n_lines").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.when(F.col("hit"), F.col("line_words")).otherwise(0)).alias("lost"))
    # rows equal in id, host and text meet in one group: one result row for each
    copies = (F.col("rows") / F.greatest(F.col("n_lines"), F.lit(1))).cast("int")
    df = df.withColumn("copies", copies).withColumn("n_removed_words", (F.coalesce("lost", F.lit(0)) / F.col("copies")).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PCT)
    depleted = F.col("n_removed_words") * 100 > F.col("n_words") * depleted_pct
    df = df.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        "doc_id", "row_hash", *base, "n_removed_words", "base_failed", "kept")


def _removed_lines(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """(hit_hash, removed): for each row hash of ``docs``, which parts of its text (split at line ends, from 0) are frequent lines."""
    df = _base(docs)
    parts = F.split("text", "\n")
    number = F.filter(F.transform(parts, lambda x, i: F.when(x.rlike(_HAS_WORD), i)), lambda i: i.isNotNull())
    df = df.select("host", "row_hash", F.explode(F.arrays_zip(number.alias("i"), F.col("hashes").alias("line"))).alias("l"))
    hit = small(frequent.select(F.col("host").alias("f_host"), F.col("line").alias("f_line")))
    df = df.join(hit, F.col("host").eqNullSafe(F.col("f_host")) & (F.col("l.line") == F.col("f_line")))
    return df.groupBy(F.col("row_hash").alias("hit_hash")).agg(F.collect_set("l.i").alias("removed"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns; texts without the frequent lines (and ``n_chars``, if there, to match)."""
    frequent = cut_lineage(frequent_lines(docs))
    touched = verdicts(docs, frequent).where(~F.col("kept") | (F.col("n_removed_words") > 0))
    touched = cut_lineage(touched.select(F.col("row_hash").alias("t_hash"), "kept").distinct())
    hashed = docs.select(whole_row(docs), row_hash().alias("row_hash"))
    cut = hashed.join(small(touched.where("kept")), F.col("row_hash") == F.col("t_hash"), "left_semi")
    removed = _removed_lines(cut.select("row.doc_id", "row.source", "row.text"), frequent)
    plan = cut_lineage(touched.join(removed, F.col("t_hash") == F.col("hit_hash"), "left").select("t_hash", "kept", "removed"))
    rows = hashed.join(small(plan, PLAN_ROWS), F.col("row_hash") == F.col("t_hash"), "left").where(F.coalesce("kept", F.lit(True)))
    rows = rows.withColumn("parts", F.when(F.col("removed").isNotNull(), F.split("row.text", "\n")))
    # array_except looks positions up by hash, so a text of many lines takes time in proportion
    left = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "removed")
    rows = rows.withColumn("left", F.when(F.col("removed").isNotNull(), left))
    text = F.array_join(F.transform("left", lambda i: F.get("parts", i)), "\n")
    rows = rows.select("row", F.when(F.col("removed").isNotNull(), text).otherwise(F.col("row.text")).alias("new"), F.col("removed").isNotNull().alias("cut"))
    out = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        length = F.char_length("new").cast(docs.schema["n_chars"].dataType)
        out["n_chars"] = F.when(F.col("cut"), length).otherwise(F.col("row.n_chars"))
    return rows.select(*[out.get(c, F.col("row")[c]).alias(c) for c in docs.columns])

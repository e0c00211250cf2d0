"""Fill-in-the-middle transformation by counted-quantifier regular expressions, DataFrame functions only.

A text is cut into units (``UNIT``; lines, each with its line feed). ``regexp_count`` gives their number n; two draws give the
cuts a <= b; the row's own pattern ``(unit{a}+)(unit{b-a}+)(rest)`` then captures prefix, middle and suffix in one match, and the
replacement string of the row's form puts them in order. All quantifiers are possessive: a unit, once matched, is never given
back, so a match is one pass over the text with no stack that grows with it.

Each row is transformed where it is (no shuffle), so hot sources, copies and long texts meet nowhere. Draws come from the
SHA-256 of ``seed:doc_id``: reruns and copies agree. Null text counts as empty, a null doc_id as the empty string; empty texts, and
texts that hold a marker, stay plain. Rows that repeat are transformed alike; extra columns are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One unit of text: a line with its line feed, or what follows the last one. Groups inside must not capture.
UNIT = r"(?:[^\n]*+\n|[^\n]++)"
MARKER = "<[PSM]>"


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def cut(docs: DataFrame, unit: str = UNIT, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """doc_id, n (units, long), form (plain, psm or spm), prefix_chars and middle_chars (code points; null if plain), output.

    ``rate``: per cent of documents cut; ``spm``: per cent of those whose suffix comes first.
    """
    text, h = F.coalesce(F.col("text"), F.lit("")), draws(F.col("doc_id"), seed)
    rows = docs.select("doc_id", text.alias("text"), F.regexp_count(text, F.lit(unit)).cast("long").alias("n"), *[x.alias(f"h{k}") for k, x in enumerate(h)])
    plain = (F.col("text") == "") | F.col("text").rlike(MARKER) | (F.col("h2") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h3") % 100 < spm, "spm").otherwise("psm")
    ends = [F.col(f"h{k}") % (F.col("n") + 1) for k in (0, 1)]
    rows = rows.select("doc_id", "text", "n", form.alias("form"), F.least(*ends).alias("a"), F.greatest(*ends).alias("b"))
    count = unit.replace("%", "%%") + "{%d}+"
    pattern = F.format_string(f"(?s)\\A({count})({count})(.*+)\\z", F.col("a"), F.col("b") - F.col("a"))
    order = F.when(F.col("form") == "psm", "<P>$1<S>$3<M>$2").otherwise("<S>$3<P>$1<M>$2")
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, order))
    rows = rows.select("doc_id", "n", "form", output.alias("output"))
    prefix, middle, _ = parts()
    return rows.select("doc_id", "n", "form", F.length(prefix).cast("long").alias("prefix_chars"), F.length(middle).cast("long").alias("middle_chars"), "output")


def parts() -> tuple[Column, Column, Column]:
    """Prefix, middle and suffix of the columns form and output (null if plain). The text held no marker, so the markers part it."""
    pieces, first = F.split("output", MARKER, -1), F.col("form") == "psm"
    cut_up = F.col("form") != "plain"
    prefix, suffix = [F.when(cut_up, F.when(first, F.get(pieces, k)).otherwise(F.get(pieces, 3 - k))) for k in (F.lit(1), F.lit(2))]
    return prefix, F.when(cut_up, F.get(pieces, F.lit(3))), suffix


def restored() -> Column:
    """The text, rebuilt from the columns form and output."""
    return F.when(F.col("form") == "plain", F.col("output")).otherwise(F.concat(*parts()))

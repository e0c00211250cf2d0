"""Registered queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import byte_bpe, decontaminate, fim, hardneg, html_text, licenses, linededup, lm, mixing, quality, rans, sharding, simhash
from riskloom.llm.common import table
from riskloom.session import checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


_WS = "[\\x09-\\x0D ]+"

OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '{_WS}'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
words AS (SELECT r, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM w),
wins AS (SELECT r, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o
        || ' ' || lead(word, 4) OVER o AS win FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
starts AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM wins WHERE win IS NOT NULL) WHERE n > 1),
rep AS (SELECT r, sum(least({quality.WINDOW}, coalesce(nxt - i, {quality.WINDOW})))::BIGINT AS n
        FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM starts) GROUP BY r),
l AS (SELECT r, source, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM w),
n AS (SELECT r, source, i, line, trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '{_WS}', ' ', 'g')) AS norm FROM l),
h AS (SELECT r, source, i, substr(md5(norm), 1, 16) AS h, len(list_filter(string_split_regex(line, '{_WS}'), lambda x: x <> '')) AS nw FROM n),
k AS (SELECT r, string_agg(h, ',' ORDER BY i) AS copy FROM h GROUP BY r),
c AS (SELECT source, h, count(DISTINCT copy) AS n FROM h JOIN k USING (r) GROUP BY 1, 2),
f AS (SELECT c.source, h FROM c JOIN (SELECT source, count(DISTINCT coalesce(copy, '')) AS docs FROM w LEFT JOIN k USING (r) GROUP BY 1) s ON c.source IS NOT DISTINCT FROM s.source
      WHERE n > {quality.MIN_DOCS} AND n * 100 > docs * {quality.HOST_SHARE_PCT}),
lost AS (SELECT r, sum(nw)::BIGINT AS n FROM h JOIN f ON h.h = f.h AND h.source IS NOT DISTINCT FROM f.source GROUP BY r),
b AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS n_removed_words
      FROM w LEFT JOIN rep USING (r) LEFT JOIN lost USING (r))
SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PCT} * n_words AS base_failed,
  NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PCT} * n_words)
  AND NOT n_removed_words * 100 > n_words * {quality.DEPLETED_PCT} AS kept FROM b
"""


@query("op7_quality_rules", OP7_SQL)
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents")).drop("row_hash")


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


OP2_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, len(list_filter(string_split_regex(coalesce(text, ''), '{_WS}'), lambda x: x <> ''))::BIGINT AS size FROM documents),
k AS (SELECT doc_id, source, t, size, -ln((('0x' || substr(md5(concat('{mixing.SEED}:', coalesce(doc_id::VARCHAR, ''), ':', t)), 1, 15))::BIGINT::DOUBLE + 0.5) / {1 << 60}.0::DOUBLE)
        / greatest(0.1::DOUBLE, 1.0::DOUBLE - (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::DOUBLE / greatest(size, 1)::DOUBLE) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY 1),
r AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w, source_size * {mixing.MAX_EPOCHS} AS cap FROM s),
o AS (SELECT *, row_number() OVER z AS rk, coalesce(sum(cap) OVER (z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS filled,
        sum(w) OVER (z ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS rest, sum(source_size) OVER ()::DOUBLE AS total
      FROM r WINDOW z AS (ORDER BY cap / w, source NULLS LAST)),
v AS (SELECT *, (total * {mixing.TOTAL_SHARE}::DOUBLE - filled) / rest AS lv FROM o),
f AS (SELECT min(rk) AS rk, arg_min(lv, rk) AS lv FROM v WHERE NOT lv * w > cap),
t AS (SELECT v.source, source_size, CASE WHEN f.rk IS NULL OR v.rk < f.rk THEN cap::DOUBLE ELSE f.lv * w END AS target FROM v, f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::INT AS epochs FROM t),
x AS (SELECT doc_id, size, source_size, target, epochs, target - epochs * source_size AS budget,
        sum(size) OVER (PARTITION BY k.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE - size / 2 AS mid
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, epochs, epochs + (mid <= budget AND size > 0)::INT AS times, (epochs + (mid <= budget AND size > 0)::INT) * size AS taken FROM x
"""


@query("op2_mix_sources", OP2_SQL)
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("row_hash")


OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, ''))::BIGINT AS bytes,
        ('0x' || substr(md5(concat(coalesce(doc_id::VARCHAR, ''), ':', coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents),
p AS (SELECT d.*, k::INT AS depth, h >> ({sharding.BITS} - k)::INT AS prefix FROM d, range(0, {sharding.BITS} + 1) q(k)),
b AS (SELECT depth, prefix, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM p GROUP BY 1, 2),
m AS (SELECT r, doc_id, bytes, depth, prefix, shard_bytes, shard_docs, row_number() OVER (PARTITION BY r ORDER BY depth) AS n
      FROM p JOIN b USING (depth, prefix) WHERE shard_bytes <= {sharding.SHARD_BYTES} OR shard_docs = 1 OR depth = {sharding.BITS})
SELECT doc_id, bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard, depth, shard_bytes, shard_docs,
  shard_bytes > {sharding.SHARD_BYTES} AS oversize FROM m WHERE n = 1
"""


@query("op6_extendible_shards", OP6_SQL)
def op6_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


@query("op1_decontaminate")
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_hash")


def tokenizer_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op5_token_files")
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/tokens-{uuid4().hex}"
    rans.write(table(spark, sf_dir, "documents"), folder, tokenizer_file("word_bpe_49k.json"))
    return rans.read(spark, folder)


@query("op8_html_text")
def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op10_license_scan")
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    # each notice found: its label, first and last word, and the edits
    span = F.transform("spans", lambda s: F.format_string("%s:%d-%d:%d", s["label"], s["first_word"], s["last_word"], s["errors"]))
    return found.withColumns({"n_notices": F.size("spans").cast("long"), "spans": F.array_join(span, ",")})


@query("op3_attention_score")
def op3_attention_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@query("op4_line_dedup")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))), true)),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r),
p AS (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id NULLS LAST, r) AS n FROM s WHERE same),
x AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.ar, p.n ORDER BY s.score DESC, s.vec_id NULLS LAST, s.r)::INT AS rank,
        s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score WHERE p.n <= 5)
SELECT * FROM x WHERE rank <= 10
"""


@query("op11_hard_negatives", OP11_SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.mine(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(concat('7:', coalesce(doc_id::VARCHAR, ''))) AS hex FROM documents),
u AS (SELECT *, string_split(t, chr(10)) AS ls, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, chr(10))) - (right(t, 1) = chr(10))::INT END::BIGINT AS n,
        [('0x' || substr(hex, 1 + 8 * k, 8))::BIGINT for k in range(4)] AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
        CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
e AS (SELECT *, length(array_to_string(ls[1:a], chr(10))) + (a > 0 AND a < len(ls))::INT AS x, length(array_to_string(ls[1:b], chr(10))) + (b > 0 AND b < len(ls))::INT AS y FROM c),
p AS (SELECT *, substr(t, 1, x) AS pre, substr(t, x + 1, y - x) AS mid, substr(t, y + 1) AS suf FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""


@query("op12_fill_in_middle", OP12_SQL)
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.cut(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(), 256).alias("restored_sha256"))


@query("op13_byte_bpe")
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    path, pattern = tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

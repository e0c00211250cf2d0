from collections import Counter
from uuid import uuid4

import corpus_pipeline as cp
import pytest

from riskloom.session import checkpoint_dir

from .test_mixing_sharding import brute_mix, brute_shards
from .test_quality import brute as brute_quality
from .test_simhash import brute as brute_simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage read and wrote."""
    docs, out, folder = spark.read.parquet(f"{SF}/documents.parquet"), [], f"{checkpoint_dir(spark)}/test-{uuid4().hex}"
    for k, (name, stage) in enumerate(cp.STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def rows(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def test_columns(stages):
    for before, after in stages[:-1]:
        assert before.columns == after.columns
    assert stages[-1][1].columns[:-1] == stages[-1][0].columns


def test_each_stage_against_brute_force(spark, stages):
    from riskloom.llm import quality, sharding
    before, after = stages[0]
    want = {r[0] for r in brute_quality(rows(before), quality.MIN_DOCS, quality.HOST_SHARE_PCT, quality.DEPLETED_PCT) if r[-1]}
    assert {r[0] for r in rows(after)} == want
    before, after = stages[1]
    assert sorted(r[0] for r in rows(after)) == sorted({c for _, _, c in brute_simhash(rows(before))})
    before, after = stages[2]
    items = [[w.lower() for w in r.text.split()] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = lambda text: any(f" {' '.join(i)} " in f" {' '.join(text.lower().split())} " for i in items)
    assert {r[0] for r in rows(after)} == {r[0] for r in rows(before) if not holds(r[1])}
    before, after = stages[3]
    taken = {d: n // max(size, 1) for d, size, _, _, n in brute_mix(rows(before))}
    assert Counter(r[0] for r in rows(after)) == +Counter(taken)
    before, after = stages[4]
    got = sorted(((r.doc_id, len(r.text.encode()), *r.shard_info) for r in after.collect()), key=str)
    assert got == brute_shards(rows(before), sharding.SHARD_BYTES)


def test_run(spark, stages):
    assert cp.run(spark, SF).count() == stages[-1][1].count()
    assert cp.ORACLE_SQL is None and 4 <= len(cp.STAGES) <= 5


def test_stages_on_odd_tables(spark, clashing, make_docs):
    for _, stage in cp.STAGES:
        assert stage(spark, make_docs([]), SF).count() == 0
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, clashing, SF).columns == clashing.columns
    assert cp.STAGES[-1][1](spark, clashing, SF).count() == clashing.count()

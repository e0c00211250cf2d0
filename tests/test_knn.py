"""Exact kNN by pivots: against numpy, on clusters, hot cells and odd rows; distances computed are counted."""

import numpy as np
import pytest

from riskloom.operators import detectors as D


def brute(q, r, k, exclude_self=False):
    out = {}
    for i, v in q:
        d = sorted((float(np.sqrt(((np.array(v) - np.array(u)) ** 2).sum())), j) for j, u in r if not (exclude_self and i == j))
        out[i] = [(j, pytest.approx(x, rel=1e-9, abs=1e-12)) for x, j in d[:k]]
    return out


def found(spark, q, r, k, **own):
    make = lambda rows: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "account_id long, vec array<double>")
    out = {i: [] for i, _ in q}
    for row in sorted(D.knn(make(q), make(r), "vec", "account_id", k, **own).collect(), key=lambda r: (r.account_id, r.nn_rank)):
        out[row.account_id].append((row.ref_id, row.dist))
        assert row.nn_rank == len(out[row.account_id])
    return out


def clusters(n, dims, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dims)) * 10
    return [(int(k), centres[c] + spread * rng.normal(size=dims)) for k, c in enumerate(rng.integers(0, 20, n))]


def test_clusters_meet_few_cells(spark):
    rows = clusters(600, 5, 1)
    counter = spark.sparkContext.accumulator(0)
    assert found(spark, rows, rows, 4, exclude_self=True, cell_rows=10, counter=counter) == brute(rows, rows, 4, True)
    assert counter.value < 0.25 * 600 * 600


def test_ten_times_the_rows_cost_far_less_than_a_hundred_times(spark):
    """Distances on clustered rows with as many more cells: 10 x the rows, well below the square."""
    cost = []
    for n in (400, 4000):
        rows, counter = clusters(n, 4, 2, 0.5), spark.sparkContext.accumulator(0)
        make = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "account_id long, vec array<double>")
        assert D.knn(make, make, "vec", "account_id", 3, cell_rows=20, counter=counter).count() == 3 * n
        cost.append(counter.value)
    assert cost[1] < 40 * cost[0] and cost[1] < 0.15 * 4000 * 4000


def test_random_rows_hot_cells_and_few_references(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), rng.normal(size=3)) for k in range(150)] + [(1000 + k, np.zeros(3)) for k in range(90)]   # many copies: one hot cell
    q = [(5000 + k, rng.normal(size=3) * 3) for k in range(40)] + [(5100 + k, np.zeros(3)) for k in range(30)]
    assert found(spark, q, rows, 7, cell_rows=8, block_rows=16) == brute(q, rows, 7)
    assert found(spark, q[:5], rows[:3], 7, cell_rows=1) == brute(q[:5], rows[:3], 7)   # fewer references than k
    assert found(spark, q[:2], [], 3) == {5000: [], 5001: []} and found(spark, [], rows, 3) == {}


def test_a_block_of_many_references_is_parted_again(spark):
    """3,000 rows make two cells alone; within their block a query still meets few references."""
    rows, counter = clusters(3000, 6, 5), spark.sparkContext.accumulator(0)
    make = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "account_id long, vec array<double>")
    got = {}
    for r in D.knn(make, make, "vec", "account_id", 4, exclude_self=True, counter=counter).collect():
        got.setdefault(r.account_id, {})[r.nn_rank] = (r.ref_id, r.dist)
    assert {i: [got[i][n] for n in sorted(got[i])] for i, _ in rows[:20]} == brute(rows[:20], rows, 4, True)
    assert counter.value < 0.25 * 3000 * 3000


def test_a_query_is_sent_once_to_each_block_it_meets(spark, monkeypatch):
    """Rows without clusters rule out no cell: a visit is still one row a query, not one a cell, and a row not finite loses no neighbour."""
    rng, seen, pairs = np.random.default_rng(6), [], D._pairs
    rows = [(k, rng.normal(size=24)) for k in range(200)]
    monkeypatch.setattr(D, "_pairs", lambda visits, *own: seen.append(visits.count()) or pairs(visits, *own))
    assert found(spark, rows, rows + [(900, np.full(24, np.nan))], 3, cell_rows=5, block_rows=40) == brute(rows, rows, 3)
    assert len(seen) == 2 and max(seen) <= 200


def lof_of(spark, monkeypatch, train, query, k):
    """LOF by one search and by two (which the numbers must not depend on), and the searches that the first took."""
    make = lambda rows: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "account_id long, vec array<double>")
    searches, own = [], D.knn
    monkeypatch.setattr(D, "knn", lambda *a, **b: searches.append(a[4]) or own(*a, **b))
    got = sorted(D.lof_scores(make(train), make(query), "vec", "account_id", k).collect())
    monkeypatch.setattr(D, "_among", lambda *a: False)
    two = sorted(D.lof_scores(make(train), make(query), "vec", "account_id", k).collect())
    monkeypatch.undo()
    assert [r.account_id for r in got] == [r.account_id for r in two]
    assert [r.lof_raw for r in got] == pytest.approx([r.lof_raw for r in two], rel=1e-9, nan_ok=True)
    return searches[:-2], {r.account_id: r.lof_raw for r in got}


def test_lof_searches_once_where_the_training_rows_are_rows_of_the_query(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = clusters(300, 4, 7) + [(1000 + k, np.ones(4)) for k in range(30)] + [(2000 + k, rng.normal(size=4)) for k in range(5)]   # 30 copies: more than k
    train = [r for r in rows if r[0] % 5]
    searches, lof = lof_of(spark, monkeypatch, train, rows, 6)
    assert searches == [7] and len(lof) == len(rows)
    near = brute(train, train, 6, True)
    kdist = {i: max(x.expected for _, x in n) for i, n in near.items()}
    lrd = {i: 1 / (np.mean([max(x.expected, kdist[j]) for j, x in n]) + 1e-10) for i, n in near.items()}
    for i, n in brute(rows, train, 6).items():
        own = 1 / (np.mean([max(x.expected, kdist[j]) for j, x in n]) + 1e-10)
        assert lof[i] == pytest.approx(-np.mean([lrd[j] for j, _ in n]) / own, rel=1e-6)


def test_lof_searches_twice_where_ids_repeat_or_rows_differ(spark, monkeypatch):
    rows = clusters(60, 3, 9)
    again = [*rows, (5, rows[9][1])]
    for train, query in ((again, again), ([(k + 1000, v) for k, v in rows], rows), ([(k, v + 1) for k, v in rows], rows)):
        assert lof_of(spark, monkeypatch, train, query, 4)[0] == [4, 4]


def test_a_second_search_meets_no_cell_beyond_the_bound(spark):
    """A block whose cells all lie farther away than a query's k-th best so far costs it no distance."""
    rows = np.array([v for _, v in clusters(3000, 4, 11)])
    far = rows[:200] + 1000.0
    counter = spark.sparkContext.accumulator(0)
    d2, _ = D._topk(far, np.arange(200), rows, np.arange(3000), 5, False, np.full(200, 1.0), 50, counter)
    assert not np.isfinite(d2).any() and counter.value == 0

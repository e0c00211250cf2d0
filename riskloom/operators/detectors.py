"""Unsupervised detectors and resampling: isolation forest (A3), local outlier
factor (A5), reconstruction error (A6) and SMOTE (M4).

* Isolation forest: each tree's 256-row sample is chosen by a hash threshold
  (no n x trees explosion: a row is emitted only for the trees that pick it),
  trees are grown in parallel by ``groupBy(tree).applyInPandas`` and returned
  as a node table (at most trees x 511 rows — a proven size bound), which is
  broadcast to a ``mapInPandas`` scorer.
* LOF / SMOTE need exact k-nearest neighbours against a *reference* set (legitimate training rows, or the minority class).
  References lie in Voronoi cells of pivots, cells in blocks; a query meets the blocks of its nearest cells first and then
  only those that the triangle inequality and the bisector of two pivots cannot rule out, and within a block again only
  such cells. A task holds two blocks and one tile of distances, whatever the table's size; k rows per query and block
  leave it.
* Reconstruction error: standardise + PCA fitted on legitimate rows (MLlib),
  error = (|z|^2 - |P^T z|^2) / d per row — a linear bottleneck of a tenth of the features.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.exprs import q
from riskloom.operators.anomaly import percentile_normalise
from riskloom.functions.stats import fit_quantiles
from riskloom.session import cut_lineage

BLOCK_ROWS = 20_000            # rows of a query or reference block, on average
TILE_QUERIES, TILE_REFS = 1024, 1024   # distances held at once by a task (8 MB)
MARGIN = 16                    # candidates kept beside the k best while ties are settled
SEED = 42


def _c(n: int) -> float:
    """Average path length of an unsuccessful BST search (isolation forest normaliser)."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int):
    """One isolation tree as flat arrays: feature, threshold, left, right, size."""
    feat, thr, left, right, size = [], [], [], [], []

    def node(idx, depth):
        i = len(feat)
        feat.append(-1), thr.append(0.0), left.append(-1), right.append(-1), size.append(len(idx))
        if depth >= max_depth or len(idx) <= 1:
            return i
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.where(hi > lo)[0]
        if len(cand) == 0:
            return i
        f = int(rng.choice(cand))
        t = float(rng.uniform(lo[f], hi[f]))
        feat[i], thr[i] = f, t
        mask = sub[:, f] < t
        left[i] = node(idx[mask], depth + 1)
        right[i] = node(idx[~mask], depth + 1)
        return i

    node(np.arange(len(x)), 0)
    return feat, thr, left, right, size


def fit_isolation_forest(train: DataFrame, feats: list[str], id_col: str, n_trees: int = 300,
                         sample_size: int = 256, seed: int = SEED) -> DataFrame:
    """A3 fit: node table (tree, node, feature, threshold, left, right, size)."""
    n = train.count()
    m = min(sample_size, n)
    rate = min(1.0, 1.5 * m / max(n, 1))
    thr = int(rate * 2 ** 31)
    trees = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)),
                     lambda t: F.pmod(F.xxhash64(F.lit(seed), t, F.col(q(id_col))), F.lit(2 ** 31)) < thr)
    picked = train.select(id_col, *feats, F.explode(trees).alias("tree"))
    prio = F.xxhash64(F.lit(seed + 1), F.col("tree"), F.col(q(id_col)))
    from pyspark.sql import Window
    w = Window.partitionBy("tree").orderBy(prio, F.col(q(id_col)))
    sample = picked.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= m).drop("__r")
    max_depth = int(math.ceil(math.log2(max(m, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values(id_col)
        x = pdf[feats].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, t])
        f, th, le, ri, sz = _grow(x, rng, max_depth)
        return pd.DataFrame({"tree": t, "node": np.arange(len(f)), "feature": f, "threshold": th,
                             "left": le, "right": ri, "size": sz})

    return sample.groupBy("tree").applyInPandas(
        build, "tree int, node long, feature long, threshold double, left long, right long, size long")


def score_isolation_forest(df: DataFrame, nodes: DataFrame, feats: list[str], id_col: str,
                           sample_size: int = 256) -> DataFrame:
    """A3 score: 2^(-E[h(x)] / c(psi)); the node table is bounded (trees x 511 rows)."""
    tab = nodes.orderBy("tree", "node").toPandas()
    bc = df.sparkSession.sparkContext.broadcast(tab)
    cn = _c(sample_size)

    def score(it):
        t = bc.value
        groups = [g for _, g in t.groupby("tree")]
        for pdf in it:
            x = pdf[feats].to_numpy(dtype=float)
            depth = np.zeros(len(x))
            for g in groups:
                f, th = g["feature"].to_numpy(), g["threshold"].to_numpy()
                le, ri, sz = g["left"].to_numpy(), g["right"].to_numpy(), g["size"].to_numpy()
                node = np.zeros(len(x), dtype=np.int64)
                d = np.zeros(len(x))
                active = f[node] >= 0
                while active.any():
                    go_left = x[np.arange(len(x)), np.where(active, f[node], 0)] < th[node]
                    nxt = np.where(go_left, le[node], ri[node])
                    node = np.where(active, nxt, node)
                    d = d + active
                    active = f[node] >= 0
                depth += d + np.array([_c(int(s)) for s in sz[node]])
            h = depth / len(groups)
            yield pd.DataFrame({id_col: pdf[id_col], "iso_raw": -(2.0 ** (-h / cn))})

    return df.select(id_col, *feats).mapInPandas(score, f"{id_col} long, iso_raw double")


def _best(d2: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest distances of each row with their ids, by (distance, id)."""
    n = d2.shape[1]
    if n > k + MARGIN:
        pick = np.argpartition(d2, k + MARGIN - 1, axis=1)[:, :k + MARGIN]
        kth = np.partition(np.take_along_axis(d2, pick, 1), k - 1, axis=1)[:, k - 1]
        tied = np.flatnonzero((d2 <= kth[:, None]).sum(1) > k + MARGIN)
        for row in tied:   # more equal distances than the margin holds
            pick[row] = np.lexsort((ids[row], d2[row]))[:k + MARGIN]
        d2, ids = np.take_along_axis(d2, pick, 1), np.take_along_axis(ids, pick, 1)
    order = np.lexsort((ids, d2), axis=1)[:, :k]
    return np.take_along_axis(d2, order, 1), np.take_along_axis(ids, order, 1)


def _reach(gap: np.ndarray, held: np.ndarray, radius: np.ndarray, between: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For queries at distances ``gap`` from pivots: their home cells (the nearest that hold ``k`` references) and, for each cell, a
    distance below which none of its references lies: by its radius, and by the bisector with the query's own pivot."""
    order = np.argsort(gap, axis=1, kind="stable")
    so_far = np.cumsum(held[order], axis=1)
    home = np.empty(gap.shape, bool)
    np.put_along_axis(home, order, (so_far - held[order]) < k, axis=1)
    wide = between[gap.argmin(axis=1)]
    bisector = np.divide(gap**2 - gap.min(axis=1)[:, None] ** 2, 2 * wide, out=np.zeros_like(gap), where=wide > 0)
    return home & (held > 0), np.maximum(gap - radius, bisector) * (1 - SLACK) - SLACK * (gap + radius)


def _topk(qx: np.ndarray, qid: np.ndarray, rx: np.ndarray, rid: np.ndarray, k: int, exclude_self: bool, limit: np.ndarray | None = None,
          local_rows: int | None = None, counter=None):
    """Squared distances and ids of each query's k nearest references (no farther than ``limit``; inf where there are fewer), tile by
    tile with a running best.

    The references of a block are parted again into cells of about ``local_rows``; a query meets its home cells, then those that its
    k-th best so far cannot rule out. A product of matrices, with a margin for its rounding, tells which rows may come in; their
    distances are then taken by differences, so equal rows are at distance zero."""
    width = min(k, len(rx))
    out_d, out_i = np.full((len(qx), k), np.inf), np.zeros((len(qx), k), rid.dtype)
    sound = np.isfinite(rx).all(axis=1)
    rx, rid = rx[sound], rid[sound]
    if not len(rx) or not len(qx):
        return out_d[:, :width], out_i[:, :width]
    n_cells = max(1, len(rx) // (local_rows or LOCAL_ROWS))
    pivots = np.unique(rx[np.linspace(0, len(rx) - 1, n_cells).astype(int)], axis=0)
    between = _gaps(pivots, pivots)
    near = np.lexsort((np.arange(len(pivots)), between[:, ::max(1, int(np.sqrt(len(pivots))))].argmin(axis=1)))   # neighbours side by side
    pivots, between = pivots[near], between[np.ix_(near, near)]
    nearest = [(g.argmin(axis=1), g.min(axis=1)) for g in (_gaps(rx[a:a + TILE_QUERIES], pivots) for a in range(0, len(rx), TILE_QUERIES))]
    cell, own = np.concatenate([c for c, _ in nearest]), np.concatenate([g for _, g in nearest])
    order = np.lexsort((rid, cell))
    rx, rid, cell, own = rx[order], rid[order], cell[order], own[order]
    start = np.searchsorted(cell, np.arange(len(pivots) + 1))
    held, radius = np.diff(start), np.zeros(len(pivots))
    np.maximum.at(radius, cell, own)
    r2 = (rx * rx).sum(axis=1)
    beside = np.concatenate([-2 * rx, r2[:, None]], axis=1).T
    # queries of one cell side by side, so that a tile of them meets few cells
    with np.errstate(invalid="ignore", over="ignore"):
        turn = np.argsort(np.concatenate([_gaps(qx[a:a + TILE_QUERIES], pivots).argmin(axis=1) for a in range(0, len(qx), TILE_QUERIES)]), kind="stable")
    qx, qid, limit = qx[turn], qid[turn], None if limit is None else limit[turn]
    for a in range(0, len(qx), TILE_QUERIES):
        x, xid = qx[a:a + TILE_QUERIES], qid[a:a + TILE_QUERIES]
        best_d, best_i = out_d[a:a + TILE_QUERIES], out_i[a:a + TILE_QUERIES]   # views
        most = np.full(len(x), np.inf) if limit is None else limit[a:a + TILE_QUERIES]
        with np.errstate(invalid="ignore", over="ignore"):
            bound, x2, wide = most.copy(), (x * x).sum(axis=1), np.concatenate([x, np.ones((len(x), 1))], axis=1)
            home, low = _reach(_gaps(x, pivots), held, radius, between, k + exclude_self)
            home &= ~(low > (most * (1 + SLACK))[:, None])

        def meet(rows: np.ndarray, c: int) -> None:
            for b in range(start[c], start[c + 1], TILE_REFS):
                r, ids, near2 = rx[b:min(b + TILE_REFS, start[c + 1])], rid[b:min(b + TILE_REFS, start[c + 1])], bound[rows] ** 2
                if counter is not None:
                    counter.add(len(rows) * len(r))
                own_x, may = x[rows], None
                if np.isfinite(near2).any():
                    about = wide[rows] @ beside[:, b:b + len(r)]
                    edge = near2 * (1 + SLACK) + ROUNDING * (x2[rows] + r2[b:b + len(r)].max()) - x2[rows]
                    may = np.flatnonzero(~(about > edge[:, None]))
                    if len(may) < 0.2 * about.size:
                        i, j = np.divmod(may, len(r))
                        t = own_x[i]
                        t -= r[j]
                        t *= t
                        d2 = np.zeros(len(i))
                        for f in range(x.shape[1]):
                            d2 += t[:, f]
                    else:
                        may = None
                if may is None:
                    d2 = np.zeros((len(rows), len(r)))
                    for f in range(x.shape[1]):
                        t = own_x[:, f, None] - r[None, :, f]
                        t *= t
                        d2 += t
                    if exclude_self:
                        d2[xid[rows][:, None] == ids[None, :]] = np.inf
                    last_d, last_i = best_d[rows, -1:], best_i[rows, -1:]
                    d2[~((d2 < last_d) | ((d2 == last_d) & np.isfinite(d2) & ~(ids[None, :] >= last_i)))] = np.inf
                    came = np.flatnonzero(np.isfinite(d2).any(axis=1))
                    new_d, new_i = d2[came], np.broadcast_to(ids, (len(came), len(ids)))
                else:
                    last_d, last_i = best_d[rows[i], -1], best_i[rows[i], -1]
                    ok = (d2 < last_d) | ((d2 == last_d) & np.isfinite(d2) & ~(ids[j] >= last_i))
                    if exclude_self:
                        ok &= xid[rows[i]] != ids[j]
                    came, at, n = np.unique(i[ok], return_inverse=True, return_counts=True)
                    if len(came):
                        place = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                        new_d, new_i = np.full((len(came), n.max()), np.inf), np.zeros((len(came), n.max()), rid.dtype)
                        new_d[at, place], new_i[at, place] = d2[ok], ids[j[ok]]
                if len(came):
                    to = rows[came]
                    best_d[to], best_i[to] = _best(np.concatenate([best_d[to], new_d], 1), np.concatenate([best_i[to], new_i], 1), k)
                    bound[to] = np.minimum(most[to], np.sqrt(best_d[to, -1]))

        with np.errstate(invalid="ignore", over="ignore"):
            for c in np.flatnonzero(home.any(axis=0)):
                meet(np.flatnonzero(home[:, c]), c)
            for c in np.flatnonzero(held):
                rows = np.flatnonzero(~home[:, c] & (low[:, c] <= bound * (1 + SLACK)))
                if len(rows):
                    meet(rows, c)
        best_d[~(np.sqrt(best_d) <= most[:, None])] = np.inf
    back = np.empty_like(turn)
    back[turn] = np.arange(len(turn))
    return out_d[back, :width], out_i[back, :width]


def _vector(feats: list[str] | str):
    """The feature columns, or one array column, as an array of doubles."""
    return F.col(feats).cast("array<double>") if isinstance(feats, str) else F.array(*[F.col(q(c)).cast("double") for c in feats])


def _gaps(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots, by differences."""
    d2 = np.zeros((len(x), len(pivots)))
    for j in range(pivots.shape[1]):
        t = x[:, j, None] - pivots[None, :, j]
        t *= t
        d2 += t
    return np.sqrt(d2)


def _rows(column: pd.Series, width: int) -> np.ndarray:
    x = np.array(column.tolist(), float).reshape(len(column), -1)
    if x.shape[1] != width:
        raise ValueError(f"vectors of length {x.shape[1]} and {width}")
    return x


def _cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """id, v, cell (its nearest pivot) and the distance to it (rows that are at no finite distance: the first cell)."""
    def run(batches):
        for whole in batches:
            for a in range(0, len(whole), TILE_QUERIES):
                b = whole.iloc[a:a + TILE_QUERIES]
                gap = _gaps(_rows(b["v"], pivots.shape[1]), pivots)
                cell = np.where(np.isfinite(gap).all(axis=1), gap.argmin(axis=1), 0)
                near = gap[np.arange(len(b)), cell]
                yield b.assign(cell=cell.astype("int32"), gap=np.where(np.isfinite(near), near, 0.0))
    return rows.mapInPandas(run, "id long, v array<double>, cell int, gap double")


def _layout(held: np.ndarray, between: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell: neighbouring cells share a block of about ``block_rows`` references, a larger
    cell is dealt over blocks of its own."""
    step = max(1, int(np.sqrt(len(held))))
    first, count, block, filled = np.zeros(len(held), int), np.ones(len(held), int), 0, 0
    for c in np.lexsort((np.arange(len(held)), between[:, ::step].argmin(axis=1))):
        n = -(-held[c] // block_rows)
        if filled and (n > 1 or filled + held[c] > block_rows):
            block, filled = block + 1, 0
        first[c], count[c] = block, max(n, 1)
        block, filled = (block + n, 0) if n > 1 else (block, filled + held[c])
    return first, count


def _pairs(visits: DataFrame, refs: DataFrame, k: int, exclude_self: bool, block_rows: int, local_rows: int, counter) -> DataFrame | None:
    """id, ref_id, d2: the k best references of each visit (id, v, limit: the largest distance that still counts, blocks) in each of
    its blocks of ``refs`` (id, v, rb); None without a visit.

    A block that many queries visit is dealt over blocks of about ``block_rows`` queries, so that a task holds one block of each,
    whatever lies in a cell."""
    asked = visits.select(F.explode("blocks").alias("rb")).groupBy("rb").count().collect()   # a row a block
    if not asked:
        return None
    blocks = visits.sparkSession.createDataFrame([(r["rb"], -(-r["count"] // block_rows)) for r in asked], "rb int, n_q int")
    qs = visits.select("id", "v", "limit", F.explode("blocks").alias("rb")).join(F.broadcast(blocks), "rb").select(
        "id", "v", "limit", "rb", F.pmod(F.xxhash64(F.lit(11), "id"), F.col("n_q")).cast("int").alias("qb"))
    rs = refs.join(F.broadcast(blocks), "rb").select("id", "v", "rb", F.explode(F.sequence(F.lit(0), F.col("n_q") - 1)).alias("qb"))

    def per_pair(qpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        if qpdf.empty or rpdf.empty:
            return pd.DataFrame({"id": [], "ref_id": [], "d2": []})
        qid = qpdf["id"].to_numpy()
        d2, ids = _topk(np.array(qpdf["v"].tolist(), float), qid, np.array(rpdf["v"].tolist(), float), rpdf["id"].to_numpy(), k, exclude_self,
                        qpdf["limit"].to_numpy(), local_rows, counter)
        near = np.isfinite(d2)
        return pd.DataFrame({"id": np.broadcast_to(qid[:, None], d2.shape)[near], "ref_id": ids[near], "d2": d2[near]})

    return qs.groupBy("rb", "qb").cogroup(rs.groupBy("rb", "qb")).applyInPandas(per_pair, "id long, ref_id long, d2 double")


#: References that a cell holds on average, and the most pivots (they go to every task); references of a cell within a block.
CELL_ROWS, MAX_PIVOTS, LOCAL_ROWS = 1_024, 512, 256
#: Bounds are widened by this share, for rounding; the share of the squared lengths that a product of matrices may be off by.
SLACK, ROUNDING = 1e-9, 1e-12


def knn(query: DataFrame, ref: DataFrame, feats: list[str] | str, id_col: str, k: int,
        exclude_self: bool = False, block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS, counter=None) -> DataFrame:
    """Exact k nearest reference rows (Euclidean) for every query row: (id, nn_rank, ref_id, dist), ties by ref_id.
    ``feats`` names columns or one array column; vectors of unequal length raise ValueError.

    Voronoi cells about pivots (reference rows of lowest hash, one in ``cell_rows``), neighbouring cells in one block. A query first
    meets the blocks of the nearest cells that hold more than k references; the distance of its k-th best there bounds the rest: a cell
    whose pivot is at distance g and whose references lie within radius u holds no nearer row where g - u exceeds the bound, nor where
    the bisector between that pivot and the query's own lies farther away than it. Only blocks with a cell left are met in a second
    round, a query once a block. Within a block the same holds for smaller cells (``_topk``), so a query's work follows the cells it
    can't rule out, not the size of the block. Where no cell can be ruled out (rows without clusters in many dimensions) this is the
    search over all blocks. ``counter``: an accumulator of the distances computed."""
    rs = ref.select(F.col(q(id_col)).cast("long").alias("id"), _vector(feats).alias("v"))
    qs = query.select(F.col(q(id_col)).cast("long").alias("id"), _vector(feats).alias("v"))
    n_pivots = int(np.clip(rs.count() // cell_rows, 1, MAX_PIVOTS))
    chosen = [r.v for r in rs.orderBy(F.xxhash64(F.lit(17), "id"), "id").limit(n_pivots).collect()]   # at most MAX_PIVOTS rows
    schema = f"{id_col} long, nn_rank long, ref_id long, dist double"
    if not chosen:
        return query.sparkSession.createDataFrame([], schema)
    pivots = np.unique(np.array(chosen, float).reshape(len(chosen), -1), axis=0)
    sound = np.isfinite(pivots).all(axis=1)
    pivots = pivots[sound] if sound.any() else np.zeros((1, pivots.shape[1]))
    cells = cut_lineage(_cells(rs, pivots))
    stats = {r["cell"]: r for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius")).collect()}   # a row a cell
    held = np.array([stats[c]["n"] if c in stats else 0 for c in range(len(pivots))])
    radius = np.array([stats[c]["radius"] if c in stats else 0.0 for c in range(len(pivots))])
    between = _gaps(pivots, pivots)
    first, count = _layout(held, between, block_rows)
    places = query.sparkSession.createDataFrame([(c, int(first[c]), int(count[c])) for c in range(len(pivots))], "cell int, first int, blocks int")
    refs = cells.join(F.broadcast(places), "cell").select("id", "v", (F.col("first") + F.pmod(F.xxhash64(F.lit(29), "id"), F.col("blocks"))).cast("int").alias("rb"))
    lies = np.zeros((len(pivots), int((first + count).max())), np.float32)   # cell x block
    for c in np.flatnonzero(held):
        lies[c, first[c]:first[c] + count[c]] = 1

    def visits(second: bool):
        """The blocks of each query: those of its home cells, or the others with a cell within the query's bound."""
        def run(batches):
            for whole in batches:
                for a in range(0, len(whole), TILE_QUERIES):
                    b = whole.iloc[a:a + TILE_QUERIES]
                    home, low = _reach(_gaps(_rows(b["v"], pivots.shape[1]), pivots), held, radius, between, k + exclude_self)
                    goes, limit = home.astype(np.float32) @ lies > 0, np.full(len(b), np.inf)
                    if second:
                        limit = b["limit"].to_numpy()
                        near = (held > 0) & (low <= limit[:, None] * (1 + SLACK))
                        goes = ~goes & (near.astype(np.float32) @ lies > 0)
                    some = np.flatnonzero(goes.any(axis=1))
                    yield pd.DataFrame({"id": b["id"].to_numpy()[some], "v": b["v"].to_numpy()[some], "limit": limit[some],
                                        "blocks": pd.Series([np.flatnonzero(goes[i]).astype("int32") for i in some], dtype=object)})
        return run

    kind, own = "id long, v array<double>, limit double, blocks array<int>", min(LOCAL_ROWS, cell_rows)
    best = Window.partitionBy("id").orderBy("d2", "ref_id")   # <= k rows of a query and block
    first_k = lambda df: df.withColumn("nn_rank", F.row_number().over(best)).filter(F.col("nn_rank") <= k)
    one = _pairs(cut_lineage(qs.mapInPandas(visits(False), kind)), refs, k, exclude_self, block_rows, own, counter)
    if one is None:
        return query.sparkSession.createDataFrame([], schema)
    one = cut_lineage(first_k(one))
    if lies.shape[1] > 1:
        bound = one.filter(F.col("nn_rank") == k).select(F.col("id").alias("i"), F.sqrt("d2").alias("limit"))
        asked = qs.join(bound, F.col("id") == F.col("i"), "left").select("id", "v", F.coalesce("limit", F.lit(float("inf"))).alias("limit"))
        two = _pairs(cut_lineage(asked.mapInPandas(visits(True), kind)), refs, k, exclude_self, block_rows, own, counter)
        if two is not None:
            one = cut_lineage(first_k(one.drop("nn_rank").unionByName(two)))   # read more than once by most callers
    return one.select(F.col("id").alias(id_col), F.col("nn_rank").cast("long"), "ref_id", F.sqrt("d2").alias("dist"))


def _among(train: DataFrame, query: DataFrame, feats: list[str] | str, id_col: str) -> bool:
    """Whether each row of ``train`` is a row of ``query``, with the same vector, and no id repeats or is null in either."""
    v = _vector(feats)
    rows = lambda df, of: df.select(F.col(q(id_col)).cast("long").alias("id"), F.xxhash64(v, F.transform(v, F.isnull)).alias("h"), F.lit(of).alias("of"))
    ids = rows(train, 1).unionByName(rows(query, 0)).groupBy("id").agg(F.sum("of").alias("n_t"), F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
    return ids.where("id IS NULL OR n_t > 1 OR n - n_t <> 1 OR lo <> hi").isEmpty()


def lof_scores(train: DataFrame, query: DataFrame, feats: list[str] | str, id_col: str, k: int = 20) -> DataFrame:
    """A5 (novelty LOF): k-distance and lrd of training rows from their own neighbours
    (self excluded); each query row's LOF = mean lrd of its neighbours / its lrd.
    Where the training rows are rows of the query, one search for k + 1 neighbours serves both: without itself, a row's first k
    of them are its own. After the kNN kernel everything is joins and group-bys on (id, neighbour)."""
    if _among(train, query, feats, id_col):
        near = knn(query, train, feats, id_col, k + 1)
        qn = near.filter(F.col("nn_rank") <= k)
        others = near.filter(F.col("ref_id") != F.col(id_col)).join(train.select(F.col(q(id_col)).cast("long").alias(id_col)), id_col, "left_semi")
        tn = others.withColumn("nn_rank", F.row_number().over(Window.partitionBy(id_col).orderBy("nn_rank"))).filter(F.col("nn_rank") <= k)
    else:
        tn = knn(train, train, feats, id_col, k, exclude_self=True)
        qn = knn(query, train, feats, id_col, k)
    kdist = tn.groupBy(id_col).agg(F.max("dist").alias("kdist"))
    reach_t = (tn.join(kdist.withColumnRenamed(id_col, "ref_id").withColumnRenamed("kdist", "ref_kdist"), "ref_id")
               .withColumn("reach", F.greatest("dist", "ref_kdist")))
    lrd_t = reach_t.groupBy(id_col).agg((1.0 / (F.avg("reach") + 1e-10)).alias("lrd"))
    ref_stats = kdist.join(lrd_t, id_col).withColumnRenamed(id_col, "ref_id")
    j = qn.join(ref_stats, "ref_id").withColumn("reach", F.greatest("dist", "kdist"))
    agg = j.groupBy(id_col).agg((1.0 / (F.avg("reach") + 1e-10)).alias("lrd_q"), F.avg("lrd").alias("lrd_nn"))
    return agg.select(id_col, (-(F.col("lrd_nn") / F.col("lrd_q"))).alias("lof_raw"))


def recon_error(train: DataFrame, df: DataFrame, feats: list[str], id_col: str, width: float = 0.1) -> DataFrame:
    """Standardise + PCA fitted on training rows through a bottleneck of ``width`` of the features (at least one
    component, at most all but one); per-row mean squared residual."""
    va = VectorAssembler(inputCols=feats, outputCol="__x")
    sc = StandardScaler(inputCol="__x", outputCol="__z", withMean=True, withStd=True).fit(va.transform(train))
    kk = max(1, min(round(width * len(feats)), len(feats) - 1))
    pca = PCA(k=kk, inputCol="__z", outputCol="__p").fit(sc.transform(va.transform(train)))
    z = pca.transform(sc.transform(va.transform(df.select(id_col, *feats))))
    za, pa = vector_to_array("__z"), vector_to_array("__p")
    sq = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)
    return z.select(id_col, ((sq(za) - sq(pa)) / float(len(feats))).alias("ae_raw"))


def normalise_scores(train_scores: DataFrame, scores: DataFrame, col: str, invert: bool) -> DataFrame:
    """A2 on a detector's raw score with bounds p1 / p99 of the training rows."""
    qs = fit_quantiles(train_scores, [col], [0.01, 0.99])[col]
    return scores.withColumn(col.replace("_raw", "_score"), percentile_normalise(F.col(col), qs[0], qs[1], invert))


def smote(df: DataFrame, feats: list[str], id_col: str, label_col: str, ratio: float = 0.15,
          k: int = 5, seed: int = SEED) -> DataFrame:
    """M4: synthetic minority rows x + gap * (neighbour - x) until minority / majority = ratio;
    skipped when fewer than 5 minority rows. Choices are hash-derived (deterministic)."""
    minority = df.filter(F.col(label_col) == 1).select(id_col, *feats)
    n_pos = minority.count()
    n_neg = df.filter(F.col(label_col) != 1).count()
    n_new = int(ratio * n_neg) - n_pos
    if n_pos < 5 or n_new <= 0:
        return df.limit(0).select(id_col, *feats, label_col)
    kk = min(k, n_pos - 1)
    nb = knn(minority, minority, feats, id_col, kk, exclude_self=True)
    from riskloom.operators.folds import exact_rank, hash_key
    idx = exact_rank(minority.withColumn("__g", F.lit(1)), "__g", hash_key(id_col, seed), id_col,
                     rank_col="__rank").select("*", (F.col("__rank") - 1).alias("base_idx")).drop("__g", "__rank")
    spark = df.sparkSession
    new = spark.range(n_new).select(F.col("id").alias("syn_id"))
    new = new.select("syn_id", F.pmod(F.col("syn_id"), F.lit(n_pos)).alias("base_idx"),
                     (F.pmod(F.xxhash64(F.lit(seed), F.col("syn_id")), F.lit(kk)) + 1).alias("nn_rank"),
                     (F.pmod(F.xxhash64(F.lit(seed + 7), F.col("syn_id")), F.lit(1 << 30)) / float(1 << 30)).alias("gap"))
    base = new.join(idx, "base_idx")
    nbs = nb.select(F.col(id_col).alias("__b"), F.col("nn_rank").alias("__k"), "ref_id")
    base = base.join(nbs, (F.col(id_col) == F.col("__b")) & (F.col("nn_rank") == F.col("__k"))).drop("__b", "__k")
    other = minority.select(F.col(id_col).alias("ref_id"), *[F.col(c).alias(f"__n_{c}") for c in feats])
    j = base.join(other, "ref_id")
    return j.select((-(F.col("syn_id") + 1)).alias(id_col),
                    *[(F.col(c) + F.col("gap") * (F.col(f"__n_{c}") - F.col(c))).alias(c) for c in feats],
                    F.lit(1).alias(label_col))

"""Approximate nearest neighbours by few stable projections and an incremental search with a stopping test.

The largest inner product is a nearest neighbour on the unit sphere: with M the largest norm, a vector
v becomes (v / M, sqrt(1 - |v|^2 / M^2)) and a query q becomes (q / |q|, 0); their squared distance is
2 - 2 <q, v> / (|q| M).  ``DIMS`` Gaussian (2-stable) projections map them to a low dimension, where a
squared projected distance is the squared distance times a chi-square variable of ``DIMS`` degrees.
A search takes neighbours in the order of projected distance r, verifies each by its true inner
product, and stops when a point not yet seen would be among the k best with a chance below 1 - p:
chi2_cdf(r^2 / d_k^2) >= p, d_k being the k-th best distance so far.  So each true neighbour is found
with probability p at least, whatever the data.

Layout: the top of a kd-tree over the projections is fitted on ``SAMPLE`` rows (a bound); its at most
``CELLS`` cells are cut to blocks of about ``BLOCK`` rows, and every row is indexed.  Equal vectors are
one entry holding its k + 1 smallest ids, which are all that any result can show of it, so a vector
that a third of the rows share is one entry.  A search is two co-grouped joins of queries and blocks:
the first gives each query a bound from its home block, the second visits the blocks whose cell the
stopping radius reaches.  Queries are cut to chunks, so a task holds one block and one chunk.

Defined cases: vectors that are null, zero, of another than the most common length (ties: the shortest)
or with null or non-finite components take no part, nor do rows without id; of an id with several
vectors the least counts, so repeated rows count once; ties in score go to the smaller id; fewer
candidates than k are all returned; an empty table gives no rows.  Vectors are read whole, whatever their length.
Only the two named columns are read, so others may have any names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, cut

DIMS, SAMPLE, CELLS, BLOCK, CHUNK, LEAF = 8, 8192, 1024, 8192, 2048, 128


def chi2_quantile(p: float, dims: int = DIMS) -> float:
    """Inverse of the chi-square distribution with an even number of degrees of freedom."""
    def cdf(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, dims // 2):
            term *= x / 2 / i
            total += term
        return 1.0 - math.exp(-x / 2) * total

    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def usable(df: DataFrame, id_col: str, vec_col: str, length: int | None = None) -> tuple[DataFrame, int | None]:
    """(id, v) of the rows that take part, one per id, and the vectors' length."""
    v = col(vec_col).cast("array<double>")
    good = (col(id_col).isNotNull() & v.isNotNull()
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    rows = df.where(good).select(col(id_col).cast("long").alias("id"), v.alias("v"))
    if length is None:
        common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
        if common is None:
            return rows, None
        length = common["n"]
    return rows.where(F.size("v") == length).groupBy("id").agg(F.min("v").alias("v")), length


def entries(rows: DataFrame, keep: int) -> DataFrame:
    """Distinct vectors: cid (smallest id), ids (the ``keep`` smallest, in order) and v."""
    # the window's rank filter is applied before the shuffle too: a hot vector sends ``keep`` rows per task
    w = Window.partitionBy("v").orderBy("id")
    return (rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= keep)
            .groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
            .select(F.col("ids")[0].alias("cid"), "ids", "v"))


def kd_split(y: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """Splits of a balanced tree over ``y`` with ``leaves`` (a power of two) leaves, in heap order:
    dimension and value of each inner node."""
    dims, cuts = np.zeros(leaves, dtype=np.int64), np.zeros(leaves)
    groups = {1: np.arange(len(y))}
    for node in range(1, leaves):
        rows = groups.pop(node)
        d = int(np.argmax(y[rows].max(axis=0) - y[rows].min(axis=0))) if len(rows) else 0
        c = float(np.median(y[rows, d])) if len(rows) else 0.0
        dims[node], cuts[node] = d, c
        right = y[rows, d] > c
        groups[2 * node], groups[2 * node + 1] = rows[~right], rows[right]
    return dims, cuts


def cell_of(y: np.ndarray, dims: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    node = np.ones(len(y), dtype=np.int64)
    while node.size and node[0] < len(dims):
        node = 2 * node + (y[np.arange(len(y)), dims[node]] > cuts[node])
    return node - len(dims)


def cell_distances(y: np.ndarray, dims: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Least squared projected distance of each row of ``y`` to the region of each cell."""
    leaves, m = len(dims), y.shape[1]
    lo, hi = np.full((2 * leaves, m), -np.inf), np.full((2 * leaves, m), np.inf)
    for node in range(1, leaves):
        for child in (2 * node, 2 * node + 1):
            lo[child], hi[child] = lo[node], hi[node]
        hi[2 * node, dims[node]] = min(hi[node, dims[node]], cuts[node])
        lo[2 * node + 1, dims[node]] = max(lo[node, dims[node]], cuts[node])
    return box_distances(y, lo[leaves:], hi[leaves:])


def box_distances(y: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    out = np.zeros((len(y), len(lo)))
    for j in range(y.shape[1]):
        gap = np.maximum(np.maximum(lo[None, :, j] - y[:, None, j], y[:, None, j] - hi[None, :, j]), 0.0)
        out += gap * gap
    return out


def _leaves(y: np.ndarray) -> list[np.ndarray]:
    todo, out = [np.arange(len(y))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        d = int(np.argmax(y[rows].max(axis=0) - y[rows].min(axis=0)))
        order = rows[np.argsort(y[rows, d], kind="stable")]
        todo += [order[:len(order) // 2], order[len(order) // 2:]]
    return out


def search_block(q: np.ndarray, qy: np.ndarray, bound: np.ndarray, x: np.ndarray, xy: np.ndarray, ids: np.ndarray,
                 keep: int, quantile: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (-1: none) and squared distances of the best ``keep`` rows of a block for each query.

    ``q`` are unit vectors, ``x`` vectors over M; ``bound`` is each query's known k-th squared distance.
    """
    leaves = _leaves(xy)
    near = box_distances(qy, np.stack([xy[r].min(axis=0) for r in leaves]), np.stack([xy[r].max(axis=0) for r in leaves]))
    order = np.argsort(near, axis=1, kind="stable")
    best, rows = np.full((len(q), keep), np.inf), np.full((len(q), keep), -1, dtype=np.int64)
    big = np.iinfo(np.int64).max
    for step in range(len(leaves)):
        leaf = order[:, step]
        reach = np.minimum(bound, best[:, -1]) * quantile
        todo = np.flatnonzero(near[np.arange(len(q)), leaf] < reach)
        if not len(todo):
            break
        for k in np.unique(leaf[todo]):
            mine, members = todo[leaf[todo] == k], leaves[k]
            d = np.maximum(2.0 - 2.0 * (q[mine] @ x[members].T), 0.0)
            hit = d.min(axis=1) <= best[mine, -1]
            mine, d = mine[hit], d[hit]
            if not len(mine):
                continue
            all_d = np.concatenate([best[mine], d], axis=1)
            all_r = np.concatenate([rows[mine], np.broadcast_to(members, d.shape)], axis=1)
            all_i = np.where(all_r < 0, big, ids[all_r])
            top = np.lexsort((all_i, all_d), axis=-1)[:, :keep]
            best[mine], rows[mine] = np.take_along_axis(all_d, top, 1), np.take_along_axis(all_r, top, 1)
    return rows, best


def project_rows(v: np.ndarray, scale: float, project: np.ndarray) -> np.ndarray:
    """Projections of vectors, lifted to the unit sphere."""
    x = v / scale
    last = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))
    return np.concatenate([x, last[:, None]], axis=1) @ project


def project_queries(v: np.ndarray, project: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True) @ project[:-1]


class Index:
    """Entries of all rows, dealt to cells and blocks of a kd-tree over their projections."""

    def __init__(self, vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 42):
        rows, self.length = usable(vectors, id_col, vec_col)
        self.k, self.table = k, None
        if self.length is None:
            return
        plain = cut(entries(rows, k + 1))
        norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
        n, top = plain.agg(F.count("*"), F.max(norm2)).first()
        self.scale = math.sqrt(top)
        self.project = np.random.default_rng(seed).standard_normal((self.length + 1, DIMS))
        sample = plain.orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).select("v").collect()
        y = project_rows(np.array([r["v"] for r in sample]), self.scale, self.project)
        cells = 1
        while cells < CELLS and cells * BLOCK < n:
            cells *= 2
        self.dims, self.cuts = kd_split(y, cells)
        placed = cut(self._placed(plain))
        self.blocks = {r["cell"]: -(-r["n"] // BLOCK) for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        self.table = placed.withColumn("sub", F.pmod(F.xxhash64("cid"), _of(self.blocks, "cell")).cast("int"))

    def _placed(self, plain: DataFrame) -> DataFrame:
        scale, project, dims, cuts = self.scale, self.project, self.dims, self.cuts

        def task(frames):
            for f in frames:
                if len(f):
                    y = project_rows(np.stack(f["v"].to_numpy()), scale, project)
                    yield f.assign(y=list(y), cell=cell_of(y, dims, cuts))

        return plain.mapInPandas(task, "cid long, ids array<long>, v array<double>, y array<double>, cell int")

    def _routed(self, queries: DataFrame, quantile: float, home: bool) -> DataFrame:
        """Queries with the cells to visit: the home cell, or all within the stopping radius of ``bound``."""
        project, dims, cuts, cells = self.project, self.dims, self.cuts, sorted(self.blocks)

        def task(frames):
            for f in frames:
                if not len(f):
                    continue
                y = project_queries(np.stack(f["v"].to_numpy()), project)
                near = cell_distances(y, dims, cuts)[:, cells]
                if home:
                    to = [[cells[int(c)]] for c in near.argmin(axis=1)]
                else:
                    within = near <= f["bound"].to_numpy()[:, None] * quantile
                    to = [[cells[c] for c in np.flatnonzero(w)] for w in within]
                yield f.assign(y=list(y), cells=to)

        out = queries.mapInPandas(task, "qid long, v array<double>, bound double, y array<double>, cells array<int>")
        return out.withColumn("cell", F.explode("cells")).drop("cells")

    def _visit(self, routed: DataFrame, quantile: float, all_blocks: bool, keep: int, schema: str, emit) -> DataFrame:
        """Co-group queries and blocks by (cell, sub, chunk) and search each pair."""
        if all_blocks:
            routed = routed.withColumn("sub", F.explode(F.sequence(F.lit(0), _of(self.blocks, "cell") - 1)))
        else:
            routed = routed.withColumn("sub", F.pmod(F.xxhash64("qid"), _of(self.blocks, "cell")).cast("int"))
        routed = cut(routed)
        chunks = {r["cell"]: -(-r["n"] // CHUNK) for r in routed.groupBy("cell", "sub").agg(F.count("*").alias("m"))
                  .groupBy("cell").agg(F.max("m").alias("n")).collect()}
        if not chunks:
            return self.table.sparkSession.createDataFrame([], schema)
        routed = routed.withColumn("chunk", F.pmod(F.xxhash64("qid", F.lit(1)), _of(chunks, "cell")).cast("int"))
        data = (self.table.where(F.col("cell").isin(list(chunks)))
                .withColumn("chunk", F.explode(F.sequence(F.lit(0), (_of(chunks, "cell") - 1).cast("int")))))
        scale = self.scale

        def task(queries, block):
            if not len(queries) or not len(block):
                return emit(None, None, None, None)
            v, x = np.stack(queries["v"].to_numpy()), np.stack(block["v"].to_numpy())
            unit = v / np.linalg.norm(v, axis=1, keepdims=True)
            rows, best = search_block(unit, np.stack(queries["y"].to_numpy()), queries["bound"].to_numpy(), x / scale,
                                      np.stack(block["y"].to_numpy()), block["cid"].to_numpy(), keep, quantile)
            return emit(queries, block, rows, best)

        keys = ["cell", "sub", "chunk"]
        return routed.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(task, schema)

    def search(self, queries: DataFrame, p: float = 0.97, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
        """query_id, rank, vec_id, score: the ``k`` best for each query, but for the entry's own id."""
        spark, k = queries.sparkSession, self.k
        empty = "query_id long, rank int, vec_id long, score double"
        if self.table is None:
            return spark.createDataFrame([], empty)
        rows, _ = usable(queries, id_col, vec_col, self.length)
        rows = cut(rows)
        distinct = cut(rows.groupBy("v").agg(F.min("id").alias("qid")))
        quantile = chi2_quantile(p)

        def bounds(queries, block, found, best):
            import pandas as pd
            if queries is None:
                return pd.DataFrame({"qid": np.zeros(0, np.int64), "bound": np.zeros(0)})
            return pd.DataFrame({"qid": queries["qid"], "bound": best[:, k] * (1 + 1e-9) + 1e-12})

        def results(queries, block, found, best):
            import pandas as pd
            if queries is None:
                return pd.DataFrame({"qid": np.zeros(0, np.int64), "ids": [], "score": np.zeros(0)})
            at, slot = np.nonzero((found >= 0) & (best <= queries["bound"].to_numpy()[:, None]))
            row = found[at, slot]
            v, x = np.stack(queries["v"].to_numpy())[at], np.stack(block["v"].to_numpy())[row]
            # left to right in double precision, so equal pairs have equal scores in every task
            score = np.cumsum(v * x, axis=1)[:, -1] if len(at) else np.zeros(0)
            return pd.DataFrame({"qid": queries["qid"].to_numpy()[at], "ids": block["ids"].to_numpy()[row], "score": score})

        start = distinct.select("qid", "v", F.lit(float("inf")).alias("bound"))
        first = self._visit(self._routed(start, quantile, True), quantile, False, k + 1, "qid long, bound double", bounds)
        bounded = cut(distinct.join(first, "qid").select("qid", "v", "bound"))
        found = self._visit(self._routed(bounded, quantile, False), quantile, True, k + 4, "qid long, ids array<long>, score double", results)
        w = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
        best = (found.withColumn("vec_id", F.explode("ids")).withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1)
                .groupBy("qid").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("best")))
        own = rows.join(distinct, "v").select(F.col("id").alias("query_id"), "qid").join(best, "qid")
        others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
        return (own.select("query_id", F.posexplode(others).alias("pos", "b"))
                .select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"),
                        (-F.col("b.s")).alias("score")))


def _of(table: dict[int, int], key: str) -> Column:
    """A number by cell (at most ``CELLS`` of them) as a column."""
    full = np.ones(max(table) + 1, dtype=np.int64)
    for cell, n in table.items():
        full[cell] = n
    return F.get(F.array(*[F.lit(int(n)) for n in full]), F.col(key))

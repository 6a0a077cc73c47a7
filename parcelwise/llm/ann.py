"""Approximate nearest neighbours by low-dimensional stable projections, indexed by kd-trees.

Vectors are projected to AXES dimensions by a seeded matrix of normal (2-stable) draws: the squared projected distance of
two vectors is their squared distance times a chi-square variable of AXES degrees of freedom. So a search takes projected
neighbours one after the other, nearest first, computes their true distances, and stops at a projected distance t once
t * t > quantile * d * d, d being the k-th best true distance so far and quantile that of chi-square at SURE: a vector
nearer than d would have been projected that far with a probability of 1 - SURE at most, so each of the k nearest is
found with a probability of SURE at least.

The index has two levels. A kd-tree over the projections of a sample (FIT vectors of smallest hashed id, a bounded set)
cuts the projected space into up to MOST_CELLS cells, which are broadcast; every row belongs to a cell. A cell's rows are
dealt into blocks of about BLOCK rows by a hash, so a cell that holds a third of all rows, or copies of one vector, is
many blocks; each task builds the kd-tree of a block. First a query searches the cell it lies in, which bounds its k-th
distance; then the cells that the stopping test doesn't exclude at that distance, with the bound carried along. Both
searches return at most k rows per query and block, and a query's best of all blocks are ranked by a window. Bounds and
stops of single blocks are never tighter than those of one search over all rows, so nothing is lost by blocks; there is no
cap on candidates.

Distances are summed over components in order, in double precision (scaled where that would leave its range). Vectors
that are null, empty, zero or hold null or non-finite components, and rows without vec_id, take no part. Vectors are
compared with queries of their own length. A row of the query's own vec_id is not its candidate; other repeated rows are
candidates each, and equal vectors are ties. A query that is repeated is asked once: its shortest vector, of those the
smallest. Ties go to the smaller vec_id, and are all seen. Empty tables, or no query, give no rows. Further columns,
whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.llm.common import pick, small_batches, stored
from parcelwise.llm.lattice import vectors_of

AXES, SURE = 8, 0.95
FIT, MOST_CELLS = 4096, 1024
#: Rows and queries of a block; points of a leaf of its kd-tree.
BLOCK, QUERIES, LEAF = 1024, 256, 32
_FAR = 1e150
_NEVER = (1 << 63) - 1
_HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
_KINDS = "vec_id long, dim int, vec array<double>, at array<double>"


def chi_square_quantile(p: float, degrees: int) -> float:
    """Of an even number of degrees: the distribution function is 1 - exp(-x / 2) * sum((x / 2) ** i / i!), i < degrees / 2."""
    upto = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))
    low, high = 0.0, 1.0
    while upto(high) < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if upto(mid) < p else (low, mid)
    return high


def projection(dim: int) -> np.ndarray:
    return np.random.default_rng([20240611, dim]).standard_normal((dim, AXES))


def project(x: np.ndarray) -> np.ndarray:
    """What would leave double precision when squared is moved to the end of the range: that only brings points nearer."""
    with np.errstate(all="ignore"):
        out = np.nan_to_num(x @ projection(x.shape[1]), nan=0.0, posinf=_FAR, neginf=-_FAR)
    return np.clip(out, -_FAR, _FAR)


def distances(q: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows a of q to rows b of x: squares are summed in the order of components, in double precision."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore", under="ignore"):
        for j in range(q.shape[1]):
            d = q[a, j] - x[b, j]
            total += d * d
    odd = np.flatnonzero(~np.isfinite(total) | (total < 1e-290))
    out = np.sqrt(total)
    if len(odd):  # beyond the range of squares, or all equal
        with np.errstate(all="ignore"):
            d = q[a[odd]] / 2 - x[b[odd]] / 2
            most = np.abs(d).max(1)
            scale = np.where(most > 0, most, 1.0)
            part = d / scale[:, None]
            out[odd] = np.minimum(np.sqrt((part * part).sum(1)) * scale * 2, np.finfo(float).max)
    return out


def kd_cells(points: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Splits (axis, value, by level; a heap of nodes) of a kd-tree with cells leaves, a power of two: each node is cut at
    the median of its widest axis, and a point whose coordinate is below the value goes left."""
    axis, value = np.zeros(max(cells - 1, 0), np.int64), np.zeros(max(cells - 1, 0))
    for node in range(cells - 1):
        own = points[_under(points, axis, value, node)]
        if len(own):
            axis[node] = np.argmax(own.max(0) - own.min(0))
            value[node] = np.median(own[:, axis[node]])
    return axis, value


def _under(points: np.ndarray, axis: np.ndarray, value: np.ndarray, node: int) -> np.ndarray:
    """Which points pass a node on their way down."""
    path = []
    while node:
        path.append(((node - 1) // 2, node % 2 == 1))
        node = (node - 1) // 2
    inside = np.ones(len(points), bool)
    for above, left in path:
        inside &= (points[:, axis[above]] < value[above]) == left
    return inside


def cell_of(points: np.ndarray, tree: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    axis, value = tree
    node = np.zeros(len(points), np.int64)
    for _ in range(int(math.log2(len(axis) + 1))):
        node = 2 * node + 1 + (points[np.arange(len(points)), axis[node]] >= value[node])
    return node - len(axis)


def cell_boxes(tree: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper corners of all cells; together they cover the whole space."""
    axis, value = tree
    low, high = np.full((1, AXES), -np.inf), np.full((1, AXES), np.inf)
    at = 0
    while at < len(axis):
        n = len(low)
        lows, highs = np.repeat(low, 2, 0), np.repeat(high, 2, 0)
        for k in range(n):
            a, v = axis[at + k], value[at + k]
            highs[2 * k, a] = min(highs[2 * k, a], v)
            lows[2 * k + 1, a] = max(lows[2 * k + 1, a], v)
        low, high, at = lows, highs, at + n
    return low, high


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes."""
    out = np.zeros((len(points), len(low)))
    for j in range(points.shape[1]):
        p = points[:, j][:, None]
        d = np.maximum(np.maximum(low[:, j][None] - p, p - high[:, j][None]), 0)
        out += d * d
    return out


def _leaves(points: np.ndarray) -> list[np.ndarray]:
    """The leaves of a balanced kd-tree: rows cut at the median of the widest axis until a leaf has LEAF points at most."""
    open_, done = [np.arange(len(points))], []
    while open_:
        rows = open_.pop()
        if len(rows) <= LEAF:
            done.append(rows)
            continue
        own = points[rows]
        axis = np.argmax(own.max(0) - own.min(0))
        order = rows[np.argpartition(own[:, axis], len(rows) // 2)]
        open_ += [order[: len(rows) // 2], order[len(rows) // 2 :]]
    return done


def _best(n: int, k: int, a: np.ndarray, ids: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest (d, id) of each of n queries, as matrices padded by infinity."""
    order = np.lexsort((ids, d, a))
    a, ids, d = a[order], ids[order], d[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    keep = rank < k
    best, names = np.full((n, k), np.inf), np.full((n, k), _NEVER)
    best[a[keep], rank[keep]], names[a[keep], rank[keep]] = d[keep], ids[keep]
    return best, names


def incremental(q: np.ndarray, x: np.ndarray, q_at: np.ndarray, x_at: np.ndarray, q_ids: np.ndarray, x_ids: np.ndarray, k: int, within: np.ndarray, quantile: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Up to k neighbours of each query, as places of queries, ids and distances, and how many pairs were verified. A
    block's leaves are opened in the order of their projected distance; what they hold is verified once no unopened leaf
    can hold a nearer projection, for many queries at a time, until the stopping test holds. within: distances that the
    k-th nearest is known not to exceed."""
    leaves = _leaves(x_at)
    low, high = np.stack([x_at[r].min(0) for r in leaves]), np.stack([x_at[r].max(0) for r in leaves])
    found, verified = [], 0
    for at in range(0, len(q), QUERIES):
        some = slice(at, at + QUERIES)
        n = len(q[some])
        near = box_distances(q_at[some], low, high)
        order = np.argsort(near, axis=1, kind="stable")
        near = np.concatenate([np.take_along_axis(near, order, 1), np.full((n, 1), np.inf)], 1)
        best, names = np.full((n, k), np.inf), np.full((n, k), _NEVER)
        waiting = np.full((n, len(x)), np.inf)  # projected distances of opened points that aren't verified yet
        active, step = np.arange(n), 0
        while len(active) and step < len(leaves):
            limit = _reach(np.minimum(best[active, k - 1], within[some][active]), quantile)
            going = near[active, step] <= limit
            active, limit = active[going], limit[going]
            if not len(active):
                break
            opened = order[active, step]
            for leaf in np.unique(opened).tolist():
                rows = active[opened == leaf]
                waiting[np.ix_(rows, leaves[leaf])] = _projected(q_at[some][rows], x_at[leaves[leaf]])
            a, b = np.nonzero(waiting[active] <= np.minimum(np.minimum(near[active, step + 1], limit), np.finfo(float).max)[:, None])
            a = active[a]
            waiting[a, b] = np.inf
            other = q_ids[some][a] != x_ids[b]
            a, b = a[other], b[other]
            verified += len(a)
            if len(a):
                d = distances(q[some], x, a, b)
                good = d <= np.minimum(best[a, k - 1], within[some][a] * (1 + 1e-12))
                a, b, d = a[good], b[good], d[good]
                newer, newer_names = _best(n, k, a, x_ids[b], d)
                both, both_names = np.concatenate([best, newer], 1), np.concatenate([names, newer_names], 1)
                pick_ = np.lexsort((both_names, both))[:, :k]
                best, names = np.take_along_axis(both, pick_, 1), np.take_along_axis(both_names, pick_, 1)
            step += 1
        a, c = np.nonzero(np.isfinite(best))
        found.append((a + at, names[a, c], best[a, c]))
    return *[np.concatenate(c) for c in zip(*found, strict=True)], verified


def _reach(d: np.ndarray, quantile: float) -> np.ndarray:
    """The squared projected distance beyond which the stopping test holds, with a slack for rounding."""
    with np.errstate(over="ignore"):
        return d * d * quantile * (1 + 1e-9) + 1e-18


def _projected(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        d = a[:, j][:, None] - b[:, j][None]
        out += d * d
    return out


def _array(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))


def _matrix(column) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = np.concatenate([c.flatten().to_numpy() for c in chunks]) if chunks else np.zeros(0)
    return flat.reshape(len(column), -1)


def _vectors(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dim, (rows, x) in vectors_of(batch.column("embedding"))[1].items():
            rows, x = rows[(x != 0).any(1)], x[(x != 0).any(1)]
            ids = batch.column("vec_id").take(pa.array(rows))
            yield pa.record_batch([ids, pa.array(np.full(len(rows), dim, np.int32)), _array(x), _array(project(x))], names=["vec_id", "dim", "vec", "at"])


def _cells(trees: dict):
    """Adds cell: where the projection lies."""

    def run(batches):
        for batch in batches:
            out, dims = np.zeros(batch.num_rows, np.int32), batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                if dim in trees:
                    out[rows] = cell_of(_matrix(batch.column("at").take(pa.array(rows))), trees[dim])
            yield pa.record_batch([*batch.columns, pa.array(out)], names=[*batch.schema.names, "cell"])

    return run


def _further(trees: dict, quantile: float):
    """A row of each query for each cell that it must still see: not its own, and not beyond the stopping test."""

    def run(batches):
        boxes = {dim: cell_boxes(tree) for dim, tree in trees.items()}
        for batch in batches:
            dims, home, within = (batch.column(c).to_numpy() for c in ("dim", "cell", "within"))
            for dim in np.unique(dims).tolist():
                if dim not in trees:
                    continue
                for rows in np.array_split(np.flatnonzero(dims == dim), -(-batch.num_rows // QUERIES)):
                    near = box_distances(_matrix(batch.column("at").take(pa.array(rows))), *boxes[dim])
                    near[np.arange(len(rows)), home[rows]] = np.inf
                    a, cell = np.nonzero((near <= _reach(within[rows], quantile)[:, None]) & (near < np.inf))
                    for some in np.array_split(np.arange(len(a)), max(1, len(a) // BLOCK)):
                        out = batch.take(pa.array(rows[a[some]]))
                        yield out.set_column(out.schema.get_field_index("cell"), "cell", pa.array(cell[some].astype(np.int32)))

    return run


def _search(k: int, quantile: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _HITS.empty_table()
        q_ids, x_ids = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        q, x, q_at, x_at = (_matrix(t.column(c)) for c in ("vec", "at") for t in (left, right))
        a, ids, d, _ = incremental(q, x, q_at, x_at, q_ids, x_ids, k, left.column("within").to_numpy(), quantile)
        return pa.Table.from_arrays([pa.array(q_ids[a]), pa.array(ids), pa.array(d)], schema=_HITS)

    return run


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, is_query: str, k: int = 10, sure: float = SURE, block: int = BLOCK, fit: int = FIT) -> DataFrame:
    """(query_id, rank, vec_id, score) over vectors(vec_id, embedding); is_query: a condition on vec_id; score: the
    Euclidean distance."""
    small_batches(vectors.sparkSession)
    quantile = chi_square_quantile(sure, AXES)
    given = pick(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where("vec_id is not null")
    n_rows = given.count()
    some = given.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n_rows))) < 4 * fit)  # about 4 * fit rows, so that no task sorts more
    sample = some.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit).mapInArrow(_vectors, _KINDS).select("dim", "at").toArrow()  # fit rows at most
    cells = 1 << max(0, min(MOST_CELLS, n_rows // block).bit_length() - 1)
    dims = sample.column("dim").to_numpy()
    trees = {d: kd_cells(_matrix(sample.column("at").filter(pa.array(dims == d))), cells) for d in np.unique(dims).tolist()}

    rows, _ = stored(given.mapInArrow(_vectors, _KINDS).mapInArrow(_cells(trees), _KINDS + ", cell int").withColumn("row", F.monotonically_increasing_id()), "index")
    of_blocks = rows.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min(F.struct("dim", "vec", "at", "cell")).alias("q")).select("vec_id", "q.*")
    asked, _ = stored(asked, "queries")

    def searched(queries: DataFrame) -> DataFrame:
        """Queries(vec_id, dim, vec, at, cell, within) meet the rows of their cell, in blocks of both."""
        sides = queries.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("groups")).join(of_blocks, ["dim", "cell"])
        sides, _ = stored(sides.coalesce(1), "sides")  # a row per cell; Spark broadcasts it by the file's size
        deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = queries.join(sides, ["dim", "cell"]).withColumn("qb", deal("vec_id", "groups")).withColumn("xb", every("blocks")).drop("groups", "blocks")
        right = rows.join(sides, ["dim", "cell"]).withColumn("xb", deal("row", "blocks")).withColumn("qb", every("groups")).drop("groups", "blocks", "row")
        keys = ["dim", "cell", "qb", "xb"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(k, quantile), "query_id long, vec_id long, score double")

    home, _ = stored(_ranked(searched(asked.withColumn("within", F.lit(float("inf")))), k).drop("rank"), "home")
    within = home.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.max("score")).alias("within"))
    known = asked.join(within, "vec_id", "left").withColumn("within", F.coalesce("within", F.lit(float("inf"))))
    others, _ = stored(known.mapInArrow(_further(trees, quantile), _KINDS + ", cell int, within double"), "further")
    return _ranked(home.unionByName(searched(others)), k).select("query_id", "rank", "vec_id", "score")

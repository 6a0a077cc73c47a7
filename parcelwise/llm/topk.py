"""Exact top-k search by multi-resolution segment statistics.

A vector is cut into segments, coarse to fine; of each segment its mean and deviation are kept. For a query q and a
vector x the squared distance is at least the sum over segments of l * ((mean_q - mean_x) ** 2 + (dev_q - dev_x) ** 2),
l being the segment's length; with the vectors' norms that bounds the inner product from above by the sum of
l * (mean_q * mean_x + dev_q * dev_x). Pairs whose bound is below the query's threshold are dropped, level by level, and
survivors are computed exactly. Bounds get a slack for rounding, so nothing is lost.

Thresholds hold across blocks: first every query is searched in a pilot of PILOT vectors (those of smallest hashed id,
a bounded set, broadcast), whose k-th best product is a lower bound of its k-th best of all. It goes with the query to
every block, where the vectors of highest coarse bound may raise it further. The pilot changes what is dropped early,
never a result. Queries and vectors meet in blocks of bounded size (a stated query set against all rows): a task gets
one block of each, and returns at most k rows per query; a query's best of all blocks are ranked by a window.

Components x become floor(256 * x), whole numbers held in double precision. Products are summed in double precision
where that is exact (below 2 ** 53), else in 64 bits, else in whole numbers of any size; scores beyond 64 bits are set
to the largest (smallest) long. Vectors that are null, empty or hold null or non-finite components, and rows without
vec_id, take no part. Vectors are compared with queries of their own length. A row of the query's own vec_id is not
its candidate; other repeated rows are candidates each. A query that is repeated is asked once: its shortest vector,
of those the smallest. Ties go to the smaller vec_id. Empty tables give no rows. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.llm.common import pick, small_batches, stored
from parcelwise.llm.lattice import vectors_of

#: Segments of each level.
LEVELS = (4, 16)
BLOCK, QUERIES, PILOT = 2048, 256, 1024
#: The share of a block's pairs beyond which they are computed at once.
DENSE = 1 / 16
_MOST = (1 << 63) - 1
#: Beyond this a component's square leaves double precision; such blocks are computed without bounds.
_HUGE = 1e150
_HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def whole(x: np.ndarray) -> np.ndarray:
    """floor(256 * x); what would leave double precision is kept below its end."""
    return np.clip(np.floor(256 * np.clip(x, -7e305, 7e305)), -1.7e308, 1.7e308)


def _integers(batches):
    for batch in batches:
        for _, (rows, x) in vectors_of(batch.column("embedding"))[1].items():
            dim = x.shape[1]
            ids = batch.column("vec_id").take(pa.array(rows))
            vec = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * dim), pa.array(whole(x).ravel()))
            yield pa.record_batch([ids, pa.array(np.full(len(rows), dim, np.int32)), vec], names=["vec_id", "dim", "vec"])


def _matrix(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = table.column("vec")
    flat = np.concatenate([c.flatten().to_numpy() for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column])])
    return table.column("vec_id").to_numpy(), flat.reshape(table.num_rows, -1)


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, each times the root of the segment's length, so that the product of two
    rows is the bound."""
    edge = np.unique(np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int))
    n = np.diff(edge)
    mean = np.add.reduceat(x, edge[:-1], 1) / n
    var = np.add.reduceat(x * x, edge[:-1], 1) / n - mean**2
    return np.concatenate([mean, np.sqrt(np.maximum(var, 0))], 1) * np.sqrt(np.concatenate([n, n]))


def products(q: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows a of q with rows b of x, as longs."""
    most = float(np.abs(q).max(initial=0)) / 2.0**53 * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 1:
        return np.einsum("pd,pd->p", q[a], x[b]).astype(np.int64)
    if most < 2.0**9:
        return np.einsum("pd,pd->p", q.astype(np.int64)[a], x.astype(np.int64)[b])
    left, right = [list(map(int, r)) for r in q.tolist()], [list(map(int, r)) for r in x.tolist()]
    out = [sum(u * v for u, v in zip(left[i], right[j], strict=True)) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    return np.array([max(-_MOST, min(_MOST, s)) for s in out], np.int64)


def search(q: np.ndarray, x: np.ndarray, q_ids: np.ndarray, x_ids: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """For each query its k best (all, if fewer) by product, then id, of those not below its threshold: query's place,
    vector's place, product. And how many pairs there were, and were left after each level that was applied."""
    left = [0] * (len(LEVELS) + 1)
    least = np.full(len(q), -np.inf) if least is None else least.astype(float)
    bounded = max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) < _HUGE
    fx = [segment_statistics(x, s) for s in LEVELS] if bounded else []
    norm = np.sqrt((x * x).sum(1).max(initial=0)) if bounded else np.inf
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] if bounded else np.inf
    found = []
    for at in range(0, len(q), QUERIES):
        some, floor = q[at : at + QUERIES], least[at : at + QUERIES]
        own = q_ids[at : at + QUERIES, None] == x_ids[None, :]
        left[0] += own.size - int(own.sum())
        if bounded:
            fq = [segment_statistics(some, s) for s in LEVELS]
            slack = 1e-9 * np.sqrt((some * some).sum(1)) * norm + 1e-3
            bound = fq[0] @ fx[0].T
            bound[own] = -np.inf
            if len(x) > 4 * k:
                seeds = np.argpartition(-bound, 4 * k, axis=1)[:, : 4 * k]
                exact = np.einsum("qd,qsd->qs", some, x[seeds])
                exact[np.take_along_axis(own, seeds, 1)] = -np.inf
                floor = np.maximum(floor, np.partition(exact, 3 * k, axis=1)[:, 3 * k])  # the k-th largest of 4 k
            floor = np.where(floor < -9.2e18, -np.inf, np.minimum(floor, 9.2e18)) - slack  # scores end there, and then tie
            qi, xi = np.nonzero((bound >= floor[:, None]) & ~own)
        else:
            fq, floor = [], np.full(len(some), -np.inf)
            qi, xi = np.nonzero(~own)
        left[1] += len(qi)
        if bounded and len(qi) > own.size * DENSE and most < 2.0**53:  # so many are left that one matrix product is less work
            exact = some @ x.T
            exact[(bound < floor[:, None]) | own] = -np.inf
            kth = np.partition(exact, max(0, len(x) - k), axis=1)[:, max(0, len(x) - k)] if len(x) else floor
            a, b = np.nonzero((exact >= kth[:, None]) & (exact > -np.inf))
            found.append((a + at, b, exact[a, b].astype(np.int64)))
            continue
        for c in range(0, len(qi), 1 << 16):
            a, b = qi[c : c + (1 << 16)], xi[c : c + (1 << 16)]
            for level in range(1, len(fq)):
                good = np.einsum("pd,pd->p", fq[level][a], fx[level][b]) >= floor[a]
                a, b = a[good], b[good]
                left[level + 1] += len(a)
            found.append((a + at, b, products(some, x, a, b)))
    none = np.zeros(0, np.int64)
    qi, xi, score = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (none, none, none)
    order = np.lexsort((x_ids[xi], -score, qi))
    qi, xi, score = qi[order], xi[order], score[order]
    best = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
    return qi[best], xi[best], score[best], left


def _thresholds(pilot: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """Adds least: the k-th best product of each query in the pilot of its length, if that has k other vectors."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = np.full(batch.num_rows, -np.inf)
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                if dim in pilot:
                    ids, q = _matrix(batch.take(pa.array(rows)))
                    x_ids, x = pilot[dim]
                    qi, _, score, _ = search(q, x, ids, x_ids, k)
                    count = np.bincount(qi, minlength=len(rows))
                    last = np.cumsum(count) - 1
                    full = count == k
                    least[rows[full]] = score[last[full]]
            yield pa.record_batch([*batch.columns, pa.array(least)], names=[*batch.schema.names, "least"])

    return run


def _search_blocks(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _HITS.empty_table()
        q_ids, q = _matrix(left)
        x_ids, x = _matrix(right)
        qi, xi, score, _ = search(q, x, q_ids, x_ids, k, left.column("least").to_numpy())
        return pa.Table.from_arrays([pa.array(q_ids[qi]), pa.array(x_ids[xi]), pa.array(score)], schema=_HITS)

    return run


def top_k(vectors: DataFrame, is_query: str, k: int = 5, block: int = BLOCK, pilot: int = PILOT) -> DataFrame:
    """(query_id, rank, vec_id, score) over vectors(vec_id, embedding); is_query: a condition on vec_id."""
    small_batches(vectors.sparkSession)
    rows = pick(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where("vec_id is not null")
    kinds = "vec_id long, dim int, vec array<double>"
    every = rows.mapInArrow(_integers, kinds)
    asked = rows.where(is_query).mapInArrow(_integers, kinds).groupBy("vec_id").agg(F.min(F.struct("dim", "vec")).alias("q")).select("vec_id", "q.*")
    first = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pilot).mapInArrow(_integers, kinds).toArrow()  # pilot rows at most
    known = {d: _matrix(first.filter(pa.compute.equal(first.column("dim"), d))) for d in set(first.column("dim").to_pylist())}
    asked, _ = stored(asked.mapInArrow(_thresholds(known, k), kinds + ", least double"), "queries")
    n_rows, n_asked = rows.count(), asked.count()  # two numbers
    xs, qs = max(1, -(-n_rows // block)), max(1, -(-n_asked // block))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("qb", deal(qs)).withColumn("xb", all_of(xs))
    right = every.withColumn("xb", deal(xs)).withColumn("qb", all_of(qs))
    keys = ["dim", "qb", "xb"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search_blocks(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

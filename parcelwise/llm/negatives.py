"""Hard negatives of anchors, mined through a vector-approximation file.

Each dimension is cut into up to CELLS cells, whose edges are quantiles of a sample (FIT vectors of smallest hashed id, a
bounded set), with an outer cell on either side; the approximation of a vector is one byte a dimension: its cell. For an
anchor a table of the least and the greatest product of each dimension and cell is made; looked up with a vector's codes
and summed, it bounds the vector's score from below and above without reading the vector. A vector with a component beyond
the outer cells has no bounds and is scored. The sample changes how tight bounds are, never a result.

A window is a range of scores of which the k best are asked. A vector is scored only if its upper bound reaches the
window, and the k-th best lower bound of vectors that are surely inside it, and its lower bound isn't above it; so a window
costs the few vectors that may enter it. Positives of an anchor come first: one window over all scores, of rows with the
anchor's label. Each distinct score of a positive then opens a window, from LOW / 100 of it up to it, over rows of other
labels; positives of one score share it.

Anchors and rows meet in blocks (a stated query set against all rows): a task gets the approximations and vectors of about
BLOCK rows, dealt by a stored row number, and as many anchors, and returns at most k rows a window; the best of all blocks
are ranked by a window function. Labels are compared within blocks and never a key, so a label may hold all rows.

Components x become floor(256 * x), whole numbers held in double precision; scores are exact (see
topk.products; beyond 64 bits they are set to the largest or smallest long). Rows
without vec_id or label, and vectors that are null, empty or hold null or non-finite components, take no part. Vectors are
compared with anchors of their own length. A row of the anchor's own vec_id is not its candidate; other repeated rows are
candidates each, and a repeated positive is returned as often as it was picked. A repeated anchor is asked once: its
shortest vector, of those the smallest, then the smallest label. Ties go to the smaller vec_id. A positive of a negative
score has an empty window. Empty tables give no rows. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.llm.common import pick, small_batches, stored
from parcelwise.llm.lattice import vectors_of
from parcelwise.llm.topk import products, whole

CELLS, FIT, BLOCK = 64, 1024, 2048
#: A negative scores at least so many hundredths of its positive.
LOW = 80
_MOST = (1 << 63) - 1
_HITS = pa.schema([("anchor_id", pa.int64()), ("high", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_KINDS = "vec_id long, label long, dim int, vec array<double>"


def cell_edges(sample: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Ascending edges of each dimension's cells, a row each; shorter rows repeat their last edge."""
    inner = np.floor(np.quantile(sample, np.linspace(0, 1, cells - 1), axis=0)).T
    low, high = sample.min(0), sample.max(0)
    reach = np.floor((high - low) / 2) + 1
    return np.sort(np.concatenate([(low - reach)[:, None], inner, (high + 1)[:, None], (high + 1 + reach)[:, None]], 1), axis=1)


def codes_of(x: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each component, and which rows have one beyond the cells."""
    codes, loose = np.empty(x.shape, np.uint8), np.zeros(len(x), bool)
    for j in range(x.shape[1]):
        c = np.searchsorted(edges[j], x[:, j], "right") - 1
        beyond = (c < 0) | (c >= edges.shape[1] - 1)
        loose |= beyond
        codes[:, j] = np.where(beyond, 0, c)
    return codes, loose


class Bounds:
    """Tables of an anchor: products with the ends of each cell, whose values are whole numbers."""

    def __init__(self, edges: np.ndarray):
        self.low, self.high = edges[:, :-1], np.maximum(edges[:, 1:] - 1, edges[:, :-1])
        self.place = (np.arange(len(edges)) * self.low.shape[1]).astype(np.intp)

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = q[:, None] * self.low, q[:, None] * self.high
        return np.minimum(a, b).ravel(), np.maximum(a, b).ravel()

    def look_up(self, table: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return table[codes + self.place].sum(1)


def possible(q: np.ndarray, bounds: Bounds, codes: np.ndarray, loose: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Rows that may be among the k best of some window [low, high] of scores."""
    least, most = bounds.tables(q)
    upper = np.where(loose, np.inf, bounds.look_up(most, codes))
    rows = np.flatnonzero(upper >= low.min())
    upper, lower = upper[rows], np.where(loose[rows], -np.inf, bounds.look_up(least, codes[rows]))
    wanted = np.zeros(len(rows), bool)
    for a, b in zip(low.astype(float).tolist(), high.astype(float).tolist(), strict=True):
        sure = lower[(lower >= a) & (upper <= b)]
        floor = np.partition(sure, len(sure) - k)[len(sure) - k] if len(sure) >= k else -np.inf
        wanted |= (upper >= max(a, floor)) & (lower <= b)
    return rows[wanted]


def mined(anchors: dict, rows: dict, edges: np.ndarray | None, same: bool, k: int) -> tuple[list, int]:
    """(anchor's place, high, ids, scores) of each window's k best rows of the anchor's label (same) or of others; and how
    many pairs were scored. anchors: ids, labels, x, low, high (lists of windows); rows: ids, labels, x, codes, loose."""
    q, x = anchors["x"], rows["x"]
    most = float(np.abs(q).max(initial=0)) / 2.0**53 * float(max(np.abs(x).max(initial=0), 0 if edges is None else np.abs(edges).max())) * x.shape[1]
    bounds = Bounds(edges) if edges is not None and most < 1 else None
    found, scored = [], 0
    for i in range(len(q)):
        low, high = anchors["low"][i], anchors["high"][i]
        if not len(low):
            continue
        at = np.flatnonzero(((rows["labels"] == anchors["labels"][i]) == same) & (rows["ids"] != anchors["ids"][i]))
        if bounds:
            at = at[possible(q[i], bounds, rows["codes"][at], rows["loose"][at], low, high, k)]
        scored += len(at)
        score = products(q[i : i + 1], x[at], np.zeros(len(at), np.int64), np.arange(len(at)))
        order = np.lexsort((rows["ids"][at], -score))
        at, score = at[order], score[order]
        for a, b in zip(low.tolist(), high.tolist(), strict=True):
            good = np.flatnonzero((score >= a) & (score <= b))[:k]
            found.append((i, b, rows["ids"][at[good]], score[good]))
    return found, scored


def _matrix(column, kind=float) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in chunks])
    return flat.astype(kind, copy=False).reshape(len(column), -1)


def _vectors(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dim, (rows, x) in vectors_of(batch.column("embedding"))[1].items():
            vec = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * dim), pa.array(whole(x).ravel()))
            same = [batch.column(c).take(pa.array(rows)) for c in ("vec_id", "label")]
            yield pa.record_batch([*same, pa.array(np.full(len(rows), dim, np.int32)), vec], names=["vec_id", "label", "dim", "vec"])


def _coded(edges: dict[int, np.ndarray]):
    """Adds the approximation: codes, a byte a dimension, and loose."""

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            codes, loose = [b""] * batch.num_rows, np.ones(batch.num_rows, bool)
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                if dim in edges:
                    c, loose[rows] = codes_of(_matrix(batch.column("vec").take(pa.array(rows))), edges[dim])
                    for r, code in zip(rows.tolist(), c, strict=True):
                        codes[r] = code.tobytes()
            yield pa.record_batch([*batch.columns, pa.array(codes, pa.binary()), pa.array(loose)], names=[*batch.schema.names, "codes", "loose"])

    return run


def _search(edges: dict[int, np.ndarray], same: bool, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _HITS.empty_table()
        own = edges.get(left.column("dim")[0].as_py())
        anchors = {"ids": left.column("vec_id").to_numpy(), "labels": left.column("label").to_numpy(), "x": _matrix(left.column("vec"))}
        anchors |= {c: [np.array(v, np.int64) for v in left.column(c).to_pylist()] for c in ("low", "high")}
        rows = {"ids": right.column("vec_id").to_numpy(), "labels": right.column("label").to_numpy(), "x": _matrix(right.column("vec"))}
        if own is not None:
            rows |= {"codes": np.frombuffer(b"".join(right.column("codes").to_pylist()), np.uint8).reshape(right.num_rows, -1), "loose": right.column("loose").to_numpy()}
        found, _ = mined(anchors, rows, own, same, k)
        if not found:
            return _HITS.empty_table()
        n = [len(f[2]) for f in found]
        columns = [np.repeat(anchors["ids"][[f[0] for f in found]], n), np.repeat(np.array([f[1] for f in found], np.int64), n), np.concatenate([f[2] for f in found]), np.concatenate([f[3] for f in found])]
        return pa.Table.from_arrays([pa.array(c) for c in columns], schema=_HITS)

    return run


def _best(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("anchor_id", "high").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: str, positives: int = 5, negatives: int = 5, low: int = LOW, block: int = BLOCK, fit: int = FIT) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over vectors(vec_id, embedding, label);
    is_anchor: a condition on vec_id. low: in hundredths, from 0 to 100."""
    small_batches(vectors.sparkSession)
    given = pick(vectors, "vec_id", "embedding", "label").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("label").cast("long")).where("vec_id is not null and label is not null")
    n_rows = given.count()
    some = given.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n_rows))) < 4 * fit)  # about 4 * fit rows, so that no task sorts more
    sample = some.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit).mapInArrow(_vectors, _KINDS).select("dim", "vec").toArrow()  # fit rows at most
    dims = sample.column("dim").to_numpy()
    edges = {d: cell_edges(_matrix(sample.column("vec").filter(pa.array(dims == d)))) for d in np.unique(dims).tolist()}

    rows, _ = stored(given.mapInArrow(_vectors, _KINDS).mapInArrow(_coded(edges), _KINDS + ", codes binary, loose boolean").withColumn("row", F.monotonically_increasing_id()), "approximations")
    asked = rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("dim", "vec", "label")).alias("q")).select("vec_id", "q.*")
    asked, _ = stored(asked, "anchors")
    xs, qs = max(1, -(-n_rows // block)), max(1, -(-asked.count() // block))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys = ["dim", "qb", "xb"]

    def searched(anchors: DataFrame, same: bool, k: int) -> DataFrame:
        left = anchors.withColumn("qb", deal("vec_id", qs)).withColumn("xb", every(xs))
        right = rows.withColumn("xb", deal("row", xs)).withColumn("qb", every(qs)).drop("row")
        return _best(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(edges, same, k), "anchor_id long, high long, vec_id long, score long"), k)

    longs = lambda *c: F.array(*c).cast("array<long>")
    like = searched(asked.withColumn("low", longs(F.lit(-_MOST))).withColumn("high", longs(F.lit(_MOST))), True, positives)
    like, _ = stored(like.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("positive_rank")), "positives")
    windows = like.where("positive_score >= 0").groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_set("positive_score")).alias("high"))  # at most `positives` scores
    windows = windows.withColumn("low", F.transform("high", lambda s: _share(s, low)))
    unlike = searched(asked.join(windows, "vec_id"), False, negatives)
    return like.join(unlike.withColumnRenamed("high", "positive_score"), ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def _share(score: Column, hundredths: int) -> Column:
    """The least whole number of which 100 times is at least hundredths times a score that isn't negative."""
    return F.ceil(score.cast("decimal(20,0)") * hundredths / F.lit(100).cast("decimal(3,0)")).cast("long")

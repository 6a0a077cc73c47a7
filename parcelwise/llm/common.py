"""Shared pieces: the cluster's shared folder, vectorised word hashing, connected components.

Words are split on ASCII white space (space and 0x09-0x0D) and hashed to 64 bits with numpy over whole
Arrow buffers, so no Python object is made per word.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are hashed at once; bounds the workers' memory.
PIECE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_P = np.uint64(0x9E3779B97F4A7C15)
#: The bytes of a lane of 8 that are a word's, by their number.
_HELD = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
#: Rows and bytes of an Arrow batch between the JVM and a Python worker, where the session has Spark's defaults.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
_kept: dict = {}


def kept(owner: str, key, make: Callable):
    """What a Python worker makes once and uses again, for one operator at a time: workers live on through a job of many
    operators, and one that goes on to another operator gives back what the last one left."""
    if _kept.get("owner") != owner:
        _kept.clear()
        give_back()
        _kept["owner"] = owner
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches that are sent to Python workers, as several workers share an executor's memory. A session that
    has set the limits itself keeps them."""
    for name, own in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(own))



def pick(df: DataFrame, *names: str, cast: dict[str, str] | None = None) -> DataFrame:
    """The named columns alone, of the kinds asked for. Found by their exact names, so that further columns, whatever
    theirs, do no harm. Columns that are right already are passed on as they are: then plans that read them twice
    can share a shuffle."""
    if len({c.lower() for c in df.columns}) < len(df.columns):
        at = [df.columns.index(n) for n in names]
        df = df.toDF(*[f"_{i}" for i in range(len(df.columns))]).select(*[F.col(f"_{i}").alias(n) for i, n in zip(at, names, strict=True)])
    kinds = dict(df.dtypes)
    return df.select(*[F.col(f"`{n}`").cast(cast[n]).alias(n) if cast and kinds[n] != cast.get(n, kinds[n]) else F.col(f"`{n}`") for n in names])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and Spark
    runs on this machine alone; elsewhere that is an error, as executors don't see each other's disks."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="parcelwise-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Writes df to the shared folder and rereads it: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a table of stored() that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offs, data = column.buffers()
    at = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def hash_words(raw: np.ndarray, at: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts that lie one after the other: start, end and 64-bit hash of each word, and each text's
    first word (one more entry than texts)."""
    n = len(raw)
    if lower:
        raw = _LOWER[raw]
    space = _SPACE[raw]
    first = np.zeros(n + 1, bool)
    first[at] = True
    before = np.ones(n, bool)
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & (before | first[:n]))
    after = np.ones(n, bool)
    after[:-1] = space[1:]
    ends = np.flatnonzero(~space & (after | first[1:])) + 1
    return starts, ends, word_hashes(raw, starts, ends), np.searchsorted(starts, at)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of words, seed by seed independent: a word's lanes of 8 bytes are each mixed with their place, summed, and
    mixed with the word's length. No structure of a word (repetition, swapped parts) makes two words alike."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))  # the 8 bytes from each place on
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):  # about PIECE bytes at a time
        last = max(k + 1, int(np.searchsorted(ends, starts[k] + PIECE, "right")))
        size = ends[k:last] - starts[k:last]
        lanes = (size + 7) >> 3
        head = np.cumsum(lanes) - lanes
        place = np.arange(int(lanes.sum())) - np.repeat(head, lanes)
        value = eight[np.repeat(starts[k:last], lanes) + 8 * place] & _HELD[np.minimum(np.repeat(size, lanes) - 8 * place, 8)]
        value = mix(value ^ mix((place.astype(np.uint64) * np.uint64(4) + np.uint64(seed)) * _P + np.uint64(1)))
        out[k:last] = mix(np.add.reduceat(value, head) + mix(size.astype(np.uint64) + _P))
        k = last
    return out


def grams(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hashes of n words in a row, at each place where n words follow."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i, q in enumerate(np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64)):
        out += words[i : i + m] * (q * np.uint64(2) + np.uint64(1))
    return mix(out)


def give_back() -> None:
    """Returns freed memory to the system: a worker waits for its next task, beside other workers, with what it holds."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about PIECE bytes of text each; a longer text is alone."""
    col = batch.column(column)
    if not batch.num_rows:
        return
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    k = 0
    while k < batch.num_rows:
        base = ends[k - 1] if k else 0
        last = max(k + 1, int(np.searchsorted(ends, base + PIECE, "right")))
        yield batch.slice(k, last - k)
        k = last


def by_text(column: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch]):
    """A mapInArrow function that applies fn to bounded slices of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                yield fn(part)
        give_back()

    return run


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components as (id, component): component is the smallest id reachable, for each id in a link.

    Large-star and small-star rounds: each round relinks a node's larger neighbours, then its smaller ones, to its
    smallest neighbour, with partial aggregation; a hub's links are only ever grouped through min(). Each round is
    written to the shared folder, so that neither lineage nor driver state grows. Ends when a round changes nothing
    (links are stars then), which takes a number of rounds logarithmic in the diameter.
    """
    spark = links.sparkSession
    edges, path = stored(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    mark = None
    while True:
        # large star: neighbours larger than u go to u's smallest neighbour (itself included)
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and u itself go to the smallest neighbour
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges, newer = stored(small, "edges")
        drop_path(spark, path)
        path = newer
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).union(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )

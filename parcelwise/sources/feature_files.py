"""Feature collections as files: a sink, and a scan of any byte range.

The sink is a Spark data source. Each task writes one FeatureCollection of its rows under a name of its own attempt, in a
folder that readers pass over; when all tasks have succeeded the driver moves the files of the successful attempts beside
it, and drops the folder with what others left. A run that fails leaves nothing that is read.

The scan cuts files into byte ranges, one task each. Whether a byte stands in a string, and how deep, depends on all before
it; so a first pass sums each range up for both cases (begun outside or inside a string): the change of depth, the least
depth, and where the key "features" opens an array. A fold over a file's ranges, a small row each, gives each range the
state it begins in, and a second pass returns the features that begin in it, reading on to the end of the last. So any
split gives the same rows, whatever stands in strings. A file without a collection is one feature. A file that ends inside
a string or an object is an error. Only the parts of features that are used are parsed (Spark prunes from_json).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

SPLIT, AHEAD = 16 << 20, 1 << 16
_KEY = b'"features"'
_TURN = np.zeros(256, np.int8)
_TURN[[ord("{"), ord("[")]], _TURN[[ord("}"), ord("]")]] = 1, -1


def _files(path: str):
    """A file system that executors open too, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path if ":" in path.split("/")[0] else f"file://{path}"))


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


class CollectionWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex
        self.draft = f"_attempts-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        name, rows = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.geojson", 0
        files, path = _files(self.path)
        files.create_dir(f"{path}/{self.draft}", recursive=True)
        with files.open_output_stream(f"{path}/{self.draft}/{name}") as out:
            out.write(b'{"type":"FeatureCollection","features":[\n')
            for batch in iterator:
                for text in batch.column(0).to_pylist():
                    out.write((b",\n" if rows else b"") + text.encode())
                    rows += 1
            out.write(b"\n]}\n")
        return Written(name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        files, path = _files(self.path)
        files.create_dir(path, recursive=True)
        old = [f.path for f in files.get_file_info(fs.FileSelector(path)) if f.is_file and self.overwrite]
        for m in messages:
            if m is not None and m.rows:
                files.move(f"{path}/{self.draft}/{m.name}", f"{path}/{m.name.removesuffix('.geojson')}-{self.job}.geojson")
        for name in old:
            files.delete_file(name)
        self._drop()

    def abort(self, messages: list[Written | None]) -> None:
        self._drop()

    def _drop(self) -> None:
        from pyarrow import fs

        files, path = _files(self.path)
        if files.get_file_info(f"{path}/{self.draft}").type == fs.FileType.Directory:
            files.delete_dir(f"{path}/{self.draft}")


class FeatureCollections(DataSource):
    """Format feature_collections: rows (value string), a feature's text each; option path."""

    @classmethod
    def name(cls) -> str:
        return "feature_collections"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> CollectionWriter:
        return CollectionWriter(self.options["path"], overwrite)


def feature_text(id_: Column, kind: Column, coordinates: Column, properties: Column) -> Column:
    """A feature as JSON, from coordinates as JSON text; one without a kind has no geometry. Null fields are kept."""
    shape = F.when(kind.isNotNull(), F.struct(kind.alias("type"), F.parse_json(coordinates).alias("coordinates")))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), id_.alias("id"), properties.alias("properties"), shape.alias("geometry")), {"ignoreNullFields": "false"})


def write(features: DataFrame, path: str, mode: str = "append") -> None:
    """Writes features(id, properties, kind, coordinates), coordinates rounded, as a folder of collections."""
    from parcelwise.sources import geojson

    features.sparkSession.dataSource.register(FeatureCollections)
    text = feature_text(F.col("id"), F.col("kind"), geojson.rounded_geometry(F.col("kind"), F.col("coordinates")), F.col("properties"))
    features.select(text.alias("value")).write.format("feature_collections").option("path", path).mode(mode).save()


def _escaped(data: np.ndarray, at: int, before: int) -> bool:
    """Whether an odd number of backslashes stands before a place; before: how many stand before the data."""
    n = 0
    while at - n > 0 and data[at - n - 1] == 92:
        n += 1
    return (n + (before if n == at else 0)) % 2 == 1


def _backslashes(file, start: int) -> int:
    n = 0
    while n < start and file.read_at(1, start - n - 1) == b"\\":
        n += 1
    return n


def structure(data: bytes, before: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of quotes that begin or end a string; places of braces and brackets; how many quotes stand before those."""
    raw = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(raw == 34)
    maybe = np.flatnonzero(raw[quotes - 1] == 92) if len(quotes) else quotes
    if len(quotes) and quotes[0] == 0:
        maybe = np.union1d(maybe, [0])
    out = [k for k in maybe.tolist() if _escaped(raw, int(quotes[k]), before)]
    quotes = np.delete(quotes, out)
    turns = np.flatnonzero(_TURN[raw])
    return quotes, turns, np.searchsorted(quotes, turns)


def _opens(file, at: int, size: int) -> int | None:
    """The place of the bracket, if what follows the key at a place is an array."""
    at, want = at + len(_KEY), b":["
    while at < size and want:
        some = file.read_at(min(256, size - at), at)
        for k, c in enumerate(some):
            if c in b" \t\r\n":
                continue
            if c != want[0]:
                return None
            want = want[1:]
            if not want:
                return at + k
        at += len(some)
    return None


_SUMS = "path string, size long, start long, end long, quotes int, states array<struct<delta:int,least:int>>, opens array<struct<inside:int,depth:int,at:long,least:int>>"


def _sums(batches):
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            files, path = _files(r["path"])
            with files.open_input_file(path) as file:
                data = file.read_at(r["end"] - r["start"], r["start"])
                before = _backslashes(file, r["start"])
                quotes, turns, seen = structure(data, before)
                turn = _TURN[np.frombuffer(data, np.uint8)[turns]].astype(np.int64)
                depth = [np.cumsum(np.where((seen + h) % 2 == 0, turn, 0)) for h in (0, 1)]
                least = lambda d: int(d.min(initial=0))
                opens, tail = [], data + file.read_at(min(len(_KEY), r["size"] - r["end"]), r["end"])
                for m in re.finditer(re.escape(_KEY), tail):
                    at = m.start()
                    if at < len(data) and (k := int(np.searchsorted(quotes, at))) < len(quotes) and quotes[k] == at and (place := _opens(file, r["start"] + at, r["size"])) is not None:
                        inside, n = k % 2, int(np.searchsorted(turns, at))
                        d, after = depth[inside], int(np.searchsorted(turns, place - r["start"], "right"))
                        opens.append({"inside": inside, "depth": int(d[n - 1]) if n else 0, "at": place, "least": int(d[after:].min()) if after < len(d) else None})
            rows.append({**r, "quotes": len(quotes), "states": [{"delta": int(d[-1]) if len(d) else 0, "least": least(d)} for d in depth], "opens": opens})
        kinds = pa.schema([("path", pa.string()), ("size", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("quotes", pa.int32()), ("states", pa.list_(pa.struct([("delta", pa.int32()), ("least", pa.int32())]))), ("opens", pa.list_(pa.struct([("inside", pa.int32()), ("depth", pa.int32()), ("at", pa.int64()), ("least", pa.int32())])))])
        yield pa.RecordBatch.from_pylist(rows, schema=kinds)


_STARTS = "path string, size long, start long, end long, inside int, depth int, opens long"


def _fold(table: pa.Table) -> pa.Table:
    """Each range of a file with the state it begins in, and where the array of features opened: -1 if it isn't open; -2 in
    the one row of a file without any."""
    rows = sorted(table.to_pylist(), key=lambda r: r["start"])
    inside, depth, opens, found, out = 0, 0, -1, False, []
    for r in rows:
        if 0 <= opens < r["start"] and depth < 2:
            opens = -1
        own = [o for o in r["opens"] if o["inside"] == inside and depth + o["depth"] == 1]
        found |= bool(own)
        now = r["states"][inside]
        begin = opens
        if opens >= 0 and depth + now["least"] < 2 and opens < r["start"]:
            opens = -1
        for o in own:
            begin, opens = o["at"], o["at"] if o["least"] is None or depth + o["least"] >= 2 else -1
        out.append({k: r[k] for k in ("path", "size", "start", "end")} | {"inside": inside, "depth": depth, "opens": begin})
        depth, inside = depth + now["delta"], (inside + r["quotes"]) % 2
    if inside or depth:
        raise ValueError(f"{rows[0]['path']} is cut short")
    if not found:
        out = [out[0] | {"end": rows[0]["size"], "opens": -2}]
    kinds = pa.schema([("path", pa.string()), ("size", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("inside", pa.int32()), ("depth", pa.int32()), ("opens", pa.int64())])
    return pa.Table.from_pylist(out, schema=kinds)


def _within(data: bytes, start: int, inside: int, depth: int, opens: int, before: int) -> tuple[list[tuple[int, int]], int | None]:
    """(begin, end) of the features that lie in the data, and where one begins that it doesn't end."""
    _, turns, seen = structure(data, before)
    turn = _TURN[np.frombuffer(data, np.uint8)[turns]].astype(np.int64)
    real = (seen + inside) % 2 == 0
    turns, turn = turns[real], turn[real]
    after = depth + np.cumsum(turn)
    good = turns + start > opens
    closed = np.flatnonzero(good & (after < 2))
    if len(closed):
        good[closed[0] :] = False
    raw = np.frombuffer(data, np.uint8)[turns]
    begins, ends = turns[good & (turn == 1) & (after == 3) & (raw == ord("{"))], turns[(turn == -1) & (after == 2) & (raw == ord("}"))]
    k = np.searchsorted(ends, begins)
    whole = [(int(b), int(ends[i]) + 1) for b, i in zip(begins.tolist(), k.tolist(), strict=True) if i < len(ends)]
    return whole, int(begins[-1]) if len(whole) < len(begins) else None


def _features(batches):
    for batch in batches:
        for r in batch.to_pylist():
            files, path = _files(r["path"])
            with files.open_input_file(path) as file:
                data = file.read_at(r["end"] - r["start"], r["start"])
                if r["opens"] == -2:
                    text = data.decode("utf-8-sig").strip()
                    yield pa.record_batch([pa.array([r["path"]]), pa.array([0]), pa.array([text])], names=["path", "offset", "value"])
                    continue
                if r["opens"] == -1 or r["opens"] >= r["end"]:
                    continue
                whole, last = _within(data, r["start"], r["inside"], r["depth"], r["opens"], _backslashes(file, r["start"]))
                texts = [(r["start"] + a, data[a:b]) for a, b in whole]
                if last is not None:  # read on, twice as much each time, until its end is there
                    rest, more = data[last:], AHEAD
                    while True:
                        rest += file.read_at(min(more, r["size"] - r["start"] - last - len(rest)), r["start"] + last + len(rest))
                        done, _ = _within(rest, 0, 0, 2, -1, 0)
                        if done:
                            texts.append((r["start"] + last, rest[: done[0][1]]))
                            break
                        more *= 2
                for at in range(0, len(texts), 1000):
                    some = texts[at : at + 1000]
                    yield pa.record_batch([pa.array([r["path"]] * len(some)), pa.array([o for o, _ in some]), pa.array([t.decode() for _, t in some])], names=["path", "offset", "value"])


def texts(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(path, offset, value): the features of files as text, by the byte where they begin."""
    listed = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size")).where("size > 0")
    tasks = 4 * spark.sparkContext.defaultParallelism  # a range is a small row, so their size tells nothing of what is read
    ranges = listed.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("start"))
    ranges = ranges.withColumn("end", F.least(F.col("start") + split, "size")).repartition(tasks, "path", "start")
    starts = ranges.mapInArrow(_sums, _SUMS).groupBy("path").applyInArrow(_fold, _STARTS)  # a small row a range
    return starts.repartition(tasks, "path", "start").mapInArrow(_features, "path string, offset long, value string")


def scan(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(path, offset, id, properties, kind, coordinates) of the features of files."""
    from parcelwise.sources import geojson

    f = F.from_json("value", geojson.FEATURE)
    return texts(spark, path, split).select("path", "offset", f["id"].alias("id"), f["properties"].alias("properties"), f["geometry"]["type"].alias("kind"), f["geometry"]["coordinates"].alias("coordinates"))


"""WARC archives: a writer with revisit records and a splittable reader.

Writing: every page becomes a record in a gzip member of its own. Of records with equal payloads of at least
LEAST bytes the one of the smallest page_id is a response; the others are revisit records that name its digest and
record and have no payload. Digests are found by partial aggregation; a hot payload costs its pages' ids only. Each
task writes one file of its own name to a folder that all executors share; the list of files is a table, so what a
lost or doubled attempt wrote is never read.

Reading: files are cut into byte ranges, dealt to tasks. A task scans its range for gzip magic, decodes the start of
each candidate, and takes it for a member only if a WARC version line comes out. It owns the records that start
inside its range and reads the last one past its end. Memory is one record and a read buffer. Nothing is lost in
silence: a member that began as a record and can't be decoded to its end (cut short, damaged, or of another length
than its header says) is an error, and so, unless junk between members is allowed (strict=False), is anything but a
record at a file's start and after each record, up to the file's end.

A null html is an empty payload; null urls are left out; rows with a null page_id come after all others, and are
revisits of the smallest page_id of their payload; where no record of a payload has an id, there is none to refer to, and
all are responses. Rows that repeat the smallest page_id of a payload are responses too. Empty and null payloads are
records as well, an empty table gives none, and long ones are one record each, read as a whole. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.llm.common import pick, shared_dir, small_batches, stored

LEAST, SPLIT, READ, LEVEL = 100, 8 << 20, 1 << 20, 5
MAGIC = b"\x1f\x8b\x08"
_DATE = "2024-01-01T00:00:00Z"
SCHEMA = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, uncompressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, digest)}"
    head = [
        "WARC/1.1", "WARC-Type: " + ("response" if refers_to is None else "revisit"), f"WARC-Record-ID: <{name}>", f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def _write(folder: str):
    def run(batches):
        files, base = _filesystem(folder)
        out, path, size, count = None, f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
        try:
            for batch in batches:
                html = batch.column("html").cast(pa.binary())
                for page, url, body, digest, refers in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), html, batch.column("digest").to_pylist(), batch.column("refers_to").to_pylist(), strict=True):
                    if out is None:
                        files.create_dir(base, recursive=True)
                        out = files.open_output_stream(path, compression=None)
                    data = _member(record(page, url, body.as_py() or b"", digest, refers))
                    out.write(data)
                    size += len(data)
                    count += 1
        finally:
            if out is not None:
                out.close()
        if count:
            yield pa.record_batch([pa.array([f"{folder}/{path.rsplit('/', 1)[1]}"]), pa.array([size]), pa.array([count])], names=["path", "size", "records"])

    return run


def write(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Writes pages(page_id, url, html) as archives to the shared folder; returns their list (path, size, records)."""
    small_batches(pages.sparkSession)
    rows = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    seen = rows.select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("n")).where(F.col("n") >= least)
    first = seen.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"), F.count_if(F.col("page_id").isNull()).alias("nulls"))
    first, _ = stored(first.where("refers_to < last or refers_to is not null and nulls > 0").select("digest", "refers_to"), "first")  # so that a frequent payload can be split in the joins
    again = seen.join(first, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()
    known, unknown = rows.where("page_id is not null"), rows.where("page_id is null")
    # by page alone: equal page_ids with other payloads are told apart by the digest
    both = known.withColumn("digest", F.sha2("html", 256)).join(again.withColumnRenamed("digest", "d2"), "page_id", "left")
    both = both.withColumn("refers_to", F.when(F.col("digest") == F.col("d2"), F.col("refers_to"))).drop("d2")
    if _repeated(seen):
        both = known.withColumn("digest", F.sha2("html", 256)).join(again, ["page_id", "digest"], "left")
    others = unknown.withColumn("digest", F.sha2("html", 256)).join(first, "digest", "left")
    both = both.select("page_id", "url", "html", "digest", "refers_to").unionByName(others.select("page_id", "url", "html", "digest", "refers_to"))
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    listed, _ = stored(both.mapInArrow(_write(folder), "path string, size long, records long"), "archives")
    return listed


def _repeated(seen: DataFrame) -> bool:
    return not seen.groupBy("page_id").count().where("count > 1").isEmpty()


class _Reader:
    """A window over a file that slides forward: `at` is its place in the file, `k` that in the bytes held."""

    def __init__(self, file, at: int):
        self.file, self.at, self.data, self.k = file, at, b"", 0

    def __len__(self) -> int:
        return len(self.data) - self.k

    def more(self) -> bool:
        """Reads on; bytes that were passed go."""
        got = self.file.read_at(READ, self.at + len(self))
        self.data, self.k = self.data[self.k :] + got, 0
        return bool(got)

    def skip(self, n: int) -> None:
        self.k += n
        self.at += n


def _decoded(window: _Reader, head_only: bool = False) -> tuple[bytes, int] | None:
    """The member at the window's start, and its length; None if it isn't a WARC record. With head_only, no more of it
    than shows that it is one."""
    d, parts, used, told = zlib.decompressobj(31), [], 0, False
    while not d.eof:
        if used == len(window) and not window.more():
            if told:
                raise ValueError(f"a record at byte {window.at} is cut short")
            return None
        at = window.k + used
        piece = window.data[at:] if told else window.data[at : at + 64]
        try:
            parts.append(d.decompress(piece))
        except zlib.error as e:
            if told:
                raise ValueError(f"a record at byte {window.at} is damaged: {e}") from e
            return None
        used += len(piece) - len(d.unused_data)
        if not told and (got := sum(map(len, parts))) >= 7:
            told = b"".join(parts)[:7] == b"WARC/1."
            if not told:
                return None
            if head_only:
                return b"", 0
        elif not told and d.eof and got < 7:
            return None
    return (b"".join(parts), used) if told else None


def members(file, start: int, end: int, strict: bool = False) -> Iterator[bytes]:
    """The records whose member starts in [start, end) of a file. With strict, a record must stand at the file's start
    and after each record, up to the file's end."""
    window, follows = _Reader(file, start), strict and start == 0
    while window.at < end:
        if not follows:
            k = window.data.find(MAGIC, window.k)
            if k < 0:
                keep = min(2, len(window))
                window.skip(len(window) - keep)
                if window.at + keep >= end + 2 or not window.more():
                    return
                continue
            window.skip(k - window.k)
            if window.at >= end:
                return
        elif not len(window) and not window.more():
            return  # the file's end
        found = _decoded(window)
        if found is None:
            if follows:
                raise ValueError(f"no record at byte {window.at}, where one must begin")
            window.skip(1)
            continue
        yield found[0]
        window.skip(found[1])
        follows = strict
    # The next range looks for its first record by itself; that there is one where this range's last ends is seen here.
    if follows and (len(window) or window.more()) and _decoded(window, head_only=True) is None:
        raise ValueError(f"no record at byte {window.at}, where one must begin")


def parsed(raw: bytes) -> tuple[dict, bytes]:
    """A record's fields (names in lower case, http- before those of the HTTP header) and its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    size = int(fields.get("content-length", 0))
    if len(rest) < size:
        raise ValueError(f"a record has {len(rest)} of {size} bytes")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    for line in http.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields["http-" + name.strip().lower()] = value.strip()
    return fields, payload


def _page(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(m[1]) if m else None


def _read(payloads: bool, strict: bool):
    def run(batches):
        for batch in batches:
            for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end")), strict=True):
                files, at = _filesystem(path)
                rows, size = [], 0
                with files.open_input_file(at) as file:
                    for raw in members(file, start, end, strict):
                        f, payload = parsed(raw)
                        kind = f.get("warc-type")
                        digest = f.get("warc-payload-digest", "").removeprefix("sha256:")
                        n = int(f.get("http-content-length", len(payload)))
                        if kind == "response":
                            n = len(payload)
                            if hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"a payload in {path} doesn't match its digest")
                        rows.append((_page(f.get("warc-record-id")), f.get("warc-target-uri"), kind, digest, n, _page(f.get("warc-refers-to")), *([payload] if payloads else [])))
                        size += len(payload) * payloads
                        if len(rows) >= 5000 or size > 32 << 20:
                            yield _batch(rows, payloads)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows, payloads)

    return run


def _batch(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), *([("payload", pa.binary())] if payloads else [])]
    return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], schema=pa.schema(kinds))


def read(archives: DataFrame, payloads: bool = True, split: int = SPLIT, strict: bool = True) -> DataFrame:
    """The records of archives(path, size): one row each, in SCHEMA, with the payload (empty for revisits) if asked.
    strict=False allows other bytes between members."""
    small_batches(archives.sparkSession)
    ranges = archives.where("size > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", (F.col("start") + split).alias("end"))
    ranges = ranges.repartition(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "start")
    return ranges.mapInArrow(_read(payloads, strict), SCHEMA + ", payload binary" * payloads)


def archived(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pages written and read back, without payloads. As many records must come back as were written."""
    listed = write(pages)
    found, _ = stored(read(listed, payloads=False), "records")
    wrote, came = listed.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0], found.count()
    if wrote != came:
        raise RuntimeError(f"{wrote} records were written, {came} were read")
    return found

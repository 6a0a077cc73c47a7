"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Encoding: documents are cut into pre-tokens with positions. Tasks group documents into blocks of bounded bytes; a
block holds each of its distinct words once, and each document's positions as numbers of those words. The distinct
words of all blocks are shuffled by a hash of the word, each block's words of one hash bucket packed in one row, and
sorted by bucket, so that each word of the corpus is encoded once, where its rows meet, and its ids are joined to them
there; they go back to their blocks, and the positions put the documents together again. Words are reduced within
blocks before they are shuffled, so a frequent word is sent once per block, not once per occurrence. The number of
buckets follows spark.sql.shuffle.partitions; a task holds the distinct words of one bucket.

A block's key is a hash of its texts: the words and the positions are made in two passes over docs, and a pass that
cut other blocks fails with an error instead of giving wrong ids. So docs must be readable twice with the same rows
in the same partitions, as tables are.

Decoding: ids are looked up in the table of token bytes (fixed by the vocabulary) and joined.

Null texts count as empty; empty texts have no ids; an empty table gives no rows. Null doc_ids stay null, repeated rows stay repeated. Further
columns, whatever their names, are not read. Ids that the vocabulary doesn't have are an error in decoding.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import PIECE, give_back, kept, pick, slices, small_batches
from parcelwise.llm.packing import pack, planes, unpack, unplanes

#: Bytes of text in a block; a longer document is a block of its own.
BLOCK = 6 << 20
#: Words whose ids a task remembers at once; a word that comes again later is encoded again.
REMEMBERED = 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _Words(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Documents' ids and texts, in blocks of at most BLOCK bytes unless one document is larger."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for part in slices(batch, "text"):
            more = part.nbytes
            if texts and size + more > BLOCK:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids += part.column("doc_id").to_pylist()
            texts += [x or "" for x in part.column("text").to_pylist()]
            size += more
    if texts:
        yield ids, texts
    del ids, texts
    give_back()


def _key(ids: list, texts: list[str]) -> int:
    h = hashlib.blake2b(digest_size=8)
    for i, x in zip(ids, texts, strict=True):
        x = x.encode()
        h.update(b"%d:%d:" % (-1 if i is None else i, len(x)))
        h.update(x)
    return int.from_bytes(h.digest(), "little", signed=True)


def _split(pattern: str):
    import regex

    return kept("bpe", ("pattern", pattern), lambda: regex.compile(pattern))


def _cut(pattern, text: str) -> Iterator[list[str]]:
    """A text's matches, in lists of bounded size."""
    if len(text) <= PIECE:
        yield pattern.findall(text)
        return
    found = (m.group() for m in pattern.finditer(text))
    while some := list(itertools.islice(found, PIECE >> 2)):
        yield some


def _distinct(pattern: str, buckets: int):
    def run(batches):
        cut = _split(pattern)
        for ids, texts in _blocks(batches):
            words = {}
            for x in texts:
                for some in _cut(cut, x):
                    words.update(dict.fromkeys(some))
            words = [x.encode() for x in words]
            key = _key(ids, texts)
            del texts
            to = np.array([zlib.crc32(x) for x in words], np.uint32) % np.uint32(buckets)
            order = np.argsort(to, kind="stable")
            edge = np.searchsorted(to[order], np.arange(buckets + 1))
            rows = []
            for k in np.flatnonzero(np.diff(edge)):
                own = order[edge[k] : edge[k + 1]]
                some = [words[i] for i in own]
                rows.append((int(k), pack(own, np.array([len(x) for x in some]), b"".join(some))))
            yield pa.record_batch([pa.array(np.full(len(rows), key)), pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["block", "bucket", "words"])

    return run


def _positions(pattern: str):
    def run(batches):
        import zstandard

        cut, press = _split(pattern), zstandard.ZstdCompressor(level=3).compress
        for ids, texts in _blocks(batches):
            number, lens, parts = _Words(), [], []
            for x in texts:
                lens.append(0)
                for some in _cut(cut, x):
                    parts.append(np.fromiter(map(number.__getitem__, some), np.int32, len(some)))
                    lens[-1] += len(some)
            flat = np.concatenate(parts)
            packed = press(planes(flat))
            yield pa.record_batch([pa.array([_key(ids, texts)]), pa.array([ids], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int32())), pa.array([len(number)], pa.int32()), pa.array([packed], pa.binary())], names=["block", "doc_ids", "lens", "n_distinct", "positions"])

    return run


def _encode_words(path: str, pattern: str):
    def run(batches):
        import tiktoken

        enc = kept("bpe", ("enc", path, pattern), lambda: tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={}))
        last, known = None, {}
        for batch in batches:
            out = []
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("words"), strict=True):
                if bucket != last or len(known) > REMEMBERED:
                    last, known = bucket, {}
                number, lens, data = unpack(blob.as_py())
                got, at = [], 0
                for n in lens.tolist():
                    word = data[at : at + n]
                    at += n
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = enc.encode_ordinary(word.decode())
                    got.append(ids)
                flat = np.fromiter(itertools.chain.from_iterable(got), np.int32)
                out.append(pack(number, np.array([len(x) for x in got]), planes(flat)))
            yield pa.record_batch([batch.column("block"), pa.array(out, pa.binary())], names=["block", "ids"])

    return run


def _expand(flat: np.ndarray, offs: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries flat[offs[k]:offs[k + 1]] for each k of pick, joined, and where each ends."""
    n = offs[pick + 1] - offs[pick]
    ends = np.cumsum(n)
    shift = offs[pick] - (ends - n)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(shift, n)], ends


def _joined(left: pa.Table, right: pa.Table) -> Iterator[tuple[list, pa.ListArray]]:
    """A block's documents, in parts of bounded size: ids of the documents, and each one's token ids. left: the block's
    positions; right: ids of its distinct words."""
    import zstandard

    if not left.num_rows:
        raise RuntimeError("documents changed between two reads: words of an unknown block")
    parts = [unpack(x.as_py()) for x in right.column("ids")] or [(np.zeros(0, np.int64), np.zeros(0, np.int32), b"")]
    number, lens = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
    flat, offs = np.concatenate([unplanes(x[2]) for x in parts]), np.concatenate([[0], np.cumsum(lens)])
    del parts
    distinct, order = np.unique(number, return_index=True)  # equal blocks send equal words
    for row in left.to_pylist():
        if len(distinct) != row["n_distinct"]:
            raise RuntimeError("documents changed between two reads: a block's words don't match its texts")
        n = sum(row["lens"])
        raw = zstandard.ZstdDecompressor().decompress(row["positions"], max_output_size=4 * n) if n else b""
        at = unplanes(raw)
        ends = np.cumsum(row["lens"])
        k = 0
        while k < len(ends):
            base = int(ends[k - 1]) if k else 0
            last = max(k + 1, int(np.searchsorted(ends, base + PIECE, "right")))
            got, till = _expand(flat, offs, order[at[base : int(ends[last - 1])]])
            till = np.concatenate([[0], till])[np.concatenate([[0], ends[k:last] - base])].astype(np.int32)
            yield row["doc_ids"][k:last], pa.ListArray.from_arrays(pa.array(till), pa.array(got))
            k = last


def _reassemble(finish: Callable[[pa.Array, pa.ListArray], pa.RecordBatch], schema: pa.Schema):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [finish(pa.array(ids, pa.int64()), coded) for ids, coded in _joined(left, right)]
        give_back()
        return pa.Table.from_batches(out, schema)

    return run


def _encoded(docs: DataFrame, ranks_path: str, pattern: str, finish, schema: pa.Schema, kinds: str) -> DataFrame:
    """What finish makes of each block's documents and ids."""
    docs = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    small_batches(docs.sparkSession)
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = docs.mapInArrow(_distinct(pattern, buckets), "block long, bucket int, words binary")
    coded = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_encode_words(ranks_path, pattern), "block long, ids binary")
    places = docs.mapInArrow(_positions(pattern), "block long, doc_ids array<long>, lens array<int>, n_distinct int, positions binary")
    return places.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(_reassemble(finish, schema), kinds)


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) for each row of docs(doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    finish = lambda ids, coded: pa.record_batch([ids, coded], schema=schema)
    return _encoded(docs, ranks_path, pattern, finish, schema, "doc_id long, ids array<int>")


def _byte_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    ranks = load_ranks(path)
    by_id = {i: b for b, i in ranks.items()}
    parts = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [b"%d," % i for i in range(n)]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    offs, flat = column.offsets.to_numpy(), column.values.to_numpy()
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        yield flat[a:b]


def _bytes_of(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> bytes:
    if len(ids) and (int(ids.max()) >= len(table[1]) - 1 or int(ids.min()) < 0):
        raise ValueError("an id that the vocabulary doesn't have")
    return b"".join(_expand(*table, ids[k : k + PIECE])[0].tobytes() for k in range(0, len(ids), PIECE))


def decode(coded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids, bytes binary) for each row of coded(doc_id, ids)."""

    def run(batches):
        table = kept("bpe", ("bytes", ranks_path), lambda: _byte_table(ranks_path))
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), batch.column("ids"), pa.array([_bytes_of(x, table) for x in _lists(batch.column("ids"))], pa.binary())], names=["doc_id", "ids", "bytes"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, bytes binary")


_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _digest(ranks_path: str):
    def finish(docs: pa.Array, coded: pa.ListArray) -> pa.RecordBatch:
        table = kept("bpe", ("bytes", ranks_path), lambda: _byte_table(ranks_path))
        decimals = kept("bpe", ("decimals", ranks_path), lambda: _decimals(len(table[1])))
        ids, text = [], []
        for x in _lists(coded):
            text.append(hashlib.sha256(_bytes_of(x, table)).hexdigest())
            ids.append(hashlib.sha256(_bytes_of(x, decimals)[:-1]).hexdigest())
        return pa.record_batch([docs, coded.value_lengths().cast(pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], schema=_DIGESTS)

    return finish


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of docs(doc_id, text): encodes as encode() does and
    decodes the ids as decode() does, where a block's ids come together, and keeps only digests of the decimal ids and
    the decoded bytes. One Python worker a task instead of two in a chain."""
    return _encoded(docs, ranks_path, pattern, _digest(ranks_path), _DIGESTS, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

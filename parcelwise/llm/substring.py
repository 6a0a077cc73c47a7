"""Exact substring deduplication by seed and extend.

Seeds: from each text's 5-word grams, winnowing keeps the smallest hash of every nine in a row. Any 13 consecutive
words hold exactly nine such grams, so two documents that share 13 words share the seed of that place. Documents are
joined on seeds; seeds that one document alone holds are dropped there. Extension: each seed that two documents share
is extended both ways to all 13-word windows that it stands for, which are compared by 95 bits of hash, of two
independent hashes of each word, beside the seed's place in them; windows that overlap or touch make up the maximal repeats, and every one of at least 13 words is
kept. Of each window's documents the smallest doc_id keeps it.

Documents with equal word sequences are found first, by an aggregation; all but the smallest are wholly repeats (from
13 words on) and go no further. Seeds and windows are combined within a task before they are grouped: a seed that a
task has seen in two documents is shared, whatever other tasks hold, and a window that a smaller document of the task
holds is a repeat; such rows are settled there, and only one row for others to compare with goes on. So a passage that
a third of all documents share makes a few rows a task in its group, not one a document; rows that are settled are
dealt out by document.

Null and empty texts have no words, and an empty table gives no rows. Long texts are read whole, about a megabyte of
words at a time where texts are split. Rows without doc_id neither remove nor lose words. Repeated rows of one doc_id
don't count against each other. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.llm.common import by_text, give_back, grams, hash_words, mix, pick, slices, small_batches, stored, text_buffer, word_hashes

GRAM = 5
#: Seeds and windows that a task remembers.
SEEN = 1 << 17
KINDS = {"doc_id": "bigint", "text": "string"}


def _seeds(words: np.ndarray, window: int) -> np.ndarray:
    """The seed of each window: the smallest gram hash inside."""
    g = grams(words, GRAM, 21)
    m = len(words) - window + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    low = g[:m].copy()
    for i in range(1, window - GRAM + 1):
        np.minimum(low, g[i : i + m], out=low)
    return low


def _sequence(part: pa.RecordBatch) -> pa.RecordBatch:
    raw, at = text_buffer(part.column("text"))
    starts, ends, words, first = hash_words(raw, at)
    n = np.diff(first)
    full = np.flatnonzero(n)
    out = np.zeros((2, len(n)), np.uint64)
    if len(full):
        place = np.arange(len(words), dtype=np.uint64) - np.repeat(first[:-1].astype(np.uint64), n)
        for k, own in enumerate((words, word_hashes(raw, starts, ends, 1))):
            out[k, full] = np.add.reduceat(mix(own + mix(place * np.uint64(2) + np.uint64(k))), first[:-1][full])
    return pa.record_batch([part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(out[0].view(np.int64)), pa.array(out[1].view(np.int64))], names=["doc_id", "n_words", "s1", "s2"])


class _Rows:
    """Base of the two mappings: rows of a part of documents that are combined with what the task has seen."""

    def __init__(self, window: int):
        self.window = window

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = self.start()
        for batch in batches:
            for part in slices(batch, "text"):
                yield self.rows(part, state)
        give_back()


class _SeedRows(_Rows):
    """(doc_id, seed, known): a row per document and seed; known if the seed is shared. A shared one is sent once more,
    as one that isn't known to be, for other tasks' sake."""

    def start(self) -> dict:
        return {"shared": np.zeros(0, np.int64)}

    def rows(self, part: pa.RecordBatch, state: dict) -> pa.RecordBatch:
        _, _, words, first = hash_words(*text_buffer(part.column("text")))
        low = _seeds(words, self.window).view(np.int64)
        got = [np.unique(low[lo : hi - self.window + 1]) if hi - lo >= self.window else low[:0] for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        seed = np.concatenate(got) if got else low[:0]
        doc = np.repeat(part.column("doc_id").to_numpy(), [len(x) for x in got])
        order = np.lexsort((doc, seed))
        seed, doc = seed[order], doc[order]
        begin = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]])) if len(seed) else np.zeros(0, np.int64)
        end = np.append(begin[1:], len(seed)) - 1
        many = doc[begin] < doc[end] if len(seed) else np.zeros(0, bool)
        old = np.isin(seed[begin], state["shared"])
        known = np.repeat(many | old, np.diff(np.append(begin, len(seed))))
        again = begin[many & ~old]
        new = seed[again]
        state["shared"] = np.concatenate([state["shared"], new]) if len(state["shared"]) + len(new) <= SEEN else new[:SEEN]
        return pa.record_batch([
            pa.array(np.concatenate([doc, doc[again]])), pa.array(np.concatenate([seed, new])), pa.array(np.concatenate([known, np.zeros(len(again), bool)])),
        ], names=["doc_id", "seed", "known"])


def _window_keys(words: np.ndarray, window: int) -> np.ndarray:
    return grams(words, window, 31)


class _WindowRows(_Rows):
    """(doc_id, w1, w2, known): the windows that shared seeds stand for; known if a smaller document holds it too."""

    def start(self) -> dict:
        return {"w1": np.zeros(0, np.int64), "w2": np.zeros(0, np.int32), "doc": np.zeros(0, np.int64)}

    def rows(self, part: pa.RecordBatch, state: dict) -> pa.RecordBatch:
        raw, place = text_buffer(part.column("text"))
        starts, ends, words, first = hash_words(raw, place)
        n = self.window
        low, one = _seeds(words, n).view(np.int64), _window_keys(words, n).view(np.int64)
        two = (grams(word_hashes(raw, starts, ends, 1), n, 32) >> np.uint64(33)).astype(np.int32)
        flat, offs = part.column("seeds").flatten().to_numpy(), part.column("seeds").offsets.to_numpy()
        got = []
        for k, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            if hi - lo >= n:
                at = lo + np.flatnonzero(np.isin(low[lo : hi - n + 1], flat[offs[k] - offs[0] : offs[k + 1] - offs[0]]))
                got.append(at[np.unique(one[at], return_index=True)[1]])
            else:
                got.append(np.zeros(0, np.int64))
        at = np.concatenate(got) if got else np.zeros(0, np.int64)
        doc = np.repeat(part.column("doc_id").to_numpy(), [len(x) for x in got])
        order = np.lexsort((doc, two[at], one[at]))
        w1, w2, doc = one[at][order], two[at][order], doc[order]
        if not len(doc):
            return pa.record_batch([pa.array(doc), pa.array(w1), pa.array(w2), pa.array(np.zeros(0, bool))], names=["doc_id", "w1", "w2", "known"])
        begin = np.flatnonzero(np.concatenate([[True], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])]))
        size = np.diff(np.append(begin, len(doc)))
        known = doc > np.repeat(doc[begin], size)
        if len(state["w1"]):
            k = np.minimum(np.searchsorted(state["w1"], w1), len(state["w1"]) - 1)
            known |= (state["w1"][k] == w1) & (state["w2"][k] == w2) & (state["doc"][k] < doc)
        many = begin[size > 1]  # remembered: the smallest document of windows that come often
        seen = {c: np.concatenate([old, x[many]]) for (c, old), x in zip(state.items(), (w1, w2, doc), strict=True)}
        if len(seen["w1"]) > SEEN:
            seen = dict(zip(seen, (w1[many[:SEEN]], w2[many[:SEEN]], doc[many[:SEEN]]), strict=True))
        keep = np.lexsort((seen["doc"], seen["w1"]))
        keep = keep[np.unique(seen["w1"][keep], return_index=True)[1]]
        state.update({c: x[keep] for c, x in seen.items()})
        return pa.record_batch([pa.array(doc), pa.array(w1), pa.array(w2), pa.array(known)], names=["doc_id", "w1", "w2", "known"])


def _removed(window: int, untouched: bool):
    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        raw, at = text_buffer(part.column("text"))
        _, _, words, first = hash_words(raw, at)
        keys = _window_keys(words, window).view(np.int64)
        data = raw.tobytes()
        gone, texts = [], []
        for k, (lo, hi, copy, flags) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), part.column("copy").to_pylist(), part.column("flags"), strict=True)):
            n = hi - lo
            own = data[at[k] : at[k + 1]].split()
            if copy and n >= window:
                gone.append(n)
                texts.append(b"")
                continue
            if not flags.is_valid or n < window:
                gone.append(0)
                texts.append(data[at[k] : at[k + 1]] if untouched else b" ".join(own))
                continue
            starts = np.flatnonzero(np.isin(keys[lo : hi - window + 1], flags.values.to_numpy()))
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + window, -1)
            keep = np.cumsum(edge[:-1]) == 0
            gone.append(int(n - keep.sum()))
            texts.append(b" ".join(compress(own, keep.tolist())))
        out = [part.column(c) for c in part.schema.names if c not in ("text", "copy", "flags")]
        names = [c for c in part.schema.names if c not in ("text", "copy", "flags")]
        return pa.record_batch([*out, pa.array(np.diff(first).astype(np.int64)), pa.array(gone, pa.int64()), pa.array([x.decode("utf-8", "replace") for x in texts], pa.string())], names=[*names, "n_words", "n_removed", "kept_text"])

    return run


def repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, flags, copy): for each doc_id with repeats, the hashes of its windows that a smaller doc_id holds
    too, or whether it repeats a smaller doc_id's words as a whole."""
    small_batches(docs.sparkSession)
    docs = pick(docs, "doc_id", "text", cast=KINDS).where("doc_id is not null")
    seq, _ = stored(docs.mapInArrow(by_text("text", _sequence), "doc_id long, n_words long, s1 long, s2 long").where(F.col("n_words") >= window), "sequences")
    same = seq.groupBy("s1", "s2", "n_words").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last")
    same, _ = stored(same, "same")  # so that the copies of a frequent text can be split in the join
    repeated = seq.groupBy("doc_id").count().where("count > 1").select("doc_id")  # their rows may differ
    copies = seq.join(same, ["s1", "s2", "n_words"]).where("doc_id > rep").select("doc_id").join(repeated, "doc_id", "left_anti")
    copies, _ = stored(copies, "copies")

    # A window function per seed, not a join with an aggregate: a second branch would run the mapping, and its
    # shuffle, again. Settled rows are dealt out by document.
    dealt = F.when(F.col("known"), F.xxhash64("doc_id")).otherwise(F.lit(0))
    seeds = docs.mapInArrow(_SeedRows(window), "doc_id long, seed long, known boolean")
    held = Window.partitionBy("seed", dealt)
    shared = seeds.select("seed", "doc_id", "known", F.min("doc_id").over(held).alias("lo"), F.max("doc_id").over(held).alias("hi")).where("known or lo < hi")
    mine = shared.groupBy("doc_id").agg(F.collect_list("seed").alias("seeds")).join(copies, "doc_id", "left_anti")
    windows = docs.join(mine, "doc_id").select("doc_id", "text", "seeds").mapInArrow(_WindowRows(window), "doc_id long, w1 long, w2 int, known boolean")
    later = windows.select("doc_id", "w1", "known", F.min("doc_id").over(Window.partitionBy("w1", "w2", dealt)).alias("lo")).where("known or doc_id > lo")
    flags = later.groupBy("doc_id").agg(F.collect_list("w1").alias("flags"))
    return flags.withColumn("copy", F.lit(False)).unionByName(copies.select("doc_id", F.lit(None).cast("array<long>").alias("flags"), F.lit(True).alias("copy")))


def without_repeats(docs: DataFrame, window: int = 13, carry: tuple[str, ...] = (), untouched: bool = False) -> DataFrame:
    """Per row of docs(doc_id, text, *carry): doc_id, the carried columns, n_words, n_removed, kept_text (kept words
    joined by one space; with untouched, a text that loses nothing stays as it is)."""
    found = repeats(docs, window)
    rows = pick(docs, "doc_id", "text", *carry, cast=KINDS)
    known, unknown = rows.where("doc_id is not null"), rows.where("doc_id is null")
    unknown = unknown.select(*unknown.columns, F.lit(None).cast("array<long>").alias("flags"), F.lit(False).alias("copy"))
    out = known.join(found, "doc_id", "left").unionByName(unknown).select("doc_id", *carry, "text", F.coalesce("copy", F.lit(False)).alias("copy"), "flags")
    kinds = "".join(f"`{c}` {k}, " for c, k in rows.dtypes if c in carry)
    return out.mapInArrow(by_text("text", _removed(window, untouched)), f"doc_id long, {kinds}n_words long, n_removed long, kept_text string")

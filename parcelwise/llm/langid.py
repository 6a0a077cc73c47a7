"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of a bounded sample of labelled text. A text is parsed against each
automaton into the fewest phrases that occur in the sample: each phrase is the longest match from where the last one
ended; a character that the sample doesn't have is a phrase of its own. A text of n characters that takes c phrases
against a sample of m characters has the cross-parsing entropy c * log2(m) / n; the language of the least one wins, so
that a language with a smaller sample, whose matches are shorter, is not put at a disadvantage. Ties go to the
language that sorts first.

The sample is bounded: of each language SAMPLE_TEXTS distinct texts (those of smallest text hash; texts that are alike
in what is learned count once), of each up to SAMPLE_CHARS characters: the whole text, or PIECES pieces from all over
it, evenly spaced. Pieces are cleaned, and those that are alike dropped, where the texts are; so no more than that is ever
collected, whatever the corpus. Texts and samples are lower-cased, and every run of other characters than letters counts as one space.

Predictions read whole texts. A long text is cut into runs that are parsed side by side with numpy as if a phrase began
at each run's start; then the phrase that the run before left open is carried on into the run, up to the first place
where both parses begin a phrase: from there on they are the same. Counts are those of one parse of the whole text.

Null and letterless texts get `und` and score 0. A score is 1 - entropy of the winner / entropy of the second (1.0 if
there is one language only). With no labelled text at all, every text is `und`. Repeated rows are predicted each; an empty table
gives none.
Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.llm.common import by_text, kept, pick, small_batches, stored

SAMPLE_TEXTS, SAMPLE_CHARS, PIECES = 24, 800, 8
#: Characters of a run, runs at a time.
STEP, RUNS = 512, 4096
PAD = 1
#: Entries up to which the automata are one array by state and character class; beyond that they are a hash table.
DENSE = 1 << 24


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of each state of the suffix automaton; state 0 is the root."""
    go: list[dict[str, int]] = [{}]
    link, size, last = [-1], [0], 0
    for ch in text:
        new = len(go)
        go.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and ch not in go[p]:
            go[p][ch] = new
            p = link[p]
        if p >= 0:
            q = go[p][ch]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(ch) == q:
                    go[p][ch] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return go


class Table:
    """A fixed map from whole numbers to whole numbers, looked up by arrays; -1 for other keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        at, todo = self._place(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[at[todo]] == -1]
            self.keys[at[free]] = keys[free]
            won = self.keys[at[todo]] == keys[todo]
            self.values[at[todo[won]]] = values[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._place(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1)
        todo = np.flatnonzero((there != keys) & (there != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            there = self.keys[at[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (there != -1)]
        return out


class Model:
    """All languages' automata. Character class 0 is unknown, 1 fills up the last run of a text."""

    def __init__(self, sample: tuple[tuple[str, str], ...], dense: int = DENSE):
        self.langs = [x for x, _ in sample]
        self.weight = np.log2(np.array([max(2, len(t)) for _, t in sample], float))
        chars = sorted({ord(c) for _, t in sample for c in t})
        self.chars, self.n = np.array(chars, np.int64), len(chars) + 2
        kind = {chr(c): i + 2 for i, c in enumerate(chars)}
        keys, values, roots, base = [], [], [], 0
        for _, text in sample:
            go = suffix_automaton(text)
            keys.append(np.array([(s + base) * self.n + kind[c] for s, row in enumerate(go) for c in row], np.int64))
            values.append(np.array([to + base for row in go for to in row.values()], np.int32))
            roots.append(base)
            base += len(go)
        self.roots = np.array(roots, np.int64)
        own, to = np.concatenate(keys or [np.zeros(0, np.int64)]), np.concatenate(values or [np.zeros(0, np.int32)])
        self.flat = self._flat(own, to, base) if base * self.n <= dense else None
        self.next = Table(own, to) if self.flat is None else None

    def _flat(self, keys: np.ndarray, to: np.ndarray, states: int) -> np.ndarray:
        """Steps by state and class, with the way back to the root: twice the next state, and 1 if a phrase begins."""
        step = np.full((states, self.n), -1, np.int32)
        step.ravel()[keys] = to
        for root, end in zip(self.roots, [*self.roots, states][1:], strict=True):
            again = np.where(step[root] < 0, root, step[root]) * 2 + 1
            part = step[root:end]
            part[:] = np.where(part < 0, again, part * 2)
            part[0] = again  # at the root no phrase is open
            part[:, PAD] = np.arange(root, end) * 2
        return step.ravel()

    def kinds(self, codes: np.ndarray) -> np.ndarray:
        """Classes of code points."""
        if not len(self.chars):
            return np.zeros(len(codes), np.int64)
        at = np.minimum(np.searchsorted(self.chars, codes), len(self.chars) - 1)
        return np.where(self.chars[at] == codes, at + 2, 0)

    def _step(self, state: np.ndarray, c: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a character, and whether it begins a phrase."""
        if self.flat is not None:
            found = self.flat[state * self.n + c]
            return (found >> 1).astype(np.int64), (found & 1).astype(bool)
        to = self.next.get(state * self.n + c)
        miss = to < 0
        if miss.any():
            again = self.next.get(root[miss] * self.n + c[miss])
            to[miss] = np.where(again < 0, root[miss], again)
        begins, filler = miss | (state == root), c == PAD
        return np.where(filler, state, to), begins & ~filler

    def phrases(self, kinds: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Phrases by language and run; kinds: runs of STEP character classes; follows: whether a run goes on the text of
        the run before."""
        out, carry = [], None
        for k in range(0, len(kinds), RUNS):
            got, carry = self._some(kinds[k : k + RUNS], follows[k : k + RUNS], carry)
            out.append(got)
        return np.concatenate(out, 1)

    def _some(self, kinds: np.ndarray, follows: np.ndarray, carry: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        langs, runs = len(self.langs), len(kinds)
        by = np.ascontiguousarray(kinds.T)
        root = np.repeat(self.roots, runs)
        state, begun = root.copy(), np.zeros((STEP, langs * runs), bool)
        for i in range(STEP):
            state, begun[i] = self._step(state, np.tile(by[i], langs), root)
        upto = np.cumsum(begun, 0, dtype=np.int16)
        alone, end = upto[-1].astype(np.int64), state
        total, last = alone.copy(), end.copy()
        came = np.full(langs * runs, -1, np.int64)
        while True:  # a run whose way in has changed is gone into again
            before = last.reshape(langs, runs)
            first = carry[:, None] if carry is not None else self.roots[:, None]
            way = np.concatenate([first, before[:, :-1]], 1).ravel()
            todo = np.flatnonzero(np.tile(follows, langs) & (way != came))
            if not len(todo):
                return total.reshape(langs, runs), before[:, -1].copy()
            came[todo] = way[todo]
            state, count = way[todo], np.zeros(len(todo), np.int64)
            for i in range(STEP):
                state, begins = self._step(state, by[i][todo % runs], root[todo])
                count += begins
                met = begins & begun[i, todo]
                if met.any():
                    lane = todo[met]
                    total[lane], last[lane] = count[met] + alone[lane] - upto[i, lane], end[lane]
                    todo, state, count = todo[~met], state[~met], count[~met]
                    if not len(todo):
                        break
            total[todo], last[todo] = count, state


def _letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000)


def entropies(model: Model, codes: list[np.ndarray]) -> np.ndarray:
    """Phrases times the logarithm of the sample's length, by language and text; codes: cleaned texts, none empty."""
    sizes = np.array([len(c) for c in codes])
    runs = -(-sizes // STEP)
    begin = np.concatenate([[0], np.cumsum(runs)])
    flat = np.concatenate(codes)
    grid = np.full(begin[-1] * STEP, PAD, np.int64)
    shift = begin[:-1] * STEP - (np.cumsum(sizes) - sizes)
    grid[np.arange(len(flat)) + np.repeat(shift, sizes)] = model.kinds(flat)
    follows = np.ones(begin[-1], bool)
    follows[begin[:-1]] = False
    return np.add.reduceat(model.phrases(grid.reshape(-1, STEP), follows), begin[:-1], 1) * model.weight[:, None]


def _predict(sample: tuple[tuple[str, str], ...], keep_text: bool):
    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        model = kept("langid", sample, lambda: Model(sample))
        letters = kept("langid", "letters", _letters)
        langs, scores = ["und"] * part.num_rows, np.zeros(part.num_rows)
        codes = [np.frombuffer((x or "").lower().encode("utf-32-le"), np.uint32) for x in part.column("text").to_pylist()]
        rows = [i for i, c in enumerate(codes) if letters[c].any()] if model.langs else []
        if rows:
            for i in rows:
                own = letters[codes[i]]
                codes[i] = np.where(own, codes[i], 32)[own | np.concatenate([[False], own[:-1]])]
            total = entropies(model, [codes[i] for i in rows])
            order = np.argsort(total, 0, kind="stable")
            best = np.take_along_axis(total, order[:1], 0)[0]
            second = np.take_along_axis(total, order[1:2], 0)[0] if len(total) > 1 else np.full(len(best), np.inf)
            for k, i in enumerate(rows):
                langs[i] = model.langs[order[0, k]]
            scores[rows] = 1 - best / second
        names = [c for c in part.schema.names if c != "text" or keep_text]
        return pa.record_batch([*[part.column(c) for c in names], pa.array(langs, pa.string()), pa.array(scores)], names=[*names, "lang_pred", "score"])

    return run


def _pieces(text: Column) -> Column:
    """What is learned of a text: all of it, or pieces from all over it, cleaned."""
    size = SAMPLE_CHARS // PIECES
    piece = lambda k: F.substring(text, (F.floor(k * (F.length(text) - size) / (PIECES - 1)) + 1).cast("int"), F.lit(size))
    clean = lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}]+", " ")
    some = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda k: clean(piece(k)))
    return F.when(F.length(text) <= SAMPLE_CHARS, clean(text)).otherwise(F.array_join(some, "\n"))


def fit(labelled: DataFrame) -> tuple[tuple[str, str], ...]:
    """The bounded sample of labelled(text, lang), as (lang, text) in the order of lang: at most SAMPLE_TEXTS *
    SAMPLE_CHARS characters of each language, and a separator after each piece."""
    rows = pick(labelled, "text", "lang").where(r"lang is not null and text rlike '\\p{L}'").select("lang", F.trim(_pieces(F.col("text"))).alias("piece"))
    rows = rows.where("piece <> ''").withColumn("h", F.xxhash64("piece"))
    once = rows.select("lang", "h").distinct()  # texts alike in what is learned count once
    first = lambda *keys: F.row_number().over(Window.partitionBy("lang", *keys).orderBy("h"))
    some = once.withColumn("rank", first(F.pmod("h", F.lit(64)))).where(F.col("rank") <= SAMPLE_TEXTS)  # a language is ranked by many tasks
    best = some.withColumn("rank", first()).where(F.col("rank") <= SAMPLE_TEXTS).select(F.col("lang").alias("l"), F.col("h").alias("h2"), "rank")
    best, _ = stored(best.coalesce(1), "best")  # SAMPLE_TEXTS rows a language; broadcast by the file's size
    found = rows.join(best, (F.col("lang") == F.col("l")) & (F.col("h") == F.col("h2"))).groupBy("lang", "rank").agg(F.min("piece").alias("piece"))
    texts: dict[str, list[str]] = {}
    for r in found.orderBy("lang", "rank").collect():  # SAMPLE_TEXTS rows a language at most
        texts.setdefault(r["lang"], []).append(r["piece"])
    return tuple((x, "\n".join(own)) for x, own in sorted(texts.items()))


def predict(docs: DataFrame, sample: tuple[tuple[str, str], ...], carry: tuple[str, ...] = ("doc_id",), keep_text: bool = False) -> DataFrame:
    """The carried columns, the text if asked, lang_pred and score for each row of docs(text, *carry)."""
    small_batches(docs.sparkSession)
    rows = pick(docs, *carry, "text")
    kinds = "".join(f"`{c}` {k}, " for c, k in rows.dtypes if c != "text" or keep_text)
    return rows.mapInArrow(by_text("text", _predict(sample, keep_text)), f"{kinds}lang_pred string, score double")


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Whether a document is not learned from: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))

"""License scans by a positional rare-token index, with DataFrame operations only.

Licences are templates: a text, and the key phrases in it that are mandatory. Document frequencies of all licence words
are counted over all documents. The index has postings (template, position) of each template's POOL words of highest
inverse document frequency. Of these a file chooses, for each template, the RARE rarest that stand in the file itself,
so a notice whose rarest words are altered is found by the next ones; index words of key phrases are chosen besides. Their postings are intersected by relative
position: the word at place i of a file that stands at place o of a template votes for the template at i - o, and places
where AGREE or more of the chosen words agree are kept. There the key phrases are verified: a label is given if all of
the template's phrases stand where the place puts them, give or take DRIFT words (a name put into a notice shifts what
follows). Phrases out of order, far apart or without votes give no label. The score is the largest share of a
template's RARE words that agree on one place, so a whole licence has 1, a piece of one less, and single words none.

Where phrases stand is looked up by postings of each one's ANCHORS rarest words, at places that all of them agree on;
there the whole phrase is compared. A phrase that stands in a text has its index words at those places, so none is
missed. Base phrases count wherever they stand, and their labels are among the others.

The postings are array and map constants that expressions look up, so the plan doesn't grow with the number of
templates, nor the work per word that isn't in the index.

Words are runs of anything but ASCII other than letters and digits, A-Z in lower case. Null texts count as empty. An
empty table gives no rows; long texts are read whole, a row's words at a time. Rows are independent: repeated ones, null ids and hot groups need no care; nothing but the word counts is shuffled. Further
columns are not read.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.functions.geom import once
from parcelwise.llm.common import pick

# Phrases and labels of the base.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
# Label, key phrases and text of further templates (notices of public licences; for some, the title).
MORE = (
    ("mit", ("permission is hereby granted free of charge to any person", "the software is provided as is"),
     "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
     "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
     "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all "
     "copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the "
     "warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("apache-2", ("licensed under the apache license",),
     "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
     "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is "
     "basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", ("redistribution and use in source and binary forms", "redistributions of source code must retain"),
     "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source "
     "code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright "
     "notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("isc", ("permission to use copy modify and or distribute this software for any purpose",),
     "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
     "permission notice appear in all copies"),
    ("gpl-3", ("gnu general public license version 3",), "gnu general public license version 3"),
    ("gpl-2", ("gnu general public license version 2",), "gnu general public license version 2"),
    ("gpl", ("gnu general public license as published by the free software foundation",),
     "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
     "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a "
     "particular purpose see the gnu general public license for more details"),
    ("lgpl", ("gnu lesser general public license",), "gnu lesser general public license"),
    ("mpl-2", ("mozilla public license",),
     "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at "
     "http mozilla org mpl 2 0"),
    ("unlicense", ("free and unencumbered software released into the public domain",),
     "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in "
     "source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("cc-by-nc", ("creative commons attribution noncommercial",), "creative commons attribution noncommercial"),
    ("cc-by-sa", ("creative commons attribution sharealike",), "creative commons attribution sharealike"),
    ("cc-by-sa", ("cc by sa",), "cc by sa"),
)
#: What stands between words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a template in the index, those of them that a file chooses, and index words of a key phrase.
POOL, RARE, ANCHORS = 16, 8, 2
#: Words that must agree on a place, and words by which a key phrase may be off it.
AGREE, DRIFT = 2, 16
#: Votes are packed: template, place (which may lie before the text) and word.
_PLACES, _WORDS = 1 << 36, 1 << 12
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    label: str
    phrases: tuple[tuple[str, ...], ...]
    words: tuple[str, ...]


def templates() -> list[Template]:
    """Those of the base, then the others."""
    base = [Template(label, (tuple(p.split()),), tuple(p.split())) for label, p in BASE]
    return base + [Template(label, tuple(tuple(p.split()) for p in phrases), tuple(text.split())) for label, phrases, text in MORE]


def offset(t: Template, phrase: tuple[str, ...]) -> int:
    """Where a key phrase first stands in its template."""
    return next(o for o in range(len(t.words)) if t.words[o : o + len(phrase)] == phrase)


def phrases() -> list[tuple[str, ...]]:
    return sorted({p for t in templates() for p in t.phrases})


def _lower_words(text: str) -> Column:
    """A text's words. Splitting takes a sixth of the time that matching each word does."""
    return F.array_remove(F.split(F.translate(F.col(text), _UPPER, _SMALL), GAP), "")


def frequencies(docs: DataFrame) -> dict[str, int]:
    """In how many documents each licence word stands (a fixed number of counts)."""
    vocabulary = sorted({w for t in templates() for w in (*t.words, *(w for p in t.phrases for w in p))})
    held = F.array_intersect(_lower_words("text"), F.array(*map(F.lit, vocabulary)))
    got = docs.select(F.explode(held).alias("w")).groupBy("w").count().collect()
    return dict.fromkeys(vocabulary, 0) | {r["w"]: r["count"] for r in got}


class Index:
    """The postings, by the words' document frequencies."""

    def __init__(self, count: dict[str, int]):
        rarest = lambda words, n: sorted(set(words), key=lambda w: (count[w], w))[:n]
        self.phrases, self.templates = phrases(), templates()
        self.anchors = [rarest(p, ANCHORS) for p in self.phrases]
        self.by_phrase: dict[str, list[tuple[int, int]]] = {}
        for k, p in enumerate(self.phrases):
            for w in self.anchors[k]:
                self.by_phrase.setdefault(w, []).append((k, p.index(w)))
        self.must = [sorted({w for p in t.phrases for w in self.anchors[self.phrases.index(p)]}) for t in self.templates]
        self.ranked = [rarest(t.words, POOL) for t in self.templates]
        self.by_template: dict[str, list[tuple[int, int]]] = {}
        for k, t in enumerate(self.templates):
            for o, w in enumerate(t.words):
                if w in self.ranked[k] or w in self.must[k]:
                    self.by_template.setdefault(w, []).append((k, o))
        self.words = sorted({*self.by_phrase, *self.by_template})


def _constant(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps({"v": value})), f"v {kind}")["v"]


def _postings(table: dict[str, list[tuple[int, int]]]) -> Column:
    return _constant({w: [{"k": k, "o": o} for k, o in got] for w, got in table.items()}, "map<string,array<struct<k:int,o:int>>>")


def _votes(table: dict[str, list[tuple[int, int]]]) -> Column:
    """What the hits vote for, in order: array<struct<k, s>>, s being the place where phrase or template k begins."""
    postings = _postings(table)
    none = F.array().cast("array<struct<k:int,s:int>>")
    each = lambda h: F.coalesce(F.transform(F.try_element_at(postings, h["w"]), lambda p: F.struct(p["k"].alias("k"), (h["i"] - p["o"]).alias("s"))), none)
    return F.array_sort(F.flatten(F.transform("hits", each)))


def _shifts(index: Index) -> Column:
    """Votes of the chosen words for (template, place), packed, distinct and in order."""
    table = {w: [{"k": k, "o": o} for k, o in got] for w, got in index.by_template.items()}
    posts = _constant({w: {"w": i, "at": table[w]} for i, w in enumerate(sorted(table))}, "map<string,struct<w:bigint,at:array<struct<k:bigint,o:bigint>>>>")

    def each(h: Column) -> Column:
        got = F.try_element_at(posts, h["w"])
        mine = F.filter(got["at"], lambda p: F.array_contains(F.get("chosen", p["k"]), h["w"]))
        pack = F.transform(mine, lambda p: (p["k"] * _PLACES + h["i"] - p["o"] + _PLACES // 2) * _WORDS + got["w"])
        return F.coalesce(pack, F.array().cast("array<bigint>"))

    return F.sort_array(F.array_distinct(F.flatten(F.transform("hits", each))))


def _spots(index: Index) -> Column:
    """Places that AGREE or more chosen words agree on: array<struct<k, s, share>>."""
    full = _constant([min(RARE, len(r)) for r in index.ranked], "array<double>")
    most = RARE + max(map(len, index.must))
    at = lambda j: F.shiftright(F.get("shifts", j), _WORDS.bit_length() - 1)
    first = F.filter(F.transform("shifts", lambda v, j: j), lambda j: ((j == 0) | (at(j - 1) != at(j))) & at(j).eqNullSafe(at(j + AGREE - 1)))

    def spot(j: Column) -> Column:
        # The distinct words that vote for a place stand next to each other.
        n = F.size(F.filter(F.array(*map(F.lit, range(most))), lambda d: at(j + d).eqNullSafe(at(j))))
        k = F.shiftright(at(j), _PLACES.bit_length() - 1).cast("int")
        return F.struct(k.alias("k"), (at(j) % _PLACES - _PLACES // 2).alias("s"), F.least(n / F.get(full, k), F.lit(1.0)).alias("share"))

    return F.transform(first, spot)


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def _base_labels(index: Index) -> Column:
    """Labels of base phrases that stand anywhere."""
    table = _constant([{"label": t.label, "p": index.phrases.index(t.phrases[0])} for t in index.templates[: len(BASE)]], "array<struct<label:string,p:int>>")
    return F.transform(F.filter(table, lambda t: F.exists("places", lambda v: v["k"] == t["p"])), lambda t: t["label"])


def _verified_labels(index: Index) -> Column:
    """Labels of templates that have a spot with all their key phrases where it puts them."""
    table = _constant(
        [{"label": t.label, "t": k, "phrases": [{"p": index.phrases.index(p), "o": offset(t, p)} for p in t.phrases]} for k, t in enumerate(index.templates)],
        "array<struct<label:string,t:int,phrases:array<struct<p:int,o:int>>>>",
    )
    stands = lambda p, spot: F.exists("places", lambda v: (v["k"] == p["p"]) & (F.abs(v["s"] - p["o"] - spot["s"]) <= DRIFT))
    given = F.filter(table, lambda t: F.exists("spots", lambda x: (x["k"] == t["t"]) & F.forall(t["phrases"], lambda p: stands(p, x))))
    return F.transform(given, lambda t: t["label"])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of docs(doc_id,
    text)."""
    docs = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    index = Index(frequencies(docs))
    # Words are cut once; those of a text without any index word go at once.
    rows = docs.select("doc_id", _lower_words("text").alias("words"))
    some = F.when(F.arrays_overlap("words", F.array(*map(F.lit, index.words))), F.col("words")).otherwise(F.array().cast("array<string>"))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), some.alias("words"))
    hits = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h["w"].isin(index.words))
    # What expressions below look up again and again is computed once a row.
    rows = once(rows, hits=hits)
    rows = once(rows, known=F.array_intersect(F.array(*map(F.lit, index.words)), F.transform("hits", lambda h: h["w"])))
    lists = _constant([{"some": r, "must": m} for r, m in zip(index.ranked, index.must, strict=True)], "array<struct<some:array<string>,must:array<string>>>")
    rows = once(rows, chosen=F.transform(lists, lambda t: F.array_union(F.slice(F.array_intersect(t["some"], F.col("known")), 1, RARE), t["must"])))
    rows = once(rows, votes=_votes(index.by_phrase), shifts=_shifts(index)).drop("hits", "known", "chosen")
    # All index words of a phrase agree where as many equal votes stand in a row.
    need = _constant([len(a) for a in index.anchors], "array<int>")
    agreed = F.filter("votes", lambda v, k: (v["s"] >= 0) & v.eqNullSafe(F.get("votes", k + F.get(need, v["k"]) - 1)))
    texts = _constant([list(p) for p in index.phrases], "array<array<string>>")
    places = F.filter(agreed, lambda v: F.slice("words", v["s"] + 1, F.size(F.get(texts, v["k"]))) == F.get(texts, v["k"]))
    rows = once(rows, places=places, spots=_spots(index)).drop("words")
    own = [index.phrases.index(t.phrases[0]) for t in index.templates[: len(BASE)]]
    starts = F.transform(F.filter("places", lambda v: v["k"].isin(own)), lambda v: v["s"])
    rows = once(rows, starts=starts, base=_base_labels(index), more=_verified_labels(index))
    score = F.coalesce(F.array_max(F.transform("spots", lambda x: x["share"])), F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"),
        _joined(F.col("base")).alias("base_labels"), _joined(F.concat("base", "more")).alias("labels"), score.alias("score"),
    )

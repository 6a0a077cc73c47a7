"""WARC, sharding, licences, mixing, search, language ID, BPE: brute force, round trips, held-out accuracy, edges."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from parcelwise.llm import bpe, langid, licenses, mixing, packing, sharding, topk, warc


def test_damaged_archives_are_errors():
    rows = [warc._member(warc.record(i, "u", random.Random(i).randbytes(400).hex().encode(), "d", None)) for i in range(3)]
    data = b"".join(rows)
    ends = np.cumsum([len(r) for r in rows]).tolist()
    read = lambda x, step, strict: [r for lo in range(0, len(x), step) for r in warc.members(_File(x), lo, lo + step, strict)]
    for step in (64, 300, len(data)):
        assert len(read(data, step, True)) == len(read(data, step, False)) == 3
        cut = data[:-20]
        middle = data[: ends[0] + 200] + bytes(100) + data[ends[0] + 300 :]
        for bad in (cut, middle):
            for strict in (True, False):
                with pytest.raises(ValueError, match="cut short|damaged|must begin|bytes"):
                    [warc.parsed(r) for r in read(bad, step, strict)]
        for at in (0, *ends[:2]):  # heads: those of any member, the first one too
            with pytest.raises(ValueError, match="must begin"):
                read(data[:at] + b"\0" + data[at + 1 :], step, True)
        with pytest.raises(ValueError, match="must begin"):
            read(data + b"junk", step, True)


def pages(n=60):
    rng = random.Random(1)
    body = [f"<p>{'é' * rng.randint(0, 300)}{k}</p>" for k in range(12)]
    rows = [(3 * i, f"http://x/{i}", rng.choice(body)) for i in range(n)]
    return [*rows, (1000, None, None), (1001, "u\r\nv", ""), (1002, "u", "z" * 99), (1003, "u", "z" * 99), (1004, "u", "z" * 100), (1005, "u", "z" * 100), (None, "u", "z" * 100), (1006, "u", rng.randbytes(40_000).hex())]


def warc_brute(rows):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        m = first.get(b)
        again = m is not None and (i is None or m < i)
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", m if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", [37, 500, 8 << 20])
def test_warc(spark, split):
    rows = pages()
    if split == 37:
        rows = rows[:20]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(3)
    got = warc.read(warc.write(df), split=split).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == warc_brute(rows)
    texts = Counter(h or "" for _, _, h in rows)
    assert all(bytes(r.payload).decode() in texts for r in got if r.record_type == "response")


def test_warc_rows_of_one_id(spark):
    df = spark.createDataFrame([(1, "u", "a" * 200), (2, "u", "a" * 200), (2, "u", "a" * 200), (2, "u", "b" * 200), (None, None, None)], "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.payload_digest[:4], r.record_type, r.refers_to) for r in warc.read(warc.write(df)).collect())
    a, b, e = (hashlib.sha256(x).hexdigest()[:4] for x in (b"a" * 200, b"b" * 200, b""))
    assert got == sorted([("1", a, "response", None), ("2", a, "revisit", 1), ("2", a, "revisit", 1), ("2", b, "response", None), ("None", e, "response", None)], key=lambda r: r[:3])
    assert warc.read(warc.write(df.limit(0))).collect() == []


class _File:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


def test_warc_members_between_junk():
    rows = [warc._member(warc.record(i, "u", b"x" * i, "d", None)) for i in range(50)]
    data = warc.MAGIC + b"junk" + b"".join(x + (b"\x00" * (i % 3) + warc.MAGIC * (i % 2)) for i, x in enumerate(rows))
    for step in (1000, 64, len(data)):
        got = [r for s in range(0, len(data), step) for r in warc.members(_File(data), s, s + step)]
        assert len(got) == 50 and [warc.parsed(r)[1] for r in got] == [b"x" * i for i in range(50)]


def id_text(i, texts):
    return str(i) if i is not None else "-" + hashlib.md5((texts[None] or "").encode()).hexdigest()


def test_shards(spark):
    rng = random.Random(4)
    rows = [(i, "é" * rng.randint(0, 400)) for i in range(300)] + [(1000, "x" * 5000), (None, "y" * 50), (7000, None)] + [(2000, "z" * 100)] * 60
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, prefix int").repartition(4)
    got = sharding.shards(df, limit=2000).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    held, texts = defaultdict(list), dict(rows)
    for r in got:
        held[r.depth, r.prefix, r.page].append(r)
        h = int(hashlib.md5(id_text(r.doc_id, texts).encode()).hexdigest()[:15], 16)
        assert r.prefix == h >> (60 - r.depth)
    for rs in held.values():
        assert sum(r.n_bytes for r in rs) == rs[0].shard_bytes
        assert rs[0].shard_bytes <= 2000 or len(rs) == 1  # a document alone may be larger
    assert {(r.doc_id, r.depth) for r in got} == shards_brute(rows, 2000)
    assert sharding.shards(df.limit(0)).collect() == []


def shards_brute(rows, limit):
    """A plain extendible hash: (doc_id, depth)."""
    done, todo = set(), [(0, [(int(hashlib.md5(id_text(i, {i: t}).encode()).hexdigest()[:15], 16), i, len((t or "").encode())) for i, t in rows])]
    while todo:
        depth, own = todo.pop()
        if sum(n for _, _, n in own) <= limit or len({h for h, _, _ in own}) == 1:
            done |= {(i, depth) for _, i, _ in own}
        else:
            for bit in (0, 1):
                todo += [(depth + 1, some)] if (some := [x for x in own if x[0] >> (59 - depth) & 1 == bit]) else []
    return done


def test_only_oversized_buckets_split(spark):
    rows = [(i, "x" * 10) for i in range(200)] + [(1000, "y" * 100_000)]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string"), limit=2500).collect()
    want = shards_brute(rows, 2500)
    assert {(r.doc_id, r.depth) for r in got} == want
    assert len({(r.depth, r.prefix) for r in got}) <= 12
    rows = [(i, "x" * (i % 97)) for i in range(3000)]  # many depths in both bands
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string"), limit=100).collect()
    assert {(r.doc_id, r.depth) for r in got} == shards_brute(rows, 100)


def test_licenses(spark):
    texts = [
        "Released under the MIT License. under the mit license", "x Licensed under the Apache License, Version 2.0", "cc-by-nc CC BY NC", "under the mitt license", "under the mit  é license",
        None, "", "!!", "GNU General Public License, version 3", "under the\nmit\tlicense " * 3, "éunder the mit license", "Permission is hereby granted, free of charge, to any person", "cc by " * 50 + "nc", "Kcc by nc K",
        "the copyright notice of a software", *["(c) 2020 someone\n" + " ".join(t.words[: len(t.words) // 2]) + ",\n" + " ".join(t.words[len(t.words) // 2 :]).upper() + ". end" for t in licenses.templates()[3:6]],
    ]
    want = dict(zip(texts[-3:], ["mit", "apache-2", "bsd"], strict=True))  # whole licences, with words before and after
    mit = list(licenses.templates()[3].words)
    one, two = (" ".join(p) for p in licenses.templates()[3].phrases)
    want |= {
        " ".join([*mit[:40], "by", "Some", "One", "and", "Others", *mit[40:]]): "mit",  # a name put in: in drift
        " ".join([*mit[:40], *["x"] * 30, *mit[40:]]): "",  # torn apart: beyond it
        f"{two} and {one}": "",  # out of order
        f"{one} " + "word " * 500 + two: "",  # far apart
        "mit": "",  # a word alone has no score
        " ".join("altered" if w in ("sublicense", "noninfringement", "merchantability", "persons", "obtaining") else w for w in mit): "mit",  # its next words vote
        "This is the Mozilla Public License.": "mpl-2",
    }
    texts += list(want)[3:]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, words int")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower)) for t in texts]
    ts = licenses.templates()
    count = Counter(w for own in words for w in set(own))
    rarest = lambda some, n: sorted(set(some), key=lambda w: (count[w], w))[:n]
    got = licenses.scan(df).collect()
    scores = {texts[r.doc_id]: r.score for r in got}
    assert scores["mit"] == 0 and all(scores[t] == 1 for t in list(want)[:3])
    for r in got:
        w = words[r.doc_id]
        at, base, every, score = [], set(), set(), 0.0
        for k, t in enumerate(ts):
            places = [[i for i in range(len(w)) if tuple(w[i : i + len(p)]) == p] for p in t.phrases]
            if k < len(licenses.BASE):
                at += places[0]
                base |= {t.label} if places[0] else set()
            pool = rarest(t.words, licenses.POOL)
            mine = {*[x for x in pool if x in w][: licenses.RARE], *(x for p in t.phrases for x in rarest(p, licenses.ANCHORS))}
            votes = defaultdict(set)
            for i, y in enumerate(w):
                if y in mine:
                    for o, x in enumerate(t.words):
                        if x == y:
                            votes[i - o].add(y)
            for s, agree in votes.items():
                if len(agree) >= 2:
                    score = max(score, min(1, len(agree) / min(licenses.RARE, len(pool))))
                    if all(any(abs(i - licenses.offset(t, p) - s) <= licenses.DRIFT for i in own) for p, own in zip(t.phrases, places, strict=True)):
                        every.add(t.label)
        every |= base
        assert tuple(r) == (r.doc_id, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(every)), pytest.approx(score))
        if texts[r.doc_id] in want:
            assert r.labels == want[texts[r.doc_id]]
    assert licenses.scan(df.limit(0)).collect() == []


def mix_rows():
    rng = random.Random(6)
    rows = [(i, rng.choice(["b", "a", "é", None, "B", "hot", "hot", "hot"]), " ".join("w" for _ in range(rng.randint(0, 300)))) for i in range(200)]
    return [*rows, (500, "empty", None), (501, "empty", ""), (None, "a", "x y z"), (502, "a", "p q r"), (502, "a", "p q r")]


def test_mixing(spark):
    rows = mix_rows()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, size int").repartition(4)
    got = mixing.taken(df).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        w = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / w > 2 * sizes[s]}
        if not full:
            target |= {s: left * weight[s] / w for s in open_}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in full)
        open_ -= full
    source = {r[0]: r[1] for r in rows}
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) < 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.taken(df.repartition(2)).collect()))
    assert mixing.taken(df.limit(0)).collect() == []
    out = mixing.mixed(df).collect()
    words = Counter()
    for r in out:
        words[r.source] += len(r.text.split())
    assert all(words[s] == taken[s] for s in order)


def test_schedule_is_even(spark):
    df = spark.createDataFrame(mix_rows(), "doc_id long, source string, text string")
    rows, mix = mixing.mixture(df, block=16)
    share = {r.sid: r.target for r in rows.select("sid", "target").distinct().collect()}
    seen = sorted((r.slot, r.sid) for r in mix.select("slot", "sid").distinct().collect())
    half = seen[: len(seen) // 2]
    for sid, t in share.items():
        n = sum(s == sid for _, s in half)
        assert abs(n - len(half) * t / sum(share.values())) < 8
    first = {r.doc_id: r.first_slot for r in mixing.taken(df, block=16).collect()}
    want = {r.doc_id: r.slot for r in mix.groupBy("doc_id").agg({"slot": "min"}).withColumnRenamed("min(slot)", "slot").collect()}
    assert {i: s for i, s in first.items() if s is not None} == want


def test_the_mix_is_in_the_order_of_its_slots(spark):
    rows = [(i, "abc"[i % 3] if i < 900 else "d", "w " * (20 + i % 7)) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    out = [r.source for r in mixing.mixed(df, block=32).collect()]
    words = Counter()
    for r in mixing.taken(df).collect():
        words[rows[r.doc_id][1]] += r.taken
    for lo in range(0, 1000, 200):  # any stretch holds the sources in their shares
        part = Counter(out[lo : lo + 200])
        assert all(abs(part[s] / 200 - n / sum(words.values())) < 0.12 for s, n in words.items())


def test_many_sources(spark):
    rows = [(i, f"s{i % 3000:05}", "w " * (1 + i % 50)) for i in range(6000)]
    got = mixing.taken(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)).collect()
    sizes, target, taken = Counter(), {}, Counter()
    for r in got:
        s = rows[r.doc_id][1]
        sizes[s] += r.size
        target[s], taken[s] = r.target, taken[s] + r.taken
    order, weight = sorted(sizes), {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes))}
    open_, left, want = set(order), 1.5 * sum(sizes.values()), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        want |= {s: 2.0 * sizes[s] if s in full else level * weight[s] for s in (full or open_)}
        left -= sum(want[s] for s in full)
        open_ = open_ - full if full else set()
    assert target == pytest.approx(want) and taken == {s: int(t) for s, t in target.items()}


def test_small_sources_are_taken_whole(spark):
    small = {f"s{k:03}": size for k, size in enumerate([1, 2, 3, 5, 20, 40, 64, 65, 100, 200, 300, 500, 700, 1000, 1500, 2000] * 6)}
    rows = [(i, "hot", "w " * 5000) for i in range(600)]
    for s, size in small.items():
        rows += [(len(rows), s, "w " * (size - size // 2)), (len(rows) + 1, s, "w " * (size // 2))]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    got = mixing.taken(df).collect()
    target, taken = {}, Counter()
    for r in got:
        target[rows[r.doc_id][1]] = r.target
        taken[rows[r.doc_id][1]] += r.taken
    assert taken == {s: int(t) for s, t in target.items()}
    _, mix = mixing.mixture(df)
    slots = mix.select("slot", "sid").distinct()
    assert slots.count() == slots.select("slot").distinct().count()


def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(0, 400, 2)]
    rows += [(1, rows[3][1]), (3, None), (5, [float("nan")] * 16), (7, [None] * 16), (9, []), (None, rows[0][1]), (50 * 99, rows[3][1]), (50 * 98, [1.0, 2.0]), (11, [3.0, 1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int").repartition(5)
    want = []
    good = [(i, np.floor(256 * np.array(v, np.float64))) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all()]
    for q, x in good:
        if q % 50 == 0:
            best = sorted((-int(x @ y), i) for i, y in good if i != q and len(y) == len(x))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    for block, pilot in ((16, 0), (16, 30), (1024, 1000)):
        assert sorted(map(tuple, topk.top_k(df, "vec_id % 50 = 0", block=block, pilot=pilot).collect())) == sorted(want)
    assert topk.top_k(df.limit(0), "vec_id % 50 = 0").collect() == []


def test_top_k_of_large_and_repeated_vectors(spark):
    whole = lambda v: [int(np.floor(256 * x)) for x in v]
    least = lambda s: max(-(2**63 - 1), min(2**63 - 1, s))
    rng = np.random.default_rng(8)
    for rows in (
        [(0, [1e8, 1.0]), (1, [1.0, 1.0]), (2, [-3.0, 2.0])], [(0, [3e7, 1e7 + 0.1]), (1, [2.5e7, -1.0]), (2, [2.5e7, -1.00390625])],
        [(0, [1e200, 1.0]), (1, [1e-200, 5.0]), (2, [1e200, 0.0]), (3, [-1e308, 1.7e308])], [(i, (rng.normal(size=3) * 1e7).tolist()) for i in range(101)],
    ):
        want, df = [], spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        if rows[-1][1][-1] > 1e300:  # 256 * x leaves double precision
            assert topk.top_k(df, "vec_id % 50 = 0").count() == 3
            continue
        for q, v in rows:
            if q % 50 == 0:
                best = sorted((-least(sum(a * b for a, b in zip(whole(v), whole(x), strict=True))), i) for i, x in rows if i != q)[:5]
                want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
        assert sorted(map(tuple, topk.top_k(df, "vec_id % 50 = 0").collect())) == want
    rows = [(50, [1.0, 2.0, 3.0]), (50, [9.0, -1.0]), (50, [2.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0, 1.0]), (1, [1.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 50 = 0").collect()
    assert [tuple(r) for r in got] == [(50, 1, 1, 3 * 65536), (50, 2, 1, 3 * 65536)]


def test_bounds_drop_most_pairs():
    rng = np.random.default_rng(2)
    x = topk.whole(np.repeat(rng.normal(size=(2000, 8)), 8, axis=1) + rng.normal(size=(2000, 64)) * 0.1)  # alike along their segments
    ids = np.arange(2000)
    q = ids % 50 == 0
    a, b, score, left = topk.search(x[q], x, ids[q], ids, 5)
    assert left[0] == q.sum() * (len(x) - 1) and left[1] < 0.2 * left[0] and 0 < left[2] < 0.05 * left[0]
    exact = x[q] @ x.T
    exact[np.arange(q.sum()), ids[q]] = -np.inf
    assert (np.sort(exact, 1)[:, :-6:-1] == score.reshape(-1, 5)).all()


def test_segment_bounds():
    rng = np.random.default_rng(1)
    q, x = rng.normal(size=(20, 37)), rng.normal(size=(30, 37)) + 1
    for s in (1, 4, 16, 64):
        assert (topk.segment_statistics(q, s) @ topk.segment_statistics(x, s).T >= q @ x.T - 1e-9).all()


def phrases_brute(text, sample):
    n, at = 0, 0
    while at < len(text):
        k = at
        while k < len(text) and text[at : k + 1] in sample:
            k += 1
        at = max(k, at + 1)
        n += 1
    return n


def test_parsing_takes_longest_matches(monkeypatch):
    rng = random.Random(2)
    sample = (("x", "".join(rng.choice("abc") for _ in range(80))), ("y", "".join(rng.choice("bcd") for _ in range(300))), ("z", "a" * 50))
    texts = ["".join(rng.choice(rng.choice(["abcde", "bc", "a"])) for _ in range(rng.randint(1, 400))) for _ in range(60)] + ["a" * 333, "e" * 100, sample[1][1] * 3, "🙂a"]
    for step, runs in ((512, 4096), (16, 7), (5, 1)):  # runs that are parsed side by side change nothing
        monkeypatch.setattr(langid, "STEP", step)
        monkeypatch.setattr(langid, "RUNS", runs)
        for dense in (0, langid.DENSE):
            got = langid.entropies(langid.Model(sample, dense), [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts])
            for k, (_, s) in enumerate(sample):
                assert got[k].tolist() == [phrases_brute(t, s) * np.log2(len(s)) for t in texts]


def predicted_brute(text, sample):
    clean = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower())
    clean = re.sub(" +", " ", clean)
    if not clean.strip():
        return "und", 0.0
    # what leads is dropped
    bits = [phrases_brute(clean.lstrip(" "), s) * np.log2(max(2, len(s))) for _, s in sample]
    order = sorted(range(len(bits)), key=lambda k: bits[k])
    return sample[order[0]][0], 1 - bits[order[0]] / bits[order[1]] if len(bits) > 1 else 1.0


def test_predictions_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sample = langid.fit(docs.where(~langid.held_out()))
    rows = [(r.doc_id, r.text) for r in docs.where("length(text) < 3000").limit(60).collect()]
    rows += [(10**6, None), (10**6 + 1, "12 !?"), (10**6 + 2, "  Ärger, und..die 日本語 É"), (10**6 + 3, "x")]
    for some in (sample, sample[:1], (*sample[:2], (sample[1][0] + "x", sample[1][1])), (sample[0], (sample[1][0], sample[1][1][:700]))):  # ties, one language, unequal samples
        got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), some).collect()}
        for i, t in rows:
            lang, score = predicted_brute(t, some)
            assert got[i] == (lang, pytest.approx(score))


def test_smaller_samples_are_at_no_disadvantage(spark):
    rng = random.Random(9)
    words = {k: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(300)] for k, letters in (("aa", "abcdefghijk"), ("bb", "efghijklmno"))}
    text = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    rows = [("aa", text("aa", 120)) for _ in range(40)] + [("bb", text("bb", 25)) for _ in range(12)]
    sample = langid.fit(spark.createDataFrame(rows, "lang string, text string"))
    asked = spark.createDataFrame([(i, k, text(k, 60)) for i in range(100) for k in ("aa", "bb")], "doc_id long, lang string, text string")
    got = langid.predict(asked, sample, ("doc_id", "lang")).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 196


def test_long_texts_are_sampled_from_all_over(spark):
    rows = [("xx", " ".join("abcdefgh"[k // 500] * 3 for k in range(4000)))]
    (sample,) = langid.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert langid.SAMPLE_CHARS <= len(sample[1]) + 8 and len(sample[1]) <= langid.SAMPLE_CHARS + 8 and set("abcdefgh") <= set(sample[1])


def test_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sample = langid.fit(docs.where(~langid.held_out()))
    got = langid.predict(docs, sample, ("doc_id", "lang")).where(langid.held_out()).collect()
    right = sum(r.lang == r.lang_pred for r in got)
    assert len(got) > 20 and right >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "12 !?", 0), (4, "der und die " * 30_000, 0), (None, "the and of the", 0)], "doc_id long, text string, lang_pred_ int")
    out = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd, sample).collect()}
    assert out[1] == out[2] == out[3] == ("und", 0.0) and out[4][0] == "de" and out[None][0] == "en"
    assert langid.fit(docs.limit(0)) == () and {r.lang_pred for r in langid.predict(odd, ()).collect()} == {"und"}
    assert (zlib.crc32(b"6") % 4 == 2) == spark.range(6, 7).select(langid.held_out("id")).first()[0]


def test_language_sample_holds_distinct_texts(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k: "".join(letters[(k // 26**i) % 26] for i in range(4))
    rows = [("xx", f"{word(k)} text") for k in range(60) for _ in range(30)] + [("xx", f"{word(k).upper()}, text!") for k in range(60)]
    rows += [("yy", "one text")] * 40 + [("yy", "two texts"), (None, "three texts"), ("yy", "12"), ("zz", None)]
    sample = dict(langid.fit(spark.createDataFrame(rows, "lang string, text string").repartition(4)))
    assert sorted(sample) == ["xx", "yy"]
    texts = [t.strip() for t in sample["xx"].split("\n")]
    assert len(texts) == len(set(texts)) == langid.SAMPLE_TEXTS
    assert sorted(sample["yy"].split("\n")) == ["one text", "two texts"]


def test_texts_alike_in_letters_are_learned_once(spark, monkeypatch):
    rows = [("log", f"sensor reading {i}") for i in range(20000)] + [("en", f"text {w}") for w in ("one", "two", "three")]
    frame = type(spark.range(0))
    got, collect = [], frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: got.append(out := collect(self)) or out)
    sample = dict(langid.fit(spark.createDataFrame(rows, "lang string, text string").repartition(4)))
    assert sample["log"] == "sensor reading" and sorted(sample["en"].split("\n")) == ["text one", "text three", "text two"]
    assert sum(map(len, got)) == 4


def test_rows_without_ids_are_spread(spark):
    rows = [(None, f"text {i}") for i in range(500)] + [(i, "x" * 10) for i in range(500)]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string"), limit=400).collect()
    assert max(Counter((r.depth, r.prefix, r.page) for r in got).values()) < 60 and {r.page for r in got} == {0}


def test_one_source_with_nearly_all_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 4)
    rows = [(i if i % 2 else None, "hot" if i % 100 else "cold", "w " * (i % 50)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    out = mixing.taken(df).collect()
    mix_brute = defaultdict(int)
    for r in out:
        mix_brute[r.target] += r.taken
        assert r.taken <= 2 * r.size
    assert all(int(t) == n for t, n in mix_brute.items()) and len(out) == 600
    plan = mixing.streams(spark.range(9).selectExpr("id % 2 as sid", "id as h", "id as doc_id", "id as size", "id as t"), 9)._jdf.queryExecution().executedPlan().toString()
    assert all("sid" not in line or "range" in line or "h" in line for line in plan.split("\n") if "Window " in line)


def test_packing_round_trip():
    rng = np.random.default_rng(4)
    for n in (0, 1, 1000):
        number = np.sort(rng.choice(10**6, n, replace=False))
        lens = rng.integers(0, 9, n)
        data = rng.bytes(int(lens.sum()))
        a, b, c = packing.unpack(packing.pack(number, lens, data))
        assert (a == number).all() and (b == lens).all() and c == data


def test_bpe(spark, monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rng = random.Random(3)
    texts = ["", None, " ", "\n\n  x", "it's 'S ''s", "é" * 3000, "日本語 text 12345", "a b c", "\x00\x01", "<|endoftext|>", "🙂🙂 ok"]
    texts += ["".join(rng.choice("ab '\n sé1!日") for _ in range(rng.randint(0, 200))) for _ in range(120)] + ["the same"] * 5
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(None, "no id", 0), (7, "again", 0), (7, "again", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)
    df = spark.read.parquet(_saved(spark, df))
    got = bpe.decode(bpe.encode(df, path, P.PATTERN), path).collect()
    want = sorted((str(i), enc.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.ids, bytes(r.bytes)) for r in got) == want
    sha = lambda x: hashlib.sha256(x).hexdigest()
    digests = sorted((str(i), len(ids), sha(",".join(map(str, ids)).encode()), sha(text)) for i, ids, text in want)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df, path, P.PATTERN).collect()) == digests
    monkeypatch.setattr(bpe, "PIECE", 40)  # long texts are cut into lists of bounded size
    cut = bpe._split(P.PATTERN)
    assert all([w for some in bpe._cut(cut, t) for w in some] == cut.findall(t) for t in texts if t)
    assert bpe.encode(df.limit(0), path, P.PATTERN).collect() == []


def _saved(spark, df):
    from parcelwise.llm.common import shared_dir

    path = f"{shared_dir(spark)}/t-{random.random()}"
    df.write.parquet(path)
    return path

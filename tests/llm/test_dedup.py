"""MinHash near-dedup, substring dedup and embedding near-dedup against brute force, with edge cases."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from parcelwise.llm import common, lattice, minhash, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOC = "doc_id long, text string, TEXT_ string, keys int, seed string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DOC)


def near_brute(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    comp = {i: i for i in sets}

    def top(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i), top(i) == i) for i in sets}


def corpus(n=150, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeABé,") for _ in range(rng.randint(1, 5)))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.3:
            words = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.randint(0, 3)):
                if words:
                    words[rng.randrange(len(words))] = word()
            rows.append((i * 3, " ".join(words)))
        elif kind < 0.5:
            rows.append((i * 3, " ".join(word() for _ in range(rng.randint(5, 80))) + "\n" + passage + "\t" + word()))
        else:
            rows.append((i * 3, " ".join(word() for _ in range(rng.randint(0, 120)))))
    hub = [word() for _ in range(200)]
    for i in range(40):  # copies of one text, changed at places of their own: all link with it, not all with each other
        own = list(hub)
        own[(5 * i) % 200] = word()
        own[(5 * i + 97) % 200] = word()
        rows.append((1000 + i, " ".join(own)))
    rows.append((2000, " ".join(hub)))
    rows += [(3000, None), (3001, ""), (3002, " \n\t"), (3003, "One"), (3004, "one"), (3005, "a b c d"), (3006, "a B c d"), (3007, "x " * 70_000)]
    return rows


def test_near_duplicates(spark):
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(table(spark, rows).repartition(7)).collect()}
    assert got == near_brute(rows)


def test_near_duplicates_order_and_partitions_do_not_matter(spark):
    rows = corpus(60, 5)
    a = minhash.near_duplicates(table(spark, rows).coalesce(1)).collect()
    b = minhash.near_duplicates(table(spark, rows[::-1]).repartition(5)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_near_duplicates_edges(spark):
    assert minhash.near_duplicates(table(spark, [])).collect() == []
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (9, "a b c d e f")]
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in minhash.near_duplicates(table(spark, rows)).collect())
    assert got == [(-1, None, False), (5, 5, True), (5, 5, True), (9, 5, False)]


def repeats_brute(rows, n=13):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    own = {}
    for i, w in words:
        for k in range(len(w) - n + 1):
            if i is not None:
                g = tuple(w[k : k + n])
                own[g] = min(own.get(g, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - n + 1):
            if i is not None and own[tuple(w[k : k + n])] < i:
                gone.update(range(k, k + n))
        out.append((-1 if i is None else i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def test_substring(spark):
    rows = [*corpus(), (None, corpus()[5][1]), (None, None), (6, corpus()[2][1])]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring.without_repeats(table(spark, rows).repartition(5)).collect())
    assert got == repeats_brute(rows)


def test_substring_edges(spark):
    assert substring.without_repeats(table(spark, [])).collect() == []
    text = " ".join(f"w{i}" for i in range(13))
    got = sorted(map(tuple, substring.without_repeats(table(spark, [(1, text), (2, "x  " + text), (2, text)]), untouched=True).collect()))
    assert got == [(1, 13, 0, text), (2, 13, 13, ""), (2, 14, 13, "x")]


def test_hashing_of_long_texts_does_not_depend_on_pieces(monkeypatch):
    raw = np.frombuffer(("".join(random.Random(1).choice("ab \n") for _ in range(5000)) + "z" * 700).encode(), np.uint8)
    at = np.array([0, 10, 10, 2000, len(raw)])
    whole = common.hash_words(raw, at)
    monkeypatch.setattr(common, "PIECE", 64)
    for a, b in zip(whole, common.hash_words(raw, at), strict=True):
        assert (a == b).all()
    assert len(whole[0]) == sum(len(raw[a:b].tobytes().split()) for a, b in zip(at[:-1], at[1:], strict=True))


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.mark.parametrize("power", range(9, 14))
def test_words_of_regular_structure_have_hashes_of_their_own(power):
    n = 1 << power
    words = [thue_morse(n), thue_morse(n, "b", "a"), *[x for k in range(3, power) for x in (thue_morse(n, "ab"[: 1 + k % 2], "cd"), "ab" * (n >> k), "a" * (n >> k), "a" * (n >> k) + "\0")]]
    half = words[0][: n // 2]
    words = sorted({*words, half + half[::-1], half[::-1] + half, half[8:] + half[:8], half[:8] + half[8:]})
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, one, _ = common.hash_words(raw, np.array([0, len(raw)]))
    two = common.word_hashes(raw, starts, ends, 1)
    assert len(one) == len(words) == len(set(one.tolist())) == len(set(two.tolist())) and not (one == two).any()


def test_words_of_one_structure_make_no_repeats(spark):
    a, b = thue_morse(1024), thue_morse(1024, "b", "a")
    words = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join([*words[:6], a, *words[6:]])), (2, " ".join([*words[:6], b, *words[6:]]))]
    assert [r.n_removed for r in substring.without_repeats(table(spark, rows)).collect()] == [0, 0]
    assert {r.component_id for r in minhash.near_duplicates(table(spark, rows)).collect()} == {1, 2}


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(50)], [(0, i) for i in range(1, 40)] + [(100, 99), (99, 7)]])
def test_components(spark, edges):
    links = spark.createDataFrame(edges, "a long, b long")
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for s in sorted(near):
        todo = [s]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = s
                todo += near[x]
    got = common.components(links).collect()
    assert {r.id: r.component for r in got} == want and len(got) == len(want)


def test_e8_decoding():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8)) * 2
    p = lattice.decode_e8(x)
    short = lattice._minimal()
    assert len(short) == 240
    near = ((x[:, None] - p[:, None] - short[None]) ** 2).sum(2).min(1)
    assert (((x - p) ** 2).sum(1) <= near + 1e-9).all()  # no neighbour is nearer
    whole = (np.abs(2 * p - np.round(2 * p)) < 1e-9).all(1) & (p.sum(1) % 2 == 0)
    assert whole.all()


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(30):
        c = rng.normal(size=64)
        for k in range(rng.integers(1, 40) if g else 700):
            rows.append((len(rows) * 2, (c + rng.normal(size=64) * 0.12 * (k > 0)).astype(np.float32).tolist(), g % 3))
    odd = [None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [None] + [1.0] * 63, [float("inf")] * 64]
    rows += [(10_001 + 2 * k, v, 1) for k, v in enumerate(odd)] + [(20_001, rows[0][1], None), (None, rows[0][1], 0), (20_003, rows[0][1][:32], 0)]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("bucket", T.StringType())])
    df = spark.createDataFrame([(*r, "x") for r in rows], schema).repartition(6)
    good = [r for r in rows[:-9]]
    x = np.array([r[1] for r in good], np.float32).astype(float)
    u = x / np.sqrt((x * x).sum(1))[:, None]
    lab = np.array([r[2] for r in good])
    link = (u @ u.T >= 0.98) & (lab[:, None] == lab[None]) & ~np.eye(len(u), dtype=bool)
    comp = np.arange(len(u))
    while True:
        new = np.minimum(comp, np.where(link, comp[None], len(u)).min(1))
        if (new == comp).all():
            break
        comp = new
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.near_duplicates(df).collect()}
    for i, r in enumerate(good):
        assert got[r[0]] == (link[i].sum(), good[comp[i]][0], comp[i] == i)
    for r in rows[-9:]:
        assert got[r[0]] == (0, r[0], r[0] is not None)
    assert lattice.near_duplicates(df.limit(0)).collect() == []


def templated(n, same, shared, seed):
    """n documents of 300 words, the first `same` words alike; each tenth one shares its own words, up to `shared`, with
    the next."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    head, rows = [word() for _ in range(same)], []
    for i in range(n):
        own = [word() for _ in range(300 - same)]
        if i % 10 == 1:
            own[: shared - same] = rows[-1][1].split()[same:shared]
        rows.append((i, " ".join(head + own)))
    return rows


def sharing(rows, threshold):
    """Components of the pairs that share a table and are similar enough."""
    import pyarrow as pa

    sig = minhash._signatures(pa.record_batch([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", "text"]))
    keys = np.array(sig.column("keys").to_pylist())
    sets = []
    for _, t in rows:
        w = t.split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    comp, links = list(range(len(rows))), 0
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            same = keys[a] == keys[b]
            both = len(sets[a] & sets[b])
            if same[: minhash.HALF].any() and same[minhash.HALF :].any() and threshold[1] * both >= threshold[0] * (len(sets[a]) + len(sets[b]) - both):
                links += 1
                x, y = sorted((comp[a], comp[b]))
                comp = [x if c == y else c for c in comp]
    return comp, links


def test_large_buckets_are_compared_in_full(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 32)
    rows = templated(300, 240, 262, 1)  # 0.66 in general, planted pairs at 0.77
    want, links = sharing(rows, (75, 100))
    assert links >= 28
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(table(spark, rows).repartition(5)).collect()}
    assert [got[i] for i, _ in rows] == want


def test_documents_of_few_open_tables_are_compared(spark):
    rows = templated(300, 150, 165, 5)  # 0.33 in general, planted pairs at 0.37, which share few tables
    want, links = sharing(rows, (36, 100))
    assert links
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(table(spark, rows), (36, 100)).collect()}
    assert [got[i] for i, _ in rows] == want


@pytest.mark.parametrize("dim", [2, 4, 8, 16, 32])
def test_short_embeddings_are_found(spark, dim):
    rng = np.random.default_rng(dim)
    rows = []
    for k in range(300):  # a label per pair
        x, y = rng.normal(size=(2, dim))
        x /= np.sqrt(x @ x)
        y -= (x @ y) * x
        y /= np.sqrt(y @ y)
        rows += [(2 * k, x.tolist(), k), (2 * k + 1, (0.9801 * x + np.sqrt(1 - 0.9801**2) * y).tolist(), k)]
    got = lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(map(tuple, got)) == [(i, 1, i // 2 * 2, i % 2 == 0) for i in range(600)]


def test_embeddings_of_any_magnitude(spark):
    v = [3.0, -1.0, 2.0, 0.5]
    rows = [(k, [x * s for x in v], 0) for k, s in enumerate([1.0, 1e-200, 1e200, 1e-300, 1e300, 5e-310])] + [(10, [0.0] * 4, 0), (11, [-x for x in v], 0), (12, [-0.0, 0.0, 0.0, 0.0], 0)]
    got = lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(map(tuple, got)) == [(k, 5, 0, k == 0) for k in range(6)] + [(k, 0, k, True) for k in (10, 11, 12)]


def test_labels_of_any_kind(spark):
    v = np.random.default_rng(1).normal(size=64).tolist()
    rows = [(1, v, "a"), (2, v, "a"), (3, v, "b"), (4, v, None)]
    got = lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)]


def test_copies_and_repeated_ids_of_embeddings(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(2, 64))
    near = a + rng.normal(size=64) * 0.02
    rows = [(5, a), (3, a), (9, a), (9, a), (7, near), (20, b), (21, b * 2)]
    table = lambda rows: spark.createDataFrame([(i, x.tolist(), 1) for i, x in rows], "vec_id long, embedding array<double>, label int").repartition(3)
    got = sorted(map(tuple, lattice.near_duplicates(table(rows)).collect()))
    assert got == [(3, 3, 3, True), (5, 3, 3, False), (7, 3, 3, False), (9, 3, 3, False), (9, 3, 3, False), (20, 1, 20, True), (21, 1, 20, False)]
    # 30 has a vector of either group, which makes one component of both; 31 has two that are alike
    got = sorted(map(tuple, lattice.near_duplicates(table([*rows, (30, a), (30, b), (31, near), (31, a)])).collect()))
    ids = [r[0] for r in got]
    assert ids == [3, 5, 7, 9, 9, 20, 21, 30, 30, 31, 31] and {r[2] for r in got} == {3}
    links = {i: sorted(r[1] for r in got if r[0] == i) for i in ids}
    assert links == {3: [6], 5: [6], 7: [6], 9: [6, 6], 20: [2], 21: [2], 30: [2, 6], 31: [5, 5]}


def test_rows_of_one_id_link_by_any_text(spark):
    rng = random.Random(4)
    text = lambda n=60: [rng.choice("abcdefghij") + str(rng.randrange(1000)) for _ in range(n)]
    rows, want = [], {}
    for k in range(40):
        x, y = text(60 + k), text()
        close = lambda w: " ".join([*w[:-1], "other"])
        a, b, c = 10 * k + 1, 10 * k + 2, 10 * k + 3  # b has two texts, a is like one of them and c like the other
        rows += [(a, close(x)), (b, " ".join(x)), (b, " ".join(y)), (b, ""), (c, close(y) if k % 2 else " ".join(y))]
        want |= {a: a, b: a, c: a}
    got = minhash.near_duplicates(table(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows) and all(r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in got)

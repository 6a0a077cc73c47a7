"""Approximate neighbours, the Merkle manifest and hard negatives: brute force, recall, edges."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from parcelwise.llm import ann, merkle, negatives, topk

KINDS = "vec_id long, embedding array<double>, label int, VEC_ID string, row string, within string"


def vectors(n=400, dim=12, seed=3):
    """Clusters, a third of copies of one vector, repeated ids, and rows that take no part."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim)) * 4
    rows = [(i, (centres[i % 20] + rng.normal(size=dim)).tolist(), i % 4) for i in range(n)]
    rows += [(n + i, rows[7][1], i % 4) for i in range(n // 2)]
    rows += [(10, rows[11][1], 1), (10, rows[11][1], 1), (20, rows[3][1], 2)]
    odd = [[0.0] * dim, None, [], [1.0, None] * (dim // 2), [float("nan")] * dim, [float("inf")] * dim, [1.0, 2.0], [1.5, 2.0]]
    rows += [(5000 + 10 * k, v, 1) for k, v in enumerate(odd)]
    return [*rows, (None, rows[0][1], 1), (6000, rows[1][1], None)]


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], KINDS).repartition(parts)


def valid(rows, zero=True):
    keep = lambda v: v and all(c is not None and np.isfinite(c) for c in v) and (zero or any(v))
    return [(i, np.array(v), label) for i, v, label in rows if i is not None and keep(v)]


def asked_once(rows, every):
    out = {}
    for i, v, label in rows:
        if i % every == 0:
            key = (len(v), v.tolist(), label)
            out[i] = min(out.get(i, key), key)
    return {i: (np.array(v), label) for i, (_, v, label) in out.items()}


def nearest_brute(rows, every, k):
    rows = valid(rows, zero=False)
    out = []
    for q, (v, _) in asked_once([(i, x, 0) for i, x, _ in rows], every).items():
        best = sorted((float(np.sqrt(((x - v) ** 2).sum())), i) for i, x, _ in rows if i != q and len(x) == len(v))[:k]
        out += [(q, n + 1, i, round(d, 9)) for n, (d, i) in enumerate(best)]
    return sorted(out)


def test_chi_square_quantiles():
    for p, m, want in ((0.95, 8, 15.50731), (0.5, 2, 1.386294), (0.99, 6, 16.81189)):  # fixed values: of the usual tables
        assert abs(ann.chi_square_quantile(p, m) - want) < 1e-4


@pytest.mark.parametrize("block", [16, 64, 5000])
def test_neighbours_are_exact_where_the_test_is_sure(spark, block):
    rows = vectors()
    got = ann.nearest(table(spark, rows), "vec_id % 10 = 0", 5, sure=1 - 1e-12, block=block, fit=100).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got) == nearest_brute(rows, 10, 5)


def test_recall_of_the_query(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, None if r.embedding is None else list(map(float, r.embedding)), 0) for r in df.collect()]
    got = ann.nearest(df, "vec_id % 5 = 0", block=64).collect()
    want = nearest_brute(rows, 5, 10)
    pairs = {(q, i) for q, _, i, _ in want}
    assert len({(r.query_id, r.vec_id) for r in got} & pairs) >= 0.93 * len(pairs) and len(got) == len(want)
    at = {i: v for i, v, _ in valid(rows)}
    for r in got:
        assert abs(r.score - np.sqrt(((at[r.query_id] - at[r.vec_id]) ** 2).sum())) < 1e-12


def test_few_vectors_are_verified_where_they_lie_in_clusters():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(100, 64)) * 5
    x = centres[np.arange(4000) % 100] + rng.normal(size=(4000, 64))
    at, ids = ann.project(x), np.arange(4000)
    q = np.arange(0, 4000, 40)
    a, got, d, verified = ann.incremental(x[q], x, at[q], at, q, ids, 10, np.full(len(q), np.inf), ann.chi_square_quantile(ann.SURE, ann.AXES))
    assert verified < 0.15 * len(q) * len(x)
    exact = np.sqrt(((x[q][:, None] - x[None]) ** 2).sum(2))
    exact[np.arange(len(q)), q] = np.inf
    want = np.argsort(exact, axis=1, kind="stable")[:, :10]
    assert np.mean([len(set(got[a == i]) & set(want[i])) / 10 for i in range(len(q))]) >= 0.95


def test_neighbours_of_few_none_and_extreme_rows(spark):
    assert ann.nearest(table(spark, vectors()).limit(0), "vec_id % 10 = 0").count() == 0
    assert ann.nearest(table(spark, vectors()), "vec_id < 0").count() == 0
    far = [(10, [1e200, 0.0], 0), (11, [-1e200, 1e200], 0), (12, [1e-200, 0.0], 0), (13, [3e-200, 0.0], 0), (14, [1e308, -1e308], 0)]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.nearest(table(spark, far), "vec_id in (10, 12)", 2).collect()}
    assert got[(12, 1)][0] == 13 and abs(got[(12, 1)][1] / 2e-200 - 1) < 1e-9 and got[(12, 2)] == (10, 1e200)
    assert got[(10, 1)][0] == 12 and got[(10, 2)][0] == 13


def naive_levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([merkle.node_of(out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def naive_path(levels, i):
    path = []
    for nodes in levels[:-1]:
        first = i - i % 8
        run = nodes[first : first + 8]
        path.append((i % 8, run[: i % 8] + run[i % 8 + 1 :]))
        i //= 8
    return path


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 66, 511, 513, 577, 1300, 4096])
def test_traversal(n):
    leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    levels = naive_levels(leaves)
    assert merkle.levels_of(n) == len(levels) - 1
    assert merkle.root_of(leaves, merkle.levels_of(n)) == levels[-1][0]
    for i, path in enumerate(merkle.traversal(leaves, merkle.levels_of(n))):
        assert path == naive_path(levels, i)
        assert merkle.fold(leaves[i], [(p, "".join(o)) for p, o in path]) == levels[-1][0]


def documents(sizes=(4200, 3, 70, 1), seed=2):
    rng = random.Random(seed)
    rows = []
    for lang, n in zip((None, "de", "en", "Fr"), sizes, strict=True):
        rows += [(rng.randrange(10**6), rng.choice(["Aé B", "abc", "", None, "X" * 50]), lang, rng.choice(["s", None]), rng.choice([None, 5])) for _ in range(n)]
    return [*rows, *rows[:5], *[(77, "One", "en", "s", 3)] * 3, (77, "one", "en", "s", 3), (None, "A", "en", None, None), (None, "B", "en", "s", 1)]


def manifest_brute(rows):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, g, s, n: hashlib.sha256("".join(map(part, (i, s, g, n, t))).encode()).hexdigest()
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[g] = naive_levels([leaf(*r) for r in own])
    top = naive_levels([trees[g][-1][0] for g in order])
    root, out = top[-1][0], []
    lower = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            path = naive_path(trees[g], i) + naive_path(top, k)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = leaf(r[0], lower(r[1]) if bad else r[1], *r[2:])
            for place, others in path:
                node = merkle.node_of(others[:place] + [node] + others[place:])
            proof = hashlib.sha256("".join(o for _, others in path for o in others).encode()).hexdigest()
            out.append((r[0], leaf(*r), trees[g][-1][0], root, proof, node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [(4200, 3, 70, 1), (0, 0, 1, 0)])
def test_manifest(spark, sizes):
    rows = documents(sizes)
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, LANG string, tree string, node string")
    got = sorted((tuple(r) for r in merkle.lower_case_tampering(df.repartition(3)).collect()), key=str)
    want = manifest_brute(rows)
    assert got == want and {r[-1] for r in got} == ({True, False} if len(rows) > 100 else {r[-1] for r in want})


def test_manifest_of_one_row_and_of_none(spark):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    (row,) = merkle.lower_case_tampering(spark.createDataFrame([(1, "A", "en", "s", 1)], kinds)).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == hashlib.sha256(b"").hexdigest()
    assert merkle.lower_case_tampering(spark.createDataFrame([], kinds)).count() == 0


def test_manifest_does_not_depend_on_partitions(spark):
    rows = documents((300, 2, 9, 1))
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    one, other = (sorted(map(str, merkle.lower_case_tampering(spark.createDataFrame(rows, kinds).repartition(n)).collect())) for n in (1, 5))
    assert one == other


def negatives_brute(rows, every, k=5):
    rows = [(i, topk.whole(v), label) for i, v, label in valid(rows) if label is not None]
    out = []
    for q, (v, own) in asked_once(rows, every).items():
        scored = sorted((-int(x @ v), i, label) for i, x, label in rows if i != q and len(x) == len(v))
        for s, p in [(-s, i) for s, i, label in scored if label == own][:k]:
            some = [(i, -t) for t, i, label in scored if label != own and 80 * s <= -100 * t <= 100 * s][:k]
            out += [(q, p, n + 1, i, s, t) for n, (i, t) in enumerate(some)]
    return sorted(out)


@pytest.mark.parametrize("block", [50, 5000])
def test_hard_negatives(spark, block):
    rows = vectors()
    rng = np.random.default_rng(8)
    rows += [(7000 + i, (rng.normal(size=12) * 0.02).tolist(), i % 2) for i in range(60)]  # many equal scores
    got = negatives.hard_negatives(table(spark, rows), "vec_id % 10 = 0", block=block, fit=100).collect()
    assert sorted(map(tuple, got)) == negatives_brute(rows, 10)


def test_hard_negatives_edges(spark):
    assert negatives.hard_negatives(table(spark, vectors()).limit(0), "vec_id % 10 = 0").count() == 0
    assert negatives.hard_negatives(table(spark, vectors()), "vec_id < 0").count() == 0
    opposite = [(10, [1.0, 0.0], 1), (11, [-1.0, 0.0], 1), (12, [-0.9, 0.0], 2), (13, [0.0, 1.0], 2)]
    assert negatives.hard_negatives(table(spark, opposite), "vec_id % 10 = 0").count() == 0
    large = [(i, [float(1 + i % 5) * 1e6, 3e5 * (i % 7)], i % 2) for i in range(1, 40)]
    got = sorted(map(tuple, negatives.hard_negatives(table(spark, large), "vec_id % 10 = 0", fit=10).collect()))
    exact = [(i, [int(256 * c) for c in v], label) for i, v, label in large]
    want = []
    for q, v, own in exact:
        if q % 10 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, v, strict=True)), i, label) for i, x, label in exact if i != q)
            for s, p in [(-s, i) for s, i, label in scored if label == own][:5]:
                some = [(i, -t) for t, i, label in scored if label != own and 80 * s <= -100 * t <= 100 * s][:5]
                want += [(q, p, n + 1, i, s, t) for n, (i, t) in enumerate(some)]
    assert got == sorted(want)


def test_approximations_bound_scores_and_drop_most(sf_dir):
    import pyarrow.parquet as pq

    x = topk.whole(np.array(pq.read_table(f"{sf_dir}/embeddings.parquet")["embedding"].to_pylist(), float))
    edges = negatives.cell_edges(x[:200])
    codes, loose = negatives.codes_of(x, edges)
    bounds = negatives.Bounds(edges)
    for q in x[::50]:
        least, most = (bounds.look_up(t, codes) for t in bounds.tables(q))
        score = x @ q
        assert ((least <= score) & (score <= most))[~loose].all() and loose.mean() < 0.05
        low, high = np.array([15000]), np.array([22000])
        rows = negatives.possible(q, bounds, codes, loose, low, high, 5)
        inside = np.flatnonzero((score >= 15000) & (score <= 22000))
        best = inside[np.argsort(-score[inside], kind="stable")][:5]
        assert set(best) <= set(rows.tolist()) and len(rows) < len(x) / 4

"""The corpus pipeline against a brute-force version, and its edges."""

import hashlib
from collections import Counter, defaultdict

import pytest

from parcelwise.llm import bpe
from parcelwise.llm.common import stored
from tests.llm.test_dedup import WORD, near_brute, repeats_brute

pipeline = pytest.importorskip("corpus_pipeline")
P = pytest.importorskip("public_tokenizers")


def mixed_brute(rows):
    """rows: (doc_id, text, source); the texts that a mix takes, a pass after the other."""
    size = {i: len(WORD.findall(t)) for i, t, _ in rows}
    total = Counter()
    for i, _, s in rows:
        total[s] += size[i]
    order = sorted(s for s in total if s is not None) + [None] * (None in total)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, rest, left = {}, set(order), 1.5 * sum(total.values())
    while rest:
        level = left / sum(weight[s] for s in rest)
        full = {s for s in rest if level * weight[s] > 2 * total[s]}
        target |= {s: 2.0 * total[s] if s in full else level * weight[s] for s in (full or rest)}
        left -= sum(target[s] for s in full)
        rest = rest - full if full else set()
    place = lambda r: (int(hashlib.md5(str(r[0]).encode()).hexdigest()[:15], 16), r[0])
    out, at = [], defaultdict(int)
    for i, t, s in sorted(rows, key=place):
        for k in range(2):
            n = min(size[i], int(target[s]) - at[s] - k * total[s])
            if n > 0:
                out.append((i, t if n == size[i] else " ".join(WORD.findall(t)[:n])))
        at[s] += size[i]
    return out


def test_against_brute_force(spark, sf_dir):
    import tiktoken

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    near = near_brute([r[:2] for r in rows])
    rows = [r for r in rows if near[r[0]][2]]
    cut = {i: (n, gone, text) for i, n, gone, text in repeats_brute([r[:2] for r in rows])}
    rows = [(i, cut[i][2] if cut[i][1] else t, s) for i, t, s in rows if not cut[i][1] or cut[i][1] < cut[i][0]]
    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    want = []
    for i, t in mixed_brute(rows):
        ids = enc.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = [tuple(r) for r in pipeline.run(spark, sf_dir).collect()]
    assert sorted(got) == sorted(want)


def test_edges(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "src0", 0), (None, "the and of " * 20, None, None, 1), (None, "a walk in the", "en", "zz", 3), (10**6 + 2, "the first of two", "en", "zz", 1), (10**6 + 2, "the other of two", None, "zz", None)], docs.schema)
    now, _ = stored(docs.limit(30).union(odd), "odd")
    counts = []
    for name, stage in pipeline.STAGES:
        now, _ = stored(stage(spark, now, sf_dir), "stage")
        if name != pipeline.STAGES[-1][0]:
            assert now.columns == list(pipeline.COLUMNS)
        counts.append(now.count())
    assert counts[0] == 30 + 4 and counts[1] < counts[0] and counts[4] == counts[3] > 0


def test_empty_table(spark, sf_dir):
    now, _ = stored(spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0), "none")
    for _, stage in pipeline.STAGES:
        now, _ = stored(stage(spark, now, sf_dir), "stage")
    assert now.count() == 0


def test_further_columns_do_no_harm(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(25)
    plain, wide = docs, docs.selectExpr("1 as slot", "'x' as TEXT", "doc_id", "text", "lang", "source", "n_chars", "'y' as Source", "array(1) as words", "'z' as lang_pred", "2 as t")
    plain, _ = stored(plain, "plain")
    for _, stage in pipeline.STAGES:
        plain, _ = stored(stage(spark, plain, sf_dir), "stage")
        wide = stage(spark, wide, sf_dir)
        assert wide.columns == plain.columns
        wide, _ = stored(wide, "stage")
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, plain.collect()))

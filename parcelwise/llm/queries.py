"""The queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.llm import ann, bpe, langid, lattice, licenses, merkle, minhash, mixing, negatives, sharding, substring, topk, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archived(spark, _table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs.where(F.col("doc_id").isNotNull() & ~langid.held_out())))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.without_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op11_approximate_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.lower_case_tampering(_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return negatives.hard_negatives(vectors, "vec_id % 100 = 0")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_warc, op2_minhash_near_dedup, op3_extendible_sharding, op4_license_scan, op5_source_mixing, op6_exact_top_k,
        op7_language_id, op8_embedding_near_dedup, op9_substring_dedup, op10_byte_bpe, op11_approximate_nearest, op12_merkle_manifest,
        op13_hard_negatives,
    )
    return {f.__name__: f for f in every}


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"



def _license_sql() -> str:
    """Phrases by comparison at every word; each file's words by a ranking, votes by a join, and phrases at their places by
    another."""
    ts, ps = licenses.templates(), licenses.phrases()
    base = [ps.index(t.phrases[0]) for t in ts[: len(licenses.BASE)]]
    lists = ", ".join(f"CASE WHEN list_has_all(ws, {list(p)!r}) THEN list_filter(range(1, len(ws) - {len(p) - 2}), lambda i: ws[i:i+{len(p) - 1}] = {list(p)!r}) ELSE [] END AS p{k}" for k, p in enumerate(ps))
    given = "list_filter([" + ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{t.label}' END" for t, k in zip(ts, base, strict=False)) + "], lambda x: x IS NOT NULL)"
    at = " || ".join(f"p{k}" for k in base)
    words = ", ".join(f"({k}, {o}, '{w}')" for k, t in enumerate(ts) for o, w in enumerate(t.words))
    parts = ", ".join(f"({k}, '{t.label}', {len(t.phrases)}, {ps.index(p)}, {licenses.offset(t, p)})" for k, t in enumerate(ts) for p in t.phrases)
    own = ", ".join(f"({k}, {ps.index(p)}, '{w}')" for k, t in enumerate(ts) for p in t.phrases for w in p)
    found = " UNION ALL ".join(f"SELECT r, {k} AS p, unnest(p{k}) - 1 AS i FROM p" for k in range(len(ps)))
    return f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS ws FROM documents),
tw(t, o, word) AS (VALUES {words}), tp(t, label, phrases, p, o) AS (VALUES {parts}), pw(t, p, word) AS (VALUES {own}),
h AS (SELECT r, i - 1 AS i, ws[i] AS word FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) WHERE ws[i] IN (SELECT word FROM tw)),
f AS (SELECT word, count(DISTINCT r) AS n FROM (SELECT DISTINCT word FROM tw) LEFT JOIN h USING (word) GROUP BY 1),
pool AS (SELECT t, word, n FROM (SELECT t, word, n, row_number() OVER (PARTITION BY t ORDER BY n, word) AS rn FROM (SELECT DISTINCT t, word FROM tw) JOIN f USING (word)) WHERE rn <= {licenses.POOL}),
mine AS (SELECT r, t, word FROM (SELECT r, t, word, row_number() OVER (PARTITION BY r, t ORDER BY n, word) AS rn FROM (SELECT DISTINCT r, word FROM h) JOIN pool USING (word)) WHERE rn <= {licenses.RARE}
    UNION SELECT r, t, word FROM (SELECT DISTINCT r, word FROM h) JOIN (SELECT t, word, row_number() OVER (PARTITION BY t, p ORDER BY n, word) AS rn FROM (SELECT DISTINCT t, p, word FROM pw) JOIN f USING (word)) USING (word) WHERE rn <= {licenses.ANCHORS}),
size AS (SELECT t, least({licenses.RARE}, count(*)) AS size FROM pool GROUP BY 1),
spots AS (SELECT r, t, i - o AS s, least(1, count(DISTINCT word) / max(size)::DOUBLE) AS share FROM h JOIN mine USING (r, word) JOIN tw USING (t, word) JOIN size USING (t) GROUP BY 1, 2, 3 HAVING count(DISTINCT word) >= {licenses.AGREE}),
best AS (SELECT r, max(share) AS share FROM spots GROUP BY 1),
p AS (SELECT r, doc_id, ws, {lists} FROM w), found AS ({found}),
more AS (SELECT r, list(DISTINCT label) AS labels FROM (SELECT r, t, s, label FROM spots JOIN tp USING (t) JOIN found USING (r, p) WHERE abs(i - tp.o - s) <= {licenses.DRIFT} GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT p) = max(phrases)) GROUP BY 1),
out AS (SELECT r, doc_id, ws, {at} AS spans, {given} AS base FROM p)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(spans) AS BIGINT) AS n_base, list_min(spans) - 1 AS first_word, list_max(spans) - 1 AS last_word,
    array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(base || coalesce(labels, []))), ',') AS labels, coalesce(share, 0) AS score
FROM out LEFT JOIN best USING (r) LEFT JOIN more USING (r)"""


def _tree_sql(name: str, nodes: str, depth: int) -> str:
    """{name}0 to {name}{depth}: nodes (tree, pos, node, n) level by level; {name}s0 ...: each node's place and others."""
    parts = [f"{name}0 AS ({nodes})"]
    for k in range(depth):
        parts.append(f"""{name}s{k} AS (SELECT tree, pos, pos % 8 AS place, array_to_string(list_concat(run[:pos % 8], run[pos % 8 + 2:]), '') AS others
    FROM {name}{k} JOIN (SELECT tree, pos // 8 AS up, list(node ORDER BY pos) AS run FROM {name}{k} GROUP BY ALL) ON up = pos // 8 AND {name}{k}.tree = tree_1 WHERE n > 1)""".replace("SELECT tree, pos // 8 AS up", "SELECT tree AS tree_1, pos // 8 AS up"))
        parts.append(f"""{name}{k + 1} AS (SELECT tree, pos // 8 AS pos, CASE WHEN max(n) > 1 THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE max(node) END AS node, (max(n) + 7) // 8 AS n FROM {name}{k} GROUP BY 1, 2)""")
    return ",\n".join(parts)


def _merkle_sql(depth: int = 8, over: int = 3) -> str:
    """Trees unrolled: {8} ** depth rows a language, {8} ** over languages. The checksum is computed bit by bit."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    bits = "list_reduce(list_concat([4294967295], flatten([[-ord(c) - 1, 0, 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')])), lambda a, b: CASE WHEN b < 0 THEN xor(a, -b - 1) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)"
    text = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    joins = "".join(f" LEFT JOIN ds{k} ON ds{k}.tree = p.tree AND ds{k}.pos = p.pos // {8**k}" for k in range(depth)) + "".join(f" LEFT JOIN ls{k} ON ls{k}.pos = g.pos // {8**k}" for k in range(over))
    steps = [f"ds{k}" for k in range(depth)] + [f"ls{k}" for k in range(over)]
    folds, at = [], "f"
    for k, x in enumerate(steps):
        folds.append(f"f{k} AS (SELECT * EXCLUDE (f), CASE WHEN o{k} IS NULL THEN f ELSE sha256(substr(o{k}, 1, 64 * c{k}) || f || substr(o{k}, 64 * c{k} + 1)) END AS f FROM {at})")
        at = f"f{k}"
    return f"""
WITH x AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS tree, {leaf("text")} AS leaf, CASE WHEN xor({bits}, 4294967295) % 3 = 0 THEN {leaf(text)} END AS other FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM x),
{_tree_sql("d", "SELECT tree, pos, leaf AS node, n FROM p", depth)},
{_tree_sql("l", f"SELECT 0 AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, node, count(*) OVER () AS n, tree AS of FROM d{depth}", over)},
f AS (SELECT p.doc_id, p.leaf, g.node AS subroot, l{over}.node AS root, coalesce(p.other, p.leaf) AS f, {", ".join(f"{x}.others AS o{k}, {x}.place AS c{k}" for k, x in enumerate(steps))}
    FROM p JOIN l0 g ON g.of = p.tree CROSS JOIN l{over}{joins}),
{", ".join(folds)}
SELECT doc_id, leaf, subroot, root, sha256({" || ".join(f"coalesce(o{k}, '')" for k in range(len(steps)))}) AS proof_sha256, f AS folded_root, f = root AS verified FROM {at}"""


_ORACLE = {
    "op1_warc": f"""
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT d, min(page_id) AS m FROM p WHERE n >= {warc.LEAST} GROUP BY 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN m < page_id OR page_id IS NULL AND m IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN m < page_id OR page_id IS NULL THEN m END AS refers_to FROM p LEFT JOIN f USING (d)""",
    # A plain extendible hash: all rows begin in one bucket; those of oversized buckets go on to the next depth.
    "op3_extendible_sharding": f"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-' || md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS h, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n FROM documents),
b AS (SELECT r, doc_id, h, n, 0 AS depth, sum(n) OVER () AS bytes, min(h) OVER () <> max(h) OVER () AS several FROM t
    UNION ALL SELECT r, doc_id, h, n, depth + 1, sum(n) OVER w, min(h) OVER w <> max(h) OVER w FROM b WHERE bytes > {sharding.LIMIT} AND several AND depth < {sharding.BITS}
    WINDOW w AS (PARTITION BY h >> ({sharding.BITS} - 1 - depth)))
SELECT doc_id, n AS n_bytes, CAST(depth AS INTEGER) AS depth, h >> ({sharding.BITS} - depth) AS prefix, CAST(0 AS BIGINT) AS page, CAST(bytes AS BIGINT) AS shard_bytes
FROM b WHERE NOT (bytes > {sharding.LIMIT} AND several)""",
    "op4_license_scan": _license_sql(),
    "op5_source_mixing": f"""
WITH t AS (SELECT doc_id, source, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-' || md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS h, CAST(coalesce(len({_WORDS.format("text")}), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid FROM t GROUP BY 1),
w AS (SELECT *, CAST([3, 1, 2][(sid - 1) % 3 + 1] AS DOUBLE) AS w, CAST(2 * source_size AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS total FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, sid) AS rn,
    (total - coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own FROM w),
f AS (SELECT min(rn) AS rn, min_by(own, rn) AS level FROM o WHERE own <= cap / w),
g AS (SELECT o.sid, o.source, o.source_size, CASE WHEN f.rn IS NULL OR o.rn < f.rn THEN cap ELSE least(cap, f.level * w) END AS target FROM o, f),
p AS (SELECT t.doc_id, t.size, g.sid, g.source_size, g.target, CAST(floor(g.target) AS BIGINT) AS upto,
    CAST(coalesce(sum(t.size) OVER (PARTITION BY t.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
    FROM t JOIN g ON t.source IS NOT DISTINCT FROM g.source),
e AS (SELECT sid, CAST(floor(target) AS BIGINT) AS words, CAST(sum(CAST(floor(target) AS BIGINT)) OVER (ORDER BY sid) AS BIGINT) AS upto, CAST(sum(CAST(floor(target) AS BIGINT)) OVER () AS BIGINT) AS everything FROM g WHERE floor(target) > 0),
n AS (SELECT k + k // 64 + 64 * (1 + CAST(ceil(log2(k + 1)) AS BIGINT)) AS n FROM (SELECT (max(everything) + {mixing.BLOCK - 1}) // {mixing.BLOCK} AS k FROM e)),
u AS (SELECT id, CAST(id % 2147483648 * {mixing.GOLDEN} % 4294967296 AS DOUBLE) / 4294967296 AS u FROM n, range(0, n.n) r(id)),
c AS (SELECT sid, id, row_number() OVER (PARTITION BY sid ORDER BY id) - 1 AS rank, (words + {mixing.BLOCK - 1}) // {mixing.BLOCK} AS blocks FROM u JOIN e
    ON u >= CAST(upto - words AS DOUBLE) / everything AND (u < CAST(upto AS DOUBLE) / everything OR upto = everything)),
had AS (SELECT sid, (words + {mixing.BLOCK - 1}) // {mixing.BLOCK} AS blocks, (SELECT count(*) FROM c WHERE c.sid = e.sid) AS had FROM e),
late AS (SELECT sid, blocks, had, coalesce(sum(blocks - had) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM had WHERE had < blocks),
sl AS (SELECT sid, rank, id AS slot FROM c WHERE rank < blocks UNION ALL SELECT sid, rank, CAST(n.n + ahead + rank - had AS BIGINT) FROM n, late, range(had, blocks) r(rank)),
q AS (SELECT *, CAST(greatest(0, least(start + size, upto) - start) + greatest(0, least(source_size + start + size, upto) - source_size - start) AS BIGINT) AS taken FROM p)
SELECT doc_id, size, source_size, target, taken, sl.slot AS first_slot FROM q LEFT JOIN sl ON taken > 0 AND sl.sid = q.sid AND sl.rank = start // {mixing.BLOCK}""",
    "op12_merkle_manifest": _merkle_sql(),
    "op13_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS anchor_id, x.vec_id, q.label = x.label AS same, CAST(list_sum([a[1] * a[2] FOR a IN list_zip(q.w, x.w)]) AS BIGINT) AS score
    FROM v q JOIN v x ON q.vec_id <> x.vec_id AND len(q.w) = len(x.w) WHERE q.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5""",
    "op2_minhash_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({_WORDS.format(_LOWER)}, []) AS ws FROM documents),
sh AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE [array_to_string(ws[i:i+4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS g FROM sh),
k AS (SELECT doc_id, len(s) AS n FROM sh),
hit AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM hit JOIN k x ON x.doc_id = a JOIN k y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
r AS (SELECT a AS x, a AS y FROM both_ways UNION SELECT r.x, l.b FROM r JOIN both_ways l ON l.a = r.y),
c AS (SELECT x, min(y) AS m FROM r GROUP BY 1)
SELECT k.doc_id, CAST(k.n AS BIGINT) AS n_shingles, coalesce(c.m, k.doc_id) AS component_id, coalesce(c.m, k.doc_id) = k.doc_id AS kept
FROM k LEFT JOIN c ON c.x = k.doc_id""",
    "op6_exact_top_k": """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum([a[1] * a[2] FOR a IN list_zip(q.w, x.w)]) AS BIGINT) AS score
    FROM v q JOIN v x ON q.vec_id <> x.vec_id AND len(q.w) = len(x.w) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op8_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS w FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT * FROM v WHERE list_inner_product(w, w) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.w, b.w) >= 0.98),
r AS (SELECT a AS x, a AS y FROM link UNION SELECT r.x, l.b FROM r JOIN link l ON l.a = r.y),
c AS (SELECT x, min(y) AS m FROM r GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM link GROUP BY 1)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.m, e.vec_id) AS component_id, coalesce(c.m, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN c ON c.x = e.vec_id LEFT JOIN n ON n.a = e.vec_id""",
    "op9_substring_dedup": f"""
WITH w AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13),
keyed AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i+12], ' ')) AS g FROM win),
own AS (SELECT g, min(doc_id) AS lo FROM keyed GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT k.doc_id, unnest(range(k.i, k.i + 13)) AS p FROM keyed k JOIN own USING (g) WHERE own.lo < k.doc_id)),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS x FROM w),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) AS t, count(*) AS n FROM word ANTI JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)

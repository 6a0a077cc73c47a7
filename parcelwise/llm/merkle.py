"""A Merkle manifest of a dataset: a leaf per row, a tree per group, a tree over the groups' roots, a proof per row.

Digests are lower-case hexadecimal SHA-256, and a node is the digest of its children's digests as text, one after the
other. A row's leaf is the digest of its columns, each `-` if null, else its length in bytes, `:` and its value. Within a
tree every WIDTH consecutive nodes (the last run: fewer, even one) become one, until one is left; a single leaf is the root.

Positions come from a sort by ranges (group, order, then the leaf and a stored row number, so ties and repeated rows have
a place each), counts of each range, and their sums: no group meets in one task. Trees are then built in aligned blocks of
WIDTH ** DEPTH nodes, a task each; the roots of blocks are the nodes of the next step, so n rows take about log(n) /
log(WIDTH ** DEPTH) steps, each that much smaller than the one before.

Proofs of a block's nodes are emitted one after the other by fractal traversal: the block's levels are cut into stacked
subtrees of HEIGHT levels. Of each stack the existing subtree, which the current path runs through, is kept, and the
desired one after it grows by one leaf with each proof emitted; it is complete when the path enters it. So a task holds
the leaf digests of one block, two subtrees a stack, and one path. The path from a block's root upwards is made in the
same way by the steps above, and joined to the block: one row a block, appended as the proofs are hashed; proofs
themselves are never stored or shuffled.

A row is tampered with by another value in its columns (changed); its proof stays. The proof is folded from the tampered
leaf up, and the row is verified where that gives the root. Rows without doc_id come first in their group; of equal
doc_ids, the smaller leaf first. Null group: first. Empty texts count as values, long ones are hashed in the JVM, row by
row. An empty table gives no rows. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.llm.common import pick, small_batches, stored

#: Children of a node; levels of a block; levels of a subtree in the traversal.
WIDTH, DEPTH, HEIGHT = 8, 4, 2
_SPAN = WIDTH**DEPTH
_STEP = pa.struct([("place", pa.int32()), ("others", pa.string())])
_PATH = "array<struct<place:int,others:string>>"


def node_of(children: list[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def levels_of(n: int, most: int = 64) -> int:
    """How many times n nodes are put together until one is left, most at most."""
    k = 0
    while n > 1 and k < most:
        n, k = -(-n // WIDTH), k + 1
    return k


class Subtree:
    """Takes leaves from left to right; keeps the nodes of levels low to high - 1, and of those below one run each."""

    def __init__(self, low: int, high: int):
        self.high = high
        self.runs: list[list[str]] = [[] for _ in range(high + 1)]
        self.nodes: dict[int, list[str]] = {k: [] for k in range(low, high)}

    def push(self, node: str, level: int = 0) -> None:
        while True:
            if level in self.nodes:
                self.nodes[level].append(node)
            run = self.runs[level]
            run.append(node)
            if level == self.high or len(run) < WIDTH:
                return
            node, level = node_of(run), level + 1
            run.clear()

    def close(self) -> None:
        """No more leaves: shorter runs become nodes too."""
        for level in range(self.high):
            if run := self.runs[level]:
                node = node_of(run)
                self.runs[level] = []
                self.push(node, level + 1)

    @property
    def root(self) -> str:
        return self.runs[self.high][0]


def root_of(leaves: list[str], levels: int) -> str:
    tree = Subtree(levels, levels)
    for leaf in leaves:
        tree.push(leaf)
    tree.close()
    return tree.root


def traversal(leaves: list[str], levels: int) -> Iterator[list[tuple[int, list[str]]]]:
    """The path of each leaf in order: at each level its node's place in its run, and the run's other nodes."""
    stacks = [(low, min(low + HEIGHT, levels)) for low in range(0, levels, HEIGHT)]
    spans = [WIDTH**high for _, high in stacks]
    existing, desired = [Subtree(*s) for s in stacks], [Subtree(*s) for s in stacks]
    for tree, span in zip(existing, spans, strict=True):
        for leaf in leaves[:span]:
            tree.push(leaf)
        tree.close()
    for i in range(len(leaves)):
        for s, span in enumerate(spans):
            if i and i % span == 0:
                desired[s].close()
                existing[s], desired[s] = desired[s], Subtree(*stacks[s])
        path = []
        for (low, high), span, tree in zip(stacks, spans, existing, strict=True):
            for level in range(low, high):
                at = i % span // WIDTH**level
                first, place = at - at % WIDTH, at % WIDTH
                run = tree.nodes[level][first : first + WIDTH]
                path.append((place, run[:place] + run[place + 1 :]))
        yield path
        for s, span in enumerate(spans):
            if i + span < len(leaves):
                desired[s].push(leaves[i + span])


def fold(leaf: str, path: list[tuple[int, str]]) -> str:
    """The root that a leaf and its path lead to; a level's others are one text of digests."""
    for place, others in path:
        leaf = sha256((others[: 64 * place] + leaf + others[64 * place :]).encode()).hexdigest()
    return leaf


def _here(table: pa.Table) -> int:
    return levels_of(table.column("n")[0].as_py(), DEPTH)


def _block_root(table: pa.Table) -> pa.Table:
    """The root of a block as a node of the next step: (tree, pos, node, n)."""
    table = table.sort_by("pos")
    root = root_of(table.column("node").to_pylist(), _here(table))
    n = table.column("n")[0].as_py()
    return pa.table({"tree": [table.column("tree")[0].as_py()], "pos": pa.array([table.column("pos")[0].as_py() // _SPAN]), "node": [root], "n": pa.array([-(-n // _SPAN)])})


def _block_paths(table: pa.Table) -> pa.Table:
    """(tree, pos, own): the path of each node within its block."""
    table = table.sort_by("pos")
    own = [[{"place": p, "others": "".join(o)} for p, o in path] for path in traversal(table.column("node").to_pylist(), _here(table))]
    return pa.table({"tree": table.column("tree"), "pos": table.column("pos"), "own": pa.array(own, pa.list_(_STEP))})


_PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _block_proofs(table: pa.Table, above: pa.Table) -> pa.Table:
    """Digests of all proofs of a block; above: the one row with the path from the block's root."""
    table, above = table.sort_by("pos"), above.slice(0, 1).to_pylist()[0]
    upper = [(x["place"], x["others"]) for x in above["path"]]
    ending = "".join(o for _, o in upper).encode()
    leaves, changed = table.column("node").to_pylist(), table.column("changed").to_pylist()
    proofs, folded = [], []
    for leaf, other, path in zip(leaves, changed, traversal(leaves, _here(table)), strict=True):
        own = [(place, "".join(others)) for place, others in path]
        digest = sha256("".join(o for _, o in own).encode())
        digest.update(ending)
        proofs.append(digest.hexdigest())
        folded.append(fold(other or leaf, own + upper))
    n = table.num_rows
    same = lambda c: pa.array([above[c]] * n, pa.string())
    return pa.table({
        "doc_id": table.column("doc_id"), "leaf": table.column("node"), "subroot": same("subroot"), "root": same("root"), "proof_sha256": pa.array(proofs, pa.string()),
        "folded_root": pa.array(folded, pa.string()), "verified": pa.array([f == above["root"] for f in folded], pa.bool_()),
    })


def _block() -> Column:
    return F.expr(f"pos div {_SPAN}")


def _numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds pos, a row's place from 0 within its tree in a total order, and n, the tree's rows."""
    dealt, _ = stored(df.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id()), "dealt")
    dealt = dealt.withColumn("part", F.shiftright("at", 33))
    runs = dealt.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("held"))
    tree = Window.partitionBy("tree")
    ahead = F.sum("held").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs, _ = stored(runs.select("tree", "part", (F.coalesce(ahead, F.lit(0)) - F.col("first")).alias("shift"), F.sum("held").over(tree).alias("n")), "runs")
    return dealt.join(runs, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _climb(nodes: DataFrame) -> list[DataFrame]:
    """The nodes (tree, pos, node, n) of every step, up to one node a tree."""
    steps = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0  # one number
    while most > 1 or len(steps) == 1:
        up, _ = stored(steps[-1].select("tree", "pos", "node", "n").groupBy("tree", _block()).applyInArrow(_block_root, "tree string, pos long, node string, n long"), "nodes")
        steps.append(up)
        most = -(-most // _SPAN)
    return steps


def _descend(steps: list[DataFrame], top: DataFrame) -> DataFrame:
    """Continues top(tree, pos, path, ...) down the steps, without their first: paths of all nodes of steps[1]."""
    rest = [c for c in top.columns if c not in ("tree", "pos", "path")]
    for nodes in reversed(steps[1:-1]):
        own = nodes.groupBy("tree", _block()).applyInArrow(_block_paths, f"tree string, pos long, own {_PATH}")
        above = top.withColumnRenamed("pos", "block")
        top, _ = stored(own.withColumn("block", _block()).join(above, ["tree", "block"]).select("tree", "pos", F.concat("own", "path").alias("path"), *rest), "paths")
    return top


def digest_of(*columns: Column) -> Column:
    """The leaf of columns, which are texts or whole numbers."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in text]), 256)


def manifest(docs: DataFrame, columns: dict[str, Column], changed: dict[str, Column], tampered: Column, group: str = "lang") -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of docs. columns: what a leaf is made of, in
    order; changed: other values for some of them, where the condition tampered holds."""
    small_batches(docs.sparkSession)
    tree = F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit(""))  # in the order of UTF-8 bytes, null first
    other = F.when(tampered, digest_of(*[changed.get(k, c) for k, c in columns.items()]))
    rows = docs.select(F.col("doc_id").cast("long"), tree.alias("tree"), digest_of(*columns.values()).alias("node"), other.alias("changed"))
    rows, _ = stored(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
    leaves = _numbered(rows, ["doc_id", "node", "row"])
    steps = _climb(leaves)
    subroots = steps[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "node")
    groups = _numbered(subroots, ["of"])
    over = _climb(groups)
    root = over[-1].select("tree", F.col("node").alias("root"))
    top = _descend(over, over[-1].select("tree", "pos", F.array().cast(_PATH).alias("path")))
    own = groups.groupBy("tree", _block()).applyInArrow(_block_paths, f"tree string, pos long, own {_PATH}").withColumn("block", _block())
    paths = own.join(top.withColumnRenamed("pos", "block"), ["tree", "block"]).select("tree", "pos", F.concat("own", "path").alias("path"))
    top = groups.join(paths, ["tree", "pos"]).join(root, "tree").select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("node").alias("subroot"), "root")
    top, _ = stored(top, "subroots")
    above = _descend(steps, top).withColumnRenamed("pos", "block")
    return leaves.withColumn("block", _block()).groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(_block_proofs, _PROOFS)


def lower_case_tampering(docs: DataFrame) -> DataFrame:
    """The manifest of documents, where 3 divides the CRC-32 of a doc_id's digits tampered with by lower-casing A-Z."""
    docs = pick(docs, "doc_id", "source", "lang", "n_chars", "text")
    columns = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return manifest(docs, columns, {"text": F.translate("text", upper, upper.lower())}, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)

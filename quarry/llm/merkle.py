r"""Merkle manifest of a dataset: a digest for every row, source and the whole.

A row's leaf is the digest of its fields.  Per source, leaves ascend by ``doc_id`` and
every ``FANOUT`` consecutive nodes become one until a single node, the subroot, is
left; the last run of a level may be shorter and is hashed as it is, without padding.
Subroots, in the order of their sources, are the leaves of one more tree with the root.

Building.  Rows are sorted into ranges, and numbered from the ranges' totals.  A task
reads its range once and keeps a stack of unfinished runs, one per level, as a mountain
range does: a finished run becomes a node, which may finish the run above.  It emits
each node, and at the range's edges the peaks, whose run lies partly elsewhere.  Peaks
are then merged in rounds: a round's group holds the peaks under one node ``HEIGHT``
levels higher, so it has a bounded size however large the tree is.

Proofs.  Paths go down in the same steps of ``HEIGHT`` levels: the nodes under one node
are grouped with its path and get their own, the last time the leaves.

Defined cases: a null field is written as ``-``; null sources form a tree of their own,
the first; rows without ``doc_id`` come first in their source and are never tampered
with; rows that repeat an id are ordered by leaf, and equal rows are leaves each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import saved, written

FANOUT = 3
#: Levels that a group spans: FANOUT ** HEIGHT leaves at most.
HEIGHT = 8
#: Rows of an Arrow batch that a task returns.
BATCH = 8192

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "tree string, n long, level int, idx long, hash binary, peak boolean"
PATHS = "tree string, block long, path binary, subroot binary, root binary"
PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}

Key = tuple[pa.Scalar, ...]


def schema_of(text: str) -> pa.Schema:
    return pa.schema([(name, KINDS[kind]) for name, kind in (field.split() for field in text.split(", "))])


def table_of(text: str, rows: list[tuple]) -> pa.Table:
    schema = schema_of(text)
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.table([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def combined(run: list[bytes]) -> bytes:
    """Digest of a run's digests as hex text."""
    return sha256("".join(h.hex() for h in run).encode()).digest()


def height(n: int) -> int:
    """Level of the single top node over n leaves."""
    level = 0
    while FANOUT**level < n:
        level += 1
    return level


def width(n: int, level: int) -> int:
    """Nodes of a level over n leaves."""
    return -(-n // FANOUT**level)


# Leaves.


def leaf(**changed: Column) -> Column:
    """SHA-256 of a row's fields: ``-`` for null, else byte count, ``:`` and value."""
    parts = []
    for name in FIELDS:
        value = changed.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """tree (orders sources, null first), doc_id, leaf, and the leaf that a check meets after tampering.

    Where 2 divides crc32 of the decimal id, tampering deletes the text's line ends.
    """
    tampers = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    tree = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("tree")
    text = F.col("text").cast("string")
    lost = F.when(tampers & F.contains(text, F.lit("\n")), leaf(text=F.replace(text, F.lit("\n"), F.lit(""))))
    return docs.select(tree, F.col("doc_id").cast("long"), leaf().alias("leaf"), lost.alias("tampered"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds idx, the row's place in its tree from 0, and n, the rows of its tree."""
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()))
    order = [*order, "row"]
    dealt = saved(rows.repartitionByRange("tree", *order).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part", "tree").agg(F.count(F.lit(1)).alias("rows"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "tree", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"), F.sum("rows").over(tree).alias("n"))
    place = F.row_number().over(Window.partitionBy("part", "tree").orderBy(*order)).cast("long")
    return saved(dealt.withColumn("idx", place - 1).join(starts, ["part", "tree"]).withColumn("idx", F.col("start") + F.col("idx")).drop("part", "start", "row"))


# Building.


class Mountains:
    """The unfinished runs of consecutive leaves of one tree, level by level.

    ``out`` gets a row ``(tree, n, level, idx, hash, peak)`` for each node above the
    leaves, and for the top of a tree of one; another, with ``peak`` true, for each node
    whose run isn't whole among the leaves seen.
    """

    def __init__(self, tree: str, n: int, out: list[tuple]):
        self.tree, self.n, self.out, self.top = tree, n, out, height(n)
        self.runs: list[list[tuple[int, bytes]]] = [[] for _ in range(self.top + 1)]
        self.ends = [width(n, level) - 1 for level in range(self.top + 1)]
        self.next = None

    def follows(self, tree: str, idx: int) -> bool:
        return tree == self.tree and idx == self.next

    def add_leaf(self, idx: int, digest: bytes) -> None:
        self.next = idx + 1
        level = 0
        while True:
            if level or not self.top:
                self.out.append((self.tree, self.n, level, idx, digest, False))
            if level == self.top:
                return
            run = self.runs[level]
            run.append((idx, digest))
            if idx % FANOUT < FANOUT - 1 and idx < self.ends[level]:
                return
            # The run has its last node: carry it up if it has its first one, too.
            if run[0][0] % FANOUT:
                self.shed(level)
                return
            digest = combined([h for _, h in run])
            run.clear()
            level, idx = level + 1, idx // FANOUT

    def shed(self, level: int) -> None:
        self.out += [(self.tree, self.n, level, i, h, True) for i, h in self.runs[level]]
        self.runs[level].clear()

    def finish(self) -> None:
        for level in range(self.top):
            self.shed(level)


def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes and peaks of a task's leaves, which lie in order."""
    out: list[tuple] = []
    now = None
    for batch in batches:
        for tree, n, idx, digest in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if now is None or not now.follows(tree, idx):
                if now is not None:
                    now.finish()
                now = Mountains(tree, n, out)
            now.add_leaf(idx, digest)
        yield from table_of(NODES, out).to_batches(BATCH)
        out.clear()
    if now is not None:
        now.finish()
        yield from table_of(NODES, out).to_batches(BATCH)


def by_level(table: pa.Table) -> dict[int, dict[int, bytes]]:
    found: dict[int, dict[int, bytes]] = defaultdict(dict)
    for level, idx, digest in zip(*(table[c].to_pylist() for c in ("level", "idx", "hash")), strict=True):
        found[level][idx] = digest
    return found


def merge(upper: int) -> Callable[[Key, pa.Table], pa.Table]:
    """The nodes above the peaks that lie under one node of level ``upper``, or under the top."""

    def run(key: Key, table: pa.Table) -> pa.Table:
        tree, n = key[0].as_py(), table["n"][0].as_py()
        found, out, top = by_level(table), [], height(n)
        for level in range(min(found), min(upper, top)):
            nodes = found[level]
            for parent in sorted({idx // FANOUT for idx in nodes}):
                children = range(parent * FANOUT, min((parent + 1) * FANOUT, width(n, level)))
                digest = combined([nodes[c] for c in children])
                found[level + 1][parent] = digest
                out.append((tree, n, level + 1, parent, digest, False))
        if upper < top:
            out += [(tree, n, upper, idx, digest, True) for idx, digest in found[upper].items()]
        return table_of(NODES, out)

    return run


def steps(levels: int) -> Column:
    """``FANOUT`` to the power of ``levels - level``."""
    powers = F.array(*(F.lit(FANOUT**i) for i in range(levels + 1)))
    return F.element_at(powers, F.lit(levels + 1) - F.col("level"))


def under(nodes: DataFrame, upper: int) -> DataFrame:
    """Nodes below level ``upper``, with the block: the number of the node there that they lie under."""
    return nodes.where(F.col("level") < upper).withColumn("width", steps(upper)).withColumn("block", F.expr("idx div width")).drop("width")


def build(rows: DataFrame) -> tuple[DataFrame, int]:
    """The nodes above numbered leaves (tree, n, idx, leaf), and the number of rounds that the largest tree takes."""
    largest = rows.agg(F.max("n")).first()[0] or 0
    rounds = max(1, -(-height(largest) // HEIGHT))
    first = written(rows.select("tree", "n", "idx", "leaf").mapInArrow(climb, NODES))
    nodes, peaks = first.where("NOT peak"), first.where("peak")
    for k in range(1, rounds + 1):
        made = written(under(peaks, k * HEIGHT).groupBy("tree", "block").applyInArrow(merge(k * HEIGHT), NODES))
        nodes = nodes.unionByName(made.where("NOT peak"))
        peaks = peaks.where(F.col("level") >= k * HEIGHT).unionByName(made.where("peak"))
    top = F.size(F.filter(F.array(*(F.lit(FANOUT**i) for i in range(rounds * HEIGHT + 1))), lambda x: x < F.col("n")))
    return nodes.drop("peak").withColumn("top", top), rounds


# Proofs.


def packed_siblings(siblings: list[bytes], position: int) -> bytes:
    """A step of a path: the node's position in its run, the number of siblings, and these."""
    return bytes((position, len(siblings))) + b"".join(siblings)


def unpacked(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    while at < len(path):
        position, count = path[at], path[at + 1]
        yield position, [path[at + 2 + 32 * i : at + 34 + 32 * i] for i in range(count)]
        at += 2 + 32 * count


def proof_of(path: bytes) -> str:
    """Digest of the path's siblings, from the leaf to the root."""
    return sha256("".join(h.hex() for _, siblings in unpacked(path) for h in siblings).encode()).hexdigest()


def folded(digest: bytes, path: bytes) -> bytes:
    """The root that a leaf and its path lead to."""
    for position, siblings in unpacked(path):
        digest = combined([*siblings[:position], digest, *siblings[position:]])
    return digest


def paths_down(found: dict[int, dict[int, bytes]], n: int, lowest: int, upper: int, path: bytes) -> dict[int, bytes]:
    """Paths of the nodes at level ``lowest`` under one at level ``upper``, or under the top, with its path."""
    levels = range(lowest, min(upper, height(n)))
    known = defaultdict(lambda: path)
    for level in reversed(levels):
        nodes, below = found[level], {}
        for idx in nodes:
            first = idx // FANOUT * FANOUT
            run = [nodes[i] for i in range(first, min(first + FANOUT, width(n, level))) if i != idx]
            below[idx] = packed_siblings(run, idx - first) + known[idx // FANOUT]
        known = below
    return known if levels else {idx: path for idx in found[lowest]}


def descend(lowest: int) -> Callable[[Key, pa.Table, pa.Table], pa.Table]:
    def run(key: Key, table: pa.Table, above: pa.Table) -> pa.Table:
        if not len(table) or not len(above):
            return table_of(PATHS, [])
        (tree, _), known = (k.as_py() for k in key), above.to_pylist()[0]
        found = paths_down(by_level(table), table["n"][0].as_py(), lowest, lowest + HEIGHT, known["path"])
        return table_of(PATHS, [(tree, idx, path, known["subroot"], known["root"]) for idx, path in found.items()])

    return run


def with_paths(rows: DataFrame, nodes: DataFrame, tops: DataFrame, rounds: int, use: Callable, schema: str) -> DataFrame:
    """What ``use`` makes of each group of leaves with the path of the node over them.

    ``tops`` has a row of ``PATHS`` for each tree: its top node's own path, with top.
    """
    paths = tops.drop("top")
    for k in range(rounds - 1, 0, -1):
        lowest = k * HEIGHT
        own = under(nodes.where((F.col("level") >= lowest) & (F.col("top") > lowest)), lowest + HEIGHT)
        made = own.groupBy("tree", "block").cogroup(paths.groupBy("tree", "block")).applyInArrow(descend(lowest), PATHS)
        paths = saved(made.unionByName(tops.where(F.col("top") <= lowest).drop("top")))
    blocks = rows.withColumn("block", F.expr(f"idx div {FANOUT**HEIGHT}"))
    return blocks.groupBy("tree", "block").cogroup(paths.groupBy("tree", "block")).applyInArrow(use, schema)


def leaf_paths(table: pa.Table, above: pa.Table) -> tuple[list[int], dict[int, bytes]]:
    """The order of a group's leaves, and their paths by idx."""
    n, place = table["n"][0].as_py(), table["idx"].to_pylist()
    found: dict[int, dict[int, bytes]] = defaultdict(dict)
    found[0] = dict(zip(place, table["leaf"].to_pylist(), strict=True))
    for level in range(min(HEIGHT, height(n)) - 1):
        for parent in {idx // FANOUT for idx in found[level]}:
            run = range(parent * FANOUT, min((parent + 1) * FANOUT, width(n, level)))
            found[level + 1][parent] = combined([found[level][i] for i in run])
    return place, paths_down(found, n, 0, HEIGHT, above["path"][0].as_py())


def source_paths(key: Key, table: pa.Table, above: pa.Table) -> pa.Table:
    """Of the tree of subroots: each source's path to the root."""
    place, paths = leaf_paths(table, above)
    root = above["root"][0].as_py()
    names, digests = table["source_tree"].to_pylist(), table["leaf"].to_pylist()
    return table_of(PATHS, [(name, 0, paths[i], digest, root) for i, name, digest in zip(place, names, digests, strict=True)])


def proofs(key: Key, table: pa.Table, above: pa.Table) -> pa.Table:
    """Of a source's tree: each row's proof, and the root that its tampered leaf leads to."""
    place, paths = leaf_paths(table, above)
    subroot, root = above["subroot"][0].as_py().hex(), above["root"][0].as_py().hex()
    rows = []
    for idx, doc_id, own, tampered in zip(place, *(table[c].to_pylist() for c in ("doc_id", "leaf", "tampered")), strict=True):
        reached = folded(own if tampered is None else tampered, paths[idx])
        rows.append((doc_id, own.hex(), subroot, root, proof_of(paths[idx]), reached.hex()))
    return table_of(PROOFS, rows)


class Manifest:
    """The trees over a table's rows.

    ``nodes`` has each tree's nodes (tree, n, level, idx, hash), ``subroots`` the top
    one of each source, ``root`` one row with the whole's digest.
    """

    def __init__(self, docs: DataFrame):
        self.rows = numbered(leaves(docs), ["doc_id", "leaf"])
        self.nodes, self.rounds = build(self.rows)
        tops = self.nodes.where(F.col("level") == F.col("top"))
        self.subroots = saved(tops.select("tree", "top", F.col("hash").alias("subroot")))
        sources = self.subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source_tree"), F.col("subroot").alias("leaf"))
        self.sources = numbered(sources, ["source_tree"])
        self.source_nodes, self.source_rounds = build(self.sources)
        self.root = saved(self.source_nodes.where(F.col("level") == F.col("top")).select("tree", "top", F.col("hash").alias("root")))

    def verify(self) -> DataFrame:
        """Every row's leaf, subroot and root, its proof's digest, and whether its tampered leaf leads to the root."""
        top = self.root.select("tree", F.lit(0).cast("long").alias("block"), F.lit(b"").alias("path"), F.lit(b"").alias("subroot"), "root", "top")
        found = with_paths(self.sources, self.source_nodes, top, self.source_rounds, source_paths, PATHS)
        tops = saved(found.join(self.subroots.select("tree", "top"), "tree"))
        checked = with_paths(self.rows, self.nodes, tops, self.rounds, proofs, PROOFS)
        return checked.withColumn("verified", F.col("folded_root") == F.col("root"))

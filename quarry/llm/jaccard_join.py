r"""Self-join of documents on the Jaccard similarity of their word 5-grams.

Sets hold the hashes of all runs of five words ``[^\x20\x09-\x0D]+`` of a text; a
shorter text with a word has one element, all its words.  Two documents are linked if
their sets' similarity is at least 0.8.

The join follows chosen paths.  A coordinate picks one element of a set by the
smallest value of a random hash, so that sets of similarity s pick the same one with
probability s.  Each of ``RUNS`` runs splits all sets on its first coordinate; a node
of more than ``LIMIT`` sets is split again on ``BRANCHES`` coordinates that its path
has not used, and so on.  A pair of similarity 0.8 keeps together in some branch, down
to any depth, with probability 0.75 a run, so 10 runs miss one such pair in a million.
A part of a large node that keeps ``DENSE`` of it holds truly similar sets and is one
group as it stands.

In small nodes all pairs are compared by sketches, one byte a coordinate: a pair of
similarity 0.8 agrees on ``AGREE`` of 64 bytes but for one in a million, sets that
merely share a passage don't.  Only what agrees is joined into groups, so each set is
sent to one group's comparison, in full and exact, not to each node it fell into.

A group of more than ``BLOCK`` sets is compared in pairs of blocks.  Before that its
members are compared with its representative, the set with the most agreements:
members so close to it that any two of them must be linked (see ``near``) are counted
without being compared, and only the rest meets all others.  Where that rest is itself
more than a block, the group is first taken apart (see ``parts_of``): in any order of
elements that both follow, two sets of similarity 0.8 share one of the first ninth of
the smaller and the first fifth of the larger.  With the elements last that most of
``SPREAD`` members hold, sets that merely share a passage have nothing in common there
and fall away, and no link is lost.

Texts with equal words are one set with a number of copies; pairs of copies are not
formed.  Comparisons send back, for each set, how many documents it is linked to, and
a root it is connected with: never pairs.

Defined cases: null texts count as empty; documents without words have no links, not
even with each other; each row is a document, those that repeat a ``doc_id`` or have
none too; classes are connected components, named by their smallest ``doc_id``, or
null where none of their rows has one (so unlike texts of one repeated ``doc_id`` are
classes that may share a name); an empty table gives no rows; columns besides doc_id
and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SPACES, join_groups, saved, text_of, unused
from quarry.llm.components import bunches, connected
from quarry.llm.substring_dedup import FACTORS, Doc, Key, docs_of, mixed, sequence_hash

SHINGLE = 5
THRESHOLD = 0.8
RUNS = 10
#: Coordinates, and those among them for splits after a run's first.
COORDINATES = 64
MORE = COORDINATES - RUNS
BRANCHES = 2
LIMIT = 512
#: A part of a large node is dense if it keeps this much of it.  Splitting with two branches sends less than
#: comparing in blocks would, up to 1 / sqrt(2).
DENSE = 0.7
#: Sketch bytes of COORDINATES that two sets must share to be compared.
AGREE = 35
BLOCK = 1024
#: Members of a large group that tell which elements are common there: a matter of order only.
SPREAD = 16
#: Elements held as a dense 0/1 matrix at a time.
COLUMNS = 4096
#: Rows of large nodes, rows of small nodes, and sets of small groups that a task holds at a time.
LEVEL_ROWS = 50_000
NODE_ROWS = 16_384
GROUP_ROWS = 2048

SKETCH = "doc_id long, text_hash long, h1 long, h2 long, n long, mins array<int>, sketch binary"
SETS = "rep long, elements binary, copies long, cluster long, blocks int"
SET_COLUMNS = ("rep", "elements", "copies", "cluster", "blocks")
CENTRES = "cluster long, blocks int, centre binary, common binary, holders binary"
JUDGED = f"{SETS}, near boolean, marks array<long>"
MET = "rep long, root long, degree long"
FOUND = "rep long, links long, root long"

#: Odd multipliers, one a coordinate.
MULTIPLIERS = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)


def elements(doc: Doc) -> np.ndarray:
    """The document's set, sorted."""
    n = len(doc.hashes)
    if not n:
        return np.zeros(0, np.uint64)
    return np.unique(sequence_hash(doc.hashes, min(n, SHINGLE), FACTORS[0]))


def whole_hash(doc: Doc) -> tuple[int, int]:
    """128-bit hash of the word sequence, as two signed numbers."""
    out = []
    for h, factor in ((doc.hashes, FACTORS[0]), (mixed(doc.hashes), FACTORS[1])):
        power = np.full(len(h), factor, np.uint64).cumprod(dtype=np.uint64)
        out.append(int(mixed((h * power).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h))).astype(np.int64)[0]))
    return out[0], out[1]


def coordinates(own: np.ndarray) -> np.ndarray:
    """The smallest value of each coordinate's hash over the set, as 31 bits."""
    least = np.full(len(MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(own), COLUMNS):
        np.minimum(least, (own[a : a + COLUMNS, None] * MULTIPLIERS).min(axis=0), out=least)
    return (mixed(least) >> np.uint64(33)).astype(np.int32)


def sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text_hash in zip(docs_of(pa.Table.from_batches([batch])), batch.column("text_hash").to_pylist(), strict=True):
            own = elements(doc)
            mins = coordinates(own) if len(own) else np.zeros(0, np.int32)
            rows.append((doc.doc_id, text_hash, *whole_hash(doc), len(own), mins, mins.astype(np.uint8).tobytes()))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        types = [pa.int64()] * 5 + [pa.list_(pa.int32()), pa.binary()]
        made_of = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        yield pa.RecordBatch.from_arrays(made_of, ["doc_id", "text_hash", "h1", "h2", "n", "mins", "sketch"])


def set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets in place of texts."""
    for batch in batches:
        own = [elements(doc).tobytes() for doc in docs_of(pa.Table.from_batches([batch]))]
        columns = {"rep": batch["rep"], "elements": pa.array(own, pa.binary())} | {c: batch[c] for c in ("copies", "cluster", "blocks")}
        yield pa.RecordBatch.from_pydict(columns)


# --- nodes -----------------------------------------------------------------------------


def nodes_of(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Small nodes ``(node, rep)``, and the members of dense ones with their smallest, ``(rep, root)``."""
    first = F.transform(F.slice("mins", 1, RUNS), lambda value, run: F.struct(run.cast("int").alias("run"), F.xxhash64(run, value).alias("node")))
    level = sets.select("rep", F.inline(first)).withColumn("parent", F.lit(None).cast("long"))
    small, dense = None, None
    for depth in range(MORE // BRANCHES + 1):
        if depth:
            level = saved(level)
        sizes = level.groupBy("node", "parent").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("root"))
        sizes = saved(sizes.where("size > 1").drop("parent") if not depth else sizes.where("size > 1"))
        held = saved(join_groups(level.drop("parent"), sizes, ["node"], "size"))
        fits = held.where(F.col("size") <= LIMIT).select("node", "rep")
        small = fits if small is None else small.unionByName(fits)
        large = held.where(F.col("size") > LIMIT)
        left = large.count()
        if not left:
            break
        if depth:
            whole = (F.col("size") >= DENSE * F.col("parent")) | F.lit(depth == MORE // BRANCHES)
            own = large.where(whole).select("rep", "root")
            dense = own if dense is None else dense.unionByName(own)
            large = large.where(~whole)
        # Runs start at different coordinates, so that a pair which one run parts may keep together in another.
        nth = [F.pmod(F.col("run") * (MORE // RUNS) + (BRANCHES * depth + k), F.lit(MORE)) + RUNS for k in range(BRANCHES)]
        parts = F.array(*(F.xxhash64("node", c, F.get(F.col("mins"), c)) for c in nth))
        split = large.select("rep", "run", "node", "size").join(sets.select("rep", "mins"), "rep").coalesce(1 + left // LEVEL_ROWS)
        level = split.select("rep", "run", F.explode(parts).alias("node"), F.col("size").alias("parent"))
    return small, dense if dense is not None else small.select("rep", F.col("rep").alias("root")).limit(0)


def meet(key: Key, table: pa.Table) -> pa.Table:
    """Sets of some small nodes whose sketches agree: the smallest set of each bunch, and the agreements of each set."""
    node, rep = table["node"].to_numpy(), table["rep"].to_numpy()
    order = np.lexsort((rep, node))
    node, rep = node[order], rep[order]
    sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, COORDINATES)[order]
    left, right = [], []
    for apart in range(1, len(node)):
        at = np.flatnonzero(node[apart:] == node[:-apart])
        if not len(at):
            break
        at = at[(sketch[at] == sketch[at + apart]).sum(axis=1) >= AGREE]
        left.append(at.astype(np.int32))
        right.append((at + apart).astype(np.int32))
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (left, right))
    root, degree = bunches(len(node), a, b), np.bincount(np.concatenate([a, b]), minlength=len(node))
    hit = degree > 0
    return pa.table([pa.array(c, pa.int64()) for c in (rep[hit], rep[root[hit]], degree[hit])], names=["rep", "root", "degree"])


# --- comparisons -----------------------------------------------------------------------


def overlaps(own: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairs' intersections; the work is done over elements that two sets have."""
    m = len(own)
    owner = np.repeat(np.arange(m), [len(x) for x in own])
    _, which, counts = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    held = counts[which] > 1
    owner, which = owner[held], which[held]
    _, which = np.unique(which, return_inverse=True)
    order = np.argsort(which, kind="stable")
    owner, which = owner[order], which[order]
    out = np.zeros((m, m), np.float32)
    for a in range(0, int(which[-1]) + 1 if len(which) else 0, COLUMNS):
        cut = slice(*np.searchsorted(which, (a, a + COLUMNS)))
        matrix = np.zeros((m, min(COLUMNS, int(which[-1]) + 1 - a)), np.float32)
        matrix[owner[cut], which[cut] - a] = 1
        out += matrix @ matrix.T
    return out


def compared(reps: np.ndarray, copies: np.ndarray, own: list[np.ndarray], block: np.ndarray | None = None) -> list[np.ndarray]:
    """Links and roots among the sets; with blocks, of the pairs between them only."""
    common = overlaps(own)
    sizes = np.array([len(x) for x in own], np.float32)
    # Sizes are exact as 32-bit floats; the quotient is taken in 64 bits.
    linked = common / (sizes[:, None] + sizes - common).astype(np.float64) >= THRESHOLD
    np.fill_diagonal(linked, False)
    if block is not None:
        linked &= block[:, None] != block
    links = linked @ copies
    root = bunches(len(reps), *np.nonzero(linked))
    hit = links > 0
    return [reps[hit], links[hit].astype(np.int64), reps[root[hit]]]


def compare(key: Key, table: pa.Table) -> pa.Table:
    """One task: some small groups, or two blocks of a large one."""
    i, j = key[1].as_py(), key[2].as_py()
    table = table.sort_by([("cluster", "ascending"), ("rep", "ascending")])
    own = [np.frombuffer(x.as_py(), "<u8") for x in table["elements"]]
    reps, copies, cluster = (table[c].to_numpy() for c in ("rep", "copies", "cluster"))
    if i >= 0:
        found = [compared(reps, copies, own, table["block"].to_numpy() if i != j else None)]
    else:
        cuts = [0, *(np.flatnonzero(cluster[1:] != cluster[:-1]) + 1), len(reps)]
        found = [compared(reps[a:b], copies[a:b], own[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    columns = [np.concatenate(x) for x in zip(*found, strict=True)]
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["rep", "links", "root"])


def near_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether each set is so near its group's representative that all such sets are linked.

    With ``a`` elements of the representative L missing and ``b`` others, two such sets
    share at least ``|L| - a1 - a2`` elements and have at most ``|L| + b1 + b2``, so
    ``10 a + 8 b <= |L|`` of each makes a similarity of 0.8.

    ``marks`` are the first elements of each set, by the chosen members that hold them.  Of
    two sets with a similarity of 0.8 the larger has at most a fifth of its own that the
    other lacks, and the smaller at most a ninth; so with one more of each they have a
    mark in common, which is one of the smaller's first ``|x| // 9 + 1``.
    """
    for batch in batches:
        flags, marks = [], []
        for row in zip(*(batch[n] for n in ("elements", "centre", "common", "holders")), strict=True):
            x, c, common, holders = (np.frombuffer(v.as_py(), kind) for v, kind in zip(row, ("<u8", "<u8", "<u8", np.uint8), strict=True))
            both = int(np.isin(x, c, assume_unique=True).sum())
            flags.append(10 * (len(c) - both) + 8 * (len(x) - both) <= len(c))
            times = np.zeros(len(x), np.uint8)
            _, own, there = np.intersect1d(x, common, assume_unique=True, return_indices=True)
            times[own] = holders[there]
            marks.append(x[np.argsort(times, kind="stable")[: len(x) // 5 + 1]].view(np.int64))
        columns = {n: batch[n] for n in SET_COLUMNS}
        yield pa.RecordBatch.from_pydict(columns | {"near": pa.array(flags, pa.bool_()), "marks": pa.array(marks, pa.list_(pa.int64()))})


def common_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The elements that more than one of a group's chosen members holds, and how many do, in place of these."""
    for batch in batches:
        common, holders = [], []
        for members in batch["members"]:
            values, counts = np.unique(np.concatenate([np.frombuffer(m.as_py(), "<u8") for m in members]), return_counts=True)
            common.append(values[counts > 1].tobytes())
            holders.append(counts[counts > 1].astype(np.uint8).tobytes())
        columns = {n: batch[n] for n in ("cluster", "blocks", "centre")}
        yield pa.RecordBatch.from_pydict(columns | {"common": pa.array(common, pa.binary()), "holders": pa.array(holders, pa.binary())})


def centres_of(sets: DataFrame, met: DataFrame) -> DataFrame:
    """``(cluster, blocks, centre, common, holders)``: each group's set with the most agreements, and elements common there."""
    degrees = met.join(sets.select("rep", "cluster"), "rep").groupBy("cluster", "rep").agg(F.sum("degree").alias("degree"))
    # Of each share of the members one is taken, whichever; the shares' best make the group's.
    chance = F.xxhash64("rep", F.lit(1))
    shares = degrees.groupBy("cluster", F.pmod(F.xxhash64("rep"), F.lit(SPREAD)).alias("share")).agg(
        F.max(F.struct("degree", "rep")).alias("best"), F.min_by("rep", chance).alias("one")
    )
    chosen = shares.groupBy("cluster").agg(F.max("best")["rep"].alias("best"), F.collect_set("one").alias("ones"))
    rep = F.explode(F.array_union(F.array("best"), F.col("ones"))).alias("rep")
    chosen = chosen.select("cluster", "best", rep).select("cluster", "rep", (F.col("rep") == F.col("best")).alias("first"))
    held = sets.join(chosen, ["cluster", "rep"]).groupBy("cluster", "blocks")
    return held.agg(F.max_by("elements", "first").alias("centre"), F.collect_list("elements").alias("members")).mapInArrow(common_batches, CENTRES)


def judged_groups(sets: DataFrame, met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sets with ``near`` and ``marks``; and of each group: members, near ones, others, the near ones' documents and root.

    A representative is sent once to each block of its group, and each block's members
    are compared with it there.
    """
    members = sets.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    centres = centres_of(sets, met).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    judged = saved(members.join(centres, ["cluster", "block"]).drop("block").mapInArrow(near_batches, JUDGED))
    counted = judged.groupBy("cluster").agg(
        F.count_if("near").alias("n"), F.count_if(~F.col("near")).alias("others"), F.sum(F.when(F.col("near"), F.col("copies"))).alias("documents"),
        F.min(F.when(F.col("near"), F.col("rep"))).alias("root"), F.count(F.lit(1)).alias("all"),
    )
    return judged.drop("blocks"), counted


def block_pairs(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks ``(place, i, j, rep, elements, copies, cluster, block)`` of judged groups, and the links that need none."""
    sure = known.where("near AND n > 1").select("rep", (F.col("documents") - F.col("copies")).alias("links"), "root")
    near_blocks, other_blocks = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("n", "others"))
    last = near_blocks + other_blocks - 1
    nth = F.pmod(F.xxhash64("rep"), F.greatest(F.lit(1), F.when(F.col("near"), near_blocks).otherwise(other_blocks)))
    block = (F.when(F.col("near"), F.lit(0)).otherwise(near_blocks) + nth).cast("int")
    others = F.when(F.col("near"), F.sequence(near_blocks, last)).otherwise(F.sequence(F.lit(0), last))
    rows = known.where("others > 0").withColumn("block", block).withColumn("other", F.explode(others))
    i, j = F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    return rows.select(F.col("cluster").alias("place"), i, j, "rep", "elements", "copies", "cluster", "block"), sure


def parts_of(wide: DataFrame) -> DataFrame:
    """``(rep, cluster)``: groups taken apart into the sets that marks connect; those that share none have no links."""
    early = F.col("nth") <= F.floor(F.octet_length("elements") / 72)
    marks = wide.select("rep", "cluster", "elements", F.posexplode("marks").alias("nth", "mark"))
    marks = saved(marks.select("rep", F.xxhash64("cluster", "mark").alias("mark"), early.alias("early")))
    shared = marks.groupBy("mark").agg(F.min("rep").alias("root"), F.count(F.lit(1)).alias("size"), F.max("early").alias("any"))
    shared = shared.where("size > 1 AND any").drop("any")
    return connected_sets(join_groups(marks, saved(shared), ["mark"], "size").select("rep", "root"))


def large_groups(sets: DataFrame, met: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Tasks of groups of several blocks (see ``block_pairs``), links that need none, and sets of small groups made of them.

    A group with more than a block of others is taken apart.  Its parts go the same way,
    with representatives of their own; one that keeps ``DENSE`` of it is compared as it
    stands, so each level has less than the last.
    """
    pairs, sure, small = [], [], []
    whole = None
    while True:
        judged, counted = judged_groups(sets, met)
        apart = F.col("others") > BLOCK
        if whole is not None:
            counted, apart = counted.join(whole, "cluster", "left"), apart & F.col("whole").isNull()
        counted = saved(counted.withColumn("apart", apart))
        known = join_groups(judged, counted, ["cluster"], "all")
        tasks, links = block_pairs(known.where("NOT apart"))
        pairs.append(tasks)
        sure.append(links)
        wide = known.where("apart")
        if counted.where("apart").isEmpty():
            return *(reduce(DataFrame.unionByName, x) for x in (pairs, sure)), reduce(DataFrame.unionByName, small) if small else None
        parts = saved(parts_of(wide))
        sizes = saved(parts.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")))
        named = join_groups(parts, sizes, ["cluster"], "size").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
        split = saved(wide.select("rep", "elements", "copies", "all").join(named, "rep"))
        small.append(split.where("blocks = 1").select(*SET_COLUMNS))
        sets = split.where("blocks > 1").select(*SET_COLUMNS)
        whole = split.where(F.col("size") >= DENSE * F.col("all")).select("cluster").distinct().withColumn("whole", F.lit(True))


# --- the join --------------------------------------------------------------------------


def text_hash() -> Column:
    return F.xxhash64(text_of())


def row_key() -> list[Column]:
    """``no_id, own, text_hash``, never null: what rows with equal id and text have in common."""
    return [F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("own"), text_hash().alias("text_hash")]


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links (other documents it is linked to) and copies of every document."""
    return classes_of(docs).select("doc_id", "class_id", "n_links", "copies")


def groups_of(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate groups ``(rep, cluster)``, and ``(rep, root, degree)`` of the sets that met."""
    small, dense = nodes_of(sets)
    small = saved(small)
    tasks = max(1, small.count() // NODE_ROWS)
    sketched = small.join(sets.select("rep", "sketch"), "rep").withColumn("task", F.pmod(F.xxhash64("node"), F.lit(tasks)))
    met = sketched.groupBy("task").applyInArrow(meet, MET)
    met = saved(met.unionByName(dense.withColumn("degree", F.lit(1).cast("long"))))
    return connected_sets(met), met


def connected_sets(links: DataFrame) -> DataFrame:
    """``(rep, cluster)`` of the sets that ``(rep, root)`` connect."""
    roots = saved(connected(links.select(F.col("rep").alias("u"), F.col("root").alias("v"))))
    own = roots.select("root").distinct().select(F.col("root").alias("rep"), F.col("root").alias("cluster"))
    return own.unionByName(roots.select(F.col("v").alias("rep"), F.col("root").alias("cluster")))


def linked_sets(own: DataFrame, sets: DataFrame) -> DataFrame:
    """``(rep, links, root)`` of the sets with links, from their documents' rows."""
    clusters, met = groups_of(sets.select("rep", "mins", "sketch"))
    clusters = saved(clusters)
    sizes = saved(clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")))
    grouped = join_groups(clusters, sizes, ["cluster"], "size").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    wanted = sets.select("rep", "copies", "row.*").join(grouped.drop("size"), "rep")
    # Texts move once, to meet what is known of their sets; rows with equal id and text are one here.
    texts = own.select(*row_key(), "text").dropDuplicates(["no_id", "own", "text_hash"])
    chosen = texts.join(wanted, ["no_id", "own", "text_hash"]).select(F.col("own").alias("doc_id"), "text", "rep", "copies", "cluster", "blocks")
    full = saved(chosen.mapInArrow(set_batches, SETS))
    tasks = max(1, full.count() // GROUP_ROWS)
    small, large = full.where("blocks = 1"), full.where("blocks > 1")
    if large.isEmpty():
        return packed(small, tasks).groupBy("place", "i", "j").applyInArrow(compare, FOUND)
    pairs, sure, parts = large_groups(large, met)
    small = small if parts is None else small.unionByName(parts)
    return packed(small, tasks).unionByName(pairs).groupBy("place", "i", "j").applyInArrow(compare, FOUND).unionByName(sure)


def packed(small: DataFrame, tasks: int) -> DataFrame:
    """Tasks that compare some small groups each."""
    place, none = F.pmod(F.xxhash64("cluster"), F.lit(tasks)).alias("place"), F.lit(-1)
    return small.select(place, none.alias("i"), none.alias("j"), "rep", "elements", "copies", "cluster", none.alias("block"))


def classes_of(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` with text_hash, and ``root``, the same in all rows of a class and null in those without words."""
    own = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    sketched = saved(own.withColumn("text_hash", text_hash()).mapInArrow(sketch_batches, SKETCH))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("own"), "text_hash")
    sets = sketched.where("n > 0").groupBy("h1", "h2").agg(
        F.min(row).alias("row"), F.count(F.lit(1)).alias("copies"), F.first("mins").alias("mins"), F.first("sketch").alias("sketch")
    )
    # The numbers of the sets are fixed once this is written.
    sets = saved(sets.withColumn("rep", F.monotonically_increasing_id()))
    found = saved(linked_sets(own, sets))

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = connected(found.select(F.col("rep").alias("u"), F.col("root").alias("v"))).withColumnRenamed("v", "rep")
    doc_id = F.when(~F.col("row.no_id"), F.col("row.own")).alias("doc_id")
    known = sets.select("h1", "h2", "rep", doc_id, "copies").join(links, "rep", "left").join(roots, "rep", "left")
    known = saved(known.withColumn("root", F.coalesce("root", "rep")))
    alone, joined = known.where("links IS NULL"), known.where("links IS NOT NULL")
    names = saved(joined.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("size")))
    named = join_groups(joined, names, ["root"], "size").select("h1", "h2", "root", "class_id", "links", "copies")
    named = saved(named.unionByName(alone.select("h1", "h2", "root", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links"), "copies")))
    worded = join_groups(sketched.where("n > 0").select("doc_id", "text_hash", "h1", "h2"), named, ["h1", "h2"], "copies")
    worded = worded.select("doc_id", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "copies", "text_hash", "root")
    nothing, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    blank = sketched.where("n = 0").select(
        "doc_id", F.col("doc_id").alias("class_id"), nothing.alias("n_links"), one.alias("copies"), "text_hash", F.lit(None).cast("long").alias("root")
    )
    return worded.unionByName(blank)


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each class, and all rows without words.

    It is the row with the smallest ``doc_id``, null last; of several texts of that id the
    one with the smallest hash, of rows with equal id and text the first by their other columns.
    """
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("own"), "text_hash")).alias("best")
    chosen = classes_of(docs).where("root IS NOT NULL").groupBy("root").agg(best)
    names = {c: unused(docs, f"quarry_{c}") for c in ("no_id", "own", "text_hash")}
    chosen = chosen.select(*(F.col(f"best.{c}").alias(new) for c, new in names.items()))
    blank = F.btrim(text_of(), F.lit(SPACES)) == ""
    keyed = docs.where(~blank).withColumns(dict(zip(names.values(), row_key(), strict=True))).join(chosen, list(names.values()), "left_semi")
    # Any number of rows may have equal id and text; the first of them is taken before the shuffle.
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*others)) if others else F.lit(0)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = keyed.groupBy(*names.values()).agg(F.min_by(row, order).alias("row"))
    return one.select("row.*").unionByName(docs.where(blank))

r"""Removal of long passages that an earlier document has as well.

Words are ``[^\x20\x09-\x0D]+``, unchanged.  A word goes if it lies in a window of 13
words whose sequence also starts in a document with a smaller ``doc_id``.

Finding the windows takes two rounds of the same kind.  Documents are dealt into
groups of about ``group_bytes`` of text (see ``group_size``).

1. Anchors.  7-word sequences are hashed only where the position modulo 7 lies in
   {0, 1, 3}.  The differences of these numbers are all residues modulo 7, so any two
   equal 13-word windows, wherever they start, have an anchor at the same offset.
   Each group sends its distinct anchors, packed by key range; a range's task finds
   those that several documents have and sends them back.
2. Windows.  Only windows around a shared anchor are hashed, with 96 bits.  Each group
   sends its distinct windows with its smallest document; a range's task sends back
   the windows that a smaller document of another group has.

The last pass marks the covered words.  A key is sent at most once by a group, so a
passage in a third of all documents burdens no task, no pairs are formed, and the
texts are shuffled once, for all three passes.

Defined cases: null texts count as empty and have no words; a null ``doc_id`` counts as
larger than any other; rows with equal ids don't affect each other; an empty table
gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import text_of
from quarry.llm.repeats import told_apart

WINDOW = 13
PERIOD = 7
#: A difference cover of PERIOD.
COVER = (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
#: Text of a group, least and most.
GROUP_BYTES, MOST_GROUP_BYTES = 4 << 20, 16 << 20
#: Text of which the least groups' packed rows hold about 70 keys.
GROUP_CORPUS = 16 << 30

#: Odd multipliers of the two window hashes.
FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

Key = tuple[pa.Scalar, ...]
PACKED = "bucket long, part long, h1 binary, h2 binary, docs binary"
RETURNED = "part long, kind int, h1 binary, h2 binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_text string"
#: Windows are known by 96 bits.
PAIR = np.dtype([("h1", "<u8"), ("h2", "<u4")])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads each input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sequence_hash(hashes: np.ndarray, length: int, factor: np.uint64) -> np.ndarray:
    """Hash of each run of ``length`` neighbouring word hashes."""
    n = max(0, len(hashes) - length + 1)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = out * factor + hashes[k : k + n]
    return mixed(out)


class Doc:
    """Word hashes of a document, its anchors, and its windows."""

    def __init__(self, doc_id: int | None, text: bytes):
        self.doc_id = doc_id
        self.order = np.iinfo(np.int64).max if doc_id is None else doc_id
        self.words = text.split()  # bytes split at ASCII white space only
        digest = xxhash.xxh3_64_intdigest
        self.hashes = np.fromiter(map(digest, self.words), np.uint64, len(self.words))

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and keys of the anchors."""
        keys = sequence_hash(self.hashes, ANCHOR, FACTORS[0])
        place = np.arange(len(keys))
        place = place[np.isin(place % PERIOD, COVER)]
        return place, keys[place]

    def candidates(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and 96-bit keys of the windows that hold a shared anchor (of a sorted array)."""
        n = len(self.hashes) - WINDOW + 1
        none = np.zeros(0, np.int64), np.zeros(0, PAIR)
        if n <= 0 or not len(shared):
            return none
        place, keys = self.anchors()
        place = place[shared[np.minimum(np.searchsorted(shared, keys), len(shared) - 1)] == keys]
        if not len(place):
            return none
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, np.clip(place - (WINDOW - ANCHOR), 0, n), 1)
        np.add.at(edge, np.minimum(place + 1, n), -1)
        start = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        pair = np.empty(len(start), PAIR)
        pair["h1"] = sequence_hash(self.hashes, WINDOW, FACTORS[0])[start]
        pair["h2"] = sequence_hash(mixed(self.hashes), WINDOW, FACTORS[1])[start] >> np.uint64(32)
        return start, pair


def docs_of(table: pa.Table) -> Iterator[Doc]:
    for batch in table.select(["doc_id", "text"]).to_batches():
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            yield Doc(doc_id, text.as_py())


def joined(arrays: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, dtype)


def made(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(fields, columns, strict=True)})


def packed(part: int, bits: int, h1: np.ndarray, h2: np.ndarray | None = None, docs: np.ndarray | None = None) -> pa.Table:
    """A row for each range of h1 (its ``bits`` highest bits), in the given order within."""
    bucket = (h1 >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h1), np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else bucket
    ends = np.append(starts[1:], len(bucket)) if len(bucket) else starts
    own = [None if x is None else x[order] for x in (h1, h2, docs)]
    return made(
        PACKED,
        [(bucket[a], part, *(None if x is None else x[a:b].tobytes() for x in own)) for a, b in zip(starts, ends, strict=True)],
    )


def local_windows(docs: list[Doc], shared: np.ndarray):
    """Candidate windows of a group: per document, and distinct with the smallest document."""
    found = [d.candidates(shared) for d in docs]
    keys = joined([x[1] for x in found], PAIR)
    order = np.repeat([d.order for d in docs], [len(x[1]) for x in found]).astype(np.int64)
    by = np.lexsort((order, keys["h2"], keys["h1"]))
    keys, order = keys[by], order[by]
    first = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
    nth = np.empty(len(by), np.int64)
    nth[by] = np.cumsum(first) - 1
    return found, nth, keys[first], order[first]


def returned(table: pa.Table, kind: int, field: str) -> np.ndarray:
    rows = [x.as_py() for x in table.filter(pc.equal(table["kind"], kind))[field]] if len(table) else []
    return joined([np.frombuffer(x, PAIR[field]) for x in rows], PAIR[field])


def send_anchors(bits: int):
    def run(key: Key, table: pa.Table) -> pa.Table:
        own = joined([np.unique(d.anchors()[1]) for d in docs_of(table)], np.uint64)
        keys, counts = np.unique(own, return_counts=True)
        return packed(key[0].as_py(), bits, keys, docs=(counts > 1).astype(np.uint8))

    return run


def shared_anchors(key: Key, table: pa.Table) -> pa.Table:
    """Of each group's anchors in a range, those that another document has too."""
    rows = [np.frombuffer(x.as_py(), "<u8") for x in table["h1"]]
    own = [np.frombuffer(x.as_py(), np.uint8) for x in table["docs"]]
    keys = np.concatenate(rows)
    _, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
    hit = (counts[which] > 1) | (np.concatenate(own) > 0)
    at, out = 0, []
    for part, row in zip(table["part"].to_pylist(), rows, strict=True):
        mine = slice(at, at := at + len(row))
        if hit[mine].any():
            out.append((part, 1, row[hit[mine]].tobytes(), None))
    return made(RETURNED, out)


def send_windows(bits: int):
    def run(key: Key, table: pa.Table, back: pa.Table) -> pa.Table:
        shared = np.sort(returned(back, 1, "h1"))
        _, _, keys, first = local_windows(list(docs_of(table)), shared) if len(shared) else (0, 0, np.zeros(0, PAIR), np.zeros(0, np.int64))
        order = np.argsort(first, kind="stable")  # runs of one document pack well
        keys, first = keys[order], first[order]
        return packed(key[0].as_py(), bits, np.ascontiguousarray(keys["h1"]), np.ascontiguousarray(keys["h2"]), first)

    return run


def earlier_windows(key: Key, table: pa.Table) -> pa.Table:
    """Of each group's windows in a range, those that a smaller document of another group has."""
    columns = {c: [np.frombuffer(x.as_py(), t) for x in table[c]] for c, t in (("h1", "<u8"), ("h2", "<u4"), ("docs", "<i8"))}
    h1, h2, docs = (np.concatenate(columns[c]) for c in ("h1", "h2", "docs"))
    order = np.lexsort((docs, h2, h1))
    a, b = h1[order], h2[order]
    first = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    least = np.empty(len(docs), np.int64)
    least[order] = docs[order][first][np.cumsum(first) - 1]
    hit, at, out = least < docs, 0, []
    for part, row in zip(table["part"].to_pylist(), columns["h1"], strict=True):
        own = slice(at, at := at + len(row))
        if hit[own].any():
            out.append((part, 2, h1[own][hit[own]].tobytes(), h2[own][hit[own]].tobytes()))
    return made(RETURNED, out)


def mark(key: Key, table: pa.Table, back: pa.Table) -> pa.Table:
    """The group's documents without the covered words."""
    shared = np.sort(returned(back, 1, "h1"))
    docs = list(docs_of(table))
    found, nth, keys, first = local_windows(docs, shared)
    elsewhere = np.empty(len(h1 := returned(back, 2, "h1")), PAIR)
    elsewhere["h1"], elsewhere["h2"] = h1, returned(back, 2, "h2")
    known = np.zeros(len(keys), bool)
    if len(elsewhere):
        # Keys of the group come back as they were sent, so equal pairs are neighbours once both are sorted.
        both = np.concatenate([keys, elsewhere])
        order = np.lexsort((np.arange(len(both)), both["h2"], both["h1"]))
        ordered = both[order]
        same = np.append(ordered[1:] == ordered[:-1], False)
        known[order[same]] = True
    rows, at = [], 0
    for doc, (start, own) in zip(docs, found, strict=True):
        mine = nth[at : at + len(own)]
        at += len(own)
        n = len(doc.words)
        repeated = start[known[mine] | (first[mine] < doc.order)] if len(own) else start
        if not len(repeated):
            rows.append((doc.doc_id, n, 0, b" ".join(doc.words).decode()))
            continue
        edge = np.zeros(n + 1, np.int64)
        edge[repeated] += 1
        np.add.at(edge, repeated + WINDOW, -1)
        gone = np.cumsum(edge[:-1]) > 0
        kept = b" ".join([w for w, g in zip(doc.words, gone.tolist(), strict=True) if not g])
        rows.append((doc.doc_id, n, int(gone.sum()), kept.decode()))
    return made(RESULT, rows)


def group_size(size: int) -> int:
    """Bytes of text a group should have in a corpus of ``size`` bytes.

    A group sends one packed row to each of about as many ranges as there are groups,
    so the keys in a row are as the square of a group's size over the corpus.  Groups
    grow with the root of the corpus to keep these rows filled, up to 256 GB, where a
    group is as large as a task should hold.
    """
    return min(MOST_GROUP_BYTES, int(GROUP_BYTES * max(1.0, sqrt(size / GROUP_CORPUS))))


def dealt(own: DataFrame, parts: int) -> DataFrame:
    """Adds part; rows equal in id and text, of which there may be any number, go to many parts."""
    deal = F.pmod(F.xxhash64("doc_id", "text", "nth"), F.lit(parts))
    return told_apart(own, ["doc_id", "text"], "nth").withColumn("part", deal).drop("nth")


def remove_repeats(docs: DataFrame, group_bytes: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (words joined by one space) of every document."""
    own = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = size // (group_bytes or group_size(size)) + 1
    bits = (parts - 1).bit_length()
    groups = dealt(own, parts).groupBy("part")
    anchors = groups.applyInArrow(send_anchors(bits), PACKED).groupBy("bucket").applyInArrow(shared_anchors, RETURNED)
    windows = groups.cogroup(anchors.groupBy("part")).applyInArrow(send_windows(bits), PACKED)
    earlier = windows.groupBy("bucket").applyInArrow(earlier_windows, RETURNED)
    return groups.cogroup(anchors.unionByName(earlier).groupBy("part")).applyInArrow(mark, RESULT)

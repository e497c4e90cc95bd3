r"""Near-duplicate components by SimHash fingerprints, found by multi-index hashing.

Texts are lower-cased (A-Z), split into words ``[^\x20\x09-\x0D]+`` and cut into runs of
3 words, repeats included; fewer words are one run.  A bit of the fingerprint is 1 if
it is set in over half of the runs' XXH64 digests (seed 42).  Fingerprints with at most
2 differing bits are linked, and a document's component is the smallest ``doc_id`` it
reaches.

Fingerprints are halved.  Of two that differ in 2 bits at most, one half differs in 1
bit at most, so each half is a table of buckets, and each bucket looks up itself and
the buckets with one set bit less (the other direction finds the rest).  Members of
buckets that meet are compared over all 64 bits.

A bucket of more than ``LIMIT`` different fingerprints isn't compared member by member.
Its members look up, in the table of whole fingerprints, the 33 that a neighbouring
bucket could hold within one more bit; among themselves they are linked through the 33
points within one bit of the other half, as two fingerprints 2 bits apart share such a
point.  Both are exact, and work grows with the members, not with their square.

Copies count once: links are between different fingerprints.

Defined cases: null texts count as empty; a text without words has fingerprint zero,
linked like any other; a null ``doc_id`` is larger than any other, so a component
without any id has a null one; repeated rows come back each; an empty table gives no
rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import join_groups, saved, text_of
from quarry.llm.components import connected

SHINGLE = 3
SEED = 42
#: Bits in which linked fingerprints differ at most.
RADIUS = 2
#: Different fingerprints of a bucket that are compared with one another.
LIMIT = 64
#: Digests whose bits are counted together.
STRETCH = 1 << 16

HALF_BITS = 32
MASK = (1 << HALF_BITS) - 1
PRINTS = "doc_id long, print long"
BUCKET = ["half", "value"]


def digests(text: bytes) -> Iterator[np.ndarray]:
    """Digests of the text's runs of words, a stretch at a time."""
    words = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    size = min(SHINGLE, len(words))
    first, last = (ends - lengths)[: len(words) - size + 1], ends[size - 1 :]
    digest = xxhash.xxh64_intdigest
    for a in range(0, len(first), STRETCH):
        spans = zip(first[a : a + STRETCH].tolist(), last[a : a + STRETCH].tolist(), strict=True)
        yield np.array([digest(joined[i:j], SEED) for i, j in spans], "<u8")


def fingerprint(text: bytes) -> np.uint64:
    """The 64 majority bits."""
    total, ones = 0, np.zeros(64, np.int64)
    for part in digests(text):
        total += len(part)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > total, bitorder="little").view("<u8")[0]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and print (the 64 bits as a signed number) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(1).cast(pa.binary())], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, PRINTS)


def halves(prints: DataFrame) -> DataFrame:
    """half (0: high bits, 1: low bits), value (the half's bits), rest (the other's) and print."""
    high, low = F.shiftrightunsigned("print", HALF_BITS), F.col("print").bitwiseAND(F.lit(MASK))
    both = [F.struct(F.lit(h).alias("half"), v.alias("value"), r.alias("rest")) for h, v, r in ((0, high, low), (1, low, high))]
    return prints.select("print", F.inline(F.array(*both)))


def whole(half: Column, value: Column, rest: Column) -> Column:
    """The fingerprint of two halves."""
    high, low = F.when(half == 0, value).otherwise(rest), F.when(half == 0, rest).otherwise(value)
    return F.shiftleft(high, HALF_BITS).bitwiseOR(low)


def within_one(rest: Column) -> Column:
    """The 33 halves that differ in one bit at most."""
    return F.array(rest, *(rest.bitwiseXOR(F.lit(1 << i)) for i in range(HALF_BITS)))


def near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= RADIUS


def links(prints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``(u, v)`` edges that connect all fingerprints within ``RADIUS`` bits, from saved distinct ones."""
    members = saved(halves(prints))
    sizes = saved(members.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("n")))
    few = join_groups(members, sizes, BUCKET, "n").where(F.col("n") <= limit)
    # Lists of ``limit`` fingerprints at most; larger buckets have none.
    lists = few.groupBy(*BUCKET).agg(F.collect_list("print").alias("prints"))
    buckets = saved(sizes.join(lists, BUCKET, "left"))

    alike = buckets.where((F.col("n") > 1) & (F.col("n") <= limit)).select("prints", F.explode("prints").alias("u"))
    found = [alike.select("u", F.explode(F.filter("prints", lambda x: (x > F.col("u")) & near(x, F.col("u")))).alias("v"))]

    # Buckets that are one bit apart; a bucket is looked up by 32 others at most.
    bits = F.array(*(F.lit(1 << i) for i in range(HALF_BITS)))
    less = F.explode(F.filter(bits, lambda m: F.col("value").bitwiseAND(m) != 0)).alias("bit")
    asked = sizes.select("half", F.col("value").alias("above"), less).withColumn("value", F.col("above") - F.col("bit")).drop("bit")
    met = asked.join(sizes.select(*BUCKET), BUCKET)
    above = buckets.select("half", F.col("value").alias("above"), F.col("n").alias("n_above"), F.col("prints").alias("prints_above"))
    pairs = saved(met.join(above, ["half", "above"]).join(buckets, BUCKET))

    small = pairs.where((F.col("n") <= limit) & (F.col("n_above") <= limit)).select("prints", F.explode("prints_above").alias("u"))
    found.append(small.select("u", F.explode(F.filter("prints", lambda x: near(x, F.col("u")))).alias("v")))

    # One of a pair with a large bucket asks: the small one, or the upper of two large ones.
    large = pairs.where((F.col("n") > limit) | (F.col("n_above") > limit))
    upper_asks = F.col("n_above") <= limit
    upper_asks = upper_asks | (F.col("n") > limit)
    asking = large.select(
        "half",
        F.when(upper_asks, F.col("above")).otherwise(F.col("value")).alias("value"),
        F.when(upper_asks, F.col("value")).otherwise(F.col("above")).alias("other"),
        F.when(upper_asks, F.col("n_above")).otherwise(F.col("n")).alias("n"),
    )
    # A bucket has 64 neighbours at most.
    asking = saved(asking.groupBy(*BUCKET, "n").agg(F.collect_list("other").alias("others")))
    wishes = join_groups(members, asking, BUCKET, "n").select("half", "rest", F.col("print").alias("u"), F.explode("others").alias("other"))
    wishes = wishes.select("u", "half", "other", F.explode(within_one(F.col("rest"))).alias("rest"))
    wishes = wishes.select("u", whole(F.col("half"), F.col("other"), F.col("rest")).alias("v"))
    found.append(wishes.join(prints.select(F.col("print").alias("v")), "v").where(near(F.col("u"), F.col("v"))).select("u", "v"))

    crowded = join_groups(members, saved(sizes.where(F.col("n") > limit)), BUCKET, "n")
    points = crowded.select("half", "value", F.col("print").alias("v"), F.explode(within_one(F.col("rest"))).alias("rest"))
    points = points.select("v", whole(F.col("half"), F.col("value"), F.col("rest")).alias("point"))
    # A point has 65 fingerprints within one bit at most.
    around = points.groupBy("point").agg(F.collect_set("v").alias("vs")).where(F.size("vs") > 1)
    found.append(around.select(F.array_min("vs").alias("u"), F.explode("vs").alias("v")).where("u <> v"))

    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges


def near_components(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    rows = saved(fingerprints(docs))
    prints = saved(rows.groupBy("print").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")))
    roots = connected(links(prints.select("print"), limit)).select(F.col("v").alias("print"), "root")
    rooted = saved(prints.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print")))
    ids = saved(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("prints")))
    known = saved(join_groups(rooted, ids, ["root"], "prints").select("print", "copies", "component_id"))
    shown = F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint")
    return join_groups(rows, known, ["print"], "copies").select("doc_id", shown, "component_id")

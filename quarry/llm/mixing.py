r"""Mixing sources to target weights by weighted sampling without replacement.

A document's size is its number of ``[^\x20\x09-\x0D]+`` words.  Sources, ordered by
code point with null last, weigh ``weights`` in turn, repeating, and share
``share`` times the words of the corpus.  No target exceeds ``cap`` times its
source's size; what a capped source leaves is shared out by weight among the rest
until none is above its cap.

Each source is taken in complete epochs first.  What then remains of its target is
filled by Efraimidis-Spirakis sampling: the key of a document is ``-ln(u) / q`` with
``u`` a hash of its id and ``q`` its quality, and documents go in by ascending key
while at least half of them fits.  So the taken words miss the target by at most
half a document.  Keys depend on the row alone, so reruns agree.

A source may hold any part of the rows, and any number of rows may have one key: the
prefix sums run over ranges of (source, key, row number) on top of the ranges' totals.
There may be any number of sources: their order's sums run over ranges likewise.

Defined cases: null and empty texts have size 0 and are taken 0 words; no row is taken
more than ``cap`` times.  A row without ``doc_id`` has a key by its text.  Null is a
source of its own.  Repeated rows count each by itself, in ``mix`` and in ``mixed``
alike.  An empty table gives no rows.  Other columns are ignored, and kept by ``mixed``,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import join_groups, prefix_sums, saved, text_of, unused, words_of, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
#: Characters that count against a document's quality.
SYMBOLS = "[#*$%&|<>]+"


def sampling_key(name: Column, quality: Column) -> Column:
    """Exponential variate of rate ``quality`` from a hash of the row's name."""
    draw = F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double")
    return -F.ln((draw + 0.5) / F.lit(float(2**52))) / quality


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Target of each source, from one row per source with its size.

    A level L exists with target = min(cap, L * weight).  Ordered by cap / weight,
    the sources below the level are capped; the first that is not gives L.
    """
    ordered = prefix_sums(sizes.withColumn("one", F.lit(1)), ["no_source", "source"], {"one": "nth"})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int")).cast("long")
    weighed = ordered.withColumn("weight", weight).withColumn("cap", F.col("source_size") * cap)
    weighed = weighed.withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = saved(prefix_sums(weighed, ["ratio", "no_source", "source"], {"cap": "before", "weight": "lighter"}))
    # One row of sums over all sources, then one with the level.
    sums = by_ratio.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    level = (F.col("all_size") * share - F.col("before")) / (F.col("all_weight") - F.col("lighter"))
    levels = by_ratio.crossJoin(F.broadcast(sums)).select("ratio", level.alias("level")).where("level <= ratio")
    first = levels.agg(F.min(F.struct("ratio", "level"))["level"].alias("level"))
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    levelled = by_ratio.crossJoin(F.broadcast(first))
    return levelled.select("no_source", "source", "source_size", F.coalesce(target, F.col("cap").cast("double")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """How many words the mix takes of each document.

    Columns: doc_id, source, size, source_size, target, taken (words, repeats
    counted), copies (times the document is in the mix).
    """
    numbered = docs.select("doc_id", "source", "text", F.monotonically_increasing_id().alias("row"))
    return counted(numbered, weights, share, cap).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def counted(docs: DataFrame, weights, share: float, cap: int) -> DataFrame:
    """``mix`` of ``docs(doc_id, source, text, row)``, with ``row``, which tells all rows apart."""
    words = F.size(words_of(text_of())).cast("long")
    marks = F.length(text_of()) - F.length(F.regexp_replace(text_of(), SYMBOLS, ""))
    no_source, source = F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source")
    measured = docs.select("row", "doc_id", F.xxhash64(text_of()).alias("text_hash"), no_source, source, words.alias("size"), marks.alias("marks"))
    quality = F.greatest(F.col("size"), F.lit(1)) / (F.greatest(F.col("size"), F.lit(1)) + F.col("marks"))
    key = sampling_key(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), "text_hash")), quality).alias("key")
    keyed = saved(measured.select("row", "doc_id", "text_hash", "no_source", "source", "size", key))

    of_source = ["no_source", "source"]
    sizes = saved(keyed.groupBy(*of_source).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")))
    targets = source_targets(sizes.drop("n"), weights, share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("epochs", epochs.cast("long")).withColumn(
        "rest", F.col("target") - F.col("epochs") * F.col("source_size")
    )
    starts = prefix_sums(sizes, of_source, {"source_size": "start"}).select(*of_source, "start", "n")
    starts = saved(starts.join(targets, of_source))

    summed = saved(prefix_sums(keyed, [*of_source, "key", "doc_id", "size", "text_hash", "row"], {"size": "before"}))
    joined = join_groups(summed, starts, of_source, "n")
    ahead = F.col("before") - F.col("start")
    chosen = (ahead + F.col("size") / 2 <= F.col("rest")).cast("long")
    copies = F.least(F.lit(cap).cast("long"), F.col("epochs") + chosen).alias("copies")
    own = F.when(~F.col("no_source"), F.col("source")).alias("source")
    return joined.select("row", "doc_id", own, "size", "source_size", "target", copies)


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """The mix itself: each row as often as it is taken.

    The rows are written once with a number, by which each finds what was decided on it.
    """
    row, times = unused(docs, "quarry_row"), unused(docs, "quarry_times")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()))
    own = counted(numbered.select("doc_id", "source", "text", F.col(row).alias("row")), weights, share, cap)
    taken = own.where("copies > 0").select(F.col("row").alias(row), F.col("copies").cast("int").alias(times))
    repeated = numbered.join(taken, row).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times))))
    return repeated.drop(row, times)

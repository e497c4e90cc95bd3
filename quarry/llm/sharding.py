r"""Contiguous shards of near-equal bytes, with equal texts kept together.

A document's size is the UTF-8 bytes of its text plus 1.  Documents are ordered by
text digest, then id, so that the copies of a text are neighbours.  The order is cut
into ranges of the digest; the ranges' totals give each range its global start, a
running sum within the range gives each text its own, and a text goes to the shard
that holds its midpoint among equal targets.  So shards are runs of the order, and a
cut is off its target by at most half of one text's copies.

A text may have any number of copies: these are counted before the shuffle, and the
rows of one text are numbered within ``SALTS`` parts by a hash of the id.

Defined cases: null texts count as empty; repeated rows, and rows without ``doc_id``
(first among their equals), take a slot each; an empty table gives no rows; other
columns are ignored by ``assign`` and written by ``write_shards``, which replaces ones
named ``shard`` or ``slot``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import saved, text_of, unused
from quarry.llm.repeats import told_apart

SHARDS = 8
#: Digest ranges: a fixed number, so that their totals are a small table at any scale.
RANGES = 4096
SALTS = 1024
FILE_BYTES = 128 << 20


def running(column: str, window) -> F.Column:
    """Sum of the column over the rows before this one."""
    return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shard and slot of every document.

    Columns: doc_id, size, text_crc32, law, shard, slot (from 0 without gaps in each
    shard), grown_shard (null: the law is ``bytes``).
    """
    return placed(docs.select("doc_id", "text", F.lit(0).alias("row")), shards).drop("row")


def placed(docs: DataFrame, shards: int) -> DataFrame:
    """``assign`` of ``docs(doc_id, text, row)``, with ``row`` passed through."""
    rows = docs.select(
        "row",
        "doc_id",
        (F.octet_length(text_of()) + 1).cast("long").alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
        F.md5(text_of().cast("binary")).alias("digest"),
    )
    # Rows equal in id and text, of which there may be any number, get different salts.
    salt = F.pmod(F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)) + F.col("nth"), F.lit(SALTS)).cast("int")
    rows = saved(told_apart(rows, ["doc_id", "digest"], "nth").withColumn("salt", salt).drop("nth"))
    units = rows.groupBy("digest", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    texts = units.groupBy("digest").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    texts = saved(texts.withColumn("part", F.conv(F.substring("digest", 1, 3), 16, 10).cast("int")))

    totals = texts.groupBy("part").agg(F.sum("n").alias("part_n"), F.sum("bytes").alias("part_bytes"))
    by_part = Window.partitionBy().orderBy("part")
    starts = totals.select(
        "part",
        running("part_n", by_part).alias("n_start"),
        running("part_bytes", by_part).alias("byte_start"),
        F.sum("part_bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    # RANGES rows at most, whatever the corpus.
    within = Window.partitionBy("part").orderBy("digest")
    placed = texts.join(F.broadcast(starts), "part").select(
        "digest",
        "n",
        (F.col("n_start") + running("n", within)).alias("first_row"),
        (F.col("byte_start") + running("bytes", within) + F.col("bytes") / 2).alias("middle"),
        "all_bytes",
    )
    shard = F.least(F.lit(shards - 1), F.floor(F.col("middle") * shards / F.col("all_bytes"))).cast("int")
    placed = saved(placed.select("digest", "first_row", shard.alias("shard")))
    # One row per shard.
    shard_rows = placed.groupBy("shard").agg(F.min("first_row").alias("shard_start"))

    by_salt = Window.partitionBy("digest").orderBy("salt")
    places = units.select("digest", "salt", running("n", by_salt).alias("salt_start")).join(placed, "digest")
    places = places.join(F.broadcast(shard_rows), "shard").select(
        "digest", "salt", "shard", (F.col("first_row") + F.col("salt_start") - F.col("shard_start")).alias("slot_start")
    )
    nth = F.row_number().over(Window.partitionBy("digest", "salt").orderBy("doc_id", "row")) - 1
    return rows.join(places, ["digest", "salt"]).select(
        "row",
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("slot_start") + nth).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, file_bytes: int = FILE_BYTES) -> None:
    """Write the documents as Parquet, a folder for each shard, files of about ``file_bytes`` of text in slot order.

    Rows are numbered in a first copy of the documents, so that each gets its own slot.
    """
    row, file = unused(docs, "quarry_row"), unused(docs, "quarry_file")
    numbered = saved(docs.drop("shard", "slot").withColumn(row, F.monotonically_increasing_id()))
    where = saved(placed(numbered.select("doc_id", "text", F.col(row).alias("row")), shards))
    totals = where.agg(F.sum("size"), F.count(F.lit(1))).first()
    files = max(1, -(-(totals[0] or 0) // (shards * file_bytes)))
    per_file = max(1, -(-(totals[1] or 0) // (shards * files)))
    own = where.select(F.col("row").alias(row), "shard", "slot", F.floor(F.col("slot") / per_file).alias(file))
    out = numbered.join(own, row).drop(row)
    dealt = out.repartition(shards * files, "shard", file).drop(file)
    dealt.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

r"""Exact deduplication against a persistent index of text digests.

Texts are equal when they are identical once each run of ``[\x20\x09-\x0D]`` is one
space.  The index is a table bucketed and sorted by digest, with one row per distinct
text and batch, in a partition of its own for each batch.  A batch of documents is
reduced to one row per digest, the digests already known are taken out with a
sort-merge anti-join that reads the index in place, and the rest is appended; of known
ones the batch's copies are appended, so that copies add up on reading.  Only digests
are shuffled, never texts, and the copies of a text are counted before the shuffle.

A batch sees the batches before it alone.  Added again under its name, it replaces its
own partition and gives the same result, so a job that failed half-way is run again.
The number of buckets comes from the first batch's size, one a core at least; once the table outgrows it,
``compact`` rewrites it with more, as ``add`` does by itself before a new batch.
A compaction keeps the rows of the last ``HORIZON`` batches apart, which can still be
added again, and makes one of all older ones.  Their names are kept in the table
``name_merged``; a batch of such a name is refused, as it was counted.  One writer at a time.

Defined cases: null and empty texts equal each other, and a text of white space only
equals ``" "``.  Within a batch the row with the smallest ``doc_id`` stays, null last,
and of rows with equal text and that id any one; a text known from an earlier batch
keeps that batch's id and none of the new rows.  Repeated rows all come back.  An
empty batch gives no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import SPACE_CLASS, join_groups, saved, text_of

#: Rows of a bucket when the table is made, about 64 MB; it is made anew at four times as many.
BUCKET_ROWS = 1_000_000
#: Batches that a compaction keeps apart, so that they can be added again.
HORIZON = 64


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, lowercase hex."""
    return F.sha2(F.regexp_replace(text, f"[{SPACE_CLASS}]+", " "), 256)


class DigestIndex:
    """Tables ``name_g1``, ``name_g2``, ... in the current database, of which the newest counts.

    Each has ``(text_sha256, keep_id, copies, seq, batch)`` of every distinct text seen
    in each batch.  A table is in the catalog only once it is whole, so a compaction
    that was stopped leaves an old one beside the new one, or nothing.
    """

    def __init__(self, spark: SparkSession, name: str, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.prefix, self.bucket_rows = spark, f"{name}_g", bucket_rows
        self._drop(self._generations()[:-1])

    def _generations(self) -> list[int]:
        names = (t.name.lower().removeprefix(self.prefix.lower()) for t in self.spark.catalog.listTables(pattern=f"{self.prefix}*"))
        return sorted(int(n) for n in names if n.isdigit())

    def _drop(self, generations: list[int]) -> None:
        for n in generations:
            self.spark.sql(f"DROP TABLE {self.prefix}{n}")

    @property
    def name(self) -> str:
        return f"{self.prefix}{max(self._generations(), default=1)}"

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self._drop(self._generations())
        self.spark.sql(f"DROP TABLE IF EXISTS {self.merged}")

    @property
    def merged(self) -> str:
        """The table ``(batch)`` of the batches that a compaction made one of."""
        return f"{self.prefix[:-2]}_merged"

    def _was_merged(self, batch: str) -> bool:
        return self.spark.catalog.tableExists(self.merged) and not self.spark.table(self.merged).where(F.col("batch") == batch).isEmpty()

    def known(self, before: int | None = None) -> DataFrame:
        """One row per text of the batches before this number: its first id, and its copies in all of them.

        The buckets keep a text together, so this shuffles nothing.
        """
        rows = self.table() if before is None else self.table().where(F.col("seq") < before)
        return rows.groupBy("text_sha256").agg(F.min_by("keep_id", "seq").alias("keep_id"), F.sum("copies").alias("copies"))

    def _create(self, name: str, rows: DataFrame, size: int) -> None:
        buckets = max(self.spark.sparkContext.defaultParallelism, -(-size // self.bucket_rows))
        dealt = rows.repartition(buckets, "text_sha256")
        writer = dealt.write.format("parquet").partitionBy("seq", "batch").bucketBy(buckets, "text_sha256")
        writer.sortBy("text_sha256").saveAsTable(name)

    def _buckets(self) -> int:
        described = self.spark.sql(f"DESCRIBE EXTENDED {self.name}").where("col_name = 'Num Buckets'")
        return int(described.first()["data_type"])

    def compact(self, keep: int = HORIZON) -> None:
        """One row per text of all batches but the last ``keep``, one sorted file per bucket and batch, and buckets for the present size."""
        old = self._generations()
        newest = self.table().agg(F.max("seq")).first()[0] or 0
        recent = self.table().where(F.col("seq") > newest - keep)
        merged = self.table().where((F.col("seq") <= newest - keep) & (F.col("seq") > 0)).select("batch").distinct()
        rows = self.known(newest - keep + 1).withColumns({"seq": F.lit(0), "batch": F.lit("compacted")})
        rows = saved(rows.unionByName(recent))
        # The names go first: a compaction that stops here refuses batches that are still whole, and may be run again.
        merged.write.format("parquet").mode("append").saveAsTable(self.merged)
        self._create(f"{self.prefix}{old[-1] + 1}", rows, rows.count())
        self._drop(old)

    def _begin(self, batch: str, size: int) -> int:
        """The number of this batch; makes or enlarges the table where needed."""
        if not self._generations():
            none = self.spark.createDataFrame([], "text_sha256 string, keep_id long, copies long, seq int, batch string")
            self._create(self.name, none, size)
            return 1
        if self._was_merged(batch):
            raise ValueError(f"batch {batch!r} was counted, and is older than the last {HORIZON}")
        numbers = {r["batch"]: r["seq"] for r in self.table().select("batch", "seq").distinct().collect()}  # one row a batch
        if batch in numbers:
            return numbers[batch]
        if self.table().count() > 4 * self.bucket_rows * self._buckets():
            self.compact()
        return 1 + max(numbers.values(), default=0)

    def _append(self, rows: DataFrame, seq: int, batch: str) -> None:
        """Write ``rows(text_sha256, keep_id, copies)`` as the batch's partition, in place of what it held."""
        # Dealt out by bucket first, so that a batch adds one file to each bucket.
        dealt = rows.repartition(self._buckets(), "text_sha256")
        name = batch.replace("\\", "\\\\").replace("'", "\\'").replace("{", "{{").replace("}", "}}")
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (seq = {seq}, batch = '{name}') SELECT * FROM {{dealt}}", dealt=dealt)

    def add(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Deduplicate a batch, append it to the index, and return a row per document.

        ``batch`` names it, so that it can be added again after a failure; without a
        name each call is a batch of its own.  Columns: doc_id, keep_id, group_size
        (rows with this text up to and with this batch), kept, text_sha256.
        """
        batch = batch or uuid.uuid4().hex
        row = F.monotonically_increasing_id().alias("row")
        rows = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(text_of()).alias("text_sha256"), row))
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
        new = saved(rows.groupBy("text_sha256").agg(first, F.count(F.lit(1)).alias("more")))
        seq = self._begin(batch, new.count())
        known = self.known(seq)
        fresh = new.join(known.hint("merge"), "text_sha256", "left_anti")
        fresh = fresh.select("text_sha256", F.col("first.doc_id").alias("keep_id"), "first.row", "more", F.col("more").alias("all"))
        seen = new.join(known.hint("merge"), "text_sha256")
        seen = seen.select("text_sha256", "keep_id", F.lit(None).cast("long").alias("row"), "more", (F.col("copies") + F.col("more")).alias("all"))
        groups = saved(fresh.unionByName(seen))
        self._append(groups.select("text_sha256", "keep_id", F.col("more").alias("copies")), seq, batch)
        joined = join_groups(rows, groups.withColumnRenamed("row", "kept_row"), ["text_sha256"], "more")
        kept = F.coalesce(F.col("row") == F.col("kept_row"), F.lit(False))
        return joined.select("doc_id", "keep_id", F.col("all").alias("group_size"), kept.alias("kept"), "text_sha256")

"""Expressions and session helpers that several operators use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.layout import spread

#: ASCII white space, as a regular expression class body and as plain characters.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    r"""Array of the words ``[^\x20\x09-\x0D]+``; empty for texts without one."""
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{SPACE_CLASS}]+"))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def unused(docs: DataFrame, name: str) -> str:
    """The name, with underscores behind it until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def saved(df: DataFrame) -> DataFrame:
    """The frame cut off from its lineage: written to, and reread from, the checkpoint folder.

    The folder is ``spark.checkpoint.dir``; only where that is unset, as in local
    tests, does a temporary one stand in.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate results, which driver and executors share."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="quarry-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder: for wide rows, of which later steps read some columns."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Groups with more than one in this many of the rows are hot; there are fewer of them than this.
HOT_SHARE = 4096


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """The inner join of rows with one row per group, however many rows a group has.

    ``weight`` is the column of ``groups`` with each group's number of rows, 1 at least.
    Groups with more than ``1 / HOT_SHARE`` of all rows, fewer than ``HOT_SHARE`` by
    that, are broadcast, and their rows stay where they are; the rest is shuffled.
    Both frames are read twice, so they should be saved.
    """
    total = groups.agg(F.sum(weight)).first()[0] or 0
    hot = groups.where(F.col(weight) * HOT_SHARE > total)
    few = F.broadcast(hot)
    usual = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(few, keys).unionByName(usual.join(groups.where(F.col(weight) * HOT_SHARE <= total), keys))


def prefix_sums(df: DataFrame, order: list[str], columns: dict[str, str]) -> DataFrame:
    """Adds for each column a new one with its sum over the rows before, in an order without ties.

    The rows are dealt out by ranges of the order; the ranges' totals, one row a task,
    give each range its start.
    """
    dealt = saved(df.repartitionByRange(*order).withColumn("quarry_range", F.spark_partition_id()))
    before = Window.orderBy("quarry_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("quarry_range").agg(*(F.sum(c).alias(new) for c, new in columns.items()))
    starts = totals.select("quarry_range", *(F.coalesce(F.sum(new).over(before), F.lit(0)).alias(f"quarry_{new}") for new in columns.values()))
    within = Window.partitionBy("quarry_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = {new: F.col(f"quarry_{new}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for c, new in columns.items()}
    return dealt.join(F.broadcast(starts), "quarry_range").withColumns(sums).drop("quarry_range", *(f"quarry_{new}" for new in columns.values()))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder, over all cores even where it is a single file."""
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))

"""How rows are dealt out to tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(table: DataFrame, order: str | None = None) -> DataFrame:
    """The table over all cores, where its files are fewer than these, by ranges of ``order`` if that is given.

    Else it stays as it is read, without a shuffle.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    if table.rdd.getNumPartitions() >= cores:
        return table
    return table.repartition(cores) if order is None else table.repartitionByRange(cores, order)

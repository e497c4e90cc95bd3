"""The ingest queue: what became of each file, in the order of events."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: States of a file, in order.
PENDING, RUNNING, DONE, ERROR = STATES = ("pending", "running", "done", "error")
EVENT = "batch long, path string, state string, error string, at timestamp"


class IngestQueue:
    """A table of events, to which each batch of files adds; a file's last event is its state."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def events(self) -> DataFrame:
        try:
            return self.spark.read.schema(EVENT).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], EVENT)

    def record(self, batch: int, files: DataFrame, state: str) -> None:
        """``files(path, error)`` come to a state."""
        rows = files.select(F.lit(batch).cast("long").alias("batch"), "path", F.lit(state).alias("state"), "error", F.current_timestamp().alias("at"))
        rows.write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        """``path, state, error, batch, at``: each file's last event."""
        nth = F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
        last = F.max(F.struct("at", nth.alias("nth"), "state", "error", "batch")).alias("last")
        return self.events().where("path IS NOT NULL").groupBy("path").agg(last).select("path", "last.state", "last.error", "last.batch", "last.at")

    def finished(self, batch: int) -> bool:
        """Whether a batch of this number came to its end."""
        return not self.events().where((F.col("batch") == batch) & F.col("path").isNull() & (F.col("state") == DONE)).isEmpty()

    def finish(self, batch: int) -> None:
        """Note the end of a batch, by an event without a file."""
        row = [(None, None)]
        self.record(batch, self.spark.createDataFrame(row, "path string, error string"), DONE)

    def next_batch(self) -> int:
        """A number below those of streams, which count from 0."""
        return min(self.events().agg(F.min("batch")).first()[0] or 0, 0) - 1

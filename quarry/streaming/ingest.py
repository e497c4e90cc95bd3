"""Continuous ingest: new files of a folder become documents, a batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

FILES = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """The folder's files as a stream, each once."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", max_files)
    return reader.load(folder).select("path", "content")


def ingest_stream(engine, folder: str, checkpoint: str, once: bool = False, strict: bool = False) -> StreamingQuery:
    """Ingest each batch with ``engine``, whose queue shows what became of each file.

    A batch that came to its end isn't done again.  One that failed before that replaces
    its own documents, as their ids come from the files' paths.
    """

    def batch(files: DataFrame, number: int) -> None:
        engine.ingest_batch(files, number, strict)

    writer = file_stream(engine.spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()

"""Paragraph chunks: a fold over each text's paragraphs, inside one expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import strip

TARGET = 800
#: Documents whose order numbers fall in one range are numbered in one task.
RANGE = 65_536


def paragraphs(text: Column) -> Column:
    """Stripped paragraphs, blank ones left out."""
    return F.filter(F.transform(F.split(text, "\n\n", -1), strip), lambda p: p != "")


def chunks_of(text: Column, target: int = TARGET, ingest: bool = True) -> Column:
    """Chunks of a text: paragraphs are packed while their lengths sum to the target at most.

    A longer paragraph is a chunk of its own.  At ingest carriage returns go first and a
    text without paragraphs is one stripped chunk; else the text itself is that chunk.
    """
    clean = F.replace(text, F.lit("\r"), F.lit("")) if ingest else text
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), none.alias("open"), F.lit(0).alias("n"))

    def add(state: Column, paragraph: Column) -> Column:
        full = (state["n"] + F.length(paragraph) > target) & (F.size(state["open"]) > 0)
        closed = F.concat(state["done"], F.array(F.array_join(state["open"], "\n")))
        return F.struct(
            F.when(full, closed).otherwise(state["done"]).alias("done"),
            F.when(full, F.array(paragraph)).otherwise(F.concat(state["open"], F.array(paragraph))).alias("open"),
            F.when(full, F.length(paragraph)).otherwise(state["n"] + F.length(paragraph)).alias("n"),
        )

    def finish(state: Column) -> Column:
        last = F.concat(state["done"], F.array(F.array_join(state["open"], "\n")))
        return F.when(F.size(state["open"]) > 0, last).otherwise(F.array(strip(text) if ingest else text))

    return F.aggregate(paragraphs(clean), start, add, finish)


def canonical(chunks: Column) -> Column:
    """The text that is stored: chunks with a blank line between."""
    return F.array_join(chunks, "\n\n")


def numbered(counts: DataFrame) -> DataFrame:
    """``doc_ord, first``: how many chunks the documents before have, from ``doc_ord, n``.

    Totals of ranges of the order give each range its start, a running sum within the
    range the rest; no task sees all documents.
    """
    ranged = counts.withColumn("range", F.floor(F.col("doc_ord") / RANGE))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("range").agg(F.sum("n").alias("all"))
    starts = totals.select("range", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("range").orderBy("doc_ord").rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(starts, "range")
    return joined.select("doc_ord", (F.col("start") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("first"))


def folded(docs: DataFrame, target: int = TARGET, ingest: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_ord, id, chunks`` of every document ``(doc_ord, id, text)``, with the columns to ``keep``."""
    return docs.select("doc_ord", "id", *keep, chunks_of(F.coalesce("text", F.lit("")), target, ingest).alias("chunks"))


def exploded(folds: DataFrame) -> DataFrame:
    """``doc_ord, id, chunk_pos, chunk_idx, chunk``: a row per chunk, numbered over all documents."""
    n = F.col("n") if "n" in folds.columns else F.size("chunks").cast("long").alias("n")
    first = numbered(folds.select("doc_ord", n))
    rows = folds.join(first, "doc_ord").select("doc_ord", "id", "first", F.posexplode("chunks").alias("chunk_pos", "chunk"))
    return rows.select("doc_ord", "id", "chunk_pos", (F.col("first") + F.col("chunk_pos")).alias("chunk_idx"), "chunk")


def chunk_table(docs: DataFrame, target: int = TARGET, ingest: bool = False) -> DataFrame:
    return exploded(folded(docs, target, ingest))

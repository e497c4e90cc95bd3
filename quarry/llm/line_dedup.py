r"""Removal of lines that are spread over many sites.

A line is a piece between ``\n``; its site is the document's source.  Lines with a
word that stand on at least ``min_sites`` distinct sites are boilerplate and go from
every place but their first, so that no text is lost from the corpus.  The first
place is the one with the smallest ``doc_id``, null ids last, then the smallest
position.

The spread comes from HyperLogLog sketches of the sites, one per line hash, merged
by aggregation.  Lines whose estimate is within ``band`` of the threshold get an
exact distinct count; far from it the estimate decides.  A line can't have more sites
than places, so only lines with ``min_sites`` places are sketched.

Lines are known by 128 bits of hash.  A line of any frequency is combined before it is
shuffled for counting, and the places of very frequent ones stay where they are when
they meet what is known of their line.  Only hashes and positions are shuffled for the
counting; a document's text moves once, to meet the positions to remove.

Defined cases: null texts count as empty and have one blank line; blank lines always
stay; a null source is a site of its own; of repeated rows with one ``doc_id`` and
text each keeps the first place's line, and rows that repeat a ``doc_id`` with another
text are documents of their own, so that each loses its own lines only; rows without ``doc_id`` lose lines as others do, each
known by a hash of its text and source, and those with equal text and source count as
repeated; an empty table gives no rows.  Columns besides doc_id, text and source pass
through ``clean`` unchanged, but ``n_chars`` where it exists is counted anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SPACES, join_groups, saved, text_of, unused

MIN_SITES = 10
#: Relative distance from the threshold within which spreads are counted exactly.
BAND = 0.3
#: 2**12 registers: a standard error of 1.6 %, so the band is over ten of them wide.
LOG_REGISTERS = 12
#: The columns that a row is known by.
ROW = ["no_id", "own", "text_hash"]
#: A line's place, in the order that the first is taken by.
PLACE = ["no_id", "own", "pos", "text_hash"]


def site() -> Column:
    return F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))


def row_key() -> dict[str, Column]:
    """``ROW``, never null: the ``doc_id``, or without one a hash of text and source, and a hash of the text."""
    own = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text_of(), site()))
    return {"no_id": F.col("doc_id").isNull(), "own": own, "text_hash": F.xxhash64(F.lit(1), text_of())}


def line_places(docs: DataFrame) -> DataFrame:
    """Hash, row, position and site of each line with a word."""
    key = [column.alias(name) for name, column in row_key().items()]
    lines = docs.select(*key, site().alias("site"), F.posexplode(F.split(text_of(), "\n")).alias("pos", "line"))
    worded = lines.where(F.btrim("line", F.lit(SPACES)) != "")
    return worded.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), *ROW, "pos", "site")


def common_places(places: DataFrame, min_sites: int) -> DataFrame:
    """The places of lines with ``min_sites`` places or more, and ``n``, how many."""
    counts = places.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    return join_groups(places, saved(counts.where(F.col("n") >= min_sites)), ["h1", "h2"], "n")


def boilerplate(places: DataFrame, min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """Hashes and ``n`` of the lines on ``min_sites`` sites or more, with their first place, from ``common_places``."""
    spread = places.groupBy("h1", "h2", "n").agg(
        F.hll_sketch_agg("site", LOG_REGISTERS).alias("sketch"), F.min(F.struct(*PLACE)).alias("first")
    )
    spread = spread.select("h1", "h2", "n", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = saved(spread.where(F.col("sites") >= min_sites * (1 - band)))
    sure = spread.where(F.col("sites") > min_sites * (1 + band))
    near = spread.where(F.col("sites") <= min_sites * (1 + band))
    around = join_groups(places.drop("n"), near.select("h1", "h2", "n"), ["h1", "h2"], "n")
    exact = around.select("h1", "h2", "site").distinct().groupBy("h1", "h2").count().where(F.col("count") >= min_sites)
    checked = near.join(exact.select("h1", "h2"), ["h1", "h2"], "left_semi")
    return sure.unionByName(checked).select("h1", "h2", "n", "first")


def clean(docs: DataFrame, min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """The documents without the boilerplate lines, and the columns n_lines and n_removed.

    Columns named ``n_lines`` or ``n_removed`` are replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    places = saved(common_places(saved(line_places(docs.select("doc_id", "text", "source"))), min_sites))
    hits = join_groups(places.drop("n"), saved(boilerplate(places, min_sites, band)), ["h1", "h2"], "n")
    hits = hits.where(F.struct(*PLACE) != F.col("first"))
    names, goes = {c: unused(docs, f"quarry_{c}") for c in ROW}, unused(docs, "quarry_gone")
    gone = hits.groupBy(*(F.col(c).alias(names[c]) for c in ROW)).agg(F.collect_set("pos").alias(goes))
    lines = F.split(text_of(), "\n")
    keyed = docs.withColumns({"n_lines": F.size(lines).cast("long")} | {names[c]: column for c, column in row_key().items()})
    joined = keyed.join(gone, [names[c] for c in ROW], "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(goes))
    kept = F.array_join(F.transform(F.array(lines), lambda own: F.transform(stay, lambda i: own[i]))[0], "\n")
    text = F.when(F.col(goes).isNull(), F.col("text")).otherwise(kept)
    removed = F.coalesce(F.size(goes), F.lit(0))
    out = joined.withColumns({"text": text, "n_removed": F.when(F.col(goes).isNull(), 0).otherwise(removed).cast("long")})
    out = out.drop(goes, *names.values())
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out

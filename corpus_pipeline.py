"""A corpus from raw documents to token ids, in five stages.

Each stage is a function ``(spark, docs, sf_dir) -> DataFrame`` over all rows that the
stage before it kept.  The first four return the columns of ``documents``, and further
ones that ``docs`` has, whatever their names.

Defined cases, as the operators have them: null texts count as empty and, as all texts of
under ten words, go in the first stage.  Rows without ``doc_id`` are documents like others;
of near duplicates the smallest ``doc_id`` stays, null last.  Rows that repeat an id are a
document each: equal ones are near duplicates of each other, unlike ones stay.  A null
source is a source of its own.  Ties are broken by id, text and then the other columns, so
reruns agree.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, jaccard_join, line_dedup, mixing, quality_rules
from quarry.llm.common import read, written
from quarry.llm.queries import vocabulary


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned list rejects go."""
    return quality_rules.keep_good(docs, read(spark, sf_dir, "labels"))


def remove_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites stay in their first place only."""
    return line_dedup.clean(docs).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.mixed(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids."""
    encoded = bpe.encode(spark, docs, vocabulary("word_bpe_49k.json"))
    return encoded.selectExpr("doc_id", "cast(size(ids) AS long) AS n_tokens", "ids")


STAGES = [
    ("quality rules", apply_quality_rules),
    ("line dedup", remove_common_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("BPE encoding", encode_tokens),
]

#: The learned rules and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written as Parquet and read again by the next one."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs

"""Presets as a table."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession

from quarry.sources.config import PRESETS


def preset_table(spark: SparkSession) -> DataFrame:
    rows = [(name, *dataclasses.astuple(p)) for name, p in PRESETS.items()]
    schema = (
        "name string, hybrid boolean, dense_k long, sparse_k long, rerank_pool long, top_n long, compression boolean, "
        "target_tokens long, raptor string, graph boolean, coverage_target double, max_context_tokens long"
    )
    return spark.createDataFrame(rows, schema)

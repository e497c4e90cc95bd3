"""Every catalog query against its SQL on the smallest data."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from quarry.plans import catalog

SF = "/root/testdata/sf0.001"
ORACLES = __spark_entry__.oracle_sql()


def comparable(frame):
    shown = frame[sorted(frame.columns)].map(lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v))
    return sorted(map(tuple, shown.values.tolist()))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF).toPandas()
    expected = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert comparable(got) == comparable(expected)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 40


def test_index_follows_changed_tables(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")

    def chunks(*texts):
        rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.mode("overwrite").parquet(path)
        first, again = catalog.index(spark, str(tmp_path)), catalog.index(spark, str(tmp_path))
        assert first.chunks.inputFiles() == again.chunks.inputFiles()
        return sorted(r["chunk"] for r in first.chunks.collect())

    assert chunks("granite is hard") == ["granite is hard"]
    assert chunks("basalt is dark", "chalk is soft") == ["basalt is dark", "chalk is soft"]

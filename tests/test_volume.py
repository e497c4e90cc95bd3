"""What steps send and hold: no row for a chunk and term is shuffled, and no task has a whole bucket."""

from pyspark.sql import functions as F

from quarry.operators import index as I
from quarry.operators import retrieve
from quarry.operators.index import Index, raw_blocks, term_frequency


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def documents(spark, n):
    return spark.range(n).select(
        F.col("id").alias("doc_ord"), F.col("id").cast("string").alias("id"), F.lit("t").alias("title"),
        F.concat_ws(" ", F.lit("stone"), F.concat(F.lit("w"), F.col("id") % 7), F.concat(F.lit("only"), "id")).alias("text"),
    )


def test_words_are_counted_without_a_shuffle(spark):
    rows = spark.createDataFrame([(1, "Tree tree the stone"), (2, ""), (3, None), (4, "the of")], "key long, text string")
    tf = term_frequency(rows, "key", "text")
    assert "Exchange" not in plan(tf)
    assert sorted(map(tuple, tf.collect())) == [(1, "stone", 1), (1, "tree", 2)]


def test_blocks_are_shuffled_packed(spark):
    own = Index.of(documents(spark, 1500))
    [part] = own.parts
    raw = raw_blocks(own.live_chunks)
    blocks = raw.where("block IS NOT NULL")
    assert blocks.count() <= 1500 // I.BLOCK + raw.rdd.getNumPartitions()
    terms = {r["term"]: (r["df"], r["spread"]) for r in own.terms.collect()}
    assert len(terms) == 1508 and terms["stone"] == (1500, 1) and terms["only5"] == (1, 1) and terms["w1"] == (215, 1)


def test_sweep_packs_blocks_and_sends_no_pairs(spark):
    own = Index.of(documents(spark, 1500))
    questions = spark.createDataFrame([(1, "stone"), (2, "w1 only5"), (3, "nothing")], "qid long, question string")
    place = own.blocks.withColumn("cell", F.lit(0)).mapInArrow(retrieve.dealt_blocks(), retrieve.DEALT)
    assert place.count() < own.blocks.count() / 50
    got = {r["qid"]: r for r in retrieve.score_totals(questions, own).collect()}
    model = retrieve.cosine_scores(questions, own).groupBy("qid").agg(F.count(F.lit(1)).alias("chunks"), F.sum("score").alias("total"), F.max("score").alias("best"))
    expected = {r["qid"]: r for r in model.collect()}
    assert sorted(got) == sorted(expected) == [1, 2]
    for qid, r in expected.items():
        assert got[qid]["chunks"] == r["chunks"] and abs(got[qid]["total"] - r["total"]) < 1e-6 and abs(got[qid]["best"] - r["best"]) < 1e-9


def test_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    import glob

    from quarry.sources.store import DocumentStore

    own = DocumentStore(spark, str(tmp_path / "s"), buckets=1)
    rows = spark.range(0, 40_000, 1, 4).select(
        F.col("id").cast("string").alias("id"), F.lit("t").alias("title"), F.concat(*(F.sha2((F.col("id") + i).cast("string"), 256) for i in range(8))).alias("text"),
        F.create_map().cast("map<string,string>").alias("metadata"), F.col("id").alias("nth"),
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        own.upsert(rows)
        own.compact()
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    for version in (1, 2):
        assert len(glob.glob(f"{own.folder(version)}/bucket=0/part-*")) > 1
    assert own.read().count() == 40_000 and own.get("17").count() == 1


def test_index_rows_are_carried_as_single_values(spark):
    own = Index.of(documents(spark, 1500))
    raw = raw_blocks(own.live_chunks)
    assert not [f.name for f in raw.schema.fields if f.dataType.typeName() == "array"]
    told = {r["term"]: (r["df"], r["blocks"]) for r in I.counted_terms(raw).collect()}
    assert len(told) == 1508 and told["stone"][0] == 1500 and told["only5"] == (1, 1)


def test_weighed_rows_leave_in_pieces(spark, monkeypatch):
    own = Index.of(documents(spark, 1500))
    raw = raw_blocks(own.live_chunks.coalesce(1))
    known = I.counted_terms(raw).select("term", "df", F.lit(1).alias("spread"))
    blocks, back = raw.where("block IS NOT NULL").toArrow(), known.where("df > 1").toArrow()
    whole = I.weighed(0, 1500)(None, blocks, back)
    monkeypatch.setattr(I, "SENT", 64)
    pieces = I.weighed(0, 1500)(None, blocks, back)
    assert len(pieces) > 1500 and pieces.combine_chunks().equals(whole.combine_chunks())
    assert max(len(x) for x in pieces["term"].chunks) <= 64


def held_cell(spark, own):
    rows = own.blocks.select("segment", "block", "kind", "term", "places", "counts", "n").withColumn("cell", F.lit(0)).toArrow()
    cell = retrieve.Cell(own.level)
    for batch in retrieve.dealt_blocks()(rows.to_batches()):
        for nth in range(batch.num_rows):
            cell.add(batch, nth)
    cell.close()
    return cell


def test_cell_holds_a_posting_in_few_bytes(spark):
    own = Index.of(documents(spark, 3000))
    postings, rows = own.blocks.where(F.col("kind") == I.TERM).agg(F.sum("n"), F.count(F.lit(1))).first()
    cell = held_cell(spark, own)
    assert sum(len(x[2]) for x in cell.tiles) == postings
    assert sum(x.nbytes for tile in cell.tiles for x in tile) <= 4 * postings + 8 * rows + 64


def test_cell_multiplies_some_products_at_a_time(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    cell, n = held_cell(spark, Index.of(documents(spark, 3000))), 40
    terms = [["stone", f"w{i % 7}", f"only{i}"] for i in range(n)]
    asked = pa.RecordBatch.from_pydict({"rows": [list(range(n))], "ks": [[5] * n], "sizes": [[3] * n], "terms": [sum(terms, [])], "weights": [[1.0, 0.5, 0.25] * n]})
    out, add, sizes = np.empty(n * retrieve.TILE), np.add, []

    class Add:
        @staticmethod
        def at(a, i, b):
            sizes.append(len(i))
            add.at(a, i, b)

    whole = cell.best(asked, 0, out)
    monkeypatch.setattr(retrieve, "PRODUCTS", 4000)
    monkeypatch.setattr(retrieve.np, "add", Add)
    got = cell.best(asked, 0, out)
    monkeypatch.undo()
    # A term's postings in a tile, or products of rare ones and one term's more.
    assert got.equals(whole) and whole.num_rows == 5 * n and max(sizes) <= 4000 + retrieve.OUTER


def test_moves_of_a_block_are_summed_without_an_object_a_row():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng, n = np.random.default_rng(3), 20_000
    size, olds, news = rng.integers(1, 4, n), rng.random(n), rng.random(n)
    places, counts = [rng.integers(0, I.BLOCK, k).astype("<i4") for k in size], [rng.integers(1, 5, k).astype("<i4") for k in size]
    table = pa.table({"places": [x.tobytes() for x in places], "counts": [x.tobytes() for x in counts], "d_old": olds, "d_new": news})
    key = (pa.scalar(0), pa.scalar(7))
    I.moved(key, table)
    tracemalloc.start()
    [got] = I.moved(key, table).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    expected = np.zeros((2, I.BLOCK))
    for at, c, a, b in zip(places, counts, olds, news, strict=True):
        np.add.at(expected, (slice(None), at), np.array([c**2 * (b - a), c**2 * (b**2 - a**2)]))
    at = np.frombuffer(got["places"], "<i4")
    assert np.allclose(np.frombuffer(got["counts"], "<f8").reshape(2, -1), expected[:, at]) and len(at) == got["n"] == I.BLOCK
    assert peak < 250 * n

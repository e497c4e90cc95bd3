"""The learned rules and the whole pipeline against plain Python models, and operators on workers without this package."""

import os
import random
import subprocess
import sys
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import quality_rules
from tests.llm import brute
from tests.llm.test_operators import SCHEMA, prose, reference_tokenizer

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def raw_documents():
    """Clean prose, junk of three kinds, copies, near copies and lines that many sites share."""
    own, rows = random.Random(11), []
    for i in range(150):
        rows.append([i, f"{prose(i, 30 + i % 40)}\nread our terms\n{prose(1000 + i, 12)}", f"s{i % 13}"])
    for i in range(150, 200):
        w = rows[i - 150][1].split(" ")
        if i % 2:
            w[3] = f"edit{i}"
        rows.append([i, " ".join(w), f"s{i % 13}"])
    for i in range(200, 260):
        rows.append([i, " ".join(w + own.choice(["#", "$%", ""]) for w in prose(i, 50).split(" ")), f"s{i % 13}"])
    for i in range(260, 300):
        rows.append([i, " ".join(w for w in prose(i, 25).split(" ") for _ in range(2)), f"s{i % 13}"])
    rows += [[300 + i, "too short", "s1"] for i in range(5)] + [[310 + i, "a b c d e f g " * 9, None] for i in range(5)]
    rows += [[320, prose(320, 40), None], [321, prose(321, 45), None]]
    return rows


def labels_of(rows):
    return [(d, int(not (200 <= d < 300))) for d, _, _ in rows if d % 5 != 4]


def model_rules(rows, cuts):
    counts = {d: brute.counts(t) for d, t, _ in rows}
    return counts, brute.learned([(d, counts[d], 1 - q) for d, q in labels_of(rows)], cuts)


def test_learned_rules_match_plain_covering(spark):
    rows = raw_documents()
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame(labels_of(rows), "doc_id long, quality int")
    measured = quality_rules.measure(docs)
    cuts = quality_rules.thresholds(measured.where(~quality_rules.base_failed()).join(labels, "doc_id"))
    names = list(cuts)
    got = [[(names.index(c.statistic), c.above, c.threshold) for c in rule] for rule in quality_rules.learn(measured, labels)]
    counts, expected = model_rules(rows, list(cuts.values()))
    assert got == expected and len(got) >= 2
    out = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs, labels).collect()}
    assert out == {d: brute.good(counts[d], expected) for d, _, _ in rows}
    # Clean documents stay, most junk goes.
    assert all(out[d] for d in range(200)) and sum(out[d] for d in range(200, 300)) < 20


def test_pipeline_matches_plain_stages(spark, tmp_path):
    rows = raw_documents()
    path = str(tmp_path)
    spark.createDataFrame([(d, t, "en", s, len(t)) for d, t, s in rows], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels_of(rows), "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    labels = spark.read.parquet(f"{path}/labels.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    measured = quality_rules.measure(docs)
    cuts = list(quality_rules.thresholds(measured.where(~quality_rules.base_failed()).join(labels, "doc_id")).values())

    counts, rules = model_rules(rows, cuts)
    now = [tuple(r) for r in rows if brute.good(counts[r[0]], rules)]
    expected = [now]
    now = brute.without_common_lines(now)
    expected.append(now)
    classes = brute.near_classes([(d, t) for d, t, _ in now])
    now = [r for r in now if classes[r[0]][0] == r[0]]
    expected.append(now)
    copies = brute.copies_in_mix(now)
    now = [r for r in now for _ in range(copies[r[0]])]
    expected.append(now)
    sizes = [len(x) for x in expected]
    assert sizes[0] > sizes[2] > 100 and max(copies.values()) == 2 and expected[0] != expected[1]

    for (_, stage), wanted in zip(corpus_pipeline.STAGES[:4], expected, strict=True):
        columns = docs.columns
        docs = stage(spark, docs, path)
        assert docs.columns == columns
        assert Counter((r["doc_id"], r["text"], r["source"]) for r in docs.collect()) == Counter(wanted)
    t = reference_tokenizer()
    ids = Counter((d, tuple(t.encode(x, add_special_tokens=False).ids)) for d, x, _ in now)
    final = corpus_pipeline.run(spark, path).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in final) == ids and all(r["n_tokens"] == len(r["ids"]) for r in final)


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in any column, repeated rows and columns with the operators' own names."""
    path = str(tmp_path)
    rows = [(i, prose(i, 40), "en", f"s{i % 3}", None) for i in range(30)]
    rows += [(None, prose(100, 40), None, None, None)] * 3 + [(5, prose(5, 40), "en", "s2", None)] * 4 + [(6, prose(200, 40), "en", "s0", 1)]
    rows += [(40, None, None, "s1", None), (None, None, None, None, None), (41, "", "en", None, 0)]
    clashing = ["quarry_row", "quarry_times", "quarry_gone", "quarry_own", "quarry_no_id", "quarry_text_hash", "quarry_counts", "quarry_n_words", "row", "kept", "size"]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit(c) for c in clashing})
    spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    kept = [Counter(rows)]
    for _, stage in corpus_pipeline.STAGES[:4]:
        columns = docs.columns
        docs = stage(spark, docs, path).cache()
        assert docs.columns == columns and all(r[c] == c for r in docs.collect() for c in clashing)
        kept.append(Counter((r["doc_id"], r["text"]) for r in docs.collect()))
    assert set(kept[1]) == {(r[0], r[1]) for r in rows if r[1]} and kept[2] == kept[1]
    assert set(kept[3]) == set(kept[1]) and set(kept[3].values()) == {1}
    assert set(kept[4]) <= set(kept[3]) and max(kept[4].values()) <= 2
    assert corpus_pipeline.STAGES[4][1](spark, docs, path).count() == sum(kept[4].values())


def test_pipeline_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0


CHILD = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
    .config("spark.sql.warehouse.dir", "warehouse").config("spark.checkpoint.dir", "shared").getOrCreate())

def missing(batches):
    import importlib.util, pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_pydict({{"found": [importlib.util.find_spec("quarry") is not None]}})

assert not spark.range(1).mapInArrow(missing, "found boolean").first()["found"]
from quarry.llm.queries import QUERIES
for name, query in QUERIES.items():
    print("ROWS", name, query(spark, "/root/testdata/sf0.001").count(), flush=True)
"""


def test_operators_on_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    vocabularies = os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and not os.path.isdir(f"{p}/quarry"))
    script = tmp_path / "child.py"
    script.write_text(CHILD.format(repo=REPO))
    run = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env | {"PYTHONPATH": vocabularies}, capture_output=True, text=True, timeout=600)
    rows = {x.split()[1]: int(x.split()[2]) for x in run.stdout.splitlines() if x.startswith("ROWS")}
    assert run.returncode == 0 and len(rows) == 14 and all(n > 0 for n in rows.values()), run.stderr[-3000:]

"""What changes cost and what they leave: index segments, block bounds, buckets, expiry, the queue, traces, answers."""

import json
import os
import random
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarry.engine import Engine
from quarry.operators import answer as A
from quarry.operators import generate, index, retrieve
from quarry.operators.index import Index
from quarry.sources import store
from quarry.sources.config import Retrieval

DOC = "doc_ord long, id string, title string, text string"
STORED = "id string, title string, text string, metadata map<string,string>, nth long"


def prose(own, n, words):
    return "\n\n".join(" ".join(own.choices(words, k=own.randint(1, 120))) for _ in range(n))


def hits(asked, found, k):
    return sorted(tuple(r) for r in retrieve.top_k(asked, found, k).select("qid", "rank", "chunk_idx", "score").collect())


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 8)
    monkeypatch.setattr(index, "TERM_BLOCKS", 2)
    monkeypatch.setattr(index, "RANGE", 4)
    monkeypatch.setattr(retrieve, "GROUP", 2)
    monkeypatch.setattr(retrieve, "FEW_BLOCKS", 0)


def test_changes_give_what_a_full_build_gives(spark, tmp_path, small_blocks):
    """Added, replaced, deleted and restored documents, in several changes and after these were merged."""
    own = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["common"] * 6 + ["the"]
    docs = {i: (f"d{i}", f"t{i % 5}", prose(own, own.randint(1, 4), words)) for i in range(40)}
    frame = lambda rows: spark.createDataFrame([(i, *d) for i, d in sorted(rows.items())], DOC)
    now = Index.of(frame(docs)).write(str(tmp_path / "v0"))
    asked = spark.createDataFrame([(i, " ".join(own.choices(words, k=5))) for i in range(6)] + [(6, "common new0 new2"), (7, "the"), (8, "w3 new1")], "qid long, question string")
    last = 40
    for step in range(4):
        changed = set()
        for i in own.sample(sorted(docs), 3):
            if own.random() < 0.5:
                changed.add(docs.pop(i)[0])
            else:
                docs[i] = (docs[i][0], "moved", prose(own, own.randint(1, 5), words) + f" new{step}")
                changed.add(docs[i][0])
        for _ in range(2):
            docs[last] = (f"d{last % 43}", "fresh", prose(own, 2, words) + f" new{step} common")
            changed.add(docs[last][0])
            docs = {i: d for i, d in docs.items() if i == last or d[0] != docs[last][0]}
            last += 1
        ids = spark.createDataFrame([(i,) for i in changed], "id string")
        fresh = frame({i: d for i, d in docs.items() if d[0] in changed})
        now = now.changed(str(tmp_path / f"v{step + 1}"), ids, fresh)
        whole = Index.of(frame(docs)).write(str(tmp_path / f"whole{step}"))
        again = Index.read(spark, str(tmp_path / f"v{step + 1}"))
        assert again.n == whole.n and again.chunks.count() == whole.chunks.count()
        assert hits(asked, again, 4) == hits(asked, whole, 4)
        known = lambda i: sorted((r["term"], r["df"], round(r["idf"], 9)) for r in i.idf.collect())
        assert known(again) == known(whole)
        # Bounds hold: no block has a better weight than its top says.
        assert all(p.rho <= 1 for p in again.parts)
    merged = now.base.changed(str(tmp_path / "merged"), now.changed_ids(), frame({i: d for i, d in docs.items() if d[0] in {r["id"] for r in now.changed_ids().collect()}}))
    assert len(merged.parts) == 2 and hits(asked, merged, 4) == hits(asked, whole, 4)


def test_a_change_writes_by_its_documents(spark, tmp_path):
    own = random.Random(5)
    words = [f"word{i}" for i in range(4000)]
    docs = spark.createDataFrame([(i, f"d{i}", "t", prose(own, 3, words)) for i in range(600)], DOC)
    base = Index.of(docs).write(str(tmp_path / "v0"))
    one = spark.createDataFrame([(600, "d600", "t", "word1 word2 special")], DOC)
    new = base.changed(str(tmp_path / "v1"), one.select("id"), one)
    size = lambda folder, table: sum(os.path.getsize(os.path.join(f, n)) for f, _, names in os.walk(f"{folder}/{table}") for n in names if n.endswith(".parquet"))
    for table in ("chunks", "blocks", "terms"):
        assert size(new.parts[1].folder, table) < 0.2 * size(base.parts[0].folder, table), table
    asked = spark.createDataFrame([(0, "special word1")], "qid long, question string")
    assert hits(asked, new, 3) == hits(asked, Index.of(docs.unionByName(one)), 3)


def test_blocks_that_cannot_matter_are_skipped(spark, tmp_path, monkeypatch, small_blocks):
    """Blocks on different subjects: a question is compared with its own, and gets what all comparisons give."""
    own = random.Random(8)
    rows = []
    for i in range(60):
        words = [f"s{i // 4}x{j}" for j in range(12)] + ["common"]
        rows.append((i, f"d{i}", "t", prose(own, 2, words)))
    found = Index.of(spark.createDataFrame(rows, DOC).coalesce(1)).write(str(tmp_path / "i"))
    assert found.blocks.where(f"kind = {index.HEAD}").count() >= 12
    asked = spark.createDataFrame([(i, f"common s{i}x1 s{i}x2 s{i}x3") for i in range(15)], "qid long, question string")
    pairs = []
    plain = retrieve.compared
    monkeypatch.setattr(retrieve, "compared", lambda p, *more: pairs.append(p.count()) or plain(p, *more))
    monkeypatch.setattr(retrieve, "FIRST_BLOCKS", 1)
    best = hits(asked, found, 2)
    blocks = found.blocks.where(f"kind = {index.HEAD}").count()
    assert sum(pairs) < 0.5 * 15 * blocks
    scores = {}
    for r in retrieve.cosine_scores(asked, found).collect():
        scores.setdefault(r["qid"], []).append((-r["score"], -r["chunk_idx"]))
    monkeypatch.setattr(retrieve, "FEW_BLOCKS", 256)
    assert hits(asked, found, 2) == best
    assert {(q, rank, i) for q, rank, i, _ in best} == {(q, n + 1, -i) for q, s in scores.items() for n, (_, i) in enumerate(sorted(s)[:2])}


def test_questions_without_or_with_one_key(spark, tmp_path):
    docs = spark.createDataFrame([(0, "a", "A", "granite is hard"), (1, "b", "B", "chalk is soft")], DOC)
    found = Index.of(docs).write(str(tmp_path / "i"))
    asked = spark.createDataFrame([(0, "granite"), (0, "chalk"), (None, "granite"), (None, "chalk"), (None, "nothing")], "qid long, question string")
    got = {(r["qid"], r["question"]): [c["snippet"] for c in r["chunks"]] for r in A.answer(asked, found, Retrieval()).collect()}
    hard, soft = ["granite is hard"], ["chalk is soft"]
    assert got == {(0, "granite"): hard, (0, "chalk"): soft, (None, "granite"): hard, (None, "chalk"): soft, (None, "nothing"): []}
    counts = sorted(r["chunks"] for r in retrieve.gathered(asked, found, 3).collect())
    assert counts == [0, 1, 1, 1, 1]


def test_evidence_reads_the_chunks_of_its_documents(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"d{i}", "t", f"granite{i} is hard") for i in range(50)], DOC)
    found = Index.of(docs).write(str(tmp_path / "i"))
    asked = spark.createDataFrame([(0, "granite7")], "qid long, question string")
    hits = retrieve.written(retrieve.top_k(asked, found, 1))
    assert retrieve.named_documents(hits) == [7]
    own = retrieve.evidence(hits, found, [7])
    assert [r["snippet"] for r in own.collect()] == ["granite7 is hard"]
    assert "EqualTo(doc_ord,7)" in own._jdf.queryExecution().executedPlan().toString()


def test_the_engine_adds_to_its_index(spark, tmp_path, monkeypatch):
    built = []
    plain = Index.write
    monkeypatch.setattr(Index, "write", lambda self, path: built.append(path) or plain(self, path))
    monkeypatch.setattr(index, "MOST_FOLDERS", 3)
    engine = Engine(spark, str(tmp_path / "engine"))
    ids = [engine.ingest_text(f"t{i}", f"stone{i} is a rock")["id"] for i in range(2)]
    assert engine.ask("stone1")["chunks"][0]["title"] == "t1" and len(built) == 1
    for i in range(2, 6):
        ids.append(engine.ingest_text(f"t{i}", f"stone{i} is a rock")["id"])
        assert engine.ask(f"stone{i}")["chunks"][0]["id"] == f"{ids[i]}-{i}"
    engine.delete_document(ids[0])
    got = engine.ask("stone1")
    assert got["chunks"][0]["id"] == f"{ids[1]}-0" and len(built) <= 3
    steps = {s["name"]: s for s in got["steps"]}
    details = json.loads(steps["retrieval"]["details"])
    assert details["sub_queries"] == [{"query": "stone1", "top_k": 5, "chunks_found": 1, "duration_ms": steps["retrieval"]["duration_ms"]}]
    assert details["total_chunks"] == 1 and details["index_ms"] >= 0
    assert steps["planning"]["duration_ms"] < details["index_ms"] + steps["retrieval"]["duration_ms"]
    gone = engine.expire(0)
    assert gone["staged"] > 0 and gone["answers"] > 0 and gone["index"] > 0
    assert engine.ask("stone5")["chunks"][0]["title"] == "t5" and engine.list_documents().count() == 5


# --- store -----------------------------------------------------------------------------


def test_one_document_is_read_from_one_bucket(spark, tmp_path):
    docs = store.DocumentStore(spark, str(tmp_path / "docs"), buckets=8)
    docs.upsert(spark.createDataFrame([(f"d{i}", "t", "x", {}, i) for i in range(200)], STORED))
    docs.compact()
    docs.upsert(spark.createDataFrame([("d7", "new", "y", {}, 0)], STORED))
    found = docs.get("d7")
    assert [r["title"] for r in found.collect()] == ["new"]
    state = docs.state()
    read = docs.read(state, [docs.bucket_of(state, "d7")])
    folders = {f.split("bucket=")[1].split("/")[0] for f in found.inputFiles()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and read.count() < 60
    assert {docs.bucket_of(state, f"d{i}") for i in range(200)} == set(range(8)) and folders
    assert all(r["b"] == docs.bucket_of(state, r["id"]) for r in docs.read().select("id", docs.bucket(state, F.col("id")).alias("b")).collect())


def test_expiry_bounds_what_is_kept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "COMPACT_AFTER", 3)
    docs = store.DocumentStore(spark, str(tmp_path / "docs"), buckets=2)
    for i in range(8):
        docs.upsert(spark.createDataFrame([(f"d{i % 3}", f"t{i}", "x", {}, 0)], STORED))
    before = sorted(tuple(r) for r in docs.list().select("id", "title", "doc_ord").collect())
    with docs.lease() as state:
        docs.upsert(spark.createDataFrame([("d0", "later", "x", {}, 0)], STORED))
        docs.compact()
        docs.expire(3600)
        assert sorted(tuple(r) for r in docs.read(state).select("id", "title", "doc_ord").collect()) == before
    assert docs.expire(0)
    folders = [e.name for e in docs.files.entries(f"{tmp_path}/docs/data")]
    assert len(folders) <= 2 and len([e for e in docs.files.entries(f"{tmp_path}/docs/versions") if e.name.startswith("part-")]) == 1
    assert docs.get("d0").first()["title"] == "later" and docs.changed_ids(0) is None
    version = docs.upsert(spark.createDataFrame([("d9", "t", "x", {}, 0)], STORED))
    assert [r["id"] for r in docs.changed_ids(version - 1).collect()] == ["d9"]
    assert [r["id"] for r in docs.list().collect()][-1] == "d9" and docs.list().count() == 4


def test_a_late_release_leaves_other_claims(spark, tmp_path):
    docs = store.DocumentStore(spark, str(tmp_path / "docs"), patience=0.3)
    docs.upsert(spark.createDataFrame([("a", "t", "x", {}, 0)], STORED))
    claimed = docs.begin()
    docs.release(claimed - 1)  # a writer whose version is published already
    with pytest.raises(store.StoreBusyError):
        docs.begin()
    docs.release(claimed)
    assert docs.begin() == claimed


def test_traces_of_a_day(spark, tmp_path):
    traces = store.TraceStore(spark, str(tmp_path / "traces"))
    assert traces.list().count() == 0
    start = datetime(2024, 5, 1, 12)
    for n in range(12):
        row = [(f"t{n}", start + timedelta(hours=10 * n), None, "p", "a", {}, [])]
        traces.record(spark.createDataFrame(row, store.TRACE).coalesce(1))
    span = traces.read(datetime(2024, 5, 2), datetime(2024, 5, 3))
    assert sorted(r["id"] for r in span.collect()) == ["t2", "t3"]
    plan = span._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    # Days are dates in the session's time zone, and a day's files become one.
    assert traces.tidy(most=2) == ["2024-05-03", "2024-05-05"] or len(traces.tidy(most=1)) >= 1
    assert [r["id"] for r in traces.list().collect()] == [f"t{n}" for n in range(12)]
    assert traces.expire(datetime(2024, 5, 3)) == ["2024-05-01", "2024-05-02"]
    assert traces.list().first()["id"] == "t4"


# --- queue and answers -----------------------------------------------------------------


def test_the_queue_shows_each_file(spark, tmp_path):
    from quarry.streaming.ingest import ingest_stream

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("granite is hard")
    (folder / "b.docx").write_bytes(b"not a zip archive")
    engine = Engine(spark, str(tmp_path / "engine"))
    ingest_stream(engine, str(folder), str(tmp_path / "progress"), once=True, strict=True).awaitTermination()
    table = {r["path"].split("/")[-1]: r for r in engine.queue.table().where("path IS NOT NULL").collect()}
    assert table["a.txt"]["state"] == "done" and table["b.docx"]["state"] == "error" and "BadZipFile" in table["b.docx"]["error"]
    assert {r["state"] for r in engine.queue.events().collect()} == {"pending", "running", "done", "error"}
    assert [r["title"] for r in engine.list_documents().collect()] == ["a"]
    # A batch that is run again is left alone, and a failed file comes again without the other.
    version, events = engine.documents.version(), engine.queue.events().count()
    engine.ingest_batch(spark.read.format("binaryFile").load(str(folder)).select("path", "content"), 0, strict=True)
    assert engine.documents.version() == version and engine.queue.events().count() == events
    assert engine.retry_failed() == 1 and engine.retry_failed() == 0
    assert sorted(r["title"] for r in engine.list_documents().collect()) == ["a", "b"]


class Counting:
    """A model that notes each call in a folder, and refuses at some questions the first time."""

    def __init__(self, folder):
        self.folder = folder

    def chat(self, messages):
        question = messages[-1]["content"].split("Question: ")[1]
        with open(f"{self.folder}/{question}", "a") as file:
            file.write("x")
        if question == "bad" and os.path.getsize(f"{self.folder}/bad") == 1:
            raise generate.ProviderError("no luck")
        return f"{question}, by {threading.current_thread().name.split('_')[0]}"


def test_a_finished_call_is_not_made_again(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    rows = spark.createDataFrame([(f"q{i}", "c") for i in range(20)] + [("bad", "c")], "question string, context string").repartition(3)
    model = Counting(str(tmp_path / "calls"))
    ask = lambda: {r["question"]: (r["answer"], r["status"]) for r in generate.generated(rows, model, f"file://{tmp_path}/log").collect()}
    first = ask()
    assert first["bad"] == ("Provider error: no luck", "error") and first["q3"][1] == "completed" and "ThreadPool" in first["q3"][0]
    again = ask()
    assert again["bad"][1] == "completed" and {k: v for k, v in again.items() if k != "bad"} == {k: v for k, v in first.items() if k != "bad"}
    assert {f.name: len(f.read_text()) for f in (tmp_path / "calls").iterdir()} == {f"q{i}": 1 for i in range(20)} | {"bad": 2}


@pytest.mark.parametrize("many_terms", [0, 1000])
def test_many_questions_pass_all_cells(spark, tmp_path, monkeypatch, small_blocks, many_terms):
    """Questions that are sent to cells of blocks get what the plain model gives, after a change too, and no pair of block and question is sent."""
    for name, value in {"FEW_QUESTIONS": 0, "CELL": 3, "TILE": 16, "TILE_GROUPS": 4, "OUTER": 4, "MANY_TERMS": many_terms, "GROUP": 5}.items():
        monkeypatch.setattr(retrieve, name, value)
    monkeypatch.setattr(retrieve, "compared", None)
    own = random.Random(21)
    words = [f"w{i}" for i in range(80)] + ["common"] * 9
    docs = {i: (f"d{i}", "t", prose(own, own.randint(1, 6), words)) for i in range(60)}
    frame = lambda rows: spark.createDataFrame([(i, *d) for i, d in sorted(rows.items())], DOC)
    now = Index.of(frame(docs)).write(str(tmp_path / "v0"))
    asked = spark.createDataFrame([(i, " ".join(own.choices(words, k=own.randint(1, 9))), own.choice([0, 1, 3, 7, 40])) for i in range(23)] + [(23, " ", 3), (24, "unknown", 3), (25, None, 2)], "qid long, question string, k int")
    for step in range(2):
        model = {}
        for r in retrieve.cosine_scores(asked, now).collect():
            model.setdefault(r["qid"], []).append((r["score"], r["chunk_idx"]))
        expected = sorted((q["qid"], rank, c, s) for q in asked.collect() for rank, (s, c) in enumerate(sorted(model.get(q["qid"], []), reverse=True)[: q["k"]], 1))
        assert hits(asked, now, F.col("k")) == expected and len(expected) > 100
        fresh = {60 + step: ("d3", "t", "common w1 w2"), 70 + step: ("d71", "t", prose(own, 2, words))}
        now = now.changed(str(tmp_path / f"v{step + 1}"), spark.createDataFrame([("d3",), ("d5",), ("d71",)], "id string"), frame(fresh))

"""The engine's two main flows, its stores, and the edge cases it decides."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.engine import Engine
from quarry.operators import generate
from quarry.sources import files, store
from quarry.sources.config import Config, Profile, Provider, Retrieval
from quarry.streaming.ingest import ingest_stream

SENTENCE = "Granite is an igneous rock that forms deep underground."


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "engine"))


class Echo:
    def chat(self, messages):
        if "fail" in messages[1]["content"]:
            raise generate.ProviderError("no luck")
        return "echo: " + messages[1]["content"].split("Question: ")[1]


def test_config_round_trip(engine):
    assert engine.config() == Config()
    own = Config(profile="Smoke", provider=Provider("cloud", "http://x/"), provider_profiles=(Profile("a", Provider("lm", "http://y")),))
    engine.update_config(own)
    assert engine.config() == own
    assert engine.update_config(own, "a").provider.name == "lm"
    with pytest.raises(KeyError):
        engine.update_config(own, "b")
    assert engine.apply_preset("FAST").retrieval.dense_k == 3
    with pytest.raises(KeyError):
        engine.apply_preset("unknown")
    assert engine.presets().count() == 3
    with pytest.raises(ValueError):
        Retrieval(dense_k=-1)
    assert own.with_saved_profile("b").provider_profiles[-1].name == "b"


def test_ingest_ask_evaluate_delete(engine):
    done = engine.ingest_text("rocks", SENTENCE)
    assert done["chunk_count"] == 1
    assert engine.list_documents().count() == 1
    got = engine.ask("What is granite?")
    assert got["answer"].endswith(SENTENCE) and got["chunks"][0]["id"] == f"{done['id']}-0"
    assert got["metrics"]["coverage"] == pytest.approx(0.2) and got["metrics"]["tokens"] == 9
    assert [s["name"] for s in got["steps"]] == ["planning", "retrieval", "generation"]
    run = engine.evaluate("smoke", ["What is granite?", "the of"])
    assert len(run["responses"]) == 2 and run["average_coverage"] == pytest.approx(0.1) and run["average_tokens"] == 4.5
    assert engine.traces().count() == 3 and engine.monitoring_traces().where(F.size("steps") > 0).count() == 0
    with pytest.raises(ValueError):
        engine.ask("  ")
    with pytest.raises(ValueError):
        engine.evaluate("none", [])
    engine.delete_document(done["id"])
    with pytest.raises(KeyError):
        engine.delete_document(done["id"])
    assert engine.ask("What is granite?")["answer"] == "No documents ingested yet."


def test_stop_word_corpus_gives_no_results(engine):
    engine.ingest_text("empty", "")
    engine.ingest_text("stop", "the of and")
    assert engine.ask("granite the")["chunks"] == []


def test_provider_answers_and_errors(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "e"), provider=Echo())
    engine.ingest_text("rocks", SENTENCE)
    assert engine.ask("granite?")["answer"] == "echo: granite?"
    got = engine.ask("granite fail")
    assert got["answer"] == "Provider error: no luck" and got["status"] == "error"


def docx(paragraphs):
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f"<w:document {space}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    own = tmp_path / "files"
    own.mkdir()
    (own / "a.txt").write_bytes(b"plain ab\xffcd\xe2\x82")
    (own / "b.MD").write_text("# Title\n\n* item `x` > y\n\na - b")
    (own / "c.docx").write_bytes(docx(["first", "second"]))
    (own / "d.docx").write_bytes(b"not a zip archive")
    (own / "e.pdf").write_bytes(b"%PDF broken")
    (own / "f.bin").write_bytes(b"other kind")
    (own / "g.txt").write_text("genuine � stays")
    return own


def test_extractors(spark, folder):
    found = {r["name"]: r for r in files.extracted(files.read_files(spark, str(folder), all_kinds=True)).collect()}
    assert found["a.txt"]["text"] == "plain abcd"
    assert found["b.MD"]["text"] == " Title\n\n item x  y\n\na b"
    assert found["c.docx"]["text"] == "first\n\nsecond" and found["c.docx"]["status"] == "ok"
    assert found["d.docx"]["text"] == "not a zip archive" and found["d.docx"]["status"].startswith("fallback")
    assert found["e.pdf"]["text"] == "%PDF broken"
    assert found["f.bin"]["text"] == "other kind"
    assert found["g.txt"]["text"] == "genuine � stays"
    assert files.read_files(spark, str(folder)).count() == 6


def test_ingest_files_and_stream(spark, engine, folder, tmp_path):
    rows = engine.ingest_files(str(folder))
    assert rows.count() == 6 and engine.documents.version() == 1
    meta = engine.list_documents().where("title = 'a'").first()["metadata"]
    assert meta["filename"] == "a.txt" and meta["filesize"] == "13" and meta["content_type"] == "text/plain" and "uploaded_at" in meta
    stream = Engine(spark, str(tmp_path / "streamed"))
    for _ in range(2):
        ingest_stream(stream, str(folder), str(tmp_path / "progress"), once=True).awaitTermination()
    assert stream.list_documents().count() == 7


def test_store_keeps_places(spark, tmp_path):
    docs = store.DocumentStore(spark, str(tmp_path / "docs"))
    assert docs.list().count() == 0 and not docs.delete("a")
    schema = "id string, title string, text string, metadata map<string,string>, nth long"
    docs.upsert(spark.createDataFrame([("a", "A", "1", {}, 0), ("b", "B", "2", {}, 1)], schema))
    docs.upsert(spark.createDataFrame([("c", "C", "3", {}, 0), ("a", "A2", "4", {}, 1)], schema))
    assert [(r["id"], r["title"]) for r in docs.list().collect()] == [("a", "A2"), ("b", "B"), ("c", "C")]
    assert docs.get("b").first()["text"] == "2" and docs.delete("b") and docs.list().count() == 2
    # Of ids that repeat in a change the last counts.
    docs.upsert(spark.createDataFrame([("d", "D", "5", {}, 0), ("d", "D2", "6", {}, 1), ("b", "B2", "7", {}, 2)], schema))
    assert [(r["id"], r["title"]) for r in docs.list().collect()] == [("a", "A2"), ("c", "C"), ("d", "D2"), ("b", "B2")]


def test_store_writes_changes_and_compacts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "COMPACT_AFTER", 3)
    docs = store.DocumentStore(spark, str(tmp_path / "docs"), patience=0.5)
    schema = "id string, title string, text string, metadata map<string,string>, nth long"
    for i in range(7):
        docs.upsert(spark.createDataFrame([(f"d{i}", f"t{i}", "x", {}, 0), ("same", f"t{i}", "y", {}, 1)], schema))
    state = docs.state()
    assert state.whole and all(len(own) < 3 for own in state.changes.values())
    assert [r["title"] for r in docs.list().collect()] == ["t0", "t6", *(f"t{i}" for i in range(1, 7))]
    # A change holds its own rows alone.
    assert spark.read.parquet(docs.folder(1)).count() == 2


def test_store_writers_take_turns(spark, tmp_path):
    schema = "id string, title string, text string, metadata map<string,string>, nth long"
    one, other = (store.DocumentStore(spark, str(tmp_path / "docs"), patience=0.5) for _ in range(2))
    rows = spark.createDataFrame([("a", "A", "1", {}, 0)], schema)
    one.begin()
    with pytest.raises(store.StoreBusyError):
        other.upsert(rows)
    one.release()
    assert other.upsert(rows) == 1
    with pytest.raises(Exception):
        other.upsert(rows.select("nth"))
    assert one.delete("a") and one.list().count() == 0


def test_json_sources(spark, tmp_path):
    path = tmp_path / "documents.json"
    path.write_text(
        '[{"id":"a","title":"A","text":"1","metadata":{"k":"v"}},{"id":"b","title":"B","text":"2","metadata":{}},{"id":"a","title":"A2","text":"3","metadata":{}}]'
    )
    rows = store.read_documents_json(spark, str(path)).orderBy("doc_ord").collect()
    assert [(r["id"], r["title"], r["text"]) for r in rows] == [("a", "A2", "3"), ("b", "B", "2")]
    path = tmp_path / "traces.json"
    path.write_text('[{"id":"t","started_at":"2024-01-02T03:04:05","prompt":"p","answer":"a","steps":[{"name":"planning"}]},{"id":"u"}]')
    rows = {r["id"]: r for r in store.read_traces_json(spark, str(path)).collect()}
    assert rows["t"]["steps"][0]["status"] == "completed" and rows["t"]["steps"][0]["duration_ms"] == 0.0
    assert rows["u"]["steps"] == [] and rows["u"]["metrics"] == {}


# --- providers -------------------------------------------------------------------------


def test_clients_speak_each_protocol():
    seen = []

    def fake(url, payload=None, key=None, timeout=0, label=""):
        seen.append((url, payload, key))
        return {"message": {"content": "m"}, "response": "r", "choices": [{"message": {"content": "c"}, "text": "t"}]}

    def client(name, **own):
        c = generate.Client.of(Provider(name, "http://host/", **own), api_key="fallback")
        return generate.Client(c.kind, c.base_url, c.model, c.api_key, fake)

    local = client("My Ollama", planner_model="p", generator_model="g")
    assert (local.chat([]), local.complete("x")) == ("m", "r") and seen[-1][1]["model"] == "p"
    studio = client("vllm")
    assert (studio.chat([]), studio.complete("x")) == ("c", "t") and seen[-1][1]["model"] == "gpt-3.5-turbo-instruct"
    cloud = client("cloud", api_key="own")
    assert cloud.chat([]) == "c" and seen[-1] == ("http://host/v1/chat/completions", {"model": "gpt-4o-mini", "messages": []}, "own")
    assert client("cloud").api_key == "fallback"
    none = generate.Client("openai", "http://h", None, None, lambda *a: {"choices": []})
    assert none.chat([]) == none.complete("") == ""


def test_discovery_and_probes(spark):
    pages = {
        "/api/tags": {"models": [{"name": "a"}, {"name": ""}]}, "/api/ps": {"models": [{"model": "a"}]}, "/api/version": {"version": "1"},
        "/v1/models": {"data": [{"id": "m"}, {"id": ""}]},
    }

    def get(url, *_):
        path = "/" + url.split("/", 3)[3]
        if path not in pages:
            raise generate.ProviderError("down")
        return pages[path]

    assert generate.discover_models(Provider("ollama", "http://h/"), get) == ["a"]
    assert generate.discover_models(Provider("cloud", "http://h"), get) == ["m"]
    rows = {r["kind"]: r for r in generate.local_providers(spark, get=get).collect()}
    assert (rows["ollama"]["status"], rows["ollama"]["running"], rows["ollama"]["version"]) == ("ok", ["a"], "1")
    assert rows["lmstudio"]["status"] == "error" and rows["lmstudio"]["models"] == [] and "down" in rows["lmstudio"]["error_message"]


def test_unreachable_server_is_a_provider_error():
    with pytest.raises(generate.ProviderError, match="Cloud provider request failed"):
        generate.Client("openai", "http://127.0.0.1:9").chat([])
    with pytest.raises(generate.ProviderError, match="^Provider request failed"):
        generate.Client("ollama", "http://127.0.0.1:9").complete("x")

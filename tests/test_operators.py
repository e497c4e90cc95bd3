"""Expressions and operators against plain Python models."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.stopwords import STOP_WORDS
from quarry.operators import answer as A
from quarry.operators import chunking, retrieve
from quarry.operators.index import Index
from quarry.plans import catalog
from quarry.sources.config import Retrieval

SPACES = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())


def column(spark, values, expression):
    rows = spark.createDataFrame(list(enumerate(values)), "i long, x string").select("i", expression(F.col("x")).alias("y"))
    return [r["y"] for r in rows.orderBy("i").collect()]


def model_chunks(text, target=800, ingest=True):
    own = text.replace("\r", "") if ingest else text
    out, held, size = [], [], 0
    for p in filter(None, (x.strip() for x in own.split("\n\n"))):
        if held and size + len(p) > target:
            out.append("\n".join(held))
            held, size = [], 0
        held.append(p)
        size += len(p)
    if held:
        out.append("\n".join(held))
    return out or [text.strip() if ingest else text]


TEXTS = [
    "", "   ", SPACES, f"{SPACES}a b{SPACES}", "one", "a" * 801, "x" * 400 + "\n\n" + "y" * 400, "x" * 400 + "\n\n" + "y" * 401,
    "a\r\n\r\nb", "p\n\n\n\nq\n\n \n\nr", "s\n\n" + "long " * 300 + "\n\nt", "\n\n".join("w" * n for n in range(1, 90)),
]


def test_strip_and_word_count(spark):
    assert column(spark, TEXTS, T.strip) == [t.strip() for t in TEXTS]
    assert column(spark, TEXTS, T.word_count) == [len(t.split()) for t in TEXTS]


@pytest.mark.parametrize("ingest", [True, False])
def test_chunks(spark, ingest):
    got = column(spark, TEXTS, lambda x: chunking.chunks_of(x, ingest=ingest))
    assert got == [model_chunks(t, ingest=ingest) for t in TEXTS]


def test_rechunking_changes_nothing(spark):
    own = random.Random(5)
    texts = ["\n\n".join("z" * own.randint(1, 500) for _ in range(own.randint(1, 30))) for _ in range(60)]
    stored = column(spark, texts, lambda x: chunking.canonical(chunking.chunks_of(x)))
    assert column(spark, stored, lambda x: chunking.chunks_of(x, ingest=False)) == [model_chunks(t) for t in texts]


def test_names_and_numbers(spark):
    names = ["A.PDF", "x.tar.gz", ".md", "noext", "a.", "d/b.Md"]
    assert column(spark, names, T.extension) == [".pdf", ".gz", "", "", "", ".md"]
    assert column(spark, names, T.title_from_name) == ["A", "x.tar", ".md", "noext", "a.", "d/b"]
    assert column(spark, names, T.content_type)[5] == "text/markdown"
    assert column(spark, names, T.uploadable) == [True, False, True, False, False, True]
    assert column(spark, ["nan", "inf", None, "2.5"], lambda x: T.number(x.cast("double"))) == ["0.00", "0.00", "0.00", "2.50"]
    assert column(spark, ["x", None, "2024-01-02T03:04:05"], T.date_time) == ["Unknown", "Unknown", "2024-01-02 03:04"]
    assert column(spark, ["0.126", "1"], lambda x: T.percent(x.cast("double"), 1)) == ["12.6", "100.0"]
    assert column(spark, ["a - b", "word- x", "#*`>t"], T.plain_markdown) == ["a b", "wordx", "t"]


def test_stop_words_and_tokens(spark):
    assert len(STOP_WORDS) == len(set(STOP_WORDS)) == 318
    assert column(spark, ["Don't THE été x_1 a b2"], T.tokens) == [["don", "été", "x_1", "b2"]]


def model_scores(chunks, questions):
    import regex

    words = lambda t: Counter(w for w in regex.findall(r"[\p{L}\p{N}_]{2,}", t.lower()) if w not in STOP_WORDS)
    tf = [words(c) for c in chunks]
    df = Counter(w for c in tf for w in c)
    idf = {w: math.log((1 + len(chunks)) / (1 + n)) + 1 for w, n in df.items()}

    def unit(counts):
        own = {w: n * idf[w] for w, n in counts.items() if w in idf}
        norm = math.sqrt(sum(x * x for x in own.values()))
        return {w: x / norm for w, x in own.items()}

    vectors = [unit(c) for c in tf]
    out = {}
    for q, text in questions:
        own = unit(words(text))
        for i, v in enumerate(vectors):
            score = round(sum(x * v[w] for w, x in own.items() if w in v), 9)
            if score > 0:
                out[q, i] = score
    return out


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    own = random.Random(2)
    words = [f"w{i}" for i in range(40)] + ["the", "of"]
    texts = ["\n\n".join(" ".join(own.choices(words, k=own.randint(1, 90))) for _ in range(own.randint(1, 6))) for _ in range(30)]
    texts += [texts[3], texts[3], "", "the of"]
    docs = spark.createDataFrame([(3 * i, f"d{i}", f"t{i % 7}", t) for i, t in enumerate(texts)], "doc_ord long, id string, title string, text string")
    chunks = [(f"d{i}", c) for i, t in enumerate(texts) for c in model_chunks(t, ingest=False)]
    questions = [(0, "w1 w2 unknown"), (1, "the of"), (2, "  "), (3, texts[3]), (4, "unknown"), (5, "w5 w5 w6")]
    path = str(tmp_path_factory.mktemp("index"))
    Index.of(docs).write(path)
    return docs, chunks, questions, Index.read(spark, path, docs)


def test_scores_and_ties(spark, small):
    docs, chunks, questions, index = small
    got = [(r["id"], r["chunk"]) for r in index.chunks.orderBy("chunk_idx").collect()]
    assert got == chunks and [r["chunk_idx"] for r in index.chunks.orderBy("chunk_idx").collect()] == list(range(len(chunks)))
    asked = spark.createDataFrame(questions, "qid long, question string")
    expected = model_scores([c for _, c in chunks], questions)
    scores = {(r["qid"], r["chunk_idx"]): r["score"] for r in retrieve.cosine_scores(asked, index).collect()}
    assert scores.keys() == expected.keys() and all(scores[k] == pytest.approx(expected[k], abs=2e-9) for k in scores)
    for k in (0, 1, 3, 10, 1000):
        best = defaultdict(list)
        for r in retrieve.top_k(asked, index, k).orderBy("qid", "rank").collect():
            best[r["qid"]].append(r["chunk_idx"])
        for q, _ in questions:
            own = sorted((i for p, i in scores if p == q), key=lambda i: (-scores[q, i], -i))
            assert best[q] == own[:k]
    with pytest.raises(ValueError):
        retrieve.top_k(asked, index, -1)


def test_snapshot_gives_the_same_answers(spark, small):
    docs, _, questions, again = small
    index = Index.of(docs)
    asked = spark.createDataFrame(questions, "qid long, question string")
    a, b = (A.answer(asked, i, Retrieval()).orderBy("qid").select("answer", "tokens", "coverage").collect() for i in (index, again))
    assert a == b and all(0 <= r["coverage"] <= 1 for r in a)
    assert a[1]["answer"] == a[2]["answer"] == A.NO_DOCUMENTS


def test_steps_deduplicate_and_fall_back(spark, small):
    _, _, _, index = small
    step = "array<struct<query:string,dense_k:int>>"
    rows = [(0, "w1", [("w1", 2), ("w1", 2), ("w2", 2)]), (1, "w1", [("w1", 0)]), (2, "unknown", [("unknown", 3)])]
    plan = A.planned(spark.createDataFrame(rows, f"qid long, question string, steps {step}"), Retrieval())
    hits = A.step_hits(plan, index)
    assert hits.where("qid = 0").count() == 6
    once = A.first_of_each(hits)
    chunks = [r["chunk_idx"] for r in once.where("qid = 0").orderBy("nth").collect()]
    assert len(chunks) == len(set(chunks)) <= 4
    final = A.with_fallback(plan, once, index)
    assert final.where("qid = 1").count() == 3 and final.where("qid = 2").count() == 0
    got = A.assembled(plan, final, index).orderBy("qid").collect()
    assert got[1]["coverage"] == 0.0 and got[2]["context"] == "" and got[0]["context"].count("\n\n") >= len(chunks) - 1


def test_empty_store(spark):
    docs = spark.createDataFrame([], "doc_ord long, id string, title string, text string")
    asked = spark.createDataFrame([(1, "granite")], "qid long, question string")
    got = A.answer(asked, Index.of(docs), Retrieval()).collect()
    assert [r["answer"] for r in got] == [A.NO_DOCUMENTS]


def test_plans_prune_and_limit_early(spark):
    """Only the columns needed are read, and top-k is cut before the last shuffle."""
    from quarry.plans import catalog

    plan = catalog.topk_batch(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan
    assert "lang" not in plan.split("ReadSchema")[1][:120]


def test_decimals_are_those_of_printf(spark):
    own = random.Random(9)
    values = [0.125, 0.375, 0.1234565, 0.5, 1.5, 0.0, -0.125, 1e15, 2.675, *(n * 64 / 1048576 for n in range(2048, 200_000, 4096)), *(round(own.random(), 9) for _ in range(2000)), *(n / 16 for n in range(64))]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(-1, None)], "i long, v double")
    for digits in (0, 1, 2, 6):
        got = [r["y"] for r in rows.orderBy("i").select(T.fixed(F.col("v"), digits).alias("y")).collect()]
        assert got == [None, *(f"{v:.{digits}f}" for v in values)]
    sizes = spark.createDataFrame([(2048,), (6144,)], "n long").select(T.size_mb(F.col("n") * 64).alias("mb"))
    assert [r["mb"] for r in sizes.collect()] == ["0.12", "0.38"]


def test_answer_record_shows_a_score_as_its_sql_does(spark, tmp_path, monkeypatch):
    chunks = [("7-1", "t", "s", 0.1234565), ("8-2", None, "s", 0.5), ("9-3", "u", "s", 0.25)]
    schema = "qid long, question string, answer string, status string, coverage double, tokens long, chunks array<struct<id:string,title:string,snippet:string,score:double>>"
    monkeypatch.setattr(catalog, "answers", lambda *_: spark.createDataFrame([(1, "q", "a", "completed", 1.0, 3, chunks)], schema))
    # The SQL leaves a row without a title out: its parts are joined with ||.
    assert catalog.answer_record(spark, str(tmp_path)).first()["evidence"] == "7-1 t 0.123456|9-3 u 0.250000"


def test_gathered_leaves_the_texts_where_they_lie(small, spark, monkeypatch):
    """The hits are written before the chunks are joined, so Spark sends these few rows and not the texts."""
    docs = small[0]
    asked, told, own = spark.createDataFrame([(1, "w3 w4"), (2, "w5"), (3, " "), (4, "w7 w8 w9")], "qid long, question string"), [], retrieve.evidence

    def evidence(hits, index, documents=None):
        told.append((hits._jdf.queryExecution().optimizedPlan().collectLeaves().size(), documents))
        return own(hits, index, documents)

    monkeypatch.setattr(retrieve, "evidence", evidence)
    index = Index.of(docs)
    got = {r["qid"]: r["chunks"] for r in retrieve.gathered(asked, index, 5).collect()}
    assert got == {1: 5, 2: 5, 3: 0, 4: 5}
    leaves, documents = told[0]
    assert leaves == 1 and 0 < len(documents) <= 15

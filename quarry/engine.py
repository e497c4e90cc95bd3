"""The engine's verbs on one object: ingest, list, delete, ask, evaluate, configure, trace."""

from __future__ import annotations

import time
import uuid
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import title_from_name, with_defaults
from quarry.operators.answer import concluded, evaluation, planned, retrieved_for
from quarry.operators.chunking import canonical, chunks_of, numbered
from quarry.operators.generate import LOCAL, Client, discover_models, local_providers
from quarry.operators.index import MERGED_SHARE, Index
from quarry.operators.presets import preset_table
from quarry.sources.config import Config, ConfigStore
from quarry.sources.files import extracted, read_files
from quarry.sources.files_api import Files
from quarry.sources.queue import DONE, ERROR, PENDING, RUNNING, IngestQueue
from quarry.sources.store import DocumentStore, TraceStore, monitoring

NAME, VERSION = "quarry", "0.1.0"


class Engine:
    """Documents, index, configuration and traces under one folder.

    ``config_path`` is a file on the driver; everything else is read and written by
    Spark and may be in any store that it reaches.
    """

    def __init__(self, spark: SparkSession, path: str, config_path: str | None = None, provider=None, servers=LOCAL, answer_log: str | None = None):
        self.spark, self.path, self.servers = spark, path, servers
        self.documents = DocumentStore(spark, f"{path}/documents")
        self.traces_store = TraceStore(spark, f"{path}/traces")
        self.queue = IngestQueue(spark, f"{path}/queue")
        #: Address of a folder in which models' answers are kept, so that no finished call is made again.
        self.answer_log = answer_log
        self.config_store = ConfigStore(config_path or f"{path.removeprefix('file:')}/config.json")
        self.provider = provider
        self.configured = provider is not None

    # --- state -------------------------------------------------------------------

    def info(self) -> dict:
        return {"name": NAME, "status": "ok", "version": VERSION}

    def healthy(self) -> dict:
        return {"status": "ok"}

    def config(self) -> Config:
        return self.config_store.read()

    def update_config(self, config: Config, active_profile: str | None = None) -> Config:
        if active_profile:
            config = config.with_profile(active_profile)
        self.config_store.write(config)
        return config

    def presets(self) -> DataFrame:
        return preset_table(self.spark)

    def apply_preset(self, name: str) -> Config:
        return self.update_config(self.config().with_preset(name))

    def models(self, config) -> list[str]:
        return discover_models(config)

    def local_providers(self) -> DataFrame:
        """The local servers ``(kind, name, address)`` that the engine was given, with their models."""
        return local_providers(self.spark, self.servers)

    def client(self):
        """The provider given to the engine, else the configured one, else none."""
        if self.configured:
            return self.provider
        own = self.config().provider
        return None if own is None else Client.of(own)

    # --- documents ---------------------------------------------------------------

    def list_documents(self) -> DataFrame:
        return self.documents.list()

    def get_document(self, doc_id: str) -> DataFrame:
        return self.documents.get(doc_id)

    def delete_document(self, doc_id: str) -> None:
        if not self.documents.delete(doc_id):
            raise KeyError(f"no document {doc_id!r}")

    def ingest_table(self, rows: DataFrame) -> DataFrame:
        """Chunk and store ``rows(id, title, text, metadata, nth)``; id, title and chunk_count of each."""
        chunked = rows.withColumn("chunks", chunks_of(F.coalesce("text", F.lit(""))))
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        columns = ("id", "title", canonical(F.col("chunks")).alias("text"), "metadata", "nth", F.size("chunks").alias("chunk_count"))
        chunked.select(*columns).write.parquet(staged)  # ids and times are fixed from here on
        ready = self.spark.read.parquet(staged)
        # Places without gaps, whatever numbers came in.
        dense = numbered(ready.select(F.col("nth").alias("doc_ord"), F.lit(1).alias("n")))
        placed = ready.select("id", "title", "text", "metadata", F.col("nth").alias("doc_ord")).join(dense, "doc_ord")
        self.documents.upsert(placed.select("id", "title", "text", "metadata", F.col("first").cast("long").alias("nth")))
        return ready.select("id", "title", F.col("chunk_count").cast("long"))

    def ingest_text(self, title: str, text: str, metadata: dict[str, str] | None = None) -> dict:
        own = {"uploaded_at": datetime.now(UTC).isoformat()} | (metadata or {})
        row = [(str(uuid.uuid4()), title, text, own, 0)]
        schema = "id string, title string, text string, metadata map<string,string>, nth long"
        return self.ingest_table(self.spark.createDataFrame(row, schema)).first().asDict()

    def ingest_file_table(self, files: DataFrame, stable_ids: bool = False) -> DataFrame:
        """Extract, chunk and store ``files(path, content)``, all with one new version of the store."""
        return self.ingest_extracted(extracted(files), stable_ids)

    def ingest_extracted(self, found: DataFrame, stable_ids: bool = False) -> DataFrame:
        now = F.lit(datetime.now(UTC).isoformat())
        doc_id = F.sha2("path", 256) if stable_ids else F.uuid()
        title = title_from_name(F.col("name"))
        given = F.create_map(F.lit("filename"), F.col("name"), F.lit("extraction"), F.col("status"))
        rows = found.select(
            doc_id.alias("id"), title.alias("title"), "text", with_defaults(given, title, F.col("content"), now).alias("metadata"), F.monotonically_increasing_id().alias("nth")
        )
        return self.ingest_table(rows)

    def ingest_batch(self, files: DataFrame, batch: int, strict: bool = False) -> None:
        """Ingest ``files(path, content)`` as a numbered batch, whose files go through the queue's states.

        A batch that came to its end before is left alone.  With ``strict``, a file that
        can't be read as its kind is an error and isn't stored; else its bytes are its text.
        """
        if self.queue.finished(batch):
            return
        named = files.select("path", F.lit(None).cast("string").alias("error"))
        self.queue.record(batch, named, PENDING)
        self.queue.record(batch, named, RUNNING)
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        extracted(files).write.parquet(staged)
        found = self.spark.read.parquet(staged)
        failed = (F.col("status") != "ok") & F.lit(strict)
        if not found.where(~failed).isEmpty():
            self.ingest_extracted(found.where(~failed), stable_ids=True)
        self.queue.record(batch, found.where(~failed).select("path", F.lit(None).cast("string").alias("error")), DONE)
        self.queue.record(batch, found.where(failed).select("path", F.col("status").alias("error")), ERROR)
        self.queue.finish(batch)

    def retry_failed(self, strict: bool = False) -> int:
        """Ingest the files whose last state is ``error`` again, without the others; how many there were."""
        failed = [r["path"] for r in self.queue.table().where(F.col("state") == ERROR).select("path").collect()]
        if failed:
            files = self.spark.read.format("binaryFile").load(failed).select("path", "content")
            self.ingest_batch(files, self.queue.next_batch(), strict)
        return len(failed)

    def expire(self, age: float) -> dict[str, int]:
        """Remove what is older than ``age`` seconds and of no more use: versions, index folders, staged data; how many of each."""
        files, gone = Files(self.spark), {"versions": len(self.documents.expire(age))}
        for name in ("staged", "answers"):
            old = [e for e in files.entries(f"{self.path}/{name}") if e.age > age]
            gone[name] = sum(files.remove(e.path) for e in old)
        versions = [e for e in files.entries(f"{self.path}/index") if files.exists(f"{e.path}/parts/_SUCCESS")]
        if versions:
            last = Index.read(self.spark, versions[-1].path)
            used = {p.folder.rstrip("/").split("/")[-1] for p in last.parts}
            gone["index"] = 0
            for version in files.entries(f"{self.path}/index"):
                for entry in files.entries(version.path):
                    kept = entry.name in used or version.path == versions[-1].path
                    if not kept and entry.age > age:
                        gone["index"] += files.remove(entry.path)
        return gone

    def ingest_files(self, path: str, all_kinds: bool = False) -> DataFrame:
        return self.ingest_file_table(read_files(self.spark, path, all_kinds))

    # --- questions ---------------------------------------------------------------

    def index(self) -> Index:
        """The index of the current documents, brought up to date on first use after a change.

        It is the last version's, with what changed since; all of it is built only when there
        is none, when the changes since aren't kept, or when they have become a good part of it.
        """
        files, state = Files(self.spark), self.documents.state()
        path = f"{self.path}/index/v{state.version:08d}"
        if files.exists(f"{path}/parts/_SUCCESS"):
            return Index.read(self.spark, path)
        docs = self.documents.read(state)
        before = [e for e in files.entries(f"{self.path}/index") if files.exists(f"{e.path}/parts/_SUCCESS")]
        known = Index.read(self.spark, before[-1].path) if before else None
        changed = self.documents.changed_ids(int(before[-1].name.removeprefix("v"))) if before else None
        if known is None or changed is None or not known.n:
            return Index.of(docs).write(path)
        if known.due and known.share_changed() > MERGED_SHARE:
            return Index.of(docs).write(path)
        if known.due:
            known, changed = known.base, known.changed_ids().unionByName(changed).distinct()
        return known.changed(path, changed, docs.join(changed, "id", "left_semi"))

    def ask_all(self, questions: DataFrame) -> DataFrame:
        """Answers to ``questions(qid, question)``, each recorded as a trace.

        All questions go through each step together, so the times of a step are the
        batch's.  What a step gives is written out once and read by the next.  Bringing
        the index up to date is no step; its time is a detail of retrieval.
        """
        config = self.config()
        staged = f"{self.path}/answers/{uuid.uuid4().hex}"
        clock = [time.perf_counter()]
        provider, index = self.client(), self.index()
        index_ms = round((time.perf_counter() - clock[0]) * 1000, 2)
        clock, began = [time.perf_counter()], datetime.now(UTC)
        plan = planned(questions, config.retrieval)
        clock.append(time.perf_counter())
        retrieved_for(plan, index).withColumn("trace_id", F.uuid()).write.parquet(f"{staged}/retrieved")
        clock.append(time.perf_counter())
        concluded(self.spark.read.parquet(f"{staged}/retrieved"), provider, self.answer_log).write.parquet(f"{staged}/answered")
        clock.append(time.perf_counter())
        ready = self.spark.read.parquet(f"{staged}/answered")
        spent = [round((b - a) * 1000, 2) for a, b in zip(clock, clock[1:], strict=False)]
        metrics = F.create_map(
            F.lit("chunks"), F.col("n_chunks").cast("double"), F.lit("coverage"), F.col("coverage"),
            F.lit("tokens"), F.col("tokens").cast("double"), F.lit("duration_ms"), F.lit(round(sum(spent), 2)),
        )
        failed = F.col("status") == "error"
        if provider is None:
            generation = F.struct(F.lit("none").alias("provider"), F.lit(True).alias("fallback"))
        else:
            generation = F.struct(
                F.lit(getattr(provider, "base_url", "unknown")).alias("provider"), F.lit(getattr(provider, "model", "unknown")).alias("model"),
                F.col("tokens").alias("context_tokens"), F.when(failed, "error").otherwise("success").alias("status"), F.when(failed, F.col("answer")).alias("error"),
            )
        # The steps of all questions are searched together.
        sub_queries = F.transform("sub_queries", lambda x: x.withField("duration_ms", F.lit(spent[1])))
        # Names of steps, details and metrics.
        details = {
            "planning": F.to_json(F.struct(F.lit(1).alias("num_steps"), F.lit(config.retrieval.target_tokens).alias("target_tokens"), F.lit(config.retrieval.coverage_target).alias("coverage_target"), F.array("question").alias("queries"))),
            "retrieval": F.to_json(F.struct(sub_queries.alias("sub_queries"), F.col("n_chunks").alias("total_chunks"), "unique_sources", F.lit(index_ms).alias("index_ms"))),
            "generation": F.to_json(generation),
        }
        times = [began + timedelta(seconds=x - clock[0]) for x in clock]
        steps = F.array(
            *(
                F.struct(
                    F.lit(name).alias("name"), F.lit(times[i]).alias("started_at"), F.lit(times[i + 1]).alias("completed_at"),
                    F.lit(spent[i]).alias("duration_ms"), own.alias("details"), (F.col("status") if name == "generation" else F.lit("completed")).alias("status"),
                )
                for i, (name, own) in enumerate(details.items())
            )
        )
        began, ended = F.lit(began), F.lit(times[-1])
        done = ready.select(
            "qid", "question", "answer", "chunks", "trace_id", metrics.alias("metrics"), steps.alias("steps"), "coverage", "tokens", "status"
        )
        self.traces_store.record(
            done.select(F.col("trace_id").alias("id"), began.alias("started_at"), ended.alias("completed_at"), F.col("question").alias("prompt"), "answer", "metrics", "steps")
        )
        return done

    def ask(self, question: str) -> dict:
        if not question.strip():
            raise ValueError("a question must not be blank")
        asked = self.spark.createDataFrame([(0, question)], "qid long, question string")
        return self.ask_all(asked).first().asDict(recursive=True)

    def evaluate(self, name: str, questions: list[str]) -> dict:
        if not questions:
            raise ValueError("an evaluation needs questions")
        asked = self.spark.createDataFrame(list(enumerate(questions)), "qid long, question string")
        done = self.ask_all(asked)
        means = evaluation(done).first()
        return {
            "name": name,
            "responses": [r.asDict(recursive=True) for r in done.orderBy("qid").collect()],  # as many as were asked
            "average_coverage": means["average_coverage"],
            "average_tokens": means["average_tokens"],
        }

    def traces(self) -> DataFrame:
        return self.traces_store.list()

    def monitoring_traces(self) -> DataFrame:
        return monitoring(self.traces())

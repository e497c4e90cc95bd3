"""Documents and traces in Parquet.

Documents lie in buckets by a hash of their id.  A change writes its own rows, deletions
as marked ones, and then appends its number to a small table of versions.  Readers take
each bucket's last whole copy and the changes after it; a bucket that ``COMPACT_AFTER``
changes have touched is written anew, alone.  So one document is read from one bucket,
and a change's place among the others is looked up in the buckets that it touches.

A writer that dies before its number is published leaves the last version in place, and a
query reads one version from start to end.  Writers take turns: each first creates the
claim file of its version, which only one can.  What no present version needs any more
goes with ``expire``, unless it is young or a reader holds a lease on its version.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime

import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.schemas import DOCUMENT, STORED, TRACE
from quarry.sources.files_api import Files

#: Changes of a bucket after which it is written anew.
COMPACT_AFTER = 16
#: Buckets of a new store: about one for a core's share of the documents.
BUCKETS = 32


def documents_of_json(arrays: DataFrame) -> DataFrame:
    """``id, title, text, metadata, doc_ord`` of JSON arrays ``(value)``; of equal ids in an array the last wins, in the first one's place."""
    schema = f"array<struct<{DOCUMENT.replace(' string', ':string').replace(' map', ':map')}>>"
    rows = arrays.select(F.posexplode(F.from_json("value", schema)))
    flat = rows.select(F.col("pos").cast("long").alias("doc_ord"), "col.*")
    return flat.groupBy("id").agg(
        F.max_by(F.struct("title", "text", "metadata"), "doc_ord").alias("last"), F.min("doc_ord").alias("doc_ord")
    ).select("id", "last.*", "doc_ord")


def read_documents_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of documents, in order; of equal ids the last wins, in the first one's place."""
    return documents_of_json(spark.read.text(path, wholetext=True))


def with_trace_defaults(traces: DataFrame) -> DataFrame:
    """Missing steps and metrics are empty, missing durations 0, missing status is ``completed``."""
    steps = F.transform(
        F.coalesce("steps", F.array()),
        lambda s: s.withField("duration_ms", F.coalesce(s["duration_ms"], F.lit(0.0))).withField("status", F.coalesce(s["status"], F.lit("completed"))),
    )
    return traces.withColumns({"steps": steps, "metrics": F.coalesce("metrics", F.create_map().cast("map<string,double>"))})


def read_traces_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of traces."""
    return with_trace_defaults(spark.read.schema(TRACE).option("multiLine", True).json(path))


def changed_rows(stored: DataFrame, changed: DataFrame, last: int | None = None) -> DataFrame:
    """The changed documents at their places: their namesakes', or the end in their given order.

    ``changed`` has the columns of a document and ``nth``, its order: distinct numbers
    from 0, gaps allowed, so that no task needs to see all rows to number them.  Of
    equal ids the last counts, in the first one's place.  ``last`` is the highest place
    in use, where that is known; ``stored`` need then hold the namesakes only.
    """
    once = changed.groupBy("id").agg(F.max_by(F.struct("title", "text", "metadata"), "nth").alias("last"), F.min("nth").alias("nth"))
    end = stored.agg(F.coalesce(F.max("doc_ord"), F.lit(-1)).alias("end")) if last is None else stored.sparkSession.range(1).select(F.lit(last).alias("end"))
    places = once.join(stored.select("id", F.col("doc_ord").alias("place")), "id", "left").crossJoin(F.broadcast(end))
    return places.select("id", "last.*", F.coalesce("place", F.col("end") + 1 + F.col("nth")).alias("doc_ord"))


class StoreBusyError(RuntimeError):
    """Another writer holds the claim of the next version."""


#: A row a version; one with ``summary`` holds all that the rows up to it say.
SUMMARY = "array<struct<bucket:int,whole:long,changes:array<long>>>"
VERSION = f"version long, bucket_count int, last long, whole array<int>, touched array<int>, summary {SUMMARY}"
CHANGED = f"{STORED}, version long, deleted boolean, bucket int"
WHOLE = f"{STORED}, bucket int"


@dataclass(frozen=True)
class State:
    """What a version is made of."""

    version: int = 0
    buckets: int = BUCKETS
    #: The highest place in use.
    last: int = -1
    #: The version of each bucket's last whole copy, and of the changes to it since.
    whole: dict[int, int] = field(default_factory=dict)
    changes: dict[int, list[int]] = field(default_factory=dict)

    def needed(self) -> set[int]:
        """Versions whose folders are read."""
        return {*self.whole.values(), *(v for own in self.changes.values() for v in own)}


class DocumentStore:
    """Documents as whole buckets and changes."""

    def __init__(self, spark: SparkSession, path: str, patience: float = 60.0, buckets: int = BUCKETS):
        self.spark, self.path, self.patience, self.buckets = spark, path, patience, buckets
        self.files = Files(spark)

    # --- reading -----------------------------------------------------------------

    def state(self, at: int | None = None) -> State:
        """The current version, or an older one that hasn't expired; a row a version is read."""
        try:
            rows = self.spark.read.schema(VERSION).parquet(f"{self.path}/versions")
            rows = rows if at is None else rows.where(F.col("version") <= at)
            rows = sorted(rows.collect(), key=lambda r: (r["version"], r["summary"] is not None))
        except AnalysisException:
            rows = []
        whole: dict[int, int] = {}
        changes: dict[int, list[int]] = {}
        for r in rows:
            if r["summary"] is not None:
                whole = {x["bucket"]: x["whole"] for x in r["summary"] if x["whole"] is not None}
                changes = {x["bucket"]: list(x["changes"]) for x in r["summary"] if x["changes"]}
                continue
            for b in r["whole"]:
                whole[b] = r["version"]
                changes.pop(b, None)
            for b in r["touched"]:
                changes.setdefault(b, []).append(r["version"])
        if not rows:
            return State(buckets=self.buckets)
        return State(rows[-1]["version"], rows[-1]["bucket_count"], rows[-1]["last"], whole, changes)

    def version(self) -> int:
        return self.state().version

    def folder(self, version: int) -> str:
        return f"{self.path}/data/v={version:08d}"

    def bucket(self, state: State, doc_id: Column) -> Column:
        return F.pmod(F.xxhash64(doc_id), F.lit(state.buckets)).cast("int")

    def bucket_of(self, state: State, doc_id: str) -> int:
        """The bucket of one id, as the column has it: its hash as a signed number."""
        h = xxhash.xxh64_intdigest(doc_id.encode(), 42)
        return (h - 2**64 if h >= 2**63 else h) % state.buckets

    def read(self, state: State | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The documents, or those of some buckets, whose folders alone are read."""
        state = self.state() if state is None else state
        columns = [c.split(" ")[0] for c in STORED.split(", ")]
        wanted = lambda of: [b for b in of if buckets is None or b in buckets]
        by_version: dict[int, list[int]] = {}
        for b in wanted(state.whole):
            by_version.setdefault(state.whole[b], []).append(b)
        out = self.spark.createDataFrame([], STORED)
        for version, own in sorted(by_version.items()):
            rows = self.spark.read.schema(WHOLE).parquet(self.folder(version))
            out = out.unionByName(rows.where(F.col("bucket").isin(own)).select(*columns))
        touched = wanted(state.changes)
        if not touched:
            return out
        # A bucket has COMPACT_AFTER changes or so at most.
        folders = sorted({v for b in touched for v in state.changes[b]})
        rows = self.spark.read.schema(CHANGED).option("basePath", f"{self.path}/data").parquet(*(f"{self.folder(v)}" for v in folders))
        since = F.create_map(*(F.lit(x) for b in touched for x in (b, min(state.changes[b]))))
        rows = rows.where(F.col("bucket").isin(touched) & (F.col("version") >= since[F.col("bucket")]))
        last = rows.groupBy("id").agg(F.max_by(F.struct(*columns[1:], "deleted"), "version").alias("last")).select("id", "last.*")
        return out.join(last.select("id"), "id", "left_anti").unionByName(last.where(~F.col("deleted")).select(*columns))

    def list(self) -> DataFrame:
        return self.read().orderBy("doc_ord")

    def get(self, doc_id: str) -> DataFrame:
        """One document, from its bucket."""
        state = self.state()
        return self.read(state, [self.bucket_of(state, doc_id)]).where(F.col("id") == doc_id).limit(1)

    def changed_ids(self, since: int) -> DataFrame | None:
        """``id`` of the documents changed after a version; None if not all these changes are kept."""
        now = self.version()
        versions = self.spark.read.schema(VERSION).parquet(f"{self.path}/versions").where((F.col("version") > since) & F.col("summary").isNull()).collect() if now else []
        changes = [r["version"] for r in versions if r["touched"]]
        if len(versions) < now - since or not all(self.files.exists(f"{self.folder(v)}/_SUCCESS") for v in changes):
            return None
        if not changes:
            return self.spark.createDataFrame([], "id string")
        return self.spark.read.schema(CHANGED).option("basePath", f"{self.path}/data").parquet(*map(self.folder, changes)).select("id").distinct()

    @contextmanager
    def lease(self) -> Iterator[State]:
        """The current version, whose folders stay until the reader is done."""
        state = self.state()
        file = f"{self.path}/leases/v{state.version:08d}-{uuid.uuid4().hex}"
        self.files.create(file)
        try:
            yield state
        finally:
            self.files.remove(file)

    # --- writing -----------------------------------------------------------------

    def _claim(self, version: int) -> str:
        return f"{self.path}/claims/v{version:08d}"

    def begin(self) -> int:
        """Claim the next version, waiting for a writer that has it."""
        end = time.monotonic() + self.patience
        while True:
            version = self.version() + 1
            if self.files.create(self._claim(version)):
                return version
            if time.monotonic() >= end:
                raise StoreBusyError(f"version {version} is being written; release({version}) frees it if its writer is gone")
            time.sleep(0.2)

    def release(self, version: int | None = None) -> None:
        """Give up the claim of a version that wasn't published: for a writer that failed, or one that is known to be gone."""
        now = self.version()
        version = now + 1 if version is None else version
        if version > now:
            self.files.remove(self._claim(version))

    def _publish(self, state: State, version: int, last: int, whole: list[int], touched: list[int]) -> None:
        row = [(version, state.buckets, last, whole, touched, None)]
        self.spark.createDataFrame(row, VERSION).coalesce(1).write.mode("append").parquet(f"{self.path}/versions")

    @contextmanager
    def _turn(self) -> Iterator[tuple[int, State]]:
        """A claimed version and the state before it; the claim is given up if the version isn't published."""
        version = self.begin()
        try:
            yield version, self.state()
        except BaseException:
            self.release(version)
            raise

    def _change(self, version: int, state: State, rows: DataFrame) -> None:
        """Write documents with ``doc_ord`` and ``deleted`` as a change, and publish it."""
        own = rows.withColumns({"version": F.lit(version).cast("long"), "bucket": self.bucket(state, F.col("id"))})
        own.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(self.folder(version))
        found = self.spark.read.schema(CHANGED).parquet(self.folder(version))
        seen = found.groupBy("bucket").agg(F.max("doc_ord").alias("last")).collect()  # a row a bucket
        self._publish(state, version, max([state.last, *(r["last"] for r in seen)]), [], sorted(r["bucket"] for r in seen))

    def upsert(self, documents: DataFrame) -> int:
        """``documents`` has the document columns and ``nth``; it must not change between readings."""
        with self._turn() as (version, state):
            touched = [r["b"] for r in documents.select(self.bucket(state, F.col("id")).alias("b")).distinct().collect()]
            namesakes = self.read(state, touched).select("id", "doc_ord")
            self._change(version, state, changed_rows(namesakes, documents, state.last).withColumn("deleted", F.lit(False)))
        self._compact_due()
        return version

    def delete(self, doc_id: str) -> bool:
        """False for an unknown id, which changes nothing."""
        if self.get(doc_id).isEmpty():
            return False
        return self.delete_all(self.spark.createDataFrame([(doc_id,)], "id string")) > 0

    def delete_all(self, ids: DataFrame) -> int:
        """Delete the documents ``ids(id)``; the number of the version."""
        with self._turn() as (version, state):
            touched = [r["b"] for r in ids.select(self.bucket(state, F.col("id")).alias("b")).distinct().collect()]
            rows = self.read(state, touched).join(ids.select("id").distinct(), "id", "left_semi")
            self._change(version, state, rows.withColumn("deleted", F.lit(True)))
        self._compact_due()
        return version

    def _compact_due(self) -> None:
        state = self.state()
        due = [b for b, own in state.changes.items() if len(own) >= COMPACT_AFTER]
        if due:
            self.compact(due)

    def compact(self, buckets: list[int] | None = None) -> None:
        """Write some buckets, or all that changed, anew."""
        with self._turn() as (version, state):
            own = sorted(state.changes if buckets is None else buckets)
            rows = self.read(state, own).withColumn("bucket", self.bucket(state, F.col("id")))
            # By bucket, but a large bucket in several tasks and files.
            rows.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(self.folder(version))
            self._publish(state, version, state.last, own, [])

    def expire(self, age: float) -> list[str]:
        """Remove folders and claims that are older than ``age`` seconds and that neither the current nor a leased version needs.

        Leases count while they are younger than ``age``, so those of readers that died
        don't hold anything for ever.  Returns what it removed.
        """
        state = self.state()
        kept = {state.version, *state.needed()}
        leased = False
        for lease in self.files.entries(f"{self.path}/leases"):
            if lease.age <= age:
                leased = True
                kept |= self.state(int(lease.name.removeprefix("v").split("-")[0])).needed()
            else:
                self.files.remove(lease.path)
        gone = []
        for entry in [*self.files.entries(f"{self.path}/data"), *self.files.entries(f"{self.path}/claims")]:
            number = entry.name.lstrip("v=")
            if number.isdigit() and int(number) <= state.version and int(number) not in kept and entry.age > age:
                self.files.remove(entry.path)
                gone.append(entry.path)
        old = [e for e in self.files.entries(f"{self.path}/versions") if e.name.startswith("part-")]
        if len(old) > 1 and not leased:
            # One row says what the older rows said; those that come after the listing stay.
            with self._turn() as (version, state):
                summary = [(b, state.whole.get(b), state.changes.get(b, [])) for b in sorted({*state.whole, *state.changes})]
                row = [(state.version, state.buckets, state.last, [], [], summary)]
                self.spark.createDataFrame(row, VERSION).coalesce(1).write.mode("append").parquet(f"{self.path}/versions")
                for entry in old:
                    self.files.remove(entry.path)
                self.release(version)
        return gone


class TraceStore:
    """Traces in a folder for each day, appended.

    Each question adds small files to its day; ``tidy`` makes one file of each past day's
    many.  A reader of a span of time reads the folders of its days alone.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path, Files(spark)

    def record(self, traces: DataFrame) -> None:
        dated = traces.withColumn("day", F.to_date("started_at"))
        dated.write.mode("append").partitionBy("day").parquet(f"{self.path}/days")

    def read(self, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
        """Traces that started from ``since`` to before ``until``, from the folders of these days."""
        try:
            rows = self.spark.read.schema(f"{TRACE}, day date").parquet(f"{self.path}/days")
        except AnalysisException:
            return self.spark.createDataFrame([], TRACE)
        for limit, late in ((since, False), (until, True)):
            if limit is not None:
                at = F.lit(limit)
                rows = rows.where((F.col("day") <= F.to_date(at)) & (F.col("started_at") < at) if late else (F.col("day") >= F.to_date(at)) & (F.col("started_at") >= at))
        return rows.drop("day")

    def list(self, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
        return self.read(since, until).orderBy("started_at", "id")

    def tidy(self, most: int = 8) -> list[str]:
        """Make one file of each day's, where there are more than ``most``; the days.

        A day is written beside its folder first and then takes its place; one whose
        folder went in between is put back by the next call.
        """
        done, beside = [], f"{self.path}/tidied"
        for entry in self.files.entries(beside):
            if not self.files.exists(f"{self.path}/days/{entry.name}") and self.files.exists(f"{entry.path}/_SUCCESS"):
                self.files.move(entry.path, f"{self.path}/days/{entry.name}")
        for day in self.files.entries(f"{self.path}/days"):
            if day.name.startswith("day=") and sum(e.name.startswith("part-") for e in self.files.entries(day.path)) > most:
                self.spark.read.schema(TRACE).parquet(day.path).coalesce(1).write.mode("overwrite").parquet(f"{beside}/{day.name}")
                self.files.remove(day.path)
                self.files.move(f"{beside}/{day.name}", day.path)
                done.append(day.name.removeprefix("day="))
        return done

    def expire(self, before: datetime) -> list[str]:
        """Remove the folders of days before a date; the days."""
        old = [d for d in self.files.entries(f"{self.path}/days") if d.name.startswith("day=") and d.name.removeprefix("day=") < before.date().isoformat()]
        for day in old:
            self.files.remove(day.path)
        return [d.name.removeprefix("day=") for d in old]


def monitoring(traces: DataFrame) -> DataFrame:
    """Traces without their steps."""
    return traces.withColumn("steps", F.slice("steps", 1, 0))

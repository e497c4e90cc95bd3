r"""Phrase collocations: the runs of words that occur more often than their parts explain.

Texts are lower-cased (A-Z), split at ``[.,;:!?\x0A-\x0D]`` into pieces and these into
words ``[^\x20\x09]+``.  Everything is counted per language.  A phrase of 2 to 5 words
with ``least`` occurrences is a candidate; its score is that of the cut into two parts
that explains it best.  Candidates that a longer one contains as often are dropped.

1. Equal pieces become one with a multiplicity, within batches first.  Distinct pieces
   are dealt into groups of some megabytes by their hash, packed by group.
2. Each group counts its own runs of words, length by length, and sends them as keys of
   96 bits with counts, one packed row for each hash bucket.  A bucket's task adds the
   counts up in duckdb, out of core, tells each group which of its keys are frequent,
   and one group of each key to send its words.  A run can only be frequent if its first
   and its last words, one less, are, so beyond two words each length sends few keys.
   Of two words there are most; these are screened by shorter keys first, which let
   some pass too many, but none too few.
3. The counts of a candidate's parts come from lookup requests that are shuffled to them,
   the requests for one part counted beforehand, as some words are part of very many.

Numbers are exact: the scores' products are decimals of 38 digits.

Defined cases: null texts count as empty, a null language as ``und``; texts without words
and an empty table give no rows; ``doc_id`` isn't read, so rows that repeat one count each;
of equal scores and counts the phrase that sorts first in bytes ranks first; columns besides
lang and text are ignored.
"""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import join_groups, saved, text_of, written
from quarry.llm.substring_dedup import FACTORS, joined, sequence_hash

LEAST = 100
LONGEST = 5
RANKED = 2000
#: Memory of a task's database; beyond it, duckdb goes to its scratch folder.
MEMORY = "256MB"
#: Text of a group.
GROUP_BYTES = 8 << 20
#: Pieces or rows that a task returns at once, and bytes of keys that it takes in at once.
BATCH, TAKEN = 1 << 15, 4 << 20
#: Rows of a language that are ranked together before the last ranking, and groups of these that are then ranked as one.
RANKED_TOGETHER, MERGED = 50_000, 16

#: Ends of pieces become line feeds.
ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)

PIECES = "part long, lang string, pieces binary, copies binary"
STATE, PHRASE, TOTAL = range(3)
#: STATE: lang, words, ids, copies of each run. PHRASE: lang, words, n. TOTAL: lang, n.
STEP = "kind int, part long, lang string, words binary, ids binary, copies binary, n long"
SENT = "bucket long, part long, keys binary, counts binary"
KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
FREQUENT = "part long, keys binary, named binary"
#: Keys are screened by this many bits below those that name the bucket.
SCREEN = np.dtype("<u4")
#: A key, and one with its number of occurrences.
PAIR = np.dtype([("h1", "<u8"), ("h2", "<u4")])
NAMED = np.dtype([("h1", "<u8"), ("h2", "<u4"), ("f", "<i8")])

Key = tuple[pa.Scalar, ...]


def table_of(schema: str, rows: list[dict]) -> pa.Table:
    fields = pa.schema([(name, KINDS[kind]) for name, kind in (f.split() for f in schema.split(", "))])
    return pa.Table.from_pylist(rows, schema=fields)


# Pieces.


def distinct_pieces(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The batch's different pieces of each language, packed by group, with their copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                pieces = text.as_py().lower().translate(ENDS).split(b"\n")  # bytes: A-Z only
                found.setdefault(lang, Counter()).update(p.strip(b" \t") for p in pieces)
            for lang, counts in found.items():
                counts.pop(b"", None)
                yield from table_of(PIECES, packed_pieces(lang, counts, parts)).to_batches(BATCH)

    return run


def packed_pieces(lang: str, counts: Counter, parts: int) -> list[dict]:
    pieces, copies = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
    seed, digest = xxhash.xxh3_64_intdigest(lang.encode()), xxhash.xxh3_64_intdigest
    part = (np.fromiter((digest(p, seed) for p in pieces), np.uint64, len(pieces)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    rows = []
    for a, b in runs_between(part[order]):
        own = order[a:b]
        rows.append({"part": int(part[own[0]]), "lang": lang, "pieces": b"\n".join([pieces[i] for i in own.tolist()]), "copies": copies[own].tobytes()})
    return rows


def runs_between(values: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal values."""
    if not len(values):
        return []
    edges = np.flatnonzero(np.append(True, values[1:] != values[:-1])).tolist() + [len(values)]
    return list(zip(edges[:-1], edges[1:], strict=True))


# A group's runs of words.


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their weights."""
    if not len(keys):
        return keys, weights
    order = np.lexsort((keys["h2"], keys["h1"]))
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.append(True, (keys["h1"][1:] != keys["h1"][:-1]) | (keys["h2"][1:] != keys["h2"][:-1])))
    return keys[first], np.add.reduceat(weights, first)


def among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


class Runs:
    """Runs of words of one language in one group.

    ``words`` are the different words, ``ids`` numbers them along all runs, with -1 after
    each run, and ``copies`` has each run's multiplicity.
    """

    def __init__(self, lang: str, words: list[bytes], ids: np.ndarray, copies: np.ndarray):
        self.lang, self.words, self.ids, self.copies = lang, words, ids, copies
        seed, digest = xxhash.xxh3_64_intdigest(lang.encode()), xxhash.xxh3_128_digest
        self.hashes = np.frombuffer(b"".join(digest(w, seed) for w in words), "<u8").reshape(-1, 2)

    @classmethod
    def of_pieces(cls, lang: str, pieces: Counter) -> Runs:
        split = [p.split() for p in pieces]  # bytes: no white space but blanks and tabs is left
        words = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(split)))}
        words_and_end = {**words, None: -1}
        ids = np.fromiter(map(words_and_end.__getitem__, chain.from_iterable((*s, None) for s in split)), np.int32)
        return cls(lang, list(words), ids, np.fromiter(pieces.values(), np.int64, len(pieces)))

    def weights(self) -> np.ndarray:
        """Each place's multiplicity."""
        run = np.cumsum(self.ids < 0) - (self.ids < 0)
        return self.copies[run] if len(run) else np.zeros(0, np.int64)

    def starts(self, length: int) -> np.ndarray:
        """Places where ``length`` words of one run start."""
        n = len(self.ids) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        end = np.append(0, np.cumsum(self.ids < 0))
        return np.flatnonzero(end[length : length + n] == end[:n])

    def keys(self, start: np.ndarray, length: int) -> np.ndarray:
        """Keys of the words from each start."""
        out = np.empty(len(start), PAIR)
        if len(start):
            first, second = (self.hashes[:, k][self.ids] for k in (0, 1))
            out["h1"] = sequence_hash(first, length, FACTORS[0])[start]
            out["h2"] = sequence_hash(second, length, FACTORS[1])[start] >> np.uint64(32)
        return out

    def phrase(self, start: int, length: int) -> bytes:
        return b" ".join(self.words[i] for i in self.ids[start : start + length].tolist())

    def cut(self, start: np.ndarray, length: int) -> Runs:
        """Only the words within ``length`` from these starts, as runs of their own where words between are gone."""
        covered = np.zeros(len(self.ids) + 1, np.int64)
        covered[start] += 1
        np.add.at(covered, start + length, -1)
        own = np.cumsum(covered[:-1]) > 0
        # Starts of one run that don't overlap stay apart: a word after a gap begins a run.
        place = np.flatnonzero(own)
        gap = np.append(np.diff(place) > 1, True) if len(place) else np.zeros(0, bool)
        used, ids = np.unique(self.ids[place], return_inverse=True)
        ends = np.flatnonzero(gap)
        return Runs(
            self.lang,
            [self.words[i] for i in used],
            np.insert(ids.astype(np.int32), ends + 1, np.int32(-1)),
            self.weights()[place[ends]] if len(ends) else np.zeros(0, np.int64),
        )


def runs_of(table: pa.Table) -> Iterator[Runs]:
    """A group's pieces by language, equal ones as one."""
    found: dict[str, Counter] = {}
    for lang, pieces, copies in zip(table["lang"].to_pylist(), table["pieces"], table["copies"], strict=True):
        own = found.setdefault(lang, Counter())
        for piece, n in zip(pieces.as_py().split(b"\n"), np.frombuffer(copies.as_py(), "<i8").tolist(), strict=True):
            own[piece] += n
    while found:
        yield Runs.of_pieces(*found.popitem())


def runs_left(table: pa.Table) -> Iterator[Runs]:
    """The runs that an earlier length left to a group."""
    for row in table.to_pylist():
        yield Runs(row["lang"], row["words"].split(b"\n"), np.frombuffer(row["ids"], np.int32), np.frombuffer(row["copies"], np.int64))


def counted(runs: Iterator[Runs], length: int, screened: np.ndarray | None = None, bits: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a group's runs of ``length`` words, with counts; only of those that the screen let pass, if there is one."""
    found = []
    for r in runs:
        start = r.starts(length)
        keys, weights = r.keys(start, length), r.weights()[start]
        if screened is not None:
            hit = among(short(keys["h1"], bits), screened)
            keys, weights = keys[hit], weights[hit]
        found.append(summed(keys, weights))
    # Runs of two languages have no key in common.
    keys, counts = joined([k for k, _ in found], PAIR), joined([c for _, c in found], np.int64)
    order = np.argsort(keys["h1"], kind="stable")
    return keys[order], counts[order]


def short(h1: np.ndarray, bits: int) -> np.ndarray:
    """The highest bits: those of the bucket, and 32 more."""
    return h1 >> np.uint64(32 - bits)


def sent(part: int, bits: int, h1: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.Table:
    """A row for each hash bucket of some keys, which are ordered by h1."""
    bucket = (h1 >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h1), np.int64)
    rows = [{"bucket": int(bucket[a]), "part": part, "keys": keys[a:b].tobytes(), "counts": counts[a:b].tobytes()} for a, b in runs_between(bucket)]
    return table_of(SENT, rows)


def send_words(bits: int) -> Callable[[Key, pa.Table], pa.Table]:
    def run(key: Key, table: pa.Table) -> pa.Table:
        keys, counts = counted(runs_of(table), 1)
        return sent(key[0].as_py(), bits, keys["h1"], keys, counts)

    return run


def send_longer(bits: int, length: int) -> Callable[[Key, pa.Table], pa.Table]:
    def run(key: Key, table: pa.Table) -> pa.Table:
        keys, counts = counted(runs_left(table), length)
        return sent(key[0].as_py(), bits, keys["h1"], keys, counts)

    return run


def send_short(bits: int, length: int) -> Callable[[Key, pa.Table], pa.Table]:
    """Short keys, for the screen."""

    def run(key: Key, table: pa.Table) -> pa.Table:
        keys, counts = counted(runs_left(table), length)
        return sent(key[0].as_py(), bits, keys["h1"], short(keys["h1"], bits).astype(SCREEN), counts)

    return run


def send_screened(bits: int, length: int) -> Callable[[Key, pa.Table, pa.Table], pa.Table]:
    """Keys of which the short ones passed the screen."""

    def run(key: Key, table: pa.Table, back: pa.Table) -> pa.Table:
        keys, counts = counted(runs_left(table), length, np.sort(received(back, "keys", "<u8")), bits)
        return sent(key[0].as_py(), bits, keys["h1"], keys, counts)

    return run


def advance(length: int) -> Callable[[Key, pa.Table, pa.Table], pa.Table]:
    """The group's share of the frequent phrases of this length, and what is left for longer ones."""

    def run(key: Key, table: pa.Table, back: pa.Table) -> pa.Table:
        part, rows = key[0].as_py(), []
        known = np.sort(received(back, "keys", "<u8"))
        named = np.sort(received(back, "named", NAMED), order=["h1", "h2"])
        told = dict(zip(zip(named["h1"].tolist(), named["h2"].tolist(), strict=True), named["f"].tolist(), strict=True))
        for r in runs_of(table) if length == 1 else runs_left(table):
            start = r.starts(length)
            if length == 1:
                rows.append({"kind": TOTAL, "part": part, "lang": r.lang, "n": int(r.weights()[start].sum())})
            keys = r.keys(start, length)
            hit = among(keys["h1"], known)
            start, keys = start[hit], keys[hit]
            own = among(keys["h1"], named["h1"])
            for k, at in zip(keys[own].tolist(), start[own].tolist(), strict=True):
                if (n := told.pop(k, None)) is not None:
                    rows.append({"kind": PHRASE, "part": part, "lang": r.lang, "words": r.phrase(at, length), "n": n})
            # Where the next start is one as well, a longer run begins.
            start = start[:-1][np.diff(start) == 1] if length < LONGEST else start[:0]
            if len(start):
                left = r.cut(start, length + 1)
                rows.append({"kind": STATE, "part": part, "lang": r.lang, "words": b"\n".join(left.words), "ids": left.ids.tobytes(), "copies": left.copies.tobytes()})
        return table_of(STEP, rows)

    return run


def received(back: pa.Table, field: str, kind) -> np.ndarray:
    """What the buckets sent a group."""
    return joined([np.frombuffer(x.as_py(), kind) for x in back[field]] if len(back) else [], np.dtype(kind))


# Counts in duckdb.


@contextmanager
def database():
    """An empty database in bounded memory; its scratch folder goes when the task ends."""
    import duckdb

    with tempfile.TemporaryDirectory() as scratch:
        found = duckdb.connect(config={"memory_limit": MEMORY, "threads": 1, "temp_directory": scratch, "preserve_insertion_order": False})
        try:
            yield found
        finally:
            found.close()


def portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in portions of ``TAKEN`` bytes of keys or so, as its rows may hold any number of keys."""
    before = np.cumsum(pc.binary_length(batch.column("keys")).to_numpy(zero_copy_only=False))
    for a, b in runs_between(before // TAKEN):
        yield batch.slice(a, b - a)


def stored(db, batches: Iterator[pa.RecordBatch], kind: np.dtype, bits: int) -> None:
    """Fills the table ``sent`` with a task's keys; short ones get back the bits of their bucket."""
    db.execute("CREATE TABLE sent (part BIGINT, h1 UBIGINT, h2 UINTEGER, c BIGINT)")
    for batch in (part for whole in batches for part in portions(whole)):
        keys = [np.frombuffer(x, kind) for x in batch.column("keys").to_pylist()]
        sizes = [len(k) for k in keys]
        part, bucket = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), sizes) for c in ("part", "bucket"))
        keys = joined(keys, kind)
        if kind == PAIR:
            h1, h2 = np.ascontiguousarray(keys["h1"]), np.ascontiguousarray(keys["h2"])
        else:
            h1, h2 = bucket.astype(np.uint64) << np.uint64(32) | keys, np.zeros(len(keys), np.uint32)
        counts = joined([np.frombuffer(x, "<i8") for x in batch.column("counts").to_pylist()], np.int64)
        db.register("own", pa.table({"part": part, "h1": h1, "h2": h2, "c": counts}))
        db.execute("INSERT INTO sent SELECT part, h1, h2, c FROM own")
        db.unregister("own")


def frequent_keys(least: int, kind: np.dtype, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each group's keys in a task's buckets, those that have ``least`` occurrences in all groups.

    One group of those that have a key, any one, gets its number of occurrences with it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with database() as db:
            stored(db, batches, kind, bits)
            query = f"""
                WITH g AS (
                    SELECT h1, h2, sum(c)::BIGINT AS f, arg_min(part, hash(part, h1)) AS namer
                    FROM sent GROUP BY h1, h2 HAVING sum(c) >= {least})
                SELECT part, h1, h2, CASE WHEN part = namer THEN f ELSE 0 END AS f FROM sent JOIN g USING (h1, h2) ORDER BY part"""
            for found in db.sql(query).to_arrow_reader(BATCH):
                part, h1, h2, f = (found.column(i).to_numpy() for i in range(4))
                named = np.empty(len(part), NAMED)
                named["h1"], named["h2"], named["f"] = h1, h2, f
                rows = [{"part": int(part[a]), "keys": h1[a:b].tobytes(), "named": named[a:b][f[a:b] > 0].tobytes()} for a, b in runs_between(part)]
                yield from table_of(FREQUENT, rows).to_batches()

    return run


def phrase_counts(docs: DataFrame, least: int = LEAST, group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, DataFrame]:
    """Exact counts ``(lang, phrase, f)`` of all phrases of 1 to 5 words with ``least`` occurrences, and ``(lang, n)`` words."""
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = size // group_bytes + 1
    bits = (parts - 1).bit_length()
    groups = own.mapInArrow(distinct_pieces(parts), PIECES).groupBy("part")

    def frequent(keys: DataFrame, kind: np.dtype = PAIR) -> DataFrame:
        # A task for each bucket: dealt by its hash, some tasks would have several.
        return keys.repartitionById(1 << bits, F.col("bucket").cast("int")).mapInArrow(frequent_keys(least, kind, bits), FREQUENT).groupBy("part")

    back = frequent(groups.applyInArrow(send_words(bits), SENT))
    steps = [written(groups.cogroup(back).applyInArrow(advance(1), STEP))]
    for length in range(2, LONGEST + 1):
        left = steps[-1].where(F.col("kind") == STATE).select("part", "lang", "words", "ids", "copies").groupBy("part")
        if length == 2:
            passed = frequent(left.applyInArrow(send_short(bits, length), SENT), SCREEN)
            keys = left.cogroup(passed).applyInArrow(send_screened(bits, length), SENT)
        else:
            keys = left.applyInArrow(send_longer(bits, length), SENT)
        steps.append(written(left.cogroup(frequent(keys)).applyInArrow(advance(length), STEP)))

    phrases = steps[0]
    for more in steps[1:]:
        phrases = phrases.unionByName(more)
    counts = phrases.where(F.col("kind") == PHRASE).select("lang", F.col("words").cast("string").alias("phrase"), F.col("n").alias("f"))
    totals = steps[0].where(F.col("kind") == TOTAL).groupBy("lang").agg(F.sum("n").alias("n"))
    return counts, totals


# Scores.


def part_of(words: str, start: str, length: str) -> str:
    return f"array_join(slice({words}, {start}, {length}), ' ')"


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n and score of every candidate, at its lowest-scoring cut."""
    candidates = counts.withColumn("words", F.split("phrase", " ")).where(F.size("words") > 1).withColumnRenamed("f", "a")
    cuts = candidates.withColumn("k", F.explode(F.expr("sequence(1, size(words) - 1)")))
    sides = [F.struct(F.lit(s).alias("side"), F.expr(e).alias("part")) for s, e in (("l", part_of("words", "1", "k")), ("r", part_of("words", "k + 1", "size(words)")))]
    requests = saved(cuts.select("lang", "phrase", "a", "k", F.inline(F.array(*sides))))
    asked = requests.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("requests"))
    answers = saved(asked.join(counts.withColumnRenamed("phrase", "part"), ["lang", "part"]))
    told = join_groups(requests, answers, ["lang", "part"], "requests")
    cut = told.groupBy("lang", "phrase", "a", "k").agg(*(F.max(F.when(F.col("side") == s, F.col("f"))).alias(s) for s in "lr"))
    wide = cut.join(totals, "lang")
    score = F.expr("cast(1000 AS decimal(38, 0)) * a * n div (cast(l AS decimal(38, 0)) * r)").alias("score")
    lowest = wide.select("lang", "phrase", "a", "k", "l", "r", "n", score).groupBy("lang", "phrase", "a")
    best = lowest.agg(F.min(F.struct("score", "k", "l", "r", "n")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.n", "best.score")


def contained(counts: DataFrame) -> DataFrame:
    """The highest number of a longer candidate that contains a phrase: lang, phrase, longer."""
    words = counts.withColumn("words", F.split("phrase", " ")).where(F.size("words") > 2)
    spans = words.withColumn("length", F.explode(F.expr("sequence(2, size(words) - 1)")))
    spans = spans.withColumn("start", F.explode(F.expr("sequence(1, size(words) - length + 1)")))
    inner = spans.select("lang", F.expr(part_of("words", "start", "length")).alias("phrase"), "f")
    return inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def ranked(rows: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows of each language, with rank; ranked in shares first, as a language may have any number."""
    rows = saved(rows)
    shares = 1
    while shares * RANKED_TOGETHER < rows.count():
        shares *= MERGED
    order = F.desc("score"), F.desc("a"), F.asc("phrase")
    rows = rows.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
    while shares > 1:
        place = F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))
        rows = rows.withColumn("rank", place).where(F.col("rank") <= limit)
        shares //= MERGED
        rows = rows.withColumn("share", F.pmod("share", F.lit(shares)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return rows.withColumn("rank", place).where(F.col("rank") <= limit)


def collocations(docs: DataFrame, least: int = LEAST, limit: int = RANKED, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``limit`` collocations."""
    counts, totals = phrase_counts(docs, least, group_bytes)
    kept = scored(counts, totals).join(contained(counts), ["lang", "phrase"], "left")
    kept = kept.where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    return ranked(kept, limit).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

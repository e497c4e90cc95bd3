r"""Quality scores by voting of the nearest labelled documents in a latent space.

A text's terms are of three kinds: the 3-grams of its characters' kinds (letters,
capitals, digits, spaces, each common sign) with three measures of repetition; hashed
4-grams of its lower-cased bytes, which hold the words; and pairs of the shapes of
neighbouring words (capital or not, at the end of a sentence, a clause or neither),
which hold their order.  Terms are weighted by damped frequency and, in the first two
kinds, by rarity; each kind has unit length times its ``SHARES``.  A truncated singular
value decomposition of the labelled documents' matrix gives the latent space.  Every
document, whole, is projected into it; blocks of documents are multiplied with all
labelled vectors, and the labels of the ``NEIGHBOURS`` most similar ones are averaged by
similarity.

Labelled rows may all look like text, so nothing would tell the vote what does not.
Therefore of the rows of label 1 one in ``NOISE`` has a twin with random letters, and
another one a twin with its words in random order, both of label 0.

Only the model is fitted on a sample: at most ``SAMPLE`` labelled rows, those with the
smallest hash of their id, and their twins.  So the vectors that are broadcast have a fixed bound
(9/8 of ``SAMPLE`` x ``DIMENSIONS`` numbers, and ``TERMS`` x ``DIMENSIONS`` for the
projection).  The sample's terms are written once and read in each pass of the
decomposition; what comes to the driver is a sum over them, and at last the latent vectors.  Rows with ``crc32(doc_id) mod 4 = 2`` are held out from fitting.

Defined cases: null texts count as empty; a text without similar neighbours, as the
empty one, scores the sample's share of label 1, and 0.5 without any labels; null
labels are not used; repeated rows come back each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import SPACES, text_of, written
from quarry.llm.substring_dedup import FACTORS, Doc, docs_of, sequence_hash

SAMPLE = 4000
DIMENSIONS = 64
NEIGHBOURS = 15
#: Rows of label 1 for each twin of a kind.
NOISE = 32
#: Documents scored together.
BLOCK = 256
#: Tasks of a pass over the sample, and stretches of terms in which their sums are added up.
FIT_TASKS, STRETCHES = 8, 8
ACCEPTED = 0.7

#: Kinds of bytes: signs of their own, then lower case (and non-ASCII), capitals, digits, spaces, the rest.
SIGNS = b".,!?#*$%&|<>\n"
LOWER, UPPER, DIGIT, BLANK, OTHER = range(len(SIGNS), len(SIGNS) + 5)
KINDS = OTHER + 1
KIND = np.full(256, OTHER, np.int32)
KIND[ord("a") : ord("z") + 1] = KIND[128:] = LOWER
KIND[ord("A") : ord("Z") + 1] = UPPER
KIND[ord("0") : ord("9") + 1] = DIGIT
KIND[[9, 11, 12, 13, 32]] = BLANK
KIND[list(SIGNS)] = np.arange(len(SIGNS))

#: Shapes of words: the first a capital or not, by the last sign.
ENDS = np.zeros(256, np.int32)
ENDS[list(b".!?")], ENDS[list(b",;:")] = 1, 2
SHAPES = 6

GRAMS = KINDS**3
REPETITION = 3
HASH_BITS = 12
#: Where each kind of terms starts, and their number.
HASHED = GRAMS + REPETITION
SHAPED = HASHED + (1 << HASH_BITS)
TERMS = SHAPED + SHAPES**2
KIND_TERMS = (slice(0, HASHED), slice(HASHED, SHAPED), slice(SHAPED, TERMS))
#: Length of each kind's part of a vector.
SHARES = (0.6, 0.8, 1.2)
#: Occurrences that a wholly repetitive text counts for.
REPEATED = 20_000
#: Bytes of a text that are hashed at a time.
STRETCH = 1 << 20

SCORES = "doc_id long, score double"


def hashed_grams(text: bytes) -> np.ndarray:
    """How often each hash of a 4-gram of the lower-cased bytes occurs."""
    raw, out = np.frombuffer(text.lower(), np.uint8), np.zeros(1 << HASH_BITS, np.int64)
    for a in range(0, len(raw) - 3, STRETCH):
        b = raw[a : a + STRETCH + 3].astype(np.uint64)
        code = b[:-3] | b[1:-2] << np.uint64(8) | b[2:-1] << np.uint64(16) | b[3:] << np.uint64(24)
        out += np.bincount((code * FACTORS[0] >> np.uint64(64 - HASH_BITS)).astype(np.int64), minlength=len(out))
    return out


def shape_pairs(text: bytes) -> np.ndarray:
    """How often a word of one shape is followed by one of another."""
    raw = np.frombuffer(text, np.uint8)
    blank = np.concatenate([[True], np.isin(raw, list(SPACES.encode())), [True]])
    first, last = np.flatnonzero(~blank[1:-1] & blank[:-2]), np.flatnonzero(~blank[1:-1] & blank[2:])
    shape = 3 * (KIND[raw[first]] == UPPER) + ENDS[raw[last]]
    return np.bincount(shape[:-1] * SHAPES + shape[1:], minlength=SHAPES**2)


def terms(doc: Doc, text: bytes) -> np.ndarray:
    """Damped frequency of each term: of grams per thousand characters, of pairs of shapes among all."""
    kinds = KIND[np.frombuffer(text, np.uint8)]
    out = np.zeros(TERMS, np.float32)
    if len(kinds) > 2:
        grams = (kinds[:-2] * KINDS + kinds[1:-1]) * KINDS + kinds[2:]
        out[:GRAMS] = np.bincount(grams, minlength=GRAMS) * (1000 / len(kinds))
        out[KIND_TERMS[1]] = hashed_grams(text) * (1000 / len(kinds))
    h = doc.hashes
    if len(h) > 1:
        out[GRAMS] = np.mean(h[1:] == h[:-1]) * REPEATED
    for k, length in ((1, 2), (2, 5)):
        runs = sequence_hash(h, length, FACTORS[0])
        if len(runs):
            out[GRAMS + k] = (1 - len(np.unique(runs)) / len(runs)) * REPEATED
    np.log1p(out, out=out)
    if len(h) > 1:
        out[KIND_TERMS[2]] = np.sqrt(shape_pairs(text) / (len(h) - 1))
    return out


def twins(text: bytes) -> list[bytes]:
    """What noise makes of one text in ``NOISE``, and in another way of one more; the same at each call."""
    seed = xxhash.xxh3_64_intdigest(text)
    own = np.random.default_rng(seed)
    if seed % NOISE == 0:
        raw = np.frombuffer(text, np.uint8).copy()
        for low, high in (b"az", b"AZ"):
            letters = (raw >= low) & (raw <= high)
            raw[letters] = own.integers(low, high + 1, letters.sum())
        return [raw.tobytes()]
    if seed % NOISE == 1:
        words = text.split(b" ")
        return [b" ".join(words[i] for i in own.permutation(len(words)))]
    return []


def blocks(batch: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray]]:
    """Ids and term matrices of a batch's documents, a block at a time."""
    for a in range(0, batch.num_rows, BLOCK):
        part = pa.Table.from_batches([batch.slice(a, BLOCK)])
        ids, rows = [], []
        for doc, text in zip(docs_of(part), part["text"].cast(pa.binary()), strict=True):
            ids.append(doc.doc_id)
            rows.append(terms(doc, text.as_py()))
        yield ids, np.array(rows)


def unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


def weighed(matrix: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Terms with their rarity, each kind with its share of a vector's length; overwrites the matrix."""
    matrix *= rarity
    for kind, share in zip(KIND_TERMS, SHARES, strict=True):
        norm = np.sqrt(np.einsum("ij,ij->i", matrix[:, kind], matrix[:, kind]))[:, None]
        matrix[:, kind] *= share / np.where(norm > 0, norm, 1)
    return matrix


class Model:
    """Projection into the latent space, and the labelled vectors there.

    ``vars`` of one are plain data, which is what is broadcast: executors without this
    package make their own object of them.
    """

    def __init__(self, labels: np.ndarray, prior: float, rarity: np.ndarray, projection: np.ndarray, vectors: np.ndarray):
        self.labels, self.prior, self.rarity, self.projection, self.vectors = labels, prior, rarity, projection, vectors

    def score(self, matrix: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """The vote on each row; overwrites the matrix."""
        k = min(neighbours, len(self.labels))
        if not k:
            return np.full(len(matrix), self.prior)
        cosine = unit(weighed(matrix, self.rarity) @ self.projection) @ self.vectors.T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64)
        total = weight.sum(axis=1)
        vote = (weight * self.labels[near]).sum(axis=1) / np.where(total > 0, total, 1)
        return np.clip(np.where(total > 0, vote, self.prior), 0, 1)


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def lowest(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows with the lowest ``hash``; of those with the last one any, which have equal terms."""
    last = rows.select("hash").orderBy("hash").limit(n).agg(F.count(F.lit(1)), F.max("hash")).first()
    if last[0] < n:
        return rows
    below = rows.where(F.col("hash") < last[1])
    return below.unionByName(rows.where(F.col("hash") == last[1]).limit(n - below.count()))


def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """A block of packed rows at a time, and the matrix of their terms."""
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            part = batch.slice(a, BLOCK)
            yield part, np.frombuffer(b"".join(part.column("terms").to_pylist()), "<f2").reshape(-1, TERMS).astype(np.float32)


def total_of(rows: DataFrame, function) -> np.ndarray:
    """The sum of ``function(matrix)``, which has a row for each term, over the packed rows.

    Tasks send their sums in stretches of terms, which are added up apart from each other;
    only the whole sum comes to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, matrix in matrices(batches):
            own = function(matrix)
            total = own if total is None else total + own
        if total is not None:
            parts = [x.astype("<f4").tobytes() for x in np.array_split(total, STRETCHES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(STRETCHES), pa.int32()), pa.array(parts, pa.binary())], ["nth", "part"])

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        # In 64 bits, so that the order of the tasks doesn't show.
        total = sum(np.frombuffer(x.as_py(), "<f4").astype(np.float64) for x in table["part"])
        return pa.table({"nth": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([total.astype("<f4").tobytes()], pa.binary())})

    kind = "nth int, part binary"
    found = rows.select("terms").coalesce(FIT_TASKS).mapInArrow(run, kind).groupBy("nth").applyInArrow(add, kind).collect()
    return np.concatenate([np.frombuffer(r["part"], "<f4") for r in sorted(found, key=lambda r: r["nth"])]).reshape(TERMS, -1)


def labelled_terms(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """``quality, terms, hash`` of a bounded sample of the labelled rows that aren't held out, and of their twins; written."""
    known = labels.where(F.col("quality").isNotNull() & ~F.coalesce(held_out(), F.lit(True)))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, quality in zip(batch.column("text").cast(pa.binary()), batch.column("quality").to_pylist(), strict=True):
                own = text.as_py()
                versions = [(own, quality)] + [(t, 0) for t in (twins(own) if quality else [])]
                packed = [terms(Doc(None, t), t).astype("<f2").tobytes() for t, _ in versions]
                yield pa.RecordBatch.from_arrays([pa.array([q for _, q in versions], pa.int64()), pa.array(packed, pa.binary())], ["quality", "terms"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    # At most ``sample`` ids and labels.
    joined = own.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("quality").cast("long"))
    rows = joined.mapInArrow(run, "quality long, terms binary").withColumn("hash", F.xxhash64("terms"))
    rows = written(rows.repartition(FIT_TASKS, "hash").sortWithinPartitions("hash", "quality"))
    return lowest(rows, sample + sample // 8)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, dimensions: int = DIMENSIONS) -> Model:
    """The model of the sample, whose terms stay in the tasks: the driver has sums over them and latent vectors."""
    context = docs.sparkSession.sparkContext
    rows = labelled_terms(docs, labels, sample)
    n = rows.count()
    found = total_of(rows, lambda matrix: np.count_nonzero(matrix, axis=0)[:, None])[:, 0] if n else np.zeros(TERMS)
    rarity = (np.log((1 + n) / (1 + found)) + 1).astype(np.float32)
    rarity[KIND_TERMS[2]] = 1
    basis = np.random.default_rng(1).standard_normal((TERMS, min(dimensions + 10, max(n, 1)))).astype(np.float32)
    if not n:
        return Model(np.zeros(0), 0.5, rarity, basis, np.zeros((0, 1), np.float32))
    # Subspace iteration for the leading right singular vectors.
    for _ in range(5):
        sent = context.broadcast((rarity, basis))

        def turned(matrix: np.ndarray) -> np.ndarray:
            own = weighed(matrix, sent.value[0])
            return own.T @ (own @ sent.value[1])

        basis = np.linalg.qr(total_of(rows, turned))[0]
        sent.destroy()
    sent = context.broadcast((rarity, basis))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, matrix in matrices(batches):
            latent = [x.tobytes() for x in (weighed(matrix, sent.value[0]) @ sent.value[1]).astype("<f4")]
            yield pa.RecordBatch.from_arrays([part.column("hash"), part.column("quality"), pa.array(latent, pa.binary())], ["hash", "quality", "latent"])

    projected = rows.coalesce(FIT_TASKS).mapInArrow(project, "hash long, quality long, latent binary").collect()
    sent.destroy()
    projected.sort(key=lambda r: (r["hash"], r["quality"]))
    latent = np.array([np.frombuffer(r["latent"], "<f4") for r in projected])
    quality = np.array([r["quality"] for r in projected], np.float64)
    _, _, turn = np.linalg.svd(latent, full_matrices=False)
    turn = turn.T[:, :dimensions]
    return Model(quality, float(quality.mean()), rarity, basis @ turn, unit(latent @ turn))


def scores(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    fitted = spark.sparkContext.broadcast(vars(fit(docs, labels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**fitted.value)
        for batch in batches:
            for ids, rows in blocks(batch):
                found = pa.array(model.score(rows), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), found], ["doc_id", "score"])

    own = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    scored = own.mapInArrow(run, SCORES)
    predicted = (F.col("score") >= ACCEPTED).cast("int")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", predicted.alias("predicted"))

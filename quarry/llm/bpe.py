r"""Byte-pair encoding and decoding for a vocabulary with word ends.

The tokenizer file's own steps are followed: special tokens are cut out of the raw
text, the rest is composed (NFC) and lower-cased, and split into contractions, runs
of letters, single digits and runs of other signs; white space goes.  A piece's
UTF-8 bytes are its first symbols, the last one marked as word end.

Pieces are merged many at a time: the symbols of all new pieces of a batch lie in one
flat array.  Each round forms the keys of neighbouring pairs, finds their ranks by
binary search over the sorted pair keys, takes the lowest rank of each piece and
merges all its places, from the left where they overlap; pieces without a pair leave
the array.  A piece met before is looked up; the memory of pieces is emptied when it
passes ``MEMORY``.

Decoding follows the file too, which names no decoder: the tokens' strings joined by
one space.

Defined cases: null texts count as empty, and have no tokens; repeated rows come back
each; an empty table gives no rows; texts are processed whole, in blocks of pieces,
whatever their length; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import text_of

#: Pieces remembered by a task, at most about 100 MB.
MEMORY = 200_000
#: Characters that are split at a time, and pieces that are merged at a time.
STRETCH = 1_000_000
BLOCK = 250_000

DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    extra = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(extra)) for b in range(256)]


class Tables:
    """A tokenizer file as arrays: what a task needs to encode and decode.

    ``vars`` of one are plain data, which is what is broadcast: executors without this
    package make their own object of them.
    """

    def __init__(self, path: str | None = None, **known):
        if path is None:
            self.__dict__ |= known
            return
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        chars = byte_characters()
        self.first = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + end] for c in chars], np.int64)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = 1 + max(*vocab.values(), *self.special.values())
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]], np.int64)
        keys = pairs[:, 0] * self.size + pairs[:, 1]
        order = np.argsort(keys)
        self.keys, self.rank, self.merged = keys[order], order, pairs[order, 2]
        self.strings = [""] * self.size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = token
        self.pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")


class Encoder:
    """Encodes and decodes with a vocabulary's tables, remembering pieces."""

    def __init__(self, tables: Tables, memory: int = MEMORY):
        self.tables, self.memory, self.known = tables, memory, {}
        self.pieces = regex.compile(tables.pattern).findall
        self.space = regex.compile(r"\s").search
        self.cut = regex.compile("(" + "|".join(map(regex.escape, tables.special)) + ")").split if tables.special else None

    def split(self, text: str) -> Iterator[list[str]]:
        """Pieces of a text, stretch by stretch; special tokens stand for themselves."""
        special = self.cut is not None and any(s in text for s in self.tables.special)
        for i, part in enumerate(self.cut(text) if special else [text]):
            if i % 2:
                # A NUL cannot begin a piece of letters, so it marks specials among the pieces.
                yield [f"\0{part}"]
                continue
            part, at = self.normal(part), 0
            while at < len(part):
                # No piece holds white space, so a stretch may end before any.
                space = self.space(part, at + STRETCH)
                end = space.start() if space else len(part)
                yield self.pieces(part, at, end)
                at = end

    @staticmethod
    def normal(text: str) -> str:
        if text.isascii():
            return text.lower()
        # Each sigma on its own: the tokenizer knows no final form.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def merge(self, pieces: list[str]) -> list[np.ndarray]:
        """Token ids of each piece, by rounds over all of them."""
        t, raw = self.tables, [p.encode("utf-8", "surrogatepass") for p in pieces]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbols, owner = t.first[flat], np.repeat(np.arange(len(raw)), lengths)
        ends = np.cumsum(lengths) - 1
        symbols[ends] = t.last[flat[ends]]
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(raw)
        none = len(t.keys)
        while len(symbols):
            keys = symbols[:-1] * t.size + symbols[1:]
            at = np.minimum(np.searchsorted(t.keys, keys), none - 1)
            hit = (t.keys[at] == keys) & (owner[:-1] == owner[1:])
            rank = np.append(np.where(hit, t.rank[at], none), none)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(starts, len(owner)))
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == none
            if done.any():
                for i, a, n in zip(owner[starts[done]].tolist(), starts[done].tolist(), sizes[done].tolist(), strict=True):
                    out[i] = symbols[a : a + n].copy()
            chosen = (rank == np.repeat(lowest, sizes)) & (rank < none)
            # Of neighbouring places only every other one, from the left.
            place = np.flatnonzero(chosen)
            run = np.flatnonzero(np.append(True, np.diff(place) != 1)) if len(place) else place
            nth = np.arange(len(place)) - np.repeat(run, np.diff(np.append(run, len(place))))
            place = place[nth % 2 == 0]
            symbols[place] = t.merged[at[place]]
            keep = np.repeat(~done, sizes)
            keep[place + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return out

    def learn(self, pieces: set[str]) -> None:
        """Remember the ids of pieces, as little-endian 32-bit bytes."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > self.memory:
            self.known.clear()
            new = list(pieces)
        plain = []
        for p in new:
            special = self.tables.special.get(p[1:]) if p[0] == "\0" else None
            if special is None:
                plain.append(p)
            else:
                self.known[p] = np.array([special], "<u4").tobytes()
        if plain:
            self.known |= zip(plain, (x.astype("<u4").tobytes() for x in self.merge(plain)), strict=True)

    def encode(self, texts: list[str]) -> Iterator[bytearray]:
        """Ids of each text as bytes; a block may hold many texts, and a text may span many blocks."""
        block: list[list[str]] = [[]]
        begun, size = bytearray(), 0
        for text in texts:
            for pieces in self.split(text):
                if size and size + len(pieces) > BLOCK:
                    *done, begun = self.joined(block, begun)
                    yield from done
                    block, size = [[]], 0
                block[-1] += pieces
                size += len(pieces)
            block.append([])
        yield from self.joined(block, begun)[:-1]

    def joined(self, block: list[list[str]], begun: bytearray) -> list[bytearray]:
        """Ids of each text's pieces in the block; the first goes on from those begun before."""
        self.learn({p for pieces in block for p in pieces})
        first, *others = (bytearray().join(map(self.known.__getitem__, pieces)) for pieces in block)
        begun += first
        return [begun, *others]

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.tables.strings.__getitem__, ids))


def encode(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ``ids``, the tokens of the whole text, for each document."""
    tables = spark.sparkContext.broadcast(vars(Tables(path)))  # a vocabulary, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Tables(**tables.value))
        for batch in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in encoder.encode(batch.column("text").to_pylist())]
            lists = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    own = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    return own.mapInArrow(run, "doc_id long, ids array<int>")


def decode(spark: SparkSession, encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and ``text`` of the ids; null ids count as none."""
    tables = spark.sparkContext.broadcast(vars(Tables(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Encoder(Tables(**tables.value))
        for batch in batches:
            texts = pa.array([decoder.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], ["doc_id", "text"])

    own = encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>"))
    return own.mapInArrow(run, "doc_id long, text string")


def round_trip(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """Digests of each document's ids and of the text decoded from them.

    The same as ``decode(encode(docs))``, without sending the ids between tasks.
    """
    tables = spark.sparkContext.broadcast(vars(Tables(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Tables(**tables.value))
        for batch in batches:
            rows = []
            for ids in encoder.encode(batch.column("text").to_pylist()):
                text = encoder.decode(np.frombuffer(ids, "<u4").tolist())
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            types = (pa.int64(), pa.string(), pa.string())
            made = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    own = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    return own.mapInArrow(run, DIGESTS)

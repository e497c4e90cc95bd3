"""Cosine retrieval for whole tables of questions at once, skipping blocks that can't matter.

A question's score in a block is bounded by the sum of its terms' highest weights there.
First each question is compared in full with the few blocks that its strongest terms
promise most; its k-th best score so far is its threshold.  Terms that together can't
reach it need not be looked up, and only blocks whose bound reaches it are compared.

A block's postings and the questions that want it meet in one task, which multiplies
them as sparse matrices and keeps each question's best.  Blocks are sent once for each
``GROUP`` questions that want them, as counted, and a frequent term's blocks are looked up
in shares.  So what is shuffled are the bounds of blocks, the postings of wanted ones and
``k`` rows a question and block, never a row for each pair of question and chunk.

That is for few questions.  Many of them want every block, so ``swept`` deals the blocks out
once, to cells of about equal size, and sends all questions to each cell, ``GROUP`` in a row.
A cell's task holds its blocks and lets the questions pass; what is shuffled are the
blocks once, the questions once a cell, and ``k`` rows a question and cell.
"""


from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.shared import written
from quarry.functions.text import is_blank, word_count
from quarry.operators.index import BLOCK, GONE, HEAD, MOVED, TERM, Index, Key, binary_of, normalised, norms, place_of, table_of, term_frequency, values_of

#: Scores are ordered by this many decimals, so that the order of summation doesn't matter.
DIGITS = 9
#: Less than any difference of ordered scores.
SLACK = 1e-8
#: Questions that meet a block at once: a matrix of this many rows and ``index.BLOCK`` columns fits a task.
GROUP = 1024
#: Blocks of an index of which none are skipped: looking up their bounds would take longer.
FEW_BLOCKS = 256
#: Questions up to which blocks are looked up by their bounds; more of them are sent to all blocks.
FEW_QUESTIONS = 16
#: Blocks of a cell, for so many questions and, in proportion, for more of them up to the most.
CELL, CELL_QUESTIONS, MOST_CELL = 64, 1 << 17, 256
#: Asked terms up to which the blocks are cut down to these before they are sent.
MANY_TERMS = 1 << 16
#: Chunks and groups of chunks of a tile, which is multiplied with a row of questions at once.
TILE, TILE_GROUPS = 4096, 64
#: Products of one term in a tile from which it is multiplied by itself.
OUTER = 512
#: Documents of hits that are named in the scan of the chunks, rather than joined alone.
FEW_DOCUMENTS = 500
#: Terms and blocks by which a question gets its threshold.
STRONGEST, FIRST_BLOCKS = 4, 4

FOUND = "row long, key long, score double, k long"
#: Products that are summed up at a time.
PRODUCTS = 1 << 20


def question_vectors(questions: DataFrame, index: Index, key: str = "qid") -> DataFrame:
    """``qid, term, w`` of ``questions(qid, question)``; blank questions have none."""
    asked = questions.where(~is_blank(F.col("question")))
    # Rows may share a key here.
    counts = term_frequency(asked, key, "question").groupBy(key, "term").agg(F.sum("tf").alias("tf"))
    vectors = normalised(counts, index.idf, key)
    return vectors.select(key, "term", F.col("w").alias("qw"))


def cosine_scores(questions: DataFrame, index: Index, key: str = "qid") -> DataFrame:
    """``qid, chunk_idx, score`` of all pairs that share a term, straight from the chunks: a model for tests."""
    postings = normalised(term_frequency(index.chunks, "chunk_idx", "chunk"), index.idf, "chunk_idx")
    shared = postings.join(question_vectors(questions, index, key), "term")
    scores = shared.groupBy(key, "chunk_idx").agg(F.round(F.sum(F.col("w") * F.col("qw")), DIGITS).alias("score"))
    return scores.where("score > 0")


def score_totals(questions: DataFrame, index: Index, key: str = "qid") -> DataFrame:
    """``qid, chunks, total, best`` over all chunks that share a term with a question; no pair of them is sent."""
    vectors = question_vectors(questions, index, key).join(index.idf.select("term", "idf"), "term").withColumn("weight", F.col("qw") * F.col("idf"))
    packed = vectors.groupBy(key).agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))
    packed = written(packed.withColumns({"row": F.monotonically_increasing_id(), "k": F.lit(1).cast("long")}))
    terms = packed.select(F.explode("terms").alias("term")).distinct()
    found = swept(packed.drop(key), terms, index, packed.count(), Cell.totals, "row long, chunks long, total double, best double")
    sums = found.groupBy("row").agg(F.sum("chunks").alias("chunks"), F.sum("total").alias("total"), F.max("best").alias("best"))
    return packed.select("row", key).join(sums, "row").drop("row")


def best_of_block(level: float):
    """The best chunks of one block for some questions.

    ``asked`` has a question's terms and weights in a row, ``rows`` the block's rows of all
    kinds; ``level`` is L of the index.
    """

    def run(key: Key, asked: pa.Table, rows: pa.Table) -> pa.Table:
        head = rows.filter(pc.equal(rows["kind"], HEAD))
        if not len(asked) or not len(head):
            return table_of(FOUND, [])
        keys = values_of(head["places"], "<i8")
        a, b, c = values_of(head["counts"], "<f8").reshape(3, -1).copy()
        alive = np.ones(len(keys), bool)
        for r in rows.filter(pc.is_in(rows["kind"], pa.array([MOVED, GONE], pa.int32()))).to_pylist():
            at = np.frombuffer(r["places"], "<i4")
            if r["kind"] == GONE:
                alive[at] = False
            else:
                b[at], c[at] = (x[at] + y for x, y in zip((b, c), np.frombuffer(r["counts"], "<f8").reshape(2, -1), strict=True))
        scores = multiplied(asked, rows.filter(pc.equal(rows["kind"], TERM)), len(keys))
        scores = np.round(scores / norms(a, b, c, level), DIGITS) * alive
        k = asked["k"].to_numpy()
        most = min(int(k.max()), len(keys))
        least = -np.partition(-scores, most - 1, axis=1)[:, most - 1]
        row, at = np.nonzero((scores >= least[:, None]) & (scores > 0))
        # Of equal scores the later chunk wins.
        order = np.lexsort((-keys[at], -scores[row, at], row))
        row, at = row[order], at[order]
        kept = np.arange(len(row)) - np.searchsorted(row, np.arange(len(k)))[row] < k[row]
        row, at = row[kept], at[kept]
        return pa.table({"row": asked["row"].to_numpy()[row], "key": keys[at], "score": scores[row, at], "k": k[row]})

    return run


def multiplied(asked: pa.Table, terms: pa.Table, n: int) -> np.ndarray:
    """Sums of weight times number over the terms of each question, for each of ``n`` chunks."""
    lists = asked["terms"].combine_chunks()
    question = np.repeat(np.arange(len(asked)), np.diff(lists.offsets.to_numpy()))
    weights = asked["weights"].combine_chunks().flatten().to_numpy()
    known = pc.index_in(lists.flatten(), terms["term"].combine_chunks()).fill_null(-1).to_numpy()
    question, weights, known = (x[known >= 0] for x in (question, weights, known))
    places, counts, size = values_of(terms["places"], "<i4"), values_of(terms["counts"], "<i4"), terms["n"].to_numpy().astype(np.int64)
    first, many = (np.cumsum(size) - size)[known], size[known]
    out = np.zeros(len(asked) * n)
    # Each of a question's terms with each of its postings, some of them at a time.
    edges = [*np.searchsorted(np.cumsum(many), np.arange(0, many.sum(), PRODUCTS)).tolist(), len(many)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own = many[a:b]
        which = np.repeat(np.arange(a, b), own)
        at = np.arange(len(which)) - np.repeat(np.cumsum(own) - own, own) + first[which]
        out += np.bincount(question[which] * n + places[at], weights=weights[which] * counts[at], minlength=len(out))
    return out.reshape(len(asked), n)


def compared(pairs: DataFrame, packed: DataFrame, terms: DataFrame, index: Index) -> DataFrame:
    """``row, key, score, k``: the best chunks of each pair ``(segment, block, row)``; of a block only the asked ``terms`` are sent."""
    wanted = pairs.groupBy("segment", "block").agg(F.count(F.lit(1)).alias("wanted"))
    groups = F.ceil(F.col("wanted") / GROUP).cast("int")
    rows = index.blocks.select("segment", "block", "kind", "term", "places", "counts", "n")
    rows = rows.where(F.col("kind") == TERM).join(terms, "term", "left_semi").select(*rows.columns).unionByName(rows.where(F.col("kind") != TERM))
    blocks = rows.join(wanted, ["segment", "block"])
    blocks = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), groups - 1))).drop("wanted")
    asked = pairs.join(wanted, ["segment", "block"]).withColumn("group", F.pmod(F.xxhash64("row"), groups).cast("int")).drop("wanted").join(packed, "row")
    place = ["segment", "block", "group"]
    return asked.groupBy(*place).cogroup(blocks.groupBy(*place)).applyInArrow(best_of_block(index.level), FOUND)


class Cell:
    """The blocks of one cell as postings by tile and term; a tile has some whole blocks.

    Blocks come in pieces, of which only the numbers are kept, in as few bytes as they need.
    """

    def __init__(self, level: float):
        self.level, self.ids, self.others, self.parts, self.tiles = level, {}, [], [], None

    def add(self, batch: pa.RecordBatch, nth: int) -> None:
        """Take in one of the rows that ``dealt_blocks`` packed."""
        if batch.column("kind")[nth].values[0].as_py() != TERM:
            self.others += dealt_rows(batch, nth).to_pylist()
            return
        segment, block, n = (batch.column(c)[nth].values.to_numpy() for c in ("segment", "block", "n"))
        order = np.lexsort((block, segment))
        new = np.append(True, (block[order][1:] != block[order][:-1]) | (segment[order][1:] != segment[order][:-1]))
        pairs = zip(segment[order][new].tolist(), block[order][new].tolist(), strict=True)
        own = np.empty(len(n), np.int32)
        own[order] = np.array([self.ids.setdefault(x, len(self.ids)) for x in pairs], np.int32)[np.cumsum(new) - 1]
        term = batch.column("term")[nth].values
        places, counts = (np.frombuffer(batch.column(c)[nth].as_buffer(), "<i4") for c in ("places", "counts"))
        # Joined with nothing, the terms are copied, else they would keep the whole batch.
        self.parts.append((own, pa.concat_arrays([term, term.slice(0, 0)]), n.astype(np.uint16), places.astype(np.uint16), counts.astype(np.min_scalar_type(counts.max(initial=0)))))

    def close(self) -> None:
        """Put all that came in order."""
        heads = {(r["segment"], r["block"]): r for r in self.others if r["kind"] == HEAD}
        sums = {x: np.frombuffer(r["counts"], "<f8").reshape(3, -1).copy() for x, r in heads.items()}
        alive = {x: np.ones(r["n"]) for x, r in heads.items()}
        for r in self.others:
            x, at = (r["segment"], r["block"]), np.frombuffer(r["places"], "<i4")
            if r["kind"] == GONE:
                alive[x][at] = 0
            elif r["kind"] == MOVED:
                sums[x][1:, at] += np.frombuffer(r["counts"], "<f8").reshape(2, -1)
        first, end = {}, 0
        for x, r in heads.items():
            if end % TILE + r["n"] > TILE:
                end = -(-end // TILE) * TILE
            first[x], end = end, end + r["n"]
        tiles = -(-end // TILE)
        self.keys, self.scale = np.zeros(tiles * TILE, np.int64), np.zeros(tiles * TILE)
        for x, r in heads.items():
            own = slice(first[x], first[x] + r["n"])
            self.keys[own], self.scale[own] = np.frombuffer(r["places"], "<i8"), alive[x] / norms(*sums[x], self.level)

        start = np.array([first[x] for x in self.ids], np.int64)
        own, n, places, counts = (np.concatenate([np.zeros(0, np.uint8), *(x[i] for x in self.parts)]) for i in (0, 2, 3, 4))
        words = pa.concat_arrays([pa.array([], pa.string()), *(x[1] for x in self.parts)])
        self.parts, self.others = [], []
        words = words.dictionary_encode()
        self.words, code = words.dictionary, words.indices.to_numpy()
        del words
        post = np.cumsum(n, dtype=np.int64) - n
        tile = (start // TILE).astype(np.int32)[own] if len(own) else np.zeros(0, np.int32)
        order = np.lexsort((code, tile))
        edges = np.searchsorted(tile[order], np.arange(tiles + 1))
        self.tiles = []
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            rows = order[a:z]
            many, terms = n[rows].astype(np.int64), code[rows]
            ends = np.cumsum(many)
            at = np.arange(many.sum()) - np.repeat(ends - many, many) + np.repeat(post[rows], many)
            new = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.zeros(0, np.int64)
            spot = (places[at] + np.repeat(start[own[rows]] % TILE, many)).astype(np.uint16)
            self.tiles.append((terms[new], np.append((ends - many)[new], len(at)).astype(np.int32), spot, counts[at]))

    def _scores(self, asked: pa.RecordBatch, nth: int, out: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Number and scores of each tile for the ``nth`` row of questions; ``out`` is room for the scores."""
        size, weight = (asked.column(x)[nth].values.to_numpy() for x in ("sizes", "weights"))
        n = len(size)
        code = pc.index_in(asked.column("terms")[nth].values, self.words).fill_null(-1).to_numpy().astype(np.int64)
        order = np.argsort(code, kind="stable")[np.count_nonzero(code < 0) :]
        question, weight, code = np.repeat(np.arange(n), size)[order] * TILE, weight[order], code[order]
        edges = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
        many, edges = np.diff(np.append(edges, len(code))), np.append(edges, len(code))
        code = code[edges[:-1]]
        for tile in range(len(self.tiles) if len(code) else 0):
            self._multiply(tile, code, many, edges, question, weight, out[: n * TILE])
            scores = out[: n * TILE].reshape(n, TILE)
            scores *= self.scale[tile * TILE : (tile + 1) * TILE]
            yield tile, scores

    def totals(self, asked: pa.RecordBatch, nth: int, out: np.ndarray) -> pa.RecordBatch:
        """How many chunks have a score for each of the ``nth`` row of questions, the scores' sum and the highest."""
        row = asked.column("rows")[nth].values.to_numpy()
        chunks, total, best = np.zeros(len(row), np.int64), np.zeros(len(row)), np.zeros(len(row))
        for _, scores in self._scores(asked, nth, out):
            np.round(scores, DIGITS, out=scores)
            chunks += (scores > 0).sum(axis=1)
            total += scores.sum(axis=1)
            np.maximum(best, scores.max(axis=1), out=best)
        hit = chunks > 0
        return pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (row, chunks, total, best)], ["row", "chunks", "total", "best"])

    def best(self, asked: pa.RecordBatch, nth: int, out: np.ndarray) -> pa.RecordBatch:
        """The best chunks for the ``nth`` row of questions."""
        row, k = (asked.column(x)[nth].values.to_numpy() for x in ("rows", "ks"))
        n = len(row)
        least, found = np.zeros(n), []
        for tile, scores in self._scores(asked, nth, out):
            scores = scores.reshape(n, TILE_GROUPS, -1)
            # A question's k-th best group has k chunks at least as good.
            tops = scores.max(axis=2)
            kth = np.take_along_axis(-np.sort(-tops, axis=1), np.minimum(k, TILE_GROUPS)[:, None] - 1, axis=1)[:, 0]
            least = np.maximum(least, np.where(k <= TILE_GROUPS, kth, 0.0))
            bound = np.maximum(least - SLACK, 4e-10)
            q, g = np.nonzero(tops >= bound[:, None])
            i, j = np.nonzero(scores[q, g] >= bound[q, None])
            at = tile * TILE + g[i] * scores.shape[2] + j
            found.append((q[i], at, np.round(scores[q[i], g[i], j], DIGITS)))
        q, at, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        key = self.keys[at]
        order = np.lexsort((-key, -score, q))
        order = order[score[order] > 0]
        q, key, score = q[order], key[order], score[order]
        kept = np.arange(len(q)) - np.searchsorted(q, np.arange(n))[q] < k[q]
        return pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (row[q], key, score, k[q])], ["row", "key", "score", "k"])

    def _multiply(self, tile: int, code: np.ndarray, many: np.ndarray, edges: np.ndarray, question: np.ndarray, weight: np.ndarray, out: np.ndarray) -> None:
        """Sums of weight times number over the terms of each question, for each chunk of a tile; some products at a time."""
        out.fill(0)
        terms, starts, at, counts = self.tiles[tile]
        if not len(terms):
            return
        spot = np.searchsorted(terms, code)
        known = terms[np.minimum(spot, len(terms) - 1)] == code
        first, n = (np.zeros(len(code), np.int64) for _ in range(2))
        first[known], n[known] = starts[spot[known]], (starts[1:] - starts[:-1])[spot[known]]
        for i in np.flatnonzero(n * many >= OUTER).tolist():
            post, step = slice(first[i], first[i] + n[i]), max(1, PRODUCTS // int(n[i]))
            for a in range(edges[i], edges[i + 1], step):
                own = slice(a, min(a + step, edges[i + 1]))
                np.add.at(out, (question[own, None] + at[post]).ravel(), (weight[own, None] * counts[post]).ravel())
        rare = np.flatnonzero((n > 0) & (n * many < OUTER))
        sums = np.cumsum((n * many)[rare])
        cuts = np.append(np.searchsorted(sums, np.arange(0, sums[-1], PRODUCTS)), len(rare)).tolist() if len(rare) else [0]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            own = rare[a:z]
            term = np.repeat(own, many[own])
            entry = np.arange(len(term)) - np.repeat(np.cumsum(many[own]) - many[own], many[own]) + edges[term]
            size = n[term]
            post = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[term], size)
            entry = np.repeat(entry, size)
            np.add.at(out, question[entry] + at[post], weight[entry] * counts[post])


def dealt_blocks():
    """Rows of blocks, packed by cell: those of one of Arrow's batches in a row, postings apart from the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column("cell").to_numpy().astype(np.int64) * 2 + (batch.column("kind").to_numpy() != TERM)
            order = np.argsort(group, kind="stable")
            group, rows = group[order], batch.take(pa.array(order))
            start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            edges = pa.array(np.append(start, len(group)).astype(np.int32))
            # The values of postings lie one after another, as n tells where each ends.
            joined = {c: pa.array([b"".join(rows.column(c).slice(a, z - a).to_pylist()) for a, z in zip(start.tolist(), edges.to_pylist()[1:], strict=True)], pa.binary()) for c in ("places", "counts")}
            lists = {c: pa.ListArray.from_arrays(edges, rows.column(c)) for c in ("segment", "block", "kind", "term", "n")}
            columns = [pa.array((group[start] // 2).astype(np.int32)), pa.array(np.full(len(start), -1, np.int32)), *lists.values(), *joined.values()]
            yield pa.RecordBatch.from_arrays(columns, ["cell", "pack", *lists, *joined])

    return run


def dealt_rows(batch: pa.RecordBatch, nth: int) -> pa.RecordBatch:
    """The rows that ``dealt_blocks`` packed, as they were."""
    own = {c: batch.column(c)[nth].values for c in ("segment", "block", "kind", "term", "n")}
    n, kind = own["n"].to_numpy().astype(np.int64), own["kind"].to_numpy()
    widths = {"places": np.where(kind == HEAD, 8, 4) * n, "counts": np.select([kind == TERM, kind == HEAD, kind == MOVED], [4 * n, 24 * n, 16 * n], 0)}
    for c, width in widths.items():
        edges = np.append(0, np.cumsum(width))
        own[c] = binary_of(np.frombuffer(batch.column(c)[nth].as_py(), np.uint8), edges)
    return pa.RecordBatch.from_pydict(own)


DEALT = "cell int, pack int, segment array<int>, block array<long>, kind array<int>, term array<string>, n array<int>, places binary, counts binary"


def swept_cells(level: float, method):
    """What a method of ``Cell`` finds in each cell for all questions; a cell's blocks come before the questions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cell, out = None, None, None
        for batch in batches:
            cells, packs = batch.column("cell").to_pylist(), batch.column("pack").to_pylist()
            for nth in range(batch.num_rows):
                if cells[nth] != now:
                    now, cell = cells[nth], None
                if packs[nth] < 0:
                    cell = cell or Cell(level)
                    cell.add(batch, nth)
                elif cell is not None:
                    if cell.tiles is None:
                        cell.close()
                    n = len(batch.column("rows")[nth])
                    if out is None or len(out) < n * TILE:
                        out = np.empty(n * TILE)
                    yield method(cell, batch, nth, out)

    return run


def swept(packed: DataFrame, terms: DataFrame, index: Index, many: int, method=Cell.best, schema: str = FOUND) -> DataFrame:
    """``row, key, score, k``: the best chunks of each cell for each of ``many`` questions, or what else a method of ``Cell`` finds.

    Of a few ``terms`` only their postings are sent.
    """
    place, posting = ["segment", "block"], ["kind", "term", "places", "counts", "n"]
    blocks = index.blocks.select(*place, *posting)
    terms = written(terms)
    if terms.count() <= MANY_TERMS:
        blocks = blocks.where(F.col("kind") == TERM).join(terms, "term", "left_semi").select(*blocks.columns).unionByName(blocks.where(F.col("kind") != TERM))
    # Deals that make each task long enough, and leave work for every core.
    n = -(-index.n // BLOCK)
    own = min(MOST_CELL, CELL * max(1, -(-many // CELL_QUESTIONS)))
    cells = max(1, -(-n // own), min(n, 2 * index.spark.sparkContext.defaultParallelism))
    groups = max(1, -(-many // GROUP))
    question = F.struct("row", "k", F.size("terms").alias("size"), "terms", "weights")
    dealt = packed.groupBy(F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("pack")).agg(F.collect_list(question).alias("q"))  # GROUP or so
    dealt = dealt.select(
        F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), "pack", F.col("q")["row"].alias("rows"), F.col("q")["k"].alias("ks"),
        F.col("q")["size"].alias("sizes"), F.flatten(F.col("q")["terms"]).alias("terms"), F.flatten(F.col("q")["weights"]).alias("weights"),
    )
    sent = blocks.withColumn("cell", F.pmod(F.xxhash64(*place), F.lit(cells)).cast("int")).mapInArrow(dealt_blocks(), DEALT)
    both = sent.unionByName(dealt, allowMissingColumns=True)
    return both.repartitionById(cells, F.col("cell")).sortWithinPartitions("cell", "pack").mapInArrow(swept_cells(index.level, method), schema)


def bounds(terms: DataFrame, index: Index) -> DataFrame:
    """``segment, block, row, bound`` of the blocks that share one of ``terms(row, term, weight, shares)``.

    A frequent term is looked up in as many shares as its segment has for it.
    """
    looked = terms.select("row", "term", "weight", F.inline("shares")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("spread") - 1))).drop("spread")
    tops = index.blocks.where(F.col("kind") == TERM).select("segment", "term", "salt", "block", (F.col("top") / index.rho()).alias("top"))
    return tops.join(looked, ["segment", "term", "salt"]).groupBy("segment", "block", "row").agg(F.sum(F.col("top") * F.col("weight")).alias("bound"))


def best_found(rows: DataFrame, terms: DataFrame, packed: DataFrame, asked: DataFrame, index: Index) -> DataFrame:
    """``compared`` over the blocks that can hold one of a question's best chunks."""
    by_row = Window.partitionBy("row")
    strongest = terms.withColumn("nth", F.row_number().over(by_row.orderBy(F.desc("most"), "term"))).where(F.col("nth") <= STRONGEST)
    promised = bounds(strongest, index)
    nth = F.row_number().over(by_row.orderBy(F.desc("bound"), "segment", "block"))
    first = written(promised.withColumn("nth", nth).where(F.col("nth") <= FIRST_BLOCKS).select("segment", "block", "row"))
    hits = written(compared(first, packed, asked, index))
    nth = F.row_number().over(by_row.orderBy(F.desc("score"), F.desc("key")))
    thresholds = hits.withColumn("nth", nth).where(F.col("nth") == F.col("k")).select("row", F.col("score").alias("threshold"))

    # From the weakest term on, those are left out that can't reach the threshold together.
    judged = terms.join(thresholds, "row", "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.0)) - SLACK)
    weaker = F.sum("most").over(by_row.orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0))
    judged = judged.withColumn("left_out", weaker < F.col("threshold"))
    rest = F.sum(F.when(F.col("left_out"), F.col("most")).otherwise(0.0)).over(by_row)
    judged = judged.withColumn("rest", rest).where("NOT left_out").select("row", "term", "weight", "shares", "threshold", "rest")
    needed = judged.groupBy("row").agg(F.max("threshold").alias("threshold"), F.max("rest").alias("rest"))
    reached = bounds(judged, index).join(needed, "row").where(F.col("bound") + F.col("rest") >= F.col("threshold"))
    others = reached.select("segment", "block", "row").join(first, ["segment", "block", "row"], "left_anti")
    return hits.unionByName(compared(written(others), packed, asked, index))


def top_k(questions: DataFrame, index: Index, k: int | Column, key: str = "qid") -> DataFrame:
    """``key, chunk_idx, score, rank, doc_ord, chunk_pos``: the best ``k`` chunks of each question, with ``rank`` from 1.

    ``k`` may be a column of ``questions``; equal scores go to the later chunk.  Each row is
    a question of its own, with whatever key: null, or that of another row.
    """
    if isinstance(k, int) and k < 0:
        raise ValueError("k must not be negative")
    # A fixed k lets Spark cut each task's rows before the last shuffle.
    limit = F.lit(k) if isinstance(k, int) else F.col("k")
    k = F.lit(k) if isinstance(k, int) else k
    rows = written(questions.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key_"), "question", k.cast("long").alias("k")))
    asked = rows.where((F.col("k") > 0) & ~is_blank(F.col("question")))
    known = term_frequency(asked, "row", "question").join(index.idf, "term").withColumn("raw", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("row")))
    weight = F.col("raw") / norm * F.col("idf")
    terms = written(known.select("row", "term", weight.alias("weight"), (weight * F.col("top")).alias("most"), "shares"))
    packed = terms.groupBy("row").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights")).join(rows.select("row", "k"), "row")

    asked = terms.select("term").distinct()
    by_row = Window.partitionBy("row")
    if (many := rows.where("k > 0").count()) > FEW_QUESTIONS:
        found = swept(packed, asked, index, many)
    elif index.n <= FEW_BLOCKS * BLOCK and len(places := index.places) <= FEW_BLOCKS:
        every = F.array(*(F.struct(F.lit(s).alias("segment"), F.lit(b).alias("block")) for s, b in places)) if places else F.array().cast("array<struct<segment:int,block:long>>")
        found = compared(rows.where("k > 0").select("row", F.inline(every)), packed, asked, index)
    else:
        found = best_found(rows, terms, packed, asked, index)
    order = by_row.orderBy(F.desc("score"), F.desc("key"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    placed = ranked.select("row", "score", "rank", *place_of(F.col("key")))
    placed = placed.join(index.firsts, "doc_ord").join(rows.select("row", F.col("key_").alias(key)), "row")
    return placed.select(key, (F.col("first") + F.col("chunk_pos")).alias("chunk_idx"), "score", "rank", "doc_ord", "chunk_pos")


def named_documents(hits: DataFrame) -> list[int] | None:
    """The order numbers of the documents of written hits, if they are few."""
    found = [r["doc_ord"] for r in hits.select("doc_ord").distinct().limit(FEW_DOCUMENTS + 1).collect()]
    return found if len(found) <= FEW_DOCUMENTS else None


def evidence(hits: DataFrame, index: Index, documents: list[int] | None = None) -> DataFrame:
    """Hits with chunk id, title and snippet; with the ``documents`` named, only row groups that may hold them are read."""
    chunks = index.live_chunks
    chunks = chunks if documents is None else chunks.where(F.col("doc_ord").isin(documents))
    chunks = chunks.select("doc_ord", "chunk_pos", F.col("id").alias("doc_id"), "title", F.col("chunk").alias("snippet"))
    chunk_id = F.concat_ws("-", "doc_id", F.col("chunk_idx").cast("string"))
    return hits.join(chunks, ["doc_ord", "chunk_pos"]).withColumn("id", chunk_id)


def coverage(found: Column, k: Column) -> Column:
    """Found over wanted, 1 at most; 0 where none are wanted."""
    return F.when(k <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), found / k))


def gathered(questions: DataFrame, index: Index, k: int, key: str = "qid") -> DataFrame:
    """``qid, chunks, coverage, tokens`` for every question, those without evidence too."""
    rows = written(questions.select(key, "question", F.monotonically_increasing_id().alias("question_row")))
    # Once they are written, Spark knows how few they are and leaves the chunks' texts where they lie.
    hits = written(top_k(rows, index, k, "question_row"))
    found = evidence(hits, index, named_documents(hits))
    sums = found.groupBy("question_row").agg(F.count(F.lit(1)).alias("chunks"), F.sum(word_count(F.col("snippet"))).alias("tokens"))
    joined = rows.select(key, "question_row").join(sums, "question_row", "left")
    chunks, tokens = (F.coalesce(c, F.lit(0)) for c in ("chunks", "tokens"))
    return joined.select(key, chunks.alias("chunks"), coverage(chunks, F.lit(k)).alias("coverage"), tokens.alias("tokens"))

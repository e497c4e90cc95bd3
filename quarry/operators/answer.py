"""From questions to answers: plan, gather, deduplicate, fall back, assemble, measure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.shared import written
from quarry.functions.text import word_count
from quarry.operators.index import Index
from quarry.operators.retrieve import coverage, evidence, named_documents, top_k
from quarry.sources.config import Retrieval

FALLBACK_K = 3

# Answers without a model, and without any evidence.
NO_PROVIDER = "(No provider configured.) Context summary:\n"
NO_DOCUMENTS = "No documents ingested yet."


def planned(questions: DataFrame, retrieval: Retrieval) -> DataFrame:
    """``qid, question, steps``: one step with the question as it is, unless steps are given.

    ``row`` names each question from here on, so that ``qid`` may be null or repeated.
    """
    step = F.struct(
        F.col("question").alias("query"),
        F.lit(retrieval.dense_k).alias("dense_k"),
        F.lit(retrieval.sparse_k).alias("sparse_k"),
        F.lit(retrieval.rerank_pool).alias("rerank_pool"),
        F.lit(retrieval.compression).alias("compression"),
    )
    own = questions if "steps" in questions.columns else questions.withColumn("steps", F.array(step))
    targets = {"target_tokens": F.lit(retrieval.target_tokens), "coverage_target": F.lit(retrieval.coverage_target)}
    return written(own.withColumns(targets | {"row": F.monotonically_increasing_id()}))


def step_hits(plan: DataFrame, index: Index) -> DataFrame:
    """``row, qid, step, chunk_idx, score, rank`` and the chunk's place: all steps of all questions at once."""
    steps = plan.select("row", "qid", F.posexplode("steps").alias("step", "s")).select(
        F.struct("row", "qid", "step").alias("key"), F.col("s.query").alias("question"), F.col("s.dense_k").alias("k")
    )
    return top_k(steps, index, F.col("k"), "key").select("key.*", "chunk_idx", "score", "rank", "doc_ord", "chunk_pos")


def first_of_each(hits: DataFrame) -> DataFrame:
    """One row per question and chunk, its first; ``nth`` numbers them in order."""
    again = Window.partitionBy("row", "chunk_idx").orderBy("step", "rank")
    order = Window.partitionBy("row").orderBy("step", "rank")
    once = hits.withColumn("again", F.row_number().over(again)).where("again = 1").drop("again")
    return once.withColumn("nth", F.row_number().over(order))


def with_fallback(plan: DataFrame, hits: DataFrame, index: Index) -> DataFrame:
    """Questions without a hit get the best three for the question itself."""
    hits = written(hits)
    bare = plan.select(F.struct("row", "qid").alias("key"), "question", "row").join(hits.select("row"), "row", "left_anti")
    more = top_k(bare.select("key", "question"), index, FALLBACK_K, "key")
    columns = ("chunk_idx", "score", "rank", "doc_ord", "chunk_pos")
    more = more.select("key.*", F.lit(0).alias("step"), *columns, F.col("rank").alias("nth"))
    return hits.select("row", "qid", "step", *columns, "nth").unionByName(more)


def assembled(plan: DataFrame, hits: DataFrame, index: Index, documents: list[int] | None = None) -> DataFrame:
    """A row per question with its evidence in order, context and metrics.

    Columns: row, qid, question, chunks (array of evidence), context, n_chunks,
    unique_sources, tokens, coverage.
    """
    found = evidence(hits, index, documents)
    chunk = F.struct("nth", "id", "title", "snippet", "score")
    grouped = found.groupBy("row").agg(
        F.array_sort(F.collect_list(chunk)).alias("own"),
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("title").alias("sources"),
        F.sum(word_count(F.col("snippet"))).alias("words"),
    )
    joined = plan.join(grouped, "row", "left")
    own = F.coalesce("own", F.array().cast("array<struct<nth:int,id:string,title:string,snippet:string,score:double>>"))
    n = F.coalesce("n", F.lit(0))
    return joined.select(
        "row",
        "qid",
        "question",
        F.transform(own, lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title"), x["snippet"].alias("snippet"), x["score"].alias("score"))).alias("chunks"),
        F.array_join(F.transform(own, lambda x: x["snippet"]), "\n\n").alias("context"),
        n.alias("n_chunks"),
        F.coalesce("sources", F.lit(0)).alias("unique_sources"),
        F.coalesce("words", F.lit(0)).alias("tokens"),
        coverage(n, F.col("steps")[0]["dense_k"]).alias("coverage"),
    )


def without_provider(context: F.Column) -> F.Column:
    """The answer where no model is configured."""
    return F.when(F.length(context) > 0, F.concat(F.lit(NO_PROVIDER), context)).otherwise(NO_DOCUMENTS)


def found_by_step(plan: DataFrame, hits: DataFrame) -> DataFrame:
    """``row, sub_queries``: each step's question, wanted number of chunks, and found ones, in order."""
    counts = hits.groupBy("row", "step").agg(F.count(F.lit(1)).alias("chunks_found"))
    steps = plan.select("row", F.posexplode("steps").alias("step", "s")).join(counts, ["row", "step"], "left")
    own = F.struct("step", F.col("s.query").alias("query"), F.col("s.dense_k").alias("top_k"), F.coalesce("chunks_found", F.lit(0)).alias("chunks_found"))
    ordered = F.array_sort(F.collect_list(own))  # as many as a plan has steps
    return steps.groupBy("row").agg(F.transform(ordered, lambda x: x.dropFields("step")).alias("sub_queries"))


def retrieved_for(plan: DataFrame, index: Index) -> DataFrame:
    """Evidence, context and metrics of a plan's questions, and what each of their steps found."""
    hits = written(step_hits(plan, index))
    chosen = written(with_fallback(plan, first_of_each(hits), index))
    rows = assembled(plan, chosen, index, named_documents(chosen))
    return rows.join(found_by_step(plan, hits), "row", "left").drop("row")


def retrieved(questions: DataFrame, index: Index, retrieval: Retrieval) -> DataFrame:
    """Evidence, context and metrics of ``questions(qid, question[, steps])``."""
    return retrieved_for(planned(questions, retrieval), index)


def concluded(rows: DataFrame, provider=None, log: str | None = None) -> DataFrame:
    """Adds answer and status to ``retrieved`` rows."""
    if provider is None:
        return rows.withColumns({"answer": without_provider(F.col("context")), "status": F.lit("completed")})
    from quarry.operators.generate import generated

    return generated(rows, provider, log)


def answer(questions: DataFrame, index: Index, retrieval: Retrieval, provider=None) -> DataFrame:
    """Answers ``questions(qid, question[, steps])`` with evidence and metrics, in one plan."""
    return concluded(retrieved(questions, index, retrieval), provider)


def evaluation(answers: DataFrame) -> DataFrame:
    """Mean coverage and tokens over all questions, those without evidence too."""
    return answers.agg(
        F.count(F.lit(1)).alias("questions"), F.avg("coverage").alias("average_coverage"), F.avg("tokens").alias("average_tokens")
    )

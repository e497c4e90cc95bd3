"""Connected components of an edge table by alternating large and small stars.

Defined cases: repeated edges count once, loops are ignored, as are edges with a null
end; no edges give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import saved


#: Edges that a task holds between two shuffles.
TASK_EDGES = 200_000


def star(edges: DataFrame, both_ways: bool, tasks: int) -> DataFrame:
    """One step: larger neighbours (both ways), or smaller ones, move to the smallest neighbour.

    The smallest neighbour is an aggregate that is combined before the shuffle; the
    edges of a vertex with very many are split by Spark's adaptive skew join.
    """
    if both_ways:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = edges.join(least, "u").coalesce(tasks)
    if both_ways:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        own = joined.select("u", F.col("m").alias("v"))
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)
    return moved.where(F.col("u") != F.col("v")).distinct().coalesce(tasks)


def bunches(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n is connected with by the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges, ``TASK_EDGES`` or so at a time, as stars that connect the same vertices: one edge a vertex at most."""
    held, n = [], 0

    def star_of(held: list[np.ndarray]) -> pa.RecordBatch:
        vertices, at = np.unique(np.concatenate(held, axis=1), return_inverse=True)
        a, b = at.reshape(2, -1)
        root = bunches(len(vertices), a, b)
        larger = root < np.arange(len(vertices))
        return pa.RecordBatch.from_arrays([pa.array(vertices[larger]), pa.array(vertices[root[larger]])], ["u", "v"])

    for batch in batches:
        held.append(np.array([batch.column(c).to_numpy() for c in (0, 1)]))
        n += batch.num_rows
        if n >= TASK_EDGES:
            yield star_of(held)
            held, n = [], 0
    if n:
        yield star_of(held)


def connected(edges: DataFrame) -> DataFrame:
    """``(v, root)`` for each vertex that isn't the smallest of its component, from ``(u, v)`` edges."""
    larger, smaller = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now = saved(edges.where(F.col("u") != F.col("v")).select(larger, smaller).distinct())
    state = mark = None
    while True:
        n = now.count() if state is None else state[0]
        if n < TASK_EDGES:
            # A task's edges at most: their stars are the components, without a shuffle.
            now = saved(now.coalesce(1).mapInArrow(forests, "u long, v long"))
        elif state is None:
            # A vertex of a large component may have very many edges; each task's are made one a vertex first.
            now = saved(now.coalesce(1 + n // TASK_EDGES).mapInArrow(forests, "u long, v long").distinct())
        if n < TASK_EDGES or state is not None and state == mark:
            return now.select(F.col("u").alias("v"), F.col("v").alias("root"))
        mark = state
        tasks = 1 + n // TASK_EDGES
        now = saved(star(star(now, True, tasks), False, tasks))
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()

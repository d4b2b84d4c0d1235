"""Connected components of an undirected graph given by its edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.storage import durable

#: Edges that a task contracts at a time, and at most how many, by count, are left to one last task.
CHUNK_EDGES = 1 << 20
LAST_EDGES = 1 << 16


def least_labels(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of n nodes is connected to: labels hook to lesser ones and paths halve until nothing moves."""
    label = np.arange(n)
    while True:
        a, b = label[x], label[y]
        if (a == b).all():
            return label
        least = np.minimum(a, b)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label = jump


def _contract(chunk: int):
    """Each node of a chunk of edges with the least node of its component there, roots with themselves."""

    def solve(batches):
        x, y = (pa.chunked_array([b.column(k) for b in batches]).combine_chunks() for k in ("x", "y"))
        coded = pa.concat_arrays([x, y]).dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        codes = rank[coded.indices.to_numpy()]
        label = least_labels(codes[: len(x)], codes[len(x) :], len(order))
        nodes = coded.dictionary.take(order)
        return pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(label))], ["x", "y"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                if held and size + part.num_rows > chunk:
                    yield solve(held)
                    held, size = [], 0
                held.append(part)
                size += part.num_rows
        if size:
            yield solve(held)

    return run


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step of alternating stars on edges from a node to a lesser or equal one.

    Each node's neighbours that are larger (or, in a small step, the others and itself) are tied
    to the least of its neighbours and itself, which keeps components and shortens paths.
    """
    ends = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))) if large else edges
    ends = durable(ends.distinct())
    least = durable(ends.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m")))
    # written tables on both sides let Spark split a hub over tasks
    tied = ends.join(least, "x")
    moved = tied.where("y >= x" if large else "y <= x").select(F.col("y").alias("x"), F.col("m").alias("y"))
    return moved.unionByName(least.select("x", F.col("m").alias("y"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", chunk: int = CHUNK_EDGES, last: int = LAST_EDGES) -> DataFrame:
    """(node, component) for every node of an edge; the component is its least node.

    Each task first contracts its edges, ``chunk`` at a time, to stars around the least node, so
    what is shuffled shrinks to a row for each node and chunk. Then large and small star steps
    alternate, with contractions between them, until nothing changes; what is written is a
    table of at most that size in each step, so neither lineage nor driver memory grows. Once
    no more than ``last`` rows are left, which are counted, one task ends it. Null ends are left
    out, loops and repeated edges do no harm.
    """
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    schema = ends.schema
    stars = durable(ends.mapInArrow(_contract(chunk), schema))
    before = None
    while True:
        size = stars.count()
        if size <= last:
            whole = durable(stars.coalesce(1).mapInArrow(_contract(max(last, 1)), schema))
            return whole.select(F.col("x").alias("node"), F.col("y").alias("component"))
        step = durable(_star(durable(_star(stars, True)), False))
        now = step.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if now == before:
            return step.groupBy("x").agg(F.min("y").alias("component")).select(F.col("x").alias("node"), "component")
        before = now
        stars = durable(step.mapInArrow(_contract(chunk), schema).distinct())

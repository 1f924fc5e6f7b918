"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.llm.shared import FILE_ROWS, prepare, stored

EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of some edges but the smallest of its component, and that one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, other = at[:len(a)], at[len(a):]
    top = np.arange(len(nodes))
    while True:
        p, q = top[one], top[other]
        apart = p != q
        if not apart.any():
            under = np.flatnonzero(top != np.arange(len(top)))
            return nodes[under], nodes[top[under]]
        one, other = one[apart], other[apart]
        np.minimum.at(top, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while ((up := top[top]) != top).any():
            top = up


def contracted(most: int):
    """Stars in place of the edges of a task, of at most so many edges at once."""

    def run(batches):
        held, many = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, most):
                part = batch.slice(i, most)
                if held and many + part.num_rows > most:
                    yield starred(held)
                    held, many = [], 0
                held.append(part)
                many += part.num_rows
        if held:
            yield starred(held)

    def starred(held):
        found = stars(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("a", "b")))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], schema=EDGE)

    return run


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most: int = FILE_ROWS) -> DataFrame:
    """(node, root) for each node of ``edges``(a, b): the smallest node it is connected with.

    First each task contracts its own edges, at most ``most`` at once, which settles a graph of no more edges.
    Then stars are contracted in turns: each node's larger neighbours are linked to its smallest one,
    then its smaller ones, until only stars are left, after about log(n) rounds.  Neighbours
    are never gathered: the smallest is an aggregate that is joined back, and each round's
    edges are a written table.  Loops and NULL nodes are left out; repeated edges count once.
    """
    prepare(edges.sparkSession)
    edges = stored(edges.filter("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")), "edges")
    many = edges.count()
    edges = stored(edges.coalesce(max(1, -(-many // most))).mapInArrow(contracted(most), "a long, b long"), "edges")  # a > b
    if many > most:
        edges = turned(stored(edges.distinct(), "edges"))
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def turned(edges: DataFrame) -> DataFrame:
    """The stars that different edges (a, b), a > b, contract to."""
    before = None
    while (now := _fingerprint(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "node")
        large = both.join(least, F.col("a") == F.col("node")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "node")
        small = large.join(lowest, F.col("a") == F.col("node")).select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = stored(small.select("e.*").filter("a <> b").distinct(), "edges")
    return edges

"""Connected components of a distributed graph: forests inside partitions, then large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Edges that a partition's union-find holds at once.
BLOCK = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over the edges: (node, smallest node of its component) for each node that is not the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    root = np.array([find(x) for x in range(len(nodes))], np.int64)
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def shrink() -> None:
        a, b = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        held[:] = [forest(a, b)]

    fresh = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        fresh += batch.num_rows
        if fresh > BLOCK:
            shrink()
            fresh = 0
    if held:
        shrink()
        yield pa.RecordBatch.from_arrays([pa.array(held[0][0], pa.int64()), pa.array(held[0][1], pa.int64())], names=["a", "b"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of the edges; component is the smallest node that it reaches, itself included.

    Each partition's edges first shrink to a forest by union-find. If BLOCK edges or fewer are left, one more union-find
    over them all is the result. Else rounds of large-star and small-star follow until nothing changes; a round is written
    to the shared folder. A node with very many neighbours is no hot group: only
    minima by node are aggregated, with partial sums before the shuffle, and joins on it are dealt by Spark's skew handling.
    Edges with a null end are dropped; loops, repeated and reversed edges do no harm; no edges give no rows.
    """
    edges = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    shrunk = lambda df, label: table(df.mapInArrow(_forests, "a long, b long").distinct().mapInArrow(_forests, "a long, b long"), label)
    star = table(edges.mapInArrow(_forests, "a long, b long"), "edges", thin=True)
    if star.count() <= BLOCK:
        star = table(star.coalesce(1).mapInArrow(_forests, "a long, b long"), "stars")
    while not _stars(star):
        # large star: a node's larger neighbours are joined to its smallest neighbour or itself
        both = star.union(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = shrunk(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b"), "large")
        # small star: a node and its smaller neighbours are joined to the smallest of them
        least = table(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        star = shrunk(small.where("a <> b"), "edges")
    return star.select(F.col("a").alias("node"), F.col("b").alias("component")).union(star.select("b", "b").distinct())


def _stars(star: DataFrame) -> bool:
    """Whether each node but the centres has one edge, which leads to a centre."""
    return star.join(star.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty() and star.groupBy("a").count().where("count > 1").isEmpty()

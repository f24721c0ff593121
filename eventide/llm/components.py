"""Connected components of a link table by alternating star contractions, all in Spark."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.batches import map_batches
from eventide.storage import stash

# Links that a task contracts among themselves at a time.
HELD = 200_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one edge down, to a node that has none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionAll(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return (ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
            .where("down > 1 or down = 1 and up = 1").isEmpty())


def _contracted(edges: DataFrame) -> DataFrame:
    """The same components with fewer and shorter paths: a task ties the nodes of the edges it holds
    to the least node they reach through these edges."""
    def run(batches):
        up: dict = {}

        def root(x):
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        def stars():
            pairs = [(x, r) for x in list(up) if (r := root(x)) != x]
            return pa.RecordBatch.from_arrays(
                [pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                up[max(x, y)] = min(x, y)
            if len(up) >= HELD:
                yield stars()
                up.clear()
        yield stars()
    return map_batches(edges.select("a", "b"), run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node that links reach) for every node of `links` (columns a, b).

    Large star: every neighbour above a node is tied to the node's least neighbour. Small star: the
    neighbours below do the same. Both keep the components; the edges end as one star each. Before
    each round tasks contract what they hold. A node with very many neighbours costs a partial
    minimum and a join that can be split.
    """
    edges = stash(_contracted(links.where("a <> b")).distinct())
    while not _stars(edges):
        pairs = _both_ways(edges)
        least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (pairs.where("b > a").join(least, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where("b <> m")
                 .select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionAll(low.select("a", F.col("m").alias("b"))))
        edges = stash(_contracted(small).distinct())
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)

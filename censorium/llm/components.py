"""Connected components of a link table as Spark jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from censorium.llm.common import discard, saved


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each batch as stars: what is connected inside it points at its smallest node."""
    for batch in batches:
        root: dict[int, int] = {}

        def find(x: int, root: dict[int, int] = root) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        nodes = [x for x in root if find(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)`` that isn't its component's smallest.

    Links are contracted inside tasks first.  Then each pass points every node at the
    smallest neighbour of its neighbourhood (large star) and the rest at their own
    smallest (small star), until nothing moves; both passes are aggregates that combine
    before the shuffle, and the number of passes grows with the logarithm of the longest chain.
    """
    stars = saved(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a != b").mapInArrow(_contracted, "node long, root long").distinct(), "stars")
    while True:
        both = stars.union(stars.select("root", "node")).toDF("node", "other")
        least = both.groupBy("node").agg(F.min("other").alias("low"))
        low = F.least("node", "low")
        # large star: neighbours above a node point at the least of its neighbourhood
        large = both.join(least, "node").where("other > node").select(F.col("other").alias("node"), low.alias("root"))
        # small star: a node's lower neighbours, and itself, point at the lowest of them
        lowest = large.groupBy("node").agg(F.min("root").alias("least"))
        small = large.join(lowest, "node").select(F.explode(F.array(F.struct(F.col("root").alias("node"), F.col("least").alias("root")), F.struct("node", F.col("least").alias("root")))).alias("x")).select("x.*").where("node != root").distinct()
        after = saved(small, "stars")
        # a forest of stars: every node has one root, and no root is a node
        several = after.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        chained = after.select("root").join(after.select(F.col("node").alias("root")), "root", "left_semi")
        done = several.select("node").union(chained.select("root")).isEmpty()
        discard(stars)
        if done:
            return after
        stars = after

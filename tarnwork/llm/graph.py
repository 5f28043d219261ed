"""Connected components by union-find inside partitions and star contraction across them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import discard, written


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while x != r:
            up[x], x = r, up.get(x, x)
        return r

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition -> one edge (member, smallest of its group) for each member: the same components, fewer edges."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
    if forest.up:
        members = list(forest.up)
        yield pa.RecordBatch.from_pydict({"a": pa.array(members, pa.int64()), "b": pa.array([forest.root(x) for x in members], pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """(id, component long) for each id with an edge in `edges` (a, b long): component is the smallest id reachable.

    Each turn makes every edge point to the smallest neighbour (large star, then small star), with aggregations that Spark
    combines before the shuffle, and writes the edges; a star around the smallest id of each component is left. A partition
    holds only its own edges. Loops (a = b) and repeated edges change nothing.
    """
    edges = written(edges.where("a != b").select("a", "b").mapInArrow(_forest, "a long, b long"), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")  # written, so that the join can split a hot node
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        down = written(large, "large")  # a > b
        lower = written(down.groupBy("a").agg(F.min("b").alias("m")), "lower")
        small = down.join(lower, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        new = written(small, "small")
        discard(edges, least, down, lower)
        star = new.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() == 0
        if star and new.join(new.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count() == 0:
            return new.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(new.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        edges = new

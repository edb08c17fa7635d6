"""Connected components of an edge table, by union-find within partitions and star contraction across them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixmine.llm.store import drop, keep

PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


class UnionFind:
    """Disjoint sets whose root is the smallest member."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.parent
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x] = root
            x = p
        return root

    def union(self, x: int, y: int) -> bool:
        """Whether the two were apart."""
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        if x > y:
            x, y = y, x
        self.parent[y] = x
        self.parent.setdefault(x, x)
        return True


def _contract(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Edges to the roots of this partition's sets; starts anew after ``most`` nodes to bound memory."""

    def out(sets: UnionFind) -> pa.RecordBatch:
        nodes = [x for x in sets.parent if sets.find(x) != x]
        return pa.record_batch([pa.array(nodes, pa.int64()), pa.array([sets.find(x) for x in nodes], pa.int64())], schema=PAIR)

    sets = UnionFind()
    for batch in batches:
        for x, y in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            sets.union(x, y)
        if len(sets.parent) > most:
            yield out(sets)
            sets = UnionFind()
    yield out(sets)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long, not null); component: its smallest reachable node.

    Loops and repeated edges do not matter; an empty table gives an empty table. Rounds of large-star and small-star
    contraction need about log(nodes) passes, each of which shuffles one row per remaining edge. The joins have one row per node on
    their right side, so a node with very many edges is split by the adaptive skew join.
    """
    edges = keep(edges.select("a", "b").where("a <> b").mapInArrow(_contract, "a long, b long").distinct(), name)
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = keep(large, name)
        drop(edges)
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = keep(small, name)
        drop(large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

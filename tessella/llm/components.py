"""Connected components of an edge list by alternating stars, as joins and aggregates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Nodes that a task holds while it joins what comes by; then it passes on what it has.
HELD = 1_000_000


def _forest(batches):
    """A row (a, b) with b < a for each edge that a partition needs to connect what its edges connect."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def found():
        pairs = [(x, find(x)) for x in parent]
        pairs = np.array([p for p in pairs if p[0] != p[1]], dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > HELD:
            yield found()
            parent.clear()
    yield found()


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the label is the component's least node.

    Large and small stars in turn: a node's larger neighbours are tied to its least one, then each node to the least
    of its smaller neighbours, until nothing changes. Edges only ever become fewer. Each step is a least neighbour a
    node, summed up before the shuffle, joined to the edges; of one with very many edges, AQE splits the join. Edges
    of a node to itself give a row, an empty list none.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    rest = cut(edges.select("a", "b").mapInArrow(_forest, "a bigint, b bigint").distinct())
    before = None
    while (now := _state(rest)) != before:
        before = now
        both = rest.union(rest.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
        rest = cut(small.mapInArrow(_forest, "a bigint, b bigint").distinct())
    return cut(nodes.join(rest.toDF("node", "label"), "node", "left").select("node", F.coalesce("label", "node").alias("label")))

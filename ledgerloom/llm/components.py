"""Connected components of an edge table, by repeated large-star and small-star steps.

First each task contracts its own edges to a forest. Then every round lets each vertex's
larger neighbours point at its smallest one, and the smaller ones too, which halves the
depth of a chain at least; it ends when a round changes nothing. Rounds are kept as tables
in the shared folder, so the plan does not grow and a lost executor costs a round at most.

Hot vertices: the smallest neighbour is an aggregate with map-side combining. Vertices with
more than ``HOT`` neighbours, and more than the ``MOST``-th part of all edges, are at most
2 * ``MOST``: these few are broadcast to their edges, which stay where they are, and only the
edges of other vertices are shuffled to meet their smallest neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import Scratch

EDGES = "a long, b long"
#: A task contracts so many edges at a time.
CHUNK = 1_000_000
HOT, MOST = 256, 8192


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while (up := root.get(x, x)) != top:
            root[x], x = top, up
        return top

    def out() -> pa.RecordBatch:
        pairs = [(x, find(x)) for x in root]
        pairs = [(x, y) for x, y in pairs if x != y]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
        if len(root) > CHUNK:
            yield out()
            root.clear()
    if root:
        yield out()


def _star(edges: DataFrame, count: int) -> DataFrame:
    """Every neighbour of a vertex, and the vertex, points at the smallest of them all."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("n"))
    bound = max(HOT, count // MOST)
    hot = F.broadcast(least.filter(F.col("n") > bound).select("a", "m"))
    near = both.join(hot, "a").unionByName(both.join(hot.select("a"), "a", "left_anti").join(least.filter(F.col("n") <= bound).select("a", "m"), "a"))
    far = near.select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return far.unionByName(own).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, scratch: Scratch, label: str = "components") -> DataFrame:
    """(a, b): each vertex that isn't the smallest of its component, and the smallest."""
    edges = scratch.keep(f"{label}-0", edges.select("a", "b").filter("a <> b").mapInArrow(_forest, EDGES))
    k = 0
    while True:
        # done when every vertex points at one other and none is both pointed at and pointing
        state = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        wrong = state.groupBy("v").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).filter("up > 1 OR up = 1 AND down > 0")
        if not wrong.limit(1).count():
            return edges
        k += 1
        edges = scratch.keep(f"{label}-{k}", _star(edges, edges.count()))
        scratch.drop(f"{label}-{k - 1}")

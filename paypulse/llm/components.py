"""Connected components of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paypulse.llm.shared import cut

#: Edges that one task reads. A round's tasks follow the edges, not the shuffle partitions: each task leaves files on disk.
EDGES_A_TASK = 100_000


def _both(*rows: Column) -> Column:
    """A row for each of the structs, in one pass over the rows where a union would take two."""
    return F.inline(F.array(*rows))


def _pair(a: str, b: str) -> Column:
    return F.struct(F.col(a).alias("a"), F.col(b).alias("b"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (larger ones, or smaller ones and itself) are hung on its smallest neighbour."""
    if large:
        sides = edges.select(_both(_pair("a", "b"), _pair("b", "a")))
    else:
        sides = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = sides.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(_both(_pair("b", "m"), _pair("a", "m")))
    return out.where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple[int, bool]:
    """How many edges there are, and whether every node hangs on one root and no root hangs on another."""
    ends = edges.select(
        _both(
            F.struct(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(False).alias("holds")),
            F.struct(F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(True).alias("holds")),
        )
    )
    nodes = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    found = nodes.agg(F.sum("hangs").alias("edges"), F.count_if(F.expr("hangs > 1 or (hangs = 1 and holds)")).alias("open")).first()
    return found.edges or 0, found.open == 0


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``links`` (a, b); component is the smallest node reachable.

    Links may be repeated, in either direction or loops; nodes are not null. Each round is written to the shared
    folder. The number of rounds is logarithmic in the size of the largest component; no node's neighbours are gathered.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        count, done = _state(edges)
        if done:
            break
        # Neither star makes more edges than twice those it gets.
        tasks = -(-count // EDGES_A_TASK)
        edges = _star(edges.coalesce(tasks), large=True).coalesce(tasks)
        edges = cut(_star(edges, large=False).coalesce(tasks))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )

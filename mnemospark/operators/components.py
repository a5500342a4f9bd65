"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.session import Scratch


def _star(pairs: DataFrame, small: bool) -> DataFrame:
    """One star step on (u, v). Every neighbourhood is reduced by aggregation and a join, never listed."""
    if small:
        arcs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        arcs = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = arcs.join(low, "u")
    if small:
        out = joined.select(F.col("v").alias("a"), "m").unionByName(low.select(F.col("u").alias("a"), "m"))
    else:
        out = joined.where("v > u").select(F.col("v").alias("a"), "m")
    return out.where("a <> m").select(F.col("a").alias("u"), F.col("m").alias("v")).distinct()


def in_one_task(edges: DataFrame) -> DataFrame:
    """components() of a bounded list of links, for callers who know its bound: lazy, one task."""
    kind = edges.schema["a"].dataType.simpleString()
    links = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    return links.where("u <> v").coalesce(1).mapInArrow(_in_one_task, f"node {kind}, root {kind}")


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a bounded list of links, the smaller root kept."""
    root: dict = {}

    def find(x):
        top = x
        while root[top] != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    kind = None
    for b in batches:
        kind = b.schema.field("u").type
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
            root.setdefault(u, u)
            root.setdefault(v, v)
            x, y = find(u), find(v)
            if x != y:
                root[max(x, y)] = min(x, y)
    if root:
        nodes = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], names=["node", "root"])


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60, links_in_task: int = 200_000) -> DataFrame:
    """(node, root) for every node of `edges` (columns a, b of one orderable type).

    root is the smallest node of the component. Self-links, repeated and reversed links are
    allowed; a null end drops the link. Up to `links_in_task` links are solved in one task, more by rounds of
    star steps, whose number grows with the logarithm of the longest chain.
    Each round is written to the shared folder, so a lost executor costs one round.
    Convergence is seen from two figures (count and a hash sum), nothing else reaches the driver.
    """
    nodes_only = edges.where("a IS NOT NULL AND b IS NOT NULL")
    pairs = scratch.save(nodes_only.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if pairs.count() <= links_in_task:
        kind = pairs.schema["u"].dataType.simpleString()
        return scratch.save(pairs.coalesce(1).mapInArrow(_in_one_task, f"node {kind}, root {kind}"))
    seen = None
    for _ in range(max_rounds):
        new = scratch.save(_star(_star(pairs, small=False), small=True))
        scratch.drop(pairs)
        pairs = new
        figure = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if figure == seen:
            break
        seen = figure
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

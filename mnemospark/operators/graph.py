"""Temporal graph: bounded expansion, current and past state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.session import Scratch

MAX_HOPS = 4


def expand(edges: DataFrame, starts: list[str], hops: int = 2, per_node: int | None = None) -> DataFrame:
    """(node, hop): nodes within hops + 1 levels of the starts, hop 0 for the starts, over edges both ways.

    hops is kept within 1 and MAX_HOPS. With per_node only the first edges of a node, by rel_id, are
    followed; the partial top-k runs before the shuffle. Each level joins the frontier with the
    edges and drops nodes met before; levels are written out, so a lost executor costs one level.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark)
    hops = max(1, min(hops, MAX_HOPS))
    arcs = edges.select("rel_id", F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(edges.select("rel_id", F.col("dst").alias("node"), F.col("src").alias("other")))
    seen = spark.createDataFrame([(s, 0) for s in dict.fromkeys(starts)], "node string, hop int")
    front = seen.select("node")
    for level in range(1, hops + 2):
        near = arcs.join(F.broadcast(front) if level == 1 else front, "node")
        if per_node:
            near = near.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("rel_id"))).where(F.col("r") <= per_node)
        new = scratch.save(near.select(F.col("other").alias("node")).distinct().join(seen, "node", "left_anti"))
        seen = seen.unionByName(new.withColumn("hop", F.lit(level)))
        front = new
    return seen


def closed_by_next(facts: DataFrame, key: list[str]) -> DataFrame:
    """facts(.., valid_from, rel_id) with valid_until: the start of the key's next fact, null while it holds."""
    return facts.withColumn("valid_until", F.lead("valid_from").over(Window.partitionBy(*key).orderBy("valid_from", "rel_id")))


def as_of(facts: DataFrame, key: list[str], when: str) -> DataFrame:
    """The fact of each key that holds at `when`; an aggregate, so a hot key is combined map-side."""
    rest = [c for c in facts.columns if c not in key]
    held = facts.where(F.col("valid_from") <= F.lit(when).cast("timestamp_ntz"))
    return held.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("valid_from", "rel_id")).alias("f")).select(*key, "f.*")

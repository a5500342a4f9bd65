"""Running totals per group that survive a group of any size.

A plain window gathers a group in one task. Here rows are range-partitioned by group and order, a
window runs only over the part of a group that lies in one partition, and the parts are joined by
the totals of the parts before, of which there are at most as many as partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.session import Scratch


def running_total(df: DataFrame, group: list[str], order: list[str], totals: dict[str, Column], rows_per_task: int = 100_000) -> DataFrame:
    """df with a column per entry of `totals`: the sum up to and including the row, nulls counting 0.

    `order` must tell rows of a group apart, else ties fall in any order. Null groups and null
    order values (first) are groups and values like others; an empty df stays empty.
    """
    scratch = Scratch(df.sparkSession)
    parts = max(1, -(-df.count() // rows_per_task))
    plain = df.select("*", *[F.coalesce(e, F.lit(0)).alias(f"_{c}") for c, e in totals.items()])
    cut = scratch.save(plain.repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id()))
    local = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = cut.groupBy("_part", *group).agg(*[F.sum(f"_{c}").alias(f"_{c}") for c in totals])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    skips = whole.select("_part", *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_s_{c}") for c in totals])
    same = F.col("_part") == F.col("_part2")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    summed = cut.select(*df.columns, "_part", *[F.sum(f"_{c}").over(local).alias(f"_r_{c}") for c in totals])
    return summed.join(skips.withColumnRenamed("_part", "_part2"), same).select(*df.columns, *[(F.col(f"_r_{c}") + F.col(f"_s_{c}")).alias(c) for c in totals])

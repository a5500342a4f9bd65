"""Which texts stand whole inside which others, without comparing all with all.

Texts have the smallest hash of the grams in every window of LEAST characters as keys. A text that stands in another brings
all its windows along, so the other one has all its keys: it is looked for by the one that the fewest others have, and not at
all if none has one of them. What shares that key is verified. Texts shorter than a window are joined on runs of
their own length, for the lengths that occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.operators.similarity import mixed
from mnemospark.session import Scratch

LEAST, GRAM = 24, 8


def window_keys(text: str, all_windows: bool) -> np.ndarray:
    """Keys of all windows, or of the first one; none for a text shorter than a window."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(code) < LEAST:
        return np.empty(0, np.int64)
    if not all_windows:
        code = code[:LEAST]
    n = len(code) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(1_000_003) + code[k : k + n]
    least = np.lib.stride_tricks.sliding_window_view(mixed(h), LEAST - GRAM + 1).min(1)
    return np.unique(least).view(np.int64)


def _keys(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [window_keys(t, True) for t in b.column("text").to_pylist()]
            at = np.repeat(np.arange(b.num_rows), [len(k) for k in keys])
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), b.column("row").take(pa.array(at))], names=["key", "row"])

    return df.select("row", "text").mapInArrow(run, "key bigint, row bigint")


def meeting(inner: DataFrame, outer: DataFrame, scratch: Scratch) -> DataFrame:
    """(i, o): rows of inner(row, text) and outer(row, text) to be compared.

    Many texts begin alike, so one is looked for by its seldomest key, and not at all if no outer text has one of its keys.
    """
    x, y = _keys(inner), scratch.save(_keys(outer))
    held = y.groupBy("key").agg(F.count("*").alias("n"))
    seldom = x.join(held, "key", "left").groupBy("row").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("key"))).alias("k")).where("k.n > 0")
    return seldom.select(F.col("row").alias("i"), F.col("k.key").alias("key")).join(y.withColumnRenamed("row", "o"), "key").select("i", "o")


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner_id, outer_id): texts inner(id, text) that stand in outer(id, text), which may be the same text.

    Ids are strings. Null and empty texts and null ids give nothing; repeated rows give one pair.
    """
    scratch = Scratch(inner.sparkSession)
    told = lambda df: scratch.save(df.where("id IS NOT NULL AND text <> ''").select(F.col("id").cast("string").alias("id"), "text").distinct().withColumn("row", F.monotonically_increasing_id()))
    inner, outer = told(inner), told(outer)
    short = inner.where(F.length("text") < LEAST)
    met = meeting(inner.where(F.length("text") >= LEAST), outer, scratch)
    side = lambda df, name, row: df.select(F.col("row").alias(row), F.col("id").alias(f"{name}_id"), F.col("text").alias(f"{name}_text"))
    long = met.join(side(inner, "inner", "i"), "i").join(side(outer, "outer", "o"), "o").where("contains(outer_text, inner_text)").select("inner_id", "outer_id")
    lengths = sorted(r[0] for r in short.select(F.length("text")).distinct().collect())  # under LEAST of them
    runs = outer.select(F.col("id").alias("outer_id"), F.lit(None).cast("string").alias("text")).where(F.lit(False))
    for n in lengths:
        at = F.explode(F.sequence(F.lit(1), F.length("text") - n + 1)).alias("at")
        cut = outer.where(F.length("text") >= n).select("id", "text", at)
        runs = runs.unionByName(cut.select(F.col("id").alias("outer_id"), F.expr(f"substring(text, at, {n})").alias("text")).distinct())
    brief = runs.join(short.withColumnRenamed("id", "inner_id"), "text").select("inner_id", "outer_id")
    return long.unionByName(brief).distinct()

"""Greedy batches of turns: at most so many turns and characters, never across sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def greedy_batches(turns: DataFrame, group: list[str], order: list[str], id_col: str, size: str, max_turns: int, max_chars: int) -> DataFrame:
    """(*group, id_col, batch): batch numbers from 0 within a group, in order.

    A batch closes when the next turn would exceed a limit; a turn larger than max_chars is a batch
    alone. Null sizes count 0. The limits reset at each close, so a group is read in order, but as
    a sorted stream: a task holds one Arrow batch at a time, however long the group is.
    """
    fields = ", ".join(f"`{c}` {turns.schema[c].dataType.simpleString()}" for c in [*group, id_col])
    slim = turns.select(*group, *[c for c in order if c not in group and c != id_col], id_col, F.coalesce(size, F.lit(0)).cast("long").alias("_size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, number, count, chars = None, 0, 0, 0
        for b in batches:
            out = []
            keys = zip(*[b.column(c).to_pylist() for c in group])
            for key, n in zip(keys, b.column("_size").to_pylist()):
                if key != here:
                    here, number, count, chars = key, 0, 0, 0
                elif count >= max_turns or chars + n > max_chars:
                    number, count, chars = number + 1, 0, 0
                count, chars = count + 1, chars + n
                out.append(number)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in [*group, id_col]], pa.array(out, pa.int64())], [*group, id_col, "batch"])

    return slim.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(run, fields + ", batch bigint")

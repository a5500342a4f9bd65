"""The extraction loop: pending turns in batches, an injected extractor, its answers read back, progress by session."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions import memory as m
from mnemospark.functions.text import is_blank
from mnemospark.operators.batches import greedy_batches
from mnemospark.session import Scratch

#: Characters that are kept of a claim and of a turn in a prompt, turns and characters of a batch.
CLAIM_CHARS, TURN_CHARS, BATCH_TURNS, BATCH_CHARS = 400, 800, 12, 4000

_ANSWER = "tool_calls string, function_call string, candidates array<struct<type:string,claim:string,context:string,user_request:string,result:string,source_class:string,turn_ids:array<string>>>"


def parsed_answer(answer: Column) -> Column:
    """The candidates of a model's answer, null if it holds none: fences are cut off, and text around an object is tolerated.

    An answer in the form of a tool call is data that is not acted on; it gives nothing.
    """
    bare = F.trim(F.regexp_replace(F.trim(answer), r"(?im)^```(?:json)?\s*|\s*```$", ""))
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    got = F.from_json(F.when(bare.startswith("{") & bare.endswith("}"), bare).otherwise(inner), _ANSWER)
    return F.when(F.coalesce(got["tool_calls"], got["function_call"]).isNull(), got["candidates"])


def candidates_of(answers: DataFrame) -> DataFrame:
    """(batch_id, n, item_type, claim, turn_ids, source_class) of answers(batch_id, answer, allowed).

    Claims are collapsed and cut, an episode without one has its context or request; types other than belief and episode, empty
    claims, control text and rows that cite none of the allowed turns are left out; citations are distinct, in order.
    """
    short = lambda c: F.substring(m.collapsed(F.coalesce(c, F.lit(""))), 1, CLAIM_CHARS)
    rows = answers.select("batch_id", "allowed", F.posexplode(parsed_answer(F.col("answer"))).alias("n", "c"))
    kind = F.lower(F.trim(F.coalesce(F.nullif(F.col("c.type"), F.lit("")), F.lit("belief"))))
    claim = short(F.col("c.claim"))
    claim = F.when((kind == "episode") & (claim == ""), short(F.coalesce(F.nullif(F.col("c.context"), F.lit("")), F.col("c.user_request")))).otherwise(claim)
    plain = F.lower(F.trim(F.coalesce("c.source_class", F.lit(""))))
    cited = F.array_distinct(F.filter(F.coalesce("c.turn_ids", F.array().cast("array<string>")), lambda x: F.array_contains("allowed", x)))
    out = rows.select("batch_id", F.col("n").cast("long").alias("n"), kind.alias("item_type"), claim.alias("claim"), cited.alias("turn_ids"), F.when(plain.isin("user_explicit", "document"), "document").otherwise("agent_inference").alias("source_class"))
    return out.where(F.col("item_type").isin("belief", "episode") & (F.col("claim") != "") & ~F.col("claim").rlike(m.CONTROL) & (F.size("turn_ids") > 0))


def extract(turns: DataFrame, progress: DataFrame, extractor: Callable[[list[str]], list[str | None]]) -> tuple[DataFrame, DataFrame]:
    """(candidates, progress) of the turns that come after progress(session_id, seq).

    turns(session_id, turn_id, seq, role, content); blank ones are passed over. `extractor` gets the prompts of some batches and gives an
    answer or None for each; it runs on the executors. A batch without an answer isn't passed: progress of its session
    stops before it, and the next call begins there. candidates are those of candidates_of(), with session_id and batch.
    """
    scratch = Scratch(turns.sparkSession)
    seen = progress.groupBy("session_id").agg(F.max("seq").alias("upto"))
    t = turns.join(seen, "session_id", "left").where(F.col("upto").isNull() | (F.col("seq") > F.col("upto"))).drop("upto")
    t = t.where(~is_blank(F.col("content"))).select("session_id", "turn_id", "seq", F.concat_ws(" ", F.concat(F.lit("["), "turn_id", F.lit("]")), F.concat(F.coalesce("role", F.lit("unknown")), F.lit(":")), m.truncate(F.col("content"), TURN_CHARS)).alias("line"))
    packed = greedy_batches(t.withColumn("n", F.length("line")), ["session_id"], ["seq", "turn_id"], "turn_id", "n", BATCH_TURNS, BATCH_CHARS)
    # a batch is bounded, so its turns may be gathered
    batches = packed.join(t, ["session_id", "turn_id"]).groupBy("session_id", "batch").agg(F.array_sort(F.collect_list(F.struct("seq", "turn_id", "line"))).alias("l"), F.max("seq").alias("last"))
    asked = batches.select("session_id", "batch", "last", F.col("l.turn_id").alias("allowed"), F.array_join("l.line", "\n").alias("prompt"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            answers = extractor(b.column("prompt").to_pylist()) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("session_id", "batch", "last", "allowed")], pa.array(answers, pa.string())], names=["session_id", "batch", "last", "allowed", "answer"])

    kind = turns.schema["seq"].dataType.simpleString()
    told = scratch.save(asked.mapInArrow(run, f"session_id string, batch bigint, last {kind}, allowed array<string>, answer string"))
    broken = told.where("answer IS NULL").groupBy("session_id").agg(F.min("batch").alias("stop"))
    passed = told.join(broken, "session_id", "left").where("stop IS NULL OR batch < stop")
    done = passed.groupBy("session_id").agg(F.max("last").alias("seq"))
    after = progress.select("session_id", "seq").unionByName(done).groupBy("session_id").agg(F.max("seq").alias("seq"))
    named = passed.select(F.struct("session_id", "batch").alias("batch_id"), "answer", "allowed")
    return candidates_of(named).select("batch_id.*", "n", "item_type", "claim", "turn_ids", "source_class"), after

"""Memories as append-only facts: nothing is updated in place, the current state is a fold.

A fact names an id, a sequence number, an action and the fields it sets; fields it leaves null keep
their value. The facts are the audit log as well, give history and past states for free, and
suit a store without row updates. Every fold is an aggregation with map-side combining.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions import memory as m

FIELDS = {"claim": "string", "kind": "string", "confidence": "double", "importance": "double", "status": "string", "source_class": "string", "superseded_by": "string", "quarantined": "boolean"}
FACT = "id string, seq bigint, at timestamp_ntz, action string, " + ", ".join(f"{k} {t}" for k, t in FIELDS.items())


def facts_of(df: DataFrame, action: str, seq: Column, at: Column, **fields: Column) -> DataFrame:
    """Facts for the rows of df(id, ..): the named fields are set, the others stay."""
    return df.select("id", seq.cast("bigint").alias("seq"), at.cast("timestamp_ntz").alias("at"), F.lit(action).alias("action"), *[fields[k].cast(t).alias(k) if k in fields else F.lit(None).cast(t).alias(k) for k, t in FIELDS.items()])


def current(facts: DataFrame, until: int | None = None) -> DataFrame:
    """(id, version, *fields) after all facts, or those up to a sequence number; purged ids are gone.

    The last non-null value of each field holds; of facts with one number the later action name counts.
    """
    seen = facts if until is None else facts.where(F.col("seq") <= until)
    order = F.struct("seq", "action")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order))
    state = seen.groupBy("id").agg(F.count("*").alias("version"), F.max_by("action", order).alias("_last"), *[last(c).alias(c) for c in FIELDS])
    return state.where("_last <> 'purge'").drop("_last")


def next_ids(existing: DataFrame, new: DataFrame, prefix: str, order: list[str]) -> DataFrame:
    """new with ids that go on from the largest of existing(id), dense and by the given order.

    Ranks come from a running total over range-sorted partitions, so no task holds all rows.
    """
    from mnemospark.operators.running import running_total

    top = existing.agg(F.coalesce(F.max(F.substring("id", len(prefix) + 2, 30).cast("bigint")), F.lit(0)).alias("top")).first()["top"]
    ranked = running_total(new.withColumn("_all", F.lit(0)), ["_all"], order, {"_rank": F.lit(1).cast("long")}).drop("_all")
    return ranked.withColumn("id", F.concat(F.lit(prefix + "-"), F.lpad((F.col("_rank") + top).cast("string"), 10, "0"))).drop("_rank")


def supersede(state: DataFrame, pairs: DataFrame, seq: int, at: str, by_user: bool = False) -> DataFrame:
    """Facts that retire old ids in favour of new ones: pairs(id, new_id). Protected rows stay unless a user asks."""
    hit = state.join(pairs, "id").where("status = 'active'")
    if not by_user:
        hit = hit.where(m.protection(F.lit(None).cast("string"), F.col("source_class"), F.col("quarantined"), F.col("confidence")) == "")
    return facts_of(hit, "supersede", F.lit(seq), F.lit(at), status=F.lit("superseded"), superseded_by=F.col("new_id"))


def reinforce(state: DataFrame, ids: DataFrame, seq: int, at: str, delta: float = 0.04) -> DataFrame:
    """Facts that raise the confidence of active ids by delta for each time they are named, .98 at most."""
    named = ids.groupBy("id").agg(F.count("*").alias("times"))
    hit = state.join(named, "id").where("status = 'active'")
    return facts_of(hit, "reinforce", F.lit(seq), F.lit(at), confidence=F.least(F.lit(0.98), F.coalesce("confidence", F.lit(0.0)) + F.lit(delta) * F.col("times")))


def set_status(state: DataFrame, ids: DataFrame, status: str, seq: int, at: str) -> DataFrame:
    """Facts that archive, restore or otherwise set the status of known ids."""
    return facts_of(state.join(ids.select("id").distinct(), "id"), status, F.lit(seq), F.lit(at), status=F.lit(status))


def purge(state: DataFrame, ids: DataFrame, seq: int, at: str) -> DataFrame:
    """Tombstones; compact() then drops all facts of these ids."""
    return facts_of(state.join(ids.select("id").distinct(), "id"), "purge", F.lit(seq), F.lit(at))


def compact(facts: DataFrame) -> DataFrame:
    """Facts without those of purged ids."""
    return facts.join(facts.where("action = 'purge'").select("id").distinct(), "id", "left_anti")


def history(facts: DataFrame, n: int = 20) -> DataFrame:
    """The newest n changes."""
    return facts.orderBy(F.desc("seq"), F.desc("id")).select("seq", "at", "action", "id").limit(n)

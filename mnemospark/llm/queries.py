"""Queries of the training-data operators over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import canonical, conversations, history, leaks, near, oracles, reading, survivor, tokens
from mnemospark.session import Scratch, table


def _beliefs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "beliefs").select(F.col("belief_id").alias("id"), "claim")


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return _beliefs(spark, d).unionByName(table(spark, d, "candidates").select(F.col("candidate_id").alias("id"), "claim"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every evidence value counts here, as the table's statement asks, so no source is judged; p2_merged and p2_sources do that."""
    best = survivor.best_records(table(spark, d, "beliefs"), table(spark, d, "source_trust"), min_truth=None)
    return best.select("group_id", "survivor_id", "confidence_from", "n_evidence")


def p2_merged(spark: SparkSession, d: str) -> DataFrame:
    """Merged records that keep the evidence judged true by the source model."""
    best = survivor.best_records(table(spark, d, "beliefs"), table(spark, d, "source_trust"), min_truth=0.5)
    return best.select("group_id", "members", "survivor_id", "confidence", F.array_join("evidence", ",").alias("evidence"), F.round("truth", 3).alias("truth"))


def p2_sources(spark: SparkSession, d: str) -> DataFrame:
    """What the model makes of each source: how much of the truth it states, how much falsehood it leaves out."""
    q = survivor.source_quality(table(spark, d, "beliefs"), table(spark, d, "source_trust"))
    return q.select("source_class", F.round("sensitivity", 3).alias("sensitivity"), F.round("specificity", 3).alias("specificity"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversations(table(spark, d, "turns"))


def p3_threads(spark: SparkSession, d: str) -> DataFrame:
    """The link trees of every session, declared and guessed links together."""
    return conversations.threads(table(spark, d, "turns"))


def digest(sha256):
    """The hexadecimal digits of a hash, whatever its case, blanks and prefix; null without 64 of them."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(sha256), r"^[^\p{L}\p{N}]*sha-?256", ""), r"[^0-9a-f]+", "")
    return F.when(F.length(bare) == 64, bare)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Beliefs are the history; candidates and archives arrive batch by batch, in order of batch_no, each probing and extending the index."""
    none = F.lit(None).cast("string")
    index = history.HistoryIndex.create(spark)
    index.accept(_beliefs(spark, d).select("id", F.col("claim").alias("text"), none.alias("digest")))
    new = table(spark, d, "candidates").select(F.col("candidate_id").alias("id"), F.col("claim").alias("text"), none.alias("digest"), "batch_no")
    new = new.unionByName(table(spark, d, "archives").select(F.col("archive_id").alias("id"), none.alias("text"), digest(F.col("sha256")).alias("digest"), "batch_no"))
    # one number per arrival, as many as there are calls below
    for number in sorted({r[0] for r in new.select("batch_no").distinct().collect()}, key=lambda b: (b is None, b or 0)):
        index.accept(new.where(F.col("batch_no").eqNullSafe(F.lit(number))).drop("batch_no"))
    repeats = Scratch(spark).save(index.labels().where("NOT startswith(id, 'B-')").select(F.col("first_id"), F.col("id").alias("dup_id")))
    index.drop()
    return repeats


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = near.group_pairs(near.near_groups(_beliefs(spark, d)))
    return pairs.select(F.col("id_a").alias("belief_id_a"), F.col("id_b").alias("belief_id_b"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per belief with its group and the first belief of its word set."""
    return near.near_groups(_beliefs(spark, d)).select(F.col("id").alias("belief_id"), "group_id", F.col("rep").alias("class_id"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.count_copies(_claims(spark, d)).where("copies > 1").select("first_id", "copies")


def p8_ids(spark: SparkSession, d: str, vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken") -> DataFrame:
    return tokens.encode_texts(table(spark, d, "documents"), vocabulary)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_report(spark, d).select("doc_id", "item_id")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Which items each document leaks, how many of their words it holds, and how many of their expected answers."""
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_merged, p2_sources, p3_found, p3_threads, p4_found, p5_found, p5_groups, p6_found, p8_ids, p9_found, p9_report, p10_found)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)

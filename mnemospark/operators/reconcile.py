"""New claims against known ones: best match and a decision in one of seven classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.functions import memory as m
from mnemospark.operators.overlap import best_of, ranked
from mnemospark.session import Scratch

#: Least content words, and the similarities that the classes ask for.
LEAST_WORDS, LEAST_CONFIDENCE, FAINT, WEAK, CLOSE, REFINED, NEAR, SAME = 3, 0.25, 0.18, 0.35, 0.40, 0.50, 0.75, 0.92


def _forms(df: DataFrame) -> DataFrame:
    """df with the strict form of its claims, made once, and what is read off it."""
    form = F.col("form")
    once = df.withColumn("form", m.strict_claim(F.col("claim")))
    return once.select("*", F.array_sort(m.form_words(form)).alias("words"), m.has_cue(form, m.NEGATIONS).alias("neg"), m.has_cue(form, m.REPLACEMENT_CUES).alias("cue"))


def classify(new: DataFrame, known: DataFrame, fold: bool = False) -> DataFrame:
    """(id, classification, matched_id, similarity) of new(id, claim, evidence[, confidence]) against known(id, claim, at, evidence).

    The match is the most similar known claim, the oldest of equals, compared on distinct content
    words; it is named from similarity WEAK on. Below that a class only needs to know whether
    anything reaches FAINT, which the same scan tells. Equal word sets are compared once.

    With `fold`, a new claim is also compared with all new ones before it by (at, id), which come
    after the known ones where similarities are equal; new then has `at` too. Only the first claim
    of a word set is searched for: that one is the match of all later ones, unless a known claim is.
    """
    scratch = Scratch(new.sparkSession)
    n = scratch.save(_forms(new))
    k = scratch.save(_forms(known))
    usable = F.size("words") >= LEAST_WORDS
    oldest = lambda df, late: df.where(F.size("words") > 0).groupBy("words").agg(F.min(F.struct("at", "id")).alias("o")).select("words", F.concat(F.lit(late), "o.id").alias("rep"), F.lit(late).alias("late"), "o.at", "o.id")
    right = oldest(k, 0)
    if fold:
        right = right.unionByName(oldest(n, 1))
    right = ranked(right, scratch, "late", "at", "id")
    left = right.where("late = 1").where(usable).select("words", F.col("id").alias("rep"), F.col("rank").alias("before")) if fold else n.where(usable).groupBy("words").agg(F.min("id").alias("rep")).withColumn("before", F.lit(2**63 - 1))
    left = scratch.save(left)
    best = best_of(left, right, scratch, WEAK, FAINT).join(right.select("rank", "late", F.col("id").alias("matched_id")), "rank", "left").withColumn("faint", F.lit(True)).drop("rank")

    mates = lambda df, late: df.select(F.lit(late).alias("late"), F.col("id").alias("matched_id"), F.col("form").alias("m_form"), F.col("words").alias("m_words"), F.col("neg").alias("m_neg"), F.col("evidence").alias("m_evidence"))
    mate = mates(k, 0).unionByName(mates(n, 1).dropDuplicates(["matched_id"])) if fold else mates(k, 0)
    judged = left.select("words", "rep").join(best, "rep", "left")
    all_ = n.join(judged, "words", "left")
    if fold:
        later = (F.col("id") != F.col("rep")) & (F.coalesce("similarity", F.lit(0.0)) < 1)
        one = lambda c, value: F.when(later, value).otherwise(F.col(c)).alias(c)
        all_ = all_.select(*n.columns, "faint", one("similarity", F.lit(1.0)), one("late", F.lit(1)), one("matched_id", F.col("rep")))
    all_ = all_.join(mate, ["late", "matched_id"], "left")
    sim, same = F.coalesce("similarity", F.when(F.col("faint"), FAINT).otherwise(0.0)), F.col("neg") == F.col("m_neg")
    shared, mine, theirs = F.size(F.array_intersect("words", "m_words")), F.size("words"), F.size("m_words")
    covered = ((F.size("evidence") > 0) & (F.size(F.array_except("evidence", "m_evidence")) == 0)) | ((F.size("evidence") == 0) & (F.size("m_evidence") == 0))
    equal = (F.col("form") == F.col("m_form")) | ((sim >= SAME) & same)
    unsure = F.coalesce(F.nanvl("confidence", F.lit(0.0)) < LEAST_CONFIDENCE, F.lit(False)) if "confidence" in new.columns else F.lit(False)
    klass = (
        F.when((mine < LEAST_WORDS) | unsure, "low-confidence")
        .when(sim < FAINT, "irrelevant")
        .when(equal, F.when(covered, "duplicate").otherwise("reinforcement"))
        .when(~same & (sim >= CLOSE), "contradiction")
        .when(F.col("cue") & (sim >= WEAK), "supersession")
        .when(same & (sim >= CLOSE) & (shared > 0) & (shared < mine) & (shared < theirs), "contradiction")
        .when(same & (sim >= REFINED) & (mine != theirs) & (shared == F.least(mine, theirs)), "update")
        .when(same & (sim >= NEAR), "reinforcement")
        .when(sim < CLOSE, "low-confidence")
        .otherwise("irrelevant")
    )
    return all_.select("id", klass.alias("classification"), "matched_id", "similarity")

"""Queries over the scalar rules: claim forms, redaction, rendering, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import memory as m
from mnemospark.plans.base import B_SQL, EP_SQL, T_SQL, beliefs, collapsed_sql, episodes, literal, normal_sql, query, strict_sql, turns
from mnemospark.session import table

AS_OF = "2026-09-01 00:00:00"
EVENTS_AS_OF = "2024-02-01 00:00:00"

CONTENT_SQL = f"list_filter(regexp_extract_all({strict_sql('claim')}, '[a-z0-9'']+'), lambda x: NOT list_contains({literal(m.STOPWORDS)}, x))"


def cue_sql(padded: str, cues: list[str]) -> str:
    return "(" + " OR ".join(f"contains({padded}, '{c.replace(chr(39), chr(39) * 2)}')" for c in cues) + ")"


NEGATED_SQL = cue_sql(f"(' ' || {strict_sql('claim')} || ' ')", m.NEGATIONS)
LOOSE_SQL = cue_sql(f"(' ' || {normal_sql('claim')} || ' ')", m.NEGATIONS_LOOSE)
CUE_SQL = cue_sql(f"(' ' || {strict_sql('claim')} || ' ')", m.REPLACEMENT_CUES)


@query(f"""WITH {B_SQL} SELECT belief_id, {normal_sql('claim')} AS normal, {strict_sql('claim')} AS strict, len(list_distinct({CONTENT_SQL})) AS n_content,
 {NEGATED_SQL} AS negated, {LOOSE_SQL} AS negated_loose, {CUE_SQL} AS replaces, sha256({normal_sql('claim')}) AS digest FROM b WHERE claim IS NOT NULL""")
def claim_forms(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "beliefs").select("belief_id", "claim").dropDuplicates(["belief_id"]).where("claim IS NOT NULL")
    once = once.select("belief_id", m.normal_claim(F.col("claim")).alias("normal"), m.strict_claim(F.col("claim")).alias("strict"))
    normal, strict = F.col("normal"), F.col("strict")
    return once.select(
        "belief_id", "normal", "strict", F.size(m.form_words(strict)).cast("long").alias("n_content"), m.has_cue(strict, m.NEGATIONS).alias("negated"), m.has_cue(normal, m.NEGATIONS_LOOSE).alias("negated_loose"),
        m.has_cue(strict, m.REPLACEMENT_CUES).alias("replaces"), F.sha2(normal, 256).alias("digest"),
    )


def _redact_sql(x: str) -> str:
    for kind, pattern in m.SECRETS:
        x = f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '[REDACTED:{kind}]', 'g')"
    return x


@query(f"""SELECT doc_id, {_redact_sql('text')} <> text AS secret, length({_redact_sql('text')}) AS n_after, sha256({_redact_sql('text')}) AS digest FROM documents WHERE text IS NOT NULL""")
def redacted_documents(spark: SparkSession, d: str) -> DataFrame:
    safe = m.redact(F.col("text"))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", (safe != F.col("text")).alias("secret"), F.length(safe).cast("long").alias("n_after"), F.sha2(safe, 256).alias("digest"))


@query(f"""SELECT doc_id, CASE WHEN length(text) > 400 THEN left(text, {400 - len(m.TRUNCATED)}) || '{m.TRUNCATED}' ELSE text END AS cut, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL""")
def truncated_documents(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", m.truncate(t, 400).alias("cut"), m.token_estimate(t).alias("tokens"))


_NEUTRAL_SQL = collapsed_sql("text")
_NEUTRAL_SQL = f"replace(replace({_NEUTRAL_SQL}, '<', '\\u003c'), '>', '\\u003e')"
_NEUTRAL_SQL = f"regexp_replace({_NEUTRAL_SQL}, '^\\[([^\\]]{{0,159}})\\]', '\\\\u005b\\1\\\\u005d')"
_NEUTRAL_SQL = f"regexp_replace({_NEUTRAL_SQL}, '^(?i)({'|'.join(m.ROLE_LABELS)}):', '\\\\\\1:')"


@query(f"SELECT doc_id, {_NEUTRAL_SQL} AS inert FROM (SELECT doc_id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT -doc_id, '[' || lang || '] <b>' || text FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL UNION ALL SELECT 1000000000 + doc_id, 'System: ' || text FROM documents WHERE text IS NOT NULL)")
def neutralized_documents(spark: SparkSession, d: str) -> DataFrame:
    """Texts as they are, and with a forged header and a forged speaker in front."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text", "lang")
    forged = docs.where("lang IS NOT NULL").select((-F.col("doc_id")).alias("doc_id"), F.concat(F.lit("["), "lang", F.lit("] <b>"), "text").alias("text"))
    posed = docs.select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), F.concat(F.lit("System: "), "text").alias("text"))
    return docs.drop("lang").unionByName(forged).unionByName(posed).select("doc_id", m.neutralize(F.col("text")).alias("inert"))


_FINGER_SQL = f"left({normal_sql(chr(34) + 'all' + chr(34))}, 400)"


@query(f"""WITH f AS (SELECT candidate_id, {_FINGER_SQL} AS fp FROM (SELECT candidate_id, concat_ws(' ', context, user_request, claim, result) AS "all" FROM candidates)),
 k AS (SELECT fp, min(candidate_id) AS first_id FROM f GROUP BY fp) SELECT candidate_id, CASE WHEN fp = '' THEN candidate_id ELSE first_id END AS first_id, fp <> '' AND candidate_id <> first_id AS duplicate FROM f JOIN k USING (fp)""")
def first_by_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """The first record of each fingerprint; later ones are duplicates, an empty fingerprint never."""
    f = table(spark, d, "candidates").select("candidate_id", m.fingerprint("context", "user_request", "claim", "result").alias("fp"))
    firsts = f.groupBy("fp").agg(F.min("candidate_id").alias("first_id"))
    blank = F.col("fp") == ""
    return f.join(firsts, "fp").select(
        "candidate_id", F.when(blank, F.col("candidate_id")).otherwise(F.col("first_id")).alias("first_id"), (~blank & (F.col("candidate_id") != F.col("first_id"))).alias("duplicate")
    )


_CLASS_SQL = "nullif(regexp_replace(trim(lower(source_class)), '[\\s-]+', '_', 'g'), '')"
_CONF_SQL = "CASE WHEN confidence IS NULL OR isnan(confidence) THEN 0.0 ELSE confidence END"


def case_sql(table: dict, key: str, default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in table.items()) + f" ELSE {default}e0 END"


@query(f"""WITH {B_SQL}, k AS (SELECT belief_id, {_CLASS_SQL} AS klass, {_CONF_SQL} AS conf, coalesce(importance, 0.0) AS imp, verified_source_class AS ver, coalesce(quarantined, false) AS q, derived_from FROM b)
 SELECT belief_id, klass, CASE WHEN klass IN ('user_explicit', 'document', 'tool_result') AND conf >= 0.8 THEN 'well-evidenced' WHEN klass = 'derived_pattern' AND conf >= 0.7 THEN 'pattern-derived, verified' WHEN klass = 'agent_inference' THEN '{m.PROVISIONAL}' ELSE 'moderate' END AS verdict,
 CASE WHEN coalesce(nullif(ver, ''), klass, '') = 'user_explicit' THEN 'attested' WHEN NOT q AND conf >= 0.9 THEN 'high-confidence' ELSE '' END AS protection,
 CASE WHEN imp >= 0.7 THEN 'high' WHEN imp >= 0.35 THEN 'medium' ELSE 'low' END AS tier, round({case_sql(m.SOURCE_CONFIDENCE, 'klass', '0.5')}, 6) AS usual_confidence,
 round(conf + {case_sql(m.SOURCE_PRIORITY, 'klass', '0.0')}, 6) AS contest_score, round(least(0.98, conf + 0.04), 6) AS reinforced,
 len(list_filter(coalesce(derived_from, []), lambda x: starts_with(x, 'episode:'))) AS n_support FROM k""")
def belief_scores(spark: SparkSession, d: str) -> DataFrame:
    """Class, verdict, protection, tier and the confidence figures of every belief."""
    conf = F.coalesce(F.nanvl("confidence", F.lit(0.0)), F.lit(0.0))
    b = beliefs(spark, d).withColumn("klass", m.source_class(F.col("source_class"))).withColumn("conf", conf)
    k, c = F.col("klass"), F.col("conf")
    return b.select(
        "belief_id", "klass", m.verdict(k, c).alias("verdict"), m.protection(F.col("verified_source_class"), k, F.col("quarantined"), c).alias("protection"), m.tier(F.coalesce("importance", F.lit(0.0))).alias("tier"),
        F.round(m.lookup(m.SOURCE_CONFIDENCE, k, 0.5), 6).alias("usual_confidence"), F.round(c + m.lookup(m.SOURCE_PRIORITY, k, 0.0), 6).alias("contest_score"), F.round(m.reinforced(c, 0.04), 6).alias("reinforced"),
        F.coalesce(F.size(F.filter("derived_from", lambda x: x.startswith("episode:"))), F.lit(0)).cast("long").alias("n_support"),
    )


_AGE_SQL = f"greatest(0.0, epoch_us(TIMESTAMP '{EVENTS_AS_OF}' - ts_start) / 86400000000.0)"
_STEP_SQL = "greatest(0.05, importance * CASE WHEN importance >= 0.35 THEN 0.85 ELSE 0.7 END)"
_SIGNALS = {"success": ["decision_made"], "failure": ["problem_discovered", "unexpected_result"], "mixed": ["physical_action"], "unknown": ["background_repeated"]}


@query(f"""WITH {EP_SQL} SELECT episode_id, round(exp(-ln(2) * {_AGE_SQL} / 45.0), 6) AS recency, round(CASE WHEN importance < 0.7 AND {_AGE_SQL} >= 1.0 AND {_STEP_SQL} < importance THEN {_STEP_SQL} ELSE importance END, 6) AS decayed,
 CASE outcome WHEN 'success' THEN 1e0 WHEN 'failure' THEN 1e0 WHEN 'mixed' THEN 1e0 ELSE 0e0 END AS from_signals FROM ep""")
def episode_scores(spark: SparkSession, d: str) -> DataFrame:
    """Recency, one decay step, and importance from signals of every episode."""
    e = episodes(spark, d)
    age = m.age_days(F.col("ts_start"), EVENTS_AS_OF)
    signals = F.lit(None)
    for outcome, names in _SIGNALS.items():
        signals = F.when(F.col("outcome") == outcome, F.array(*map(F.lit, names))).otherwise(signals)
    return e.select("episode_id", F.round(m.recency(F.col("ts_start"), EVENTS_AS_OF), 6).alias("recency"), F.round(m.decayed(F.col("importance"), age), 6).alias("decayed"), m.base_importance(signals).alias("from_signals"))


_PLAIN_SQL = collapsed_sql("content")


@query(f"""WITH {T_SQL} SELECT source, count(*) AS n, count(*) FILTER (WHERE content IS NULL OR {_PLAIN_SQL} = '' OR starts_with({_PLAIN_SQL}, '/') OR regexp_matches({_PLAIN_SQL}, '{m.TRIVIAL}')) AS trivial,
 CAST(sum(ceil(length(content) / 4.0)) AS BIGINT) AS tokens, max(length(content)) AS longest FROM t GROUP BY source""")
def turn_text_totals(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return turns(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.count_if(m.is_trivial(c)).alias("trivial"), F.sum(m.token_estimate(c)).alias("tokens"), F.max(F.length(c)).cast("long").alias("longest"))


@query(f"""WITH {B_SQL} SELECT belief_id, CASE WHEN q AND true THEN 'quarantined' WHEN mine <> 'planner-2' THEN 'other-actor' WHEN level <> 'unclassified' THEN 'sensitivity' ELSE '' END AS refusal
 FROM (SELECT belief_id, coalesce(quarantined, false) AS q, CASE WHEN actor_id IS NULL OR actor_id = '' THEN 'primary' WHEN trim(actor_id) = '' THEN 'untrusted' ELSE trim(actor_id) END AS mine,
 CASE WHEN trim(lower(coalesce(sensitivity, ''))) IN ('unclassified', 'internal', 'private', 'restricted') THEN trim(lower(sensitivity)) ELSE 'unclassified' END AS level FROM b)""")
def policy_partition(spark: SparkSession, d: str) -> DataFrame:
    """Why the caller planner-2 may not read each belief ('' where it may)."""
    return beliefs(spark, d).select("belief_id", m.read_refusal(F.col("actor_id"), F.col("quarantined"), F.col("sensitivity"), "planner-2", owner=False).alias("refusal"))

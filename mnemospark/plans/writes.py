"""Writes and what they change: trust rules, and the effects of decisions as facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import memory as m
from mnemospark.functions import trust as t
from mnemospark.plans.base import B_SQL, D_SQL, beliefs, decisions, query
from mnemospark.plans.texts import case_sql
from mnemospark.session import table

_PLAIN = "trim(lower(coalesce(ingestion_channel, '')))"
_IDENTITY = f"CASE {_PLAIN} WHEN '' THEN 'owner' " + " ".join(f"WHEN '{c}' THEN '{i}'" for c, (i, _) in t.CHANNELS.items()) + " ELSE 'untrusted' END"
_PROVENANCE = f"CASE {_PLAIN} WHEN '' THEN 'user' " + " ".join(f"WHEN '{c}' THEN '{p}'" for c, (_, p) in t.CHANNELS.items()) + " ELSE 'external' END"
_ACTOR = "CASE WHEN actor_id IS NULL OR actor_id = '' THEN 'primary' WHEN trim(actor_id) = '' THEN 'untrusted' ELSE trim(actor_id) END"
_CLASS = "nullif(regexp_replace(trim(lower(source_class)), '[\\s-]+', '_', 'g'), '')"
_CONF = "CASE WHEN isnan(confidence) THEN NULL ELSE confidence END"
_CLASSES = ", ".join(f"'{c}'" for c in m.SOURCE_CONFIDENCE)
_PROTECTED = "(coalesce(nullif(verified_source_class, ''), source_class, '') = 'user_explicit' OR (NOT coalesce(quarantined, false) AND coalesce(CASE WHEN isnan(confidence) THEN NULL ELSE confidence END, 0.0) >= 0.9))"


@query(f"""WITH {B_SQL}, k AS (SELECT *, {_IDENTITY} AS identity, {_PROVENANCE} AS provenance, {_ACTOR} AS mine, {_CLASS} AS claimed, {_CONF} AS said FROM b),
 v AS (SELECT *, CASE provenance WHEN 'external' THEN 'external_source' WHEN 'agent' THEN 'agent_reported' WHEN 'agent_consolidation' THEN 'derived_pattern' ELSE CASE WHEN claimed IN ({_CLASSES}) THEN claimed ELSE 'agent_inference' END END AS verified FROM k),
 u AS (SELECT *, {case_sql(m.SOURCE_CONFIDENCE, 'verified', '0.5')} AS usual FROM v)
 SELECT belief_id, identity, provenance, CASE WHEN identity = 'untrusted' AND mine IN ('primary', 'owner') THEN 'untrusted' ELSE mine END AS actor, verified, round(CASE WHEN provenance IN ('agent', 'external') THEN least(coalesce(said, usual), usual) ELSE coalesce(said, usual) END, 6) AS confidence,
 coalesce(quarantined, false) OR identity NOT IN ('owner', 'system') AS quarantined FROM u""")
def write_rules(spark: SparkSession, d: str) -> DataFrame:
    """Every memory as a write through its channel: who that is, what is believed of it, and how it is stored."""
    b = beliefs(spark, d).select("*", t.identity_of(F.col("ingestion_channel")).alias("identity"), t.provenance_of(F.col("ingestion_channel")).alias("provenance"))
    b = b.withColumn("verified", t.verified_class(m.source_class(F.col("source_class")), F.col("provenance")))
    return b.select(
        "belief_id", "identity", "provenance", t.bound_actor(F.col("actor_id"), F.col("identity")).alias("actor"), "verified",
        F.round(t.bounded_confidence(F.col("confidence"), F.col("verified"), F.col("provenance")), 6).alias("confidence"), t.write_quarantine(F.col("quarantined"), F.col("identity")).alias("quarantined"),
    )


@query(f"""SELECT capability, provenance, identity, protected, CASE capability WHEN 'read' THEN identity = 'owner' OR provenance = 'external' WHEN 'write_candidate' THEN true WHEN 'approve' THEN provenance = 'user'
 WHEN 'purge' THEN provenance = 'user' AND identity = 'owner' ELSE CASE WHEN protected THEN provenance = 'user' ELSE provenance <> 'external' AND (identity = 'owner' OR provenance = 'agent_consolidation') END END AS allowed
 FROM (SELECT unnest({t.CAPABILITIES}) AS capability), (SELECT unnest({t.PROVENANCES}) AS provenance), (SELECT unnest({t.IDENTITIES}) AS identity), (SELECT unnest([true, false]) AS protected)""")
def capabilities(spark: SparkSession, d: str) -> DataFrame:
    """What each kind of caller may do to plain and to protected memories: a table of fixed size."""
    rows = [(c, p, i, x) for c in t.CAPABILITIES for p in t.PROVENANCES for i in t.IDENTITIES for x in (True, False)]
    df = spark.createDataFrame(rows, "capability string, provenance string, identity string, protected boolean")
    return df.withColumn("allowed", t.may(F.col("capability"), F.col("provenance"), F.col("identity"), F.col("protected")))


@query(f"""WITH {B_SQL}, {D_SQL}, r AS (SELECT DISTINCT matched_id AS id FROM dec WHERE coalesce(matched_id, '') <> '' UNION SELECT DISTINCT candidate_id FROM dec WHERE candidate_id IS NOT NULL),
 k AS (SELECT r.id, b.belief_id, coalesce(quarantined, false) AS q, {_ACTOR} AS mine, {_PROTECTED} AS protected, CASE WHEN trim(lower(coalesce(sensitivity, ''))) IN ('internal', 'private', 'restricted') THEN 1 ELSE 0 END AS level FROM r LEFT JOIN b ON b.belief_id = r.id)
 SELECT id, CASE WHEN belief_id IS NULL THEN 'unknown' WHEN q AND mine <> 'planner-2' THEN 'quarantined-other-actor' WHEN mine <> 'planner-2' THEN 'other-actor' WHEN level = 1 THEN 'sensitivity' WHEN protected THEN 'protected' ELSE '' END AS refusal FROM k""")
def forget_refusals(spark: SparkSession, d: str) -> DataFrame:
    """Why the agent planner-2 may not forget what decisions name: no such memory, not its own, or protected."""
    x = decisions(spark, d)
    named = x.select(F.col("matched_id").alias("id")).where("id <> ''").unionByName(x.select(F.col("candidate_id").alias("id")).where("id IS NOT NULL")).distinct()
    k = named.join(beliefs(spark, d), F.col("id") == F.col("belief_id"), "left")
    read = m.read_refusal(F.col("actor_id"), F.col("quarantined"), F.col("sensitivity"), "planner-2", owner=False, review=True)
    kept = m.protection(F.col("verified_source_class"), F.col("source_class"), F.col("quarantined"), F.col("confidence")) != ""
    return k.select("id", F.when(F.col("belief_id").isNull(), "unknown").when(read != "", read).when(kept, "protected").otherwise("").alias("refusal"))


@query(f"""WITH {B_SQL}, x AS (SELECT belief_id, CASE WHEN status <> 'active' THEN status WHEN coalesce(quarantined, false) THEN 'quarantined' END AS reason FROM b)
 SELECT 'owner' AS caller, 'belief:' || belief_id AS item, reason FROM x WHERE reason IS NOT NULL UNION ALL SELECT 'other', '', '{t.WITHHELD}'""")
def exclusions(spark: SparkSession, d: str) -> DataFrame:
    """What recall leaves out and why; anybody but the owner gets one and the same answer."""
    reason = F.when(F.col("status") != "active", F.col("status")).when(F.coalesce("quarantined", F.lit(False)), "quarantined")
    own = beliefs(spark, d).select(F.lit("owner").alias("caller"), F.concat(F.lit("belief:"), "belief_id").alias("item"), reason.alias("reason")).where("reason IS NOT NULL")
    return own.unionByName(spark.createDataFrame([("other", "", t.WITHHELD)], own.schema))


_AGENT_CONF = f"least(greatest(0.6, {m.SOURCE_CONFIDENCE['agent_inference']}), {m.SOURCE_CONFIDENCE['agent_reported']})"


@query(f"""WITH {B_SQL}, {D_SQL}, o AS (SELECT belief_id, status, kind, importance, derived_from, {_PROTECTED} AS denied FROM b), c AS (SELECT candidate_id, claim FROM candidates WHERE trim(coalesce(claim, '')) <> '')
 SELECT decision_id, belief_id AS old_id, denied, CASE WHEN denied THEN status ELSE 'superseded' END AS old_status, CASE WHEN NOT denied THEN claim END AS claim, CASE WHEN NOT denied THEN kind END AS kind, CASE WHEN NOT denied THEN CAST({_AGENT_CONF} AS DOUBLE) END AS confidence, CASE WHEN NOT denied THEN importance END AS importance,
 CASE WHEN NOT denied THEN array_to_string(list_append(coalesce(derived_from, []), 'supersedes:' || belief_id), ',') END AS derived_from FROM dec JOIN o ON o.belief_id = dec.matched_id JOIN c USING (candidate_id) WHERE classification = 'supersession'""")
def supersede_effects(spark: SparkSession, d: str) -> DataFrame:
    """Each supersession by an agent: the old memory retires and its successor inherits, unless it is protected."""
    c = table(spark, d, "candidates").where("trim(coalesce(claim, '')) <> ''").select("candidate_id", F.col("claim").alias("new_claim"))
    b = beliefs(spark, d).withColumnRenamed("belief_id", "old_id").drop("claim", "created_at")
    x = decisions(spark, d).where("classification = 'supersession'").select("decision_id", "candidate_id", F.col("matched_id").alias("old_id")).join(b, "old_id").join(c, "candidate_id")
    kept = m.protection(F.col("verified_source_class"), F.col("source_class"), F.col("quarantined"), F.col("confidence")) != ""
    sure = t.bounded_confidence(F.greatest(F.lit(0.6), F.lit(m.SOURCE_CONFIDENCE["agent_inference"])), F.lit("agent_reported"), F.lit("agent"))
    line = F.array_join(F.array_append(F.coalesce("derived_from", F.array().cast("array<string>")), F.concat(F.lit("supersedes:"), "old_id")), ",")
    new = lambda e, name: F.when(~kept, e).alias(name)
    return x.select("decision_id", "old_id", kept.alias("denied"), F.when(kept, F.col("status")).otherwise("superseded").alias("old_status"), new(F.col("new_claim"), "claim"), new(F.col("kind"), "kind"), new(F.round(sure, 6), "confidence"), new(F.col("importance"), "importance"), new(line, "derived_from"))


_NEW_CONF = min(m.SOURCE_CONFIDENCE["agent_inference"], m.SOURCE_CONFIDENCE["agent_reported"])


@query(f"""WITH {B_SQL}, {D_SQL}, x AS (SELECT decision_id, candidate_id, b.belief_id, {_PROTECTED} AS blocked, contradictions FROM dec JOIN b ON b.belief_id = dec.matched_id WHERE classification = 'contradiction' AND candidate_id IS NOT NULL),
 s AS (SELECT decision_id, unnest(list_distinct(list_append(coalesce(contradictions, []), belief_id))) AS id FROM x WHERE NOT blocked),
 g AS (SELECT decision_id, s.id, round(coalesce(CASE WHEN isnan(confidence) THEN NULL ELSE confidence END, 0.0) + {case_sql(m.SOURCE_PRIORITY, 'source_class', '0.0')}, 6) AS score FROM s JOIN b ON b.belief_id = s.id WHERE status <> 'superseded'
  UNION ALL SELECT decision_id, candidate_id, round({_NEW_CONF} + {m.SOURCE_PRIORITY['agent_reported']}, 6) FROM x WHERE NOT blocked),
 w AS (SELECT decision_id, arg_max(id, (score, id)) AS winner, count(*) - 1 AS losers FROM g GROUP BY 1)
 SELECT x.decision_id, x.belief_id, blocked, coalesce(winner, '') AS winner, coalesce(losers, 0) AS losers FROM x LEFT JOIN w USING (decision_id)""")
def contradict_effects(spark: SparkSession, d: str) -> DataFrame:
    """Each contradiction by an agent: the cluster's best by confidence and source stays active, the others are contradicted; a protected memory blocks it."""
    b = beliefs(spark, d)
    kept = m.protection(F.col("verified_source_class"), F.col("source_class"), F.col("quarantined"), F.col("confidence")) != ""
    named = decisions(spark, d).where("classification = 'contradiction' AND candidate_id IS NOT NULL").select("decision_id", "candidate_id", F.col("matched_id").alias("belief_id"))
    x = named.join(b.select("belief_id", kept.alias("blocked"), "contradictions"), "belief_id")
    free = x.where("NOT blocked")
    sides = free.select("decision_id", F.explode(F.array_distinct(F.array_append(F.coalesce("contradictions", F.array().cast("array<string>")), F.col("belief_id")))).alias("id"))
    scored = sides.join(b.where("status <> 'superseded'").select(F.col("belief_id").alias("id"), F.round(t.contest_score(F.col("confidence"), F.col("source_class")), 6).alias("score")), "id")
    new = free.select(F.col("candidate_id").alias("id"), "decision_id", F.round(t.contest_score(F.lit(_NEW_CONF), F.lit("agent_reported")), 6).alias("score"))
    won = scored.unionByName(new).groupBy("decision_id").agg(F.max_by("id", F.struct("score", "id")).alias("winner"), (F.count("*") - 1).alias("losers"))
    return x.join(won, "decision_id", "left").select("decision_id", "belief_id", "blocked", F.coalesce("winner", F.lit("")).alias("winner"), F.coalesce("losers", F.lit(0)).cast("long").alias("losers"))


@query(f"""WITH {B_SQL}, {D_SQL}, k AS (SELECT matched_id AS belief_id, list(DISTINCT candidate_id) AS others FROM dec WHERE classification = 'contradiction' AND candidate_id IS NOT NULL GROUP BY 1)
 SELECT b.belief_id, status, array_to_string(list_sort(list_distinct(list_concat(coalesce(contradictions, []), others))), ',') AS contradictions FROM b JOIN k USING (belief_id)""")
def open_contradictions(spark: SparkSession, d: str) -> DataFrame:
    """Both sides kept and linked, no winner picked. Links are rows of one decision each; a list holds one memory's, for display."""
    k = decisions(spark, d).where("classification = 'contradiction' AND candidate_id IS NOT NULL").groupBy(F.col("matched_id").alias("belief_id")).agg(F.collect_set("candidate_id").alias("others"))
    both = F.array_sort(F.array_distinct(F.concat(F.coalesce("contradictions", F.array().cast("array<string>")), "others")))
    return beliefs(spark, d).join(k, "belief_id").select("belief_id", "status", F.array_join(both, ",").alias("contradictions"))


@query(f"""WITH {B_SQL} SELECT belief_id, claim IS NOT NULL AND trim(claim) <> '' AS approved, CASE WHEN trim(coalesce(claim, '')) <> '' THEN 'user_explicit' ELSE verified_source_class END AS verified_source_class, trim(coalesce(claim, '')) = '' AS quarantined, CASE WHEN trim(coalesce(claim, '')) <> '' THEN status ELSE 'archived' END AS status FROM b WHERE quarantined""")
def approve_effects(spark: SparkSession, d: str) -> DataFrame:
    """An owner's review of all that is held back: what says something is attested and released, blank claims are rejected, which archives them."""
    says = F.trim(F.coalesce("claim", F.lit(""))) != ""
    return beliefs(spark, d).where("quarantined").select("belief_id", says.alias("approved"), F.when(says, "user_explicit").otherwise(F.col("verified_source_class")).alias("verified_source_class"), (~says).alias("quarantined"), F.when(says, F.col("status")).otherwise("archived").alias("status"))


@query(f"""WITH {B_SQL}, k AS (SELECT belief_id, len(list_filter(coalesce(derived_from, []), lambda x: starts_with(x, 'episode:'))) AS supports, {_CONF} AS c, status FROM b)
 SELECT belief_id, supports, round(least(0.98, coalesce(c, 0.0) + 0.04), 6) AS confidence FROM k WHERE supports >= 3 AND status = 'active'""")
def confidence_update(spark: SparkSession, d: str) -> DataFrame:
    """Active memories that three or more episodes support gain a little."""
    supports = F.size(F.filter(F.coalesce("derived_from", F.array().cast("array<string>")), lambda x: x.startswith("episode:")))
    k = beliefs(spark, d).where("status = 'active'").select("belief_id", supports.cast("long").alias("supports"), F.coalesce(F.nanvl("confidence", F.lit(0.0)), F.lit(0.0)).alias("c"))
    return k.where("supports >= 3").select("belief_id", "supports", F.round(m.reinforced(F.col("c"), 0.04), 6).alias("confidence"))


@query("""SELECT candidate_id, array_to_string(list_filter([CASE WHEN trim(coalesce(user_request, '')) <> '' THEN 'user_asked' END, CASE WHEN trim(coalesce(claim, '')) <> '' THEN 'decision_made' END, CASE WHEN trim(coalesce(result, '')) <> '' THEN 'physical_action' END, CASE WHEN coalesce(context, '') <> '' THEN 'project_relevance' END], lambda x: x IS NOT NULL), ',') AS signals,
 round(least(1.0, 0.35e0 + CASE WHEN trim(coalesce(user_request, '')) <> '' THEN 0.3 ELSE 0.0 END + CASE WHEN coalesce(context, '') <> '' THEN 0.25 ELSE 0.0 END), 6) AS importance FROM candidates""")
def field_importance(spark: SparkSession, d: str) -> DataFrame:
    """Signals and fallback importance that the fields of a candidate give: its claim as decision, result as action, context as project."""
    none = F.lit(None).cast("string")
    c = table(spark, d, "candidates")
    return c.select("candidate_id", F.array_join(t.field_signals(none, F.col("user_request"), none, F.col("claim"), F.col("result"), F.col("context")), ",").alias("signals"), F.round(t.fallback_importance(none, F.col("user_request"), F.col("context")), 6).alias("importance"))

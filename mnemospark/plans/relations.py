"""Scans, joins, aggregates and set algebra over the memory tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.functions import memory as m
from mnemospark.operators.running import running_total
from mnemospark.plans.base import B_SQL, D_SQL, EP_SQL, T_SQL, beliefs, decisions, episodes, query, turns
from mnemospark.session import table

CLASSES = ["duplicate", "reinforcement", "contradiction", "update", "supersession", "low-confidence", "irrelevant"]


@query(f"""WITH {B_SQL}, p AS (SELECT * FROM b WHERE status = 'active' AND kind = 'fact' ORDER BY created_at DESC, belief_id DESC LIMIT 50)
 SELECT belief_id, created_at, actor_id FROM p WHERE NOT coalesce(quarantined, false)""")
def list_beliefs(spark: SparkSession, d: str) -> DataFrame:
    """Newest active facts; the limit comes before the policy, as callers of this listing expect."""
    newest = beliefs(spark, d).where("status = 'active' AND kind = 'fact'").orderBy(F.desc("created_at"), F.desc("belief_id")).limit(50)
    return newest.where(m.read_refusal(F.col("actor_id"), F.col("quarantined"), F.col("sensitivity"), "primary", owner=True) == "").select("belief_id", "created_at", "actor_id")


@query(f"WITH {EP_SQL} SELECT episode_id, ts_start, context, outcome FROM ep WHERE project = 'P1' AND outcome = 'failure' ORDER BY ts_start DESC, episode_id DESC LIMIT 100")
def list_episodes(spark: SparkSession, d: str) -> DataFrame:
    return episodes(spark, d).where("project = 'P1' AND outcome = 'failure'").orderBy(F.desc("ts_start"), F.desc("episode_id")).limit(100).select("episode_id", "ts_start", "context", "outcome")


@query(f"""WITH {B_SQL} SELECT * FROM (SELECT 'belief' AS kind, belief_id AS id, created_at AS at_time FROM b WHERE quarantined
 UNION ALL SELECT 'candidate', candidate_id, extracted_at FROM candidates WHERE item_type = 'episode') ORDER BY at_time DESC NULLS LAST, id DESC LIMIT 40""")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """Newest items to review across kinds, merged under one limit."""
    held = beliefs(spark, d).where("quarantined").select(F.lit("belief").alias("kind"), F.col("belief_id").alias("id"), F.col("created_at").alias("at_time"))
    new = table(spark, d, "candidates").where("item_type = 'episode'").select(F.lit("candidate").alias("kind"), F.col("candidate_id").alias("id"), F.col("extracted_at").alias("at_time"))
    return held.unionByName(new).orderBy(F.col("at_time").desc_nulls_last(), F.desc("id")).limit(40)


@query(f"""WITH {B_SQL}, {D_SQL} SELECT 'beliefs' AS name, count(*) AS n, count(*) FILTER (WHERE quarantined) AS quarantined FROM b UNION ALL SELECT 'candidates', count(*), 0 FROM candidates
 UNION ALL SELECT 'decisions', count(*), 0 FROM dec UNION ALL SELECT 'turns', count(*), 0 FROM turns UNION ALL SELECT 'archives', count(*), 0 FROM archives UNION ALL SELECT 'chat_exports', count(*), 0 FROM chat_exports UNION ALL SELECT 'documents', count(*), 0 FROM documents""")
def health_counts(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(0).cast("long").alias("quarantined")
    out = beliefs(spark, d).agg(F.lit("beliefs").alias("name"), F.count("*").alias("n"), F.count_if(F.coalesce("quarantined", F.lit(False))).alias("quarantined"))
    out = out.unionByName(decisions(spark, d).agg(F.lit("decisions").alias("name"), F.count("*").alias("n"), none))
    for name in ("candidates", "turns", "archives", "chat_exports", "documents"):
        out = out.unionByName(table(spark, d, name).agg(F.lit(name).alias("name"), F.count("*").alias("n"), none))
    return out


@query(f"""WITH {T_SQL} SELECT archive_id, source AS archive_source, count(turn_id) AS n_turns, count(DISTINCT session_id) AS n_sessions FROM archives a LEFT JOIN (SELECT archive_id, session_id, turn_id FROM t) x USING (archive_id) GROUP BY archive_id, source""")
def archive_turns(spark: SparkSession, d: str) -> DataFrame:
    """Archives with what was stored from them; 0 where nothing was. Counts are gathered before the join."""
    per = turns(spark, d).groupBy("archive_id", "session_id").agg(F.count("*").alias("k")).groupBy("archive_id").agg(F.sum("k").alias("n_turns"), F.count("*").alias("n_sessions"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return table(spark, d, "archives").join(per, "archive_id", "left").select("archive_id", F.col("source").alias("archive_source"), zero("n_turns"), zero("n_sessions"))


@query("""SELECT session_id, turn_id, count(DISTINCT t.archive_id) AS n_archives, min(a.captured_at) AS first_captured FROM turns t JOIN archives a USING (archive_id) GROUP BY session_id, turn_id HAVING count(DISTINCT t.archive_id) > 1""")
def turn_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Turns that came from several archives."""
    links = table(spark, d, "turns").select("session_id", "turn_id", "archive_id").distinct()
    seen = links.join(table(spark, d, "archives").select("archive_id", "captured_at"), "archive_id")
    return seen.groupBy("session_id", "turn_id").agg(F.count("*").alias("n_archives"), F.min("captured_at").alias("first_captured")).where("n_archives > 1")


@query(f"WITH {D_SQL} SELECT c.candidate_id, c.batch_no, c.item_type FROM candidates c ANTI JOIN dec ON dec.candidate_id = c.candidate_id")
def pending_candidates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates").select("candidate_id", "batch_no", "item_type").join(decisions(spark, d).select("candidate_id"), "candidate_id", "left_anti")


@query(f"""WITH {B_SQL}, {D_SQL} SELECT belief_id FROM b WHERE status IN ('active', 'superseded', 'contradicted') AND (NOT coalesce(quarantined, false) OR coalesce(ingestion_channel, '') <> 'import' OR belief_id IN (SELECT matched_id FROM dec WHERE matched_id IS NOT NULL))""")
def comparison_set(spark: SparkSession, d: str) -> DataFrame:
    """Memories that new claims are compared with: established ones, and imports that a decision names."""
    named = decisions(spark, d).where("matched_id IS NOT NULL").select(F.col("matched_id").alias("belief_id")).distinct().withColumn("named", F.lit(True))
    b = beliefs(spark, d).where(F.col("status").isin("active", "superseded", "contradicted")).join(named, "belief_id", "left")
    return b.where(~F.coalesce("quarantined", F.lit(False)) | (F.coalesce("ingestion_channel", F.lit("")) != "import") | F.col("named")).select("belief_id")


@query(f"""WITH {B_SQL}, {EP_SQL}, l AS (SELECT DISTINCT belief_id, CAST(substr(x, 11) AS BIGINT) AS n FROM (SELECT belief_id, unnest(derived_from) AS x FROM b) WHERE starts_with(x, 'episode:E-'))
 SELECT belief_id, count(*) AS n_sources, count(e.episode_id) AS n_known, count(*) FILTER (WHERE e.outcome = 'failure') AS n_failed FROM l LEFT JOIN ep e ON e.episode_id = 'E-' || lpad(CAST(l.n AS VARCHAR), 8, '0') GROUP BY belief_id""")
def lineage(spark: SparkSession, d: str) -> DataFrame:
    """Episodes that a belief was derived from, by its prefixed source references."""
    refs = beliefs(spark, d).select("belief_id", F.explode("derived_from").alias("x")).where(F.col("x").startswith("episode:E-"))
    refs = refs.select("belief_id", F.concat(F.lit("E-"), F.lpad(F.substring("x", 11, 20).cast("long").cast("string"), 8, "0")).alias("episode_id")).distinct()
    known = episodes(spark, d).select("episode_id", "outcome")
    return refs.join(known, "episode_id", "left").groupBy("belief_id").agg(F.count("*").alias("n_sources"), F.count("outcome").alias("n_known"), F.count_if(F.col("outcome") == "failure").alias("n_failed"))


@query(f"""WITH {B_SQL}, e AS (SELECT DISTINCT belief_id, lower(trim(x)) AS evidence_id FROM (SELECT belief_id, unnest(evidence_ids) AS x FROM b) WHERE trim(x) <> '')
 SELECT evidence_id, count(*) AS n_beliefs, min(belief_id) AS first_belief FROM e GROUP BY evidence_id HAVING count(*) > 1""")
def shared_evidence(spark: SparkSession, d: str) -> DataFrame:
    e = beliefs(spark, d).select("belief_id", F.explode("evidence_ids").alias("x")).select("belief_id", F.lower(F.trim("x")).alias("evidence_id")).where("evidence_id <> ''").distinct()
    return e.groupBy("evidence_id").agg(F.count("*").alias("n_beliefs"), F.min("belief_id").alias("first_belief")).where("n_beliefs > 1")


@query(f"""WITH {EP_SQL}, k AS (SELECT project, left(trim(context), 60) AS pattern, count(*) AS n, count(*) FILTER (WHERE outcome IN ('success', 'mixed')) AS good FROM ep GROUP BY 1, 2)
 SELECT project, pattern, n, good, round(least(0.85, 0.4 + 0.15 * good / n + 0.05 * least(n, 6)), 6) AS confidence FROM k WHERE n >= 3 AND good >= 0.6 * n""")
def pattern_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Repeated contexts of a project that mostly went well become procedure candidates."""
    k = episodes(spark, d).groupBy("project", F.substring(F.trim("context"), 1, 60).alias("pattern")).agg(F.count("*").alias("n"), F.count_if(F.col("outcome").isin("success", "mixed")).alias("good"))
    sure = F.least(F.lit(0.85), F.lit(0.4) + F.lit(0.15) * F.col("good") / F.col("n") + F.lit(0.05) * F.least("n", F.lit(6)))
    return k.where("n >= 3 AND good >= 0.6 * n").select("project", "pattern", "n", "good", F.round(sure, 6).alias("confidence"))


@query(f"""WITH {EP_SQL}, w AS (SELECT *, left(trim(context), 50) AS pattern FROM ep), big AS (SELECT project, pattern FROM w GROUP BY 1, 2 HAVING count(*) >= 3)
 SELECT project, pattern, outcome, count(*) AS n, round(max(importance), 6) AS importance, min(episode_id) AS first_id FROM w JOIN big USING (project, pattern) GROUP BY 1, 2, 3 HAVING count(*) >= 3""")
def compress_groups(spark: SparkSession, d: str) -> DataFrame:
    """Episodes of one project, context and outcome that one summary can stand for; one aggregation."""
    g = episodes(spark, d).groupBy("project", F.substring(F.trim("context"), 1, 50).alias("pattern"), "outcome").agg(F.count("*").alias("n"), F.max("importance").alias("importance"), F.min("episode_id").alias("first_id"))
    return g.where("n >= 3").withColumn("importance", F.round("importance", 6))


@query("""WITH o AS (SELECT user_id, event_type, count(*) AS n, count(*) FILTER (WHERE value > 20) AS good FROM events GROUP BY 1, 2 HAVING count(*) >= 3)
 SELECT user_id, event_type, n, good, round(CASE WHEN good >= 0.6 * n THEN least(0.95, 0.5 + 0.15 * least(n, 4) + 0.1 * good / n) ELSE greatest(0.1, 0.5 - 0.2) END, 6) AS confidence, CASE WHEN good >= 0.6 * n THEN 'validated' ELSE 'candidate' END AS status FROM o""")
def procedure_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Confidence of procedures, here user and type, from their outcomes."""
    o = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 20).alias("good")).where("n >= 3")
    works = F.col("good") >= 0.6 * F.col("n")
    up = F.least(F.lit(0.95), F.lit(0.5) + F.lit(0.15) * F.least("n", F.lit(4)) + F.lit(0.1) * F.col("good") / F.col("n"))
    return o.select("user_id", "event_type", "n", "good", F.round(F.when(works, up).otherwise(F.lit(0.3)), 6).alias("confidence"), F.when(works, "validated").otherwise("candidate").alias("status"))


@query(f"""WITH {T_SQL} SELECT source, count(DISTINCT session_id) AS sessions, count(*) AS n_turns, count(*) FILTER (WHERE on_current_path) AS on_path, count(*) FILTER (WHERE NOT on_current_path) AS alternate, count(*) FILTER (WHERE branch_path IS NULL) AS no_path FROM t GROUP BY source""")
def conversation_summary(spark: SparkSession, d: str) -> DataFrame:
    per = turns(spark, d).groupBy("source", "session_id").agg(F.count("*").alias("n"), F.count_if("on_current_path").alias("p"), F.count_if(~F.col("on_current_path")).alias("a"), F.count_if(F.col("branch_path").isNull()).alias("x"))
    return per.groupBy("source").agg(F.count("*").alias("sessions"), F.sum("n").alias("n_turns"), F.sum("p").alias("on_path"), F.sum("a").alias("alternate"), F.sum("x").alias("no_path"))


@query(f"""WITH {D_SQL}, c AS (SELECT unnest({CLASSES!r}) AS classification) SELECT classification, count(decision_id) AS n FROM c LEFT JOIN dec USING (classification) GROUP BY classification""")
def decision_histogram(spark: SparkSession, d: str) -> DataFrame:
    """All seven classes, with 0 where there is none."""
    counted = decisions(spark, d).groupBy("classification").agg(F.count("*").alias("n"))
    return spark.createDataFrame([(c,) for c in CLASSES], "classification string").join(counted, "classification", "left").select("classification", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(f"""WITH {D_SQL} SELECT job_id, count(*) AS n, count(*) FILTER (WHERE classification IN ('duplicate', 'reinforcement')) AS supports, count(*) FILTER (WHERE classification = 'contradiction') AS conflicts, count(*) FILTER (WHERE applied) AS applied, min(created_at) AS started, max(created_at) AS ended FROM dec GROUP BY job_id""")
def job_counters(spark: SparkSession, d: str) -> DataFrame:
    return decisions(spark, d).groupBy("job_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("classification").isin("duplicate", "reinforcement")).alias("supports"), F.count_if(F.col("classification") == "contradiction").alias("conflicts"),
        F.count_if(F.coalesce("applied", F.lit(False))).alias("applied"), F.min("created_at").alias("started"), F.max("created_at").alias("ended"),
    )


@query(f"""WITH {B_SQL}, {D_SQL}, k AS (SELECT matched_id, count(*) FILTER (WHERE classification IN ('duplicate', 'reinforcement')) AS supports, count(*) FILTER (WHERE classification = 'supersession') AS replaced, count(*) FILTER (WHERE classification = 'contradiction') AS conflicts FROM dec WHERE matched_id IS NOT NULL GROUP BY 1)
 SELECT belief_id, supports, conflicts, round(least(0.98, CASE WHEN confidence IS NULL OR isnan(confidence) THEN 0.0 ELSE confidence END + 0.04 * supports), 6) AS confidence,
 CASE WHEN replaced > 0 AND NOT (coalesce(nullif(verified_source_class, ''), source_class, '') = 'user_explicit' OR (NOT coalesce(quarantined, false) AND CASE WHEN confidence IS NULL OR isnan(confidence) THEN 0.0 ELSE confidence END >= 0.9)) THEN 'superseded' ELSE status END AS status FROM b JOIN k ON k.matched_id = b.belief_id""")
def decision_effects(spark: SparkSession, d: str) -> DataFrame:
    """What the decisions do to the memories they name: support adds confidence, replacement retires unprotected ones."""
    is_ = lambda *c: F.count_if(F.col("classification").isin(*c))
    k = decisions(spark, d).where("matched_id IS NOT NULL").groupBy(F.col("matched_id").alias("belief_id")).agg(is_("duplicate", "reinforcement").alias("supports"), is_("supersession").alias("replaced"), is_("contradiction").alias("conflicts"))
    conf = F.coalesce(F.nanvl("confidence", F.lit(0.0)), F.lit(0.0))
    kept = m.protection(F.col("verified_source_class"), F.col("source_class"), F.col("quarantined"), F.col("confidence"))
    return beliefs(spark, d).join(k, "belief_id").select(
        "belief_id", "supports", "conflicts", F.round(F.least(F.lit(0.98), conf + F.lit(0.04) * F.col("supports")), 6).alias("confidence"), F.when((F.col("replaced") > 0) & (kept == ""), "superseded").otherwise(F.col("status")).alias("status")
    )


@query("""SELECT date_trunc('hour', ts) AS hour, user_id, count(*) AS n, count(*) > 3 AS over_limit FROM events GROUP BY 1, 2""")
def hourly_quota(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "user_id").agg(F.count("*").alias("n"), (F.count("*") > 3).alias("over_limit"))


@query("""SELECT event_type, round(median(value), 6) AS median_value, round(max(value), 6) AS max_value, round(avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM events GROUP BY event_type""")
def value_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("median_value"), F.round(F.max("value"), 6).alias("max_value"), F.round(F.avg((F.col("value") > 20).cast("double")), 6).alias("rate"))


@query(f"""WITH {EP_SQL}, u AS (SELECT actor_id, count(*) FILTER (WHERE outcome = 'failure') AS f, count(*) FILTER (WHERE outcome = 'success') AS s, count(*) FILTER (WHERE outcome = 'mixed') AS x, count(*) FILTER (WHERE outcome <> 'unknown') AS n FROM ep GROUP BY 1)
 SELECT actor_id, CASE WHEN n = 0 THEN 'unknown' WHEN f > 0 THEN 'failure' WHEN s >= n / 2.0 THEN 'success' WHEN x > 0 THEN 'mixed' ELSE 'unknown' END AS outcome FROM u""")
def prevailing_outcome(spark: SparkSession, d: str) -> DataFrame:
    is_ = lambda o: F.count_if(F.col("outcome") == o)
    u = episodes(spark, d).groupBy("actor_id").agg(is_("failure").alias("f"), is_("success").alias("s"), is_("mixed").alias("x"), F.count_if(F.col("outcome") != "unknown").alias("n"))
    return u.select("actor_id", F.expr("CASE WHEN n = 0 THEN 'unknown' WHEN f > 0 THEN 'failure' WHEN s >= n / 2 THEN 'success' WHEN x > 0 THEN 'mixed' ELSE 'unknown' END").alias("outcome"))


@query("""SELECT session_id, turn_id, count(*) AS n_rows, count(DISTINCT coalesce(content, '<null>')) AS n_contents FROM turns GROUP BY 1, 2 HAVING count(DISTINCT coalesce(content, '<null>')) > 1 OR count(DISTINCT coalesce(role, '<null>')) > 1 OR count(DISTINCT coalesce(CAST(occurred_at AS VARCHAR), '<null>')) > 1""")
def import_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Turns whose repeated rows differ in content, role or time; an import with any is refused as a whole."""
    seen = table(spark, d, "turns").groupBy("session_id", "turn_id").agg(
        F.count("*").alias("n_rows"), F.count_distinct(F.xxhash64(F.coalesce("content", F.lit("<null>")))).alias("n_contents"), F.count_distinct(F.coalesce("role", F.lit("<null>"))).alias("r"), F.count_distinct(F.coalesce(F.col("occurred_at").cast("string"), F.lit("<null>"))).alias("o")
    )
    return seen.where("n_contents > 1 OR r > 1 OR o > 1").select("session_id", "turn_id", "n_rows", "n_contents")


@query("""SELECT id, arg_max(export_id, (archive_id, export_id)) AS export_id, arg_max(archive_id, (archive_id, export_id)) AS archive_id, count(*) AS n_exports FROM chat_exports WHERE id IS NOT NULL GROUP BY id""")
def latest_export(spark: SparkSession, d: str) -> DataFrame:
    """The last export of each conversation."""
    key = F.struct("archive_id", "export_id")
    return table(spark, d, "chat_exports").where("id IS NOT NULL").groupBy("id").agg(F.max_by("export_id", key).alias("export_id"), F.max_by("archive_id", key).alias("archive_id"), F.count("*").alias("n_exports"))


_HASH_SQL = "regexp_replace(regexp_replace(lower(sha256), '^[^\\pL\\pN]*sha-?256', ''), '[^0-9a-f]+', '', 'g')"


@query(f"""SELECT h AS digest, min(archive_id) AS archive_id, count(*) AS n, max(nullif(archived_path, '')) AS archived_path FROM (SELECT *, {_HASH_SQL} AS h FROM archives WHERE sha256 IS NOT NULL) GROUP BY h""")
def archive_upsert(spark: SparkSession, d: str) -> DataFrame:
    """One row per content hash: the first archive, with a copy path if any delivery had one."""
    h = F.regexp_replace(F.regexp_replace(F.lower("sha256"), r"^[^\p{L}\p{N}]*sha-?256", ""), r"[^0-9a-f]+", "")
    return table(spark, d, "archives").where("sha256 IS NOT NULL").groupBy(h.alias("digest")).agg(F.min("archive_id").alias("archive_id"), F.count("*").alias("n"), F.max(F.nullif(F.col("archived_path"), F.lit(""))).alias("archived_path"))


@query(f"""WITH {T_SQL}, c AS (SELECT DISTINCT session_id, unnest(turn_ids) AS turn_id FROM candidates) SELECT t.session_id, count(*) AS pending FROM t ANTI JOIN c ON c.session_id = t.session_id AND c.turn_id = t.turn_id WHERE regexp_matches(t.content, '[^\\s\\pZ\\pC]') GROUP BY t.session_id""")
def pending_turns(spark: SparkSession, d: str) -> DataFrame:
    """Visible turns that no candidate cites yet, counted by session."""
    cited = table(spark, d, "candidates").select("session_id", F.explode("turn_ids").alias("turn_id")).distinct()
    left = turns(spark, d).where(F.col("content").rlike(r"[^\p{Cf}\p{Cc}\p{Z}\s]")).select("session_id", "turn_id").join(cited, ["session_id", "turn_id"], "left_anti")
    return left.groupBy("session_id").agg(F.count("*").alias("pending"))


_REQUEST_SQL = "(lower(trim(role)) IN ('user', 'human') AND length(trim(coalesce(content, ''))) > 12 AND NOT regexp_matches(trim(coalesce(content, '')), '^[/!?]'))"


@query(f"""WITH {T_SQL}, o AS (SELECT session_id, turn_id, sum(CASE WHEN {_REQUEST_SQL} THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY stored_at NULLS FIRST, turn_id ROWS UNBOUNDED PRECEDING) AS arc FROM t)
 SELECT session_id, CAST(arc AS BIGINT) AS arc, count(*) AS n_turns, min(turn_id) AS a_turn FROM o GROUP BY 1, 2""")
def task_arcs(spark: SparkSession, d: str) -> DataFrame:
    """A substantial request opens an arc that lasts to the next one; turns before the first form arc 0."""
    said = F.trim(F.coalesce("content", F.lit("")))
    asks = F.lower(F.trim("role")).isin("user", "human") & (F.length(said) > 12) & ~said.rlike(r"^[/!?]")
    t = turns(spark, d).select("session_id", "turn_id", "stored_at", F.when(asks, 1).otherwise(0).cast("long").alias("asks"))
    arcs = running_total(t, ["session_id"], ["stored_at", "turn_id"], {"arc": F.col("asks")})
    return arcs.groupBy("session_id", "arc").agg(F.count("*").alias("n_turns"), F.min("turn_id").alias("a_turn"))


@query(f"""WITH {B_SQL}, k AS (SELECT belief_id, unnest(list_distinct(list_append(contradictions, belief_id))) AS other FROM b WHERE len(contradictions) > 0),
 s AS (SELECT k.belief_id, o.belief_id AS other, round(CASE WHEN o.confidence IS NULL OR isnan(o.confidence) THEN 0.0 ELSE o.confidence END, 6) AS score FROM k JOIN b o ON o.belief_id = k.other WHERE o.status <> 'superseded')
 SELECT belief_id, count(*) AS members, arg_max(other, (score, other)) AS winner FROM s GROUP BY belief_id""")
def contest_winner(spark: SparkSession, d: str) -> DataFrame:
    """Of a belief and those it contradicts, the most confident that is not superseded; ties go to the larger id."""
    b = beliefs(spark, d)
    sides = b.where("size(contradictions) > 0").select("belief_id", F.explode(F.array_distinct(F.array_append("contradictions", F.col("belief_id")))).alias("other"))
    score = F.round(F.coalesce(F.nanvl("confidence", F.lit(0.0)), F.lit(0.0)), 6)
    live = b.where("status <> 'superseded'").select(F.col("belief_id").alias("other"), score.alias("score"))
    return sides.join(live, "other").groupBy("belief_id").agg(F.count("*").alias("members"), F.max_by("other", F.struct("score", "other")).alias("winner"))


@query("""SELECT path, n, rank FROM (SELECT original_path AS path, count(*) OVER (PARTITION BY original_path) AS n, row_number() OVER (PARTITION BY original_path ORDER BY captured_at DESC NULLS LAST, archive_id DESC) AS rank FROM archives WHERE original_path IS NOT NULL) WHERE rank > 1""")
def rotation(spark: SparkSession, d: str) -> DataFrame:
    """Older captures of a path beyond the newest one kept."""
    newest = Window.partitionBy("original_path").orderBy(F.col("captured_at").desc_nulls_last(), F.desc("archive_id"))
    a = table(spark, d, "archives").where("original_path IS NOT NULL")
    return a.select(F.col("original_path").alias("path"), F.count("*").over(Window.partitionBy("original_path")).alias("n"), F.row_number().over(newest).cast("long").alias("rank")).where("rank > 1")

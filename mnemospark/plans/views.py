"""Listings, lookups, transcripts, evidence and the parsing of what an extractor answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import memory as m
from mnemospark.functions.text import is_blank
from mnemospark.operators.extract import CLAIM_CHARS, candidates_of
from mnemospark.operators.running import running_total
from mnemospark.plans.base import B_SQL, D_SQL, EP_SQL, G_SQL, T_SQL, beliefs, collapsed_sql, decisions, edges, episodes, normal_sql, query, turns
from mnemospark.plans.extraction import CONTROL_SQL, FIELD_LIMITS, MAX_ITEMS, violations
from mnemospark.session import table

@query(f"""WITH {EP_SQL} SELECT * FROM ep WHERE outcome <> 'unknown' ORDER BY ts_start DESC, episode_id DESC LIMIT 500""")
def list_episodes_full(spark: SparkSession, d: str) -> DataFrame:
    """The newest 500 episodes with all their fields."""
    return episodes(spark, d).where("outcome <> 'unknown'").orderBy(F.desc("ts_start"), F.desc("episode_id")).limit(500)


@query(f"""WITH {EP_SQL}, k AS (SELECT project, left(trim(context), 60) AS name, count(*) AS n, count(*) FILTER (WHERE outcome IN ('success', 'mixed')) AS good, max(ts_start) AS seen FROM ep GROUP BY 1, 2 HAVING count(*) >= 3)
 SELECT project, name, CASE WHEN good >= 0.6 * n THEN 'validated' ELSE 'candidate' END AS status, seen AS updated_at FROM k ORDER BY seen DESC, project DESC, name DESC LIMIT 100""")
def list_procedures(spark: SparkSession, d: str) -> DataFrame:
    """The 100 procedures that were seen last, and how far they are validated."""
    k = episodes(spark, d).groupBy("project", F.substring(F.trim("context"), 1, 60).alias("name")).agg(F.count("*").alias("n"), F.count_if(F.col("outcome").isin("success", "mixed")).alias("good"), F.max("ts_start").alias("updated_at")).where("n >= 3")
    return k.orderBy(F.desc("updated_at"), F.desc("project"), F.desc("name")).limit(100).select("project", "name", F.when(F.col("good") >= 0.6 * F.col("n"), "validated").otherwise("candidate").alias("status"), "updated_at")


@query(f"""WITH {EP_SQL}, s AS (SELECT DISTINCT project, left(trim(context), 60) AS pattern, actor_id AS step FROM ep WHERE outcome IN ('success', 'mixed')), r AS (SELECT *, row_number() OVER (PARTITION BY project, pattern ORDER BY step) AS i FROM s)
 SELECT project, pattern, string_agg(step, ',' ORDER BY step) AS steps FROM r WHERE i <= 8 GROUP BY 1, 2""")
def procedure_steps(spark: SparkSession, d: str) -> DataFrame:
    """The first eight distinct steps, here actors, of what went well; eight are kept map-side, whatever a pattern's size."""
    from pyspark.sql import Window

    s = episodes(spark, d).where(F.col("outcome").isin("success", "mixed")).select("project", F.substring(F.trim("context"), 1, 60).alias("pattern"), F.col("actor_id").alias("step")).distinct()
    first = s.withColumn("i", F.row_number().over(Window.partitionBy("project", "pattern").orderBy("step"))).where("i <= 8")
    return first.groupBy("project", "pattern").agg(F.array_join(F.array_sort(F.collect_list("step")), ",").alias("steps"))


@query(f"""WITH {B_SQL}, {D_SQL}, w AS (SELECT DISTINCT matched_id AS id FROM dec WHERE matched_id IS NOT NULL) SELECT id, belief_id IS NOT NULL AS known, claim, status, array_to_string(list_sort(list_distinct(list_filter(list_transform(coalesce(evidence_ids, []), lambda x: lower(trim(x))), lambda x: x <> ''))), ',') AS evidence FROM w LEFT JOIN b ON b.belief_id = w.id""")
def beliefs_by_id(spark: SparkSession, d: str) -> DataFrame:
    """Memories looked up by id, each with its evidence ids in order."""
    w = decisions(spark, d).select(F.col("matched_id").alias("id")).where("id IS NOT NULL").distinct()
    ev = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("evidence_ids", F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x != "")))
    return w.join(beliefs(spark, d), F.col("id") == F.col("belief_id"), "left").select("id", F.col("belief_id").isNotNull().alias("known"), "claim", "status", F.array_join(ev, ",").alias("evidence"))


@query(f"""WITH {B_SQL}, {D_SQL}, {EP_SQL}, w AS (SELECT DISTINCT candidate_id AS id FROM dec UNION SELECT belief_id FROM b WHERE quarantined)
 SELECT id, CASE WHEN b.belief_id IS NOT NULL THEN 'belief' WHEN c.candidate_id IS NOT NULL THEN 'candidate' ELSE '' END AS kind, coalesce(b.claim, c.claim) AS text FROM w LEFT JOIN b ON b.belief_id = w.id LEFT JOIN candidates c ON c.candidate_id = w.id WHERE id IS NOT NULL""")
def resolved_ids(spark: SparkSession, d: str) -> DataFrame:
    """What an id names: a memory first, then a candidate."""
    w = decisions(spark, d).select(F.col("candidate_id").alias("id")).unionByName(beliefs(spark, d).where("quarantined").select(F.col("belief_id").alias("id"))).where("id IS NOT NULL").distinct()
    b = beliefs(spark, d).select(F.col("belief_id").alias("id"), F.col("claim").alias("b_text"), F.lit(True).alias("b"))
    c = table(spark, d, "candidates").select(F.col("candidate_id").alias("id"), F.col("claim").alias("c_text"), F.lit(True).alias("c"))
    return w.join(b, "id", "left").join(c, "id", "left").select("id", F.when(F.col("b"), "belief").when(F.col("c"), "candidate").otherwise("").alias("kind"), F.coalesce("b_text", "c_text").alias("text"))


@query(f"""WITH {T_SQL}, ti AS (SELECT session_id, min(session_title) AS title FROM t GROUP BY 1) SELECT t.session_id, title, turn_id, row_number() OVER (PARTITION BY t.session_id ORDER BY stored_at NULLS FIRST, turn_id) AS pos, role FROM t JOIN ti USING (session_id)""")
def transcript(spark: SparkSession, d: str) -> DataFrame:
    """Turns with the title of their conversation and their place in it, in order of storage."""
    t = turns(spark, d).select("session_id", "session_title", "turn_id", "role", "stored_at")
    titles = t.groupBy("session_id").agg(F.min("session_title").alias("title"))
    placed = running_total(t.drop("session_title"), ["session_id"], ["stored_at", "turn_id"], {"pos": F.lit(1).cast("long")})
    return placed.join(titles, "session_id").select("session_id", "title", "turn_id", "pos", "role")


_ASKS_SQL = "(lower(trim(role)) IN ('user', 'human') AND length(trim(coalesce(content, ''))) > 12 AND NOT regexp_matches(trim(coalesce(content, '')), '^[/!?]'))"


@query(f"""WITH {T_SQL}, o AS (SELECT session_id, turn_id, role, content, row_number() OVER w AS i, sum(CASE WHEN {_ASKS_SQL} THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY stored_at NULLS FIRST, turn_id ROWS UNBOUNDED PRECEDING) AS arc FROM t WINDOW w AS (PARTITION BY session_id ORDER BY stored_at NULLS FIRST, turn_id))
 SELECT session_id, CAST(arc AS BIGINT) AS arc, arg_max(turn_id, i) AS last_turn, arg_max(sha256(content), i) AS answer FROM o WHERE lower(trim(role)) IN ('assistant', 'ai', 'model', 'bot') AND regexp_matches(content, '[^\\s\\pZ\\pC]') GROUP BY 1, 2""")
def arc_answers(spark: SparkSession, d: str) -> DataFrame:
    """The last thing the assistant said in each task arc."""
    said = F.trim(F.coalesce("content", F.lit("")))
    role = F.lower(F.trim("role"))
    asks = role.isin("user", "human") & (F.length(said) > 12) & ~said.rlike(r"^[/!?]")
    answers = role.isin("assistant", "ai", "model", "bot") & F.col("content").rlike(r"[^\p{C}\p{Z}\s]")
    t = turns(spark, d).select("session_id", "turn_id", "stored_at", F.when(asks, 1).otherwise(0).cast("long").alias("asks"), F.when(answers, F.sha2("content", 256)).alias("answer"))
    arcs = running_total(t, ["session_id"], ["stored_at", "turn_id"], {"arc": F.col("asks"), "i": F.lit(1).cast("long")})
    return arcs.where("answer IS NOT NULL").groupBy("session_id", "arc").agg(F.max_by("turn_id", "i").alias("last_turn"), F.max_by("answer", "i").alias("answer"))


@query(f"""WITH {T_SQL}, k AS (SELECT sha256(content) AS digest, session_id, turn_id, stored_at FROM t WHERE content IS NOT NULL AND stored_at IS NOT NULL) SELECT digest, min(stored_at) AS captured_at, arg_min(session_id || '/' || turn_id, (stored_at, session_id, turn_id)) AS source_ref, count(*) AS n FROM k GROUP BY digest""")
def first_evidence(spark: SparkSession, d: str) -> DataFrame:
    """One piece of evidence per content hash: where it was captured first. The texts themselves aren't moved."""
    k = turns(spark, d).where("content IS NOT NULL AND stored_at IS NOT NULL").select(F.sha2("content", 256).alias("digest"), "session_id", "turn_id", "stored_at")
    return k.groupBy("digest").agg(F.min("stored_at").alias("captured_at"), F.min_by(F.concat_ws("/", "session_id", "turn_id"), F.struct("stored_at", "session_id", "turn_id")).alias("source_ref"), F.count("*").alias("n"))


@query(f"WITH {B_SQL} SELECT belief_id, {normal_sql('claim')} AS claim FROM b WHERE status = 'active' AND trim(coalesce(claim, '')) <> ''")
def active_claims(spark: SparkSession, d: str) -> DataFrame:
    """What an extractor's claims are compared with: all active ones, those held back too."""
    return beliefs(spark, d).where("status = 'active' AND trim(coalesce(claim, '')) <> ''").select("belief_id", m.normal_claim(F.col("claim")).alias("claim"))


@query(f"""WITH {T_SQL}, c AS (SELECT DISTINCT session_id, unnest(turn_ids) AS turn_id FROM candidates) SELECT t.source, count(*) AS pending, count(DISTINCT t.session_id) AS sessions FROM t ANTI JOIN c ON c.session_id = t.session_id AND c.turn_id = t.turn_id WHERE regexp_matches(t.content, '[^\\s\\pZ\\pC]') GROUP BY 1""")
def extract_preview(spark: SparkSession, d: str) -> DataFrame:
    """How many turns of how many sessions an extraction would read."""
    cited = table(spark, d, "candidates").select("session_id", F.explode("turn_ids").alias("turn_id")).distinct()
    left = turns(spark, d).where(F.col("content").rlike(r"[^\p{Cf}\p{Cc}\p{Z}\s]")).select("source", "session_id", "turn_id").join(cited, ["session_id", "turn_id"], "left_anti")
    return left.groupBy("source", "session_id").agg(F.count("*").alias("n")).groupBy("source").agg(F.sum("n").alias("pending"), F.count("*").alias("sessions"))


@query(
    "SELECT candidate_id, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN length({f}) > {n} THEN '{f}' END" for f, n in FIELD_LIMITS.items())
    + f", CASE WHEN len(turn_ids) > {MAX_ITEMS} THEN 'turn_ids' END], lambda x: x IS NOT NULL), ',') AS too_long FROM candidates"
)
def argument_caps(spark: SparkSession, d: str) -> DataFrame:
    """Fields of each candidate beyond the limits of the store."""
    return table(spark, d, "candidates").select("candidate_id", F.array_join(violations(FIELD_LIMITS, {"turn_ids": MAX_ITEMS}), ",").alias("too_long"))


# --- an extractor's answer --------------------------------------------------------------------
_SHORT = lambda x: f"left({collapsed_sql(f'coalesce({x}, {chr(39) * 2})')}, {CLAIM_CHARS})"


@query(f"""WITH c AS (SELECT candidate_id, CASE WHEN item_type = '' OR item_type IS NULL THEN 'belief' ELSE lower(trim(item_type)) END AS item_type, {_SHORT('claim')} AS a, {_SHORT('coalesce(nullif(context, ' + chr(39) * 2 + '), user_request)')} AS o, list_distinct(turn_ids[2:]) AS t, turn_ids[2:] AS raw, lower(trim(coalesce(source_class, ''))) AS k FROM candidates),
 e AS (SELECT *, CASE WHEN item_type = 'episode' AND a = '' THEN o ELSE a END AS claim FROM c)
 SELECT candidate_id, item_type, claim, len(t) AS n_cited, CASE WHEN k IN ('user_explicit', 'document') THEN 'document' ELSE 'agent_inference' END AS source_class FROM e WHERE item_type IN ('belief', 'episode') AND claim <> '' AND NOT regexp_matches(claim, '{CONTROL_SQL}') AND len(t) > 0""")
def parsed_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Each candidate as a fenced answer with text around it, read back; the first turn it cites isn't allowed."""
    c = table(spark, d, "candidates")
    row = F.struct(F.col("item_type").alias("type"), "claim", "context", "user_request", "result", "source_class", "turn_ids")
    answer = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(row).alias("candidates"))), F.lit("\n```"))
    mine = F.when(F.size("turn_ids") > 1, F.slice("turn_ids", 2, 10_000)).otherwise(F.array().cast("array<string>"))
    allowed = F.filter(mine, lambda x: x.isNotNull())
    got = candidates_of(c.select(F.col("candidate_id").alias("batch_id"), answer.alias("answer"), allowed.alias("allowed")))
    return got.select(F.col("batch_id").alias("candidate_id"), "item_type", "claim", F.size("turn_ids").cast("long").alias("n_cited"), "source_class")


# --- rendering of the other kinds -------------------------------------------------------------
def _neutral_sql(x: str) -> str:
    one = f"replace(replace({collapsed_sql(x)}, '<', '\\u003c'), '>', '\\u003e')"
    one = f"regexp_replace({one}, '^\\[([^\\]]{{0,159}})\\]', '\\\\u005b\\1\\\\u005d')"
    return f"regexp_replace({one}, '^(?i)({'|'.join(m.ROLE_LABELS)}):', '\\\\\\1:')"


@query(f"""WITH {EP_SQL} SELECT episode_id, '[EPISODE ' || episode_id || ' ' || strftime(ts_start, '%Y-%m-%d') || '] ' || {_neutral_sql('context')} || ' — outcome: ' || outcome || ' | project: ' || project || ' | importance ' || CAST(CAST(floor(importance * 100 + 0.5) / 100 AS DECIMAL(6,2)) AS VARCHAR) AS block FROM ep WHERE outcome = 'failure'""")
def rendered_episodes(spark: SparkSession, d: str) -> DataFrame:
    e = episodes(spark, d).where("outcome = 'failure'")
    block = F.concat(F.lit("[EPISODE "), "episode_id", F.lit(" "), F.date_format("ts_start", "yyyy-MM-dd"), F.lit("] "), m.neutralize(F.col("context")), F.lit(" — outcome: "), "outcome", F.lit(" | project: "), "project", F.lit(" | importance "), (F.floor(F.col("importance") * 100 + 0.5) / 100).cast("decimal(6,2)").cast("string"))
    return e.select("episode_id", block.alias("block"))


@query(f"""WITH {G_SQL} SELECT rel_id, '[GRAPH ' || {_neutral_sql('src')} || ' -[' || {_neutral_sql('rel')} || ']-> ' || {_neutral_sql('dst')} || ' (active)]' AS block FROM g WHERE rel = 'PART_OF'""")
def rendered_edges(spark: SparkSession, d: str) -> DataFrame:
    block = F.concat(F.lit("[GRAPH "), m.neutralize(F.col("src")), F.lit(" -["), m.neutralize(F.col("rel")), F.lit("]-> "), m.neutralize(F.col("dst")), F.lit(" (active)]"))
    return edges(spark, d).where("rel = 'PART_OF'").select("rel_id", block.alias("block"))


@query("""SELECT doc_id, text IS NULL OR NOT regexp_matches(text, '[^\\s\\pZ\\pC]') AS blank, CASE WHEN text IS NOT NULL AND regexp_matches(text, '[^\\s\\pZ\\pC]') THEN '<recalled_memory>' || chr(10) || text || chr(10) || '</recalled_memory>' ELSE '' END AS framed FROM documents""")
def framed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Recalled text inside its frame; what shows nothing has none."""
    blank = is_blank(F.col("text"))
    return table(spark, d, "documents").select("doc_id", blank.alias("blank"), F.when(~blank, F.concat(F.lit("<recalled_memory>\n"), "text", F.lit("\n</recalled_memory>"))).otherwise("").alias("framed"))

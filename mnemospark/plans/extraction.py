"""Extraction-side queries: caps, references, remapped classes, control text, entity links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import memory as m
from mnemospark.functions.text import words
from mnemospark.plans.base import B_SQL, EP_SQL, T_SQL, beliefs, episodes, query, turns
from mnemospark.session import table

#: Characters and items that a stored field may have.
FIELD_LIMITS = {"claim": 32000, "context": 32000, "user_request": 8000, "result": 32000, "session_id": 128}
MAX_ITEMS = 256
#: The narrower caps of a one-line listing.
LINE_LIMITS, LINE_ITEMS = {"claim": 180, "context": 80, "user_request": 60, "result": 60, "session_id": 128}, 2
CONTROL = CONTROL_SQL = m.CONTROL


def violations(limits: dict[str, int] = FIELD_LIMITS, items: dict[str, int] | None = None) -> Column:
    """Names of the text fields longer than their limit and of the lists with more items than theirs; nulls are within any."""
    tests = [F.when(F.length(f) > n, f) for f, n in limits.items()] + [F.when(F.size(f) > n, f) for f, n in (items or {}).items()]
    return F.array_compact(F.array(*tests))


@query(
    "SELECT candidate_id, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN length({f}) > {n} THEN '{f}' END" for f, n in LINE_LIMITS.items())
    + f", CASE WHEN len(turn_ids) > {LINE_ITEMS} THEN 'turn_ids' END], lambda x: x IS NOT NULL), ',') AS too_long FROM candidates"
)
def over_caps(spark: SparkSession, d: str) -> DataFrame:
    """Fields of each candidate that are too long for a one-line listing."""
    return table(spark, d, "candidates").select("candidate_id", F.array_join(violations(LINE_LIMITS, {"turn_ids": LINE_ITEMS}), ",").alias("too_long"))


@query(
    f"""WITH {T_SQL} SELECT session_id, turn_id, '{{"kind":"ingest_turn","source":"' || source || '","session_id":"' || session_id || '","turn_id":"' || turn_id || '"}}' AS ref,
 strftime(make_timestamp(CAST(floor(CASE WHEN occurred_at > 1e11 THEN occurred_at / 1000 ELSE occurred_at END) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS said_at FROM t WHERE occurred_at IS NOT NULL"""
)
def turn_references(spark: SparkSession, d: str) -> DataFrame:
    """A compact JSON reference and an ISO time for every timed turn."""
    ref = F.to_json(F.struct(F.lit("ingest_turn").alias("kind"), "source", "session_id", "turn_id"))
    at = F.when(F.col("occurred_at") > 1e11, F.col("occurred_at") / 1000).otherwise(F.col("occurred_at"))
    iso = F.date_format(F.to_utc_timestamp(F.timestamp_seconds(F.floor(at)), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return turns(spark, d).where("occurred_at IS NOT NULL").select("session_id", "turn_id", ref.alias("ref"), iso.alias("said_at"))


@query("""SELECT candidate_id, CASE lower(trim(coalesce(source_class, ''))) WHEN 'user_explicit' THEN 'document' WHEN 'document' THEN 'document' ELSE 'agent_inference' END AS source_class FROM candidates""")
def extracted_class(spark: SparkSession, d: str) -> DataFrame:
    """What an extracted claim may say of its origin: it is never the user's own word."""
    plain = F.lower(F.trim(F.coalesce("source_class", F.lit(""))))
    return table(spark, d, "candidates").select("candidate_id", F.when(plain.isin("user_explicit", "document"), "document").otherwise("agent_inference").alias("source_class"))


@query(f"""SELECT doc_kind, count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '{CONTROL}')) AS control FROM documents WHERE text IS NOT NULL GROUP BY doc_kind""")
def control_text(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold tool-call or frame marks, by kind."""
    return table(spark, d, "documents").where("text IS NOT NULL").groupBy("doc_kind").agg(F.count("*").alias("n"), F.count_if(F.col("text").rlike(CONTROL)).alias("control"))


@query(f"""WITH {B_SQL}, w AS (SELECT belief_id, ' ' || array_to_string(regexp_extract_all(lower(claim), '[\\pL\\pN]+'), ' ') || ' ' AS said FROM b WHERE status = 'active' AND claim IS NOT NULL), e AS (SELECT DISTINCT array_to_string(regexp_extract_all(lower(project), '[\\pL\\pN]+'), ' ') AS name FROM documents WHERE project IS NOT NULL UNION SELECT DISTINCT array_to_string(list_slice(regexp_extract_all(lower(claim), '[\\pL\\pN]+'), 1, 2), ' ') FROM candidates WHERE item_type = 'episode')
 SELECT name, count(*) AS n_beliefs, min(belief_id) AS first_belief FROM w JOIN e ON contains(w.said, ' ' || e.name || ' ') WHERE name <> '' GROUP BY name""")
def entity_links(spark: SparkSession, d: str) -> DataFrame:
    """Memories that name an entity of one or several words: projects, and the first two words of episodes."""
    named = table(spark, d, "documents").where("project IS NOT NULL").select(words(F.col("project")).alias("w"))
    opened = table(spark, d, "candidates").where("item_type = 'episode' AND claim IS NOT NULL").select(F.slice(words(F.col("claim")), 1, 2).alias("w"))
    names = named.unionByName(opened).select(F.array_join("w", " ").alias("name")).where("name <> ''").distinct()
    said = beliefs(spark, d).where("status = 'active' AND claim IS NOT NULL").select("belief_id", words(F.col("claim")).alias("w"))
    return names_held(said, names).groupBy("name").agg(F.count("*").alias("n_beliefs"), F.min("belief_id").alias("first_belief"))


def names_held(said: DataFrame, names: DataFrame) -> DataFrame:
    """(belief_id, name): which names(name), of any number of words, stand in said(belief_id, w) word by word.

    A name is joined on itself with the runs of as many words in each text; only lengths that names have are cut.
    """
    lengths = sorted(r[0] for r in names.select(F.size(F.split("name", " ")).alias("n")).distinct().collect())  # a few lengths
    none = said.select("belief_id", F.lit("").alias("name")).where(F.lit(False))
    at = said.select("belief_id", "w", F.posexplode("w").alias("i", "word"))
    for n in lengths:
        run = F.col("word") if n == 1 else F.array_join(F.slice("w", F.col("i") + 1, n), " ")
        none = none.unionByName(at.where(F.col("i") + n <= F.size("w")).select("belief_id", run.alias("name")))
    return none.join(names, "name").select("belief_id", "name").distinct()


@query(f"""WITH {EP_SQL} SELECT project AS src, 'OBSERVED_IN' AS rel, 'actor:' || actor_id AS dst, count(*) AS n_sources, min(ts_start) AS valid_from FROM ep GROUP BY 1, 2, 3""")
def observed_edges(spark: SparkSession, d: str) -> DataFrame:
    """One edge from a project to each actor seen in its episodes, however often it is run."""
    return episodes(spark, d).groupBy(F.col("project").alias("src"), F.lit("OBSERVED_IN").alias("rel"), F.concat(F.lit("actor:"), "actor_id").alias("dst")).agg(F.count("*").alias("n_sources"), F.min("ts_start").alias("valid_from"))


@query(f"""WITH {T_SQL}, e AS (SELECT session_id, min(turn_id) AS first_turn, min(content) AS content FROM t WHERE content IS NOT NULL GROUP BY session_id, sha256(content)) SELECT sha256(content) AS digest, count(*) AS sessions, min(session_id) AS first_session FROM e GROUP BY 1 HAVING count(*) > 3""")
def repeated_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Contents, by hash, that several sessions hold; the session is folded in first, so no text is moved."""
    h = turns(spark, d).where("content IS NOT NULL").select("session_id", F.sha2("content", 256).alias("digest")).distinct()
    return h.groupBy("digest").agg(F.count("*").alias("sessions"), F.min("session_id").alias("first_session")).where("sessions > 3")

"""Upkeep: forgetting, compression, edges from decisions, entities, warnings, and claims that are known already."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.functions import memory as m
from mnemospark.operators.containment import LEAST, contained
from mnemospark.operators.lifecycle import next_ids
from mnemospark.plans.base import B_SQL, D_SQL, EP_SQL, G_SQL, T_SQL, beliefs, decisions, edges, episodes, normal_sql, query, turns
from mnemospark.plans.structure import TREE_SQL
from mnemospark.plans.texts import EVENTS_AS_OF
from mnemospark.session import Scratch, table
from mnemospark.sources.chat_tree import flatten_exports

_AGE = f"greatest(0.0, epoch_us(TIMESTAMP '{EVENTS_AS_OF}' - ts_start) / 86400000000.0)"
_STEP = "greatest(0.05, importance * CASE WHEN importance >= 0.35 THEN 0.85 ELSE 0.7 END)"


@query(f"""WITH {EP_SQL}, g AS (SELECT project, left(trim(context), 50) AS pattern, outcome FROM ep GROUP BY 1, 2, 3 HAVING count(*) >= 3)
 SELECT episode_id, round(CASE WHEN importance < 0.7 AND {_AGE} >= 1.0 AND {_STEP} < importance THEN {_STEP} ELSE importance END, 6) AS importance, CASE WHEN g.pattern IS NOT NULL THEN 'compressed' ELSE 'active' END AS status FROM ep LEFT JOIN g ON g.project = ep.project AND g.pattern = left(trim(ep.context), 50) AND g.outcome = ep.outcome""")
def forgetting_pass(spark: SparkSession, d: str) -> DataFrame:
    """One pass over all episodes: importance decays, and what a summary stands for is compressed."""
    e = episodes(spark, d).withColumn("pattern", F.substring(F.trim("context"), 1, 50))
    keys = ["project", "pattern", "outcome"]
    many = e.groupBy(*keys).agg(F.count("*").alias("n")).where("n >= 3")
    aged = m.decayed(F.col("importance"), m.age_days(F.col("ts_start"), EVENTS_AS_OF))
    return e.join(many, keys, "left").select("episode_id", F.round(aged, 6).alias("importance"), F.when(F.col("n").isNotNull(), "compressed").otherwise("active").alias("status"))


@query(f"""WITH {EP_SQL} SELECT project, 'Generalized: ' || CASE WHEN left(trim(context), 50) <> '' THEN left(trim(context), 50) ELSE project END || ' (' || count(*) || ' similar ' || outcome || ' episodes)' AS context, CASE WHEN outcome IN ('success', 'failure', 'mixed') THEN outcome ELSE 'unknown' END AS outcome,
 round(max(importance), 6) AS importance, count(*) AS members, min(episode_id) AS first_id FROM ep GROUP BY project, left(trim(context), 50), ep.outcome HAVING count(*) >= 3""")
def compressed_episodes(spark: SparkSession, d: str) -> DataFrame:
    """The summaries that stand for three or more episodes of one project, context and outcome. Members stay rows of their own, with the summary's key."""
    g = episodes(spark, d).groupBy("project", F.substring(F.trim("context"), 1, 50).alias("pattern"), F.col("outcome").alias("o")).agg(F.count("*").alias("members"), F.max("importance").alias("top"), F.min("episode_id").alias("first_id")).where("members >= 3")
    name = F.when(F.col("pattern") != "", F.col("pattern")).otherwise(F.col("project"))
    text = F.concat(F.lit("Generalized: "), name, F.lit(" ("), F.col("members").cast("string"), F.lit(" similar "), "o", F.lit(" episodes)"))
    return g.select("project", text.alias("context"), F.when(F.col("o").isin("success", "failure", "mixed"), F.col("o")).otherwise("unknown").alias("outcome"), F.round("top", 6).alias("importance"), "members", "first_id")


_RELS = {"reinforcement": "SUPPORTED_BY", "contradiction": "CONTRADICTED_BY", "update": "DERIVED_FROM"}


@query(f"""WITH {D_SQL}, x AS (SELECT 'belief:' || matched_id AS a, 'belief:' || candidate_id AS b, classification AS c FROM dec WHERE coalesce(matched_id, '') <> '' AND candidate_id IS NOT NULL)
 SELECT src, rel, dst, 0.6e0 AS confidence, count(*) AS n FROM (SELECT a AS src, 'SUPPORTED_BY' AS rel, b AS dst FROM x WHERE c = 'reinforcement' UNION ALL SELECT a, 'CONTRADICTED_BY', b FROM x WHERE c = 'contradiction' UNION ALL SELECT b, 'CONTRADICTED_BY', a FROM x WHERE c = 'contradiction' UNION ALL SELECT b, 'DERIVED_FROM', a FROM x WHERE c = 'update') GROUP BY 1, 2, 3""")
def decision_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges between memories, as nodes of the graph, that decisions give: support, contradiction both ways, derivation."""
    x = decisions(spark, d).where("matched_id <> '' AND candidate_id IS NOT NULL").select(F.concat(F.lit("belief:"), "matched_id").alias("a"), F.concat(F.lit("belief:"), "candidate_id").alias("b"), "classification")
    way = lambda kind, s, o: x.where(F.col("classification") == kind).select(F.col(s).alias("src"), F.lit(_RELS[kind]).alias("rel"), F.col(o).alias("dst"))
    out = way("reinforcement", "a", "b").unionByName(way("contradiction", "a", "b")).unionByName(way("contradiction", "b", "a")).unionByName(way("update", "b", "a"))
    return out.groupBy("src", "rel", "dst").agg(F.lit(0.6).alias("confidence"), F.count("*").alias("n")).select("src", "rel", "dst", "confidence", "n")


@query(f"""WITH {G_SQL}, n AS (SELECT DISTINCT trim(name) AS name FROM (SELECT src AS name FROM g WHERE rel = 'PART_OF' UNION ALL SELECT dst FROM g WHERE rel = 'PART_OF')) SELECT 'N-' || lpad(CAST(row_number() OVER (ORDER BY name) AS VARCHAR), 10, '0') AS id, name, CASE split_part(name, ':', 1) WHEN 'customer' THEN 'person' WHEN 'supplier' THEN 'person' WHEN 'nation' THEN 'place' WHEN 'region' THEN 'place' ELSE 'object' END AS type FROM n""")
def entity_ids(spark: SparkSession, d: str) -> DataFrame:
    """One entity per name, with ids dense in order of the name; ranks come from a running total, so no task holds all names."""
    g = edges(spark, d).where("rel = 'PART_OF'")
    names = g.select(F.trim("src").alias("name")).unionByName(g.select(F.trim("dst").alias("name"))).distinct()
    ids = next_ids(spark.createDataFrame([], "id string"), names, "N", ["name"])
    kind = F.split_part("name", F.lit(":"), F.lit(1))
    return ids.select("id", "name", F.when(kind.isin("customer", "supplier"), "person").when(kind.isin("nation", "region"), "place").otherwise("object").alias("type"))


@query(f"WITH {G_SQL} SELECT rel_id, src, rel, dst FROM g WHERE rel = 'PART_OF' AND dst = 'nation:3'")
def edges_about(spark: SparkSession, d: str) -> DataFrame:
    """Edges by any of source, kind and target; here by two of the three."""
    wanted = {"src": None, "rel": "PART_OF", "dst": "nation:3"}
    out = edges(spark, d)
    for name, value in wanted.items():
        out = out.where(F.col(name) == value) if value is not None else out
    return out.select("rel_id", "src", "rel", "dst")


_TROUBLE = "error|exception|traceback|failed|failure|denied"


@query(f"""WITH {T_SQL} SELECT session_id, turn_id, CASE WHEN regexp_matches(lower(left(content, 500)), '{_TROUBLE}') THEN 'problem_discovered,physical_action' ELSE 'physical_action' END AS signals FROM t WHERE lower(trim(role)) = 'tool' AND content IS NOT NULL""")
def turn_signals(spark: SparkSession, d: str) -> DataFrame:
    """What a tool's answer says about a turn: that something was done, and whether it went wrong."""
    t = turns(spark, d).where((F.lower(F.trim("role")) == "tool") & F.col("content").isNotNull())
    wrong = F.lower(F.substring("content", 1, 500)).rlike(_TROUBLE)
    return t.select("session_id", "turn_id", F.when(wrong, "problem_discovered,physical_action").otherwise("physical_action").alias("signals"))


@query(f"""{TREE_SQL}, x AS (SELECT export_id, k, unnest(ch) AS child, generate_subscripts(ch, 1) AS pos FROM n), f AS (SELECT export_id, k, child, min(pos) AS pos FROM x GROUP BY 1, 2, 3)
 SELECT x.export_id, x.k AS node_id, x.child AS child_id, CASE WHEN f.pos < x.pos THEN 'repeated' ELSE 'unknown' END AS warning FROM x JOIN f ON f.export_id = x.export_id AND f.k = x.k AND f.child = x.child LEFT JOIN n ON n.export_id = x.export_id AND n.k = x.child WHERE f.pos < x.pos OR n.k IS NULL""")
def export_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Children that are listed twice or that the mapping lacks; what is read goes on without them."""
    c = flatten_exports(table(spark, d, "chat_exports"), "children")
    first = c.groupBy("export_id", "node_id", "child_id").agg(F.min("pos").alias("first"))
    again = F.col("pos") > F.col("first")
    return c.join(first, ["export_id", "node_id", "child_id"]).where(again | ~F.col("known")).select("export_id", "node_id", "child_id", F.when(again, "repeated").otherwise("unknown").alias("warning"))


_KNOWN = f"""WITH {B_SQL}, a AS (SELECT DISTINCT {normal_sql('claim')} AS hay FROM b WHERE status = 'active' AND trim(coalesce(claim, '')) <> ''), c AS (SELECT candidate_id, {normal_sql("coalesce(claim, '')")} AS needle FROM candidates)
 SELECT candidate_id, needle = '' OR EXISTS (SELECT 1 FROM a WHERE hay <> '' AND (hay = needle OR (length(needle) >= {LEAST} AND (contains(hay, needle) OR contains(needle, hay))))) AS known FROM c"""


@query(_KNOWN)
def known_claims(spark: SparkSession, d: str) -> DataFrame:
    """Whether a new claim is blank, equal to an active one, or (from 24 characters on) stands in one or holds one."""
    text = m.normal_claim(F.coalesce("claim", F.lit("")))
    scratch, key = Scratch(spark), F.md5("text").alias("id")
    old = scratch.save(beliefs(spark, d).where("status = 'active'").select(text.alias("text")).where("text <> ''").distinct().select(key, "text"))
    new = table(spark, d, "candidates").select("candidate_id", text.alias("text")).select("candidate_id", key, (F.col("text") == "").alias("blank"), "text")
    needles = scratch.save(new.where(F.length("text") >= LEAST).select("id", "text").distinct())
    found = contained(needles, old).select(F.col("inner_id").alias("id")).unionByName(contained(old, needles).select(F.col("outer_id").alias("id")))
    found = found.unionByName(old.select("id")).distinct().withColumn("found", F.lit(True))
    return new.join(found, "id", "left").select("candidate_id", (F.col("blank") | F.coalesce("found", F.lit(False))).alias("known"))


@query(f"""WITH k AS ({_KNOWN}), c AS (SELECT *, {normal_sql("coalesce(claim, '')")} AS n FROM candidates), f AS (SELECT n, min(candidate_id) AS first_id FROM c JOIN k USING (candidate_id) WHERE NOT known AND len(turn_ids) > 0 GROUP BY n)
 SELECT c.candidate_id, CASE WHEN known OR len(coalesce(turn_ids, [])) = 0 OR c.candidate_id <> f.first_id THEN 'skip' WHEN item_type = 'episode' THEN 'episode' ELSE 'belief' END AS written, 0.4e0 AS confidence, true AS quarantined FROM c JOIN k USING (candidate_id) LEFT JOIN f ON f.n = c.n""")
def written_candidates(spark: SparkSession, d: str) -> DataFrame:
    """What the extractor's writer does with each candidate: skips what is known, cites nothing or repeats one before it, and holds the rest back."""
    c = table(spark, d, "candidates").select("candidate_id", "item_type", m.normal_claim(F.coalesce("claim", F.lit(""))).alias("n"), F.size(F.coalesce("turn_ids", F.array().cast("array<string>"))).alias("cited")).join(known_claims(spark, d), "candidate_id")
    first = c.where("NOT known AND cited > 0").groupBy("n").agg(F.min("candidate_id").alias("first_id"))
    skip = F.col("known") | (F.col("cited") == 0) | (F.col("candidate_id") != F.col("first_id"))
    return c.join(first, "n", "left").select("candidate_id", F.when(skip, "skip").when(F.col("item_type") == "episode", "episode").otherwise("belief").alias("written"), F.lit(0.4).alias("confidence"), F.lit(True).alias("quarantined"))


@query("""SELECT path, archive_id, rank FROM (SELECT original_path AS path, archive_id, row_number() OVER (PARTITION BY original_path ORDER BY captured_at DESC NULLS LAST, archive_id DESC) AS rank FROM archives WHERE original_path IS NOT NULL) WHERE rank <= 3""")
def kept_backups(spark: SparkSession, d: str) -> DataFrame:
    """The newest three captures of each path; three are kept map-side before anything is moved."""
    newest = Window.partitionBy("original_path").orderBy(F.col("captured_at").desc_nulls_last(), F.desc("archive_id"))
    a = table(spark, d, "archives").where("original_path IS NOT NULL").select("original_path", "archive_id", "captured_at")
    return a.withColumn("rank", F.row_number().over(newest)).where("rank <= 3").select(F.col("original_path").alias("path"), "archive_id", F.col("rank").cast("long").alias("rank"))

"""Sessions, indexes and streams."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.operators.batches import greedy_batches
from mnemospark.operators.running import running_total
from mnemospark.plans.base import B_SQL, T_SQL, beliefs, query, turns
from mnemospark.plans.recall import TERMS, search_index
from mnemospark.session import shared_dir, table
from mnemospark.streaming import sessions as streams

_BATCH_SQL = f"""WITH RECURSIVE {T_SQL}, o AS (SELECT session_id, turn_id, coalesce(length(content), 0) AS n, row_number() OVER (PARTITION BY session_id ORDER BY stored_at NULLS FIRST, turn_id) AS i FROM t),
 w AS (SELECT session_id, turn_id, i, 0 AS batch, 1 AS k, n AS c FROM o WHERE i = 1
  UNION ALL SELECT o.session_id, o.turn_id, o.i, CASE WHEN w.k >= 12 OR w.c + o.n > 4000 THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.k >= 12 OR w.c + o.n > 4000 THEN 1 ELSE w.k + 1 END, CASE WHEN w.k >= 12 OR w.c + o.n > 4000 THEN o.n ELSE w.c + o.n END FROM w JOIN o ON o.session_id = w.session_id AND o.i = w.i + 1)
 SELECT session_id, CAST(batch AS BIGINT) AS batch, count(*) AS n_turns, min(turn_id) AS a_turn FROM w GROUP BY 1, 2"""


@query(_BATCH_SQL)
def turn_batches(spark: SparkSession, d: str) -> DataFrame:
    """Turns packed for an extractor: 12 turns or 4,000 characters at most, never across sessions."""
    t = turns(spark, d).select("session_id", "turn_id", "stored_at", F.length("content").alias("n"))
    packed = greedy_batches(t, ["session_id"], ["stored_at", "turn_id"], "turn_id", "n", max_turns=12, max_chars=4000)
    return packed.groupBy("session_id", "batch").agg(F.count("*").alias("n_turns"), F.min("turn_id").alias("a_turn"))


@query(f"""WITH {T_SQL} SELECT session_id, turn_id, sum(coalesce(length(content), 0)) OVER (PARTITION BY session_id ORDER BY stored_at NULLS FIRST, turn_id ROWS UNBOUNDED PRECEDING)::BIGINT AS chars, row_number() OVER (PARTITION BY session_id ORDER BY stored_at NULLS FIRST, turn_id) AS nth FROM t""")
def running_chars(spark: SparkSession, d: str) -> DataFrame:
    """Characters said so far in each session, whatever its size."""
    t = turns(spark, d).select("session_id", "turn_id", "stored_at", F.length("content").cast("long").alias("n"))
    out = running_total(t, ["session_id"], ["stored_at", "turn_id"], {"chars": F.col("n"), "nth": F.lit(1).cast("long")})
    return out.select("session_id", "turn_id", "chars", "nth")


@query(f"""WITH {T_SQL}, p AS (SELECT session_id, turn_id, role, on_current_path FROM t) SELECT session_id, count(*) FILTER (WHERE on_current_path) AS on_path, count(*) FILTER (WHERE NOT on_current_path) AS aside, count(DISTINCT role) AS n_roles FROM p GROUP BY session_id HAVING count(*) FILTER (WHERE NOT on_current_path) > 0""")
def alternate_turns(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with turns off the current path."""
    t = turns(spark, d).groupBy("session_id").agg(F.count_if("on_current_path").alias("on_path"), F.count_if(~F.col("on_current_path")).alias("aside"), F.count_distinct("role").alias("n_roles"))
    return t.where("aside > 0")


@query(f"""WITH {B_SQL}, c AS (SELECT 'belief' AS kind, belief_id AS id, claim AS body FROM b UNION ALL SELECT 'candidate', candidate_id, concat_ws(' ', context, user_request, claim, result) FROM candidates),
 w AS (SELECT kind, id, unnest(regexp_extract_all(lower(coalesce(body, '')), '[\\pL\\pN]+')) AS term FROM c) SELECT term, count(DISTINCT kind || id) AS df, count(*) AS tf FROM w WHERE term IN ('sensor', 'limit', 'watts', 'harbor', 'relay') GROUP BY term""")
def term_postings(spark: SparkSession, d: str) -> DataFrame:
    """Frequencies of the queried terms, read from the index folders that hold them."""
    return search_index(spark, d).postings(TERMS).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query(f"""WITH {B_SQL}, e AS (SELECT actor_id, kind, count(*) AS n, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE quarantined) AS held, round(avg(importance), 6) AS importance FROM b GROUP BY 1, 2) SELECT * FROM e""")
def actor_profile(spark: SparkSession, d: str) -> DataFrame:
    """What each actor wrote, by kind; actors are skewed, counts combine map-side."""
    return beliefs(spark, d).groupBy("actor_id", "kind").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.coalesce("quarantined", F.lit(False))).alias("held"), F.round(F.avg("importance"), 6).alias("importance"))


@query("""SELECT date_trunc('hour', ts) AS hour, user_id, count(*) AS n, count(*) > 3 AS over_limit FROM events GROUP BY 1, 2""")
def quota_stream(spark: SparkSession, d: str) -> DataFrame:
    """The streaming twin of hourly_quota with its watermark of an hour, run over all that is there and then stopped; counts only grow, so the last one holds."""
    schema = table(spark, d, "events").schema
    where = f"{shared_dir(spark)}/quota-{uuid.uuid4().hex}"
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(os.path.join(d, "events.parquet*"))

    def keep(counts: DataFrame, _: int) -> None:
        counts.write.mode("append").parquet(f"{where}/out")

    q = streams.hourly_quota(source, 3).writeStream.outputMode("update").option("checkpointLocation", f"{where}/state").foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    seen = spark.read.schema("hour timestamp, user_id bigint, n bigint, over_limit boolean").parquet(f"{where}/out")
    return seen.groupBy(F.col("hour").cast("timestamp_ntz").alias("hour"), "user_id").agg(F.max("n").alias("n"), F.max("over_limit").alias("over_limit"))

"""What the query modules share: registration and the model tables derived from the given ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.session import table

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL twin if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def beliefs(spark: SparkSession, d: str) -> DataFrame:
    """One row per id; repeated deliveries are the same record."""
    return table(spark, d, "beliefs").dropDuplicates(["belief_id"])


def decisions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "decisions").dropDuplicates(["decision_id"])


def turns(spark: SparkSession, d: str) -> DataFrame:
    """One row per session and turn: the copy that was stored first."""
    t = table(spark, d, "turns")
    rest = [c for c in t.columns if c not in ("session_id", "turn_id")]
    picked = t.groupBy("session_id", "turn_id").agg(F.min_by(F.struct(*rest), F.struct("stored_at", "archive_id", "content")).alias("r"))
    return picked.select("session_id", "turn_id", "r.*")


def episodes(spark: SparkSession, d: str) -> DataFrame:
    """Events as episodes: project by user, context from type and key, outcome from type."""
    kind = F.col("event_type")
    return table(spark, d, "events").select(
        F.concat(F.lit("E-"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("episode_id"),
        F.col("ts").alias("ts_start"),
        F.col("user_id").cast("string").alias("actor_id"),
        F.concat(F.lit("P"), (F.col("user_id") % 5).cast("string")).alias("project"),
        F.concat(kind, F.lit(" "), F.get_json_object("props", "$.k")).alias("context"),
        F.when(kind.isin("purchase", "signup"), "success").when(kind == "error", "failure").when(kind == "click", "mixed").otherwise("unknown").alias("outcome"),
        F.least(F.lit(1.0), F.col("value") / F.lit(100.0)).alias("importance"),
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(rel_id, src, rel, dst): places, customers, orders and suppliers as a graph."""
    name = lambda kind, key: F.concat(F.lit(kind + ":"), F.col(key).cast("string"))

    def rel(t: str, src: tuple, kind: str, dst: tuple) -> DataFrame:
        s, o = name(*src), name(*dst)
        return table(spark, d, t).select(F.concat_ws("|", s, F.lit(kind), o).alias("rel_id"), s.alias("src"), F.lit(kind).alias("rel"), o.alias("dst"))

    parts = [
        rel("nation", ("nation", "n_nationkey"), "PART_OF", ("region", "n_regionkey")),
        rel("supplier", ("supplier", "s_suppkey"), "PART_OF", ("nation", "s_nationkey")),
        rel("customer", ("customer", "c_custkey"), "PART_OF", ("nation", "c_nationkey")),
        rel("orders", ("customer", "o_custkey"), "OWNS", ("order", "o_orderkey")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- the same tables for the SQL twins --------------------------------------------------------
B_SQL = "b AS (SELECT DISTINCT ON (belief_id) * FROM beliefs)"
D_SQL = "dec AS (SELECT DISTINCT ON (decision_id) * FROM decisions)"
T_SQL = "t AS (SELECT DISTINCT ON (session_id, turn_id) * FROM turns ORDER BY session_id, turn_id, stored_at, archive_id, content)"
EP_SQL = """ep AS (SELECT 'E-' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS episode_id, ts AS ts_start, CAST(user_id AS VARCHAR) AS actor_id,
  'P' || CAST(user_id % 5 AS VARCHAR) AS project, event_type || ' ' || (props ->> '$.k') AS context,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'success' WHEN event_type = 'error' THEN 'failure' WHEN event_type = 'click' THEN 'mixed' ELSE 'unknown' END AS outcome,
  least(1.0, value / 100.0) AS importance FROM events)"""
G_SQL = """g0 AS (SELECT 'nation:' || n_nationkey AS src, 'PART_OF' AS rel, 'region:' || n_regionkey AS dst FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, 'PART_OF', 'nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, 'PART_OF', 'nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'customer:' || o_custkey, 'OWNS', 'order:' || o_orderkey FROM orders),
 g AS (SELECT src || '|' || rel || '|' || dst AS rel_id, * FROM g0)"""


def collapsed_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\s\\pZ]+', ' ', 'g'))"


def normal_sql(x: str) -> str:
    return collapsed_sql(f"lower({x})")


def strict_sql(x: str) -> str:
    return collapsed_sql(f"regexp_replace(lower({x}), '[^a-z0-9''\\s]+', ' ', 'g')")


def literal(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"

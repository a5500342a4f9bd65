"""Queries over nested exports and turn trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.memory import SKIPPED_CONTENT
from mnemospark.operators.forest import forest, tree_paths
from mnemospark.session import table
from mnemospark.sources.chat_tree import flatten_exports


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return flatten_exports(table(spark, d, "chat_exports"), "links")


def p1_nodes(spark: SparkSession, d: str) -> DataFrame:
    return flatten_exports(table(spark, d, "chat_exports"), "nodes")


def p1_messages(spark: SparkSession, d: str) -> DataFrame:
    return flatten_exports(table(spark, d, "chat_exports"), "messages")


def p1_children(spark: SparkSession, d: str) -> DataFrame:
    """Child lists as they are written, with places; known is false where the mapping lacks the key."""
    return flatten_exports(table(spark, d, "chat_exports"), "children")


def p1_parts(spark: SparkSession, d: str) -> DataFrame:
    return flatten_exports(table(spark, d, "chat_exports"), "parts")


def p1_metadata(spark: SparkSession, d: str) -> DataFrame:
    return flatten_exports(table(spark, d, "chat_exports"), "metadata")


def p1_order(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of each conversation in depth-first order of its child lists."""
    return flatten_exports(table(spark, d, "chat_exports"), "order")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    tree = forest(table(spark, d, "turns"), "session_id", "turn_id", "parent_turn_id", hint="occurred_at")
    return tree.select("session_id", "turn_id", F.col("root").alias("root_turn_id"), F.col("depth").cast("long").alias("depth"), F.col("n_below").cast("long").alias("n_below"))


def p7_paths(spark: SparkSession, d: str) -> DataFrame:
    """The path from the root to every turn; '' on and under loops."""
    paths = tree_paths(table(spark, d, "turns"), "session_id", "turn_id", "parent_turn_id", hint="occurred_at")
    return paths.select("session_id", "turn_id", F.coalesce(F.array_join("path", "/"), F.lit("")).alias("path"))


def p7_descendants(spark: SparkSession, d: str) -> DataFrame:
    """(session_id, turn_id, below_id, distance): every turn with each of its descendants; as large as the sum of depths."""
    paths = tree_paths(table(spark, d, "turns"), "session_id", "turn_id", "parent_turn_id", hint="occurred_at").where("size(path) > 1")
    above = paths.select("session_id", F.col("turn_id").alias("below_id"), F.size("path").alias("n"), F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("at", "turn_id"))
    return above.select("session_id", "turn_id", "below_id", (F.col("n") - 1 - F.col("at")).cast("long").alias("distance"))


TREE_SQL = """WITH RECURSIVE e AS (SELECT export_id, current_node, unnest(json_keys(mapping)) AS k, mapping FROM chat_exports WHERE json_valid(mapping)),
 n0 AS (SELECT export_id, current_node, k, json_extract(mapping, '$."' || k || '"') AS j FROM e),
 n AS (SELECT export_id, current_node, k, j, j ->> '$.parent' AS p, CAST(j -> '$.children' AS VARCHAR[]) AS ch FROM n0),
 c AS (SELECT export_id, k AS q, unnest(ch) AS x FROM n), cl AS (SELECT export_id, x, min(q) AS q FROM c WHERE q <> x GROUP BY 1, 2),
 u AS (SELECT n.export_id, n.k, n.current_node, n.j, CASE WHEN pp.k IS NOT NULL THEN n.p ELSE cl.q END AS up FROM n LEFT JOIN n pp ON pp.export_id = n.export_id AND pp.k = n.p LEFT JOIN cl ON cl.export_id = n.export_id AND cl.x = n.k),
 w AS (SELECT export_id, k, up FROM u WHERE k = current_node UNION SELECT u.export_id, u.k, u.up FROM u JOIN w ON w.export_id = u.export_id AND u.k = w.up),
 v AS (SELECT u.*, CAST(w.k IS NOT NULL AS BIGINT) AS on_path FROM u LEFT JOIN w ON w.export_id = u.export_id AND w.k = u.k)"""
_STRING = "CASE json_type({0}) WHEN 'VARCHAR' THEN {0} ->> '$' WHEN 'OBJECT' THEN CASE WHEN json_type({0}, '$.text') = 'VARCHAR' THEN {0} ->> '$.text' END END"
_SKIPPED = ", ".join(f"'{t}'" for t in SKIPPED_CONTENT)

QUERIES = {f.__name__: f for f in (p1_found, p1_nodes, p1_messages, p1_children, p1_parts, p1_metadata, p1_order, p7_found, p7_paths, p7_descendants)}

SQL = {
    "p1_nodes": f"""{TREE_SQL}, kids AS (SELECT export_id, up, count(*) AS n FROM u WHERE up IS NOT NULL GROUP BY 1, 2)
 SELECT v.export_id, v.k AS node_id, v.up AS parent_id, coalesce(kids.n, 0) AS n_children, coalesce(json_type(j, '$.message') = 'OBJECT', false) AS has_message, on_path FROM v LEFT JOIN kids ON kids.export_id = v.export_id AND kids.up = v.k""",
    "p1_messages": f"""{TREE_SQL}, m AS (SELECT export_id, k, on_path, j -> '$.message' AS m, list_filter(list_transform(CAST(j -> '$.message.content.parts' AS JSON[]), lambda x: {_STRING.format('x')}), lambda x: x IS NOT NULL) AS parts FROM v WHERE json_type(j, '$.message') = 'OBJECT')
 SELECT export_id, k AS node_id, m ->> '$.id' AS message_id, coalesce(m ->> '$.author.role', '') AS role, m ->> '$.author.name' AS author_name, m ->> '$.recipient' AS recipient, CAST(m ->> '$.create_time' AS DOUBLE) AS create_time, m ->> '$.content.content_type' AS content_type,
 CASE WHEN trim(m ->> '$.content.content_type') IN ({_SKIPPED}) THEN '' WHEN len(parts) > 0 THEN array_to_string(parts, chr(10)) ELSE coalesce(m ->> '$.content.text', CASE WHEN parts IS NOT NULL THEN '' END) END AS text, on_path FROM m""",
    "p1_children": f"""{TREE_SQL}, x AS (SELECT export_id, k, unnest(ch) AS child, generate_subscripts(ch, 1) - 1 AS pos FROM n)
 SELECT x.export_id, x.k AS node_id, x.pos, x.child AS child_id, n.k IS NOT NULL AS known FROM x LEFT JOIN n ON n.export_id = x.export_id AND n.k = x.child""",
    "p1_parts": f"""{TREE_SQL}, x AS (SELECT export_id, k, unnest(CAST(j -> '$.message.content.parts' AS JSON[])) AS part, generate_subscripts(CAST(j -> '$.message.content.parts' AS JSON[]), 1) - 1 AS pos FROM n)
 SELECT export_id, k AS node_id, pos, CASE json_type(part) WHEN 'VARCHAR' THEN 'text' WHEN 'OBJECT' THEN coalesce(part ->> '$.content_type', part ->> '$.type', 'object') END AS kind, {_STRING.format('part')} AS text FROM x""",
    "p1_metadata": f"""{TREE_SQL}, x AS (SELECT export_id, k, j, unnest(json_keys(j, '$.message.metadata')) AS key FROM n) SELECT export_id, k AS node_id, key, j ->> ('$.message.metadata."' || key || '"') AS value FROM x""",
    "p7_descendants": """WITH RECURSIVE t AS (SELECT session_id, turn_id, max(CASE WHEN trim(parent_turn_id) <> '' THEN parent_turn_id END) AS p FROM turns WHERE session_id IS NOT NULL AND turn_id IS NOT NULL GROUP BY 1, 2),
 u AS (SELECT t.session_id, t.turn_id, q.turn_id AS p FROM t LEFT JOIN t q ON q.session_id = t.session_id AND q.turn_id = t.p),
 down AS (SELECT session_id, turn_id, [turn_id] AS path FROM u WHERE p IS NULL UNION ALL SELECT u.session_id, u.turn_id, list_append(d.path, u.turn_id) FROM u JOIN down d ON d.session_id = u.session_id AND u.p = d.turn_id)
 SELECT session_id, turn_id, below_id, distance FROM (SELECT session_id, turn_id AS below_id, unnest(path) AS turn_id, len(path) - generate_subscripts(path, 1) AS distance FROM down) WHERE distance > 0""",
    "p1_found": """WITH RECURSIVE e AS (SELECT export_id, current_node, unnest(json_keys(mapping)) AS k, mapping FROM chat_exports WHERE json_valid(mapping)),
 n0 AS (SELECT export_id, current_node, k, json_extract(mapping, '$."' || k || '"') AS j FROM e),
 n AS (SELECT export_id, current_node, k, j ->> '$.parent' AS p, coalesce(j ->> '$.message.author.role', '') AS speaker, CAST(j -> '$.children' AS VARCHAR[]) AS ch FROM n0),
 c AS (SELECT export_id, k AS q, unnest(ch) AS x FROM n), cl AS (SELECT export_id, x, min(q) AS q FROM c WHERE q <> x GROUP BY 1, 2),
 u AS (SELECT n.export_id, n.k, n.current_node, n.speaker, CASE WHEN pp.k IS NOT NULL THEN n.p ELSE cl.q END AS up FROM n LEFT JOIN n pp ON pp.export_id = n.export_id AND pp.k = n.p LEFT JOIN cl ON cl.export_id = n.export_id AND cl.x = n.k),
 w AS (SELECT export_id, k, up FROM u WHERE k = current_node UNION SELECT u.export_id, u.k, u.up FROM u JOIN w ON w.export_id = u.export_id AND u.k = w.up)
 SELECT u.export_id, u.up AS parent_id, u.k AS child_id, u.speaker, CAST(w.k IS NOT NULL AS BIGINT) AS on_path FROM u LEFT JOIN w ON w.export_id = u.export_id AND w.k = u.k WHERE u.up IS NOT NULL""",
    "p7_found": """WITH RECURSIVE t AS (SELECT session_id, turn_id, max(CASE WHEN trim(parent_turn_id) <> '' THEN parent_turn_id END) AS p FROM turns WHERE session_id IS NOT NULL AND turn_id IS NOT NULL GROUP BY 1, 2),
 u AS (SELECT t.session_id, t.turn_id, q.turn_id AS p FROM t LEFT JOIN t q ON q.session_id = t.session_id AND q.turn_id = t.p),
 down AS (SELECT session_id, turn_id, turn_id AS root, 0 AS depth, [turn_id] AS path FROM u WHERE p IS NULL UNION ALL SELECT u.session_id, u.turn_id, d.root, d.depth + 1, list_append(d.path, u.turn_id) FROM u JOIN down d ON d.session_id = u.session_id AND u.p = d.turn_id),
 b AS (SELECT session_id, a AS turn_id, count(*) - 1 AS n FROM (SELECT session_id, unnest(path) AS a FROM down) GROUP BY 1, 2)
 SELECT u.session_id, u.turn_id, coalesce(d.root, '') AS root_turn_id, CAST(coalesce(d.depth, -1) AS BIGINT) AS depth, coalesce(b.n, -1) AS n_below FROM u LEFT JOIN down d USING (session_id, turn_id) LEFT JOIN b USING (session_id, turn_id)""",
    "p7_paths": """WITH RECURSIVE t AS (SELECT session_id, turn_id, max(CASE WHEN trim(parent_turn_id) <> '' THEN parent_turn_id END) AS p FROM turns WHERE session_id IS NOT NULL AND turn_id IS NOT NULL GROUP BY 1, 2),
 u AS (SELECT t.session_id, t.turn_id, q.turn_id AS p FROM t LEFT JOIN t q ON q.session_id = t.session_id AND q.turn_id = t.p),
 down AS (SELECT session_id, turn_id, turn_id AS root, 0 AS depth, [turn_id] AS path FROM u WHERE p IS NULL UNION ALL SELECT u.session_id, u.turn_id, d.root, d.depth + 1, list_append(d.path, u.turn_id) FROM u JOIN down d ON d.session_id = u.session_id AND u.p = d.turn_id)
 SELECT u.session_id, u.turn_id, coalesce(array_to_string(d.path, '/'), '') AS path FROM u LEFT JOIN down d USING (session_id, turn_id)""",
}

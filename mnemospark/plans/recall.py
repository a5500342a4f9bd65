"""Recall, graph and similarity queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.functions import memory as m
from mnemospark.operators import graph, overlap, retrieval, similarity
from mnemospark.operators.reconcile import classify
from mnemospark.plans.base import B_SQL, G_SQL, SQL, beliefs, collapsed_sql, decisions, edges, literal, normal_sql, query, strict_sql
from mnemospark.plans.texts import AS_OF, CUE_SQL, LOOSE_SQL, NEGATED_SQL
from mnemospark.session import Scratch, table

TERMS = ["sensor", "limit", "watts", "harbor", "relay"]


def _search_docs(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "beliefs").select(F.lit("belief").alias("kind"), F.col("belief_id").alias("id"), F.col("claim").alias("body")).dropDuplicates(["id"])
    c = table(spark, d, "candidates").select(F.lit("candidate").alias("kind"), F.col("candidate_id").alias("id"), F.concat_ws(" ", "context", "user_request", "claim", "result").alias("body"))
    return b.unionByName(c)


_INDEXES: dict[tuple[str, str], retrieval.SearchIndex] = {}


def search_index(spark: SparkSession, d: str) -> retrieval.SearchIndex:
    """The index over memories and candidates of a folder of tables, made once for a Spark application and then opened."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        index = retrieval.SearchIndex(spark, f"{Scratch(spark).root}/index")
        index.add(_search_docs(spark, d))
        _INDEXES[key] = index
    return _INDEXES[key]


_BM25_SQL = f"""{B_SQL}, corp AS (SELECT 'belief' AS kind, belief_id AS id, claim AS body FROM b UNION ALL SELECT 'candidate', candidate_id, concat_ws(' ', context, user_request, claim, result) FROM candidates),
 tok AS (SELECT kind, id, regexp_extract_all(lower(coalesce(body, '')), '[\\pL\\pN]+') AS w FROM corp), st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(w)) AS avgdl FROM tok),
 tf AS (SELECT kind, id, len(w) AS dl, term, CAST(len(list_filter(w, lambda x: x = term)) AS DOUBLE) AS tf FROM tok, (SELECT unnest({literal(TERMS)}) AS term)),
 df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM tf WHERE tf > 0 GROUP BY term),
 hit AS (SELECT kind, id, -sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (term), st WHERE tf > 0 GROUP BY kind, id)"""


@query(f"WITH {_BM25_SQL} SELECT kind, id, round(score, 6) AS score FROM hit")
def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    return search_index(spark, d).search(TERMS).withColumn("score", F.round("score", 6))


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS score FROM embeddings, q ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) DESC, vec_id LIMIT 8""")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    probe = v.where("vec_id = 0").select("embedding").first()
    top = retrieval.nearest(v, probe["embedding"] if probe else [], 8)
    return v.select("vec_id", "label").join(F.broadcast(top), "vec_id").select("vec_id", "label", F.round("score", 6).alias("score"))


def _items(spark: SparkSession, d: str, hits: DataFrame) -> DataFrame:
    """Beliefs behind the hits (id, vector_score, keyword_score), shaped for ranking."""
    b = table(spark, d, "beliefs").select("belief_id", "claim", "kind", "status", "quarantined", "actor_id", "sensitivity", "importance", "confidence", "created_at", "source_class", "verified_source_class", "ingestion_channel", "derived_from", "evidence_ids")
    b = b.join(F.broadcast(hits), b.belief_id == hits.id).dropDuplicates(["belief_id"])  # a bounded list of hits
    return b.select(
        *[c for c in b.columns if c not in ("id", "vector_score", "keyword_score")], F.concat(F.lit("belief:"), "belief_id").alias("key"), F.col("claim").alias("text"), F.col("created_at").alias("at"), "vector_score", "keyword_score", F.lit(0).alias("reinforcement"),
        F.coalesce("quarantined", F.lit(False)).alias("hidden"), m.fingerprint(F.col("claim")).alias("fp"),
    )


_AGE = f"greatest(0.0, epoch_us(TIMESTAMP '{AS_OF}' - created_at) / 86400000000.0)"
_HITS = "(" + " + ".join(f"CAST(contains(lower(coalesce(claim, '')), '{t}') AS INTEGER)" for t in TERMS) + ")"
_HALF = "CASE WHEN {0} IS NULL OR isnan({0}) OR {0} = 0 THEN 0.5 ELSE {0} END"
_RANK_SQL = f"""p AS (SELECT *, {_HITS} AS hits, coalesce(exp(-ln(2) * {_AGE} / 45.0), 0.5) AS recency FROM c),
 s AS (SELECT *, greatest(vector_score, keyword_score / 10.0, hits * 0.12) AS relevance FROM p),
 r AS (SELECT *, 0.30 * {_HALF.format('importance')} + 0.22 * recency + 0.22 * relevance + CASE WHEN hits > 0 THEN 0.13 ELSE 0.0 END + 0.13 * {_HALF.format('confidence')} AS score FROM s),
 k AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, belief_id) AS rank FROM r)"""


@query(f"""WITH {_BM25_SQL}, top AS (SELECT id, score FROM hit WHERE kind = 'belief' ORDER BY score, id LIMIT 24), c AS (SELECT b.*, 0.0 AS vector_score, t.score AS keyword_score FROM b JOIN top t ON b.belief_id = t.id WHERE status = 'active' AND NOT coalesce(quarantined, false)), {_RANK_SQL}
 SELECT rank, belief_id, round(score, 6) AS score, round(relevance, 6) AS relevance, round(recency, 6) AS recency FROM k WHERE rank <= 12""")
def recall_bm25(spark: SparkSession, d: str) -> DataFrame:
    """Keyword recall by the owner: the best hits, filtered by state and policy, ranked."""
    hits = search_index(spark, d).search(TERMS).where("kind = 'belief'").orderBy("score", "id").limit(24).select("id", F.lit(0.0).alias("vector_score"), F.col("score").alias("keyword_score"))
    allowed = _items(spark, d, hits).where((F.col("status") == "active") & (m.read_refusal(F.col("actor_id"), F.col("quarantined"), F.col("sensitivity"), "primary", owner=True) == ""))
    out = retrieval.ranked(allowed, TERMS, AS_OF).where("rank <= 12")
    return out.select(F.col("rank").cast("long").alias("rank"), "belief_id", F.round("score", 6).alias("score"), F.round("relevance", 6).alias("relevance"), F.round("recency", 6).alias("recency"))


_VEC_SQL = "v AS (SELECT 'B-' || lpad(CAST(vec_id AS VARCHAR), 10, '0') AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 7) AS DOUBLE[])) AS score FROM embeddings ORDER BY 2 DESC, vec_id LIMIT 8)"
_KLASS = "coalesce(nullif(verified_source_class, ''), nullif(source_class, ''), 'unknown')"
_CONF2 = "CASE WHEN confidence IS NULL OR isnan(confidence) THEN 0.0 ELSE confidence END"
_NEUTRAL = f"regexp_replace(regexp_replace(replace(replace({collapsed_sql('coalesce(claim, ' + chr(39) * 2 + ')')}, '<', '\\u003c'), '>', '\\u003e'), '^\\[([^\\]]{{0,159}})\\]', '\\\\u005b\\1\\\\u005d'), '^(?i)({'|'.join(m.ROLE_LABELS)}):', '\\\\\\1:')"
_BLOCK_SQL = f"'[' || CASE WHEN kind = 'hypothesis' THEN 'HYPOTHESIS' ELSE 'BELIEF' END || ' ' || belief_id || ' ' || kind || '/' || {_KLASS} || ' conf ' || CAST(CAST({_CONF2} AS DECIMAL(6,2)) AS VARCHAR) || '] ' || {_NEUTRAL} || CASE WHEN len(derived_from) > 0 THEN ' | from: ' || array_to_string(derived_from[1:4], ', ') ELSE '' END || ' (via ' || coalesce(nullif(ingestion_channel, ''), 'unknown') || ')'"


def block_of_belief() -> Column:
    """One line of text for a belief: what it is, how sure, what it says, where it comes from."""
    klass = F.coalesce(F.nullif(F.col("verified_source_class"), F.lit("")), F.nullif(F.col("source_class"), F.lit("")), F.lit("unknown"))
    conf = F.coalesce(F.nanvl("confidence", F.lit(0.0)), F.lit(0.0)).cast("decimal(6,2)").cast("string")
    head = F.concat(F.lit("["), F.when(F.col("kind") == "hypothesis", "HYPOTHESIS").otherwise("BELIEF"), F.lit(" "), "belief_id", F.lit(" "), "kind", F.lit("/"), klass, F.lit(" conf "), conf, F.lit("] "))
    tail = F.when(F.size("derived_from") > 0, F.concat(F.lit(" | from: "), F.array_join(F.slice("derived_from", 1, 4), ", "))).otherwise("")
    return F.concat(head, m.neutralize(F.col("claim")), tail, F.lit(" (via "), F.coalesce(F.nullif(F.col("ingestion_channel"), F.lit("")), F.lit("unknown")), F.lit(")"))


@query(f"""WITH {_BM25_SQL}, {_VEC_SQL}, f AS (SELECT id, score FROM hit WHERE kind = 'belief' ORDER BY score, id LIMIT 24),
 u AS (SELECT id, max(vs) AS vector_score, max(ks) AS keyword_score FROM (SELECT id, score AS vs, NULL AS ks FROM v UNION ALL SELECT id, NULL, score FROM f) GROUP BY id),
 c AS (SELECT b.*, coalesce(u.vector_score, 0.0) AS vector_score, coalesce(u.keyword_score, 0.0) AS keyword_score FROM b JOIN u ON b.belief_id = u.id), {_RANK_SQL},
 blk AS (SELECT *, {_BLOCK_SQL} AS block, left({normal_sql("coalesce(claim, '')")}, 400) AS fp, CASE WHEN status <> 'active' THEN status WHEN coalesce(quarantined, false) THEN 'quarantined' END AS fate0 FROM k),
 tw AS (SELECT *, row_number() OVER (PARTITION BY fp, fate0 IS NULL ORDER BY rank) AS twin FROM blk), f1 AS (SELECT *, CASE WHEN fate0 IS NULL AND fp <> '' AND twin > 1 THEN 'duplicate' ELSE fate0 END AS fate1 FROM tw),
 us AS (SELECT *, sum(CASE WHEN fate1 IS NULL THEN length(block) + 1 ELSE 0 END) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM f1)
 SELECT rank, belief_id, round(score, 6) AS score, block, CASE WHEN fate1 IS NULL AND used - 1 > 1500 THEN 'budget' ELSE coalesce(fate1, '') END AS fate FROM us""")
def recall_packed(spark: SparkSession, d: str) -> DataFrame:
    """Keyword and vector candidates merged by key, ranked, rendered and packed into 1,500 characters, with the reason for each row left out."""
    out = _packed(spark, d)
    return out.select(F.col("rank").cast("long").alias("rank"), "belief_id", F.round("score", 6).alias("score"), "block", "fate")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    probe = v.where("vec_id = 7").select("embedding").first()
    vec = retrieval.nearest(v, probe["embedding"] if probe else [], 8).select(F.concat(F.lit("B-"), F.lpad(F.col("vec_id").cast("string"), 10, "0")).alias("id"), F.col("score").alias("vs"), F.lit(None).cast("double").alias("ks"))
    key = search_index(spark, d).search(TERMS).where("kind = 'belief'").orderBy("score", "id").limit(24).select("id", F.lit(None).cast("double").alias("vs"), F.col("score").alias("ks"))
    hits = vec.unionByName(key).groupBy("id").agg(F.coalesce(F.max("vs"), F.lit(0.0)).alias("vector_score"), F.coalesce(F.max("ks"), F.lit(0.0)).alias("keyword_score"))
    return retrieval.packed(retrieval.ranked(_items(spark, d, hits), TERMS, AS_OF), block_of_belief(), 1500)


_PACK_SQL = SQL["recall_packed"][: SQL["recall_packed"].rindex("SELECT rank")]
_DERIVED = "list_filter(coalesce(derived_from, [])[1:4] || coalesce(evidence_ids, [])[1:2], lambda x: coalesce(x, '') <> '')"


@query(_PACK_SQL + """SELECT rank, 'belief:' || belief_id AS item, status, round(importance, 6) AS importance, round(recency, 6) AS recency, round(relevance, 6) AS relevance, CAST(hits AS BIGINT) AS hits, round(score, 6) AS score,
 CASE WHEN fate1 IS NULL AND used - 1 > 1500 THEN 'budget' ELSE coalesce(fate1, '') END <> '' AS dropped FROM us""")
def recall_explained(spark: SparkSession, d: str) -> DataFrame:
    """Why each candidate scored as it did and whether it was left out; no text of it."""
    r = lambda c: F.round(c, 6).alias(c)
    return _packed(spark, d).select(F.col("rank").cast("long").alias("rank"), F.col("key").alias("item"), "status", r("importance"), r("recency"), r("relevance"), F.col("hits").cast("long").alias("hits"), r("score"), (F.col("fate") != "").alias("dropped"))


@query(_PACK_SQL + f""", kept AS (SELECT * FROM us WHERE fate1 IS NULL AND used - 1 <= 1500), src AS (SELECT rank, unnest({_DERIVED}) AS x, generate_subscripts({_DERIVED}, 1) AS i FROM kept), firsts AS (SELECT x, min(rank * 100 + i) AS o FROM src GROUP BY x)
 SELECT count(*) AS items, (SELECT count(*) FROM us) - count(*) AS excluded, '<recalled_memory>' || chr(10) || string_agg(block, chr(10) ORDER BY rank) || chr(10) || '</recalled_memory>' AS context, CAST(ceil((sum(length(block)) + count(*) - 1 + 37) / 4.0) AS BIGINT) AS token_estimate, (SELECT string_agg(x, ',' ORDER BY o) FROM firsts) AS sources FROM kept""")
def context_package(spark: SparkSession, d: str) -> DataFrame:
    """What a caller gets: the framed text of what fits, its size, and where it comes from. One query's bounded list is gathered."""
    p = _packed(spark, d)
    origin = F.filter(F.concat(F.slice(F.coalesce("derived_from", F.array().cast("array<string>")), 1, 4), F.slice(F.coalesce("evidence_ids", F.array().cast("array<string>")), 1, 2)), lambda x: F.coalesce(x, F.lit("")) != "")
    kept = F.col("fate") == ""
    rows = p.agg(F.count_if(kept).alias("items"), F.count_if(~kept).alias("excluded"), F.array_sort(F.collect_list(F.when(kept, F.struct("rank", "block", origin.alias("from"))))).alias("l"))
    text = F.concat(F.lit("<recalled_memory>\n"), F.array_join("l.block", "\n"), F.lit("\n</recalled_memory>"))
    return rows.select("items", "excluded", text.alias("context"), m.token_estimate(text).alias("token_estimate"), F.array_join(F.array_distinct(F.flatten("l.from")), ",").alias("sources"))


@query(f"""WITH {_BM25_SQL}, top AS (SELECT id, score FROM hit WHERE kind = 'belief' ORDER BY score, id LIMIT 24) SELECT TIMESTAMP '{AS_OF}' AS at, 'sensor limit [REDACTED:assigned_secret]' AS query, string_agg(id, ',' ORDER BY score, id) AS recalled FROM top""")
def retrieval_log(spark: SparkSession, d: str) -> DataFrame:
    """The entry that a recall leaves: its query without secrets, cut to 500 characters, and the ids it found."""
    asked = "sensor limit password=hunter2hunter2"
    top = search_index(spark, d).search(TERMS).where("kind = 'belief'").orderBy("score", "id").limit(24)
    found = top.agg(F.array_sort(F.collect_list(F.struct("score", "id"))).alias("l"))
    return found.select(F.lit(AS_OF).cast("timestamp_ntz").alias("at"), m.truncate(m.redact(F.lit(asked)), 500).alias("query"), F.array_join("l.id", ",").alias("recalled"))


_NAMES_SQL = "e AS (SELECT 'nation:' || n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 'region:' || r_regionkey, r_name FROM region)"


@query(f"""WITH {G_SQL}, {_NAMES_SQL}, tok AS (SELECT id, regexp_extract_all(lower(name), '[\\pL\\pN]+') AS w FROM e), found AS (SELECT id, len(list_filter(w, lambda x: x IN ('france', 'asia', 'united', 'china', 'america'))) AS hits FROM tok),
 top AS (SELECT id, row_number() OVER (ORDER BY hits DESC, id) AS r FROM found WHERE hits > 0 ORDER BY r LIMIT 4), a AS (SELECT top.id, g.*, row_number() OVER (PARTITION BY top.id ORDER BY rel_id) AS i FROM top JOIN g ON g.src = top.id OR g.dst = top.id WHERE top.r <= 3),
 o AS (SELECT top.id, g.*, row_number() OVER (PARTITION BY top.id ORDER BY rel_id) AS i FROM top JOIN g ON g.src = top.id) SELECT DISTINCT rel_id, src, rel, dst FROM (SELECT rel_id, src, rel, dst FROM a WHERE i <= 8 UNION ALL SELECT rel_id, src, rel, dst FROM o WHERE i <= 4)""")
def recall_graph(spark: SparkSession, d: str) -> DataFrame:
    """Entities that a query names, and edges about them: eight either way for the first three, four outgoing ones for the first four."""
    asked = ["france", "asia", "united", "china", "america"]
    one = lambda t, k, key, name: table(spark, d, t).select(F.concat(F.lit(k + ":"), F.col(key).cast("string")).alias("id"), F.col(name).alias("name"))
    names = one("nation", "nation", "n_nationkey", "n_name").unionByName(one("region", "region", "r_regionkey", "r_name"))
    hits = F.size(F.filter(F.regexp_extract_all(F.lower("name"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda x: x.isin(*asked)))
    top = [r["id"] for r in names.select("id", hits.alias("h")).where("h > 0").orderBy(F.desc("h"), "id").limit(4).collect()]  # four at most
    g = edges(spark, d)
    ends = g.select("*", F.explode(F.array("src", "dst")).alias("id")).where(F.col("id").isin(top[:3])).distinct()
    first = lambda df, n: df.withColumn("i", F.row_number().over(Window.partitionBy("id").orderBy("rel_id"))).where(F.col("i") <= n)
    out = first(g.withColumn("id", F.col("src")).where(F.col("id").isin(top)), 4)
    return first(ends, 8).unionByName(out.select(*ends.columns, "i")).select("rel_id", "src", "rel", "dst").distinct()


@query(f"""WITH RECURSIVE {G_SQL}, a AS (SELECT src AS node, dst AS other FROM g UNION ALL SELECT dst, src FROM g), w(node, hop) AS (SELECT 'region:1', 0 UNION SELECT a.other, w.hop + 1 FROM w JOIN a ON a.node = w.node WHERE w.hop < 3)
 SELECT node, min(hop) AS hop FROM w GROUP BY node""")
def graph_expand(spark: SparkSession, d: str) -> DataFrame:
    """Everything within two hops, which makes three levels, of one region."""
    return graph.expand(edges(spark, d), ["region:1"], hops=2)


@query(f"""WITH {G_SQL}, a AS (SELECT rel_id, src AS node FROM g UNION ALL SELECT rel_id, dst FROM g), k AS (SELECT node, rel_id, row_number() OVER (PARTITION BY node ORDER BY rel_id) AS r FROM a) SELECT node, rel_id, r FROM k WHERE r <= 4""")
def first_edges(spark: SparkSession, d: str) -> DataFrame:
    """The first four edges of every node."""
    g = edges(spark, d)
    a = g.select("rel_id", F.col("src").alias("node")).unionByName(g.select("rel_id", F.col("dst").alias("node")))
    return a.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("rel_id"))).where("r <= 4").select("node", "rel_id", F.col("r").cast("long").alias("r"))


_SUPPLY_SQL = "s AS (SELECT l_partkey AS part, l_suppkey AS supplier, CAST(l_shipdate AS TIMESTAMP) AS valid_from, lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '-' || l_linenumber AS rel_id FROM lineitem)"


def _supplies(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.lit("-"), F.col("l_linenumber").cast("string"))
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_shipdate").cast("timestamp_ntz").alias("valid_from"), key.alias("rel_id"))


@query(f"WITH {_SUPPLY_SQL} SELECT part, arg_max(supplier, (valid_from, rel_id)) AS supplier, max(valid_from) AS valid_from FROM s WHERE valid_from <= TIMESTAMP '1995-06-01' GROUP BY part")
def edge_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Who supplied each part at a moment."""
    return graph.as_of(_supplies(spark, d), ["part"], "1995-06-01 00:00:00").select("part", "supplier", "valid_from")


@query(f"WITH {_SUPPLY_SQL} SELECT part, supplier, rel_id, valid_from, lead(valid_from) OVER (PARTITION BY part ORDER BY valid_from, rel_id) AS valid_until FROM s")
def edge_history(spark: SparkSession, d: str) -> DataFrame:
    """All supply facts, each closed by the next one of its part."""
    return graph.closed_by_next(_supplies(spark, d), ["part"]).select("part", "supplier", "rel_id", "valid_from", "valid_until")


_SETS_SQL = f"w AS (SELECT belief_id, claim, created_at, list_sort(list_distinct(list_filter(string_split({normal_sql('claim')}, ' '), lambda x: x <> ''))) AS ws FROM b WHERE claim IS NOT NULL AND status = 'active'), sets AS (SELECT ws, min(belief_id) AS rep FROM w WHERE len(ws) > 0 GROUP BY ws)"
_PAIRS_SQL = "SELECT x.rep AS a, y.rep AS b, len(list_intersect(x.ws, y.ws)) / greatest(len(x.ws), len(y.ws)) AS sim FROM sets x JOIN sets y ON x.rep < y.rep"


def _claim_sets(spark: SparkSession, d: str) -> DataFrame:
    words = F.array_sort(m.claim_words(F.col("claim")))
    return beliefs(spark, d).where("claim IS NOT NULL AND status = 'active'").select("belief_id", words.alias("words")).where("size(words) > 0").groupBy("words").agg(F.min("belief_id").alias("rep"))


@query(f"WITH {B_SQL}, {_SETS_SQL} SELECT belief_id, rep AS class_id FROM w JOIN sets USING (ws)")
def claim_classes(spark: SparkSession, d: str) -> DataFrame:
    """Which word set, named by its first belief, each active claim belongs to: the members of the pairs below."""
    words = F.array_sort(m.claim_words(F.col("claim")))
    b = beliefs(spark, d).where("claim IS NOT NULL AND status = 'active'").select("belief_id", F.md5(F.array_join(words, " ")).alias("set"), F.size(words).alias("n")).where("n > 0")
    return b.join(b.groupBy("set").agg(F.min("belief_id").alias("class_id")), "set").select("belief_id", "class_id")


@query(f"WITH {B_SQL}, {_SETS_SQL}, p AS ({_PAIRS_SQL}) SELECT a, b, round(sim, 6) AS sim FROM p WHERE sim >= 0.6 - 1e-9")
def similar_claims(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different active word sets, each named by its first belief, that share 0.6 of the larger."""
    return similarity.similar_pairs(_claim_sets(spark, d), 0.6).withColumn("sim", F.round("sim", 6))


@query(f"WITH {B_SQL}, {_SETS_SQL}, p AS ({_PAIRS_SQL}), n AS (SELECT belief_id, {LOOSE_SQL} AS neg FROM b WHERE claim IS NOT NULL) SELECT a, p.b, round(sim, 6) AS sim FROM p JOIN n na ON na.belief_id = a JOIN n nb ON nb.belief_id = p.b WHERE sim >= 0.45 - 1e-9 AND na.neg <> nb.neg")
def opposed_claims(spark: SparkSession, d: str) -> DataFrame:
    """Like similar_claims at 0.45, where one of the two is negated."""
    scratch = Scratch(spark)
    neg = beliefs(spark, d).where("claim IS NOT NULL").select(F.col("belief_id").alias("rep"), m.negated(F.col("claim"), loose=True).alias("neg"))
    sets = scratch.save(_claim_sets(spark, d).join(neg, "rep"))
    plain = overlap.ranked(sets.where("NOT neg"), scratch, "rep")
    pairs = overlap.close_pairs(sets.where("neg"), plain, scratch, 0.45).join(plain.select("rank", F.col("rep").alias("other")), "rank")
    return pairs.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b"), F.round("sim", 6).alias("sim"))


@query(f"""WITH {B_SQL}, {_SETS_SQL}, p AS ({_PAIRS_SQL}), q AS (SELECT a, p.b FROM p WHERE sim >= 0.6 - 1e-9 UNION ALL SELECT p.b, a FROM p WHERE sim >= 0.6 - 1e-9), t AS (SELECT q.a AS rep, q.b AS other, x.created_at AS mine, y.created_at AS theirs FROM q JOIN w x ON x.belief_id = q.a JOIN w y ON y.belief_id = q.b)
 SELECT rep AS belief_id, arg_min(other, (theirs, other)) AS merged_into FROM t WHERE (theirs, other) < (mine, rep) GROUP BY rep""")
def merge_into_oldest(spark: SparkSession, d: str) -> DataFrame:
    """Each claim that is not the oldest of those similar to it is merged into the oldest."""
    pairs = similarity.similar_pairs(_claim_sets(spark, d), 0.6).select("a", "b")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    at = beliefs(spark, d).select("belief_id", "created_at")
    t = both.join(at.select(F.col("belief_id").alias("a"), F.col("created_at").alias("mine")), "a").join(at.select(F.col("belief_id").alias("b"), F.col("created_at").alias("theirs")), "b")
    older = F.struct(F.col("theirs").alias("t"), F.col("b").alias("i"))
    return t.where(older < F.struct(F.col("mine").alias("t"), F.col("a").alias("i"))).groupBy(F.col("a").alias("belief_id")).agg(F.min_by("b", older).alias("merged_into"))


_CONTENT = f"list_sort(list_distinct(list_filter(regexp_extract_all({strict_sql('claim')}, '[a-z0-9'']+'), lambda x: NOT list_contains({literal(m.STOPWORDS)}, x))))"
_RECON_SQL = f"""WITH {B_SQL}, m AS (SELECT belief_id AS id, created_at, {strict_sql('claim')} AS form, {_CONTENT} AS ws, {NEGATED_SQL} AS neg, coalesce(evidence_ids, []) AS ev FROM b WHERE claim IS NOT NULL AND status IN ('active', 'superseded', 'contradicted')),
 c AS (SELECT candidate_id, {strict_sql('claim')} AS form, {_CONTENT} AS ws, {NEGATED_SQL} AS neg, {CUE_SQL} AS cue, coalesce(turn_ids, []) AS ev FROM candidates WHERE claim IS NOT NULL),
 p AS (SELECT c.candidate_id, m.id, m.created_at, CASE WHEN c.form = m.form THEN 1.0 ELSE len(list_intersect(c.ws, m.ws)) / greatest(len(c.ws), len(m.ws)) END AS sim FROM c JOIN m ON len(c.ws) >= 3 AND len(m.ws) > 0),
 best AS (SELECT candidate_id, max(sim) AS sim, arg_max(id, (sim, -epoch_us(created_at), -CAST(substr(id, 3) AS BIGINT))) AS id FROM p WHERE sim > 0 GROUP BY candidate_id),
 j AS (SELECT c.*, best.sim, best.id AS mid, m.form AS mform, m.ws AS mws, m.neg AS mneg, m.ev AS mev FROM c LEFT JOIN best USING (candidate_id) LEFT JOIN m ON m.id = best.id),
 k AS (SELECT *, neg = mneg AS same, len(list_intersect(ws, mws)) AS shared FROM j)
 SELECT candidate_id, CASE WHEN len(ws) < 3 THEN 'low-confidence' WHEN sim IS NULL OR sim < 0.18 THEN 'irrelevant'
  WHEN form = mform OR (sim >= 0.92 AND same) THEN CASE WHEN (len(ev) > 0 AND len(list_filter(ev, lambda x: NOT list_contains(mev, x))) = 0) OR (len(ev) = 0 AND len(mev) = 0) THEN 'duplicate' ELSE 'reinforcement' END
  WHEN NOT same AND sim >= 0.40 THEN 'contradiction' WHEN cue AND sim >= 0.35 THEN 'supersession' WHEN same AND sim >= 0.40 AND shared > 0 AND shared < len(ws) AND shared < len(mws) THEN 'contradiction'
  WHEN same AND sim >= 0.50 AND len(ws) <> len(mws) AND shared = least(len(ws), len(mws)) THEN 'update' WHEN same AND sim >= 0.75 THEN 'reinforcement' WHEN sim < 0.40 THEN 'low-confidence' ELSE 'irrelevant' END AS classification,
  CASE WHEN sim >= 0.35 THEN mid END AS matched_id, CASE WHEN sim >= 0.35 THEN round(sim, 6) END AS similarity FROM k"""


def _reconciled(spark: SparkSession, d: str, fold: bool = False) -> DataFrame:
    known = beliefs(spark, d).where("claim IS NOT NULL").where(F.col("status").isin("active", "superseded", "contradicted")).select(F.col("belief_id").alias("id"), "claim", F.col("created_at").alias("at"), F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("evidence"))
    new = table(spark, d, "candidates").where("claim IS NOT NULL").select(F.col("candidate_id").alias("id"), "claim", F.col("extracted_at").alias("at"), F.coalesce("turn_ids", F.array().cast("array<string>")).alias("evidence"))
    return classify(new, known, fold) if fold else classify(new.drop("at"), known)


@query(_RECON_SQL)
def reconcile_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Each new claim against all known ones, in one of seven classes; the match is named from 0.35 on."""
    return _reconciled(spark, d).select(F.col("id").alias("candidate_id"), "classification", "matched_id", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT classification, count(*) AS n FROM ({_RECON_SQL}) GROUP BY classification")
def reconcile_counts(spark: SparkSession, d: str) -> DataFrame:
    return _reconciled(spark, d).groupBy("classification").agg(F.count("*").alias("n"))


#: As _RECON_SQL, but earlier candidates are known too.
_FOLD_SQL = f"""WITH {B_SQL}, c AS (SELECT candidate_id, extracted_at AS since, {strict_sql('claim')} AS form, {_CONTENT} AS ws, {NEGATED_SQL} AS neg, {CUE_SQL} AS cue, coalesce(turn_ids, []) AS ev FROM candidates WHERE claim IS NOT NULL),
 m AS (SELECT 0 AS late, belief_id AS id, created_at AS since, {strict_sql('claim')} AS form, {_CONTENT} AS ws, {NEGATED_SQL} AS neg, coalesce(evidence_ids, []) AS ev FROM b WHERE claim IS NOT NULL AND status IN ('active', 'superseded', 'contradicted') UNION ALL SELECT 1, candidate_id, since, form, ws, neg, ev FROM c),
 p AS (SELECT c.candidate_id, m.late, m.id, m.since, CASE WHEN c.form = m.form THEN 1.0 ELSE len(list_intersect(c.ws, m.ws)) / greatest(len(c.ws), len(m.ws)) END AS sim FROM c JOIN m ON len(c.ws) >= 3 AND len(m.ws) > 0 AND (m.late = 0 OR (m.since, m.id) < (c.since, c.candidate_id))),
 best AS (SELECT candidate_id, max(sim) AS sim, arg_max(id, (sim, -late, -epoch_us(since), -CAST(substr(id, 3) AS BIGINT))) AS id FROM p WHERE sim > 0 GROUP BY candidate_id),
 k AS (SELECT c.*, best.sim, best.id AS mid, m.form AS mform, m.ws AS mws, m.ev AS mev, c.neg = m.neg AS same, len(list_intersect(c.ws, m.ws)) AS shared FROM c LEFT JOIN best USING (candidate_id) LEFT JOIN m ON m.id = best.id)
 {_RECON_SQL[_RECON_SQL.rindex('SELECT candidate_id, CASE'):]}"""


@query(_FOLD_SQL)
def reconcile_folded(spark: SparkSession, d: str) -> DataFrame:
    """As reconcile_candidates, each claim also against all candidates before it by (extracted_at, candidate_id)."""
    return _reconciled(spark, d, fold=True).select(F.col("id").alias("candidate_id"), "classification", "matched_id", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT classification, count(*) AS n FROM ({_FOLD_SQL}) GROUP BY classification")
def reconcile_folded_counts(spark: SparkSession, d: str) -> DataFrame:
    return _reconciled(spark, d, fold=True).groupBy("classification").agg(F.count("*").alias("n"))


@query(f"""WITH {B_SQL}, dec AS (SELECT DISTINCT ON (decision_id) * FROM decisions), n AS (SELECT belief_id, claim, {_CONTENT} AS ws, {strict_sql('claim')} AS form FROM b), c AS (SELECT candidate_id, {_CONTENT} AS cws, {strict_sql('claim')} AS cform FROM candidates)
 SELECT decision_id, round(CASE WHEN cform = form AND form <> '' THEN 1.0 WHEN len(cws) > 0 AND len(ws) > 0 THEN len(list_intersect(cws, ws)) / greatest(len(cws), len(ws)) ELSE 0.0 END, 6) AS recomputed FROM dec JOIN c USING (candidate_id) JOIN n ON n.belief_id = dec.matched_id WHERE n.claim IS NOT NULL AND cform IS NOT NULL""")
def recomputed_similarity(spark: SparkSession, d: str) -> DataFrame:
    """The similarity that a recorded decision ought to have had."""
    c = table(spark, d, "candidates").where("claim IS NOT NULL").select("candidate_id", F.col("claim").alias("x"))
    b = beliefs(spark, d).where("claim IS NOT NULL").select(F.col("belief_id").alias("matched_id"), F.col("claim").alias("y"))
    x, y = m.strict_claim(F.col("x")), m.strict_claim(F.col("y"))
    sim = F.when((x == y) & (x != ""), 1.0).otherwise(m.overlap(m.content_words(F.col("x")), m.content_words(F.col("y"))))
    return decisions(spark, d).select("decision_id", "candidate_id", "matched_id").join(c, "candidate_id").join(b, "matched_id").select("decision_id", F.round(sim, 6).alias("recomputed"))

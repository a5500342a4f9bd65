"""Keyword and vector search, ranking, and packing into a character budget."""

from __future__ import annotations

import json
import zlib

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.functions import memory as m
from mnemospark.functions.text import words
from mnemospark.session import Folder

K1, B = 1.2, 0.75


class SearchIndex:
    """Inverted index in a folder: postings by hash of the term, document lengths, removals, and the corpus figures.

    add() and remove() append a segment and publish a new numbered manifest; nothing is rewritten. A search names its terms,
    and so reads the folders of their buckets only; the number of documents and their mean length are in the manifest.
    """

    POSTS = "term string, kind string, id string, tf bigint, dl int, seq int, bucket int"
    DOCS = "kind string, id string, dl int, seq int"

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets, self.folder = spark, root.rstrip("/"), buckets, Folder(spark, root)
        known = self.folder.names("manifest-")
        self.state = json.loads(self.folder.text(known[-1])) if known else {"seq": 0, "added": [], "removed": [], "docs": 0, "words": 0}

    def _publish(self, **change) -> None:
        state = self.state | change
        self.folder.put(f"manifest-{state['seq']:012d}", json.dumps(state))
        self.state = state

    def _read(self, what: str, segments: list[int], shape: str) -> DataFrame:
        paths = [f"{self.root}/{what}-{s}" for s in segments]
        if not paths:
            return self.spark.createDataFrame([], shape)
        out = None  # one reader for each segment: each is partitioned by bucket on its own
        for path in paths:
            one = self.spark.read.schema(shape).parquet(path)
            out = one if out is None else out.unionByName(one)
        return out

    def add(self, docs: DataFrame) -> None:
        """Index docs(kind, id, body); null bodies count as empty, ids of one kind must be new or removed before."""
        seq = self.state["seq"] + 1
        tokens = docs.select("kind", "id", words(F.coalesce("body", F.lit(""))).alias("w")).select("kind", "id", "w", F.size("w").alias("dl"))
        posts = tokens.select("kind", "id", "dl", F.explode("w").alias("term")).groupBy("term", "kind", "id", "dl").agg(F.count("*").alias("tf"))
        placed = posts.withColumn("seq", F.lit(seq)).withColumn("bucket", (F.crc32(F.col("term").cast("binary")) % self.buckets).cast("int"))
        placed.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/posts-{seq}")
        seen = Observation()
        tokens.select("kind", "id", "dl", F.lit(seq).alias("seq")).observe(seen, F.count("*").alias("n"), F.sum("dl").alias("w")).write.parquet(f"{self.root}/docs-{seq}")
        got = seen.get
        self._publish(seq=seq, added=[*self.state["added"], seq], docs=self.state["docs"] + got["n"], words=self.state["words"] + (got["w"] or 0))

    def remove(self, ids: DataFrame) -> None:
        """Take the documents ids(kind, id) out; unknown ones are ignored."""
        seq = self.state["seq"] + 1
        gone = self._live(self._read("docs", self.state["added"], self.DOCS)).join(ids.select("kind", "id").distinct(), ["kind", "id"], "left_semi")
        seen = Observation()
        gone.select("kind", "id", "dl", F.lit(seq).alias("seq")).observe(seen, F.count("*").alias("n"), F.sum("dl").alias("w")).write.parquet(f"{self.root}/gone-{seq}")
        got = seen.get
        self._publish(seq=seq, removed=[*self.state["removed"], seq], docs=self.state["docs"] - got["n"], words=self.state["words"] - (got["w"] or 0))

    def _live(self, rows: DataFrame) -> DataFrame:
        if not self.state["removed"]:
            return rows
        gone = self._read("gone", self.state["removed"], self.DOCS).groupBy("kind", "id").agg(F.max("seq").alias("upto"))
        return rows.join(gone, ["kind", "id"], "left").where("upto IS NULL OR seq > upto").drop("upto")

    def postings(self, terms: list[str]) -> DataFrame:
        """(term, kind, id, tf, dl) of the terms, from their buckets only."""
        terms = sorted({t.lower() for t in terms})
        at = sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})
        found = self._read("posts", self.state["added"], self.POSTS).where(F.col("bucket").isin(at) & F.col("term").isin(terms))
        return self._live(found).select("term", "kind", "id", "tf", "dl")

    def search(self, terms: list[str]) -> DataFrame:
        """(kind, id, score) of documents holding any term of more than one character; a lower (negative) score is better."""
        posts = self.postings([t for t in terms if len(t) > 1])
        n, mean = float(self.state["docs"]), self.state["words"] / max(1, self.state["docs"])
        df = posts.groupBy("term").agg(F.count("*").cast("double").alias("df"))  # one row a term
        idf = F.greatest(F.lit(1e-6), F.log((F.lit(n) - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5))))
        f = F.col("tf").cast("double")
        part = idf * f * F.lit(K1 + 1) / (f + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.lit(mean)))
        return posts.join(F.broadcast(df), "term").groupBy("kind", "id").agg((-F.sum(part)).alias("score"))


def bm25(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(kind, id, score) of docs(kind, id, body) holding any term; a lower (negative) score is better.

    One scan gathers the statistics of the whole index, one scores. No term of more than one
    character gives no row, null bodies count as empty. Only the queried terms are counted, so
    no posting of other words is made.
    """
    terms = sorted({t.lower() for t in terms if len(t) > 1})
    if not terms:
        return docs.select("kind", "id", F.lit(0.0).alias("score")).where(F.lit(False))
    w = words(F.coalesce("body", F.lit("")))
    count = lambda t: F.size(F.filter("w", lambda x: x == F.lit(t)))
    tf = [count(t).alias(f"tf{i}") for i, t in enumerate(terms)]
    counted = docs.select("kind", "id", w.alias("w")).select("kind", "id", F.size("w").alias("dl"), *tf)
    stats = counted.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    n, score = F.col("n_docs").cast("double"), F.lit(0.0)
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.col("avgdl"))
    for i in range(len(terms)):
        df, f = F.col(f"df{i}").cast("double"), F.col(f"tf{i}").cast("double")
        idf = F.greatest(F.lit(1e-6), F.log((n - df + F.lit(0.5)) / (df + F.lit(0.5))))
        score = score + F.when(f > 0, idf * f * F.lit(K1 + 1) / (f + norm)).otherwise(F.lit(0.0))
    found = counted.crossJoin(F.broadcast(stats))  # one row of statistics
    return found.where(F.greatest(*[F.col(f"tf{i}") for i in range(len(terms))], F.lit(0)) > 0).select("kind", "id", (-score).alias("score"))


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The k rows of highest cosine with the query; exact, ties to the smaller id, k rows a task at most are moved."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(id_col, m.cosine(F.col(vec), q).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def ranked(items: DataFrame, terms: list[str], as_of: str, project: str | None = None, use_bm25: bool = False) -> DataFrame:
    """items with hits, recency, relevance, score and rank.

    items(key, text, importance, confidence, at, vector_score, keyword_score, reinforcement[, project]) is the
    bounded candidate list of one query. A preferred project comes first, it is no filter.
    """
    hits = m.term_hits(F.coalesce("text", F.lit("")), terms)
    rel = m.relevance(F.col("vector_score"), F.col("keyword_score"), F.col("hits"), use_bm25)
    out = items.withColumn("hits", hits).withColumn("recency", m.recency(F.col("at"), as_of)).withColumn("relevance", rel)
    out = out.withColumn("score", m.rank_score(F.col("importance"), F.col("recency"), F.col("relevance"), F.col("hits"), F.col("confidence"), F.col("reinforcement")))
    first = [F.desc(F.col("project") == project)] if project else []
    return out.withColumn("rank", F.row_number().over(Window.orderBy(*first, F.desc(F.round("score", 9)), "key")))


def packed(items: DataFrame, block: Column, budget: int) -> DataFrame:
    """items(rank, fp, status, hidden, ..) with `fate`: '' if packed, else why not.

    In rank order: rows that are not active, hidden rows, later rows of one fingerprint (empty ones are
    all different), and everything from the first block that no longer fits. items is one query's list.
    """
    order = Window.orderBy("rank")
    fate = F.when(F.col("status") != "active", F.col("status")).when(F.col("hidden"), "quarantined")
    one = items.withColumn("block", block).withColumn("fate", fate)
    twin = F.row_number().over(Window.partitionBy("fp", F.col("fate").isNull()).orderBy("rank"))
    one = one.withColumn("fate", F.when(F.col("fate").isNull() & (F.col("fp") != "") & (twin > 1), "duplicate").otherwise(F.col("fate")))
    size = F.when(F.col("fate").isNull(), F.length("block") + 1).otherwise(0)
    return one.withColumn("used", F.sum(size).over(order)).withColumn("fate", F.when(F.col("fate").isNull() & (F.col("used") - 1 > budget), "budget").otherwise(F.coalesce("fate", F.lit("")))).drop("used")

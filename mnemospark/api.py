"""Memory: one object over the store, for callers that don't want to compose operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import memory as m
from mnemospark.functions import trust as t
from mnemospark.operators import graph, lifecycle, retrieval
from mnemospark.operators.reconcile import classify
from mnemospark.session import Scratch
from mnemospark.sources.sinks import Versioned, export


class Memory:
    """Beliefs as facts, and edges, in versioned tables below `root`."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.facts = Versioned(spark, f"{root}/facts")
        self.edges = Versioned(spark, f"{root}/edges")

    def _facts(self) -> DataFrame:
        found = self.facts.read()
        return found if found is not None else self.spark.createDataFrame([], lifecycle.FACT)

    def _append(self, new: DataFrame) -> None:
        self.facts.append(new)

    def _seq(self) -> int:
        return self._facts().agg(F.coalesce(F.max("seq"), F.lit(0)).alias("s")).first()["s"] + 1

    def state(self, until: int | None = None) -> DataFrame:
        return lifecycle.current(self._facts(), until)

    def remember(self, claims: DataFrame, at: str, channel: str = "") -> DataFrame:
        """Store claims(claim[, kind, confidence, importance, source_class, quarantined]); returns them with ids.

        `channel` decides how far the rest is believed: only the owner's own channels ('' , local, cli) may name a source
        class, an agent's or outsider's confidence is capped by its class, and what an outsider writes is held back.
        Null and blank claims are left out.
        """
        have, via = set(claims.columns), F.lit(channel)
        identity, provenance = t.identity_of(via), t.provenance_of(via)
        given = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
        rows = lifecycle.next_ids(self._facts().select("id"), claims.where("trim(coalesce(claim, '')) <> ''"), "B", ["claim"])
        klass = t.verified_class(m.source_class(given("source_class", "string")), provenance)
        usual = F.when(given("source_class", "string").isNull() & (provenance == "user"), 0.5)
        sure = F.coalesce(F.nanvl(given("confidence", "double"), F.lit(None).cast("double")), usual)
        fields = {"claim": F.col("claim"), "status": F.lit("active"), "source_class": F.when(given("source_class", "string").isNotNull() | (provenance != "user"), klass)}
        fields |= {"confidence": t.bounded_confidence(sure, klass, provenance), "quarantined": t.write_quarantine(given("quarantined", "boolean"), identity)}
        if "kind" in have:
            fields["kind"] = F.when(F.col("kind").isin(*t.KINDS), F.col("kind")).otherwise("belief")
        if "importance" in have:
            fields["importance"] = F.col("importance")
        self._append(lifecycle.facts_of(rows, "remember", F.lit(self._seq()), F.lit(at), **fields))
        return self.state().join(rows.select("id"), "id", "left_semi")

    def supersede(self, pairs: DataFrame, at: str, by_user: bool = False) -> None:
        self._append(lifecycle.supersede(self.state(), pairs, self._seq(), at, by_user))

    def replace(self, new: DataFrame, at: str, channel: str = "") -> DataFrame:
        """Retire new(id, claim)'s ids and store the claims in their place, with their kind and importance; protected ones only by a user."""
        free = self.state().join(new.select("id", F.col("claim").alias("new_claim")), "id").where("status = 'active' AND trim(coalesce(new_claim, '')) <> ''")
        if t.CHANNELS.get(channel, ("", "external"))[1] != "user" and channel:
            free = free.where(m.protection(F.lit(None).cast("string"), F.col("source_class"), F.col("quarantined"), F.col("confidence")) == "")
        free = Scratch(self.spark).save(free)
        kept = self.remember(free.select(F.col("new_claim").alias("claim"), "kind", "importance", F.lit(0.6).alias("confidence")), at, channel)
        self.supersede(free.select("id", F.col("new_claim").alias("claim")).join(kept.select(F.col("id").alias("new_id"), "claim"), "claim").select("id", "new_id"), at, by_user=True)
        return kept

    def contradict(self, pairs: DataFrame, at: str) -> None:
        """Of each group of opposed ids, pairs(group, id), the best by confidence and source stays active and the others are contradicted."""
        state = self.state().where("status <> 'superseded'")
        scored = state.join(pairs.select("group", "id").distinct(), "id").select("group", "id", F.round(t.contest_score(F.col("confidence"), F.col("source_class")), 6).alias("score"))
        won = scored.groupBy("group").agg(F.max_by("id", F.struct("score", "id")).alias("winner"))
        status = scored.join(won, "group").groupBy("id").agg(F.min(F.when(F.col("id") == F.col("winner"), "active").otherwise("contradicted")).alias("to"))
        self._append(lifecycle.facts_of(state.join(status, "id"), "contradict", F.lit(self._seq()), F.lit(at), status=F.col("to")))

    def review(self, verdicts: DataFrame, at: str, channel: str = "cli") -> None:
        """Verdicts(id, approved) of an owner on what is held back: released and attested, or archived. Others may not."""
        if channel and t.CHANNELS.get(channel, ("", "external"))[1] != "user":
            raise PermissionError("only a user may approve")
        held = self.state().where("quarantined").join(verdicts.select("id", "approved").dropDuplicates(["id"]), "id")
        yes = F.col("approved")
        self._append(lifecycle.facts_of(held, "review", F.lit(self._seq()), F.lit(at), quarantined=F.when(yes, F.lit(False)), source_class=F.when(yes, "user_explicit"), status=F.when(~yes, "archived")))

    def reinforce(self, ids: DataFrame, at: str, delta: float = 0.04) -> None:
        self._append(lifecycle.reinforce(self.state(), ids, self._seq(), at, delta))

    def archive(self, ids: DataFrame, at: str) -> None:
        self._append(lifecycle.set_status(self.state(), ids, "archived", self._seq(), at))

    def purge(self, ids: DataFrame, at: str) -> None:
        """Forget for good: all facts of the ids are dropped and older versions with them."""
        marked = self._facts().unionByName(lifecycle.purge(self.state(), ids, self._seq(), at))
        self.facts.write(lifecycle.compact(marked), keep=1)

    def changes(self, n: int = 20) -> DataFrame:
        return lifecycle.history(self._facts(), n)

    def relate(self, new: DataFrame) -> None:
        """Add edges(rel_id, src, rel, dst, valid_from); a known rel_id is not added again."""
        old = self.edges.read()
        new = new.dropDuplicates(["rel_id"])
        self.edges.append(new if old is None else new.join(old.select("rel_id"), "rel_id", "left_anti"))

    def neighbours(self, starts: list[str], hops: int = 2) -> DataFrame:
        return graph.expand(self.edges.read(), starts, hops)

    def recall(self, query: str, as_of: str, limit: int = 6, caller: str = "primary", owner: bool = True) -> DataFrame:
        """Ranked active memories for a query: (rank, id, claim, score)."""
        state = self.state()
        docs = state.select(F.lit("belief").alias("kind"), "id", F.col("claim").alias("body"))
        terms = [w for w in query.lower().replace("?", " ").split() if len(w) > 1]
        allowed = m.read_refusal(F.lit(caller), F.col("quarantined"), F.lit(None).cast("string"), caller, owner) == ""
        docs = docs.join(state.where((F.col("status") == "active") & allowed).select("id"), "id", "left_semi")
        hits = retrieval.bm25(docs, terms).orderBy("score", "id").limit(2 * limit)
        born = self._facts().groupBy("id").agg(F.min("at").alias("at"))
        items = state.join(F.broadcast(hits.select("id", F.col("score").alias("keyword_score"))), "id").join(born, "id")
        items = items.select("id", "claim", F.col("id").alias("key"), F.col("claim").alias("text"), "importance", "confidence", "at", F.lit(0.0).alias("vector_score"), "keyword_score", F.lit(0).alias("reinforcement"))
        return retrieval.ranked(items, terms, as_of).where(F.col("rank") <= limit).select("rank", "id", "claim", "score")

    def reconcile(self, candidates: DataFrame) -> DataFrame:
        """Classes of candidates(id, claim, evidence) against what is known."""
        born = self._facts().groupBy("id").agg(F.min("at").alias("at"))
        known = self.state().where(F.col("status").isin("active", "superseded", "contradicted")).join(born, "id").select("id", "claim", "at", F.array().cast("array<string>").alias("evidence"))
        return classify(candidates, known)

    def export(self, path: str, kind: str = "all") -> list[str]:
        tables = {"beliefs": self.state(), "changes": self._facts()}
        if self.edges.read() is not None:
            tables["edges"] = self.edges.read()
        return export(tables, path, kind)

    def status(self) -> DataFrame:
        return self.state().groupBy("status").agg(F.count("*").alias("n"))

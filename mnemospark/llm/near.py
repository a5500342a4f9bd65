"""Near-duplicate groups by a grouped prefix join.

Two texts are linked if the distinct words they share are at least `threshold` of the larger
text's distinct words; a group is everything linked directly or through others.

Equal word sets collapse to one class, classes with the same prefix and size to one group of
mnemospark.operators.similarity, whose buckets lose no link. Pairs of groups are filtered, then expanded and
their members verified. A crowded bucket costs one comparison a member first, with its smallest
member: what hangs together through that needs no more. If few members are left outside, they are
compared with the rest of the bucket, in slices; if many are, the bucket is split by longer keys. So a bucket that
holds a third of all rows costs a bounded number of comparisons a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.text import words
from mnemospark.llm.canonical import WORDY, with_canonical
from mnemospark.operators.components import components
from mnemospark.operators.similarity import PrefixJoin
from mnemospark.session import Scratch


def word_classes(df: DataFrame, text: str, id_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(docs, classes): docs(id, canon, wkey), one row per id; classes(wkey, rep, words, copies)."""
    slim = df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & F.col("text").rlike(WORDY))
    found = with_canonical(slim, "text").select("id", F.unhex(F.md5("canon")).alias("canon"), F.array_sort(F.array_distinct(words(F.col("text")))).alias("words"))
    docs = scratch.save(found.dropDuplicates(["id"]).withColumn("wkey", F.unhex(F.md5(F.array_join("words", " ")))))
    classes = docs.groupBy("wkey").agg(F.min("id").alias("rep"), F.first("words").alias("words"), F.count("*").alias("copies"))
    return docs, classes


def _crowded(join: PrefixJoin, rows: DataFrame, edges: DataFrame, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """(edges, keys still open) once the members of large buckets have been compared as far as it pays.

    rows(key, size, rep, ..) are bucket members. Unless `last`, keys with more than join.cap members
    outside their largest component are left open, and only what that leaves is compared.
    """
    scratch, bare = join.scratch, ["key", "size", "rep", "side", "n", "a0", "a1", "o0", "o1"]
    rows = scratch.save(rows.select(*bare).distinct())
    pair = lambda d: d.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
    link = F.expr("x.rep <> y.rep") & join.may_link()
    pivot = rows.groupBy("key").agg(F.min(F.struct("rep", *[c for c in bare if c not in ("key", "rep", "size")])).alias("p")).select("key", "p.*").alias("y")
    first = rows.alias("x").join(pivot, F.expr("x.key = y.key") & link)
    edges = scratch.save(edges.unionByName(join.verified(pair(first)).select("a", "b")))
    comp = components(edges, scratch)
    labelled = rows.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    parts = labelled.groupBy("key", "root").agg(F.count("*").alias("c"))
    keys = parts.groupBy("key").agg(F.max(F.struct("c", "root")).alias("main"), F.sum("c").alias("m"), F.count("*").alias("parts")).where("parts > 1")
    keys = scratch.save(keys.select("key", F.col("main.root").alias("main"), (F.col("m") - F.col("main.c")).alias("strays")))
    todo = keys if last else keys.where(F.col("strays") <= join.cap)
    inside = labelled.join(todo.select("key", "main"), "key")
    second = join.salted(inside.where("root <> main"), inside, link & F.expr("x.root <> y.root AND (y.root = y.main OR x.rep < y.rep)"))
    late = scratch.save(join.verified(pair(second)).select("a", "b"))
    return edges.unionByName(late), None if last else keys.where(F.col("strays") > join.cap).select("key")


def near_groups(df: DataFrame, text: str = "claim", id_col: str = "id", threshold: float = 0.75, **cost) -> DataFrame:
    """(id, group_id, rep): group_id is the smallest id of the group; a text alone is its own group.

    rep names the text's set of distinct words by its first id.
    Null and wordless texts and null ids take part in nothing; rows with one id are one record;
    texts that are copies after canonical writing are linked too. Ids must be of one orderable
    type. Other columns of df are ignored. `cost` are the parameters of PrefixJoin; they never change the groups.
    """
    scratch = Scratch(df.sparkSession)
    docs, classes = word_classes(df, text, id_col, scratch)
    classes = scratch.save(classes)
    join = PrefixJoin(classes, threshold, scratch, **cost)
    named = docs.select("canon", "wkey").distinct().join(classes.select("wkey", "rep"), "wkey")
    edges = named.join(named.groupBy("canon").agg(F.min("rep").alias("a")), "canon").where("a < rep").select("a", F.col("rep").alias("b"))
    keyed = scratch.save(join.first())
    crowds = join.crowds()
    if join.groups.where("held > 1").limit(1).count():
        edges, _ = _crowded(join, crowds, edges, last=True)
    for level in range(2, join.levels + 1):
        cold, hot, any_ = join.split(keyed)
        edges = edges.unionByName(join.expanded(join.group_pairs(cold)).select("a", "b"))
        if not any_:
            break
        hot, last = scratch.save(hot), level == join.levels
        edges, open_ = _crowded(join, join.members(hot), edges, last)
        if last or not open_.limit(1).count():
            break
        hot = hot.join(open_, "key")
        edges, _ = _crowded(join, join.members(hot.where(join.stays(level))), edges, last=True)
        keyed = scratch.save(join.longer(hot, level))
    comp = components(edges, scratch)
    labelled = classes.select("wkey", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("wkey", "rep", F.coalesce("root", "rep").alias("group_id"))
    return docs.select("id", "wkey").join(labelled, "wkey").select("id", "group_id", "rep")


def group_pairs(groups: DataFrame) -> DataFrame:
    """(id_a, id_b): all pairs within groups, smaller id first; only groups of two or more are joined."""
    shared = groups.groupBy("group_id").agg(F.count("*").alias("m")).where("m > 1").select("group_id")
    inside = groups.select("id", "group_id").join(shared, "group_id")
    a, b = inside.withColumnRenamed("id", "id_a"), inside.withColumnRenamed("id", "id_b")
    return a.join(b, "group_id").where("id_a < id_b").select("id_a", "id_b")

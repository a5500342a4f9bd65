"""Conversations from message rows: reply links, link trees, order, soundness.

Declared parents are taken as links. A turn without one may have lost its link, or channels may be
interleaved in one session: earlier turns of the session within `max_gap` seconds are scored as its
parent by time, mention, lexical overlap and change of speaker, and the likeliest one is chosen. The links form
trees. threads() gives the trees themselves; conversations() orders a session by time, and where times are missing
or equal by the tree. Order and soundness are decided over range-sorted partitions, whose edges are
stitched by a window over one row a session and partition, so a session that holds a third of all rows is never gathered in one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.text import is_blank, words
from mnemospark.operators.forest import forest
from mnemospark.session import Scratch

#: The four speakers and their common synonyms.
SPEAKERS = {
    "user": ("user", "human", "person", "customer"),
    "assistant": ("assistant", "ai", "bot", "model", "chatbot"),
    "system": ("system", "developer"),
    "tool": ("tool", "function"),
}
USER, ASSISTANT = 0, 1


def speaker(role: Column) -> Column:
    """user, assistant, system or tool; null if the role can't be read."""
    plain = F.lower(F.regexp_replace(role, r"[^\p{L}]+", ""))
    out = F.lit(None).cast("string")
    for name, ways in SPEAKERS.items():
        out = F.when(plain.isin(*ways), name).otherwise(out)
    return out


def epoch_seconds(t: Column) -> Column:
    """Seconds from seconds, milli-, micro- or nanoseconds; null for NaN and infinite values."""
    fine = F.when(~F.isnan(t) & (F.abs(t) < F.lit(1e30)), t)
    size = F.abs(fine)
    return F.when(size >= 1e17, fine / 1e9).when(size >= 1e14, fine / 1e6).when(size >= 1e11, fine / 1e3).otherwise(fine)


def speaker_code(name: Column) -> Column:
    return F.when(name == "user", USER).when(name == "assistant", ASSISTANT).when(name.isNotNull(), 2)


#: Weights of the link score: closeness in time (and its scale in seconds), shared words by their rarity so far, mention of the turn, change of speaker.
TIME, SCALE, SHARED, MENTION, TURN = 1.0, 600.0, 4.0, 1.0, 0.2
_GUESS = "session_id string, turn_id string, guess string, score double"


def _best_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The likeliest parent of each asked turn, over rows sorted by session, block, slice and time.

    A later candidate can only lose to an earlier one that shares words, is named, or is the
    latest of another speaker: those alone are scored, by an index from words to turns.
    """
    here = None
    for b in batches:
        out: list[tuple] = []
        cols = [b.column(c).to_pylist() for c in ("session_id", "block", "cut", "turn_id", "time", "code", "root", "root_time", "w", "asked", "own")]
        for session, block, cut, turn, at, code, root, root_at, w, asked, own in zip(*cols):
            if (session, block, cut) != here:
                here, ids, times, codes, roots, by_word, by_id = (session, block, cut), [], [], [], [], {}, {}
                late, latest = [], {}  # turns whose root is not yet before the row read, a heap by root; of all others the latest of each speaker
            if asked and own:
                seen: dict[int, float] = {}
                whole = 1e-9
                for word in w:
                    found = by_word.get(word, ())
                    rare = np.log1p(len(ids) / (1 + len(found)))
                    whole += rare
                    for k in found:
                        seen[k] = seen.get(k, 0.0) + rare
                    if word in by_id:
                        seen.setdefault(by_id[word], 0.0)
                while late and late[0][:2] < (at, turn):  # rows come in order of time, so what is before one stays before all later ones
                    k = heapq.heappop(late)[2]
                    latest[codes[k]] = max(latest.get(codes[k], -1), k)
                for k in latest.values():
                    seen.setdefault(k, 0.0)
                best = None
                for k, shared in seen.items():
                    if roots[k][0] < at or (roots[k][0] == at and roots[k][1] < turn):
                        score = TIME * np.exp(-(at - times[k]) / SCALE) + SHARED * shared / whole + (MENTION if ids[k].lower() in w else 0.0) + (TURN if codes[k] != code else 0.0)
                        best = max(best, (score, times[k], ids[k])) if best else (score, times[k], ids[k])
                if best:
                    out.append((session, turn, best[2], float(best[0])))
            k = len(ids)
            ids.append(turn), times.append(at), codes.append(code), roots.append((root_at, root))
            heapq.heappush(late, (root_at, root, k))
            by_id[turn.lower()] = k
            for word in w:
                by_word.setdefault(word, []).append(k)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.string(), pa.string(), pa.string(), pa.float64()))], names=["session_id", "turn_id", "guess", "score"])


def likely_parents(trees: DataFrame, turns: DataFrame, lost: DataFrame, max_gap: float = 86_400.0, slice_rows: int = 50_000) -> DataFrame:
    """(session_id, turn_id, guess, score) for the turns lost(session_id, turn_id), where there is an earlier turn within the gap.

    Turns are laid out in blocks of `max_gap` seconds, each with the block before it, and read in order of time; no pair is made.
    A block of more than `slice_rows` turns is read in several slices that share its asked turns between
    them. A guess always lies in a tree with an earlier root, so guesses never form a loop.
    """
    asked = lost.select("session_id", "turn_id", F.lit(True).alias("asked"))
    sessions = lost.select("session_id").distinct()
    texts = turns.join(sessions, "session_id", "left_semi").groupBy("session_id", "turn_id").agg(F.min("content").alias("content"))
    texts = texts.select("session_id", "turn_id", F.array_distinct(words(F.coalesce("content", F.lit("")))).alias("w"))
    near = trees.where("on_path AND NOT loop AND time IS NOT NULL").join(sessions, "session_id", "left_semi")
    root_of = near.where("turn_id = root").select("session_id", F.col("turn_id").alias("root"), F.col("time").alias("root_time"))
    rows = near.join(root_of, ["session_id", "root"], "left").join(texts, ["session_id", "turn_id"]).join(asked, ["session_id", "turn_id"], "left")
    own_block = F.floor(F.col("time") / F.lit(max_gap)).cast("long")
    rows = rows.select("session_id", "turn_id", "time", F.coalesce("code", F.lit(9)).cast("int").alias("code"), "root", F.coalesce("root_time", F.lit(float("-inf"))).alias("root_time"), "w", F.coalesce("asked", F.lit(False)).alias("asked"), own_block.alias("at"))
    size = rows.groupBy("session_id", "at").agg(F.count("*").alias("size"), F.max("asked").alias("any"))
    blocks = size.withColumn("block", F.explode(F.array("at", F.col("at") + 1))).groupBy("session_id", "block").agg(F.ceil(F.sum("size") / F.lit(slice_rows)).cast("int").alias("cuts"), F.max(F.col("any") & (F.col("at") == F.col("block"))).alias("any")).where("any").drop("any")
    laid = rows.withColumn("block", F.explode(F.array("at", F.col("at") + 1))).join(blocks, ["session_id", "block"]).withColumn("cut", F.explode(F.expr("sequence(0, cuts - 1)")))
    laid = laid.withColumn("own", (F.col("at") == F.col("block")) & (F.pmod(F.xxhash64("turn_id"), "cuts") == F.col("cut"))).drop("at", "cuts")
    keys = ["session_id", "block", "cut"]
    return laid.repartition(*keys).sortWithinPartitions(*keys, "time", "turn_id").mapInArrow(_best_links, _GUESS)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions within one sorted partition, and what its neighbours must know of its outer sessions."""
    from pyspark import TaskContext

    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got).combine_chunks()
    pid, n = TaskContext.get().partitionId(), t.num_rows
    g = t["session_id"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    seg = np.cumsum(np.r_[True, g[1:] != g[:-1]]) - 1
    k = len(start)
    on, shown = t["on_path"].to_numpy(), t["shown"].to_numpy()
    counted = on & shown
    upto = np.cumsum(counted)
    pos = upto - (upto[start] - counted[start])[seg]
    count = np.add.reduceat(counted.astype(np.int64), start)
    bad = np.logical_or.reduceat(t["flag"].to_numpy(), start)
    code = pc.fill_null(t["code"], 9).to_numpy()
    said = np.flatnonzero(counted & (code <= ASSISTANT))
    first, last = np.full(k, -1), np.full(k, -1)
    if len(said):
        s, c = seg[said], code[said]
        twice = (s[1:] == s[:-1]) & (c[1:] == USER) & (c[:-1] == USER)
        bad[s[1:][twice]] = True
        first[s[::-1]], last[s] = c[::-1], c
    edge = np.zeros(k, bool)
    edge[[0, -1]] = True
    sound = ~bad & (first == USER) & (last == ASSISTANT)
    rows = np.flatnonzero(counted & (sound | edge)[seg])
    take = pa.array(rows)
    none = lambda m, kind: pa.nulls(m, kind)
    out = pa.table(
        {
            "pid": pa.array(np.full(len(rows), pid, np.int32)), "edge": pa.array(edge[seg[rows]]), "session_id": t["session_id"].take(take), "turn_id": t["turn_id"].take(take), "pos": pa.array(pos[rows].astype(np.int64)),
            "count": none(len(rows), pa.int64()), "bad": none(len(rows), pa.bool_()), "first": none(len(rows), pa.int32()), "last": none(len(rows), pa.int32()),
        }
    )
    yield from out.to_batches(max_chunksize=20_000)
    at = np.flatnonzero(edge)
    m = len(at)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(m, pid, np.int32)), pa.array(np.ones(m, bool)), t["session_id"].take(pa.array(start[at])).combine_chunks(), none(m, pa.string()), none(m, pa.int64()), pa.array(count[at].astype(np.int64)), pa.array(bad[at]), pa.array(first[at].astype(np.int32)), pa.array(last[at].astype(np.int32))],
        names=["pid", "edge", "session_id", "turn_id", "pos", "count", "bad", "first", "last"],
    )


_NUMBERED = "pid int, edge boolean, session_id string, turn_id string, pos long, count long, bad boolean, first int, last int"


def _stitched(edges: DataFrame) -> DataFrame:
    """(session_id, pid, skip) of the sound sessions at partition edges, from one row a session and partition."""
    before = Window.partitionBy("session_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    said = lambda c: F.when(F.col(c) >= 0, F.col(c))
    rows = edges.select("session_id", "pid", "bad", "first", "last", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("skip"), F.last(said("last"), ignorenulls=True).over(before).alias("was"))
    rows = rows.withColumn("bad", F.col("bad") | F.coalesce((F.col("was") == USER) & (F.col("first") == USER), F.lit(False)))
    whole = rows.groupBy("session_id").agg(F.max("bad").alias("any"), F.min_by(said("first"), F.when(F.col("first") >= 0, F.col("pid"))).alias("f"), F.max_by(said("last"), F.when(F.col("last") >= 0, F.col("pid"))).alias("l"))
    return rows.join(whole.where(f"NOT any AND f = {USER} AND l = {ASSISTANT}").select("session_id"), "session_id").select("session_id", "pid", "skip")


def _trees(turns: DataFrame, scratch: Scratch, rows_per_task: int) -> DataFrame:
    """One row per turn with its declared tree, time, speaker and what makes its session unsound."""
    on = F.coalesce(F.col("on_current_path"), F.lit(False))
    slim = turns.select(
        "session_id", "turn_id", "parent_turn_id", epoch_seconds(F.col("occurred_at")).alias("time"), on.alias("on"), speaker_code(speaker(F.col("role"))).alias("code"), (~is_blank(F.col("content"))).alias("shown"),
        F.xxhash64(F.coalesce("content", F.lit("\u0000none"))).alias("text"),
    )
    carry = {
        "time": F.min("time"),
        "on_path": F.max("on"),
        "code": F.min("code"),
        "shown": F.max("shown"),
        "odd": (F.min("text") != F.max("text")) | F.max(F.col("on") & F.col("code").isNull()),
    }
    tree = forest(slim, "session_id", "turn_id", "parent_turn_id", hint="time", inherit="time", carry=carry, rows_per_task=rows_per_task)
    return scratch.save(tree.drop("n_below").withColumn("flag", F.col("odd") | F.col("loop") | ((F.col("depth") == 0) & F.col("parent").isNotNull())))


def _regrown(trees: DataFrame, guesses: DataFrame, rows_per_task: int) -> DataFrame:
    """The trees once guessed links count as declared ones; only sessions with a guess are made again."""
    touched = guesses.select("session_id").distinct()
    again = trees.join(touched, "session_id", "left_semi").join(guesses.select("session_id", "turn_id", "guess"), ["session_id", "turn_id"], "left").withColumn("parent", F.coalesce("guess", "parent"))
    keep = {c: F.first(c) for c in ("time", "on_path", "code", "shown", "odd", "flag")}
    redone = forest(again.select("session_id", "turn_id", "parent", *keep), "session_id", "turn_id", "parent", hint="time", inherit="time", carry=keep, rows_per_task=rows_per_task)
    return trees.join(touched, "session_id", "left_anti").unionByName(redone.drop("n_below"))


def threads(turns: DataFrame, max_gap: float = 86_400.0, least: float = 0.5, rows_per_task: int = 50_000) -> DataFrame:
    """(session_id, turn_id, parent, thread, depth, guessed): link trees of every session's current path.

    Turns that name no parent, or one that the session lacks, are linked to the likeliest earlier turn if its score
    reaches `least`; else they open a thread. thread is the turn that opened it. Turns on or under a loop have thread ''
    and depth -1; turns without a time keep what they declare. Rules for rows are those of conversations().
    """
    scratch = Scratch(turns.sparkSession)
    trees = _trees(turns, scratch, rows_per_task)
    lost = trees.where("on_path AND NOT loop AND depth = 0 AND time IS NOT NULL").select("session_id", "turn_id")
    guesses = scratch.save(likely_parents(trees, turns, lost, max_gap).where(F.col("score") >= least))
    grown = _regrown(trees, guesses, rows_per_task).where("on_path")
    known = grown.join(guesses.select("session_id", "turn_id", F.lit(True).alias("guessed")), ["session_id", "turn_id"], "left")
    parent = F.when((F.col("depth") != 0) | F.col("loop"), F.col("parent"))
    return known.select("session_id", "turn_id", parent.alias("parent"), F.col("root").alias("thread"), F.col("depth").cast("long").alias("depth"), F.coalesce("guessed", F.lit(False)).alias("guessed"))


def conversations(turns: DataFrame, rows_per_task: int = 50_000) -> DataFrame:
    """(session_id, pos, turn_id): every visible turn of every sound conversation, pos from 1.

    A conversation is a session's rows with on_current_path true. It is unsound, and left out as a
    whole, if a turn names a parent that the session lacks, parents form a loop, one turn_id has
    different contents (null is one of them), a role on the path can't be read, or the visible user
    and assistant turns lack a user turn, don't begin with one, or hold a user turn without an
    assistant turn before the next user turn or the end. Times in other units count as
    seconds; a turn without a time stands after its parent (roots without one come first); ties
    go by depth in the tree, then by turn_id. Rows without session_id or turn_id are left out,
    repeated rows are one turn, a null on_current_path is false.
    """
    scratch = Scratch(turns.sparkSession)
    trees = _trees(turns, scratch, rows_per_task)
    # second trees of sound sessions have lost their link
    roots = trees.where("on_path AND depth = 0 AND parent IS NULL")
    first = roots.groupBy("session_id").agg(F.min(F.struct(F.coalesce("time", F.lit(float("-inf"))).alias("t"), F.col("turn_id").alias("i"))).alias("first"), F.count("*").alias("roots")).where("roots > 1")
    first = first.join(trees.where("flag").select("session_id").distinct(), "session_id", "left_anti")
    lost = scratch.save(roots.join(first, "session_id").where("turn_id <> first.i AND time IS NOT NULL").select("session_id", "turn_id"))
    if lost.limit(1).count():
        trees = _regrown(trees, scratch.save(likely_parents(trees, turns, lost)), rows_per_task)

    seq = trees.where("on_path OR flag").select("session_id", F.coalesce("fill", F.lit(float("-inf"))).alias("at"), "depth", "turn_id", "code", "shown", "on_path", "flag")
    parts = max(1, -(-trees.count() // rows_per_task))
    keys = ["session_id", "at", "depth", "turn_id"]
    numbered = scratch.save(seq.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(_number, _NUMBERED))
    inside = numbered.where("NOT edge").select("session_id", "pos", "turn_id")
    spots = _stitched(numbered.where("edge AND count IS NOT NULL").select("pid", "session_id", "count", "bad", "first", "last"))
    outer = numbered.where("edge AND turn_id IS NOT NULL").join(spots, ["session_id", "pid"]).select("session_id", (F.col("pos") + F.col("skip")).alias("pos"), "turn_id")
    return inside.unionByName(outer)

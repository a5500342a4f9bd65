"""Parent-child rows to full hierarchies, for trees of any depth and groups of any size.

Rows are range-partitioned by group and order hint, so every task holds a bounded stretch of rows
and a huge group is spread over many tasks. Each task contracts its parent chains to fragment
exits with vectorised pointer jumping. Groups that lie inside one task are finished there. For
the others the exits form a smaller quotient forest, which is solved by the same function, and its
results are expanded back over the fragments. Loops show either inside a task or in a quotient.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.session import Scratch

_LOCAL = "pid int, open boolean, g string, id string, parent string, hint double, len long, weight long, exit string, exit_parent string, dist long, below long, loop boolean, fill double"


def contract(up: np.ndarray, length: np.ndarray, weight: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(exit, dist, total, loop) of each row, given its parent's row or -1.

    exit: the topmost row reached; dist: summed length on the way; total: weight of the row and
    everything under it; loop: the row is on a loop, under one, or under a bad exit.
    """
    n = len(up)
    top = up < 0
    at = np.where(top, np.arange(n), up)
    dist, hops = np.where(top, 0, length), np.where(top, 0, 1)
    for _ in range(max(1, int(n).bit_length() + 1)):
        if top[at].all():
            break
        dist, hops, at = dist + dist[at], hops + hops[at], at[at]
    loop = ~top[at] | bad[at]
    total = weight.astype(np.int64).copy()
    sound = np.flatnonzero(~loop & ~top)
    order = sound[np.argsort(-hops[sound], kind="stable")]
    level = hops[order]
    cuts = np.flatnonzero(np.diff(level)) + 1
    for part in np.split(order, cuts) if len(order) else []:
        np.add.at(total, up[part], total[part])
    return at, dist, total, loop


def parent_rows(g: pa.ChunkedArray, ids: pa.ChunkedArray, parents: pa.ChunkedArray) -> np.ndarray:
    """Row number of each row's parent within the same group, or -1."""
    n = len(ids)
    if n == 0:
        return np.empty(0, np.int64)
    codes = pa.chunked_array([*ids.chunks, *parents.chunks], ids.type).combine_chunks().dictionary_encode()
    k = pc.fill_null(codes.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    gk = g.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    span = len(codes.dictionary) + 1
    own, want = np.where(k[:n] < 0, -2, gk * span + k[:n]), np.where(k[n:] < 0, -1, gk * span + k[n:])
    order = np.argsort(own, kind="stable")
    pos = np.minimum(np.searchsorted(own[order], want), n - 1)
    return np.where(own[order[pos]] == want, order[pos], -1)


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got) if got else None


def inherited(up: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Each row's own value, else that of its nearest ancestor here that has one, else NaN."""
    at = np.where(np.isnan(value) & (up >= 0), up, np.arange(len(up)))
    for _ in range(max(1, len(up).bit_length() + 1)):
        at = at[at]
    return value[at]


def _local_pass(batches: Iterator[pa.RecordBatch], carry: list[str]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    t = _whole(batches)
    if t is None:
        return
    n = t.num_rows
    up = parent_rows(t["g"], t["id"], t["parent"])
    exits, dist, total, loop = contract(up, t["len"].to_numpy(), t["weight"].to_numpy(), t["bad"].to_numpy())
    ends = pc.min_max(t["g"])
    edge = pc.or_(pc.equal(t["g"], ends["min"]), pc.equal(t["g"], ends["max"]))
    is_exit = pa.array(up < 0)
    out = pa.table(
        {
            "pid": pa.array(np.full(n, TaskContext.get().partitionId(), np.int32)),
            "open": edge,
            "g": t["g"],
            "id": t["id"],
            "parent": t["parent"],
            "hint": t["hint"],
            "len": t["len"],
            "weight": t["weight"],
            "exit": t["id"].take(pa.array(exits)),
            "exit_parent": pc.if_else(is_exit, t["parent"], pa.scalar(None, pa.string())),
            "dist": pa.array(dist.astype(np.int64)),
            "below": pa.array(total),
            "loop": pa.array(loop),
            "fill": pa.array(inherited(up, pc.fill_null(t["val"], np.nan).to_numpy()), from_pandas=True),
            **{c: t[c] for c in carry},
        }
    )
    yield from out.to_batches(max_chunksize=20_000)


def _totals(nodes: pa.Table, added: pa.Table) -> pa.Table:
    """Weight under each row of one fragment set once the totals hung below its rows are known."""
    g = pa.chunked_array([*nodes["g"].chunks, *added["g"].chunks], pa.string())
    ids = pa.chunked_array([*nodes["id"].chunks, pa.nulls(added.num_rows, pa.string())], pa.string())
    parents = pa.chunked_array([*nodes["parent"].chunks, *added["id"].chunks], pa.string())
    n = nodes.num_rows
    up = parent_rows(g, ids, parents)
    weight = np.concatenate([nodes["weight"].to_numpy(), added["total"].to_numpy()]).astype(np.int64)
    bad = np.zeros(len(weight), bool)
    _, _, total, _ = contract(up, np.ones(len(weight), np.int64), weight, bad)
    return pa.table({"g": nodes["g"], "id": nodes["id"], "below": pa.array(total[:n])})


def _solve(nodes: DataFrame, count: int, scratch: Scratch, rows_per_task: int, carry: list[str]) -> DataFrame:
    """(g, id, parent, root, depth, below, loop, fill, *carry) of nodes(g, id, parent, hint, len, weight, bad, val, *carry)."""
    parts = max(1, -(-count // rows_per_task))
    ranged = nodes.coalesce(1) if parts == 1 else nodes.repartitionByRange(parts, "g", "hint", "id")
    extra = "".join(f", `{c}` {nodes.schema[c].dataType.simpleString()}" for c in carry)
    done = ranged.mapInArrow(lambda batches: _local_pass(batches, carry), _LOCAL + extra)
    shape = ["g", "id", "parent", F.col("exit").alias("root"), F.col("dist").alias("depth"), "below", "loop", "fill", *carry]
    if parts == 1:
        return done.select(*shape)
    done = scratch.save(done)
    rest = done.where("open")
    exits = rest.where("id = exit AND NOT loop").select("g", "id", "exit_parent", "hint", "below", "fill", F.col("len").alias("own_len"))
    above = rest.select("g", F.col("id").alias("exit_parent"), F.col("pid").alias("p_pid"), F.col("exit").alias("p_exit"), F.col("dist").alias("p_dist"), F.col("loop").alias("p_loop"), F.col("fill").alias("p_fill"))
    quotient = scratch.save(
        exits.join(above, ["g", "exit_parent"], "left").select("g", "id", "exit_parent", "hint", "below", "p_pid", "p_exit", (F.col("p_dist") + F.col("own_len")).alias("len"), F.coalesce("p_loop", F.lit(False)).alias("bad"), F.coalesce("fill", "p_fill").alias("val"))
    )
    # exits under which nothing hangs are raked off and answered from the fragment they hang on; roots among them are answered at once
    held = quotient.where("p_exit IS NOT NULL").select("g", F.col("p_exit").alias("id")).distinct()
    inner = quotient.join(held, ["g", "id"], "left_semi")
    leaves = quotient.where("p_exit IS NOT NULL").join(held, ["g", "id"], "left_anti")
    alone = quotient.where("p_exit IS NULL").join(held, ["g", "id"], "left_anti").select("g", "id", F.col("id").alias("root"), F.lit(0).cast("long").alias("depth"), "below", F.lit(False).alias("loop"), F.col("val").alias("fill"))
    raked = leaves.groupBy("g", F.col("p_exit").alias("id")).agg(F.sum("below").alias("extra"))
    # a parent that lies on a local loop is no quotient node, so its children end there and are bad
    smaller = scratch.save(
        inner.join(raked, ["g", "id"], "left").select(
            "g", "id", F.when(~F.col("bad"), F.col("p_exit")).alias("parent"), "hint", F.coalesce("len", F.lit(0)).cast("long").alias("len"), (F.col("below") + F.coalesce("extra", F.lit(0))).alias("weight"), "bad", "val"
        )
    )
    size = smaller.count()
    if size > 0.7 * count:  # chains lie across the hint: put children beside parents by coin flips instead
        head = lambda c: F.xxhash64(F.col(c), F.lit(count), F.lit(rows_per_task)) % 2 == 0  # noqa: E731, B023
        mate = F.when(~head("id") & F.col("parent").isNotNull() & head("parent"), F.col("parent")).otherwise(F.col("id"))
        smaller = smaller.withColumn("hint", F.xxhash64(mate).cast("double"))
        rows_per_task += 1  # other coins on the next level
    solved = scratch.save(_solve(smaller, size, scratch, rows_per_task, []))
    on = solved.select("g", F.col("id").alias("p_exit"), "root", "depth", F.col("loop").alias("on_loop"), "fill")
    late = leaves.join(on, ["g", "p_exit"], "left").select(
        "g", "id", "root", (F.col("depth") + F.col("len")).alias("depth"), "below", (F.col("bad") | F.coalesce("on_loop", F.lit(True))).alias("loop"), F.coalesce("val", "fill").alias("fill")
    )
    solved = scratch.save(solved.select("g", "id", "root", "depth", "below", "loop", "fill").unionByName(late).unionByName(alone))
    hung = (
        quotient.where("p_exit IS NOT NULL AND NOT bad")
        .join(solved.select("g", "id", F.col("below").alias("total"), "loop"), ["g", "id"])
        .where("NOT loop")
        .groupBy(F.col("p_pid").alias("pid"), "g", F.col("exit_parent").alias("id"))
        .agg(F.sum("total").alias("total"))
    )
    touched = rest.where("NOT loop").select("pid", "g", "id", "parent", "weight")
    totals = touched.groupBy("pid").cogroup(hung.groupBy("pid")).applyInArrow(_totals, "g string, id string, below long")
    upper = solved.select("g", F.col("id").alias("exit"), F.col("root"), F.col("depth").alias("up"), F.col("loop").alias("q_loop"), F.col("fill").alias("q_fill"))
    expanded = (
        rest.drop("below")
        .join(upper, ["g", "exit"], "left")
        .join(totals, ["g", "id"], "left")
        .select("g", "id", "parent", "root", (F.col("dist") + F.col("up")).alias("depth"), "below", (F.col("loop") | F.coalesce("q_loop", F.lit(False))).alias("loop"), F.coalesce("fill", "q_fill").alias("fill"), *carry)
    )
    return done.where("NOT open").select(*shape).unionByName(expanded)


def forest(df: DataFrame, group: str, node: str, parent: str, hint: str | None = None, inherit: str | None = None, carry: dict | None = None, rows_per_task: int = 50_000) -> DataFrame:
    """(group, node, parent, root, depth, n_below, loop, fill, *carry), one row per distinct node of a group.

    A node whose parent is null, blank or absent from its group is a root of depth 0. Nodes on a
    loop, a node that is its own parent, and all nodes under a loop get loop = true, root '',
    depth -1 and n_below -1. Repeated rows are one node; of several parents the largest counts.
    Rows without a group or node are left out. `hint` (a number that orders rows roughly as
    they hang together, such as a time) changes the cost, never the result. `fill` is the
    node's own `inherit` value, else the nearest ancestor's, else null. `carry` names further
    output columns as aggregates over the rows of a node.
    Each level of recursion shrinks: leaves and roots without fragments under them are raked off, and chains that the hint
    scatters are halved by coin flips.
    """
    scratch = Scratch(df.sparkSession)
    order = F.col(hint).cast("double") if hint else F.lit(0.0)
    named = F.when(F.col(parent).rlike(r"\S"), F.col(parent).cast("string"))
    carry = carry or {}
    own = F.col(inherit).cast("double") if inherit else F.lit(None).cast("double")
    nodes = scratch.save(
        df.where(F.col(group).isNotNull() & F.col(node).isNotNull())
        .groupBy(F.col(group).cast("string").alias("g"), F.col(node).cast("string").alias("id"))
        .agg(F.max(named).alias("parent"), F.coalesce(F.min(order), F.lit(0.0)).alias("hint"), F.min(own).alias("val"), *[e.alias(c) for c, e in carry.items()])
        .select("*", F.lit(1).cast("long").alias("len"), F.lit(1).cast("long").alias("weight"), F.lit(False).alias("bad"))
    )
    out = _solve(nodes, nodes.count(), scratch, rows_per_task, list(carry))
    sound = ~F.col("loop")
    return out.select(
        F.col("g").alias(group),
        F.col("id").alias(node),
        "parent",
        F.when(sound, F.col("root")).otherwise("").alias("root"),
        F.when(sound, F.col("depth")).otherwise(-1).alias("depth"),
        F.when(sound, F.col("below") - 1).otherwise(-1).alias("n_below"),
        "loop",
        F.when(sound, F.col("fill")).alias("fill"),
        *carry,
    )


def chains(up: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(flat, lengths): for each of the rows, the rows below its exit on the way down to it."""
    steps, at = [], rows.copy()
    where = np.arange(len(rows))
    while True:
        keep = up[at] >= 0
        at, where = at[keep], where[keep]
        if not len(at):
            break
        steps.append((where, at))
        at = up[at]
    length = np.zeros(len(rows), np.int64)
    for w, _ in steps:
        length[w] += 1
    ends = np.cumsum(length)
    flat = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    for k, (w, a) in enumerate(steps):  # the k-th step lies k places before the end
        flat[ends[w] - 1 - k] = a
    return flat, length


_PATHS = "pid int, open boolean, g string, id string, hint double, exit string, exit_parent string, seg array<string>, tail array<string>, loop boolean"


def _path_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    t = _whole(batches)
    if t is None:
        return
    t = t.combine_chunks()
    n, one = t.num_rows, np.zeros(t.num_rows, np.int64)
    up = parent_rows(t["g"], t["id"], t["parent"])
    exits, _, _, loop = contract(up, one, one, t["bad"].to_numpy())
    ends = pc.min_max(t["g"])
    edge = pc.or_(pc.equal(t["g"], ends["min"]), pc.equal(t["g"], ends["max"]))
    segments = t["seg"].combine_chunks()
    for start in range(0, n, 2_000):
        rows = np.arange(start, min(n, start + 2_000))
        sound = np.where(loop[rows], -1, rows)
        flat, length = chains(up, sound[sound >= 0])
        counts = np.zeros(len(rows), np.int64)
        counts[sound >= 0] = length
        parts = segments.take(pa.array(flat))
        sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
        total = np.concatenate([[0], np.cumsum(sizes)])
        offsets = total[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
        take = pa.array(rows)
        is_exit = pa.array(up[rows] < 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(rows), TaskContext.get().partitionId(), np.int32)), edge.take(take).combine_chunks(), t["g"].take(take).combine_chunks(), t["id"].take(take).combine_chunks(), t["hint"].take(take).combine_chunks(), t["id"].take(pa.array(exits[rows])).combine_chunks(), pc.if_else(is_exit, t["parent"].take(take).combine_chunks(), pa.scalar(None, pa.string())), segments.take(take), pa.ListArray.from_arrays(pa.array(offsets), parts.flatten()), pa.array(loop[rows])],
            names=["pid", "open", "g", "id", "hint", "exit", "exit_parent", "seg", "tail", "loop"],
        )


def _solve_paths(nodes: DataFrame, count: int, scratch: Scratch, rows_per_task: int) -> DataFrame:
    """(g, id, path) of nodes(g, id, parent, hint, seg, bad); path is null on and under loops."""
    parts = max(1, -(-count // rows_per_task))
    ranged = nodes.coalesce(1) if parts == 1 else nodes.repartitionByRange(parts, "g", "hint", "id")
    done = scratch.save(ranged.mapInArrow(_path_pass, _PATHS))
    tops = done.where("id = exit AND NOT loop").select("g", F.col("id").alias("exit"), F.col("seg").alias("top"))
    own = F.when(~F.col("loop"), F.concat("top", "tail"))
    if parts == 1:
        return done.join(tops, ["g", "exit"], "left").select("g", "id", own.alias("path"))
    closed = done.where("NOT open").join(tops, ["g", "exit"], "left").select("g", "id", own.alias("path"))
    rest = done.where("open")
    above = rest.select("g", F.col("id").alias("exit_parent"), F.col("exit").alias("p_exit"), F.col("tail").alias("p_tail"), F.col("loop").alias("p_loop"))
    quotient = rest.where("id = exit AND NOT loop").select("g", "id", "exit_parent", "hint", "seg").join(above, ["g", "exit_parent"], "left")
    bad = F.coalesce("p_loop", F.lit(False))
    quotient = scratch.save(quotient.select("g", "id", "p_exit", "hint", F.concat(F.coalesce("p_tail", F.array().cast("array<string>")), "seg").alias("seg"), bad.alias("bad")))
    # exits under which nothing hangs are left to the fragment they hang on, or are whole paths
    held = quotient.where("p_exit IS NOT NULL").select("g", F.col("p_exit").alias("id")).distinct()
    edge = scratch.save(quotient.join(held, ["g", "id"], "left_anti").select("g", "id", "p_exit", "seg"))
    smaller = scratch.save(quotient.join(held, ["g", "id"], "left_semi").select("g", "id", F.when(~F.col("bad"), F.col("p_exit")).alias("parent"), "hint", "seg", "bad"))
    size = smaller.count()
    if size > 0.7 * count:
        head = lambda c: F.xxhash64(F.col(c), F.lit(count), F.lit(rows_per_task)) % 2 == 0  # noqa: E731, B023
        mate = F.when(~head("id") & F.col("parent").isNotNull() & head("parent"), F.col("parent")).otherwise(F.col("id"))
        smaller = smaller.withColumn("hint", F.xxhash64(mate).cast("double"))
        rows_per_task += 1
    solved = scratch.save(_solve_paths(smaller, size, scratch, rows_per_task))
    on = solved.select("g", F.col("id").alias("p_exit"), F.col("path").alias("above"))
    late = edge.where("p_exit IS NOT NULL").join(on, ["g", "p_exit"], "left").select("g", "id", F.concat("above", "seg").alias("path"))
    solved = solved.unionByName(late).unionByName(edge.where("p_exit IS NULL").select("g", "id", F.col("seg").alias("path")))
    solved = solved.select("g", F.col("id").alias("exit"), F.col("path").alias("top"))
    return closed.unionByName(rest.join(solved, ["g", "exit"], "left").select("g", "id", own.alias("path")))


def tree_paths(df: DataFrame, group: str, node: str, parent: str, hint: str | None = None, rows_per_task: int = 50_000) -> DataFrame:
    """(group, node, path): the nodes from the root down to each node, null for nodes on or under a loop.

    The ancestors of a node are its path; its descendants are the rows whose path holds it, so
    exploding path gives every ancestor-descendant pair. Rules are those of forest(); fragments are contracted and
    expanded the same way, each carrying the stretch of nodes that it stands for. The result is as
    large as the sum of depths, and no task makes more than 2,000 paths at a time.
    """
    scratch = Scratch(df.sparkSession)
    order = F.col(hint).cast("double") if hint else F.lit(0.0)
    named = F.when(F.col(parent).rlike(r"\S"), F.col(parent).cast("string"))
    nodes = scratch.save(
        df.where(F.col(group).isNotNull() & F.col(node).isNotNull())
        .groupBy(F.col(group).cast("string").alias("g"), F.col(node).cast("string").alias("id"))
        .agg(F.max(named).alias("parent"), F.coalesce(F.min(order), F.lit(0.0)).alias("hint"))
        .select("*", F.array("id").alias("seg"), F.lit(False).alias("bad"))
    )
    return _solve_paths(nodes, nodes.count(), scratch, rows_per_task).select(F.col("g").alias(group), F.col("id").alias(node), "path")

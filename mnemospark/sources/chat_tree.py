"""Chat-tree exports to flat, related tables of nodes, messages and links.

The JSON is parsed once by the JVM into a list of (key, node) entries. Everything after that works
on Arrow buffers: list offsets give parent indices, keys are propagated by take, and links are
resolved with sorted lookups over a whole batch. No record is visited on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.memory import SKIPPED_CONTENT

_NODE = "map<string,struct<parent:string,children:array<string>,message:struct<{}>>>"
#: What each table needs of a node; the JSON is parsed for no more than that.
_NEEDS = {
    "links": "author:struct<role:string>",
    "nodes": "author:struct<role:string>",
    "children": "author:struct<role:string>",
    "order": "create_time:double",
    "messages": "id:string,author:struct<role:string,name:string>,create_time:double,recipient:string,content:struct<content_type:string,parts:array<variant>,text:string>",
    "parts": "content:struct<parts:array<variant>>",
    "metadata": "metadata:map<string,string>",
}
TABLES = {
    "links": "export_id bigint, parent_id string, child_id string, speaker string, on_path bigint",
    "nodes": "export_id bigint, node_id string, parent_id string, n_children bigint, has_message boolean, on_path bigint",
    "children": "export_id bigint, node_id string, pos bigint, child_id string, known boolean",
    "order": "export_id bigint, node_id string, pos bigint",
    "messages": "export_id bigint, node_id string, message_id string, role string, author_name string, recipient string, create_time double, content_type string, text string, on_path bigint",
    "parts": "export_id bigint, node_id string, pos bigint, kind string, text string",
    "metadata": "export_id bigint, node_id string, key string, value string",
}


def _match(g_own: np.ndarray, own: pa.Array, g_want: np.ndarray, want: pa.Array) -> np.ndarray:
    """For each (g, want) the position of the last equal (g, own), or -1."""
    if len(own) == 0 or len(want) == 0:
        return np.full(len(want), -1)
    codes = pa.concat_arrays([own.cast(pa.string()), want.cast(pa.string())]).dictionary_encode()
    k = pc.fill_null(codes.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    span = len(codes.dictionary) + 1
    a = np.where(k[: len(own)] < 0, -2, g_own * span + k[: len(own)])
    b = np.where(k[len(own) :] < 0, -1, g_want * span + k[len(own) :])
    order = np.argsort(a, kind="stable")
    pos = np.maximum(np.searchsorted(a[order], b, side="right") - 1, 0)
    return np.where(a[order[pos]] == b, order[pos], -1)


def _one(col: pa.ChunkedArray | pa.Array) -> pa.Array:
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def _flat(batch: pa.RecordBatch) -> dict:
    """Node arrays of one batch with their parent, path mark and owning row."""
    entries = batch.column("entries")
    row = pc.list_parent_indices(entries).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(entries)
    key, node = pc.struct_field(flat, "key"), pc.struct_field(flat, "value")
    last = _match(row, key, row, key) == np.arange(len(row))  # a repeated key: its last writing holds
    if not last.all():
        keep = pa.array(last)
        row, key, node = row[last], key.filter(keep), node.filter(keep)
    n = len(row)
    children = pc.struct_field(node, "children")
    by = pc.list_parent_indices(children).to_numpy(zero_copy_only=False)
    listed = pc.list_flatten(children)
    named = _match(row, key, row[by], listed)
    declared = up = _match(row, key, row, pc.struct_field(node, "parent"))
    claimed = np.full(n, -1)
    ok = (named >= 0) & (named != by)
    claimed[named[ok][::-1]] = by[ok][::-1]  # the first node that names it
    up = np.where(up >= 0, up, claimed)
    on_path = np.zeros(n, bool)
    here = _match(row, key, np.arange(batch.num_rows), batch.column("current_node"))
    here = here[here >= 0]
    while len(here):
        on_path[here] = True
        here = up[here]
        here = here[here >= 0]
        here = here[~on_path[here]]
    count = np.zeros(n, np.int64)
    np.add.at(count, up[up >= 0], 1)
    return {"lists": children, "by": by, "listed": listed, "declared": declared, "row": row, "key": key, "up": up, "on_path": on_path, "children": count, "message": pc.struct_field(node, "message")}


def _text(parts: pa.ListArray, text: pa.Array) -> pa.Array:
    """The parts that aren't null, joined by line breaks; without any, `text`, or '' where there is a list."""
    part = pc.list_flatten(parts)
    there = part.is_valid()
    counts = np.bincount(pc.list_parent_indices(parts).filter(there).to_numpy(zero_copy_only=False), minlength=len(parts))
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    joined = pc.binary_join(pa.ListArray.from_arrays(offsets, part.filter(there)), "\n")
    return pc.if_else(pa.array(counts > 0), joined, pc.coalesce(text, pc.if_else(parts.is_valid(), "", pa.scalar(None, pa.string()))))


def _positions(lists: pa.Array) -> np.ndarray:
    """0, 1, .. within each list."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _order(t: dict) -> np.ndarray:
    """Nodes of a batch in depth-first order, tree after tree: children as listed, roots and what no root reaches by (time, key)."""
    row, n = t["row"], len(t["row"])
    named = _match(row, t["key"], row[t["by"]], t["listed"])
    below: list[list[int]] = [[] for _ in range(n)]
    for p, c in zip(t["by"].tolist(), named.tolist()):
        if c >= 0 and c not in below[p]:
            below[p].append(c)
    at = pc.struct_field(t["message"], "create_time")
    late = pc.fill_null(at, np.inf).to_numpy(zero_copy_only=False)
    late = np.where(np.isfinite(late), late, np.inf)
    keys = t["key"].to_pylist()
    tops = sorted(np.flatnonzero(t["declared"] < 0).tolist(), key=lambda k: (row[k], late[k], keys[k]))
    rest = sorted(range(n), key=lambda k: (row[k], late[k], keys[k]))
    out, seen = [], np.zeros(n, bool)
    for top in [*tops, *rest]:
        todo = [top]
        while todo:
            k = todo.pop()
            if not seen[k]:
                seen[k] = True
                out.append(k)
                todo += reversed(below[k])
    return np.array(out, np.int64)


def _emit(what: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in TABLES[what].split(", ")]
    for batch in batches:
        if batch.num_rows == 0:
            continue
        t = _flat(batch)
        message, up, row, key = t["message"], t["up"], t["row"], t["key"]

        def of(at: np.ndarray, row=row, key=key, batch=batch) -> list:
            """The two columns that every row of node `at` begins with."""
            return [batch.column("export_id").take(pa.array(row[at])), key.take(pa.array(at))]

        on_path = t["on_path"].astype(np.int64)
        parent = lambda at: key.take(pa.array(up[at], mask=up[at] < 0))  # noqa: B023, E731
        if what == "links":
            at = np.flatnonzero(up >= 0)
            role = pc.fill_null(pc.struct_field(pc.struct_field(message.take(pa.array(at)), "author"), "role"), "")
            out = [of(at)[0], parent(at), of(at)[1], role, pa.array(on_path[at])]
        elif what == "nodes":
            at = np.arange(len(up))
            out = [*of(at), parent(at), pa.array(t["children"]), message.is_valid(), pa.array(on_path)]
        elif what == "children":
            known = _match(row, key, row[t["by"]], t["listed"]) >= 0
            out = [*of(t["by"]), pa.array(_positions(t["lists"])), t["listed"], pa.array(known)]
        elif what == "order":
            at = _order(t)
            start = np.searchsorted(row[at], row[at]) if len(at) and (np.diff(row[at]) >= 0).all() else None
            if start is None:  # leftovers come after all trees, so places are counted by export
                at = at[np.argsort(row[at], kind="stable")]
                start = np.searchsorted(row[at], row[at])
            out = [*of(at), pa.array(np.arange(len(at)) - start)]
        elif what == "metadata":
            maps = pc.struct_field(message, "metadata")
            lists = maps.cast(pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())])))
            at, pairs = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), pc.list_flatten(lists)
            out = [*of(at), pc.struct_field(pairs, "key"), pc.struct_field(pairs, "value")]
        elif what == "parts":
            parts = pc.struct_field(pc.struct_field(message, "content"), "parts")
            at, part = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False), pc.list_flatten(parts)
            out = [*of(at), pa.array(_positions(parts)), pc.struct_field(part, "kind"), pc.struct_field(part, "text")]
        else:
            at = np.flatnonzero(message.is_valid().to_numpy(zero_copy_only=False))
            m = message.take(pa.array(at))
            content, author = pc.struct_field(m, "content"), pc.struct_field(m, "author")
            hidden = pc.is_in(pc.utf8_trim_whitespace(pc.struct_field(content, "content_type")), pa.array(SKIPPED_CONTENT))
            text = pc.if_else(hidden, "", _text(pc.struct_field(content, "texts"), pc.struct_field(content, "text")))
            fields = [pc.struct_field(m, "id"), pc.fill_null(pc.struct_field(author, "role"), ""), pc.struct_field(author, "name"), pc.struct_field(m, "recipient"), pc.struct_field(m, "create_time")]
            out = [*of(at), *fields, pc.struct_field(content, "content_type"), text, pa.array(on_path[at])]
        yield pa.RecordBatch.from_arrays(out, names)


def _part_text(v: Column) -> Column:
    """The text of a part: a string, or the `text` of an object; null for anything else."""
    kind = F.schema_of_variant(v)
    return F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind.startswith("OBJECT"), F.when(F.schema_of_variant(F.try_variant_get(v, "$.text", "variant")) == "STRING", F.try_variant_get(v, "$.text", "string")))


def _part_kind(v: Column) -> Column:
    """'text', or what an object says it is; null for a null part."""
    kind = F.schema_of_variant(v)
    named = F.coalesce(F.try_variant_get(v, "$.content_type", "string"), F.try_variant_get(v, "$.type", "string"), F.lit("object"))
    return F.when(kind == "STRING", "text").when(kind.startswith("OBJECT"), named).when(kind != "VOID", F.lower(kind))


def _entries(what: str) -> Column:
    """The mapping as a list of (key, node); parts as texts (and kinds) of strings and objects."""
    entries = F.map_entries(F.from_json("mapping", _NODE.format(_NEEDS[what])))
    if what not in ("messages", "parts"):
        return entries

    def slim(e: Column) -> Column:
        m = e["value"]["message"]
        parts = m["content"]["parts"]
        if what == "parts":
            inner = F.struct(F.struct(F.transform(parts, lambda v: F.struct(_part_kind(v).alias("kind"), _part_text(v).alias("text"))).alias("parts")).alias("content"))
        else:
            content = F.struct(m["content"]["content_type"].alias("content_type"), F.transform(parts, _part_text).alias("texts"), m["content"]["text"].alias("text"))
            inner = F.struct(*[m[c].alias(c) for c in ("id", "author", "create_time", "recipient")], content.alias("content"))
        return F.struct(e["key"].alias("key"), F.struct(e["value"]["parent"].alias("parent"), e["value"]["children"].alias("children"), F.when(m.isNotNull(), inner).alias("message")).alias("value"))

    return F.transform(entries, slim)


def flatten_exports(exports: DataFrame, what: str = "links") -> DataFrame:
    """One of TABLES of the exports: links (one row per parent and child), nodes, children (as each node lists them, with their
    place), order (depth-first), messages, parts (of a message's content, with their place) or metadata (of a message, by key).

    A node's parent is the key in its `parent` if the mapping has it, else the first node whose
    `children` names it (never itself), else none. on_path is 1 for nodes met from current_node up
    to the root, each once, so loops end; a null or unknown current_node marks nothing. Null,
    empty and unreadable mappings give no rows; a repeated key counts once, with its last writing;
    other columns are ignored. The text of a message is that of its parts, strings or objects with a `text`, null parts and
    other objects left out, else its `text`. Messages of the types in SKIPPED_CONTENT (reasoning, injected
    context) keep their row, with an empty text. In depth-first order siblings stand as listed, roots and nodes that no root
    reaches by (time, key), each node once. Every table is one scan without any shuffle: a conversation never leaves its row.
    """
    parsed = exports.select(F.col("export_id").cast("bigint"), F.col("current_node").cast("string"), _entries(what).alias("entries"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _emit(what, batches)

    return parsed.where(F.col("entries").isNotNull()).mapInArrow(run, TABLES[what])

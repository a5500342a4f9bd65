"""Session exports in files: chat-tree JSON and linear JSON or JSON-lines sessions.

Files are found and read by Spark (`binaryFile`), one row each; a file that can't be read becomes
a warning row and never stops the others.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TURN = "path string, session_id string, title string, turn_id string, parent_turn_id string, role string, content string, occurred_at double, on_current_path boolean, seq bigint, warning string"
#: Limits on one file and on its nesting.
MAX_BYTES, MAX_DEPTH = 64 * 1024 * 1024, 64


def read_files(spark: SparkSession, root: str, pattern: str = "*.{json,jsonl}") -> DataFrame:
    """(path, content, sha256, byte_length) of the files below root, without hidden, index and dump files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    kept = files.where(~name.rlike(r"^\.") & ~name.rlike(r"(?i)^(index|dump)\b") & (F.lower(name) != "sessions.json"))
    return kept.select("path", "content", F.sha2("content", 256).alias("sha256"), F.col("length").alias("byte_length"))


def _strict(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key is written twice")
    return out


def _depth(value, level: int = 0) -> int:
    """Nesting depth, without recursion."""
    most, todo = 0, [(value, 1)]
    while todo:
        v, d = todo.pop()
        most = max(most, d)
        if d > MAX_DEPTH + 1:
            break
        todo += [(x, d + 1) for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())]
    return most


def _no_constant(name: str):
    raise ValueError(f"{name} is no finite number")


def parse_strict(text: str):
    """JSON without repeated keys, infinite numbers and nesting beyond MAX_DEPTH; else ValueError."""
    value = json.loads(text, object_pairs_hook=_strict, parse_constant=_no_constant)
    if _depth(value) > MAX_DEPTH:
        raise ValueError("nested too deep")
    return value


def text_of(content) -> str:
    """Text of a message content: a string, a list of parts, or an object with parts or text."""
    if content is None:
        return ""
    if isinstance(content, (int, float)) and not isinstance(content, bool):
        return str(content)
    if isinstance(content, str):
        return content
    if isinstance(content, list):
        return "\n".join(t for t in map(text_of, content) if t)
    if isinstance(content, dict):
        return text_of(content.get("parts")) or text_of(content.get("text")) or text_of(content.get("content"))
    return ""


def seconds(value) -> float | None:
    """Epoch seconds of a number or an ISO time; null for anything else."""
    if isinstance(value, bool) or value is None:
        return None
    try:
        out = float(value)
        return out if math.isfinite(out) else None
    except (TypeError, ValueError):
        pass
    try:
        at = datetime.fromisoformat(str(value).replace("Z", "+00:00"))
        return (at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp()
    except ValueError:
        return None


def content_id(session) -> str:
    """An id made from the content, the same for any order of keys."""
    return hashlib.sha256(json.dumps(session, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:32]


def _sessions(path: str, raw: bytes) -> Iterator[tuple[dict, list]]:
    """(session, messages) of one file; JSON lines may hold sessions or the messages of one."""
    text = raw.decode("utf-8-sig")
    if path.lower().endswith(".jsonl"):
        loose = []
        for n, line in enumerate(text.splitlines(), 1):
            if not line.strip():
                continue
            try:
                row = parse_strict(line)
            except ValueError as e:
                yield {"warning": f"line {n}: {e}"}, []
                continue
            if isinstance(row, dict) and ("messages" in row or "segments" in row):
                yield row, _messages(row)
            elif isinstance(row, dict):
                loose.append(row)
        if loose:
            yield {"id": path.rsplit("/", 1)[-1].rsplit(".", 1)[0]}, loose
        return
    value = parse_strict(text)
    for row in value if isinstance(value, list) else value.get("sessions", [value]):
        if isinstance(row, dict):
            yield row, _messages(row)


def _messages(session: dict) -> list:
    if isinstance(session.get("segments"), list):
        return [m for s in session["segments"] if isinstance(s, dict) for m in s.get("messages") or []]
    return session.get("messages") or []


def _turns(path: str, raw: bytes) -> Iterator[dict]:
    for session, messages in _sessions(path, raw):
        if "warning" in session:
            yield {"path": path, "warning": session["warning"]}
            continue
        sid = str(session.get("id") or session.get("session_id") or content_id(session))
        title = str(session.get("title") or sid)
        before = None
        for seq, m in enumerate(x for x in messages if isinstance(x, dict)):
            tid = next((str(m[k]) for k in ("id", "message_id", "platform_message_id") if m.get(k) not in (None, "")), str(seq))
            live = str(m.get("active", True)).strip().lower() not in ("0", "false", "no")
            role = m.get("role")
            at = m.get("timestamp", m.get("created_at"))
            yield {
                "path": path, "session_id": sid, "title": title, "turn_id": tid, "parent_turn_id": before, "role": role.strip() if isinstance(role, str) and role.strip() else "unknown", "content": text_of(m.get("content")),
                "occurred_at": seconds(at), "on_current_path": live, "seq": seq, "warning": None,
            }
            before = tid if live else before


def parse_sessions(files: DataFrame) -> DataFrame:
    """Turns of linear sessions in files(path, content): a turn's parent is the live turn before it; bad files and lines give a warning row."""
    kinds = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "bigint": pa.int64()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in TURN.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    if len(raw) > MAX_BYTES:
                        raise ValueError("larger than the limit")
                    rows += list(_turns(path, raw))
                except (ValueError, AttributeError, RecursionError) as e:
                    rows.append({"path": path, "warning": f"file: {e}"[:200]})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path", "content").mapInArrow(run, TURN)


def chat_exports(files: DataFrame) -> DataFrame:
    """(export_id, id, title, current_node, mapping, path, warning) of chat-tree files, as flatten_exports() takes them.

    A file holds one conversation, a list of them, or an object with `conversations`. A file that
    can't be read, or holds something else, is one row with a warning and no mapping.
    """
    schema = "path string, n bigint, id string, title string, current_node string, mapping string, warning string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    if len(raw) > MAX_BYTES:
                        raise ValueError("larger than the limit")
                    value = parse_strict(raw.decode("utf-8-sig"))
                    talks = value.get("conversations", [value]) if isinstance(value, dict) else value
                    if not isinstance(talks, list):
                        raise ValueError("no conversation, list of them or object with them")
                except (ValueError, RecursionError) as e:
                    rows.append({"path": path, "n": -1, "warning": f"file: {e}"[:200]})
                    continue
                for n, c in enumerate(t for t in talks if isinstance(t, dict) and isinstance(t.get("mapping"), dict)):
                    node = c.get("current_node")
                    rows.append({"path": path, "n": n, "id": str(c.get("id") or c.get("conversation_id") or content_id(c)), "title": str(c.get("title") or ""), "current_node": node if isinstance(node, str) else None, "mapping": json.dumps(c["mapping"], ensure_ascii=False)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(k, pa.int64() if k == "n" else pa.string()) for k in ("path", "n", "id", "title", "current_node", "mapping", "warning")]))

    return files.select("path", "content").mapInArrow(run, schema).select(F.xxhash64("path", "n").alias("export_id"), "id", "title", "current_node", "mapping", "path", "warning")

"""Structured Streaming twins: write quota by hour, and task arcs that close with their session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ARC = "session_id string, arc bigint, request string, n_turns bigint, outcome string, tools string"
_STATE = "arc bigint, request string, n_turns bigint, outcomes array<bigint>, tools array<string>"
#: Characters kept of a request, tools kept of an arc.
REQUEST_CHARS, MAX_TOOLS = 300, 8


def hourly_quota(events: DataFrame, limit: int, late: str = "1 hour", at: str = "ts", who: str = "user_id") -> DataFrame:
    """(hour, who, n, over_limit): writes by hour and writer; rows later than the watermark are left out."""
    stamped = events.withColumn("_at", F.col(at).cast("timestamp"))
    counted = stamped.withWatermark("_at", late).groupBy(F.window("_at", "1 hour").alias("w"), who).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("hour"), who, "n", (F.col("n") > limit).alias("over_limit"))


def counted(outcomes: list[int], outcome: str | None) -> list[int]:
    """Numbers of failures, successes, mixed and other known outcomes, with one more."""
    if not isinstance(outcome, str) or outcome in ("", "unknown"):
        return outcomes
    k = {"failure": 0, "success": 1, "mixed": 2}.get(outcome, 3)
    return [n + (i == k) for i, n in enumerate(outcomes)]


def prevailing(outcomes: list[int]) -> str:
    """Any failure wins, then success from half on, then mixed."""
    failure, success, mixed, _ = outcomes
    if not sum(outcomes):
        return "unknown"
    if failure:
        return "failure"
    if success * 2 >= sum(outcomes):
        return "success"
    return "mixed" if mixed else "unknown"


def is_request(role: str | None, content: str | None) -> bool:
    said = (content or "").strip()
    return role == "user" and len(said) > 12 and said[0] not in "/!?"


def _close(session: str, arc: tuple) -> tuple:
    number, request, n, outcomes, tools = arc
    return session, number, request, n, prevailing(outcomes), ",".join(tools)


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    closed, arc = [], tuple(state.get) if state.exists else None
    if arc:
        arc = (arc[0], arc[1], arc[2], list(arc[3]), list(arc[4]))
    if state.hasTimedOut:
        if arc and arc[2]:
            closed.append(_close(key[0], arc))
        state.remove()
    else:
        rows = pd.concat(list(frames)).sort_values(["ts", "turn_id"], kind="stable")
        for r in rows.itertuples(index=False):
            if r.role == "end":
                if arc and arc[2]:
                    closed.append(_close(key[0], arc))
                arc = (0, "", 0, [0] * 4, [])
                continue
            if arc is None:
                arc = (0, "", 0, [0] * 4, [])
            if is_request(r.role, r.content):
                if arc[2]:
                    closed.append(_close(key[0], arc))
                arc = (arc[0] + 1, r.content.strip()[:REQUEST_CHARS], 0, [0] * 4, [])
            arc = (arc[0], arc[1], arc[2] + 1, counted(arc[3], r.outcome), arc[4] + [r.tool] if isinstance(r.tool, str) and r.tool and r.tool not in arc[4] and len(arc[4]) < MAX_TOOLS else arc[4])
        state.update(arc)  # of bounded size: four counts, and the first MAX_TOOLS tools
        state.setTimeoutDuration(30 * 60 * 1000)
    yield pd.DataFrame(closed, columns=["session_id", "arc", "request", "n_turns", "outcome", "tools"])


def task_arcs(turns: DataFrame) -> DataFrame:
    """Arcs of a stream of turns(session_id, turn_id, ts, role, content, outcome, tool).

    A substantial user request opens an arc; the one before is given out then, or when a row with
    role 'end' or half an hour of silence closes the session.
    """
    return turns.groupBy("session_id").applyInPandasWithState(_advance, ARC, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)

"""Scalar rules of the memory model as column expressions; all stay inside Catalyst.

Time never comes from the clock: whoever needs an age passes `as_of`.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------
STOPWORDS = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "in", "on", "at", "of",
    "to", "for", "and", "or", "with", "from", "that", "this", "it", "its", "as", "by", "into",
]
NEGATIONS = [" no longer ", " not ", " never ", " doesn't ", " does not ", " won't ", " cannot ", " can't ", " stopped ", " isn't ", " aren't ", " wasn't ", " weren't ", " no "]
NEGATIONS_LOOSE = [" no longer ", " not ", " never ", " doesn't ", " does not ", " won't ", " cannot ", " can't ", " stopped ", "isn't ", "aren't ", "wasn't ", "weren't "]
REPLACEMENT_CUES = [" now ", " instead ", " replaced ", " moved to ", " switched to ", " from now on ", " currently ", " replaced by ", " no longer uses "]
SIGNAL_WEIGHTS = {
    "novel_object": 20, "user_asked": 30, "problem_discovered": 25, "decision_made": 20, "physical_action": 20,
    "unexpected_result": 35, "project_relevance": 25, "background_repeated": -30, "irrelevant_environmental": -40, "duplicate_observation": -30,
}
SOURCE_CONFIDENCE = {
    "user_explicit": 0.95, "document": 0.85, "tool_result": 0.80, "visual_observation": 0.70, "audio_observation": 0.65,
    "external_source": 0.60, "agent_inference": 0.45, "derived_pattern": 0.50, "agent_reported": 0.55,
}
SOURCE_PRIORITY = {
    "user_explicit": 0.30, "document": 0.15, "tool_result": 0.15, "visual_observation": 0.10, "audio_observation": 0.10,
    "external_source": 0.05, "agent_inference": 0.0, "derived_pattern": 0.05, "agent_reported": 0.08,
}
SECRETS = [
    ("private_key", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z0-9 ]*PRIVATE KEY-----"),
    ("openai_key", r"\bsk-[A-Za-z0-9_\-]{16,}\b"),
    ("github_pat", r"\bgithub_pat_[A-Za-z0-9_]{20,}\b"),
    ("github_token", r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{20,}\b"),
    ("aws_access_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("google_api_key", r"\bAIza[0-9A-Za-z_\-]{30,}\b"),
    ("slack_token", r"\bxox[baprs]-[A-Za-z0-9\-]{10,}\b"),
    ("jwt", r"\beyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\b"),
    ("bearer_token", r"(?i)\bbearer\s+[A-Za-z0-9\-._~+/]{20,}=*"),
    ("assigned_secret", r"(?i)\b(?:api[_-]?key|apikey|secret[_-]?key|secret|password|passwd|token|access[_-]?key)\b\s*[:=]\s*['\"]?([A-Za-z0-9\-._~+/]{12,})"),
]
ROLE_LABELS = ["system", "developer", "assistant", "user", "tool", "function", "instruction", "instructions"]
TRIVIAL = r"(?i)^(yes|no|ok|okay|sure|thanks|thank you|y|n|yep|nope|yeah|nah|hi|hey|hello|yo|sup|continue|go ahead|do it|proceed|got it|cool|nice|great|done|next|lgtm|k)[\s!?.:;,~]*$"
SENSITIVITIES = ["unclassified", "internal", "private", "restricted"]
OWNERS = ["primary", "owner"]
SKIPPED_CONTENT = ["thoughts", "reasoning_recap", "model_editable_context", "user_editable_context", "system_error", "tether_quote", "tether_browsing_display"]
TRUNCATED = "…[truncated]"
PROVISIONAL = "inference — treat as provisional until reinforced"
#: Marks of text that is no claim: tool calls and frames.
CONTROL = r'(?i)("(?:tool_calls|function_call|name|arguments)"\s*:)|(<\|tool_call\|>)|(<system>)|(</recalled_memory>)'
# ----------------------------------------------------------------------------------------------


def lookup(table: dict, key: Column, default=None) -> Column:
    """Value of a small fixed table, or the default."""
    found = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


def normal_claim(text: Column) -> Column:
    return collapsed(F.lower(text))


def strict_claim(text: Column) -> Column:
    return collapsed(F.regexp_replace(F.lower(text), r"[^a-z0-9'\s]+", " "))


def claim_words(text: Column) -> Column:
    """Distinct blank-separated words of the normal form."""
    return F.array_distinct(F.filter(F.split(normal_claim(text), " "), lambda w: w != ""))


def form_words(form: Column) -> Column:
    """Distinct content words of a claim in strict form."""
    return F.array_except(F.regexp_extract_all(form, F.lit(r"[a-z0-9']+"), F.lit(0)), F.array(*map(F.lit, STOPWORDS)))


def content_words(text: Column) -> Column:
    """Distinct content words of the strict form."""
    return form_words(strict_claim(text))


def overlap(a: Column, b: Column) -> Column:
    """Shared over larger, of distinct-word arrays; 0 if either is empty."""
    larger = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / larger).otherwise(F.lit(0.0))


def has_cue(form: Column, cues: list[str]) -> Column:
    """Whether any of the cues stands in the form between blanks; one pass over the text."""
    return F.concat(F.lit(" "), form, F.lit(" ")).rlike("|".join(map(re.escape, cues)))


def negated(text: Column, loose: bool = False) -> Column:
    return has_cue(normal_claim(text), NEGATIONS_LOOSE) if loose else has_cue(strict_claim(text), NEGATIONS)


def replaces(text: Column) -> Column:
    return has_cue(strict_claim(text), REPLACEMENT_CUES)


def redact(text: Column) -> Column:
    for kind, pattern in SECRETS:
        text = F.regexp_replace(text, pattern, f"[REDACTED:{kind}]")
    return text


def truncate(text: Column, limit: int, marker: str = TRUNCATED) -> Column:
    keep = max(0, limit - len(marker))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, keep), F.lit(marker))).otherwise(text)


def neutralize(text: Column) -> Column:
    """Readable text that can't pose as markup, as a header or as another speaker."""
    one = collapsed(F.coalesce(text, F.lit("")))
    one = F.replace(F.replace(one, F.lit("<"), F.lit("\\u003c")), F.lit(">"), F.lit("\\u003e"))
    one = F.regexp_replace(one, r"^\[([^\]]{0,159})\]", r"\\u005b$1\\u005d")
    return F.regexp_replace(one, r"^(?i)(" + "|".join(ROLE_LABELS) + "):", r"\\$1:")


def fingerprint(*texts: Column) -> Column:
    return F.substring(normal_claim(F.concat_ws(" ", *texts)), 1, 400)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(4)).cast("long")


def age_days(ts: Column, as_of: str) -> Column:
    micros = F.timestamp_diff("MICROSECOND", ts, F.lit(as_of).cast("timestamp_ntz"))
    return F.greatest(F.lit(0.0), micros / F.lit(86_400_000_000.0))


def recency(ts: Column, as_of: str, half_life: float = 45.0) -> Column:
    return F.coalesce(F.exp(F.lit(-math.log(2)) * age_days(ts, as_of) / F.lit(half_life)), F.lit(0.5))


def or_half(x: Column) -> Column:
    """A missing or zero score counts as one half."""
    return F.when(x.isNull() | (x == 0) | F.isnan(x), F.lit(0.5)).otherwise(x)


def term_hits(text: Column, terms: list[str]) -> Column:
    kept = sorted({t.lower() for t in terms if len(t) > 2})
    return F.size(F.filter(F.array(*map(F.lit, kept)).cast("array<string>"), lambda t: F.contains(F.lower(text), t)))


def relevance(vector: Column, keyword: Column, hits: Column, use_bm25: bool = False) -> Column:
    """use_bm25 turns the keyword score, which is negative where better, to count in favour."""
    kw = (-keyword if use_bm25 else keyword) / F.lit(10.0)
    return F.greatest(F.coalesce(vector, F.lit(0.0)), F.coalesce(kw, F.lit(0.0)), hits * F.lit(0.12))


def rank_score(importance: Column, recent: Column, relevant: Column, hits: Column, confidence: Column, reinforced: Column) -> Column:
    factor = F.lit(1.0) + F.lit(0.05) * F.least(F.lit(10), F.coalesce(reinforced, F.lit(0)))
    bonus = F.when(hits > 0, 0.13).otherwise(0.0)
    return (F.lit(0.30) * or_half(importance) + F.lit(0.22) * recent + F.lit(0.22) * relevant + bonus + F.lit(0.13) * or_half(confidence)) * factor


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for different lengths or a zero norm."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def base_importance(signals: Column, scale: float = 1.0) -> Column:
    total = F.aggregate(signals, F.lit(0.0), lambda s, x: s + lookup(SIGNAL_WEIGHTS, x, 0).cast("double") * F.lit(scale))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(0.35) + total))


def tier(importance: Column) -> Column:
    return F.when(importance >= 0.70, "high").when(importance >= 0.35, "medium").otherwise("low")


def decayed(importance: Column, age: Column) -> Column:
    """One decay step: not above .70, not within a day of the last one, never under .05."""
    new = F.greatest(F.lit(0.05), importance * F.when(importance >= 0.35, 0.85).otherwise(0.70))
    return F.when((importance < 0.70) & (age >= 1.0) & (new < importance), new).otherwise(importance)


def reinforced(confidence: Column, delta: float) -> Column:
    return F.least(F.lit(0.98), confidence + F.lit(delta))


def source_class(value: Column) -> Column:
    """Lower case, words joined by underscores; null if empty."""
    return F.nullif(F.regexp_replace(F.trim(F.lower(value)), r"[\s-]+", "_"), F.lit(""))


def actor(value: Column) -> Column:
    """Nothing given: the primary actor; blank: an untrusted one; else trimmed."""
    return F.when(value.isNull() | (value == ""), "primary").when(F.trim(value) == "", "untrusted").otherwise(F.trim(value))


def sensitivity(value: Column) -> Column:
    plain = F.trim(F.lower(F.coalesce(value, F.lit(""))))
    return F.when(plain.isin(*SENSITIVITIES), plain).otherwise("unclassified")


def read_refusal(row_actor: Column, quarantined: Column, level: Column, caller: str, owner: bool, review: bool = False) -> Column:
    """Why a caller may not read a row, or ''. Rules in order: label clash, quarantine, other actor, sensitivity."""
    mine, hidden = actor(row_actor), F.coalesce(quarantined, F.lit(False))
    rules = []
    if not owner and caller in OWNERS:
        rules.append((mine.isin(*OWNERS), "other-actor"))
    if not review:
        rules.append((hidden, "quarantined"))
    elif not owner:
        rules.append((hidden & (mine != caller), "quarantined-other-actor"))
    if not owner:
        rules += [(mine != caller, "other-actor"), (sensitivity(level) != "unclassified", "sensitivity")]
    out = F.lit("")
    for test, reason in reversed(rules):
        out = F.when(test, reason).otherwise(out)
    return out


def protection(verified: Column, claimed: Column, quarantined: Column, confidence: Column) -> Column:
    attested = F.coalesce(F.nullif(verified, F.lit("")), claimed, F.lit("")) == "user_explicit"
    sure = ~F.coalesce(quarantined, F.lit(False)) & (F.coalesce(F.nanvl(confidence, F.lit(0.0)), F.lit(0.0)) >= 0.90)
    return F.when(attested, "attested").when(sure, "high-confidence").otherwise("")


def verdict(klass: Column, confidence: Column) -> Column:
    return (
        F.when(klass.isin("user_explicit", "document", "tool_result") & (confidence >= 0.8), "well-evidenced")
        .when((klass == "derived_pattern") & (confidence >= 0.7), "pattern-derived, verified")
        .when(klass == "agent_inference", PROVISIONAL)
        .otherwise("moderate")
    )


def is_trivial(text: Column) -> Column:
    plain = collapsed(F.coalesce(text, F.lit("")))
    return (plain == "") | plain.startswith("/") | plain.rlike(TRIVIAL)


def control_marks(*tools: str) -> str:
    """CONTROL, and calls of the tools named."""
    return CONTROL + (r"|((?:" + "|".join(tools) + r")\s*\()" if tools else "")

"""Who writes, how far that is believed, and what it may do, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemospark.functions import memory as m

# --- fixed values -----------------------------------------------------------------------------
#: Channel: identity and provenance of what comes through it. Anything else is an untrusted, external caller.
CHANNELS = {
    "local": ("owner", "user"),
    "cli": ("owner", "user"),
    "agent_tool": ("owner", "agent"),
    "import": ("owner", "agent"),
    "consolidation": ("system", "agent_consolidation"),
}
CAPABILITIES = ["read", "write_candidate", "approve", "correct", "forget", "purge"]
PROVENANCES = ["user", "agent", "agent_consolidation", "external"]
IDENTITIES = ["owner", "system", "untrusted"]
KINDS = ["fact", "belief", "hypothesis", "procedural_belief"]
WITHHELD = "excluded items are not enumerated for this caller"
# ----------------------------------------------------------------------------------------------


def _plain(x: Column) -> Column:
    return F.trim(F.lower(F.coalesce(x, F.lit(""))))


def identity_of(channel: Column) -> Column:
    """No channel is code inside the owner's own process."""
    plain = _plain(channel)
    return F.when(plain == "", "owner").otherwise(m.lookup({c: i for c, (i, _) in CHANNELS.items()}, plain, "untrusted"))


def provenance_of(channel: Column) -> Column:
    plain = _plain(channel)
    return F.when(plain == "", "user").otherwise(m.lookup({c: p for c, (_, p) in CHANNELS.items()}, plain, "external"))


def resolved_provenance(given: Column, identity: Column) -> Column:
    """What is declared, if it is known; nothing declared goes by identity."""
    plain = _plain(given)
    usual = F.when(identity.isNull() | (_plain(identity) == "owner"), "user").when(_plain(identity) == "system", "agent_consolidation").otherwise("external")
    return F.when(plain == "", usual).when(plain.isin(*PROVENANCES), plain).otherwise("external")


def bound_actor(label: Column, identity: Column) -> Column:
    """The actor of a write; an untrusted caller can't carry an owner's label."""
    plain = m.actor(label)
    return F.when((identity == "untrusted") & plain.isin(*m.OWNERS), "untrusted").otherwise(plain)


def verified_class(claimed: Column, provenance: Column) -> Column:
    """The source class that is believed: only a user's own channel may name it."""
    known = F.when(claimed.isin(*m.SOURCE_CONFIDENCE), claimed).otherwise("agent_inference")
    return F.when(provenance == "external", "external_source").when(provenance == "agent", "agent_reported").when(provenance == "agent_consolidation", "derived_pattern").otherwise(known)


def bounded_confidence(given: Column, klass: Column, provenance: Column) -> Column:
    """An agent's or outsider's confidence is capped by that of its class, which is also the default."""
    usual, said = m.lookup(m.SOURCE_CONFIDENCE, klass, 0.5), F.nanvl(given, F.lit(None).cast("double"))
    return F.when(provenance.isin("agent", "external"), F.least(F.coalesce(said, usual), usual)).otherwise(F.coalesce(said, usual))


def write_quarantine(requested: Column, identity: Column) -> Column:
    return F.coalesce(requested, F.lit(False)) | ~identity.isin("owner", "system")


def may(capability: Column, provenance: Column, identity: Column, protected: Column) -> Column:
    """Whether a channel may do something; a protected target is changed by a user only."""
    user, owner, system = provenance == "user", identity == "owner", provenance == "agent_consolidation"
    change = F.when(protected, user).otherwise(provenance.isin("user", "agent", "agent_consolidation") & (owner | system))
    return (
        F.when(capability == "read", owner | (provenance == "external"))
        .when(capability == "write_candidate", F.lit(True))
        .when(capability == "approve", user)
        .when(capability.isin("correct", "forget"), change)
        .when(capability == "purge", user & owner)
        .otherwise(F.lit(False))
    )


def contest_score(confidence: Column, klass: Column) -> Column:
    return F.coalesce(F.nanvl(confidence, F.lit(0.0)), F.lit(0.0)) + m.lookup(m.SOURCE_PRIORITY, klass, 0.0)


def field_signals(outcome: Column, request: Column, problem: Column, decisions: Column, actions: Column, project: Column) -> Column:
    """Names of the signals that an episode's fields give, in a fixed order."""
    said = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    tests = [(F.coalesce(outcome == "unexpected", F.lit(False)), "unexpected_result"), (said(request), "user_asked"), (given(problem), "problem_discovered"), (said(decisions), "decision_made"), (said(actions), "physical_action"), (given(project), "project_relevance")]
    return F.array_compact(F.array(*[F.when(t, name) for t, name in tests]))


def fallback_importance(outcome: Column, request: Column, project: Column) -> Column:
    add = lambda test, x: F.when(test, x).otherwise(0.0)
    return F.least(F.lit(1.0), F.lit(0.35) + add(outcome == "unexpected", 0.35) + add(F.trim(F.coalesce(request, F.lit(""))) != "", 0.30) + add(F.coalesce(project, F.lit("")) != "", 0.25))

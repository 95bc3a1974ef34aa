"""Membership, access-control and trust predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_TEAM = "__no_team__"
# Trust from low to high.
TRUST_ORDER = ("REJECTED", "AMBIGUOUS", "INFERRED_LOW", "INFERRED_HIGH", "EXTRACTED")
# Weight of a kind of source by intent, in the order of KINDS.
KINDS = ("code", "doc", "adr", "pr", "card", "other")
INTENT_WEIGHTS = {
    "how_does_x_work": (1.5, 1.0, 0.9, 0.8, 0.7, 1.0),
    "why_was_x_changed": (0.9, 1.0, 1.4, 1.5, 1.5, 1.0),
    "who_owns_x": (1.1, 0.9, 1.0, 1.5, 1.3, 1.0),
    "what_calls_x": (1.4, 0.9, 0.9, 0.9, 0.8, 1.0),
}


def member(seq: int, valid_from: str = "valid_from_seq", invalidated: str = "invalidated_at_seq") -> Column:
    """Whether a row's interval holds version ``seq``."""
    return (F.col(valid_from) <= seq) & (F.col(invalidated).isNull() | (F.col(invalidated) > seq))


def visible(acl: Column, teams: list[str]) -> Column:
    """An empty list is public; else a team must be shared."""
    return (F.size(acl) == 0) | F.arrays_overlap(acl, F.array(*map(F.lit, teams)) if teams else F.array().cast("array<string>"))


def strictest(lists: Column) -> Column:
    """Intersection of all non-empty lists; only empty ones: public; nothing shared, or no list at all: nobody."""
    tight = F.filter(lists, lambda a: F.size(a) > 0)
    shared = F.aggregate(tight, F.element_at(tight, 1), lambda a, x: F.array_intersect(a, x))
    none = F.array().cast("array<string>")
    return F.when(F.size(lists) <= 0, F.array(F.lit(NO_TEAM))).when(F.size(tight) == 0, none).when(F.size(shared) == 0, F.array(F.lit(NO_TEAM))).otherwise(F.array_sort(shared))


def trust_rank(trust: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, t in enumerate(TRUST_ORDER):
        out = F.when(trust == t, F.lit(i)).otherwise(out)
    return out


def trust_admits(trust: Column, floor: str, include_inferred: bool) -> Column:
    """EXTRACTED always; INFERRED only if asked for, and then from the floor on (EXTRACTED as floor holds none back)."""
    least = TRUST_ORDER.index("INFERRED_LOW" if floor == "EXTRACTED" else floor)
    inferred = trust.isin("INFERRED_LOW", "INFERRED_HIGH") & F.lit(include_inferred) & (trust_rank(trust) >= least)
    return F.coalesce((trust == "EXTRACTED") | inferred, F.lit(False))


def source_kind(source_type: Column, artifact_type: Column) -> Column:
    """code, adr, card, pr, doc or other: the artifact's own type first where it is code, then in fixed order."""
    s, a = F.lower(F.coalesce(source_type, F.lit(""))), F.lower(artifact_type)
    return (
        F.when(artifact_type.isin("code_file", "code_symbol", "endpoint", "test") | (s == "github_code"), "code")
        .when(a.isin("adr", "decision"), "adr")
        .when((s == "ado_card") | a.isin("card", "work_item"), "card")
        .when((s == "git_metadata") | a.isin("commit", "pull_request", "pr"), "pr")
        .when(s.isin("github_doc", "azure_wiki") | a.isin("doc_chunk", "chunk", "summary", "concept", "doc"), "doc")
        .otherwise("other")
    )


def temporal_weight(intent: Column, kind: Column, superseded: Column, stale: Column) -> Column:
    """Weight of the kind under the intent, 0.6 of it when superseded, 0.25 of it when stale."""
    w = F.lit(1.0)
    for i, weights in INTENT_WEIGHTS.items():
        for k, x in zip(KINDS, weights, strict=True):
            w = F.when((intent == i) & (kind == k), F.lit(x)).otherwise(w)
    return w * F.when(superseded, 0.6).otherwise(1.0) * F.when(stale, 0.25).otherwise(1.0)

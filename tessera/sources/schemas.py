"""Declared schemas of the registry tables, and the contract that their rows keep.

A table is read with its declared columns and types, never inferred.  ``split_rows`` parts a table into the rows that keep the
contract and a table of rejected ones with their reasons: a key that is null or repeated, a value outside a closed vocabulary,
an interval that ends before it begins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

# Closed vocabularies.
EDGE_TYPES = ("calls", "imports", "tests", "defined_in", "exposed_as", "documents", "mentions", "implements", "requests", "alias_of", "uses", "references", "inherits", "related_to")
TRUST = ("REJECTED", "AMBIGUOUS", "INFERRED_LOW", "INFERRED_HIGH", "EXTRACTED")
STATUSES = ("reused", "approved", "denied", "needs_human_approval", "error")
BUILD_STATES = ("building", "active", "superseded", "validation_failed")
ARTIFACT_TYPES = ("code_file", "code_symbol", "endpoint", "test", "summary", "chunk", "concept", "source_backed_fact", "commit", "alias_reference")
INTENTS = ("how_does_x_work", "why_was_x_changed", "who_owns_x", "what_calls_x")

_S, _L, _B, _D, _T, _A = StringType(), LongType(), BooleanType(), DoubleType(), TimestampType(), ArrayType(StringType())


@dataclass(frozen=True)
class Contract:
    """Columns with their types, the key, vocabularies by column, and pairs of columns (begin, end) of intervals."""

    columns: dict[str, DataType]
    key: tuple[str, ...]
    words: dict[str, tuple[str, ...]] = field(default_factory=dict)
    intervals: tuple[tuple[str, str], ...] = ()

    @property
    def schema(self) -> StructType:
        return StructType([StructField(n, t) for n, t in self.columns.items()])


_EDGE = {"from_artifact_id": _S, "to_artifact_id": _S, "edge_type": _S}
_EDGE_WORDS = {"edge_type": EDGE_TYPES, "trust_class": TRUST}
_VALID = {"valid_from_seq": _L, "invalidated_at_seq": _L}
TABLES = {
    "source_item": Contract({"source_id": _S, "source_type": _S, "source_uri": _S, "repo": _S, "path": _S, "external_id": _S, "content_hash": _S, "acl_teams": _A, "is_deleted": _B, "last_seen_min": _L}, ("source_type", "source_uri")),
    "knowledge_artifact": Contract(
        {"artifact_id": _S, "source_id": _S, "artifact_type": _S, "title": _S, "body_text": _S, "search_text": _S, "knowledge_kind": _S, "authority_score": _D, "centrality_score": _D, **_VALID},
        ("artifact_id",), {"artifact_type": ARTIFACT_TYPES, "knowledge_kind": ("source_backed", "interpreted")}, (("valid_from_seq", "invalidated_at_seq"),),
    ),
    "doc_edge": Contract({**_EDGE, "source": _S, "trust_class": _S, "evidence": _S, **_VALID}, tuple(_EDGE), _EDGE_WORDS, (("valid_from_seq", "invalidated_at_seq"),)),
    "code_edge": Contract({**_EDGE, "trust_class": _S}, (*_EDGE, "trust_class"), _EDGE_WORDS),
    "knowledge_edge": Contract({**_EDGE, "trust_class": _S}, (*_EDGE, "trust_class"), _EDGE_WORDS),
    "retrieval_event": Contract(
        {"retrieval_id": _S, "created_at": _T, "run_id": _S, "agent_name": _S, "tool_name": _S, "status": _S, "query_text": _S, "returned_artifact_ids": _A, "cache_hit": _B, "semantic_reuse": _B, "tokens_returned": _L, "reused_evidence_ids": _A, "new_evidence_ids": _A},
        ("retrieval_id",), {"status": STATUSES},
    ),
    "trace_span": Contract({"span_id": _S, "trace_id": _S, "parent_span_id": _S, "name": _S, "started_at": _T, "duration_ms": _L, "status": _S}, ("span_id",), {"status": ("ok", "error")}),
    "kb_build_run": Contract(
        {"kb_version": _S, "build_seq": _L, "started_at": _T, "completed_at": _T, "sources_seen": _L, "sources_changed": _L, "model_calls": _L, "embedding_calls": _L, "ledger_mining_mined": _L, "ledger_mining_unresolved": _L, "failed_gate": _S, "status": _S},
        ("build_seq",), {"status": BUILD_STATES}, (("started_at", "completed_at"),),
    ),
    "linkable": Contract({"artifact_id": _S, "artifact_type": _S, "title": _S, "body_text": _S, "source_type": _S, "external_id": _S, "path": _S, "branch": _S, "repo": _S}, ("artifact_id",), {"artifact_type": ARTIFACT_TYPES}),
    "search_query": Contract({"query_id": _L, "query_text": _S, "intent": _S}, ("query_id",), {"intent": INTENTS}),
}


def conformed(df: DataFrame, name: str) -> DataFrame:
    """The table's declared columns, in order; a column that lacks or has another type is an error before any row is read."""
    found = {f.name: f.dataType for f in df.schema}
    wrong = [f"{n}: {found[n].simpleString() if n in found else 'missing'} for {t.simpleString()}" for n, t in TABLES[name].columns.items() if n not in found or found[n].simpleString() != t.simpleString()]
    if wrong:
        raise TypeError(f"{name} doesn't keep its schema: {'; '.join(wrong)}")
    return df.select(*TABLES[name].columns)


def read_registry(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All registry tables that lie as Parquet in a folder, each read with its declared schema."""
    return {name: spark.read.schema(c.schema).parquet(f"{folder}/{name}.parquet") for name, c in TABLES.items()}


def reason(name: str) -> Column:
    """Why a row alone breaks the contract; null where it doesn't."""
    c = TABLES[name]
    found = F.when(F.greatest(F.lit(False), *(F.col(k).isNull() for k in c.key)), "null_key")
    for column, words in c.words.items():
        found = found.when(F.col(column).isNotNull() & ~F.col(column).isin(*words), f"unknown_{column}")
    for begin, end in c.intervals:
        found = found.when(F.col(end) < F.col(begin), f"{end}_before_{begin}")
    return found


def split_rows(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows that keep the contract, rejected rows with ``reason``).

    Of rows with equal keys the first stays, in order of all their columns; the others are rejected as repeated.
    """
    c = TABLES[name]
    told = conformed(df, name).withColumn("reason", reason(name))
    # Rows without a key can't be repeated: they are dealt by all they hold.
    w = Window.partitionBy(*c.key, F.when(F.col("reason").isNotNull(), F.xxhash64(*c.columns))).orderBy(*c.columns)
    told = told.withColumn("reason", F.coalesce("reason", F.when(F.row_number().over(w) > 1, "repeated_key")))
    return told.where("reason IS NULL").drop("reason"), told.where("reason IS NOT NULL")

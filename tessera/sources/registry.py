"""Registry tables as pure projections of the star-schema and document tables.

Each projection is one SQL text for Spark and DuckDB; ``{MARKS}`` stand where the dialects differ.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import conformed
from .written import written

_MARKS = {
    "spark": {
        "SHA": "sha2(text, 256)", "A1": "array('team_a')", "A2": "array('team_a','team_b')", "A3": "array('team_b')", "A0": "CAST(array() AS ARRAY<STRING>)",
        "IDS": "CASE WHEN k % 4 = 0 THEN CAST(array() AS ARRAY<STRING>) ELSE transform(sequence(k, k + k % 4 - 1), x -> CAST(x AS STRING)) END",
        "MS": "CAST(FLOOR(value) AS BIGINT)", "K": "array(CAST(k AS STRING))", "DIV": "div", "H1": "sha2(", "H2": ", 256)", "NL": "chr(10)",
        "NEAR": "explode(array(doc_id div 40, doc_id div 40 + 1))",
    },
    "duckdb": {
        "SHA": "sha256(text)", "A1": "['team_a']", "A2": "['team_a','team_b']", "A3": "['team_b']", "A0": "CAST([] AS VARCHAR[])",
        "IDS": "CASE WHEN k % 4 = 0 THEN CAST([] AS VARCHAR[]) ELSE list_transform(range(k, k + k % 4), lambda x: CAST(x AS VARCHAR)) END",
        "MS": "CAST(FLOOR(value) AS BIGINT)", "K": "[CAST(k AS VARCHAR)]", "DIV": "//", "H1": "sha256(", "H2": ")", "NL": "chr(10)", "NEAR": "unnest([doc_id // 40, doc_id // 40 + 1])",
    },
}

#: name -> (tables that it reads, text)
_TEXTS = {
    "source_item": (("documents",), """SELECT CAST(doc_id AS STRING) AS source_id,
 CASE doc_id % 7 WHEN 0 THEN 'github_code' WHEN 1 THEN 'github_code' WHEN 3 THEN 'azure_wiki' WHEN 4 THEN 'ado_card' WHEN 5 THEN 'git_metadata' ELSE 'github_doc' END AS source_type,
 'github://org/' || source || '/docs/' || lang || '/item-' || CAST(doc_id AS STRING) || '.md' AS source_uri,
 source AS repo, 'docs/' || lang || '/item-' || CAST(doc_id AS STRING) || '.md' AS path,
 CASE WHEN doc_id % 7 = 4 THEN 'AB#' || CAST(doc_id AS STRING) END AS external_id, {SHA} AS content_hash,
 CASE doc_id % 6 WHEN 0 THEN {A1} WHEN 1 THEN {A2} WHEN 2 THEN {A3} ELSE {A0} END AS acl_teams,
 doc_id % 29 = 0 AS is_deleted, doc_id AS last_seen_min FROM {documents}"""),
    "knowledge_artifact": (("documents",), """SELECT CAST(doc_id AS STRING) AS artifact_id, CAST(doc_id AS STRING) AS source_id,
 CASE doc_id % 7 WHEN 0 THEN 'code_symbol' WHEN 1 THEN 'code_file' WHEN 3 THEN 'source_backed_fact' WHEN 5 THEN 'commit' WHEN 6 THEN 'concept' ELSE 'summary' END AS artifact_type,
 NULLIF(regexp_extract(text, '[^ ]+ [^ ]+', 0), '') AS title, text AS body_text,
 CASE WHEN doc_id % 7 IN (0, 1) THEN source || ' ' || lang END AS search_text,
 CASE WHEN doc_id % 7 IN (2, 4, 6) THEN 'interpreted' ELSE 'source_backed' END AS knowledge_kind,
 CAST(CASE doc_id % 7 WHEN 3 THEN 0.8 WHEN 6 THEN 0.6 WHEN 2 THEN 0.5 WHEN 4 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS authority_score,
 CAST(doc_id % 11 AS DOUBLE) / 10 AS centrality_score, doc_id % 5 AS valid_from_seq,
 CASE WHEN doc_id % 13 = 0 THEN doc_id % 5 + 2 END AS invalidated_at_seq FROM {documents}"""),
    "doc_edge": (("documents",), """SELECT CAST(a.doc_id AS STRING) AS from_artifact_id, CAST(b.doc_id AS STRING) AS to_artifact_id,
 CASE a.doc_id % 4 WHEN 0 THEN 'mentions' WHEN 1 THEN 'documents' WHEN 2 THEN 'implements' ELSE 'related_to' END AS edge_type,
 CASE WHEN a.doc_id % 3 = 0 THEN 'linker' ELSE 'llm_judge' END AS source,
 CASE WHEN a.doc_id % 3 = 0 THEN 'EXTRACTED' WHEN a.doc_id % 3 = 1 THEN 'INFERRED_HIGH' ELSE 'AMBIGUOUS' END AS trust_class,
 CASE WHEN a.doc_id % 8 <> 0 THEN 'ref-' || CAST(b.doc_id AS STRING) END AS evidence,
 CASE WHEN a.doc_id % 5 > b.doc_id % 5 THEN a.doc_id % 5 ELSE b.doc_id % 5 END AS valid_from_seq,
 CAST(NULL AS BIGINT) AS invalidated_at_seq
 FROM (SELECT *, {NEAR} AS near FROM {documents}) a JOIN {documents} b ON a.source = b.source AND b.doc_id {DIV} 40 = a.near AND b.doc_id > a.doc_id AND b.doc_id <= a.doc_id + 40"""),
    "code_edge": (("documents",), """SELECT DISTINCT CAST(a.doc_id AS STRING) AS from_artifact_id, CAST(b.doc_id AS STRING) AS to_artifact_id,
 CASE WHEN a.doc_id % 7 = 0 AND b.doc_id = a.doc_id + 1 THEN 'defined_in' WHEN a.doc_id % 7 = 1 AND b.doc_id % 7 = 1 THEN 'imports' WHEN (a.doc_id + b.doc_id) % 5 = 0 THEN 'tests' ELSE 'calls' END AS edge_type,
 CASE WHEN (a.doc_id + b.doc_id) % 9 = 0 THEN 'INFERRED_HIGH' ELSE 'EXTRACTED' END AS trust_class
 FROM (SELECT *, {NEAR} AS near FROM {documents}) a JOIN {documents} b ON b.doc_id {DIV} 40 = a.near AND b.doc_id > a.doc_id AND b.doc_id <= a.doc_id + 40
 WHERE a.doc_id % 7 IN (0, 1) AND b.doc_id % 7 IN (0, 1)"""),
    "knowledge_edge": (("orders", "lineitem"), """SELECT DISTINCT 'c' || CAST(o_custkey AS STRING) AS from_artifact_id, 's' || CAST(l_suppkey AS STRING) AS to_artifact_id,
 CASE l_linenumber % 4 WHEN 0 THEN 'calls' WHEN 1 THEN 'imports' WHEN 2 THEN 'tests' ELSE 'defined_in' END AS edge_type,
 CASE l_returnflag WHEN 'R' THEN 'EXTRACTED' WHEN 'A' THEN 'INFERRED_HIGH' ELSE 'INFERRED_LOW' END AS trust_class
 FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey
 UNION SELECT DISTINCT 's' || CAST(l_suppkey AS STRING), 'p' || CAST(l_partkey AS STRING),
 CASE l_linenumber % 4 WHEN 0 THEN 'calls' WHEN 1 THEN 'imports' WHEN 2 THEN 'tests' ELSE 'defined_in' END,
 CASE l_returnflag WHEN 'R' THEN 'EXTRACTED' WHEN 'A' THEN 'INFERRED_HIGH' ELSE 'AMBIGUOUS' END FROM {lineitem}"""),
    "retrieval_event": (("events",), """SELECT CAST(event_id AS STRING) AS retrieval_id, CAST(ts AS TIMESTAMP) AS created_at,
 CASE WHEN user_id % 10 = 0 THEN '-' ELSE 'run_' || CAST(user_id AS STRING) || '_' || CAST(CAST(ts AS DATE) AS STRING) END AS run_id,
 'agent_' || CAST(user_id % 12 AS STRING) AS agent_name,
 CASE event_id % 4 WHEN 0 THEN 'kb_search' WHEN 1 THEN 'context.request_more' WHEN 2 THEN 'context.open_evidence' ELSE 'context.create_pack' END AS tool_name,
 CASE event_type WHEN 'purchase' THEN 'reused' WHEN 'signup' THEN 'denied' WHEN 'error' THEN 'error' ELSE 'approved' END AS status,
 'Find the ' || event_type || ' item #' || CAST(k AS STRING) AS query_text, {IDS} AS returned_artifact_ids,
 k < 20 AS cache_hit, (event_type = 'purchase' AND k % 3 = 0) AS semantic_reuse,
 CASE WHEN event_type IN ('view', 'click') THEN {MS} ELSE 0 END AS tokens_returned,
 CASE WHEN event_type = 'purchase' THEN {IDS} ELSE {A0} END AS reused_evidence_ids,
 CASE WHEN event_id % 4 = 2 AND k % 3 > 0 THEN {K} ELSE {A0} END AS new_evidence_ids
 FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM {events})"""),
    "trace_span": (("events",), """SELECT CAST(event_id AS STRING) AS span_id, CAST(user_id AS STRING) || '/' || CAST(CAST(ts AS DATE) AS STRING) AS trace_id,
 CASE WHEN rn > 1 THEN CAST(root AS STRING) END AS parent_span_id, event_type AS name, CAST(ts AS TIMESTAMP) AS started_at,
 {MS} AS duration_ms, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status
 FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn,
 first_value(event_id) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS root FROM {events})"""),
    "kb_build_run": (("events",), """SELECT 'local.' || CAST(day AS STRING) AS kb_version, CAST(row_number() OVER (ORDER BY day) AS BIGINT) AS build_seq,
 first_ts AS started_at, last_ts AS completed_at, clicks AS sources_seen, views AS sources_changed, signups AS model_calls, errors AS embedding_calls,
 purchases AS ledger_mining_mined, purchases % 5 AS ledger_mining_unresolved, CASE WHEN errors > 70 THEN 'index_drift' END AS failed_gate,
 CASE WHEN errors > 70 THEN 'validation_failed' WHEN day = max(day) OVER () THEN 'active' ELSE 'superseded' END AS status
 FROM (SELECT CAST(ts AS DATE) AS day, CAST(min(ts) AS TIMESTAMP) AS first_ts, CAST(max(ts) AS TIMESTAMP) AS last_ts,
 count(CASE WHEN event_type = 'click' THEN 1 END) AS clicks, count(CASE WHEN event_type = 'view' THEN 1 END) AS views,
 count(CASE WHEN event_type = 'signup' THEN 1 END) AS signups, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors,
 count(CASE WHEN event_type = 'purchase' THEN 1 END) AS purchases FROM {events} GROUP BY CAST(ts AS DATE))"""),
    "linkable": (("documents",), """SELECT CAST(doc_id AS STRING) AS artifact_id,
 CASE doc_id % 7 WHEN 0 THEN 'code_symbol' WHEN 1 THEN 'code_file' WHEN 3 THEN 'source_backed_fact' WHEN 5 THEN 'commit' WHEN 6 THEN 'concept' ELSE 'summary' END AS artifact_type,
 CASE doc_id % 7 WHEN 0 THEN 'handle_' || CAST(doc_id AS STRING) WHEN 1 THEN 'src/m' || CAST(doc_id % 10 AS STRING) || '/file_' || CAST(doc_id AS STRING) || '.py'
 WHEN 4 THEN 'Card ' || CAST(doc_id AS STRING) ELSE NULLIF(regexp_extract(text, '[^ ]+ [^ ]+', 0), '') END AS title,
 CASE WHEN doc_id % 7 = 5 THEN 'feat(' || source || '): ' || regexp_extract(text, '^[^ ]+( [^ ]+)?( [^ ]+)?( [^ ]+)?', 0) || {NL} || {NL} || 'closes AB#' || CAST(doc_id - 1 AS STRING) || ', reverts ' || substr({H1}CAST(doc_id - 7 AS STRING){H2}, 1, 12)
 || {NL} || {NL} || '--- changed files ---' || {NL} || 'src/m' || CAST((doc_id - 4) % 10 AS STRING) || '/file_' || CAST(doc_id - 4 AS STRING) || '.py' || {NL} || 'docs/' || CAST(doc_id AS STRING) || '-payment-retry-guide.md'
 WHEN doc_id % 7 = 6 THEN text || ' uses handle_' || CAST(doc_id - 6 AS STRING) WHEN doc_id % 7 IN (2, 3, 4) THEN text || ' see AB#' || CAST(doc_id + 7 AS STRING) || ' and handle_' || CAST(doc_id - doc_id % 7 AS STRING) || ' in src/m' || CAST((doc_id - doc_id % 7 + 1) % 10 AS STRING) || '/file_' || CAST(doc_id - doc_id % 7 + 1 AS STRING) || '.py'
 ELSE text END AS body_text,
 CASE doc_id % 7 WHEN 0 THEN 'github_code' WHEN 1 THEN 'github_code' WHEN 3 THEN 'azure_wiki' WHEN 4 THEN 'ado_card' WHEN 5 THEN 'git_metadata' ELSE 'github_doc' END AS source_type,
 CASE doc_id % 7 WHEN 4 THEN 'AB#' || CAST(doc_id AS STRING) WHEN 5 THEN substr({H1}CAST(doc_id AS STRING){H2}, 1, 40) END AS external_id,
 CASE WHEN doc_id % 7 IN (0, 1) THEN 'src/m' || CAST(doc_id % 10 AS STRING) || '/file_' || CAST(doc_id - doc_id % 7 + 1 AS STRING) || '.py' WHEN doc_id % 7 = 2 THEN 'src/m' || CAST(doc_id % 10 AS STRING) || '/guide_' || CAST(doc_id AS STRING) || '.md' END AS path,
 CASE WHEN doc_id % 7 = 5 AND doc_id % 2 = 0 THEN 'fix/' || CAST(doc_id - 8 AS STRING) || '-x' END AS branch, source AS repo FROM {documents}"""),
    "search_query": (("benchmark",), """SELECT item_id AS query_id, text AS query_text,
 CASE item_id % 4 WHEN 0 THEN 'how_does_x_work' WHEN 1 THEN 'why_was_x_changed' WHEN 2 THEN 'who_owns_x' ELSE 'what_calls_x' END AS intent FROM {benchmark}"""),
}


def is_given(name: str) -> bool:
    """Whether a table is one of the given ones, not a projection."""
    return name not in _TEXTS


def _text(name: str, dialect: str, tables: dict[str, str]) -> str:
    marks = _MARKS[dialect] | tables
    text = reduce(lambda s, m: s.replace(f"{{{m[0]}}}", m[1]), marks.items(), _TEXTS[name][1])
    return text if dialect == "spark" else text.replace("AS STRING)", "AS VARCHAR)")


#: The types and trust classes of an edge's bits, by position / 3 and % 3: of customers' edges, and of suppliers'.
_TYPES, _TRUSTS = ("calls", "imports", "tests", "defined_in"), (("EXTRACTED", "INFERRED_HIGH", "INFERRED_LOW"), ("EXTRACTED", "INFERRED_HIGH", "AMBIGUOUS"))


def _knowledge_edges(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """``knowledge_edge`` as its SQL states it, written once: one row of keys for each pair of ends, with a bit for each type and trust.

    Queries read the table several times; pairs of numbers take a fraction of the bytes and memory of four strings, and
    strings are made where they are read.
    """
    m = F.col("l_linenumber") % 4
    kind = F.when(m == 0, 0).when(m == 1, 3).when(m == 2, 6).otherwise(9) + F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    lines = lineitem.select("l_orderkey", "l_suppkey", "l_partkey", F.call_function("shiftleft", F.lit(1), kind).alias("bit"))
    bought = orders.join(lines.drop("l_partkey"), orders["o_orderkey"] == lines["l_orderkey"]).select(F.lit(0).alias("side"), F.col("o_custkey").cast("long").alias("u"), F.col("l_suppkey").cast("long").alias("v"), "bit")
    made = lines.select(F.lit(1).alias("side"), F.col("l_suppkey").cast("long").alias("u"), F.col("l_partkey").cast("long").alias("v"), "bit")
    pairs = [written(x.groupBy("side", "u", "v").agg(F.bit_or("bit").alias("bits")), "knowledge_edge") for x in (bought, made)]

    def told(x: DataFrame, side: int, a: str, b: str) -> DataFrame:
        kinds = [F.when(F.col("bits").bitwiseAND(1 << 3 * i + j) != 0, F.struct(F.lit(t).alias("edge_type"), F.lit(c).alias("trust_class"))) for i, t in enumerate(_TYPES) for j, c in enumerate(_TRUSTS[side])]
        ids = (F.concat(F.lit(a), F.col("u").cast("string")).alias("from_artifact_id"), F.concat(F.lit(b), F.col("v").cast("string")).alias("to_artifact_id"))
        return x.select(*ids, F.explode(F.array_compact(F.array(*kinds))).alias("k")).select("from_artifact_id", "to_artifact_id", "k.edge_type", "k.trust_class")

    return told(pairs[0], 0, "c", "s").unionAll(told(pairs[1], 1, "s", "p"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A registry table, or one of the given tables by its name."""
    if name not in _TEXTS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    reads = _TEXTS[name][0]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in reads}
    if name == "knowledge_edge":
        return conformed(_knowledge_edges(frames["orders"], frames["lineitem"]), name)
    return conformed(spark.sql(_text(name, "spark", {t: f"{{{t}}}" for t in reads}), **frames), name)


def with_tables(*names: str) -> str:
    """The WITH clause of these registry tables for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({_text(n, 'duckdb', {t: t for t in _TEXTS[n][0]})})" for n in names) + " "

"""Queries of graph search and extracted graphs.

Nodes of knowledge_edge may be seen unless the number in their id is divisible by 5.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from ..sources.written import written
from .catalog import add

E = ("knowledge_edge",)


def _nodes(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array("from_artifact_id", "to_artifact_id")).alias("artifact_id")).distinct()


def _seeds(nodes: DataFrame) -> DataFrame:
    return nodes.where("cast(substr(artifact_id, 2) as long) % 50 = 1")


def _allowed(nodes: DataFrame) -> DataFrame:
    return nodes.where("cast(substr(artifact_id, 2) as long) % 5 > 0")


def _searched(e: DataFrame, search: Callable[..., DataFrame]) -> DataFrame:
    """A search of the edges from its seeds over allowed nodes; the edges' ends are found once."""
    nodes = written(_nodes(e), "nodes")
    return search(e, _seeds(nodes), _allowed(nodes))


def _neighbors(e: DataFrame) -> DataFrame:
    return _searched(e, lambda *x: graph.visible_neighbors(*x, 2, types=["calls", "imports"], floor="INFERRED_HIGH", include_inferred=True))


_SIDES = """, nd AS MATERIALIZED (SELECT from_artifact_id AS id FROM knowledge_edge UNION SELECT to_artifact_id FROM knowledge_edge), al AS MATERIALIZED (SELECT id FROM nd WHERE CAST(substr(id, 2) AS BIGINT) % 5 > 0), sd AS MATERIALIZED (SELECT id FROM nd WHERE CAST(substr(id, 2) AS BIGINT) % 50 = 1)"""
add("visible_neighbors", E, _neighbors, _SIDES + """, e AS (SELECT * FROM knowledge_edge WHERE trust_class IN ('EXTRACTED', 'INFERRED_HIGH') AND edge_type IN ('calls', 'imports')),
 b AS MATERIALIZED (SELECT from_artifact_id AS near, to_artifact_id AS far, (from_artifact_id, to_artifact_id, edge_type, trust_class, 'out') AS c FROM e WHERE to_artifact_id IN (SELECT id FROM al) UNION ALL SELECT to_artifact_id, from_artifact_id, (from_artifact_id, to_artifact_id, edge_type, trust_class, 'in') FROM e WHERE from_artifact_id IN (SELECT id FROM al)),
 h1 AS MATERIALIZED (SELECT id AS seed, far, min(c) AS c FROM sd JOIN b ON near = id WHERE far <> id GROUP BY ALL), h2 AS (SELECT seed, b.far, min(b.c) AS c FROM h1 JOIN b ON b.near = h1.far WHERE b.far <> seed AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.seed = h1.seed AND x.far = b.far) GROUP BY ALL),
 a AS (SELECT *, 1 AS hop FROM h1 UNION ALL SELECT *, 2 FROM h2) SELECT seed, far AS artifact_id, hop, c[3] AS edge_type, c[4] AS trust_class, c[5] AS direction FROM (SELECT seed, far, hop, [c[1], c[2], c[3], c[4], c[5]] AS c, row_number() OVER (PARTITION BY seed ORDER BY hop, c) AS r FROM a) WHERE r <= 100""")


add("expand", E, lambda e: _searched(e, graph.expand_sizes), _SIDES + """, e AS (SELECT * FROM knowledge_edge WHERE trust_class IN ('EXTRACTED', 'INFERRED_HIGH', 'INFERRED_LOW')),
 b AS MATERIALIZED (SELECT from_artifact_id AS near, to_artifact_id AS far, trust_class = 'EXTRACTED' AS x FROM e WHERE to_artifact_id IN (SELECT id FROM al) UNION SELECT to_artifact_id, from_artifact_id, trust_class = 'EXTRACTED' FROM e WHERE from_artifact_id IN (SELECT id FROM al)),
 p AS MATERIALIZED (WITH RECURSIVE r AS (SELECT id AS seed, id FROM sd UNION SELECT seed, far FROM r JOIN b ON near = r.id AND x) SELECT * FROM r),
 q AS (WITH RECURSIVE r AS (SELECT seed, id FROM p UNION SELECT seed, far FROM r JOIN b ON near = r.id) SELECT * FROM r)
 SELECT seed, CASE WHEN q.id = seed THEN 'seed' WHEN p.id IS NOT NULL THEN 'EXTRACTED' ELSE 'INFERRED' END AS tier, count(*) AS nodes FROM q LEFT JOIN p USING (seed, id) GROUP BY ALL""")
add("expand_cards", E, lambda e: _searched(e, graph.expand_cards), None)


def _visible(allowed: DataFrame) -> DataFrame:
    i = F.col("artifact_id")
    return allowed.select("artifact_id", F.when(i.like("p%"), "code_file").otherwise("code_symbol").alias("artifact_type"), i.alias("title"), F.concat(F.lit("src/"), F.substring(i, 2, 1), F.lit("/"), i, F.lit(".py")).alias("path"))


add("blast_radius", E, lambda e: _searched(e, lambda e, seeds, allowed: graph.blast_radius(e, seeds, _visible(allowed), 20)), _SIDES + """, e AS MATERIALIZED (SELECT DISTINCT from_artifact_id AS f, to_artifact_id AS t, edge_type FROM knowledge_edge WHERE trust_class = 'EXTRACTED'), hm AS (SELECT f, min(t) AS file FROM e WHERE edge_type = 'defined_in' GROUP BY 1),
 r AS (SELECT f AS seed, 'callee' AS role, t AS id, edge_type FROM e WHERE f IN (SELECT id FROM sd) AND edge_type IN ('calls', 'imports') UNION ALL SELECT t, CASE WHEN edge_type = 'tests' THEN 'test' ELSE 'caller' END, f, edge_type FROM e WHERE t IN (SELECT id FROM sd) AND edge_type IN ('calls', 'imports', 'tests')),
 x AS (SELECT r.*, CASE WHEN role = 'callee' THEN a.file ELSE b.file END AS cf, CASE WHEN role = 'callee' THEN b.file ELSE a.file END AS tf FROM r LEFT JOIN hm a ON a.f = seed LEFT JOIN hm b ON b.f = id WHERE seed <> id AND id IN (SELECT id FROM al)),
 y AS (SELECT seed, role, id AS artifact_id, 'src/' || substr(id, 2, 1) || '/' || id || '.py' AS path, CASE WHEN id NOT LIKE 'p%' THEN id END AS symbol, edge_type, CASE WHEN edge_type <> 'calls' OR coalesce(cf = tf, false) OR (cf, tf) IN (SELECT (f, t) FROM e WHERE edge_type = 'imports') THEN 'deterministic' ELSE 'interpreted' END AS tier FROM x)
 SELECT seed, role, row_number() OVER (PARTITION BY seed, role ORDER BY path, coalesce(symbol, ''), artifact_id, edge_type) AS place, artifact_id, path, symbol, edge_type, tier FROM y QUALIFY place <= 20""")


def _extraction(o: DataFrame, l: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    file = F.concat(F.lit("m"), k % 20, F.lit("/f"), k % 97, F.lit(".py"))
    base = F.concat(F.lit("f"), k % 97, F.lit(".py"))
    nodes = o.select(F.concat(F.lit("n"), k).alias("id"), F.when(k % 5 == 0, base).otherwise(F.concat(F.lit("fn"), k)).alias("label"), F.when(k % 11 == 0, "").otherwise(file).alias("source_file"))
    relation = F.element_at(F.array(*map(F.lit, ("calls", "imports", "uses", "inherits", "other"))), (F.col("l_linenumber") % 5 + 1).cast("int"))
    edges = l.select(F.concat(F.lit("n"), "l_orderkey").alias("source"), F.concat(F.lit("n"), F.col("l_partkey") % 3000).alias("target"), relation.alias("relation"), (F.col("l_suppkey") % 4).alias("source_location"))
    return graph.graph_from_extraction(nodes, edges)


add("graph_from_extraction", ("orders", "lineitem"), _extraction, """WITH nd AS MATERIALIZED (SELECT 'n' || o_orderkey AS id, 'm' || (o_orderkey % 20) || '/f' || (o_orderkey % 97) || '.py' AS sf, o_orderkey % 5 = 0 AS isf FROM orders WHERE o_orderkey % 11 > 0), fl AS (SELECT sf, max(id) AS fid FROM nd WHERE isf GROUP BY 1),
 n AS MATERIALIZED (SELECT id, nd.sf, isf, fid, CASE WHEN isf THEN 'file:' || nd.sf ELSE 'symbol:' || nd.sf || '#' || CASE WHEN fid IS NOT NULL AND starts_with(id, fid || '_') THEN substr(id, length(fid) + 2) ELSE id END END AS key FROM nd LEFT JOIN fl USING (sf)),
 e AS (SELECT s.key AS fk, s.isf AS ff, t.key AS tk, t.isf AS tf, rel, s.id AS sid, t.id AS tid, loc FROM (SELECT 'n' || l_orderkey AS source, 'n' || (l_partkey % 3000) AS target, ['calls', 'imports', 'uses', 'inherits', 'other'][l_linenumber % 5 + 1] AS rel, l_suppkey % 4 AS loc FROM lineitem) JOIN n s ON s.id = source JOIN n t ON t.id = target)
 SELECT from_key, to_key, edge_type, confidence::DOUBLE AS confidence FROM (SELECT DISTINCT key AS from_key, 'file:' || sf AS to_key, 'defined_in' AS edge_type, 1.0 AS confidence FROM n WHERE NOT isf AND fid IS NOT NULL
 UNION SELECT fk, tk, 'imports', 1.0 FROM e WHERE rel = 'imports' AND ff AND tf UNION SELECT min(fk), min(tk), 'calls', 0.9 FROM e WHERE rel = 'calls' AND NOT ff AND NOT tf GROUP BY sid, loc HAVING count(DISTINCT tid) = 1
 UNION SELECT fk, tk, rel, 0.8 FROM e WHERE rel IN ('uses', 'inherits') AND NOT ff AND NOT tf) WHERE from_key <> to_key""")


def _doc_artifacts(d: DataFrame) -> DataFrame:
    path = F.concat(F.lit("docs/"), "doc_id", F.lit(".md"))
    kind = F.when(F.col("doc_id") % 4 == 0, "document").when(F.col("doc_id") % 4 == 3, "code").otherwise("concept")
    place = F.when(F.col("doc_id") % 4 == 1, F.substring("text", 3, 40)).otherwise("paraphrased by a model, not there")
    nodes = d.select(path.alias("path"), F.concat(F.lit("n"), "doc_id").alias("id"), kind.alias("file_type"), "lang", F.when(F.col("doc_id") % 9 == 0, "other.md").otherwise(path).alias("source_file"), place.alias("source_location")).withColumnRenamed("lang", "label")
    return graph.doc_artifacts(nodes, d.select(path.alias("path"), "text")).select("path", "artifact_type", "knowledge_kind", F.sha2("body_text", 256).alias("body"), "authority_score")


_WS = "trim(regexp_replace({}, '[ \\t\\r\\n\\x0b\\f]+', ' ', 'g'))"
add("doc_artifacts", ("documents",), _doc_artifacts, f"""WITH x AS (SELECT doc_id, lang, CASE WHEN doc_id % 4 = 1 THEN substr(text, 3, 40) ELSE 'paraphrased by a model, not there' END AS loc, {_WS.format("text")} AS w FROM documents WHERE doc_id % 4 < 3 AND doc_id % 9 > 0),
 y AS (SELECT *, doc_id % 4 > 0 AND {_WS.format("loc")} <> '' AND contains(w, {_WS.format("loc")}) AS fact FROM x)
 SELECT 'docs/' || doc_id || '.md' AS path, CASE WHEN fact THEN 'source_backed_fact' WHEN doc_id % 4 = 0 THEN 'summary' ELSE 'concept' END AS artifact_type, CASE WHEN fact THEN 'source_backed' ELSE 'interpreted' END AS knowledge_kind, sha256(CASE WHEN fact THEN loc ELSE lang END) AS body,
 CASE WHEN fact THEN 0.8 WHEN doc_id % 4 = 0 THEN 0.5 ELSE 0.6 END::DOUBLE AS authority_score FROM y""")

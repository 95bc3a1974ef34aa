"""The query of change packs: cards of the work board are the tasks, searched among all artifacts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import changes, registry
from .catalog import add
from .queries import _SCORED

L = ("linkable", "code_edge")


def _change(a: DataFrame, e: DataFrame) -> DataFrame:
    """A task names a symbol, a file, or neither; files next to code files are their tests; code uses what stands before it."""
    i = F.col("artifact_id").cast("long")
    used = F.concat(F.lit(" uses handle_"), i - i % 7 - 7, F.lit(" and Handle"), i - i % 7 - 14, F.lit("Client"))
    is_test = i % 7 == 2
    art = a.select(
        "artifact_id", F.when(is_test, "code_file").otherwise(F.col("artifact_type")).alias("artifact_type"), F.when(i % 35 == 0, F.concat(F.lit("Handle"), i, F.lit("Client"))).otherwise(F.col("title")).alias("title"),
        F.when(is_test, F.concat(F.lit("src/m"), i % 10, F.lit("/tests/test_file_"), i - 1, F.lit(".py"))).otherwise(F.col("path")).alias("path"), F.when(i % 7 < 2, F.concat("body_text", used)).otherwise(F.col("body_text")).alias("body_text"),
    )
    said = F.substring("body_text", -60, 60)
    said = F.when(i % 3 == 0, said).when(i % 3 == 1, F.regexp_replace(said, "handle_[0-9]+", "")).otherwise(F.regexp_replace(said, "handle_[0-9]+|[^ ]*file_[0-9]+[^ ]*", ""))
    tasks = a.where("source_type = 'ado_card'").select(i.alias("query_id"), said.alias("query_text"), (300 + i % 900).alias("budget"))
    pool = art.select("*", F.lit(0).alias("valid_from_seq"), F.lit(None).cast("long").alias("invalidated_at_seq"), F.col("path").alias("search_text"))
    edges = e.where("trust_class = 'EXTRACTED'").select("from_artifact_id", "to_artifact_id", "edge_type")
    # Cards can't be their own answer.
    code = pool.where("artifact_type IN ('code_symbol', 'code_file')")
    return changes.change_pack(tasks, edges, art, lambda q: registry.keyword_search(q, code, 1, 12).select("query_id", "artifact_id", "rank"))


def _search(prefix: str, queries: str) -> str:
    """SQL of a search of that table of queries among ``pool``, best twelve."""
    sql = re.sub(r"\b(qt|ma|ct|ht|df|sc|top)\b", rf"{prefix}_\1", _SCORED)
    sql = sql.replace("FROM search_query", f"FROM {queries}").replace("rank <= 20", "rank <= 12")
    return re.sub(r"FROM knowledge_artifact WHERE \([^)]*\([^)]*\)\)", "FROM pool", sql)


_STEM = "regexp_replace(string_split({0}, '/')[-1], '\\.[^.]*$', '')"
_NEAR = "len(list_filter(range(1, least(len(string_split({0}, '/')), len(string_split({1}, '/')))), lambda i: string_split({0}, '/')[1:i] = string_split({1}, '/')[1:i]))"
_TEST = "(contains({0}, '/test') OR starts_with(string_split({0}, '/')[-1], 'test_') OR ends_with(string_split({0}, '/')[-1], '_test.py'))"
_BAD = ", ".join(f"'{x}'" for x in changes.UBIQUITOUS)
_SQL = f""", art AS MATERIALIZED (SELECT artifact_id AS id, n, CASE WHEN n % 7 = 2 THEN 'code_file' ELSE artifact_type END AS t, CASE WHEN n % 35 = 0 THEN 'Handle' || n || 'Client' ELSE title END AS title, CASE WHEN n % 7 = 2 THEN 'src/m' || (n % 10) || '/tests/test_file_' || (n - 1) || '.py' ELSE path END AS path, CASE WHEN n % 7 < 2 THEN body_text || ' uses handle_' || (n - n % 7 - 7) || ' and Handle' || (n - n % 7 - 14) || 'Client' ELSE body_text END AS body_text, source_type FROM (SELECT *, CAST(artifact_id AS BIGINT) AS n FROM linkable)),
 tk AS MATERIALIZED (SELECT n AS query_id, CASE n % 3 WHEN 0 THEN s WHEN 1 THEN regexp_replace(s, 'handle_[0-9]+', '', 'g') ELSE regexp_replace(s, 'handle_[0-9]+|[^ ]*file_[0-9]+[^ ]*', '', 'g') END AS query_text, 300 + n % 900 AS budget FROM (SELECT n, right(body_text, 60) AS s FROM art WHERE source_type = 'ado_card')),
 pool AS MATERIALIZED (SELECT id AS artifact_id, title, path AS search_text, body_text FROM art WHERE t IN ('code_symbol', 'code_file')),
 e AS MATERIALIZED (SELECT from_artifact_id AS f, to_artifact_id AS t, edge_type FROM code_edge WHERE trust_class = 'EXTRACTED')""" + _search("l", "tk") + f""", c AS (SELECT * FROM art WHERE t IN ('code_symbol', 'code_file')), wd AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(query_text, '[A-Za-z_][A-Za-z0-9_./-]*')) AS w FROM tk),
 ca AS (SELECT query_id, id, 0.96::DOUBLE AS score FROM wd JOIN c ON t = 'code_symbol' AND title = w UNION ALL SELECT query_id, id, 0.85 FROM wd JOIN c ON t = 'code_file' AND string_split(path, '/')[-1] = string_split(w, '/')[-1] UNION ALL SELECT query_id, arg_min(artifact_id, rank), 0.55 FROM l_top JOIN c ON id = artifact_id GROUP BY 1),
 g AS MATERIALIZED (SELECT query_id, id AS tid, score, title, path AS tp FROM (SELECT * FROM ca QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) = 1) JOIN art USING (id)), ts AS MATERIALIZED (SELECT id, path, body_text FROM art WHERE {_TEST.format("path")}),
 sa AS (SELECT DISTINCT id, unnest(regexp_extract_all(body_text, '[A-Za-z_][A-Za-z0-9_]*')) AS w FROM ts),
 f1 AS MATERIALIZED (SELECT query_id, f AS id, 0.9::DOUBLE AS score FROM g JOIN e ON e.t = tid AND edge_type = 'tests' UNION ALL SELECT query_id, id, 0.8 FROM g JOIN sa ON w = title),
 r1 AS MATERIALIZED (SELECT query_id, concat_ws(' ', 'test', title, {_STEM.format("tp")}) AS query_text, tp FROM g WHERE query_id NOT IN (SELECT query_id FROM f1))""" + _search("o", "r1") + f""", f2 AS MATERIALIZED (SELECT query_id, artifact_id AS id, 0.7::DOUBLE AS score FROM o_top JOIN ts ON id = artifact_id),
 f3 AS (SELECT query_id, id, 0.5::DOUBLE AS score FROM r1 JOIN ts ON {_STEM.format("path")} = 'test_' || {_STEM.format("tp")} WHERE query_id NOT IN (SELECT query_id FROM f2)),
 fo AS (SELECT query_id, id, max(score) AS score FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3) GROUP BY ALL),
 te AS (SELECT query_id, id, path, fo.score, row_number() OVER (PARTITION BY query_id ORDER BY contains(string_split(path, '/')[-1], {_STEM.format("tp")}) DESC, {_NEAR.format("tp", "path")} DESC, fo.score DESC, path, id) AS place FROM fo JOIN g USING (query_id) JOIN art USING (id) WHERE path IS NOT NULL QUALIFY place <= {changes.TESTS}),
 ow AS MATERIALIZED (SELECT query_id, e.t AS fid FROM g JOIN e ON e.f = tid AND edge_type = 'defined_in' UNION SELECT query_id, id FROM g JOIN art ON art.t = 'code_file' AND path = tp),
 im AS (SELECT f, t FROM e WHERE edge_type = 'imports' UNION SELECT t, f FROM e WHERE edge_type = 'imports'), nr AS (SELECT DISTINCT query_id, t AS fid FROM ow JOIN im ON f = fid WHERE (query_id, t) NOT IN (SELECT (query_id, fid) FROM ow)),
 pt AS (SELECT query_id, fid, sum({changes.IN_TASK} * contains(lower(query_text), lower(s.title))::INT + {changes.IN_TARGET} * contains(lower(coalesce(b.body_text, '')), lower(s.title))::INT + {changes.IS_CONTRACT} * regexp_matches(s.title, '{changes.CONTRACT}')::INT) AS points
  FROM nr JOIN (SELECT DISTINCT f, t FROM e WHERE edge_type = 'defined_in') d ON d.t = fid JOIN art s ON s.id = d.f AND s.title IS NOT NULL JOIN tk USING (query_id) JOIN g USING (query_id) JOIN art b ON b.id = tid GROUP BY ALL),
 dp AS (SELECT query_id, fid AS id, path, points + CASE WHEN {_STEM.format("path")} IN ({_BAD}) AND NOT contains(lower(query_text), {_STEM.format("path")}) THEN {changes.IS_UBIQUITOUS} ELSE 0 END AS pts, tp FROM pt JOIN art ON id = fid JOIN tk USING (query_id) JOIN g USING (query_id)),
 dq AS (SELECT query_id, id, path, least(0.95, round(0.55 + pts / 200, 6)) AS score, row_number() OVER (PARTITION BY query_id ORDER BY pts DESC, {_NEAR.format("tp", "path")} DESC, path, id) AS place FROM dp WHERE pts > 0 AND path <> tp AND NOT {_TEST.format("path")} QUALIFY place <= {changes.DEPENDENCIES}),
 sz AS (SELECT path, sum(length(coalesce(body_text, ''))) AS chars FROM art GROUP BY 1),
 ch AS MATERIALIZED (SELECT *, CASE WHEN coalesce(chars, 0) > 0 THEN CAST(ceil(chars / 4) AS BIGINT) ELSE {changes.UNKNOWN_TOKENS} END AS tokens FROM (SELECT query_id, 'target' AS role, 1 AS place, tid AS id, tp AS path, score FROM g UNION ALL SELECT query_id, 'test', place, id, path, score FROM te UNION ALL SELECT query_id, 'dependency', place, id, path, score FROM dq) LEFT JOIN sz USING (path)),
 es AS (SELECT query_id, sum(tokens) AS spent, any_value(budget) AS budget FROM ch JOIN tk USING (query_id) WHERE role <> 'dependency' GROUP BY 1), k1 AS (SELECT query_id, tokens, spent + tokens <= budget AS fits FROM ch JOIN es USING (query_id) WHERE role = 'dependency' AND place = 1)
 SELECT query_id, role, CAST(place AS INT) AS place, id AS artifact_id, score::DOUBLE AS score, tokens FROM ch JOIN es USING (query_id) LEFT JOIN (SELECT query_id, CASE WHEN fits THEN tokens ELSE 0 END AS first FROM k1) USING (query_id)
 WHERE role <> 'dependency' OR place = 1 AND spent + tokens <= budget OR place = 2 AND spent + coalesce(first, 0) + tokens <= budget"""
add("change_pack", L, _change, _SQL)

"""Change packs: a task's target, the tests that cover it and the files that it depends on, within a budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.written import written
from .matching import small
from .versions import path_proximity

# Sizes, tokens of a file without text, what a name says of its file, and files that all others import.
TESTS, DEPENDENCIES, UNKNOWN_TOKENS = 3, 2, 400
CONTRACT = "(Error|Exception|Client|Response|Request|Config|Protocol|Backend|Base|Spec)$"
UBIQUITOUS = ("structured_logging", "logging", "logger", "log", "telemetry", "tracing", "metrics")
IN_TASK, IN_TARGET, IS_CONTRACT, IS_UBIQUITOUS = 40, 45, 25, -50


def _name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _stem(path: Column) -> Column:
    return F.regexp_replace(_name(path), "\\.[^.]*$", "")


def change_targets(tasks: DataFrame, lexical: DataFrame, artifacts: DataFrame) -> DataFrame:
    """One target for each task: (query_id, artifact_id, score).

    Code whose name the text holds (.96), or whose file it names (.85), or the best hit that is code (.55); ties to the smaller id.
    """
    code = artifacts.where(F.col("artifact_type").isin("code_symbol", "code_file")).select("artifact_id", "artifact_type", "title", "path")
    words = tasks.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all("query_text", F.lit("[A-Za-z_][A-Za-z0-9_./-]*"), F.lit(0)))).alias("word"))
    named = words.join(code.where("artifact_type = 'code_symbol'"), F.col("word") == F.col("title")).select("query_id", "artifact_id", F.lit(0.96).alias("score"))
    files = code.where("artifact_type = 'code_file'").withColumn("word_", _name(F.col("path")))
    filed = words.withColumn("word_", _name(F.col("word"))).join(files, "word_").select("query_id", "artifact_id", F.lit(0.85).alias("score"))
    hit = lexical.join(code.select("artifact_id"), "artifact_id").groupBy("query_id").agg(F.min_by("artifact_id", "rank").alias("artifact_id")).select("query_id", "artifact_id", F.lit(0.55).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "artifact_id")
    return named.unionAll(filed).unionAll(hit).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def _tests(t: DataFrame, edges: DataFrame, artifacts: DataFrame, heads: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(query_id, artifact_id, path, score) of tests of each target, by stages: only targets that one leaves without a test go on."""
    tests = written(artifacts.where(text.is_test_path(F.col("path"))).select("artifact_id", "path", "body_text"), "tests")
    same = lambda d: d.where(F.coalesce(text.service_scope(F.col("target_path")) == text.service_scope(F.col("path")), F.lit(True)))
    edge = t.join(edges.where("edge_type = 'tests'"), F.col("to_artifact_id") == F.col("target_id")).select("query_id", "target_path", F.col("from_artifact_id").alias("artifact_id"), F.lit(0.9).alias("score"))
    edge = edge.join(heads.select("artifact_id", "path"), "artifact_id")
    said = tests.select("artifact_id", "path", F.explode(F.array_distinct(F.regexp_extract_all("body_text", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))).alias("title"))
    # Texts have many words, so the names are what moves, if they are few.
    body = said.join(small(t), "title").select("artifact_id", "query_id", "target_path", F.lit(0.8).alias("score"), "path")
    found = written(same(edge.unionAll(body)), "covering")
    rest = written(t.join(found.select("query_id").distinct(), "query_id", "left_anti"), "uncovered")
    focused = search(rest.select("query_id", F.concat_ws(" ", F.lit("test"), "title", _stem(F.col("target_path"))).alias("query_text")))
    hits = focused.join(tests.select("artifact_id", "path"), "artifact_id").join(rest, "query_id").select("artifact_id", "query_id", "target_path", F.lit(0.7).alias("score"), "path")
    hits = written(same(hits), "focused")
    last = rest.join(hits.select("query_id").distinct(), "query_id", "left_anti").withColumn("name", F.concat(F.lit("test_"), _stem(F.col("target_path"))))
    named = same(last.join(tests.withColumn("name", _stem(F.col("path"))), "name").select("artifact_id", "query_id", "target_path", F.lit(0.5).alias("score"), "path"))
    every = found.unionAll(hits).unionAll(named).groupBy("query_id", "artifact_id", "path", "target_path").agg(F.max("score").alias("score"))
    stem = F.contains(_name(F.col("path")), _stem(F.col("target_path")))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce(stem, F.lit(False))), F.desc(path_proximity(F.col("target_path"), F.col("path"))), F.desc("score"), "path", "artifact_id")
    return every.withColumn("place", F.row_number().over(w)).where(F.col("place") <= TESTS).select("query_id", "artifact_id", "path", "score", "place")


def dependencies(tasks: DataFrame, t: DataFrame, edges: DataFrame, artifacts: DataFrame, heads: DataFrame) -> DataFrame:
    """(query_id, artifact_id, path, score, place): files that the target's file imports or that import it, best first.

    A file counts by the symbols defined in it: each that the task names, each that the target's body uses, and each
    whose name ends like a contract (an error, a client, a config); a file that all others import counts less
    unless the task names it.  Tests, files of another service and files that count for nothing are left out.
    ``heads``: the artifacts without their texts.
    """
    defined = written(edges.where("edge_type = 'defined_in'").select(F.col("from_artifact_id").alias("symbol_id"), F.col("to_artifact_id").alias("file_id")).distinct(), "defined")
    own = t.join(defined.withColumnRenamed("symbol_id", "target_id"), "target_id").select("query_id", "file_id")
    by_path = t.join(heads.where("artifact_type = 'code_file'").select(F.col("artifact_id").alias("file_id"), F.col("path").alias("target_path")), "target_path").select("query_id", "file_id")
    own = written(own.unionAll(by_path).distinct(), "target_files")
    imports = edges.where("edge_type = 'imports'").select(F.col("from_artifact_id").alias("file_id"), F.col("to_artifact_id").alias("other"))
    near = own.join(imports.unionAll(imports.select("other", "file_id")), "file_id").select("query_id", F.col("other").alias("file_id")).distinct().join(own, ["query_id", "file_id"], "left_anti")
    # Two hops first, to titles and ids alone; texts join one row for each symbol that counts, and only those of its targets are read on.
    titles = heads.where("title IS NOT NULL").select(F.col("artifact_id").alias("symbol_id"), "title")
    named = written(near.join(defined, "file_id").join(titles, "symbol_id").select("query_id", "file_id", "title"), "named")
    asked = t.select("query_id", "target_id", "target_path").join(named.select("query_id").distinct(), "query_id", "left_semi")
    asked = written(asked.join(tasks.select("query_id", F.lower("query_text").alias("asked")), "query_id"), "asking")
    bodies = artifacts.select(F.col("artifact_id").alias("target_id"), F.lower(F.coalesce("body_text", F.lit(""))).alias("body"))
    bodies = bodies.join(small(written(asked.select("target_id").distinct(), "wanted")), "target_id", "left_semi")
    symbols = named.join(asked, "query_id").join(bodies, "target_id")
    low = F.lower("title")
    points = F.when(F.contains("asked", low), IN_TASK).otherwise(0) + F.when(F.contains("body", low), IN_TARGET).otherwise(0) + F.when(F.col("title").rlike(CONTRACT), IS_CONTRACT).otherwise(0)
    counted = symbols.groupBy("query_id", "file_id").agg(F.sum(points).alias("points"))
    files = heads.select(F.col("artifact_id").alias("file_id"), "path")
    j = counted.join(files, "file_id").join(asked.select("query_id", "target_path", "asked"), "query_id")
    stem = _stem(F.col("path"))
    j = j.withColumn("points", F.col("points") + F.when(stem.isin(*UBIQUITOUS) & ~F.contains("asked", stem), IS_UBIQUITOUS).otherwise(0))
    j = j.where((F.col("points") > 0) & (F.col("path") != F.col("target_path")) & ~text.is_test_path(F.col("path")))
    j = j.where(F.coalesce(text.service_scope(F.col("target_path")) == text.service_scope(F.col("path")), F.lit(True)))
    w = Window.partitionBy("query_id").orderBy(F.desc("points"), F.desc(path_proximity(F.col("target_path"), F.col("path"))), "path", "file_id")
    best = j.withColumn("place", F.row_number().over(w)).where(F.col("place") <= DEPENDENCIES)
    return best.select("query_id", F.col("file_id").alias("artifact_id"), "path", F.least(F.lit(0.95), F.round(0.55 + F.col("points") / 200, 6)).alias("score"), "place")


def change_pack(tasks: DataFrame, edges: DataFrame, artifacts: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows (query_id, role, place, artifact_id, score, tokens): target, tests and dependencies of each task.

    ``tasks``: query_id, query_text, budget; ``artifacts``: artifact_id, artifact_type, title, path, body_text; ``search`` gives hits
    (query_id, artifact_id, rank) of queries (query_id, query_text).  Target and tests always stay; a dependency that no longer
    fits the budget is skipped, a later one may fit.  A file's tokens are those of all text that the artifacts of its path have.
    """
    # What is read many times is written once, so that texts are read only where they count.
    tasks, edges = written(tasks.select("query_id", "query_text", "budget"), "tasks"), written(edges, "edges")
    heads = written(artifacts.select("artifact_id", "artifact_type", "title", "path", F.length(F.coalesce("body_text", F.lit(""))).alias("chars")), "heads")
    target = change_targets(tasks, search(tasks.select("query_id", "query_text")), heads)
    t = target.join(heads.select("artifact_id", "title", F.col("path").alias("target_path")), "artifact_id").select("query_id", F.col("artifact_id").alias("target_id"), "title", "target_path", "score")
    t = written(t, "targets")
    tests = _tests(t.drop("score"), edges, artifacts, heads, search)
    needed = dependencies(tasks, t, edges, artifacts, heads)
    role = lambda d, r: d.select("query_id", F.lit(r).alias("role"), "place", "artifact_id", "path", "score")
    chosen = role(t.select("query_id", F.lit(1).alias("place"), F.col("target_id").alias("artifact_id"), F.col("target_path").alias("path"), "score"), "target").unionAll(role(tests, "test")).unionAll(role(needed, "dependency"))
    size = heads.groupBy("path").agg(F.sum("chars").alias("chars"))
    chosen = chosen.join(size, "path", "left").withColumn("tokens", F.when(F.coalesce("chars", F.lit(0)) > 0, F.ceil(F.col("chars") / 4)).otherwise(UNKNOWN_TOKENS).cast("long"))
    chosen = written(chosen, "chosen")
    spent = chosen.where("role <> 'dependency'").groupBy("query_id").agg(F.sum("tokens").alias("spent")).join(tasks.select("query_id", "budget"), "query_id")
    ordered = chosen.where("role = 'dependency'").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "artifact_id", "tokens"))).alias("wanted")).join(spent, "query_id")

    def skip(s: Column, x: Column) -> Column:
        fits = s["spent"] + x["tokens"] <= F.col("budget")
        return F.struct(F.when(fits, s["spent"] + x["tokens"]).otherwise(s["spent"]).alias("spent"), F.when(fits, F.concat(s["kept"], F.array(x["artifact_id"]))).otherwise(s["kept"]).alias("kept"))

    kept = F.aggregate("wanted", F.struct(F.col("spent"), F.expr("CAST(array() AS array<string>)").alias("kept")), skip)["kept"]
    fit = ordered.select("query_id", F.explode(kept).alias("artifact_id"))
    out = chosen.where("role <> 'dependency'").unionByName(chosen.where("role = 'dependency'").join(fit, ["query_id", "artifact_id"], "left_semi"))
    return out.select("query_id", "role", "place", "artifact_id", "score", "tokens")

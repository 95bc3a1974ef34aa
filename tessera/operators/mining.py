"""Alias mining from commits and documents, and what it changes in the registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import resolve

#: Targets that an alias lists, and that it has edges to.
MAX_TARGETS, MAX_EDGES = 50, 20


def mine_commits(commits: DataFrame) -> DataFrame:
    """Rows (source_key, content_hash, phrase, path): what each commit's subject and changed documents name.

    ``commits``: source_key, content_hash, subject, changed_files.  Scope and n-grams of the subject
    name all changed files, if there are any; a changed docs/**.md is named by its slug.
    """
    c = commits.withColumn("files", F.array_sort(F.array_distinct("changed_files")))
    scope, rest = text.subject_scope(F.col("subject")), text.subject_description(F.col("subject"))
    phrases = F.concat(F.array_compact(F.array(text.normalize_phrase(scope))), text.phrase_ngrams(rest))
    by_subject = c.select("source_key", "content_hash", F.explode(F.array_distinct(phrases)).alias("phrase"), "files").where("phrase <> ''").withColumn("path", F.explode("files")).drop("files")
    slugs = c.select("source_key", "content_hash", F.explode(F.filter("files", lambda p: F.startswith(p, F.lit("docs/")))).alias("path"))
    by_slug = slugs.select("source_key", "content_hash", text.doc_slug_phrase(F.col("path")).alias("phrase"), "path").where("phrase is not null")
    return by_subject.unionByName(by_slug).distinct()


def mine_docs(docs: DataFrame) -> DataFrame:
    """Rows (source_key, content_hash, phrase, path): a document's slug names the document."""
    return docs.select("source_key", "content_hash", text.doc_slug_phrase(F.col("path")).alias("phrase"), "path").where("phrase is not null")


def incremental_mining(stored: DataFrame, inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stored evidence to replay, inputs to mine).

    ``stored``: source_key, content_hash, phrase, path; ``inputs``: source_key, content_hash and what
    mining reads.  A source is replayed if all its stored rows have one hash and it is the input's.
    """
    known = stored.groupBy("source_key").agg(F.min("content_hash").alias("low"), F.max("content_hash").alias("high")).where("low = high")
    same = inputs.select("source_key", "content_hash").join(known, (inputs["source_key"] == known["source_key"]) & (F.col("content_hash") == F.col("low"))).select(inputs["source_key"])
    return stored.join(same, "source_key", "left_semi"), inputs.join(same, "source_key", "left_anti")


def alias_aggregate(contributions: DataFrame, most: int = MAX_TARGETS) -> DataFrame:
    """Rows (phrase, path, place, count, confirmations): each phrase's targets in order of rank.

    A target ranks by the sources that name it, then tests last, then tokens of the file name that
    the phrase has, then the path.  ``most`` bounds an alias's list, which is the feature.
    """
    c = contributions.select("source_key", "phrase", "path").distinct()
    confirmed = c.groupBy("phrase").agg(F.count_distinct("source_key").alias("confirmations"))
    counts = c.groupBy("phrase", "path").agg(F.count("*").alias("count"))
    name = F.substring_index("path", "/", -1)
    shared = F.size(F.array_intersect(text.tokens(name), F.split("phrase", " ")))
    w = Window.partitionBy("phrase").orderBy(F.desc("count"), text.is_test_file(F.col("path")), F.desc(shared), "path")
    ranked = counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return ranked.join(confirmed, "phrase").select("phrase", "path", F.col("place").cast("long").alias("place"), "count", "confirmations")


def alias_rows(aggregates: DataFrame) -> DataFrame:
    """Desired alias rows: phrase, body (targets as JSON), search_text, confirmations."""
    target = F.struct("place", "path", "count")
    g = aggregates.groupBy("phrase").agg(F.sort_array(F.collect_list(target)).alias("t"), F.max("confirmations").alias("confirmations"))
    body = F.to_json(F.struct(F.col("confirmations"), F.transform("t", lambda t: F.struct(t["path"].alias("path"), t["count"].alias("count"))).alias("targets")))
    return g.select("phrase", body.alias("body"), F.array_join(F.concat(F.array("phrase"), text.phrase_variants(F.col("phrase"))), " ").alias("search_text"), "confirmations")


def reconcile_aliases(before: DataFrame, desired: DataFrame, seq: int) -> DataFrame:
    """Rows (phrase, action, body, valid_from_seq, invalidated_at_seq) after a mining pass.

    ``before``: phrase, body, search_text, provenance, valid_from_seq, invalidated_at_seq.  Rows of
    the ledger's provenance aren't this pass's to invalidate; a row that was invalidated is revived.
    """
    b = before.select("phrase", F.col("body").alias("old_body"), F.col("search_text").alias("old_search"), "provenance", "valid_from_seq", "invalidated_at_seq", F.lit(True).alias("had"))
    j = b.join(desired.select("phrase", "body", "search_text", F.lit(True).alias("wanted")), "phrase", "full")
    same = (F.col("old_body") == F.col("body")) & (F.col("old_search") == F.col("search_text")) & F.col("invalidated_at_seq").isNull()
    gone = F.col("invalidated_at_seq").isNull() & (F.coalesce("provenance", F.lit("")) != "ledger_mined")
    action = F.when(F.col("had").isNull(), "insert").when(F.col("wanted").isNull(), F.when(gone, "invalidate").otherwise("keep")).when(same, "unchanged").otherwise("refresh")
    j = j.withColumn("action", action)
    left = F.when(F.col("action") == "invalidate", F.lit(seq)).when(F.col("action") == "keep", F.col("invalidated_at_seq"))
    return j.select("phrase", "action", F.coalesce("body", "old_body").alias("body"), F.coalesce(F.col("valid_from_seq").cast("long"), F.lit(seq).cast("long")).alias("valid_from_seq"), left.cast("long").alias("invalidated_at_seq"))


def alias_edges(aggregates: DataFrame, targets: DataFrame, most: int = MAX_EDGES) -> DataFrame:
    """Edges (phrase, artifact_id, confidence) to the first targets that resolve: confidence is count over confirmations."""
    j = aggregates.join(targets.select("path", "artifact_id"), "path").where(F.col("place") <= most)
    return j.select("phrase", "artifact_id", F.round(F.least(F.lit(1.0), F.col("count") / F.col("confirmations")), 6).alias("confidence"))


def reconcile_mined(groups: DataFrame, titles: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows (phrase, outcome, alias): what becomes of phrases that searches missed.

    already_aliased where the phrase is an alias; unresolved where no title resembles it; else mined,
    with the title that resolves it.
    """
    known = aliases.select("phrase", F.lit(True).alias("known")).distinct()
    found = resolve.fuzzy_resolve(groups.select(F.col("phrase").alias("query_id"), F.col("phrase").alias("query_text")), titles)
    j = groups.select("phrase").distinct().join(known, "phrase", "left").join(found.select(F.col("query_id").alias("phrase"), "alias"), "phrase", "left")
    outcome = F.when(F.col("known"), "already_aliased").when(F.col("alias").isNull(), "unresolved").otherwise("mined")
    return j.select("phrase", outcome.alias("outcome"), F.when(outcome == "mined", F.col("alias")).alias("alias"))


def explode_targets(aliases: DataFrame) -> DataFrame:
    """Rows (alias_id, place, path, artifact_id) of the aliases' JSON; bad JSON gives none.

    ``target_entity_ids`` is a list of ids; ``targets`` one of objects with artifact_id and path.
    """
    shape = "target_entity_ids array<string>, targets array<struct<artifact_id: string, path: string>>"
    p = F.from_json("body", shape)
    none = F.lit(None).cast("string")
    each = F.coalesce(F.transform(p["target_entity_ids"], lambda i: F.struct(none.alias("path"), i.alias("artifact_id"))), F.transform(p["targets"], lambda t: F.struct(t["path"].alias("path"), t["artifact_id"].alias("artifact_id"))))
    return aliases.select("alias_id", F.posexplode(each).alias("place", "t")).select("alias_id", F.col("place").cast("long").alias("place"), "t.path", "t.artifact_id")

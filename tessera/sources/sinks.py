"""Sinks: search documents and linked notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import access, text


def write_search_docs(docs: DataFrame, path: str) -> None:
    """Replaces the projection, in one folder for each artifact type; running again gives the same rows."""
    docs.write.mode("overwrite").partitionBy("artifact_type").parquet(path)


def note_slugs(artifacts: DataFrame, seq: int) -> DataFrame:
    """Rows (artifact_id, folder, slug, title): unique within a folder; from the second of a slug on, its id's first group is put behind."""
    a = artifacts.where(access.member(seq)).select("artifact_id", F.col("artifact_type").alias("folder"), F.coalesce("title", "artifact_id").alias("title"))
    a = a.withColumn("base", text.slugify(F.col("title"), F.lit("untitled")))
    n = F.row_number().over(Window.partitionBy("folder", "base").orderBy("title", "artifact_id"))
    slug = F.when(n == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.substring_index("artifact_id", "-", 1)))
    return a.select("artifact_id", "folder", slug.alias("slug"), "title")


def export_notes(artifacts: DataFrame, edges: DataFrame, sources: DataFrame, seq: int) -> DataFrame:
    """Rows (folder, slug, markdown): a note for each member artifact, with links to and from its neighbours.

    Links of a note come sorted; a hub's lines are one row of output, as a note is one file.
    """
    n = note_slugs(artifacts, seq)
    e = edges.where(access.member(seq)).select("from_artifact_id", "to_artifact_id", "edge_type").distinct()
    link = F.concat(F.lit("[["), "folder", F.lit("/"), "slug", F.lit("]]"))
    far = n.select("artifact_id", link.alias("link"))
    side = lambda me, other, arrow: e.join(far.withColumnRenamed("artifact_id", other), other).select(F.col(me).alias("artifact_id"), F.concat(F.lit(f"- {arrow} "), "edge_type", F.lit(": "), "link").alias("line"))
    lines = side("from_artifact_id", "to_artifact_id", "to").unionAll(side("to_artifact_id", "from_artifact_id", "from"))
    links = lines.groupBy("artifact_id").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("links"))
    d = artifacts.select("artifact_id", "artifact_type", "body_text", "source_id").join(sources.select("source_id", "source_uri"), "source_id", "left")
    j = n.join(d, "artifact_id").join(links, "artifact_id", "left")
    front = F.concat(F.lit("---\nid: "), "artifact_id", F.lit("\ntype: "), "artifact_type", F.lit("\nsource: "), F.coalesce("source_uri", F.lit("")), F.lit("\n---\n\n# "), "title", F.lit("\n\n"))
    return j.select("folder", "slug", F.concat(front, F.coalesce("body_text", F.lit("")), F.lit("\n\n## Links\n\n"), F.coalesce("links", F.lit("")), F.lit("\n")).alias("markdown"))


def note_index(notes: DataFrame) -> DataFrame:
    return notes.groupBy("folder").agg(F.count("*").alias("notes"))


def write_notes(notes: DataFrame, path: str) -> None:
    """One folder for each type; a note is a row of the text files there."""
    notes.select("folder", "markdown").write.mode("overwrite").partitionBy("folder").text(path)

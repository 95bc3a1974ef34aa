"""Sweeps over interval versions, and checks of claims against evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import access


def judgment_cache_key(a: Column, b: Column, *versions: Column) -> Column:
    """A key of two content hashes in either order, and the versions of what judged them."""
    return F.sha2(F.concat_ws("\x1f", F.least(a, b), F.greatest(a, b), *versions), 256)


def path_proximity(a: Column, b: Column) -> Column:
    """Number of leading folders that two paths share."""
    folders = lambda p: F.slice(F.split(p, "/"), 1, F.greatest(F.size(F.split(p, "/")) - 1, F.lit(0)))
    same = F.transform(F.arrays_zip(folders(a).alias("x"), folders(b).alias("y")), lambda z: F.coalesce(z["x"] == z["y"], F.lit(False)))
    apart = F.array_position(same, False)
    return F.when(apart == 0, F.size(same)).otherwise(apart - 1).cast("int")


def deletion_sweep(artifacts: DataFrame, edges: DataFrame, gone: DataFrame, seq: int) -> tuple[DataFrame, DataFrame]:
    """Artifacts of gone sources and edges at them leave at ``seq``; what left before stays as it was."""
    g = gone.select("source_id", F.lit(True).alias("gone"))
    a = artifacts.join(g, "source_id", "left")
    hit = F.col("gone").isNotNull() & F.col("invalidated_at_seq").isNull()
    a = a.withColumns({"swept": hit, "invalidated_at_seq": F.when(hit, seq).otherwise(F.col("invalidated_at_seq"))}).drop("gone")
    ids = a.where("swept").select("artifact_id").distinct()
    return a, touching_edges_leave(edges, ids, seq)


def touching_edges_leave(edges: DataFrame, ids: DataFrame, seq: int) -> DataFrame:
    """Live edges at one of the artifacts leave at ``seq``."""
    e = edges
    for end in ("from_artifact_id", "to_artifact_id"):
        e = e.join(ids.select(F.col("artifact_id").alias(end), F.lit(True).alias(f"g_{end}")), end, "left")
    touched = (F.col("g_from_artifact_id").isNotNull() | F.col("g_to_artifact_id").isNotNull()) & F.col("invalidated_at_seq").isNull()
    return e.withColumn("invalidated_at_seq", F.when(touched, seq).otherwise(F.col("invalidated_at_seq"))).select(*edges.columns)


def supersession_sweep(artifacts: DataFrame, changed: DataFrame, seq: int) -> DataFrame:
    """Live artifacts of changed sources from earlier builds leave at ``seq``."""
    a = artifacts.join(changed.select("source_id", F.lit(True).alias("hit")), "source_id", "left")
    old = F.col("hit").isNotNull() & F.col("invalidated_at_seq").isNull() & (F.col("valid_from_seq") < seq)
    return a.withColumn("invalidated_at_seq", F.when(old, seq).otherwise(F.col("invalidated_at_seq"))).drop("hit")


def acl_propagate(held: DataFrame, sources: DataFrame) -> DataFrame:
    """Artifacts whose access list differs from their source's, with the list to set."""
    j = held.join(sources.select("source_id", F.col("acl_teams").alias("wanted")), "source_id")
    return j.where(~(F.array_sort("acl_teams") == F.array_sort("wanted"))).select("artifact_id", F.array_join("wanted", ",").alias("acl"))


def edge_between(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Whether an extracted edge joins two artifacts, in either direction."""
    e = edges.where("trust_class = 'EXTRACTED'").select(F.least("from_artifact_id", "to_artifact_id").alias("a"), F.greatest("from_artifact_id", "to_artifact_id").alias("b")).distinct().withColumn("hit", F.lit(True))
    p = pairs.select("x", "y", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return p.join(e, ["a", "b"], "left").select("x", "y", F.coalesce("hit", F.lit(False)).alias("joined"))


def verify_evidence(claims: DataFrame, artifacts: DataFrame, sources: DataFrame, seq: int, teams: list[str]) -> DataFrame:
    """By claim: whether every cited id exists, is a member, isn't deleted and may be seen; and the reasons if not."""
    a = artifacts.join(sources.select("source_id", "is_deleted", "acl_teams"), "source_id").select(
        "artifact_id", access.member(seq).alias("member"), "is_deleted", access.visible(F.col("acl_teams"), teams).alias("seen"), F.lit(True).alias("exists")
    )
    j = claims.join(a, "artifact_id", "left")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("exists").isNull(), "unknown_id"), F.when(~F.coalesce("member", F.lit(False)) & F.col("exists"), "not_member"),
            F.when(F.col("is_deleted"), "deleted"), F.when(~F.coalesce("seen", F.lit(True)), "not_visible"),
        )
    )
    j = j.select("claim_id", reasons.alias("r"))
    return j.groupBy("claim_id").agg(F.bool_and(F.size("r") == 0).alias("passed"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("r")))), ",").alias("reasons"))

"""Access lists of artifacts, as their sources have them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def artifact_acl(artifacts: DataFrame, sources: DataFrame) -> DataFrame:
    return artifacts.select("artifact_id", "source_id").join(sources.select("source_id", "acl_teams"), "source_id").select("artifact_id", "acl_teams")


def visible_to(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows for each request that may see them: ``rows`` has acl_teams and request_id, ``requests`` request_id and teams."""
    j = rows.join(requests.select("request_id", "teams"), "request_id")
    return j.where((F.size("acl_teams") == 0) | F.arrays_overlap("acl_teams", "teams")).drop("teams")

"""Where plan modules register their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.registry import is_given, table, with_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: The version and the teams that queries ask for.
SEQ = 4
TEAMS = ["team_a"]
MEMBER = f"(valid_from_seq <= {SEQ} AND (invalidated_at_seq IS NULL OR invalidated_at_seq > {SEQ}))"
VISIBLE = "(len(acl_teams) = 0 OR list_has_any(acl_teams, ['team_a']))"


def add(name: str, tables: tuple[str, ...], run: Callable[..., DataFrame], sql: str | None) -> None:
    """Registers ``run(*tables)``; ``sql`` is a SELECT over the same tables, None where SQL can't state it."""
    if name in QUERIES:
        raise ValueError(f"{name} is there already")
    QUERIES[name] = lambda spark, sf_dir: run(*(table(spark, sf_dir, t) for t in tables))
    if sql is not None:
        own = [t for t in tables if not is_given(t)]
        SQL[name] = (with_tables(*own) if own else "WITH _none AS (SELECT 1) " if sql.startswith(",") else "") + sql

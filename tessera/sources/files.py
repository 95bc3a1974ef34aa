"""Files as tables: text trees by globs, and exported commit logs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders of tools, which no listing takes.
SKIPPED = (".git", "__pycache__", "node_modules", ".venv", ".mypy_cache", ".ruff_cache")


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob: ** spans folders, * and ? stay within one."""
    out, i = "^", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += "[^/]*" if glob[i] == "*" else "[^/]" if glob[i] == "?" else re.escape(glob[i])
            i += 1
    return out + "$"


def path_kept(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether a path matches any of the included globs and none of the excluded, and no part of it is hidden or a tool's."""
    any_of = lambda globs: F.lit(False) if not globs else path.rlike("|".join(map(glob_pattern, globs)))
    hidden = path.rlike("(^|/)(\\.[^/]*|" + "|".join(map(re.escape, SKIPPED)) + ")(/|$)")
    return any_of(include) & ~any_of(exclude) & ~hidden


def read_text_tree(spark: SparkSession, root: str, include: list[str], exclude: list[str] | None = None) -> DataFrame:
    """Rows (path, text) of the files below ``root`` that the globs keep, each file whole; the path is relative."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(base) + "/", "")
    return f.select(relative.alias("path"), F.col("content").cast("string").alias("text")).where(path_kept(F.col("path"), include, exclude or []))


def read_commit_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows (sha, subject, body, changed_files) of an exported log: records end in 1E, fields in 1F, files in line feeds.

    Missing fields are empty; changed files are sorted and each once.
    """
    t = spark.read.option("lineSep", "\x1e").text(path).where(F.trim(F.regexp_replace("value", "[\\r\\n]", "")) != "")
    f = F.split(F.regexp_replace("value", "^[\\r\\n]+", ""), "\x1f")
    at = lambda i: F.coalesce(F.get(f, F.lit(i)), F.lit(""))
    files = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(at(3), "\n"), F.trim), lambda x: x != "")))
    return t.select(F.trim(at(0)).alias("sha"), F.trim(at(1)).alias("subject"), F.trim(at(2)).alias("body"), files.alias("changed_files"))

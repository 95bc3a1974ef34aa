"""Quality rules: a table of thresholds compiled into one projection (operator 5).

``RULES`` is data: (name, numerator, denominator, comparison, threshold).  ``compile_rules`` turns
it into Spark columns; nothing runs outside the JVM and nothing is shuffled, so a document costs
the same wherever it lies and a hot source needs no care.

Defined results: a null or empty text has no words, all its counts are 0 and it fails the base
rules; a ratio over 0 counts as 0; repeated rows are judged one by one; extra columns stay as
they are in ``filter_quality`` and are dropped by ``quality_metrics``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, free_name, words_of

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on was be with as by this at from are or an "
    "de la le les des et en un une du que qui pour dans est pas sur au par "
    "der die und den von zu das mit sich auf ist im dem nicht ein eine als "
    "el los las y del se por con no su para al una lo"
).split()

#: name, numerator, denominator, comparison that a good text meets, threshold.
RULES = (
    ("min_words", "n_words", None, ">=", 10),
    ("max_repeated_words", "n_repeat_words", "n_words", "<=", 0.20),
    ("min_mean_word_length", "word_chars", "n_words", ">=", 1.5),
    ("max_mean_word_length", "word_chars", "n_words", "<=", 20.0),
    ("max_symbols_per_word", "n_symbols", "n_words", "<=", 0.30),
    ("min_stop_words", "n_stop_words", "n_words", ">=", 0.02),
    ("max_duplicate_lines", "n_dup_lines", "n_lines", "<=", 0.50),
)
BASE_RULES = ("min_words", "max_repeated_words")
WINDOW = 5


def _repeats(sites: Column) -> Column:
    """Starts of the windows whose hash comes twice or more, from (hash, start) sorted.  ``sites`` must be a plain column."""
    near = lambda s, k: F.coalesce(F.get(sites, k)["h"] == s["h"], F.lit(False))
    marked = F.transform(sites, lambda s, k: F.when(((k > 0) & near(s, k - 1)) | near(s, k + 1), s["i"]))
    return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))


def _covered(starts: Column) -> Column:
    gaps = F.transform(starts, lambda s, k: F.least(F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW)), F.lit(WINDOW)).cast("long"))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)


def quality_metrics(df: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The counts of every whole text, next to the columns in ``keep`` (all but the text by default).

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_stop_words, n_repeat_words (long).
    A column of the input with one of these names is replaced.
    """
    keep = [c for c in df.columns if c != text] if keep is None else list(keep)
    raw, words, lines, hashes, sites, starts = (free_name(df, n) for n in ("_t", "_w", "_l", "_h", "_x", "_s"))
    metrics = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_stop_words", "n_repeat_words")
    keep = [c for c in keep if c not in metrics]
    body = F.coalesce(F.col(text), F.lit(""))
    a = df.select(*keep, body.alias(raw), words_of(F.col(text)).alias(words))
    each = F.transform(F.col(words), lambda w: F.xxhash64(w))
    b = a.select(
        *keep,
        F.size(words).cast("long").alias("n_words"),
        F.length(F.regexp_replace(raw, SPACES, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(raw, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size(F.filter(F.col(words), lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.filter(F.split(raw, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias(lines),
        each.alias(words),
    )
    c = b.withColumn(
        hashes,
        F.when(
            F.size(words) >= WINDOW,
            F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(*(F.get(words, i + (j - 1)) for j in range(WINDOW)))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    # Only a text with a repeated window is sorted.
    found = F.sort_array(F.transform(F.col(hashes), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    c = c.withColumn(sites, F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), found).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    d = c.withColumn(starts, _repeats(F.col(sites)))
    return d.select(
        *keep,
        "n_words", "word_chars", "n_symbols",
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
        "n_stop_words",
        _covered(F.col(starts)).alias("n_repeat_words"),
    )


def _meets(numerator: str, denominator: str | None, comparison: str, threshold: float) -> Column:
    """One row of the table.  Ratios are compared by multiplying, so no division rounds."""
    left, right = F.col(numerator), F.lit(threshold)
    if denominator:
        whole = round(threshold * 100)
        left, right = F.col(numerator) * 100, F.col(denominator) * F.lit(whole)
    return left >= right if comparison == ">=" else left <= right


def compile_rules(rules=RULES) -> tuple[Column, Column]:
    """(failed a base rule, passes all rules) as two columns over the metrics."""
    failed = reduce(lambda a, b: a | b, (~_meets(*r[1:]) for r in rules if r[0] in BASE_RULES))
    passed = reduce(lambda a, b: a & b, (_meets(*r[1:]) for r in rules))
    return failed, passed


def judge(df: DataFrame, text: str = "text", rules=RULES, keep: Sequence[str] | None = None) -> DataFrame:
    """``quality_metrics`` with ``base_failed`` and ``kept``."""
    failed, passed = compile_rules(rules)
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("base_failed", "kept") and c != text]
    return quality_metrics(df, text, keep).withColumns({"base_failed": failed, "kept": passed & ~failed})


def filter_quality(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows that pass, with their columns as they came."""
    whole, body, mark = free_name(df, "_row"), free_name(df, "_text"), free_name(df, "_mark")
    packed = df.select(F.struct(*df.columns).alias(whole), F.col(text).alias(body))
    # The mark keeps the optimiser from pushing the filter below the projection that computes the
    # counts: pushed, their lambdas would evaluate whole columns again for every word.
    judged = judge(packed, body, rules, [whole]).withColumn(mark, F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col(mark) >= 0)).select(f"{whole}.*")

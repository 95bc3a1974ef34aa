"""Ledger metrics as streams: the same columns as the batch operators, on closed windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import StructType

from ..functions.text import normalize_query


def read_ledger_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The append-only ledger as a stream of Parquet files."""
    return spark.readStream.schema(schema).parquet(path)


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)


def _thin() -> Column:
    return (F.col("tool_name") == "kb_search") & (F.col("status") == "approved") & (F.coalesce(F.size("returned_artifact_ids"), F.lit(0)) <= 1)


def stream_health(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events, outcomes and thin answers in windows of a day; rows later than the watermark are dropped."""
    outcomes = (("approved", "approved"), ("reused", "reused"), ("denied", "denied"), ("needs_human_approval", "needs_human_approval"), ("error", "errors"))
    g = _timed(events, late).groupBy(F.window("created_at", "1 day")).agg(
        F.count("*").alias("events"), *(F.count_if(F.col("status") == s).alias(n) for s, n in outcomes),
        F.count_if((F.col("tool_name") == "kb_search") & (F.col("status") == "approved")).alias("kb_search_answered"), F.count_if(_thin()).alias("kb_search_zero_thin"),
    )
    return g.select(F.to_date("window.start").alias("day"), "events", *(n for _, n in outcomes), "kb_search_answered", "kb_search_zero_thin")


def stream_misses(events: DataFrame, days: int = 14, late: str = "1 day") -> DataFrame:
    """Searches that found one item at most, by normalised phrase in sliding windows of ``days``, a day apart."""
    phrase = normalize_query(F.substring(F.regexp_replace("query_text", "[\\x00-\\x1f\\x7f]", " "), 1, 80))
    e = _timed(events, late).where(_thin()).withColumn("phrase", phrase).where("phrase <> ''")
    g = e.groupBy("phrase", F.window("created_at", f"{days} days", "1 day")).agg(F.count("*").alias("misses"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))
    return g.select("phrase", F.to_date("window.end").alias("until"), "misses", "first_seen", "last_seen")


def stream_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Calls and tokens of each agent's sessions, which end after a gap."""
    g = _timed(events, late).groupBy("agent_name", F.session_window("created_at", gap)).agg(F.count("*").alias("calls"), F.sum("tokens_returned").alias("tokens"))
    return g.select("agent_name", F.col("session_window.start").alias("started_at"), "calls", "tokens")


def stream_exact_reuse(events: DataFrame, late: str = "1 day") -> DataFrame:
    """The first of equal queries of a run within the watermark."""
    return _timed(events, late).dropDuplicatesWithinWatermark(["run_id", "query_text"])


class _Budget(StatefulProcessor):
    """State of one run and agent: rows that the watermark hasn't passed, and what is used."""

    def __init__(self, max_calls: int, max_tokens: int, idle_ms: int):
        self.max_calls, self.max_tokens, self.idle_ms = max_calls, max_tokens, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long, retrieval_id string, tokens long")
        self.used = handle.getValueState("used", "calls long, tokens long, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        for f in rows:
            new = [(int(r.at), r.retrieval_id, int(r.tokens_returned)) for r in f.itertuples() if r.at >= passed]
            if new:
                self.held.appendList(new)
            # A row is decided once no earlier one can come: behind the millisecond that it stands in.
            for ms in {at // 1000 + 1 for at, _, _ in new}:
                self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.held.get()) if self.held.exists() else []
        calls, tokens, last = self.used.get() if self.used.exists() else (0, 0, 0)
        due = [r for r in rows if r[0] < passed]
        if not due:
            if not rows and self.used.exists() and last // 1000 + self.idle_ms < timerValues.getCurrentWatermarkInMs():
                self.used.clear()
            return
        out = []
        for at, retrieval_id, cost in due:
            allowed = calls < self.max_calls and tokens < self.max_tokens
            if allowed:
                calls, tokens = calls + 1, tokens + cost
            out.append((*key, retrieval_id, allowed))
            last = at
        if len(due) < len(rows):
            self.held.put(rows[len(due) :])
        else:
            self.held.clear()
        self.used.update((calls, tokens, last))
        self.handle.registerTimer(last // 1000 + self.idle_ms + 1)
        yield pd.DataFrame(out, columns=["run_id", "agent_name", "retrieval_id", "allowed"])

    def close(self) -> None:
        pass


def stream_budget(events: DataFrame, max_calls: int = 1, max_tokens: int = 4000, late: str = "1 day", idle_ms: int = 3_600_000) -> DataFrame:
    """Per run and agent, in order of time: a call is allowed while calls and tokens are under their caps; denied calls charge nothing.

    Order holds across micro-batches: rows wait in state until the watermark has passed them, then timers of
    event time decide them by time and id.  Rows later than the watermark are dropped; what a key has used
    is forgotten ``idle_ms`` of event time after its last row.  State lies in the RocksDB store
    (``spark.sql.streaming.stateStore.providerClass``); it is what the watermark leaves open.
    """
    timed = _timed(events, late).select("run_id", "agent_name", "retrieval_id", F.coalesce("tokens_returned", F.lit(0)).cast("long").alias("tokens_returned"), "created_at", F.unix_micros("created_at").alias("at"))
    return timed.groupBy("run_id", "agent_name").transformWithStateInPandas(
        _Budget(max_calls, max_tokens, idle_ms), "run_id string, agent_name string, retrieval_id string, allowed boolean", outputMode="Append", timeMode="EventTime"
    )

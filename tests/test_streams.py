"""Streams give on closed windows what batch gives, and replay the budget policy."""

import tempfile
import time

from pyspark.sql import functions as F

from tessera.operators import ledger, packs
from tessera.sources.registry import table
from tessera.streaming import ledger as streams

SF = "/root/testdata/sf0.001"


def run(spark, make, mode):
    where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    events = table(spark, SF, "retrieval_event").withColumn("created_at", F.col("created_at").cast("timestamp"))
    events.coalesce(1).write.parquet(f"{where}/ledger")
    stream = streams.read_ledger_stream(spark, f"{where}/ledger", events.schema)
    name = f"out_{abs(hash(where))}"
    q = make(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return events, spark.table(name)


def test_stream_health_equals_batch(spark):
    events, out = run(spark, streams.stream_health, "complete")
    cols = ["day", "events", "approved", "reused", "denied", "needs_human_approval", "errors", "kb_search_answered", "kb_search_zero_thin"]
    assert sorted(map(tuple, out.select(cols).collect())) == sorted(map(tuple, ledger.retrieval_health_daily(events).select(cols).collect()))


def test_stream_budget_in_order_of_time_across_batches(spark):
    """Three files in no order, then one event that moves the watermark past all others."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    events = table(spark, SF, "retrieval_event").withColumn("created_at", F.col("created_at").cast("timestamp")).where("agent_name < 'agent_2'")
    try:
        for i in range(3):
            events.where(F.pmod(F.xxhash64("retrieval_id"), F.lit(3)) == i).orderBy(F.rand(i)).coalesce(1).write.mode("append").parquet(f"{where}/ledger")
            time.sleep(1.1)
        last = events.limit(1).withColumns({"created_at": F.lit("2100-01-01").cast("timestamp"), "run_id": F.lit("closing"), "retrieval_id": F.lit("closing")})
        last.coalesce(1).write.mode("append").parquet(f"{where}/ledger")
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/ledger")
        out = streams.stream_budget(stream, 2, 100, late="4000 days", idle_ms=10**12)
        name = f"out_{abs(hash(where))}"
        out.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination(300)
        got = {r["retrieval_id"]: r["allowed"] for r in spark.table(name).collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = {r["retrieval_id"]: r["allowed"] for r in packs.kb_budget_replay(events, 2, 100).collect()}
    assert got == want and len(set(want.values())) == 2


def test_stream_exact_reuse_keeps_the_first_of_a_run(spark):
    events, out = run(spark, streams.stream_exact_reuse, "append")
    got = sorted((r["run_id"], r["query_text"]) for r in out.collect())
    assert got == sorted({(r["run_id"], r["query_text"]) for r in events.collect()})


def test_stream_sessions_equal_batch(spark):
    events, out = run(spark, lambda s: streams.stream_sessions(s, "6 hours"), "complete")
    told, last = {}, {}
    for r in sorted(events.collect(), key=lambda r: r["created_at"]):
        a, t = r["agent_name"], r["created_at"]
        if a not in last or (t - last[a][1]).total_seconds() >= 6 * 3600:
            last[a] = (t, t)
        last[a] = (last[a][0], t)
        calls, tokens = told.get((a, last[a][0]), (0, 0))
        told[a, last[a][0]] = (calls + 1, tokens + r["tokens_returned"])
    assert {(r["agent_name"], r["started_at"]): (r["calls"], r["tokens"]) for r in out.collect()} == told


def test_stream_misses_slide(spark):
    events, out = run(spark, streams.stream_misses, "complete")
    batch = ledger.miss_groups(events, 13)
    last = events.agg(F.max(F.to_date("created_at"))).first()[0]
    got = {r["phrase"]: r["misses"] for r in out.where(F.date_sub("until", 1) == F.lit(last)).collect()}
    told = {r["phrase"]: r["misses"] for r in ledger.miss_groups(events.where(F.to_date("created_at") > F.date_sub(F.lit(last), 14)), 14).collect()}
    assert got == told and batch.count() > 0

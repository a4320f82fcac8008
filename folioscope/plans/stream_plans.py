"""Structured Streaming (T), each against its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.plans.registry import query
from folioscope.plans.sql_parts import CHUNKS
from folioscope.session import scratch_path
from folioscope.streaming import ingest, live, timers


@query("feedback_stream", """
WITH v AS (SELECT user_id, arg_min(event_type, (ts, event_id)) AS event_type, arg_min(ts, (ts, event_id)) AS ts
  FROM events WHERE event_type IN ('click', 'error') GROUP BY user_id)
SELECT date_trunc('day', ts)::TIMESTAMP AS day, CASE event_type WHEN 'click' THEN 'like' ELSE 'dislike' END AS vote, count(*) AS n FROM v GROUP BY ALL""")
def _feedback(spark, sf):
    """A user's events are votes on one response. Votes that the watermark has passed come from the stream, the others from its state."""
    rated = live.read_files(spark, sf, "events.parquet").filter("event_type in ('click', 'error')")
    votes = rated.select("ts", F.col("event_id").alias("tie"), F.col("user_id").alias("response_id"),
                         F.when(F.col("event_type") == "click", "like").otherwise("dislike").alias("vote"))
    path = scratch_path(spark, "feedback-stream")
    timers.drain(timers.first_votes(votes, memory_days=365), path)
    counted = spark.read.schema(timers.VOTE).parquet(f"{path}/out").unionByName(timers.open_votes(spark, path))
    return counted.groupBy(F.date_trunc("day", "ts").alias("day"), "vote").agg(F.count(F.lit(1)).alias("n"))


_INGESTED = f"WITH {CHUNKS} SELECT doc_id, source, lang, chunk_index, chunk_text, chunk_id FROM chunks"


def _document_stream(spark, sf):
    return live.read_files(spark, sf, "documents.parquet").select("doc_id", "source", "lang", "text")


@query("ingest_stream", _INGESTED)
def _ingest(spark, sf):
    path = scratch_path(spark, "ingest-stream")
    ingest.ingest(_document_stream(spark, sf), path)
    return ingest.read_index(spark, path).drop("content_hash")


@query("reingest_stream", _INGESTED)
def _reingest(spark, sf):
    """The documents arrive over an index of earlier states: some with another text, some that were deleted since, the rest alike."""
    path = scratch_path(spark, "reingest-stream")
    i = F.col("doc_id")
    earlier = F.when(i % 3 == 0, F.concat(F.lit("Draft. "), F.reverse("text"))).when(i % 7 != 0, F.col("text"))
    ingest.ingest(_document_stream(spark, sf).withColumn("text", earlier), path, "drafts")
    ingest.ingest(_document_stream(spark, sf), path)
    return ingest.read_index(spark, path).drop("content_hash")


@query("last_used", "SELECT user_id AS document, max(ts)::TIMESTAMP AS last_used FROM events GROUP BY 1")
def _last_used(spark, sf):
    events = live.read_files(spark, sf, "events.parquet").select(F.col("user_id").alias("document"), F.col("ts").cast("timestamp").alias("ts"))
    path = scratch_path(spark, "last-used-stream")
    live.drain_batches(live.last_used(events), path, mode="update")
    rows = live.read_batches(spark, path, "document long, last_used timestamp, batch int")
    return rows.groupBy("document").agg(F.max("last_used").alias("last_used"))


@query("session_documents", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
e AS (SELECT user_id, min(ts)::TIMESTAMP AS opened, (max(ts) + INTERVAL 30 MINUTE)::TIMESTAMP AS closed, count(*) AS n FROM s GROUP BY user_id, k)
SELECT * FROM e""")
def _sessions(spark, sf):
    """Closed sessions come from the stream, those still open when the events end from its state."""
    path = scratch_path(spark, "session-stream")
    timers.drain(timers.expiring_sessions(live.read_files(spark, sf, "events.parquet").select("ts", "user_id")), path)
    every = spark.read.schema(timers.SESSION).parquet(f"{path}/out").unionByName(timers.open_sessions(spark, path))
    return every.withColumn("user_id", F.col("user_id").cast("bigint"))

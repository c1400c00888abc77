"""Event traces, as batches and as a stream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import trace
from tessera.sources import views as v
from tessera.sources.store import folder
from tessera.streaming import streams

from .registry import query


@query(f"WITH {v.TRACES} SELECT event_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY run))::BIGINT AS elapsed_us FROM traces")
def trace_elapsed(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return v.traces(spark, d).select("event_id", (us - F.min(us).over(Window.partitionBy("run"))).alias("elapsed_us"))


DONE = v.TRACE_EVENTS + """, ended AS (SELECT run, min({'at': "at", 'seq': seq}) AS last FROM trace_events WHERE node IS NULL GROUP BY run),
  until_done AS (SELECT trace_events.* FROM trace_events LEFT JOIN ended USING (run) WHERE last IS NULL OR {'at': "at", 'seq': seq} <= last)"""


def events(spark, d):
    return v.trace_events(v.attempts(v.table(spark, d, "events")))


@query(f"""WITH {v.TRACE_EVENTS}, s AS (SELECT run, node, attempt, min("at") FILTER (status = 'started') AS first, min({{'at': "at", 'seq': seq, 'status': status}}) FILTER (status IN ('completed', 'failed')) AS last
  FROM trace_events WHERE node IS NOT NULL GROUP BY ALL) SELECT run, node, attempt, coalesce(last.status, 'open') AS status, last.at - first AS duration_us FROM s""")
def node_spans(spark, d):
    return trace.node_spans(events(spark, d))


@query(f"""WITH {DONE}, s AS (SELECT run, min({{'at': "at", 'seq': seq, 'status': status}}) FILTER (node IS NULL) AS last, min("at") AS first, count(*) AS n FROM until_done GROUP BY run)
  SELECT run, coalesce(last.status, 'running') AS status, (last.at - first) // 1000 AS total_ms, n FROM s""")
def run_status(spark, d):
    return trace.run_status(events(spark, d))


_COUNTERS = f"""WITH {v.TRACE_EVENTS} SELECT run, count(*) FILTER (status = 'retrying') AS retries, count(*) FILTER (status = 'completed') AS completed, CASE WHEN count(*) > count(node) THEN 100
  ELSE least(95, floor(100 * count(*) FILTER (status = 'completed') / greatest(count(node), 1) + 0.5)) END::BIGINT AS progress FROM trace_events GROUP BY run"""


@query(_COUNTERS)
def trace_counters(spark, d):
    return trace.counters(events(spark, d))


@query(f"WITH {v.TRACES} SELECT event_id, node FROM traces WHERE run = 5 ORDER BY ts, event_id")
def audit_for_run(spark, d):
    return v.traces(spark, d).where("run = 5").orderBy("ts", "event_id").select("event_id", "node")


@query(_COUNTERS)
def stream_trace_counters(spark, d):
    """The same counts kept by a stream over the events' files, run until all are read."""
    return streams.stream_counters(v.trace_events(streams.source(spark, d, "events")), folder(spark, "counters"))


@query(f"""WITH {DONE} SELECT run, seq, node, status, "at" FROM until_done WHERE "at" // 1000 < (SELECT max("at") // 1000 FROM trace_events) - 86400000""")
def stream_until_done(spark, d):
    """What has been forwarded when all files are read: events of the last day may still be
    overtaken by others that are late, so they wait."""
    e = streams.source(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.stream_until_done(v.trace_events(e), folder(spark, "until-done"))


@query("SELECT role AS model, sum(length(text) // 4)::BIGINT AS tokens FROM conversations GROUP BY role")
def token_usage(spark, d):
    return v.table(spark, d, "conversations").groupBy(F.col("role").alias("model")).agg(F.sum(F.floor(F.length("text") / 4)).alias("tokens"))

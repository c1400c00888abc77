"""Spans, status and progress of runs from their events (run, seq, node, attempt, status, at).

A node's event is started, completed, failed or retrying; a run's terminal event has no
node, and the status ok or error. ``at`` counts microseconds; order is by (at, seq).
All are aggregates per run or span, combined before the shuffle; other columns are unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def until_done(events: DataFrame) -> DataFrame:
    """The events of each run up to its first terminal one; all of a run without one. Later
    ones are dropped. Repeated rows stay."""
    last = events.where("node is null").groupBy(F.col("run").alias("ended")).agg(F.min(F.struct("at", "seq")).alias("last"))
    j = events.join(last, F.col("run").eqNullSafe(F.col("ended")), "left")
    return j.where(F.col("last").isNull() | (F.struct("at", "seq") <= F.col("last"))).select(*events.columns)


def node_spans(events: DataFrame) -> DataFrame:
    """(run, node, attempt, status, duration_us): a start paired with the first completed or
    failed event of its run, node and attempt. A span that none has ended is open, with no
    duration; nor has one that lacks its start. Retrying events end nothing."""
    start = F.min(F.when(F.col("status") == "started", F.col("at")))
    end = F.min(F.when(F.col("status").isin("completed", "failed"), F.struct("at", "seq", "status")))
    s = events.where("node is not null").groupBy("run", "node", "attempt").agg(start.alias("start"), end.alias("end"))
    return s.select("run", "node", "attempt", F.coalesce("end.status", F.lit("open")).alias("status"), (F.col("end.at") - F.col("start")).alias("duration_us"))


def run_status(events: DataFrame) -> DataFrame:
    """(run, status, total_ms, n): ok or error by the run's first terminal event, else running;
    whole milliseconds from the first event to that one, null while it runs; and how many
    events there are up to it."""
    end = F.min(F.when(F.col("node").isNull(), F.struct("at", "seq", "status")))
    s = until_done(events).groupBy("run").agg(end.alias("end"), F.min("at").alias("first"), F.count("*").alias("n"))
    return s.select("run", F.coalesce("end.status", F.lit("running")).alias("status"), F.floor((F.col("end.at") - F.col("first")) / 1000).alias("total_ms"), "n")


def counters(events: DataFrame) -> DataFrame:
    """(run, retries, completed, progress): progress is the share of completed ones among a
    run's events in whole per cent, at most 95 while it runs, 100 once it has ended."""
    of = lambda s: F.count_if(F.coalesce(F.col("status") == s, F.lit(False)) & F.col("node").isNotNull())
    s = events.groupBy("run").agg(of("retrying").alias("retries"), of("completed").alias("completed"), F.count("node").alias("n"), F.count_if(F.col("node").isNull()).alias("ends"))
    return with_progress(s)


def with_progress(counts: DataFrame) -> DataFrame:
    """(run, retries, completed, progress) of counts (run, retries, completed, n, ends)."""
    share = F.floor(F.col("completed") * 100 / F.greatest("n", F.lit(1)) + 0.5)
    return counts.select("run", "retries", "completed", F.when(F.col("ends") > 0, F.lit(100).cast("long")).otherwise(F.least(share, F.lit(95).cast("long"))).alias("progress"))

"""Structured Streaming over the tables' files; each run ends when all files are read, and
the next one with the same folder goes on with the files that are new by then."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.trace import with_progress
from tessera.operators.verify import folded_hits, judge_claims
from tessera.sources.store import folder, listed, written

HOUR = 3_600_000  # milliseconds


def source(spark: SparkSession, d: str, table: str, files_at_once: int | None = None) -> DataFrame:
    static = spark.read.parquet(f"{d}/{table}.parquet")
    reader = spark.readStream.schema(static.schema)
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).parquet(f"{d}/{table}.parquet*")


def run_to_end(df: DataFrame, at: str, mode: str = "append") -> None:
    """Appends each batch once: a batch that is tried again overwrites its own folder."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    df.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries that start inside keep their state in RocksDB, which timers need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Each content once, however often it arrives. State is one hash for each content."""
    at = folder(spark, "dedup")
    run_to_end(source(spark, d, "documents").select(F.sha2("text", 256).alias("content_hash"), "doc_id").dropDuplicates(["content_hash"]), at)
    return spark.read.parquet(f"{at}/out")


def timed(events: DataFrame, delay_ms: int) -> DataFrame:
    return events.withColumn("time", F.timestamp_micros("at")).withWatermark("time", f"{delay_ms} milliseconds")


EVENTS = "run string, seq long, node string, status string, at long"


def bytes_of(rows: pd.DataFrame) -> bytes:
    out = pa.BufferOutputStream()
    t = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(out, t.schema) as w:
        w.write_table(t)
    return out.getvalue().to_pybytes()


def rows_of(state) -> pd.DataFrame | None:
    return pa.ipc.open_stream(bytes(state.get()[0])).read_all().to_pandas() if state.exists() else None


class UntilDone(StatefulProcessor):
    """Holds events back until none that is older can come, then forwards each run's in
    order up to the terminal one. What a run is known by goes ``keep`` ms after its end.

    A key is a bucket of runs, whose events are told apart by columns: a call for each run
    costs over a millisecond, however few events it has."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "rows binary")
        self.done = handle.getValueState("done", "rows binary")  # runs, and until when they are known

    def _hold(self, state, rows: pd.DataFrame) -> None:
        state.update((bytes_of(rows),)) if len(rows) else state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([part[["run", "seq", "node", "status", "at"]] for part in rows], ignore_index=True)
        done = rows_of(self.done)
        if done is not None:
            # rows come before timers, so the time of some may be over already
            new = new[~new["run"].isin(done["run"][done["until"] > timerValues.getCurrentWatermarkInMs()])]
        if len(new):
            held = rows_of(self.waiting)
            self._hold(self.waiting, new if held is None else pd.concat([held, new], ignore_index=True))
            self.handle.registerTimer(int(new["at"].min()) // 1000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        done, held = rows_of(self.done), rows_of(self.waiting)
        left = None if done is None else done[done["until"] > now]
        ready = None
        if held is not None:
            old = held["at"] // 1000 < now
            ready = held[old].sort_values(["run", "at", "seq"], kind="stable")
            end = ready["node"].isna()
            ended = ready["run"][end].unique()
            # how many ends of the run come before
            before = end.astype("int64").groupby(ready["run"]).cumsum() - end
            ready = ready[before == 0]
            later = held[~old & ~held["run"].isin(ended)]
            if old.any():
                self._hold(self.waiting, later)
            if len(later):
                self.handle.registerTimer(int(later["at"].min()) // 1000)
            if len(ended):
                known = pd.DataFrame({"run": ended, "until": now + self.keep})
                left = known if left is None else pd.concat([left, known], ignore_index=True)
        if left is not None:
            self._hold(self.done, left)
            if len(left):
                self.handle.registerTimer(int(left["until"].min()))
        if ready is not None and len(ready):
            yield ready.reset_index(drop=True)

    def close(self) -> None:
        pass


def stream_until_done(events: DataFrame, at: str, delay_ms: int = 24 * HOUR, keep_ms: int = 24 * HOUR, buckets: int = 1024) -> DataFrame:
    """(run, seq, node, status, at) of a stream of events: each run's in order of (at, seq) up
    to its first terminal one, however they are dealt over batches.

    An event may be up to ``delay_ms`` late: it waits that long, and what comes later
    is dropped. A run's state goes ``keep_ms`` after its end, so ids of runs must not be used
    again sooner; a run that never ends holds only what still waits. Runs must not be null.
    Runs are dealt over ``buckets``, each of which has its events in memory at one time.
    """
    spark = events.sparkSession
    dealt = timed(events.select("run", "seq", "node", "status", "at"), delay_ms).withColumn("bucket", F.pmod(F.xxhash64("run"), F.lit(buckets)))
    out = dealt.groupBy("bucket").transformWithStateInPandas(UntilDone(keep_ms), EVENTS, "Append", "EventTime")
    with rocksdb(spark):
        run_to_end(out, at)
    return spark.read.schema(EVENTS).parquet(*[f"{at}/out/{x}" for x in listed(spark, f"{at}/out")])


def stream_counters(events: DataFrame, at: str, delay_ms: int = 24 * HOUR, keep_ms: int = 24 * HOUR) -> DataFrame:
    """(run, retries, completed, progress) of a stream of events, as ``operators.trace.counters``
    counts them. A run's counts are kept by windows of ``keep_ms``; a batch writes those that
    it changes, and the last of each window are added up. A window's counts leave the state
    when no event of it can come any more, but not what was written."""
    spark, n = events.sparkSession, ("retries", "completed", "n", "ends")
    e, own = timed(events.select("run", "node", "status", "at"), delay_ms), F.col("node").isNotNull()
    of = lambda s: F.count_if(F.coalesce(F.col("status") == s, F.lit(False)) & own)
    counts = (of("retrying").alias("retries"), of("completed").alias("completed"), F.count("node").alias("n"), F.count_if(~own).alias("ends"))
    out = e.groupBy("run", F.window("time", f"{keep_ms} milliseconds")).agg(*counts).select("run", F.unix_millis("window.start").alias("start"), *n)
    with rocksdb(spark):
        run_to_end(out, at, "update")
    rows = spark.read.schema(f"run string, start long, {', '.join(f'{c} long' for c in n)}, batch long").option("basePath", f"{at}/out").parquet(f"{at}/out")
    last = rows.groupBy("run", "start").agg(F.max_by(F.struct(*n), "batch").alias("x"))
    return with_progress(last.groupBy("run").agg(*[F.sum(f"x.{c}").alias(c) for c in n]))


def stream_verify(claims: DataFrame, hits: DataFrame, at: str) -> DataFrame:
    """Claims judged as they arrive, against what their run had retrieved when the stream
    began: the hits are folded once, and every batch joins that table. The file sink
    commits each batch once. Repeated claims are judged each, as in a batch."""
    spark = claims.sparkSession
    folded = folded_hits(hits)
    folded = spark.read.schema(folded.schema).parquet(f"{at}/hits") if "_SUCCESS" in listed(spark, f"{at}/hits") else written(folded, f"{at}/hits")
    judged = judge_claims(claims, folded)
    q = judged.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    q.start().awaitTermination()
    return spark.read.schema(judged.schema).parquet(f"{at}/out")

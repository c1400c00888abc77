"""Streams over files that arrive in several batches."""

import random

from tessera.operators import trace
from tessera.operators.chunking import chunk_documents
from tessera.operators.verify import verify_claims
from tessera.sources.store import Tables
from tessera.streaming import ingest, streams

EVENT = "run string, seq long, node string, attempt int, status string, at long"
HOUR = 3_600_000_000  # microseconds


def put(spark, rows, kind, at):
    spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{at}/x.parquet")


def read(spark, at, kind):
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{at}/x.parquet")


def runs(n=60, seed=1):
    r, out = random.Random(seed), []
    for k in range(n):
        at, end = r.randrange(100) * HOUR, r.choice([None, 3, 6])
        for i in range(r.randrange(1, 10)):
            at += r.randrange(HOUR // 4)
            out.append((f"r{k}", k * 100 + i, None if i == end else r.choice("ab"), 1, "ok" if i == end else r.choice(["started", "completed", "failed", "retrying"]), at))
    return out


def test_until_done_keeps_order_over_batches(spark, tmp_path):
    """Events come up to two hours late, in batches that split runs."""
    rows = runs()
    arrival = sorted(rows, key=lambda x: x[5] + random.Random(x[1]).randrange(2 * HOUR))
    arrival.append(("last", 10**6, "a", 1, "started", 1000 * HOUR))
    for i in range(0, len(arrival), 60):
        put(spark, arrival[i : i + 60], EVENT, tmp_path)
    out = streams.stream_until_done(read(spark, tmp_path, EVENT), f"{tmp_path}/s", delay_ms=2 * streams.HOUR, keep_ms=5 * streams.HOUR)
    got = sorted((r.run, r["at"], r.seq, r.node, r.status) for r in out.collect())
    want = []
    for run in {x[0] for x in rows}:
        for x in sorted((y for y in rows if y[0] == run), key=lambda y: (y[5], y[1])):
            want.append((run, x[5], x[1], x[2], x[4]))
            if x[2] is None:
                break
    assert got == sorted(want)
    batch = trace.until_done(spark.createDataFrame(rows, EVENT))
    assert sorted((r.run, r["at"], r.seq, r.node, r.status) for r in batch.collect()) == sorted(want)


def test_state_of_an_ended_run_goes(spark, tmp_path):
    """Long after its end a run's id is as good as new; before, its events stay dropped."""
    for row in [("x", 1, None, 1, "ok", 10 * HOUR), ("y", 2, "a", 1, "started", 30 * HOUR), ("x", 3, "a", 1, "started", 31 * HOUR), ("y", 4, "a", 1, "failed", 90 * HOUR), ("x", 5, "b", 1, "started", 95 * HOUR), ("y", 6, "a", 1, "failed", 200 * HOUR)]:
        put(spark, [row], EVENT, tmp_path)
    out = streams.stream_until_done(read(spark, tmp_path, EVENT), f"{tmp_path}/s", delay_ms=streams.HOUR, keep_ms=40 * streams.HOUR)
    assert sorted(r.seq for r in out.collect()) == [1, 2, 4, 5]


def test_counters_over_batches_and_again(spark, tmp_path):
    rows = runs()
    # a run is heard of within the time that its state is kept
    for i in range(0, len(rows), 50):
        put(spark, rows[i : i + 50], EVENT, tmp_path)
    go = lambda: {tuple(r) for r in streams.stream_counters(read(spark, tmp_path, EVENT), f"{tmp_path}/s", delay_ms=500 * streams.HOUR).collect()}
    plain = lambda rows: {tuple(r) for r in trace.counters(spark.createDataFrame(rows, EVENT)).collect()}
    assert go() == plain(rows)
    more = [("r1", 9001, "a", 1, "completed", 150 * HOUR), ("new", 9002, None, 1, "error", 150 * HOUR)]
    put(spark, more, EVENT, tmp_path)
    assert go() == plain(rows + more)


def test_runs_of_one_bucket_are_told_apart(spark, tmp_path):
    rows = [(f"r{k}", k * 10 + i, None if i == 2 else "a", 1, "ok", (k % 7 + i + 1) * HOUR) for k in range(500) for i in range(4)]
    for i in range(2):
        put(spark, rows[i::2] + [("last", 10**6 + i, "a", 1, "started", (20 + 30 * i) * HOUR)], EVENT, tmp_path)
    out = streams.stream_until_done(read(spark, tmp_path, EVENT), f"{tmp_path}/s", delay_ms=30 * streams.HOUR, buckets=1)
    assert sorted((r.run, r.seq) for r in out.collect()) == sorted((x[0], x[1]) for x in rows if x[1] % 10 < 3)


def test_counts_outlive_their_state(spark, tmp_path):
    """A run that is heard of again long after goes on from what was counted."""
    for row in [("x", 1, "a", 1, "completed", 10 * HOUR), ("y", 2, "a", 1, "started", 900 * HOUR), ("y", 3, "a", 1, "retrying", 901 * HOUR), ("x", 4, "a", 1, "completed", 902 * HOUR)]:
        put(spark, [row], EVENT, tmp_path)
    out = streams.stream_counters(read(spark, tmp_path, EVENT), f"{tmp_path}/s", delay_ms=streams.HOUR, keep_ms=5 * streams.HOUR)
    assert {tuple(r) for r in out.collect()} == {("x", 0, 2, 95), ("y", 1, 0, 0)}


DOC = "doc_id long, source_ref string, text string"


def ruling(k, to, words="and so it goes on for quite a while in every hall of every ward of the town "):
    return (k, f"SCC-1988-1-{k}", f"Ruling {k} says {words * 3}(1988) 1 SCC {to}")


def state(t):
    docs = {r.doc_id: (r.source_ref, r.content_hash) for r in t.read("documents").collect()}
    return docs, {(r.source_id, r.target_ref, r.target_id) for r in t.read("edges").collect()}, sorted((r.doc_id, r.ordinal, r.content) for r in t.read("chunks").collect())


def test_ingest_of_new_changed_and_late_documents(spark, tmp_path):
    first = [ruling(k, (k * 3) % 40) for k in range(1, 20)]
    put(spark, first, DOC, tmp_path)
    t = ingest.stream_ingest(read(spark, tmp_path, DOC), f"{tmp_path}/c", parts=5)
    _, edges, _ = state(t)
    assert edges == {(k, f"SCC-1988-1-{(k * 3) % 40}", (k * 3) % 40 if 0 < (k * 3) % 40 < 20 and k * 3 % 40 != k else None) for k in range(1, 20)}
    # 21 to 39 arrive, 3 changes and 4 comes again as it was, null and repeated rows come along
    second = [ruling(k, k) for k in range(21, 40)] + [(3, "SCC-1988-1-3", "Another text altogether, much shorter."), first[3], first[3], (None, "x", "y"), (50, None, None)]
    put(spark, second, DOC, tmp_path)
    t = ingest.stream_ingest(read(spark, tmp_path, DOC), f"{tmp_path}/c", parts=5)
    docs, edges, chunks = state(t)
    now = {k: x for k, *x in first + second[:19]} | {3: ("SCC-1988-1-3", second[19][2]), 50: (None, "")}
    assert set(docs) == set(now)
    # an edge to a document that came late has its target, one to the document itself none
    assert all(target == (int(ref.rsplit("-", 1)[1]) if int(ref.rsplit("-", 1)[1]) in now and int(ref.rsplit("-", 1)[1]) != k else None) for k, ref, target in edges)
    assert {(k, r) for k, r, _ in edges} == {(k, f"SCC-1988-1-{(k * 3) % 40}") for k in range(1, 20)} | {(k, f"SCC-1988-1-{k}") for k in range(21, 40)}
    flat = spark.createDataFrame([(k, x[1]) for k, x in now.items()], "doc_id long, text string")
    assert chunks == sorted((r.doc_id, r.ordinal, r.content) for r in chunk_documents(flat).collect())
    # the same documents from another stream change nothing
    before = t.manifest(t.last())
    t = ingest.stream_ingest(spark.readStream.schema(DOC).parquet(f"{tmp_path}/x.parquet").where("doc_id <> 3"), f"{tmp_path}/c", parts=5, source="again")
    after = t.manifest(t.last())
    assert {k: v for k, v in before.items() if k != "sources"} == {k: v for k, v in after.items() if k != "sources"} and state(t)[:2] == (docs, edges)


def test_only_touched_partitions_are_written_and_a_batch_counts_once(spark, tmp_path):
    t = ingest.tables(spark, str(tmp_path), parts=8)
    frame = lambda rows: spark.createDataFrame(rows, DOC)
    ingest.ingest(t, frame([ruling(k, 99) for k in range(30)]), 0)
    ingest.ingest(t, frame([ruling(500, 98)]), 1)
    held = t.manifest(t.last())
    assert [list(held[x].values()).count(1) for x in ("documents", "chunks", "edges")] == [1, 1, 1]
    ingest.ingest(t, frame([ruling(501, 97)]), 1)  # the batch is there already
    ingest.ingest(t, frame([]), 2)
    assert t.read("documents").count() == 31 and t.last() == 2 and t.has("stream", 2) and not t.has("other", 0)


def test_tables_before_a_commit(spark, tmp_path):
    t = Tables(spark, f"{tmp_path}/none", {"a": "x long"})
    assert t.read("a").count() == 0 and t.last() == -1


def test_claims_are_judged_as_they_arrive(spark, tmp_path):
    kind = "run long, chunk_id string, quote string, other string"
    hits = spark.createDataFrame([(1, "c1", "The quick brown fox jumps over it."), (1, "c1", "Zzz"), (2, None, "four words are here"), (None, "c1", "x")], "run long, chunk_id string, content string")
    rows = [(1, " c1", "quick brown fox jumps", "a"), (1, "c2", "quick brown fox jumps", "b"), (None, "c1", "x y z w", "c"), (1, None, None, "d"), (1, "c1", "", "e")]
    for row in rows + rows[:1]:
        put(spark, [row], kind, tmp_path)
    go = lambda: sorted(map(str, streams.stream_verify(read(spark, tmp_path, kind), hits, f"{tmp_path}/v").collect()))
    plain = lambda rows: sorted(map(str, verify_claims(spark.createDataFrame(rows, kind), hits).collect()))
    assert go() == plain(rows + rows[:1])
    put(spark, rows[2:4], kind, tmp_path)
    assert go() == plain(rows + rows[:1] + rows[2:4])

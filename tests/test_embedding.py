"""Encoding in batches, reuse of vectors and refilling."""

from dataclasses import dataclass

from pyspark.sql import functions as F

from tessera.operators import embedding as e
from tessera.functions.text import content_key

ROWS = "chunk_id string, content string, part int"


@dataclass(frozen=True)
class Spy:
    """Tells in each vector how long its batch was and how the lengths spread in it."""

    model: str = "spy"

    def load(self):
        return self

    def encode(self, texts):
        n = [len(t) for t in texts]
        return [[float(len(t)), float(len(texts)), float(max(n) - min(n))] for t in texts]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, ROWS).repartition(parts)


def test_batches_are_of_like_lengths_and_rows_keep_their_vectors(spark):
    rows = [(f"c{i}", None if i % 50 == 7 else "x" * (i * 37 % 500), i % 4) for i in range(1000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = {r.chunk_id: r.embedding for r in e.embed_batches(frame(spark, rows, 1), Spy(), batch=32, window=500).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k, t, _ in rows:
        assert (got[k] is None) == (t is None) and (t is None or got[k][0] == len(t))
    full = [v for v in got.values() if v]
    assert max(v[1] for v in full) == 32 and sum(v[1] == 32 for v in full) > 0.9 * len(full)
    assert max(v[2] for v in full) < 60


def test_hash_encoder(spark):
    v = e.HashEncoder().encode(["a a b", "", "  ", "é"])
    assert abs(sum(x * x for x in v[0]) - 1) < 1e-9 and v[1] is None and v[2] is None and v[3] is not None
    assert e.embed_batches(frame(spark, []), e.HashEncoder()).count() == 0


def test_each_text_is_encoded_once(spark):
    rows = [("a", "one", 1), ("b", "one", 1), ("c", None, 1), ("d", "three", 1), ("e", "", 1)]
    key = lambda m, t: content_key(F.lit(m), F.lit(t))
    cache = spark.range(1).select(key("spy", "three").alias("key"), F.array(F.lit(9.0).cast("float")).alias("embedding"))
    cache = cache.union(spark.range(2).select(key("other", "one"), F.array(F.lit(8.0).cast("float"))))
    got = {r.chunk_id: r.embedding for r in e.embed_distinct(frame(spark, rows, 1), Spy(), cache).collect()}
    assert got["d"] == [9.0] and got["c"] is None and got["a"] == got["b"] == [3.0, 2.0, 3.0] and got["e"][1] == 2
    assert e.embed_distinct(frame(spark, rows, 1), Spy()).where("embedding is not null").count() == 4


def test_refill_goes_on_where_it_stopped(spark, tmp_path):
    rows = [(f"c{i}", None if i == 5 else f"text {i}", i % 6) for i in range(60)]
    chunks, at = frame(spark, rows), f"{tmp_path}/v"
    old = chunks.where("part < 3").select("chunk_id", F.lit("old").alias("model"), F.array(F.lit(1.0).cast("float")).alias("embedding"), "part")
    old.write.partitionBy("part").parquet(at)
    first = e.reembed_corpus(chunks, at, Spy(), at_once=2, rounds=1)
    assert first == [{"parts": [0, 1], "done": 20, "total": 60}]
    there = spark.read.parquet(at)
    assert {(r.part, r.model) for r in there.select("part", "model").distinct().collect()} == {(0, "spy"), (1, "spy"), (2, "old")}
    assert [p["done"] for p in e.reembed_corpus(chunks, at, Spy(), at_once=2)] == [40, 60]
    got = {r.chunk_id: (r.model, r.embedding and r.embedding[0]) for r in spark.read.parquet(at).collect()}
    assert got == {k: ("spy", t and float(len(t))) for k, t, _ in rows}
    # nothing is left; a new chunk is the only one that is encoded
    assert e.reembed_corpus(chunks, at, Spy()) == []
    more = chunks.union(spark.createDataFrame([("new", "x", 3)], ROWS))
    assert e.reembed_corpus(more, at, Spy()) == [{"parts": [3], "done": 61, "total": 61}]
    assert spark.read.parquet(at).count() == 61
    assert e.reembed_corpus(chunks.where("false"), f"{tmp_path}/none", Spy()) == []

"""Changes, upserts, cascades and rules on small tables."""

import random

from pyspark.sql import functions as F

from tessera.operators import corpus as c
from tessera.operators import evaluation as ev
from tessera.operators.evaluation import LEVELS, tfidf_logistic_report

DOC = "id string, kind string, source_ref string, content_hash string, title string, created_at int, updated_at int"


def test_upsert_keeps_what_is_there(spark):
    current = spark.createDataFrame([("1", "a", "x", "h1", "t1", 1, 1), ("2", "b", "x", "h2", "t2", 1, 1), ("3", "a", "y", None, "t3", 1, 1)], DOC)
    rows = [("9", "a", "x", "h1", "other title"), ("8", "b", "x", "new", "t8"), ("8", "b", "x", "newer", "t9"), ("7", "c", "z", "h7", "t7"), ("6", "a", "y", "h6", "t6"), ("5", None, None, "h5", "t5")]
    incoming = spark.createDataFrame(rows, "id string, kind string, source_ref string, content_hash string, title string")
    got = {tuple(r) for r in c.upsert_documents(incoming, current, 7).collect()}
    assert got == {("1", "a", "x", "h1", "t1", 1, 1), ("2", "b", "x", "newer", "t9", 1, 7), ("7", "c", "z", "h7", "t7", 7, 7), ("3", "a", "y", "h6", "t6", 1, 7), ("5", None, None, "h5", "t5", 7, 7)}
    change = {(r.kind, r.content_hash): r.change for r in c.detect_changes(incoming, current).collect()}
    assert change == {("a", "h1"): "unchanged", ("b", "new"): "changed", ("b", "newer"): "changed", ("c", "h7"): "new", ("a", "h6"): "changed", (None, "h5"): "new"}
    assert {r.change for r in c.detect_changes(incoming.where("kind = 'a'"), current, force=True).collect()} == {"changed"}
    assert c.upsert_documents(incoming.where("false"), current, 7).count() == 3 and c.upsert_documents(incoming, current.where("false"), 7).count() == 5


def test_cascade_and_rules(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (3, "b", "z")], "id long, kind string, source_ref string")
    chunks = spark.createDataFrame([("c1", 1, 0, 5, [1.0, 2.0]), ("c2", 1, 0, -1, None), ("c3", 2, 0, None, [1.0]), ("c4", 9, 0, 1, None)], "chunk_id string, document_id long, ordinal int, token_count int, embedding array<float>")
    edges = spark.createDataFrame([(1, "R", 2), (1, "R", 2), (2, "S", 2), (3, "T", 1), (3, "U", None)], "source_id long, target_ref string, target_id long")
    report = {r.rule: r.violations for r in c.constraint_report(docs, chunks, edges, 2).collect()}
    assert report == {"unique_document": 1, "unique_chunk": 1, "unique_edge": 1, "token_count": 1, "self_edge": 1, "dimension": 1, "orphan_chunk": 1}
    d, ch, e = c.delete_documents(docs, chunks, edges, spark.createDataFrame([(1,), (1,), (77,)], "id long"))
    assert sorted(r.id for r in d.collect()) == [2, 3, 3] and sorted(r.chunk_id for r in ch.collect()) == ["c3", "c4"]
    assert sorted(map(tuple, e.collect())) == [(2, "S", 2), (3, "T", None), (3, "U", None)]
    fresh = spark.createDataFrame([("n", 1, 0)], "chunk_id string, document_id long, ordinal int")
    assert sorted(r.chunk_id for r in c.replace_chunks(chunks, fresh, fresh).collect()) == ["c3", "c4", "n"]
    assert {r.violations for r in c.constraint_report(docs.where("false"), chunks.where("false"), edges.where("false"), 2).collect()} == {0}


def test_vectors_are_put_in_place(spark):
    chunks = spark.createDataFrame([("a", [1.0]), ("b", None), ("c", [3.0]), (None, [4.0])], "chunk_id string, embedding array<float>")
    new = spark.createDataFrame([("a", [9.0]), ("b", [8.0]), ("c", None), ("d", [7.0]), (None, [6.0])], "chunk_id string, embedding array<float>")
    assert {(r.chunk_id, tuple(r.embedding)) for r in c.apply_embeddings(chunks, new).collect()} == {("a", (9.0,)), ("b", (8.0,)), ("c", (3.0,)), (None, (4.0,))}


def test_tfidf_logistic_learns_what_words_tell(spark):
    r = random.Random(1)
    own = {"high": ["alpha", "beta"], "medium": ["gamma", "delta"], "low": ["eps", "zeta"]}
    rows = [(i, k, i % 5 == 0, " ".join(r.choice(own[k] + ["the", "of", "and"]) for _ in range(12))) for i in range(300) for k in [LEVELS[i % 3]]]
    rows += [(1000 + i, "high", i % 2 == 0, None) for i in range(4)]
    out = {x.risk: x for x in tfidf_logistic_report(spark.createDataFrame(rows, "doc_id long, risk string, test boolean, text string"), 20).collect()}
    assert set(out) == set(LEVELS) and min(x.f1 for x in out.values()) > 0.97 and out["low"].macro_f1 > 0.97


def test_tfidf_logistic_reads_a_text_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(x):
        seen.add(1)
        return x

    rows = [(i, LEVELS[i % 3], i % 5 == 0, f"{'alpha beta gamma'.split()[i % 3]} the x{i % 7}") for i in range(60)]
    parts = spark.createDataFrame(rows, "doc_id long, risk string, test boolean, text string").withColumn("text", read.asNondeterministic()("text"))
    assert {x.risk for x in tfidf_logistic_report(parts, 5).collect()} == set(LEVELS) and seen.value == len(rows)


def test_vocabulary_is_of_the_most_frequent_grams_whatever_the_partitions(spark, tmp_path):
    texts = ["b a b a", "d c b a", "e e e e", "c d", "d c", None, ""]
    t = spark.createDataFrame([(x,) for x in texts], "text string").select(F.split("text", " ").alias("w")).where("w[0] <> ''")
    for parts in (1, 3):
        t.repartition(parts).write.mode("overwrite").parquet(f"{tmp_path}/{parts}")
        at = spark.read.parquet(f"{tmp_path}/{parts}")
        # a, b: 3 times; b a: 3; c, d: 3; d c: 2; a b and e in one row only, c b and c d once
        assert ev.vocabulary(at, "w", 9) == ["a", "b", "b a", "c", "d", "d c"] and ev.vocabulary(at, "w", 3) == ["a", "b", "b a"]


def test_order_statistics_and_split(spark):
    r = random.Random(2)
    rows = [(k, r.choice([r.random(), 5.0, 1e6 * r.random(), -3.0])) for k in "ab" for _ in range(301)] + [("one", 4.0), ("same", 2.0), ("same", 2.0), ("none", None), (None, 1.0)]
    t = spark.createDataFrame(rows, "stage string, value double")
    got = {x.stage: (x.p50, x.p95) for x in ev.nearest_ranks(t, "stage", "value").collect()}
    want = {}
    for k in ("a", "b", "one", "same"):
        o = sorted(x for s, x in rows if s == k)
        want[k] = (o[len(o) // 2], o[min(int(len(o) * 0.95), len(o) - 1)])
    assert {k: x for k, x in got.items() if k} == want
    latency = {x.stage: x for x in ev.latency_summary(t, 3.0).collect()}
    o = sorted(x for s, x in rows if s == "a")
    assert latency["a"].p50 == round(o[150], 6) and latency["same"].on_target and not latency["one"].on_target and latency["one"].n == 1
    assert ev.nearest_ranks(t.where("false"), "stage", "value").count() == 0
    clauses = spark.createDataFrame([(i, "abc"[min(i // 40, 2)]) for i in range(103)] + [(999, None)], "id long, kind string")
    parts = ev.stratified_split(clauses, "id", "kind").collect()
    assert len(parts) == 104 and {k: sum(p.test for p in parts if p.kind == k) for k in ("a", "b", "c", None)} == {"a": 8, "b": 8, "c": 4, None: 0}
    assert [p.id for p in sorted(ev.stratified_split(clauses, "id", "kind").collect(), key=lambda p: p.id) if p.test] == sorted(p.id for p in parts if p.test)


def test_scores(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 11, 3), (2, 9, 1)], "query_id long, document_id long, rank int")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    relevant = spark.createDataFrame([(1, 11), (1, 12), (2, 8), (3, 10)], "query_id long, document_id long")
    got = {x.query_id: (x.precision, x.recall, x.rr, x.hit) for x in ev.scores(hits, queries, relevant, k=4).collect()}
    assert got == {1: (0.5, 0.5, 0.5, True), 2: (0.0, 0.0, 0.0, False), 3: (0.0, 0.0, 0.0, False)}
    m = ev.means({"x": ev.scores(hits, queries, relevant, k=4)}).first()
    assert (m.retriever, m.precision, m.recall, m.mrr, m.hit_rate) == ("x", round(0.5 / 3, 6), round(0.5 / 3, 6), round(0.5 / 3, 6), round(1 / 3, 6))

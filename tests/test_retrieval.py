"""Retrieval against plain statements of it: vectors, words, fusion, attempts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import STOP
from tessera.operators import retrieval as r
from tessera.operators.lexical import LexicalIndex

CHUNK = "chunk_id string, document_id long, kind string, label string, content string, embedding array<float>"


def cosines(queries, chunks, k):
    good = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    out = []
    for q, v in queries:
        if good(v):
            s = sorted((-math.floor(sum(a * b for a, b in zip(v, w)) / math.sqrt(sum(a * a for a in v) * sum(b * b for b in w)) * 1e6 + 0.5) / 1e6, c) for c, w in chunks if good(w))
            out += [(q, c, -x, i) for i, (x, c) in enumerate(s[:k], 1)]
    return sorted(out)


def knn(spark, queries, chunks, k, **how):
    q = spark.createDataFrame(queries, "query_id long, vector array<float>")
    c = spark.createDataFrame([(i, 1, "a", None, "", v) for i, v in chunks], CHUNK).repartition(5)
    return sorted((x.query_id, x.chunk_id, x.score, x["rank"]) for x in r.knn_join(q, c, k, **how).collect())


@pytest.mark.parametrize("how", [{}, {"block": 3, "spread": 2}])
def test_knn(spark, how):
    rnd = random.Random(1)
    v = lambda: [float(rnd.randrange(-3, 4)) for _ in range(4)]
    chunks = [(f"c{i}", v()) for i in range(150)] + [("null", None), ("z1", [0.0] * 4), ("z2", [0.0] * 4), ("nan", [1.0, float("nan"), 0.0, 0.0]), ("hole", [1.0, None, 0.0, 0.0]), ("big", [3e38] * 4), ("tiny", [1e-40] * 4)]
    queries = [(i, v()) for i in range(20)] + [(50, None), (51, [0.0] * 4), (52, [1e-30] * 4)]
    got, want = knn(spark, queries, chunks, 5, **how), cosines(queries, chunks, 5)
    assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in want]
    assert all(a[2] == pytest.approx(b[2], abs=2e-6) for a, b in zip(got, want))


def test_knn_takes_no_place_for_what_has_no_direction(spark):
    zeros = [(f"z{i}", [0.0, 0.0]) for i in range(9)]
    assert [x[1] for x in knn(spark, [(1, [1.0, 0.0])], zeros + [(f"c{i}", [1.0, float(i)]) for i in range(5)], 5)] == [f"c{i}" for i in range(5)]
    assert knn(spark, [(1, [1.0, 0.0])], zeros, 5) == [] == knn(spark, [], [("c", [1.0, 1.0])], 5) == knn(spark, [(1, None)], [("c", [1.0, 1.0])], 5) == knn(spark, [(1, [1.0])], [], 5)
    with pytest.raises(Exception, match="components"):
        knn(spark, [(1, [1.0, 0.0])], [("c", [1.0, 1.0, 1.0])], 5)


def test_filters_of_one_vector(spark):
    rows = [("a", 1, "x", None, "", [1.0, 0.0]), ("b", 1, "y", None, "", [1.0, 0.1]), ("c", 2, "y", None, "", [1.0, 1.0]), ("d", 2, "y", None, "", None)]
    c = spark.createDataFrame(rows, CHUNK)
    ids = lambda **how: [x.chunk_id for x in r.vector_search([1.0, 0.0], c, 2, **how).orderBy("rank").collect()]
    assert ids() == ["a", "b"] and ids(kind="y") == ["b", "c"] and ids(document_id=2) == ["c"] and ids(kind="x", document_id=2) == [] and ids(kind="none") == []


def words(t):
    return [w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split() if w not in STOP]


def by_words(queries, chunks, k, keep=lambda c: True):
    out = []
    for q, text in queries:
        asked = set(words(text))
        s = sorted((-n, c[0]) for c in chunks if keep(c) and (n := sum(w in asked for w in words(c[3]) + words(c[4]))))
        out += [(q, c, float(-n), i) for i, (n, c) in enumerate(s[:k], 1)]
    return sorted(out)


def texts(n, seed):
    """Few words, some very common, and chunks of very different lengths."""
    rnd = random.Random(seed)
    vocab = [f"w{min(int(rnd.expovariate(0.12)), 60)}" for _ in range(400)] + ["the", "of"]
    return [(f"c{i}", i // 3, "xy"[i % 2], rnd.choice([None, "Section w3", ""]), None if i % 41 == 7 else " ".join(rnd.choice(vocab) for _ in range(rnd.choice([1, 5, 40, 200]))), None) for i in range(n)]


QUERY = [(1, "w0 w1 W2?"), (2, "the of"), (3, ""), (4, None), (5, "w40"), (6, "w1 w1 w7 w30 nothing"), (7, "nothing"), (8, "section w59 w0")]


def test_lexical_index_and_search(spark, tmp_path):
    rows = texts(300, 3)
    index = LexicalIndex(spark, str(tmp_path), block=8, buckets=4)
    q = spark.createDataFrame(QUERY, "query_id long, query string")
    found = lambda **how: sorted(map(tuple, index.search(q, 5, **how).select("query_id", "chunk_id", "score", "rank").collect()))
    assert found() == []  # nothing is stored yet
    frame = lambda rows: spark.createDataFrame(rows, CHUNK).repartition(4)
    assert index.refresh(frame(rows)) == len(rows) and index.refresh(frame(rows)) == 0
    assert found() == by_words(QUERY, rows, 5)
    assert found(kind="x") == by_words(QUERY, rows, 5, lambda c: c[2] == "x")
    assert found(kind="y", document_id=7) == by_words(QUERY, rows, 5, lambda c: c[2] == "y" and c[1] == 7)
    # some change, some go, some come: those alone are indexed
    now = [(c, d, k, "Section w59" if i % 10 == 0 else label, "w0 " * 30 if i % 37 == 5 else t, v) for i, (c, d, k, label, t, v) in enumerate(rows) if i % 11] + [(f"n{i}", 999, "x", None, "w0 w1 " * i, None) for i in range(20)]
    changed = sum(x not in rows for x in now)
    assert 0 < changed < 100 and index.refresh(frame(now)) == changed
    assert found() == by_words(QUERY, now, 5)
    assert sorted(map(tuple, index.postings().collect())) == sorted((c, w, (words(l) + words(t)).count(w)) for c, _, _, l, t, _ in now for w in set(words(l) + words(t)))
    assert index.refresh(frame(now[:50])) == 0 and found() == by_words(QUERY, now[:50], 5)
    assert index.refresh(frame(rows)) > 0 and found() == by_words(QUERY, rows, 5)


def test_a_posting_is_shuffled_once_for_all_queries(spark, tmp_path):
    rows = [(f"c{i:03}", 1, "x", None, "w0 " * (i % 5 + 1) + f"w{i % 3 + 1}", None) for i in range(300)]
    index = LexicalIndex(spark, str(tmp_path), block=8, buckets=2)
    index.refresh(spark.createDataFrame(rows, CHUNK))
    out = index.search(spark.createDataFrame([(q, "w0 w1") for q in range(50)], "query_id long, query string"), 3)
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    best = sorted(range(300), key=lambda i: (-(i % 5 + 1) - (i % 3 == 0), i))[:3]
    assert sorted((x.query_id, x["rank"], x.chunk_id) for x in out.collect()) == [(q, r + 1, f"c{i:03}") for q in range(50) for r, i in enumerate(best)]


def test_postings_are_packed_without_a_shuffle(spark, tmp_path):
    from tessera.operators.lexical import chunk_terms

    rows = texts(200, 5)
    index = LexicalIndex(spark, str(tmp_path), block=4, buckets=3, run=500)  # so a task packs several times
    packed = index._pack(chunk_terms(spark.createDataFrame(rows, CHUNK).repartition(2).cache()))
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("InMemoryRelation")[0] and "Aggregate" not in plan
    blocks, of = packed.collect(), {c: words(l) + words(t) for c, _, _, l, t, _ in rows}
    assert sorted((p.chunk_id, b.term, p.tf) for b in blocks for p in b.postings) == sorted((c, w, own.count(w)) for c, own in of.items() for w in set(own))
    for b in blocks:
        sizes = [len(of[p.chunk_id]) for p in b.postings]
        assert sizes == sorted(sizes, reverse=True) and b.longest == sizes[0] and b.most == max(p.tf for p in b.postings) and len(sizes) <= 4


def test_first_blocks_are_found_before_the_shuffle(spark):
    one = lambda c, tf: [(c, 1, "x", tf)]
    rows = [("w0", 0, 5, 9, one("a", 5)), ("w0", 1, 7, 9, one("b", 7)), ("w0", 2, 7, 9, one("c", 7)), ("w0", 0, 8, 3, one("d", 8)), ("w1", 3, 1, 1, one("e", 1))]
    blocks = spark.createDataFrame(rows, "term string, segment int, most long, longest int, postings array<struct<chunk_id: string, document_id: long, kind: string, tf: long>>")
    out = LexicalIndex._longest(blocks)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((x.term, x.segment, x.postings[0].chunk_id) for x in out.collect()) == [("w0", 1, "b"), ("w1", 3, "e")]


def test_blocks_are_skipped(spark, tmp_path, monkeypatch):
    """What can't reach the k-th sum isn't unpacked: without these postings it's the same."""
    rows = [(f"c{i:03}", 1, "x", None, "w0 " * (400 - i) + "w1", None) for i in range(400)]
    index = LexicalIndex(spark, str(tmp_path), block=8, buckets=2)
    index.refresh(spark.createDataFrame(rows, CHUNK))
    read, all_of = index._read, F.get("postings", F.lit(0))
    poor = (F.col("most") < 390) & (F.col("term") == "w0")
    nothing = F.array(F.struct(F.lit("c000").alias("chunk_id"), F.lit(1).cast("long").alias("document_id"), F.lit("x").alias("kind"), (all_of["tf"] * 1000).alias("tf")))
    monkeypatch.setattr(index, "_read", lambda name, kind: read(name, kind).withColumn("postings", F.when(poor, nothing).otherwise(F.col("postings"))) if name == "blocks" else read(name, kind))
    out = index.search(spark.createDataFrame([(1, "w0 w1")], "query_id long, query string"), 5)
    assert [(x.chunk_id, x.score) for x in out.orderBy("rank").collect()] == [(f"c{i:03}", 401.0 - i) for i in range(5)]


def test_fusion(spark):
    hits = lambda *ids: spark.createDataFrame([(1, c, i) for i, c in enumerate(ids, 1)], "query_id long, chunk_id string, rank int")
    got = lambda arms, limit=8: [(x.chunk_id, x.matched_by) for x in r.rrf_fuse(arms, limit).orderBy("rank").collect()]
    assert got([("v", hits("a", "b", "c"), 1.0), ("l", hits("c"), 1.0)]) == [("c", "l,v"), ("a", "v"), ("b", "v")]
    # equal sums keep the order of the arms, then of the ranks
    assert got([("v", hits("b", "x"), 1.0), ("l", hits("a", "y"), 1.0)]) == [("b", "v"), ("a", "l"), ("x", "v"), ("y", "l")]
    assert got([("v", hits("b", "x"), 1.0), ("l", hits("a"), 2.0)], 2) == [("a", "l"), ("b", "v")]
    assert got([("v", hits("b"), 1.0), ("l", hits("b"), 0.0)]) == [("b", "l,v")]
    none = spark.createDataFrame([], "query_id long, chunk_id string, rank int")
    assert got([("v", none, 1.0), ("l", none, 1.0)]) == [] and got([("v", none, 1.0), ("l", hits("q"), 1.0)]) == [("q", "l")]


def test_weak_queries_and_attempts(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    hits = spark.createDataFrame([(1, "a", 0.02, 1), (1, "b", 0.001, 2), (2, "a", 0.01, 1)], "query_id long, chunk_id string, score double, rank int")
    assert sorted((x.query_id, x.best) for x in r.weak(q, hits, 0.015).collect()) == [(2, 0.01), (3, None)]
    rows = [("a", 1, 0.9), ("a", 2, 0.95), ("b", 1, 0.1), ("b", 2, 0.7), ("c", 1, 0.1), ("c", 2, None), ("c", 3, 0.9), ("d", 1, 0.2)]
    got = r.final_attempt(spark.createDataFrame(rows, "clause string, attempt int, score double"), 0.5)
    assert sorted(map(tuple, got.collect()), key=str) == [("a", 1, 0.9, "accepted"), ("b", 2, 0.7, "accepted"), ("c", 2, None, "exhausted"), ("d", 1, 0.2, "open")]
    assert r.final_attempt(got.where("false"), 0.5).count() == 0

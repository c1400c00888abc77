"""The pipeline's near-duplicate stage against brute-force Jaccard."""

import random

import pytest

import corpus_pipeline
from tessera.llm.common import stored
from tessera.llm.jaccard import jaccard_duplicates

from .conftest import DOCS


def components(rows, least=0.8, k=5):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else {()}
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = list(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {i: find(i) for i in sets}


def edited():
    """Originals, copies with one to five changed words each, and a chain."""
    r = random.Random(11)
    word = lambda: f"w{r.randrange(5000)}"
    out = []
    for _ in range(12):
        base = [word() for _ in range(r.randrange(60, 240))]
        for edits in range(6):
            w = list(base)
            for _ in range(edits):
                w[r.randrange(len(w))] = word()
            out.append((len(out), " ".join(w)))
    chain = [word() for _ in range(150)]
    for i in range(40):
        chain[(3 * i) % 150] = word()
        out.append((len(out), " ".join(chain)))
    return out


@pytest.mark.parametrize("how", [{}, {"small": 1, "chunk": 3}])
def test_jaccard_duplicates(docs, rows, how):
    assert {r.doc_id: r.component_id for r in jaccard_duplicates(docs, **how).collect()} == components(rows)


@pytest.mark.parametrize("how", [{}, {"small": 2, "chunk": 5}])
def test_edited_copies_meet(spark, how):
    rows = edited()
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    want = components(rows)
    assert {r.doc_id: r.component_id for r in jaccard_duplicates(d, **how).collect()} == want


def test_near_stage_drops_copies_at_similarity_of_four_fifths(spark):
    rows = edited()
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    kept = {r.doc_id for r in corpus_pipeline.near_stage(spark, stored(d), "").collect()}
    assert kept == {i for i, c in components(rows).items() if i == c}


def test_null_ids_and_empty_tables(spark, nothing):
    assert jaccard_duplicates(nothing).count() == 0
    d = spark.createDataFrame([(None, "a b c " * 30), (1, "a b c " * 30), (1, "a b c " * 30), (None, "x y z u v w"), (7, None), (5, "")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard_duplicates(d).collect()), key=str)
    assert got == sorted([(None, 1), (1, 1), (1, 1), (None, None), (7, 5), (5, 5)], key=str)


def test_simhash_links_are_found_first_and_are_alike(spark):
    """Links come from fingerprints at most three bits apart whose sets are alike; they leave some apart."""
    from pyspark.sql import functions as F

    from tessera.llm.jaccard import fingerprinted, simhash_links

    rows = edited()
    d = spark.createDataFrame([(i, t.encode()) for i, t in rows], "id long, t binary")
    fps = stored(fingerprinted(d, 5))
    bits = {r.id: r.fp for r in fps.collect()}
    nodes = stored(fps.groupBy("sig").agg(F.min("id").alias("node"), F.first("fp").alias("fp")))
    links = {(r.u, r.v) for r in simhash_links(d, nodes, 5, 80, 3).collect()}
    comp = components(rows)
    assert links and len(links) < sum(i != c for i, c in comp.items())
    assert all(bin((bits[u] ^ bits[v]) & (2**64 - 1)).count("1") <= 3 and comp[u] == comp[v] for u, v in links)


def test_near_stage_goes_by_simhash(spark, monkeypatch):
    import tessera.llm.jaccard as jaccard

    asked = []
    links = jaccard.near_links
    monkeypatch.setattr(jaccard, "near_links", lambda nodes, distance: asked.append(distance) or links(nodes, distance))
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in edited()], DOCS)
    corpus_pipeline.near_stage(spark, stored(d), "").collect()
    assert asked == [3]


def test_near_stage_writes_few_files_where_partitions_are_many(spark, tmp_path, monkeypatch):
    """A table of few rows gets as many files as there are cores, not one for each shuffle partition."""
    import tessera.llm.common as common

    rows = edited()
    d = stored(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS))
    monkeypatch.setattr(common, "shared_dir", lambda s, own=common.shared_dir: own(s) and str(tmp_path))
    conf = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        kept = {r.doc_id for r in corpus_pipeline.near_stage(spark, d, "").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert kept == {i for i, c in components(rows).items() if i == c}
    tables = [sum(1 for _ in t.glob("part-*.parquet")) for t in tmp_path.glob("table-*")]
    assert len(tables) > 10 and max(tables) <= spark.sparkContext.defaultParallelism

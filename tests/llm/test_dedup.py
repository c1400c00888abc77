import hashlib
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.exact import exact_dedup
from tessera.llm.simhash import near_duplicates, near_links
from tessera.llm.substring import substring_dedup
from tessera.llm.suffix import suffix_array, suffix_dedup
from tessera.llm.windows import anchors

from . import brute


def as_set(df):
    return {tuple(r) for r in df.collect()}


def exact_brute(rows):
    groups = {}
    for k, t in rows:
        groups.setdefault("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""), []).append(k)
    return {(k, max(g), len(g), k == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for k in g}


def test_exact(docs, rows):
    assert as_set(exact_dedup(docs, keep="largest")) == exact_brute(rows)


def test_exact_with_colliding_digests(docs, rows):
    got = exact_dedup(docs, keep="largest", digest=lambda t: F.length(t) % 5)
    assert as_set(got) == exact_brute(rows)


def test_exact_smallest_null_ids_and_repeats(spark):
    d = spark.createDataFrame([(None, "a"), (3, "A"), (3, "a"), (None, "b"), (5, None), (4, "")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(d).collect()), key=str)
    assert got == sorted([(None, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (None, None, 1, True), (5, 4, 2, False), (4, 4, 2, True)], key=str)


def test_simhash(docs, rows):
    assert as_set(near_duplicates(docs)) == brute.simhash(rows)


def test_near_links_over_chunks(spark):
    # a chain of 40 fingerprints, neighbours two bits apart, dealt over many chunks
    fps = [(i, sum(3 << 2 * j for j in range(i))) for i in range(30)]
    nodes = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in fps], "node long, fp long")
    links = near_links(nodes, chunk=3)
    comp = connected_components(links)
    assert {r.component for r in comp.collect()} == {0} and comp.count() == 30


def test_components_of_a_long_chain(spark):
    e = spark.range(200).selectExpr("id as u", "id + 1 as v").union(spark.createDataFrame([(500, 501), (7, 7), (None, 3)], "u long, v long"))
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_substring(docs, rows):
    assert as_set(substring_dedup(docs).drop("kept_text")) == brute.words_dedup(rows)


def test_substring_three_levels(docs, rows):
    assert as_set(substring_dedup(docs, start=5).drop("kept_text")) == brute.words_dedup(rows)


def test_suffix(docs, rows):
    assert as_set(suffix_dedup(docs).drop("kept")) == brute.bytes_dedup(rows)


def test_suffix_with_crowded_anchors_and_small_shards(docs, rows):
    assert as_set(suffix_dedup(docs, length=60, gram=8, block=500, crowd=2).drop("kept")) == brute.bytes_dedup(rows, 60)


def test_empty_tables(nothing):
    for f in (exact_dedup, near_duplicates, substring_dedup, suffix_dedup):
        assert f(nothing).count() == 0


def test_clashing_columns_and_null_ids(spark):
    d = spark.createDataFrame([(None, "a b c " * 30, 1, 2), (1, "a b c " * 30, 3, 4)], "doc_id long, text string, key long, h long")
    for f in (exact_dedup, near_duplicates, substring_dedup, suffix_dedup):
        assert f(d).count() == 2


def letters(r, n):
    return "".join(r.choice("abcdefgh ") for _ in range(n))


def test_different_texts_without_ids(spark):
    r = random.Random(9)
    p, q = letters(r, 400), letters(r, 400)
    rows = [(None, letters(r, 300) + q), (None, p + q + letters(r, 200)), (1, letters(r, 10) + p), (None, None), (2, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    # rows without an id come last, in order of a hash of their texts
    order = sorted((t or "" for k, t in rows if k is None), key=lambda t: (h := xxhash.xxh64_intdigest(t.encode(), seed=42)) - (h >> 63 << 64))
    named = [(k if k is not None else 1000 + order.index(t or ""), t) for k, t in rows]
    for f, plain in ((suffix_dedup, brute.bytes_dedup), (substring_dedup, brute.words_dedup)):
        want = sorted(((k if k < 1000 else None, *x) for k, *x in plain(named)), key=str)
        assert sorted((tuple(x)[:-1] for x in f(d).collect()), key=str) == want


def test_ids_of_any_value(spark):
    r = random.Random(10)
    shared = [letters(r, 300) for _ in range(2)]
    ids = [2**62 + 5, 2**62, 2**63 - 1, -1, -(2**63), 0, 7, None]
    rows = [(k, letters(r, 50 + i) + shared[i % 2] + letters(r, 40)) for i, k in enumerate(ids)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for f, plain in ((suffix_dedup, brute.bytes_dedup), (substring_dedup, brute.words_dedup)):
        want = sorted(((k if k < 2**63 else None, *x) for k, *x in plain([(2**63 if k is None else k, t) for k, t in rows])), key=str)
        assert sorted((tuple(x)[:-1] for x in f(d).collect()), key=str) == want


def test_rows_of_one_id_with_different_texts(spark):
    r = random.Random(11)
    p, q = letters(r, 400), letters(r, 400)
    rows = [(1, letters(r, 300) + q), (1, p + q + letters(r, 200)), (2, letters(r, 10) + p), (2, letters(r, 10) + p[:150])]
    got = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    want = sorted(x[1:] for x in brute.bytes_dedup([(i, t) for i, (_, t) in enumerate(rows)]))
    assert sorted(tuple(x)[1:5] for x in got.collect()) == want and sorted(x.doc_id for x in got.collect()) == [1, 1, 2, 2]


def test_anchors_of_equal_windows_are_equal():
    h = np.random.default_rng(1).integers(0, 50, 3000, dtype=np.uint64) << np.uint64(40)
    at = anchors(h, 60)
    assert all(at[i] == i + int(np.argmin(h[i : i + 60])) for i in range(len(at)))


def test_suffix_arrays():
    r = random.Random(6)
    for alphabet in (1, 2, 5, 200):
        for n in (0, 1, 2, 40, 500):
            t = np.array([r.randrange(1, alphabet + 1) for _ in range(n)] + [0], dtype=np.uint16)
            assert suffix_array(t).tolist() == sorted(range(n + 1), key=lambda i: t[i:].tolist())

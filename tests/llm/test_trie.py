import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import trie
from tessera.llm.scan import running_sums

from . import brute

KINDS = "conv_id long, turn long, role string, text string"


def made_up(n=260, seed=3):
    """Conversations with shared turns, null turns, roles and texts, ties and repeats."""
    r = random.Random(seed)
    say = lambda: r.choice(["", "hi", "hello", "é𝄞", None, "a\nb"])
    out = []
    for c in [*range(n), -7, -150, -100, 2**62 + 100, 2**62 + 103]:
        if r.random() < 0.1 and c:
            continue
        for t in range(r.randrange(1, 12)):
            out.append((c, t if r.random() < 0.95 else None, r.choice(["user", "assistant", None]), say()))
        if r.random() < 0.1:
            out += [out[-1]] * 3 + [(*out[-1][:3], "other")]
    return out + [(None, 0, "user", "hi")]


def rows_of(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = [tuple(r) for r in df.select(*names).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("height", [2, 3, 8])
def test_trie(spark, height):
    rows = made_up()
    assert rows_of(trie.prefix_trie(spark.createDataFrame(rows, KINDS), height)) == brute.trie(rows)


def test_one_long_conversation_that_others_begin_like(spark):
    # most turns belong to one conversation, whose text another repeats
    rows = [(c, t, "u", f"t{t}") for c, n in ((100, 400), (101, 399), (230, 90), (231, 3)) for t in range(n)]
    spread = spark.createDataFrame(rows, KINDS).repartition(7)
    assert rows_of(trie.prefix_trie(spread, 3)) == brute.trie(rows)


def test_turnless_empty_and_clashing(spark):
    # conversations of one turn without their base keep none where they skip it
    rows = [(c, 0, "u", "x") for c in range(101, 130)]
    assert rows_of(trie.prefix_trie(spark.createDataFrame(rows, KINDS))) == brute.trie(rows)
    assert rows_of(trie.prefix_trie(spark.createDataFrame([], KINDS))) == set()
    odd = spark.createDataFrame(rows, KINDS).withColumns({x: F.lit("z") for x in ("c", "pos", "key", "depth", "r", "e", "n", "band", "__part")})
    assert rows_of(trie.prefix_trie(odd)) == brute.trie(rows)


def test_many_ends_of_one_node(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 4)
    rows = [(c, 0, "u", "x") for c in range(0, 9000, 100)]
    assert rows_of(trie.prefix_trie(spark.createDataFrame(rows, KINDS).repartition(5))) == brute.trie(rows)


def test_running_sums_wrap_and_cross_tasks(spark):
    r = random.Random(1)
    rows = [(0 if r.random() < 0.7 else r.randrange(5), i, r.randrange(-(2**63), 2**63)) for i in range(500)]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    got = {(x.k, x.i): x.s for x in running_sums(spark.createDataFrame(rows, "k long, i long, s long").repartition(13), "k", ["i"], ["s"]).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    total, want = {}, {}
    for k, i, s in sorted(rows):
        total[k] = (total.get(k, 0) + s) % 2**64
        want[k, i] = total[k] - 2**64 if total[k] >= 2**63 else total[k]
    assert got == want

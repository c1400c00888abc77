import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import spelling

from . import brute

KINDS = "doc_id long, text string"


def made_up(n=400, seed=4):
    """Words over few letters, so that most have near ones; runs of equal letters."""
    r = random.Random(seed)
    base = ["".join(r.choice("aabÿÀ") for _ in range(r.randrange(4, 8))) for _ in range(60)]
    out = [(None, None), (1, ""), (None, "aaaab aaaab, aaaab"), (2, "×÷×÷× ×÷×÷× ×÷×÷×")]
    for i in range(3, n):
        out.append((i, " ".join(r.choice([str.upper, str.title, str])(r.choice(base[: r.randrange(1, 61)])) for _ in range(8)) + "1a2;𝄞b"))
    return out + out[5:9] + [(9, "ab" * 4000 + " " + "ab" * 3999 + "a"), (10, ("ab" * 4000 + " " + "ab" * 3999 + "a ") * 3)]


def result(df):
    got = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("damage", [97, 3])
def test_spelling(spark, damage):
    rows = made_up()
    want = brute.spelling(rows, damage)
    assert sum(x[1] is not None for x in want) > 10 and any(x[1] != x[2] and x[1] for x in want)
    assert result(spelling.spelling_variants(spark.createDataFrame(rows, KINDS), damage=damage)) == want


def test_numbers_of_nodes_over_many_tasks(spark):
    words = sorted({"".join(random.Random(i).choices("ab", k=i % 9 + 1)) for i in range(600)})
    spark.conf.set("spark.sql.shuffle.partitions", "31")
    rows = spelling.numbered(spark.createDataFrame([(w,) for w in words], "w string").repartition(31), "w", "id").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert [r.w for r in sorted(rows, key=lambda r: r.id)] == words and sorted(r.id for r in rows) == list(range(len(words)))
    names = {}
    for r in rows:
        assert len(r.nodes) == len(r.w)
        for i, x in enumerate(r.nodes):
            assert names.setdefault(x, r.w[: i + 1]) == r.w[: i + 1] and x > 0
    assert len(set(names.values())) == len(names) == len({w[:i] for w in words for i in range(1, len(w) + 1)})


def test_empty_and_clashing(spark):
    assert result(spelling.spelling_variants(spark.createDataFrame([], KINDS))) == set()
    assert result(spelling.spelling_variants(spark.createDataFrame([(1, "one two"), (2, None)], KINDS))) == set()
    rows = made_up(60)
    odd = spark.createDataFrame(rows, KINDS).withColumns({x: F.lit("zzzzz") for x in ("d", "run", "word", "n", "id", "nodes", "root")})
    assert result(spelling.spelling_variants(odd)) == brute.spelling(rows)

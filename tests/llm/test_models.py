"""The language model against a plain statement of it, the mix, and the pipeline."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm.common import stored
from tessera.llm.mixing import DOMAINS, WEIGHTS, fit_rates, mix
from tessera.llm.perplexity import learns, perplexities, quality_classifier
from tessera.llm.quality import quality_rules, trusted_ids

from .test_jaccard import components

LABELS = "doc_id long, quality int, toxic int"


def kneser_ney(texts, order=5):
    """bytes -> perplexity, by the recursive definition."""
    counts = {order: Counter()}
    for w in texts:
        counts[order].update(w[i : i + order] for i in range(len(w) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    less, total, off = {}, defaultdict(float), defaultdict(float)
    for k, c in counts.items():
        n = [0] + [sum(v == i for v in c.values()) for i in range(1, 5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = [max(0.05, min(i * 0.95, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] else i * 0.5 for i in (1, 2, 3)]
        for g, v in c.items():
            less[g] = d[min(v, 3) - 1]
            total[g[:-1]] += v
            off[g[:-1]] += less[g]
    # contexts of different orders are told apart by their length
    def p(g):
        if not g:
            return 1 / 256
        ctx, n = g[:-1], counts[len(g)].get(g, 0)
        if ctx not in total:
            return p(g[1:])
        return ((n - less[g]) / total[ctx] if n else 0) + off[ctx] / total[ctx] * p(g[1:])

    return lambda w: math.exp(-sum(math.log(p(w[max(0, i - order + 1) : i + 1])) for i in range(len(w))) / len(w))


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(k, 1, 0) for k, _ in rows if k % 3] + [(None, 1, 0), (6, None, None)], LABELS)


@pytest.mark.parametrize("how", [{}, {"hot_terms": 0}, {"hot_terms": 300, "order": 3}, {"order": 1}])
def test_perplexity(docs, rows, labels, how):
    ids = {r.doc_id for r in trusted_ids(labels.where(learns(F.col("doc_id"))), 1000).collect()}
    model = kneser_ney([(t or "").encode() for k, t in rows if k in ids], how.get("order", 5))
    got = {r.doc_id: r for r in perplexities(docs, labels, **how).collect()}
    assert len(got) == len(rows)
    for k, t in rows:
        w = (t or "").encode()
        assert got[k].n_words == len(w.split())
        assert got[k].perplexity == pytest.approx(model(w), rel=1e-6) if w.split() else got[k].perplexity is None


def test_perplexity_edges(spark, docs, rows, nothing, labels):
    assert quality_classifier(nothing, labels).count() == 0
    none = labels.where("false")
    assert {(r.doc_id, r.kept) for r in quality_classifier(docs, none).collect()} == {(k, bool((t or "").split())) for k, t in rows}
    d = spark.createDataFrame([(None, "a b c", None), (1, "a b c", None), (1, "a b c", None), (2, None, "en")], "doc_id long, text string, lang string")
    got = quality_classifier(d, spark.createDataFrame([(1, 1, 0)], LABELS)).collect()
    assert len(got) == 4 and not next(r.kept for r in got if r.doc_id == 2)
    assert len({r.perplexity for r in got if r.doc_id != 2}) == 1
    clash = docs.selectExpr("*", "1 as key", "'x' as value", "2 as n", "3 as row", "4 as g")
    assert quality_classifier(clash, labels).count() == len(rows)


@pytest.fixture(scope="module")
def domains(spark):
    r = random.Random(3)
    common = [f"c{i}" for i in range(60)]
    own = [[f"{d}{i}" for i in range(40)] for d in DOMAINS]
    rows = [(i, k := r.choice((0, 0, 0, 1, 1, 2)), " ".join(r.choice(own[k] if r.random() < 0.4 else common) for _ in range(r.randrange(20, 80)))) for i in range(400)]
    marks = [(i, int(k == 0), int(k == 2)) for i, k, _ in rows if i % 2]
    return rows, spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string"), spark.createDataFrame(marks, LABELS)


def test_mix_meets_targets_and_tells_domains_apart(domains):
    rows, docs, labels = domains
    got = {r.doc_id: r for r in mix(docs, labels, budget=12_000.0).collect()}
    assert len(got) == len(rows)
    for d, w in WEIGHTS.items():
        assert sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in got.values()) == pytest.approx(12_000 * w, rel=1e-3)
    held_out = [max(range(3), key=lambda j: got[i][f"p_{DOMAINS[j]}"]) == k for i, k, _ in rows if i % 2 == 0]
    assert sum(held_out) / len(held_out) > 0.9
    for i, _, t in rows:
        r = got[i]
        assert r.n_tokens == len(t.split()) and r.rate >= 0 and r.copies in (math.floor(r.rate), math.floor(r.rate) + 1)
        assert r.p_good + r.p_poor + r.p_toxic == pytest.approx(1)


def nearest_rates(n, f, targets, ceiling, rounds=20_000):
    """The rates nearest to 1 that meet the targets, by projections in turn (Dykstra)."""
    n, f, r = np.array(n, float), np.array(f, float), np.ones(len(n))
    a = (f * n[:, None]).T
    back = f @ np.linalg.pinv(f.T @ (f * n[:, None]))
    q = np.zeros(len(n))
    for _ in range(rounds):
        y = r - back @ (a @ r - targets)
        r = np.clip(y + q, 0, ceiling)
        q = y + q - r
    return r


@pytest.mark.parametrize("ceiling", [None, 1.0, 1.6])
def test_rates_are_those_of_brute_force(spark, ceiling):
    r = random.Random(4)
    rows = [(i, r.randrange(1, 400), [a / (a + b), b / (a + b)]) for i in range(80) for a, b in [(r.random() ** 3, r.random() ** 3)]]
    total = [sum(n * p[k] for _, n, p in rows) for k in (0, 1)]
    goal = [0.8 * total[0], 0.2 * total[1]] if ceiling == 1.0 else [1.3 * total[0], 0.3 * total[1]]
    members = spark.createDataFrame(rows, "id long, n_tokens long, p array<double>")
    rate, totals, _ = fit_rates(members, [F.get("p", F.lit(k)) for k in (0, 1)], goal, [1e-6 * g for g in goal], ceiling)
    got = {x.id: x.rate for x in members.select("id", rate.alias("rate")).collect()}
    want = nearest_rates([x[1] for x in rows], [x[2] for x in rows], goal, np.inf if ceiling is None else ceiling)
    assert totals == pytest.approx(goal, rel=1e-6)
    assert [got[i] for i in range(len(rows))] == pytest.approx(want.tolist(), abs=2e-3)


def test_mix_with_a_ceiling(domains):
    _, docs, labels = domains
    got = mix(docs, labels, ceiling=1.0).collect()
    tokens = [sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in got) for d in DOMAINS]
    assert all(0 <= r.rate <= 1 for r in got)
    for d, t in zip(DOMAINS[1:], tokens[1:]):
        assert t == pytest.approx(WEIGHTS[d] * sum(tokens), rel=2e-3)
    # a domain that has less than its weight is taken whole
    short = mix(docs, labels, weights={"good": 0.1, "poor": 0.1, "toxic": 0.8}, ceiling=1.0).collect()
    tokens = [sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in short) for d in DOMAINS]
    assert tokens[1] <= 0.1001 * sum(tokens) and all(r.rate == 1 for r in short if r.p_toxic > 0.99)


def test_mix_warns_where_targets_cannot_be_met(domains):
    _, docs, labels = domains
    with pytest.warns(UserWarning, match="toxic"):
        mix(docs, labels.where("toxic = 0"), budget=5_000.0)


def test_labels_given_twice(domains):
    _, docs, labels = domains
    both = labels.union(labels.selectExpr("doc_id", "1", "toxic"))
    assert mix(docs, both, budget=9_000.0).count() == docs.count()


def test_mix_edges(spark, domains, nothing):
    _, docs, labels = domains
    assert mix(nothing, labels).count() == 0
    one = mix(docs, labels.where("quality = 1")).collect()
    assert len(one) == docs.count() and {(r.p_good, r.p_poor, r.p_toxic) for r in one} == {(1.0, 0.0, 0.0)}
    odd = spark.createDataFrame([(None, "c1 c2", 5), (None, "c1 c2", 5), (3, None, 6), (5, "", 7)], "doc_id long, text string, label int")
    got = mix(docs.withColumn("label", F.lit(1)).unionByName(odd), labels).where("doc_id is null or doc_id in (3, 5)")
    assert sorted(r.n_tokens for r in got.collect() if r.doc_id is None) == [2, 2]


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lower = lambda t: t.translate({i: i + 32 for i in range(65, 91)})
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stored(stage(spark, docs, sf))
        after = {r.doc_id for r in out.collect()}
        assert len(after) == out.count() and after <= {r.doc_id for r in before}
        if name == "quality_rules":
            judged = quality_rules(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("kept")
            assert after == {r.doc_id for r in judged.collect()}
        if name == "exact_dedup":
            first = {}
            for r in sorted(before):
                first.setdefault(lower(r.text), r.doc_id)
            assert after == set(first.values())
        if name == "simhash_near_dedup":
            assert after == {i for i, c in components([(r.doc_id, r.text) for r in before]).items() if i == c}
        if name == "mixing":
            taken = mix(docs, spark.read.parquet(f"{sf}/labels.parquet"), ceiling=1.0).where("copies >= 1")
            assert after == {r.doc_id for r in taken.collect()}
        if name == "bpe":
            assert after == {r.doc_id for r in before}
        else:
            assert out.columns == docs.columns
        docs = out


def odd_rows(spark, tmp_path):
    long = [f"{c} text about many things that nobody has said before and number {c}{i} in a row" for i, c in enumerate("abcdefgh")]
    text = lambda k, n=60: " ".join(f"{k}{i}" for i in range(n))
    near = text("n").split()
    rows = [(None, text("x")), (None, text("y")), (3, text("x")), (3, text("x")), (3, text("z")), (None, text("y").upper()), (7, " ".join(near)), (None, " ".join(near[:-1] + ["other"])), (8, None), (9, ""), (None, long[0])]
    d = spark.createDataFrame([(k, t, "en", "s", 1, 5, "v") for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row int, h string")
    spark.createDataFrame([(3, 1, 0), (None, 0, 0)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    return stored(d), rows


def test_stages_decide_by_row(spark, tmp_path):
    docs, rows = odd_rows(spark, tmp_path)
    sf = str(tmp_path)
    kept = stored(corpus_pipeline.quality_stage(spark, docs, sf))
    assert all((r.text or "").split() for r in kept.collect()) and kept.columns == docs.columns
    exact = stored(corpus_pipeline.exact_stage(spark, docs, sf))
    got = Counter(((r.text or "").lower(), r.doc_id) for r in exact.collect())
    assert got == Counter({(rows[0][1].lower(), 3): 1, (rows[1][1].lower(), None): 1, (rows[4][1], 3): 1, (rows[6][1], 7): 1, (rows[7][1], None): 1, ("", 8): 1, (rows[10][1].lower(), None): 1})
    near = stored(corpus_pipeline.near_stage(spark, exact, sf))
    assert {r.text for r in exact.collect()} - {r.text for r in near.collect()} == {rows[7][1]} and near.columns == docs.columns
    mixed = stored(corpus_pipeline.mixing_stage(spark, near, sf))
    assert mixed.columns == docs.columns and mixed.count() <= near.count()
    assert corpus_pipeline.encoding_stage(spark, mixed, sf).count() == mixed.count()


def test_stages_of_an_empty_table(spark, tmp_path):
    docs, _ = odd_rows(spark, tmp_path)
    docs = stored(docs.where("false"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0

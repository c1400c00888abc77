"""Mixing to target weights: soft domain membership and projected-gradient least squares."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, stored, table

DOMAINS = ("good", "poor", "toxic")
#: Shares of the mix's tokens.
WEIGHTS = {"good": 0.96, "poor": 0.03, "toxic": 0.01}


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def labelled_sample(labels: DataFrame, most: int) -> DataFrame:
    """At most ``most`` labelled ids with their domain, spread by hash; of an id that
    is labelled twice, the highest domain number counts."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    own = labels.select(F.col("doc_id").cast("long").alias("id"), domain.alias("label")).where("id is not null and label is not null")
    return own.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most)


def posteriors(docs: DataFrame, labels: DataFrame, most: int = 10_000, features: int = 1 << 14, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_tokens, p array<double>) for every document: the class probabilities of
    a logistic regression on which hashed words a text has, learnt from at most
    ``most`` labelled documents. Maps only; the sample's bound lets it be broadcast."""
    def split(rows: DataFrame) -> DataFrame:
        return rows.withColumn("words", F.transform(words(F.col("text")), F.lower))

    raw = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *carry)
    d = split(raw)
    tf = HashingTF(inputCol="words", outputCol="features", numFeatures=features, binary=True)
    # split after the join, or Spark would split every text to keep a few
    own = split(raw.join(F.broadcast(labelled_sample(labels, most)), "id"))
    sample = cut(tf.transform(own).select("label", "features"))
    seen = sorted(r.label for r in sample.select("label").distinct().collect())
    n = F.size("words").cast("long").alias("n_tokens")
    if len(seen) < 2:  # nothing to tell apart
        only = seen[0] if seen else 0
        return d.select("id", *carry, n, F.array(*[F.lit(float(i == only)) for i in range(len(DOMAINS))]).alias("p"))
    model: LogisticRegressionModel = LogisticRegression(maxIter=25, regParam=0.003, family="multinomial").fit(sample)
    p = vector_to_array("probability")
    out = model.transform(tf.transform(d)).select("id", *carry, n, p.alias("p"))
    pad = [F.when(F.lit(i < max(seen) + 1), F.get("p", F.lit(i))).otherwise(F.lit(0.0)) for i in range(len(DOMAINS))]
    return out.select("id", *carry, "n_tokens", F.array(*pad).alias("p"))


def fit_rates(members: DataFrame, features: list[Column], targets: list[float], close: list[float], ceiling: float | None = None, steps: int = 60) -> tuple[Column, list[float], list[float]]:
    """The rate of each row of ``members`` as a column, its totals, and the multipliers.

    Least squares by projected gradient: the rates nearest to 1 (squares weighed by
    ``n_tokens``) between 0 and ``ceiling`` for which each total
    sum(rate * n_tokens * feature) is its target, to within ``close``. A step moves all
    rates along the features and projects them into their bounds:
    rate = clip(1 - sum(x * feature)). The gradient of the k numbers x is what the
    totals miss; it is preconditioned by the k x k Gram matrix of the rows that are
    not at a bound, and shortened until the (convex) objective falls. A step moves
    nothing but k + k(k+1)/2 + 1 sums, and a rate depends on its row and x alone.
    """
    k = len(features)
    x = np.zeros(k)

    def rate(at: np.ndarray) -> tuple[Column, Column]:
        free = F.lit(1.0) - sum((f * F.lit(float(v)) for f, v in zip(features, at)), F.lit(0.0))
        inside = F.greatest(F.lit(0.0), free)
        return (inside if ceiling is None else F.least(F.lit(float(ceiling)), inside)), free

    def sums(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        r, free = rate(at)
        n = F.col("n_tokens").cast("double")
        loose = F.when((free > 0) & (free < (1e308 if ceiling is None else ceiling)) | (free == r), n).otherwise(0.0)
        rows = members.select(n.alias("n"), r.alias("r"), free.alias("u"), loose.alias("loose"), *[f.alias(f"f{i}") for i, f in enumerate(features)])
        total = [F.sum(F.col("n") * F.col("r") * F.col(f"f{i}")) for i in range(k)]
        gram = [F.sum(F.col("loose") * F.col(f"f{i}") * F.col(f"f{j}")) for i in range(k) for j in range(i + 1)]
        # integral of the clipped rate over the free one
        row = rows.agg(F.sum(F.col("n") * (F.col("r") * F.col("u") - F.col("r") * F.col("r") / 2)), *total, *gram).first()
        row = [float(v or 0) for v in row]
        g = np.zeros((k, k))
        g[np.tril_indices(k)] = row[1 + k :]
        return row[0] + float(at @ np.array(targets)), np.array(row[1 : 1 + k]), g + np.tril(g, -1).T

    value, totals, gram = sums(x)
    for _ in range(steps):
        miss = totals - np.array(targets)
        if (abs(miss) <= np.array(close)).all():
            break
        step = np.linalg.lstsq(gram + np.eye(k) * 1e-9 * max(gram.trace(), 1e-9), miss, rcond=None)[0]
        size = 1.0
        while True:
            new = sums(x + size * step)
            if new[0] < value or size < 1e-6:
                break
            size /= 2
        if size < 1e-6 and abs(new[1] - targets).sum() >= abs(miss).sum():
            break  # no step helps: the targets can't be met
        x, (value, totals, gram) = x + size * step, new
    return rate(x)[0], totals.tolist(), x.tolist()


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, budget: float | None = None, head: float = 2.0, ceiling: float | None = None, within: float = 1e-4, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), **how) -> DataFrame:
    """One row per document: doc_id, n_tokens, p_good, p_poor, p_toxic, rate, copies, and
    the columns to ``carry``.

    ``rate`` is how often a document is to be taken so that the expected tokens of
    each domain are its weight times ``budget`` (default: ``head`` times the tokens
    at which the first domain's present total has its weight); of all such rates,
    those nearest to 1. ``copies`` is the rate rounded up or down by a hash of the
    id, up as often as its fraction says.

    With a ``ceiling`` no rate is above it, and there is no budget: rates are lowered
    until no domain but the first has more than its weight among all tokens, and as
    little as that needs. A domain that has less than its weight to begin with
    stays short of it.

    A target is met when the total is within the share ``within`` of it. Where that
    can't be (no tokens of a domain with a weight), a warning names the domains.

    Null or empty texts have no tokens and the classifier's prior. A null id hashes
    like any other value; repeated rows get the same answer. With fewer than two
    labelled domains all documents are in one, and all are taken once. Empty tables
    give no rows.
    """
    w = weights or WEIGHTS
    members = stored(posteriors(docs, labels, id_col=id_col, text_col=text_col, carry=carry, **how))
    p = [F.get("p", F.lit(i)) for i in range(len(DOMAINS))]
    have = [float(t or 0) for t in members.agg(*[F.sum(F.col("n_tokens") * x) for x in p]).first()]
    share = [w[d] for d in DOMAINS]
    if sum(t > 0 for t in have) < 2:
        rate, short = F.lit(1.0), []
    elif ceiling is None:
        goal = [x * (head * have[0] / share[0] if budget is None else budget) for x in share]
        rate, totals, _ = fit_rates(members, p, goal, [within * g for g in goal])
        short = [d for d, t, g in zip(DOMAINS, totals, goal) if abs(t - g) > max(within, 1e-3) * g]
    else:
        # total of a domain less its weight of all tokens: zero where it has just that
        over = [x - F.lit(s) for x, s in zip(p, share)]
        held = [i for i in range(1, len(DOMAINS)) if have[i] > share[i] * sum(have)]
        rate, short = F.lit(min(1.0, float(ceiling))), []
        while held:
            rate, totals, x = fit_rates(members, [over[i] for i in held], [0.0] * len(held), [within * share[i] * sum(have) * 0.1 for i in held], ceiling)
            if all(v >= 0 for v in x):
                break
            held = [i for i, v in zip(held, x) if v >= 0]  # one that needs no lowering of its own
        if held:
            short = [DOMAINS[i] for i, t in zip(held, totals) if abs(t) > 1e-3 * share[i] * sum(have)]
    if short:
        warnings.warn(f"targets not met: {', '.join(short)}", stacklevel=2)
    out = members.withColumn("rate", rate)
    chance = F.pmod(F.xxhash64("id", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    copies = (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long")
    return out.select(F.col("id").alias("doc_id"), "n_tokens", *[F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate", copies.alias("copies"), *carry)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

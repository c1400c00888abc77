"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, SPACES), lambda w: w != ""), lambda w: F.xxhash64(w))


def buckets(h: Column, n: int) -> Column:
    """Buckets of all words and of all pairs of neighbours."""
    pairs = F.zip_with(h, F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.pmod(F.xxhash64(a, b), F.lit(n))))
    return F.concat(F.transform(h, lambda x: F.pmod(x, F.lit(n))), F.filter(pairs, lambda x: x.isNotNull()))


def repeat_words(h: Column, window: int = 5) -> Column:
    """How many words lie in a window that the text has twice or more.

    Windows are compared by 64-bit hashes. Only texts with a repeated one sort
    (hash, place) to find the places, whose covered words are then counted.
    """

    def places(s: Column) -> Column:
        same = lambda i, j: F.get(s, i).h == F.get(s, j).h
        hit = F.transform(s, lambda x, i: F.when(F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)), x.i))
        return F.sort_array(F.filter(hit, lambda x: x.isNotNull()))

    def cover(p: Column) -> Column:
        gap = F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window))))
        return F.aggregate(gap, F.lit(0), lambda a, x: a + x)

    def count(w: Column) -> Column:
        s = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(s, lambda y: let(places(y), cover)))

    windows = F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(window))))
    return F.when(F.size(h) <= window, F.lit(0)).otherwise(let(windows, count)).cast("long")


def base_counts(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *carry).withColumn("h", word_hashes(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return d.select(
        "doc_id",
        "h",
        F.size("h").cast("long").alias("n_words"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[^\x20\x09-\x0D]+", ""))).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("h")).alias("n_repeat_words"),
        *carry,
    )


def trusted_ids(labels: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``most`` labelled documents of quality 1 that are not toxic, spread by hash."""
    good = labels.where("quality = 1 and toxic = 0").select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def log_ratio(docs: DataFrame, labels: DataFrame, n: int, most: int, id_col: str, text_col: str) -> list[int]:
    """For each bucket log(p in trusted text / p in all text), in thousandths.

    Counts cover all documents; trusted text is that of ``trusted_ids``, whose
    documented bound makes them safe to broadcast. A map-side combine leaves at most
    ``n`` rows a task; the n weights are what the driver gets, at any input size.
    """
    target = F.broadcast(trusted_ids(labels, most).select(F.col("doc_id").alias("id"), F.lit(1).alias("t")))
    h = docs.select(F.col(id_col).cast("long").alias("id"), word_hashes(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))
    grams = h.join(target, "id", "left").select(F.explode(buckets(F.col("h"), n)).alias("b"), "t")
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.count("t").alias("trusted")).collect()
    raw, trusted = sum(c.raw for c in counts), sum(c.trusted for c in counts)
    weights = [0] * n
    if trusted:
        for c in counts:
            weights[c.b] = round(1000 * math.log((c.trusted + 1) / (trusted + n) / ((c.raw + 1) / (raw + n))))
    return weights


def quality_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_buckets: int = 1 << 16, trusted_docs: int = 20_000, threshold: float = -0.2, carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, score, kept, and the columns to ``carry``.

    ``score`` is the mean over a document's words and word pairs of the log ratio
    between trusted and raw multinomials over ``n_buckets`` hash buckets; documents
    below ``threshold`` are rejected, as are those that fail the base rules. Every
    document is judged, always alike. Nothing but bucket counts is shuffled.

    Null text counts as no words: it fails the base rules. Null labels trust
    nothing; without trusted text all scores are 0. Null ids and repeated rows are
    kept; an empty table gives no rows; other columns are unread.
    """
    weights = log_ratio(docs, labels, n_buckets, trusted_docs, id_col, text_col)
    w = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")  # folded to one constant
    total = F.aggregate(buckets(F.col("h"), n_buckets), F.lit(0).cast("long"), lambda a, b: a + F.get(w, b.cast("int")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    d = base_counts(docs, id_col, text_col, carry).withColumn("base_failed", failed)
    d = d.withColumn("score", total / (1000 * F.greatest(2 * F.col("n_words") - 1, F.lit(1)))).drop("h")
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

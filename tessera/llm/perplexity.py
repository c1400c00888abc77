"""Quality by perplexity under an interpolated modified Kneser-Ney model of byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import most_frequent, stored, table
from .pieces import ONE, slices

U = np.uint64
GRAM, CONTEXT, DOCUMENT = 0, 16, 32  # what a key stands for; the order is added
FILTER_BITS = 26  # the filter of keys: 8 MB, whatever the model's size
SLOT_BITS = 22  # places of the table of hot n-grams


def spread(kind: int, grams: np.ndarray) -> np.ndarray:
    """Keys from n-grams as numbers: a one-to-one map (murmur3's finalizer), so different
    n-grams never share a key."""
    x = grams | U(kind << 56)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> U(shift)
        x *= U(factor)
    return x ^ (x >> U(33))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each text begins and ends."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def grams_ending(data: np.ndarray, order: int) -> np.ndarray:
    """At each byte, the last ``order`` bytes as a number; meaningless where a text has fewer."""
    x = data.astype(U)
    for _ in range(order - 1):
        x[1:] = (x[:-1] << U(8)) | data[1:]
    return x


def training_grams(docs: DataFrame, ids: DataFrame, order: int, id_col: str, text_col: str) -> DataFrame:
    """(g, n): every n-gram of the trusted texts, its bytes as one number, counted per
    task and then in all; shorter n-grams follow from these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for b in batches for s in slices(b, 0, 6 << 20)):
            data, off = text_bytes(b.column(0))
            place = np.arange(len(data)) - np.repeat(off[:-1], np.diff(off))
            g, n = np.unique(grams_ending(data, order)[place >= order - 1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], ["g", "n"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t")).join(ids.hint("merge"), "doc_id", "left_semi")  # ids grow with the labels: never broadcast
    return own.select("t").mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))


def keyed(kind: int, df: DataFrame) -> DataFrame:
    """(g, n, value) with the key in place of the n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = spread(kind, b.column(0).to_numpy().view(U))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(1), b.column(2)], ["key", "n", "value"])

    return df.select("g", "n", "value").mapInArrow(run, "key long, n long, value double")


def kneser_ney(grams: DataFrame, order: int) -> tuple[DataFrame, DataFrame, float]:
    """The model as additive terms (key, n, value), the longest n-grams' log probabilities
    (key, n, value), and the log probability of a byte that was never seen.

    With g = context + byte, p(g) = max(c - D(c), 0) / total(context) + gamma(context)
    p(shorter g); below the longest order, c counts the different bytes before g, and
    below the first order all 256 bytes are alike. A text's log probability is the sum
    of: that of an unseen byte for each byte; for each known byte, what it is more; for
    each known context, log gamma; for each known longer n-gram, how much its p
    exceeds gamma times the shorter p, in logs.
    """
    low = lambda k: F.col("g").bitwiseAND(F.lit((1 << 8 * k) - 1))
    counts = {order: stored(grams)}
    for k in range(order - 1, 0, -1):
        counts[k] = counts[k + 1].groupBy(low(k).alias("g")).agg(F.count("*").alias("n"))
        if k > 2:
            counts[k] = stored(counts[k])
    terms, p, unseen = None, None, 0.0
    for k in range(1, order + 1):
        c = counts[k]
        n1, n2, n3, n4, total = c.select(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5)], F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        d = [max(0.05, min(i * 0.95, i - (i + 1) * y * b / a)) if a else i * 0.5 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        less = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        if k == 1:
            gamma = float(c.agg(F.sum(less)).first()[0] or 0) / total if total else 1.0
            base = max(gamma, 1e-9) / 256
            unseen = float(np.log(base))
            p = c.select("g", "n", ((F.col("n") - less) / F.lit(float(total or 1)) + base).alias("p"))
            terms = keyed(GRAM + 1, p.withColumn("value", F.log("p") - unseen))
        else:
            context = c.groupBy(F.shiftright("g", 8).alias("ctx")).agg(F.sum("n").alias("total"), F.sum(less).alias("off"))
            shorter = p.select(F.col("g").alias("low"), F.col("p").alias("q"))
            p = c.withColumn("ctx", F.shiftright("g", 8)).withColumn("low", low(k - 1)).join(context, "ctx").join(shorter, "low")
            p = p.withColumn("gq", F.col("off") / F.col("total") * F.col("q"))
            p = stored(p.select("g", "n", "gq", ((F.col("n") - less) / F.col("total") + F.col("gq")).alias("p")))
            gammas = context.select(F.col("ctx").alias("g"), F.col("total").alias("n"), F.log(F.col("off") / F.col("total")).alias("value"))
            terms = terms.union(keyed(CONTEXT + k - 1, gammas)).union(keyed(GRAM + k, p.withColumn("value", F.log(F.col("p") / F.col("gq")))))
    return stored(terms), stored(keyed(GRAM + order, p.withColumn("value", F.log("p")))), unseen


def key_filter(model: DataFrame) -> np.ndarray:
    """A fixed-size bitmap with the bit of each key set, put together byte by byte."""
    place = F.shiftrightunsigned("key", 64 - FILTER_BITS)
    bit = F.get(F.array(*[F.lit(1 << i) for i in range(8)]), (place % 8).cast("int"))
    merged = model.select(F.floor(place / 8).cast("int").alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
    out[merged["at"].to_numpy()] = merged["bits"].to_numpy()
    return out


class Scorer:
    """What every task has of the model: hot n-grams of the longest order with their log
    probability, one for each slot; hot terms, sorted; the filter of keys."""

    def __init__(self, full: tuple, hot: tuple, bits: np.ndarray, order: int, unseen: float):
        self.order, self.unseen, self.bits = order, unseen, bits
        key, value = full
        self.slot_key, self.slot_value = np.zeros(1 << SLOT_BITS, dtype=U), np.full(1 << SLOT_BITS, np.nan)
        at = key >> U(64 - SLOT_BITS)
        self.slot_key[at], self.slot_value[at] = key, value
        by_key = np.argsort(hot[0])
        self.key, self.value = hot[0][by_key], hot[1][by_key]

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
        """For each text its bytes, its words and the log probability as far as known here;
        and what the sharded table has to add: (text, key, times)."""
        data, off = text_bytes(texts)
        size = np.diff(off)
        text = np.repeat(np.arange(len(size), dtype=np.int32), size)
        place = np.arange(len(data)) - off[text]
        space = ONE[data]
        words = np.bincount(text[~space & ((place == 0) | np.concatenate(([True], space[:-1]))[: len(data)])], minlength=len(size))
        key = spread(GRAM + self.order, grams_ending(data, self.order))
        at = key >> U(64 - SLOT_BITS)
        value = np.where((self.slot_key[at] == key) & (place >= self.order - 1), self.slot_value[at], np.nan)
        rest = np.flatnonzero(np.isnan(value))
        value[rest] = self.unseen
        total = np.bincount(text, weights=value, minlength=len(size))
        owner, keys = [], []
        g = np.zeros(len(rest), dtype=U)
        for k in range(1, self.order + 1):
            rest, g = (x[place[rest] >= k - 1] for x in (rest, g))
            g = g | (data[rest - (k - 1)].astype(U) << U(8 * (k - 1)))
            found = [spread(GRAM + k, g)] + ([spread(CONTEXT + k - 1, g >> U(8))] if k > 1 else [])
            for x in found:
                bit = x >> U(64 - FILTER_BITS)
                known = np.flatnonzero((self.bits[bit >> U(3)] >> (bit & U(7)).astype(np.uint8)) & 1)
                owner.append(text[rest[known]])
                keys.append(x[known])
        owner, keys = np.concatenate(owner), np.concatenate(keys)
        if len(self.key):
            at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
            hot = self.key[at] == keys
            total += np.bincount(owner[hot], weights=self.value[at[hot]], minlength=len(size))
            owner, keys = owner[~hot], keys[~hot]
        order = np.lexsort((keys, owner))
        owner, keys = owner[order], keys[order]
        first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1]))[: len(keys)])
        return size, words, total, (owner[first], keys[first], np.diff(np.append(first, len(keys))))


@lru_cache(maxsize=1)
def worker_scorer(shared: Broadcast) -> Scorer:
    return Scorer(*shared.value)


def perplexities(docs: DataFrame, labels: DataFrame, order: int = 5, hot_terms: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, n_words, perplexity) of every document; perplexity is per byte.

    The model learns from all labelled trusted documents of ``training_ids``. Its most
    frequent longest n-grams and its most frequent terms, at most ``hot_terms`` of
    each, go to every task; all of it stays a sharded table. Documents send only the
    keys that are not hot and that a fixed-size filter takes for known, once per
    document with their number, and a row of their own; these meet the table in one
    equi join, and sums per document are combined before their shuffle.
    """
    spark = docs.sparkSession
    model, full, unseen = kneser_ney(training_grams(docs, training_ids(labels), order, id_col, text_col), order)

    def hot(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        rows = most_frequent(df, hot_terms).select("key", "value").toArrow()
        return rows["key"].to_numpy().view(U), rows["value"].to_numpy()

    shared = spark.sparkContext.broadcast((hot(full), hot(model), key_filter(model), order, unseen))
    names = ["key", "row", "n", "value", "doc_id", "lang", "n_words", "n_bytes"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_scorer(shared)
        for b in (s for b in batches for s in slices(b, 3, 1 << 20)):
            size, words, total, (owner, keys, n) = scorer.score(b.column(3))
            row = b.column(0).to_numpy()
            own = spread(DOCUMENT, row.view(U))  # no term has such a key
            of = np.concatenate((owner, np.arange(len(row))))
            both = lambda x, y: pa.array(np.concatenate((x, y)).astype(np.int64))
            zero = np.zeros(len(keys), dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((keys, own)).view(np.int64)), pa.array(row[of]), both(n, 0 * row), pa.array(np.concatenate((zero.astype(float), total))),
                    b.column(1).take(pa.array(of)), b.column(2).take(pa.array(of)), both(zero, words), both(zero, size),
                ],
                names,
            )

    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("binary").alias("t"))
    rows = d.mapInArrow(score, "key long, row long, n long, value double, doc_id long, lang string, n_words long, n_bytes long")
    met = rows.join(model.select("key", F.col("value").alias("term")), "key", "left")
    total = F.sum(F.col("value") + F.col("n") * F.coalesce("term", F.lit(0.0))).alias("total")
    sums = met.groupBy("row", "doc_id", "lang").agg(total, F.sum("n_words").alias("n_words"), F.sum("n_bytes").alias("n_bytes"))
    ppl = F.exp(-F.col("total") / F.greatest("n_bytes", F.lit(1)))
    return sums.select("doc_id", "lang", "n_words", F.when(F.col("n_words") > 0, ppl).alias("perplexity"))


def learns(doc_id: Column) -> Column:
    """Which labelled documents train the model; the others set the thresholds."""
    return F.pmod(F.xxhash64(doc_id, F.lit("train")), F.lit(2)) == 0


def training_ids(labels: DataFrame) -> DataFrame:
    """The ids of all labelled trusted documents that train the model, each once."""
    return labels.where("quality = 1 and toxic = 0").select(F.col("doc_id").cast("long")).where(learns(F.col("doc_id"))).distinct()


def quality_classifier(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, slack: float = 1.5, **how) -> DataFrame:
    """One row per document: doc_id, lang, n_words, perplexity, threshold, kept.

    Each language's threshold is ``slack`` times the ``quantile`` of the perplexities
    of its trusted labelled documents that the model hasn't learnt from; languages
    without any take that of all such documents. Documents above it are rejected, and those without words.

    Null text counts as no words (perplexity null, rejected); null language is a
    language of its own. Null ids are judged alike; repeated rows are repeated; with
    no trusted document all with words are kept; an empty table gives no rows.
    """
    p = stored(perplexities(docs, labels, **how))
    good = labels.where("quality = 1 and toxic = 0").select(F.col("doc_id").cast("long")).where(~learns(F.col("doc_id"))).distinct()
    trusted = p.where("n_words > 0").join(good, "doc_id", "left_semi")
    q = F.percentile_approx("perplexity", quantile, 10000)
    by_lang = trusted.groupBy("lang").agg(q.alias("own")).withColumnRenamed("lang", "l")
    overall = trusted.agg(q.alias("q")).first().q
    limit = slack * F.coalesce("own", F.lit(overall).cast("double"))
    out = p.join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left").withColumn("threshold", limit)
    kept = (F.col("n_words") > 0) & (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))
    return out.select("doc_id", "lang", "n_words", "perplexity", "threshold", F.coalesce(kept, F.lit(False)).alias("kept"))


def op5_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Verification of quoted claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import fold_quote, strip


def quote_run_ratio(quote: Column, source: Column, shortest: int = 4) -> Column:
    """1 for a contained quote; else the longest run of its words found, over its words; 0
    for an empty quote or one of fewer than ``shortest`` words that isn't contained.

    Runs are tried from the longest down, and only until one is found. The quote is cut into
    words once, as the only entry of an array, and not again for each run."""
    n = F.size(F.split(quote, " "))

    def longest(words: Column) -> Column:
        found = lambda k: F.exists(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.contains(source, F.array_join(F.slice(words, i, k), " ")))
        return F.aggregate(F.sequence(F.greatest(F.size(words) - 1, F.lit(1)), F.lit(1), F.lit(-1)), F.lit(0), lambda acc, k: F.when((acc == 0) & found(k), k).otherwise(acc))

    best = F.element_at(F.transform(F.array(F.split(quote, " ")), longest), 1)
    return F.when(quote == "", 0.0).when(F.contains(source, quote), 1.0).when(n < shortest, 0.0).otherwise(F.round(best / n, 6))


def folded_hits(hits: DataFrame) -> DataFrame:
    """(run, chunk_id, s, known): what each run retrieved, folded; of a chunk that a run has
    twice with different contents, the smallest one."""
    one = hits.groupBy("run", "chunk_id").agg(F.min(F.coalesce("content", F.lit(""))).alias("content"))
    return one.select("run", "chunk_id", fold_quote(F.col("content")).alias("s"), F.lit(True).alias("known"))


def judge_claims(claims: DataFrame, folded: DataFrame, shortest: int = 4, least: float = 0.85) -> DataFrame:
    """Adds ratio and verdict to claims, which may be a stream; ``folded`` as of ``folded_hits``."""
    c = claims.withColumn("chunk_id", strip(F.coalesce("chunk_id", F.lit("")))).withColumn("q", fold_quote(F.coalesce("quote", F.lit(""))))
    j = c.join(folded, ["run", "chunk_id"], "left").withColumn("ratio", F.when(F.col("known"), quote_run_ratio(F.col("q"), F.col("s"), shortest)))
    verdict = F.when(F.col("known").isNull(), "unknown_chunk").when(F.size(F.split("q", " ")) < shortest, "quote_too_short").when(F.col("ratio") < least, "quote_not_found").otherwise("verified")
    return j.withColumn("verdict", verdict).drop("q", "s", "known")


def verify_claims(claims: DataFrame, hits: DataFrame, shortest: int = 4, least: float = 0.85) -> DataFrame:
    """Adds ratio and verdict: unknown_chunk, quote_too_short, quote_not_found or verified,
    tested in this order.

    A claim (run, chunk_id, quote) is held against what its run retrieved: ``hits`` has
    (run, chunk_id, content). A chunk of the corpus that the run did not retrieve is
    unknown. Only the hits that claims name are folded. Null ids, quotes and contents
    count as empty; a null run has no hits. Repeated claims are judged each; other columns
    of the claims are carried along, those named ratio and verdict replaced."""
    named = claims.select("run", strip(F.coalesce("chunk_id", F.lit(""))).alias("chunk_id")).distinct()
    own = hits.select("run", "chunk_id", "content").join(named, ["run", "chunk_id"], "left_semi")
    return judge_claims(claims, folded_hits(own), shortest, least)


def misjudged(verified: DataFrame) -> DataFrame:
    """The claims that were judged wrongly: real ones refused, made-up ones accepted."""
    return verified.where((F.col("verdict") == "verified") != F.col("real"))


def groundedness(verified: DataFrame) -> DataFrame:
    """(real, rate, n, failing): the share of real claims accepted and of made-up ones
    rejected, and how many were judged wrongly (``misjudged`` has them). Claims whose
    ``real`` is null are a row of their own, with no rate."""
    ok = (F.col("verdict") == "verified") == F.col("real")
    return verified.groupBy("real").agg(F.round(F.avg(ok.cast("double")), 6).alias("rate"), F.count("*").alias("n"), F.count_if(~ok).alias("failing"))


def feedback(judged: DataFrame) -> DataFrame:
    """(run, feedback): a line for each claim of a run that failed, with its issue and why, in
    order of issue; runs without one have no row. A run's claims are what one reply held."""
    bad = judged.where("verdict <> 'verified'").select("run", F.struct(F.coalesce("issue", F.lit("no issue")).alias("issue"), "verdict").alias("x"))
    line = F.transform(F.sort_array(F.collect_list("x")), lambda x: F.concat(F.lit("- "), x["issue"], F.lit(": "), x["verdict"]))
    return bad.groupBy("run").agg(F.array_join(line, "\n").alias("feedback"))


def rejections(judged: DataFrame) -> DataFrame:
    """(verdict, n, discarded): failed claims by reason, and those of them that came in the
    last attempt of their run, which nothing mends."""
    last = judged.groupBy("run").agg(F.max("attempt").alias("last"))
    bad = judged.where("verdict <> 'verified'").join(last, "run")
    return bad.groupBy("verdict").agg(F.count("*").alias("n"), F.count_if(F.col("attempt") == F.col("last")).alias("discarded"))

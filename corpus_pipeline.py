"""The corpus pipeline: five stages, each over all that the one before kept.

Every stage but the last returns the columns of ``documents``; the last returns one
row per document that is left: doc_id, n_tokens, ids_sha256, decoded_sha256, ids.
A stage decides row by row, so rows that share an id or have none are judged like any
other; of equal or near texts one row stays, whatever their ids. Null and empty texts
fail the quality rules. Empty tables give no rows, and other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import bpe_round_trip
from tessera.llm.common import gathered, stored, table
from tessera.llm.exact import exact_dedup
from tessera.llm.jaccard import TEXTS, jaccard_duplicates
from tessera.llm.mixing import mix
from tessera.llm.quality import quality_rules


def _numbered(docs: DataFrame) -> DataFrame:
    """With a number for each row, in a table: Spark may cut the files of ``docs`` otherwise at
    each read, as executors come and go, so the numbers are written once and read."""
    return stored(docs.withColumn("__row", F.monotonically_increasing_id()))


def _only(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of numbered ``docs`` whose numbers are in ``rows``."""
    return gathered(docs.join(rows.select("__row"), "__row", "left_semi").drop("__row"), docs.count(), TEXTS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; a map with the document carried along."""
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("__doc"))
    judged = quality_rules(rows, table(spark, sf_dir, "labels"), carry=("__doc",))
    # a row number keeps Spark from moving the filter below the counts, where each use would count anew
    kept = F.col("kept") & (F.monotonically_increasing_id() >= 0)
    return judged.select("__doc", kept.alias("__kept")).where("__kept").select("__doc.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest id."""
    docs = _numbered(docs)
    return _only(docs, exact_dedup(docs, row_col="__row").where("kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (shingles of five words, Jaccard 0.8 or more),
    the row with the smallest id: SimHash links within three bits, held against the sets,
    then what SimHash left apart."""
    docs = _numbered(docs)
    groups = jaccard_duplicates(docs, id_col="__row", percent=80, shingle=5)
    groups = groups.withColumnRenamed("doc_id", "__row")
    several = groups.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    most = docs.count()
    ids = groups.join(several, "component_id", "left_semi").join(docs.select("doc_id", "__row"), "__row")
    ids = stored(gathered(ids, most))
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("first"))
    # few rows go; as a table they have a known size, by which Spark sends them to the texts or shuffles both
    gone = stored(gathered(ids.join(first.select("first.__row"), "__row", "left_anti").select("__row"), most))
    return docs.join(gone, "__row", "left_anti").drop("__row")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the mix takes. None is repeated: rates are between 0 and 1, lowered as
    little as the weights of the poor and toxic tokens need."""
    docs = _numbered(docs)
    return _only(docs, mix(docs, table(spark, sf_dir, "labels"), ceiling=1.0, carry=("__row",)).where("copies >= 1"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of their decoding."""
    return bpe_round_trip(docs, contents=("ids",))


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("bpe", encoding_stage),
]

#: SQL can't state the stages of quality rules, near duplicates, mixing and BPE; tests hold
#: each against a brute-force version or a library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs

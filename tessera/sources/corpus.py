"""The chunks of the given documents with stored vectors and a stored index, and a query set."""

from __future__ import annotations

import tempfile
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import content_key
from tessera.operators.embedding import HashEncoder, embed_batches, reembed_corpus
from tessera.operators.lexical import LexicalIndex

from . import views as v
from .store import folder

_TEMPORARY: dict[str, str] = {}  # of sessions that name no shared folder, as in tests


def home(spark: SparkSession, d: str) -> str:
    """One folder for the corpus of a folder of tables, the same for the whole session."""
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None) or _TEMPORARY.setdefault(app, tempfile.mkdtemp(prefix="spark-ckpt-"))
    return f"{base.rstrip('/')}/corpus-{app}-{zlib.crc32(d.encode()):08x}"


def encoded(spark: SparkSession, d: str, parts: int = 16) -> DataFrame:
    """Chunks with ``embedding``. Vectors are stored by model and content: each text is
    encoded once, and a later call encodes only what has not been there."""
    encoder, at = HashEncoder(v.DIMS), f"{home(spark, d)}/vectors"
    chunks = v.chunks(spark, d).withColumn("key", content_key(F.lit(encoder.model), F.col("content")))
    texts = chunks.groupBy(F.col("key").alias("chunk_id")).agg(F.min("content").alias("content")).withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int"))
    reembed_corpus(texts, at, encoder, at_once=parts)
    vectors = spark.read.schema("chunk_id string, model string, embedding array<float>, part int").parquet(at).where(F.col("model") == encoder.model)
    return chunks.join(vectors.select(F.col("chunk_id").alias("key"), "embedding"), "key", "left").drop("key")


def index(spark: SparkSession, d: str) -> LexicalIndex:
    """The stored index, brought up to date with the documents."""
    x = LexicalIndex(spark, f"{home(spark, d)}/index")
    x.refresh(v.chunks(spark, d))
    return x


def query_set(spark: SparkSession, d: str) -> DataFrame:
    """(id, query, relevant) from one JSON document over many lines, which is written first:
    benchmark items that documents hold, with those documents. An evaluation set is
    small, so it is one value."""
    own = v.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("query"))
    relevant = v.relevance(spark, d).groupBy(F.col("query_id").alias("id")).agg(F.sort_array(F.collect_list("document_id")).alias("relevant"))
    at = folder(spark, "queries")
    rows = F.sort_array(F.collect_list(F.struct("id", "query", "relevant")))
    own.join(relevant, "id").agg(F.struct(F.lit("passages").alias("name"), rows.alias("queries")).alias("x")).select(F.to_json("x", {"pretty": "true"})).write.text(at)
    return read_query_set(spark, at)


def read_query_set(spark: SparkSession, at: str) -> DataFrame:
    read = spark.read.schema("name string, queries array<struct<id: long, query: string, relevant: array<long>>>").option("multiLine", True).option("mode", "FAILFAST").json(at)
    return read.select(F.explode("queries").alias("q")).select("q.*")


def eval_queries(asked: DataFrame) -> DataFrame:
    """(query_id, query, vector) of a query set."""
    q = asked.select(F.col("id").alias("query_id"), "query")
    return embed_batches(q, HashEncoder(v.DIMS), "query").withColumnRenamed("embedding", "vector")

"""The citation graph as an edge list: targets, and what hits lead to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import STOP, terms

from .embedding import Encoder, embed_batches
from .retrieval import cosine, depths, fuse, top


def resolve_targets(edges: DataFrame, named: DataFrame) -> DataFrame:
    """(source_id, target_ref, target_id): edges (source_id, target_ref) with the document
    (doc_id, source_ref) that is known by the reference, the smallest id of several but the
    edge's own; null where there is none. Repeated edges stay."""
    names = named.where("source_ref is not null").groupBy(F.col("source_ref").alias("target_ref")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    own = F.when(F.col("low") != F.col("source_id"), F.col("low")).when(F.col("high") != F.col("source_id"), F.col("high"))
    return edges.join(names, "target_ref", "left").select("source_id", "target_ref", own.alias("target_id"))


def cited_documents(hits: DataFrame, edges: DataFrame, best: int = 3, most: int = 3) -> DataFrame:
    """(query_id, target_id, ref): documents that a query's ``best`` hits (query_id, document_id,
    rank) cite by resolved ``edges`` and that are not among its hits, ``most`` by hit rank and
    reference."""
    known = edges.where("target_id is not null").select(F.col("source_id").alias("document_id"), "target_id", "target_ref")
    seen = hits.select("query_id", F.col("document_id").alias("target_id"))
    reached = hits.where(F.col("rank") <= best).join(known, "document_id").join(seen, ["query_id", "target_id"], "left_anti")
    reached = reached.groupBy("query_id", "target_id").agg(F.min("rank").alias("at"), F.min("target_ref").alias("ref"))
    w = Window.partitionBy("query_id").orderBy("at", "ref", "target_id")
    return reached.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("query_id", "target_id", "ref")


def passages(targets: DataFrame, chunks: DataFrame, encoder: Encoder) -> DataFrame:
    """(target_id, ref, chunk_id, score): the best passage of each cited document by hybrid search
    within it for the reference that it is cited by.

    ``targets`` (target_id, ref), ``chunks`` (chunk_id, document_id, label, content,
    embedding); null vectors have no part in the vectors' arm."""
    asked = embed_batches(targets.select("target_id", "ref").distinct(), encoder, "ref").withColumnRenamed("embedding", "vector")
    wanted = F.filter(F.array_distinct(terms(F.col("ref"))), lambda t: ~t.isin(STOP))
    asked = asked.withColumn("wanted", wanted)
    own = chunks.join(asked, F.col("document_id") == F.col("target_id")).withColumn("query_id", F.struct("target_id", "ref"))
    tf = F.size(F.filter(terms(F.concat_ws(" ", "label", "content")), lambda t: F.array_contains("wanted", t)))
    near, words = depths(1)
    by_vector = own.where("embedding is not null and vector is not null").select("query_id", "chunk_id", F.round(cosine(F.col("embedding"), F.col("vector")), 6).alias("score"))
    by_words = own.select("query_id", "chunk_id", tf.alias("score")).where("score > 0")
    return fuse((top(by_vector, near), top(by_words, words)), 1).select("query_id.*", "chunk_id", "score")


def expand_via_graph(hits: DataFrame, edges: DataFrame, queries: DataFrame, chunks: DataFrame, best: int = 3, most: int = 3) -> DataFrame:
    """(query_id, target_id, chunk_id, score): ``cited_documents``, each with its passage nearest
    to the query.

    ``queries`` (query_id, vector), ``chunks`` (chunk_id, document_id, embedding); null
    vectors have no part.
    """
    few = cited_documents(hits, edges, best, most).drop("ref")
    own = few.join(queries.select("query_id", "vector").where("vector is not null"), "query_id")
    own = own.join(chunks.where("embedding is not null").select(F.col("document_id").alias("target_id"), "chunk_id", "embedding"), "target_id")
    scored = own.select("query_id", "target_id", F.struct((-F.round(cosine(F.col("embedding"), F.col("vector")), 6)).alias("less"), "chunk_id").alias("x"))
    return scored.groupBy("query_id", "target_id").agg(F.min("x").alias("x")).select("query_id", "target_id", "x.chunk_id", (-F.col("x.less")).alias("score"))

"""Incremental ingest: documents, their chunks and their citation edges in one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.chunking import chunk_documents
from tessera.operators.citations import extract_citations
from tessera.sources.store import Tables, written

SCHEMAS = {
    "documents": "doc_id long, source_ref string, content_hash string",
    "chunks": "doc_id long, ordinal int, label string, chapter string, content string, token_count int",
    "edges": "source_id long, target_ref string, context string, target_id long",
}


def tables(spark: SparkSession, at: str, parts: int = 16) -> Tables:
    return Tables(spark, at, SCHEMAS, parts)


def ingest(t: Tables, batch: DataFrame, number: int, source: str = "stream") -> None:
    """One batch of documents (doc_id, source_ref, text) as a commit.

    Of a document that comes twice in a batch, the row with the largest hash counts. Those
    whose hash is stored are skipped. The chunks of the others replace the stored ones,
    their references are added to the edges that are there, and edges that lacked their
    target find it when it arrives, in this batch or later (the smallest id of those with
    the reference, never the document itself). Only partitions where something changes
    are read and written. A batch that is committed is skipped, so it can be replayed.
    Rows without doc_id are left out; a null text counts as empty.
    """
    if t.has(source, number):
        return
    spark, staged = t.spark, f"{t.at}/staged/{source}-{number}"
    rows = batch.where("doc_id is not null").select("doc_id", "source_ref", F.coalesce("text", F.lit("")).alias("text")).withColumn("content_hash", F.sha2("text", 256))
    one = rows.groupBy("doc_id").agg(F.max(F.struct("content_hash", "source_ref", "text")).alias("x")).select("doc_id", "x.*").withColumn("part", t.part(F.col("doc_id")))
    one = written(one, f"{staged}/incoming")
    some = lambda df: sorted(r.part for r in df.select("part").distinct().collect())  # noqa: E731  at most one row for each partition
    known = t.read("documents", some(one))
    changed = written(one.join(known.select("doc_id", "content_hash"), ["doc_id", "content_hash"], "left_anti"), f"{staged}/changed")
    parts = some(changed)
    ids = changed.select("doc_id")
    documents = t.read("documents", parts).join(ids, "doc_id", "left_anti").unionByName(changed.select("doc_id", "source_ref", "content_hash", "part"))
    own = chunk_documents(changed)
    own = own.select("doc_id", F.col("ordinal").cast("int").alias("ordinal"), "label", "chapter", "content", F.col("token_count").cast("int").alias("token_count"), t.part(F.col("doc_id")).alias("part"))
    chunks = t.read("chunks", parts).join(ids, "doc_id", "left_anti").unionByName(own)

    edges = t.read("edges")
    new = extract_citations(changed).select(F.col("doc_id").alias("source_id"), "target_ref", "context").join(edges.select("source_id", "target_ref"), ["source_id", "target_ref"], "left_anti")
    new = new.withColumns({"target_id": F.lit(None).cast("long"), "part": t.part(F.col("source_id"))})
    names = lambda df: df.where("source_ref is not null").groupBy(F.col("source_ref").alias("target_ref")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    # new edges look at all documents, old ones without a target only at those that arrived
    before = t.read("documents").join(ids, "doc_id", "left_anti")
    everyone = names(before.select("doc_id", "source_ref").unionByName(changed.select("doc_id", "source_ref")))
    target = F.when(F.col("low") != F.col("source_id"), F.col("low")).when(F.col("high") != F.col("source_id"), F.col("high"))
    found = new.join(everyone, "target_ref", "left").withColumn("target_id", target).drop("low", "high")
    late = edges.where("target_id is null").join(names(changed), "target_ref").withColumn("target_id", target).where("target_id is not null").drop("low", "high")
    fresh = written(found.unionByName(late), f"{staged}/edges")
    edge_parts = some(fresh)
    kept = t.read("edges", edge_parts).join(fresh.select("source_id", "target_ref"), ["source_id", "target_ref"], "left_anti")
    t.commit(source, number, {"documents": (documents, parts), "chunks": (chunks, parts), "edges": (kept.unionByName(fresh), edge_parts)})


def stream_ingest(docs: DataFrame, at: str, parts: int = 16, source: str = "stream") -> Tables:
    """A stream of documents into the tables at ``at``, a commit for each batch. Once more
    with the same ``source``: only new files are read. By another name the same documents
    are read again; all are unchanged, so no table is written, only a manifest."""
    t = tables(docs.sparkSession, at, parts)
    q = docs.writeStream.option("checkpointLocation", f"{t.at}/state/{source}").trigger(availableNow=True).foreachBatch(lambda batch, n: ingest(t, batch, n, source))
    q.start().awaitTermination()
    return t

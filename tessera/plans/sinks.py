"""What is written, read back as the query's rows; and streams over the tables' files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.operators import chunking, embedding
from tessera.sources import corpus
from tessera.sources import views as v
from tessera.sources.store import folder, written
from tessera.streaming import ingest
from tessera.streaming import streams as s

from . import search
from .registry import query


@query("SELECT event_type AS stage, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def metrics_sink(spark, d):
    """Metric rows as JSON lines."""
    m = v.table(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    at = folder(spark, "metrics")
    m.write.json(at)
    return spark.read.schema("stage string, n long, mean double").json(at)


@query(f"SELECT item_id AS id, benchmark.text AS query, list(doc_id ORDER BY doc_id) AS relevant FROM benchmark JOIN documents ON {v.ABOUT} GROUP BY ALL")
def scan_eval_queries(spark, d):
    """A query set in one JSON document over many lines, one row per query."""
    return corpus.query_set(spark, d)


@query(f"""WITH {v.EMBEDDED}, {v.EDGES}, c AS (SELECT kind, count(*) AS chunks, count(embedding) AS vectors FROM embedded GROUP BY kind), e AS (SELECT source AS kind, count(*) AS citations FROM edges JOIN documents ON doc_id = source_id GROUP BY source)
  SELECT source AS kind, count(*) AS documents, coalesce(any_value(chunks), 0) AS chunks, coalesce(any_value(vectors), 0) AS vectors, coalesce(any_value(citations), 0) AS citations FROM documents LEFT JOIN c ON c.kind = source LEFT JOIN e ON e.kind = source GROUP BY source""")
def corpus_sink(spark, d):
    """Documents, chunks and citations by kind, text first and vectors after it; what is read
    back is counted."""
    e, at = v.embedded(spark, d), folder(spark, "corpus")
    docs = v.table(spark, d, "documents").select("doc_id", F.col("source").alias("kind"), "text")
    docs.write.partitionBy("kind").parquet(f"{at}/documents")
    e.drop("embedding").write.partitionBy("kind").parquet(f"{at}/chunks")
    v.edges(spark, d).join(docs.select(F.col("doc_id").alias("source_id"), "kind"), "source_id").write.partitionBy("kind").parquet(f"{at}/citations")
    e.where("embedding is not null").select("chunk_id", "embedding").write.parquet(f"{at}/vectors")
    read = lambda name: spark.read.parquet(f"{at}/{name}").withColumn("kind", F.col("kind").cast("string"))
    c = read("chunks").join(spark.read.parquet(f"{at}/vectors"), "chunk_id", "left").groupBy("kind").agg(F.count("*").alias("chunks"), F.count("embedding").alias("vectors"))
    n = lambda name: read(name).groupBy("kind").agg(F.count("*").alias(name))
    return n("documents").join(c, "kind", "left").join(n("citations"), "kind", "left").na.fill(0)


@query()
def chunk_documents(spark, d):
    return chunking.chunk_documents(v.statutes(spark, d))


@query()
def preamble_span(spark, d):
    return chunking.split_sections(v.statutes(spark, d)).where("label = 'Preamble'")


@query()
def split_sections(spark, d):
    return chunking.split_sections(v.statutes(spark, d))


@query()
def tag_chapter(spark, d):
    return chunking.split_sections(v.statutes(spark, d)).select("doc_id", "pos", "label", "chapter")


@query()
def split_subsections(spark, d):
    sections = chunking.split_sections(v.statutes(spark, d)).where(t.token_estimate(F.col("content")) > 64)
    return sections.select("doc_id", "pos", F.inline(chunking.split_subsections(F.col("label"), F.col("content"))))


@query()
def pack_sentences(spark, d):
    docs = v.table(spark, d, "documents").where(t.token_estimate(F.col("text")) > 512)
    return docs.select("doc_id", F.posexplode(chunking.pack_sentences(F.col("text"))).alias("part", "content"))


@query("SELECT sha256(text) AS content_hash, count(*) > 0 AS seen FROM documents GROUP BY ALL")
def stream_dedup(spark, d):
    return s.stream_dedup(spark, d).select("content_hash", F.lit(True).alias("seen"))


@query(f"""WITH {v.RULINGS}, named AS (SELECT source_ref AS target_ref, min(doc_id) AS low, max(doc_id) AS high FROM rulings GROUP BY ALL)
  SELECT doc_id, sha256(text) AS content_hash, target_ref, CASE WHEN low <> doc_id THEN low WHEN high <> doc_id THEN high END AS target_id FROM rulings LEFT JOIN named USING (target_ref)""")
def stream_ingest(spark, d):
    """Documents with the edges that their references became, after a stream of them into
    documents, chunks and edges, and a replay, which changes nothing."""
    at, n = folder(spark, "ingest"), v.table(spark, d, "documents").count()
    stream = lambda: v.rulings(s.source(spark, d, "documents"), n)
    ingest.stream_ingest(stream(), at)
    t = ingest.stream_ingest(stream(), at, source="replay")
    edges = t.read("edges").select(F.col("source_id").alias("doc_id"), "target_ref", "target_id")
    return t.read("documents").select("doc_id", "content_hash").join(edges, "doc_id", "left")


@query(f"{search.VERIFIED} SELECT claim_id, run, chunk_id, quote, real, ratio, verdict FROM verified")
def stream_verify(spark, d):
    """Claims of documents that arrive, judged against what their run retrieved."""
    claims = v.claims_of(v.lines(s.source(spark, d, "documents")))
    return s.stream_verify(claims, v.hits(spark, d), folder(spark, "verify"))


_HASHED = f"{v.CHUNKS}, {v.hashed('hashed', 'chunk_id', 'content', 'chunks', 16)}, rounded AS (SELECT chunk_id, list_transform(embedding, lambda x: round(x::DOUBLE, 4) + 0.0) AS embedding FROM hashed)"


def rounded(df):
    return df.select("chunk_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 4)).alias("embedding"))


@query(f"WITH {_HASHED} SELECT chunk_id, embedding FROM chunks LEFT JOIN rounded USING (chunk_id) WHERE ordinal > 0")
def embed_batches(spark, d):
    """Vectors of the chunks that have none, by an encoder in batches."""
    pending = v.chunks(spark, d).where("ordinal > 0").select("chunk_id", "content")
    return rounded(embedding.embed_batches(pending, embedding.HashEncoder()))


@query(f"WITH {_HASHED} SELECT chunk_id, embedding FROM chunks LEFT JOIN rounded USING (chunk_id)")
def reembed_corpus(spark, d):
    """Vectors of all chunks after a change of model, in two runs, the first of which stops."""
    at = folder(spark, "reembed")
    part = F.pmod(F.xxhash64("document_id"), F.lit(8)).cast("int").alias("part")
    chunks = written(v.embedded(spark, d).select("chunk_id", "content", "embedding", part), f"{at}/chunks")
    old = chunks.where("embedding is not null").select("chunk_id", F.lit("old").alias("model"), "embedding", "part")
    written(old, f"{at}/vectors", ("part",))
    for rounds in (1, None):
        embedding.reembed_corpus(chunks.drop("embedding"), f"{at}/vectors", embedding.HashEncoder(), at_once=3, rounds=rounds)
    return rounded(spark.read.parquet(f"{at}/vectors"))

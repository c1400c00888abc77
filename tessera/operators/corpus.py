"""The stored corpus kept up to date: changes, upserts, cascades, rules, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["kind", "source_ref"]


def detect_changes(incoming: DataFrame, current: DataFrame, force: bool = False) -> DataFrame:
    """``incoming`` with ``change``: new, changed or unchanged by its hash against the stored
    row of the same (kind, source_ref); with ``force`` what is stored counts as changed.
    Both have content_hash; keys must be unique in ``current``. Null keys are new."""
    old = current.select(*KEY, F.col("content_hash").alias("__old"), F.lit(True).alias("__there"))
    same = F.col("__old").eqNullSafe(F.col("content_hash")) & ~F.lit(force)
    change = F.when(F.col("__there").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return incoming.join(old, KEY, "left").select(*incoming.columns, change.alias("change"))


def upsert_documents(incoming: DataFrame, current: DataFrame, now) -> DataFrame:
    """The table after the incoming rows: what changed takes the place of its stored row, which
    keeps its ``id`` and ``created_at``; ``updated_at`` is ``now`` for what is new or
    changed alone. Rows as (id, kind, source_ref, content_hash, created_at, updated_at and
    others that both have). Of rows that come twice, one with the largest hash counts."""
    rest = [c for c in current.columns if c not in (*KEY, "id", "created_at", "updated_at")]
    one = incoming.groupBy(*KEY).agg(F.max(F.struct("content_hash", *[c for c in rest if c != "content_hash"], "id")).alias("x")).select(*KEY, "x.*")
    touched = detect_changes(one, current).where("change <> 'unchanged'").drop("change")
    kept = current.join(touched.select(*KEY), KEY, "left_anti")
    old = current.select(*KEY, F.col("id").alias("__id"), F.col("created_at").alias("__created"))
    fresh = touched.join(old, KEY, "left").withColumns({"id": F.coalesce("__id", "id"), "created_at": F.coalesce("__created", F.lit(now)), "updated_at": F.lit(now)})
    return kept.select(*current.columns).unionByName(fresh.select(*current.columns))


def replace_chunks(stored: DataFrame, touched: DataFrame, fresh: DataFrame) -> DataFrame:
    """``stored`` chunks without those of ``touched`` documents (document_id), and ``fresh`` ones."""
    return stored.join(touched.select("document_id").distinct(), "document_id", "left_anti").select(*fresh.columns).unionByName(fresh)


def delete_documents(documents: DataFrame, chunks: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the documents in ``gone`` (id): their chunks and their own edges
    go with them, edges that lead to them stay but lose their target."""
    ids = gone.select("id").distinct()
    of = lambda c: ids.select(F.col("id").alias(c))
    left = edges.join(of("source_id"), "source_id", "left_anti")
    dead = of("target_id").withColumn("__dead", F.lit(True))
    left = left.join(dead, "target_id", "left").withColumn("target_id", F.when(F.col("__dead").isNull(), F.col("target_id"))).select(*edges.columns)
    return documents.join(ids, "id", "left_anti"), chunks.join(of("document_id"), "document_id", "left_anti").select(*chunks.columns), left


def constraint_report(documents: DataFrame, chunks: DataFrame, edges: DataFrame, dims: int) -> DataFrame:
    """(rule, violations) of each rule that the tables have to keep; a repeated key counts once."""
    twice = lambda df, *key: df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    rules = {
        "unique_document": twice(documents, *KEY), "unique_chunk": twice(chunks, "document_id", "ordinal"), "unique_edge": twice(edges, "source_id", "target_ref"),
        "token_count": chunks.where("token_count < 0"), "self_edge": edges.where("source_id = target_id"), "dimension": chunks.where(F.size("embedding") != dims),
        "orphan_chunk": chunks.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_anti"),
    }
    out = None
    for name, bad in rules.items():
        one = bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


def apply_embeddings(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """``chunks`` with the vectors (chunk_id, embedding) in place of their own; a chunk without a
    new vector, or with a null one, keeps what it has. Ids must be unique in ``vectors``;
    ids that no chunk has are ignored."""
    new = vectors.select("chunk_id", F.col("embedding").alias("__new"))
    return chunks.join(new, "chunk_id", "left").withColumn("embedding", F.coalesce("__new", "embedding")).select(*chunks.columns)

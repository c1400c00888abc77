"""Vectors of texts from an encoder that stays outside: batches, reuse and refilling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from tessera.functions.text import content_key
from tessera.sources.store import folder, listed, written


class Encoder(Protocol):
    """What is shipped to the workers is only this description; ``load`` makes the model."""

    model: str

    def load(self): ...  # an object with encode(list[str]) -> one vector for each text


@dataclass(frozen=True)
class HashEncoder:
    """Stands in for a model: words counted by the first byte of their MD5, in ``dims``
    groups of equal size, at unit length. A text without words has no vector."""

    dims: int = 16

    @property
    def model(self) -> str:
        return f"hash-{self.dims}"

    def load(self) -> HashEncoder:
        return self

    def encode(self, texts: list[str]) -> list[list[float] | None]:
        out = []
        for t in texts:
            v = np.bincount([hashlib.md5(w.encode()).digest()[0] * self.dims // 256 for w in t.split(" ") if w], minlength=self.dims)
            out.append((v / np.sqrt((v * v).sum())).tolist() if v.any() else None)
        return out


@lru_cache(maxsize=1)
def worker_model(encoder: Encoder):
    """Loaded once for all tasks of a Python worker."""
    return encoder.load()


def embed_batches(rows: DataFrame, encoder: Encoder, text_col: str = "content", batch: int = 32, window: int = 2048) -> DataFrame:
    """``rows`` with ``embedding``: array<float>, null for null texts and where the encoder gives none.

    A map: rows keep their partitions. Texts are gathered over Arrow batches, ``window`` at
    a time, and given to the encoder by length, ``batch`` at a time, so that a batch is
    not padded to one long text; then each goes back to its row. ``rows`` must not have a
    column ``embedding``.
    """
    at = rows.columns.index(text_col)
    schema = StructType([*rows.schema.fields, StructField("embedding", ArrayType(FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held, n = worker_model(encoder), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            texts = t.column(at).to_pylist()
            order = sorted((i for i, x in enumerate(texts) if x is not None), key=lambda i: len(texts[i]))
            found: list = [None] * len(texts)
            for k in range(0, len(order), batch):
                some = order[k : k + batch]
                for i, v in zip(some, model.encode([texts[i] for i in some]), strict=True):
                    found[i] = v
            yield from t.append_column("embedding", pa.array(found, pa.list_(pa.float32()))).to_batches()

        for b in batches:
            for i in range(0, b.num_rows, window):
                held.append(b.slice(i, window))
                n += held[-1].num_rows
                if n >= window:
                    yield from flush()
                    held.clear()
                    n = 0
        if n:
            yield from flush()

    return rows.mapInArrow(run, schema)


def embed_distinct(rows: DataFrame, encoder: Encoder, cache: DataFrame | None = None, text_col: str = "content") -> DataFrame:
    """``rows`` with ``embedding``: each different text is encoded once, and not at all where
    ``cache`` (key, embedding) has it; keys name the model, so another one's are not used.
    Null texts have no vector."""
    keyed = rows.withColumn("__key", F.when(F.col(text_col).isNotNull(), content_key(F.lit(encoder.model), F.col(text_col))))
    wanted = keyed.where("__key is not null").select("__key", F.col(text_col).alias("content")).dropDuplicates(["__key"])
    if cache is not None:
        known = cache.select(F.col("key").alias("__key"), "embedding").dropDuplicates(["__key"])
        wanted = wanted.join(known.select("__key"), "__key", "left_anti")
    vectors = embed_batches(wanted, encoder).select("__key", "embedding")
    vectors = vectors if cache is None else vectors.unionByName(known)
    return keyed.join(vectors, "__key", "left").drop("__key")


def reembed_corpus(chunks: DataFrame, vectors_at: str, encoder: Encoder, at_once: int = 4, rounds: int | None = None) -> list[dict]:
    """Refill the vectors (chunk_id, model, embedding, part) at ``vectors_at`` after a change of
    model, or where some are missing: progress as (done, total, parts) of each round.

    ``chunks`` has chunk_id, content and a partition column ``part`` of few values. Each
    round takes the next ``at_once`` partitions that lack a vector of this model, keeps
    what they have of it, encodes the rest and replaces just those partitions
    (dynamic overwrite). A run that stops, or does ``rounds`` only, goes on where it
    stopped; a finished one finds nothing to do. Progress is observed while the rows are
    written. Chunks with null content get a row without a vector, so they count as done.
    """
    spark = chunks.sparkSession
    kinds = "chunk_id string, model string, embedding array<float>, part int"

    def held() -> DataFrame:
        there = any(x.startswith("part=") for x in listed(spark, vectors_at))
        return (spark.read.schema(kinds).parquet(vectors_at) if there else spark.createDataFrame([], kinds)).where(F.col("model") == encoder.model)

    per = chunks.groupBy("part").agg(F.count("*").alias("n")).join(held().groupBy("part").agg(F.count("*").alias("have")), "part", "left").na.fill(0)
    counts = {r.part: (r.n, r.have) for r in per.collect()}  # a row for each partition
    total, done = sum(n for n, _ in counts.values()), sum(h for _, h in counts.values())
    pending = sorted(p for p, (n, have) in counts.items() if have < n)
    progress = []
    for i in range(0, len(pending), at_once)[:rounds]:
        parts = pending[i : i + at_once]
        # what is read is replaced by the same job, so it is set aside first
        own = written(held().where(F.col("part").isin(parts)), folder(spark, "kept"))
        lacking = chunks.where(F.col("part").isin(parts)).select("chunk_id", "content", "part").join(own, ["part", "chunk_id"], "left_anti")
        seen = Observation()
        fresh = embed_batches(lacking, encoder).observe(seen, F.count("*").alias("n"))
        out = fresh.select("chunk_id", F.lit(encoder.model).alias("model"), "embedding", "part").unionByName(own)
        out.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(vectors_at)
        done += seen.get["n"]
        progress.append({"parts": parts, "done": done, "total": total})
    return progress

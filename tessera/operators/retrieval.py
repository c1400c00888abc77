"""Vector, lexical and hybrid retrieval for many queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import STOP, terms
from tessera.sources.store import folder, written

from .lexical import LexicalIndex

NAMES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}


def dot(a: Column, b: Column) -> Column:
    prod = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best hits of each query with ranks from 1; ties by chunk id, null scores last."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def only(chunks: DataFrame, kind: str | None = None, document_id=None) -> DataFrame:
    """Chunks of one kind or one document; a filter that is not given is not there."""
    if kind is not None:
        chunks = chunks.where(F.col("kind") == kind)
    return chunks if document_id is None else chunks.where(F.col("document_id") == document_id)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of rows whose vector has a direction: not null, not zero, all components finite."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return v.where(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def unit(flat: np.ndarray, dims: int) -> np.ndarray:
    v = flat.reshape(-1, dims)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def packed(rows: DataFrame, id_col: str, vector_col: str, block: int) -> DataFrame:
    """(ids, vectors, dims): up to ``block`` rows as one, task by task, their usable vectors
    at unit length and end to end."""
    kind = dict(rows.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for b in batches if b.num_rows):
            sizes = pc.list_value_length(b.column(1)).to_numpy()
            for n in np.unique(sizes):  # one, but for mixed lengths
                own = pa.array(np.flatnonzero(sizes == n))
                v, ids = unit(b.column(1).take(own).flatten().to_numpy(), n), b.column(0).take(own)
                for i in range(0, len(ids), block):
                    cols = [[ids[i : i + block].to_pylist()], [v[i : i + block].ravel()], [n]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.list_(ids.type), pa.list_(pa.float64()), pa.int32()))], ["ids", "vectors", "dims"])

    return usable(rows, id_col, vector_col).mapInArrow(run, f"ids array<{kind}>, vectors array<double>, dims int")


def knn_join(queries: DataFrame, chunks: DataFrame, k: int, block: int = 1024, spread: int = 16) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k chunks with the largest cosine, in six
    decimals, for each query; ties by chunk id.

    Queries and chunks are packed into blocks of about ``block`` vectors, and every block of
    queries meets every block of chunks by a join on the number of the query block:
    Spark sends the query blocks to all tasks if their table is small, and shuffles both
    where it isn't, dealt over ``spread`` salts. A task keeps k rows for each query of
    the blocks at hand, so what is shuffled after it doesn't grow with the chunks.

    Rows whose vector is null, zero or not finite have no part. A chunk's vector of another
    length than a query's is an error. No queries or no chunks give no rows. Query ids
    should be unique: a repeated one takes its k hits from all its rows.
    """
    spark = chunks.sparkSession
    kinds = dict(queries.dtypes)["query_id"], dict(chunks.dtypes)["chunk_id"]
    q = usable(queries, "query_id", "vector")
    blocks = -(-q.count() // block)
    if not blocks:
        return spark.createDataFrame([], f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double, rank int")
    q = q.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("qblock"), F.size("v").alias("q_dims")).agg(F.collect_list(F.struct("id", "v")).alias("x"))
    q = q.select("qblock", F.col("x.id").alias("q_ids"), F.flatten("x.v").alias("q_vectors"), "q_dims")
    q = written(q, folder(spark, "queries"))  # a table, so that Spark knows its size
    c = packed(chunks, "chunk_id", "embedding", block)
    c = c.withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(spread)).cast("int"))
    both = c.join(q.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))), ["qblock", "salt"]).select("qblock", "q_ids", "q_vectors", "q_dims", "ids", "vectors", "dims")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}  # of each block of queries: vectors, ids, the scores and the chunks so far

        def out(ids: pa.Array, found: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
            row, col = np.nonzero(found > -np.inf)
            return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(names[row, col].tolist(), NAMES[kinds[1]]), pa.array(found[row, col])], ["query_id", "chunk_id", "score"])

        for b in batches:
            for i in range(b.num_rows):
                n, own_dims = b.column("dims")[i].as_py(), b.column("q_dims")[i].as_py()
                if n != own_dims:
                    raise ValueError(f"a chunk's vector has {n} components, a query's {own_dims}")
                at = (b.column("qblock")[i].as_py(), n)
                if at not in held:
                    if len(held) == 16:
                        yield out(*held.pop(next(iter(held)))[1:])
                    ids = b.column("q_ids")[i].values
                    held[at] = (unit(b.column("q_vectors")[i].values.to_numpy(), n), ids, np.full((len(ids), k), -np.inf), np.empty((len(ids), k), dtype=object))
                own, ids, found, names = held[at]
                s = np.floor((own @ b.column("vectors")[i].values.to_numpy().reshape(-1, n).T) * 1e6 + 0.5) / 1e6
                chunk = np.array(b.column("ids")[i].as_py(), dtype=object)
                for row in np.flatnonzero((s >= found[:, -1:]).any(axis=1)):
                    some = np.flatnonzero(s[row] >= found[row, -1])
                    score, name = np.append(found[row], s[row, some]), np.append(names[row], chunk[some])
                    best = sorted(np.flatnonzero(score > -np.inf), key=lambda j: (-score[j], name[j]))[:k]
                    found[row, : len(best)], names[row, : len(best)] = score[best], name[best]
        for x in held.values():
            yield out(*x[1:])

    return top(both.mapInArrow(score, f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double"), k)


def vector_search(vector: list[float], chunks: DataFrame, k: int, kind: str | None = None, document_id=None) -> DataFrame:
    """(chunk_id, score) of the k chunks nearest to one vector, of one kind or document."""
    one = chunks.sparkSession.createDataFrame([(0, [float(x) for x in vector])], "query_id long, vector array<double>")
    return knn_join(one, only(chunks, kind, document_id), k).select("chunk_id", "score", "rank")


def query_terms(queries: DataFrame) -> DataFrame:
    t = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))
    return t.where(~F.col("term").isin(STOP))


def rrf_fuse(arms: list[tuple[str, DataFrame, float]], limit: int, k: int = 60) -> DataFrame:
    """(query_id, chunk_id, score, matched_by, rank): the sum of weight / (k + rank) over arms
    (name, hits, weight), ``limit`` of each query after the ranking.

    Equal sums keep the order of the arms, then of the ranks there, then of the ids.
    ``matched_by`` names the arms that found a chunk, also those of weight 0. A chunk that
    an arm names twice adds up. Queries without hits have no rows; arms may be empty.
    """
    union = None
    for i, (name, hits, weight) in enumerate(arms):
        h = hits.select("query_id", "chunk_id", F.lit(name).alias("arm"), F.lit(i).alias("a"), "rank", (F.lit(weight) / (F.col("rank") + k)).alias("s"))
        union = h if union is None else union.unionByName(h)
    fused = union.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum("s"), 9).alias("score"), F.array_join(F.array_sort(F.collect_set("arm")), ",").alias("matched_by"), F.min(F.struct("a", "rank")).alias("first")
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "first.a", "first.rank", "chunk_id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("first")


def depths(limit: int) -> tuple[int, int]:
    """How many hits of the vector and of the lexical arm are fused for ``limit`` ones. They are
    parameters of the method, as is ``limit``: what matches by any term grows weak after
    the first few, and fused it would outvote near vectors."""
    per_arm = max(3 * limit, 20)
    return per_arm, min(per_arm, 3)


def hybrid_arms(queries: DataFrame, chunks: DataFrame, index: LexicalIndex, limit: int = 8, kind: str | None = None, document_id=None) -> tuple[DataFrame, DataFrame]:
    """Hits of the vector and of the lexical arm, each found once and written: fusions of
    other weights, and measures of each arm, read them again."""
    spark, (near, words) = chunks.sparkSession, depths(limit)
    by_vector = knn_join(queries, only(chunks, kind, document_id), near)
    by_words = index.search(queries, words, kind, document_id)
    return written(by_vector, folder(spark, "vector-hits")), written(by_words, folder(spark, "lexical-hits"))


def fuse(arms: tuple[DataFrame, DataFrame], limit: int = 8, weights: tuple[float, float] = (1.0, 0.1)) -> DataFrame:
    return rrf_fuse([("vector", arms[0], weights[0]), ("lexical", arms[1], weights[1])], limit)


def hybrid_search(queries: DataFrame, chunks: DataFrame, index: LexicalIndex, limit: int = 8, weights: tuple[float, float] = (1.0, 0.1), kind: str | None = None, document_id=None) -> DataFrame:
    """(query_id, chunk_id, score, matched_by, rank): both arms fused. Filters hold inside
    each arm, so that they don't take hits away after the ranking."""
    return fuse(hybrid_arms(queries, chunks, index, limit, kind, document_id), limit, weights)


def weak(queries: DataFrame, fused: DataFrame, least: float) -> DataFrame:
    """(query_id, best) of queries without a hit (null), or none of ``least`` or more."""
    best = fused.groupBy("query_id").agg(F.max("score").alias("best"))
    return queries.select("query_id").join(best, "query_id", "left").where(F.coalesce("best", F.lit(0.0)) < least)


def final_attempt(attempts: DataFrame, least: float, most: int = 2) -> DataFrame:
    """(clause, attempt, score, outcome) of attempts (clause, attempt from 1, score): each
    clause's first one with ``least`` or more, accepted; else its last up to number
    ``most``, exhausted if that is ``most``, else open. A null score is not enough."""
    a = attempts.where(F.col("attempt") <= most)
    enough = F.coalesce(F.col("score") >= least, F.lit(False))
    s = a.groupBy("clause").agg(F.min(F.when(enough, F.struct("attempt", "score"))).alias("good"), F.max(F.struct("attempt", "score")).alias("last"))
    x = F.coalesce("good", "last")
    outcome = F.when(F.col("good").isNotNull(), "accepted").when(F.col("last.attempt") == most, "exhausted").otherwise("open")
    return s.select("clause", x["attempt"].alias("attempt"), x["score"].alias("score"), outcome.alias("outcome"))

"""Exact nearest vectors by inner product; distances to pivots eliminate candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table
from .scan import running_sums

BLOCK = 4096  # candidates that a task holds at a time
CELLS = 4096  # groups of blocks whose bounds go to all tasks
ASKS = 4096  # queries that meet a block in one task
STEP = 256  # candidates that are evaluated before the bound is looked at again
EXACT = 2.0**52  # inner products below it are exact as doubles


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists as rows, filled up with zeros."""
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), dtype=flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def pivots_of(vectors: DataFrame, n: int, sample: int, scale: float) -> np.ndarray:
    """``n`` vectors far from each other, out of a ``sample`` chosen by a hash."""
    rows = vectors.orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(sample).select("x").toArrow().column(0).combine_chunks()
    width = pc.max(pc.list_value_length(rows)).as_py() or 0
    v = np.floor(matrix(rows, width) * scale)
    v = v[np.isfinite((v * v).sum(axis=1))]
    if not len(v):
        return np.zeros((1, width))
    chosen, far = [0], ((v - v[0]) ** 2).sum(axis=1)
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((v - v[chosen[-1]]) ** 2).sum(axis=1))
    return v[chosen]


def located(vectors: DataFrame, pivots: np.ndarray, scale: float) -> DataFrame:
    """(row, vec_id, v: scaled components, n2: squared length, dist: to each pivot), in order
    of the nearest pivot and the distance to it; ``row`` numbers them from 0. Vectors whose
    squared length is no finite double are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for b in batches if b.num_rows):
            sizes = pc.list_value_length(b.column(1))
            width = max(pc.max(sizes).as_py(), pivots.shape[1])
            with np.errstate(over="ignore", invalid="ignore"):
                v = np.floor(matrix(b.column(1), width) * scale)
                n2 = (v * v).sum(axis=1)
            own = np.flatnonzero(np.isfinite(n2))
            v, n2, sizes = v[own], n2[own], sizes.to_numpy()[own]
            p = np.zeros((len(pivots), width))
            p[:, : pivots.shape[1]] = pivots
            dist = np.sqrt(np.maximum(n2[:, None] + (p * p).sum(axis=1) - 2 * (v @ p.T), 0)).astype(np.float32)
            near = dist.argmin(axis=1)
            cut = lambda flat, ends, kind: pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(flat, kind))
            cols = [
                pa.array(np.ones(len(own), dtype=np.int64)), b.column(0).take(pa.array(own)), cut(v[np.arange(width) < sizes[:, None]], np.cumsum(sizes), pa.float64()), pa.array(n2),
                cut(dist.reshape(-1), np.arange(1, len(own) + 1) * len(pivots), pa.float32()), pa.array(sizes.astype(np.int32)), pa.array(near.astype(np.int32)), pa.array(dist[np.arange(len(own)), near]),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["row", "vec_id", "v", "n2", "dist", "size", "pivot", "near"])

    rows = vectors.mapInArrow(run, "row long, vec_id long, v array<double>, n2 double, dist array<float>, size int, pivot int, near float")
    rows = rows.withColumns({"zero": F.lit(0).cast("long"), "any": F.monotonically_increasing_id()})
    order = ["size", "pivot", "near", "vec_id", "any"]
    return running_sums(rows, "zero", order, ["row"], drop=("size", "pivot", "near", "any")).select((F.col("row") - 1).alias("row"), "vec_id", "v", "n2", "dist")


class Block:
    """Candidates in memory: nothing is evaluated whose bound is below the k-th score."""

    def __init__(self, parts: list[pa.Table], k: int):
        t = pa.concat_tables(parts).combine_chunks()
        col = lambda c: t.column(c).combine_chunks()
        self.width = pc.max(pc.list_value_length(col("v"))).as_py() or 0
        self.v, self.n2 = matrix(col("v"), self.width), t.column("n2").to_numpy()
        self.dist = np.ascontiguousarray(matrix(col("dist"), pc.list_value_length(col("dist"))[0].as_py()).T)
        self.row = t.column("row").to_numpy()
        ids = col("vec_id")
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        self.id, self.k = ids.fill_null(0).to_numpy(zero_copy_only=False), k
        self.longest = float(self.n2.max()) ** 0.5

    def best(self, of: np.ndarray, score: np.ndarray) -> np.ndarray:
        return np.lexsort((self.row[of], self.id[of], self.null[of], -score))[: self.k]

    def search(self, row: int, q: np.ndarray, n2: float, dist: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best candidates that score ``least`` or more."""
        q = q[: self.width]
        v = self.v[:, : len(q)]
        if n2**0.5 * self.longest >= EXACT:
            of = np.flatnonzero(self.row != row)
            whole = [int(x) for x in q]
            score = np.array([max(-(2**63) + 1, min(2**63 - 1, sum(a * int(b) for a, b in zip(whole, x)))) for x in v[of]], dtype=np.int64)
            keep = self.best(of, score)
            return of[keep], score[keep]
        gap = np.abs(self.dist - dist[:, None]).max(axis=0).astype(np.float64)
        gap = np.maximum(gap - 1e-6 * (self.longest + n2**0.5 + float(dist.max())), 0)
        bound = (n2 + self.n2 - gap * gap) / 2
        bound += 1e-9 * np.abs(bound) + 1
        bound[self.row == row] = -np.inf
        of = np.flatnonzero(bound >= least)
        of = of[np.argsort(-bound[of], kind="stable")]
        found, scores = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        for i in range(0, len(of), STEP):
            if len(found) == self.k and bound[of[i]] < scores[-1]:
                break
            some = of[i : i + STEP]
            some = some[self.row[some] != row]
            found, scores = np.append(found, some), np.append(scores, (v[some] @ q).astype(np.int64))
            keep = self.best(found, scores)
            found, scores = found[keep], scores[keep]
        return found, scores


def met(vectors: DataFrame, asks: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(q, query_id, row, vec_id, score): the k best of each block for each query (q: its
    row) that ``pairs`` (row, block) sends there.

    A block's rows come before its queries, so a task holds one block and one Arrow batch
    of queries. A block that many queries ask for is sent to several tasks, each with
    about ``ASKS`` of them.
    """
    tasks = stored(pairs.groupBy("block").agg(F.ceil(F.count("*") / ASKS).cast("int").alias("tasks")))
    kinds = "block long, salt int, kind int, row long, vec_id long, v array<double>, n2 double, dist array<float>, least double"
    names = [x.split()[0] for x in kinds.split(", ")]
    blocks = vectors.withColumn("block", F.floor(F.col("row") / BLOCK)).join(tasks, "block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    blocks = blocks.withColumns({"kind": F.lit(0), "least": F.lit(None).cast("double")}).select(*names)
    sent = pairs.join(tasks, "block").withColumn("salt", F.pmod(F.xxhash64("row"), F.col("tasks")).cast("int")).join(asks, "row").withColumn("kind", F.lit(1)).select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, block = None, [], None
        for b in (b for b in batches if b.num_rows):
            key = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("block", "salt", "kind")])
            begins = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
            for begin, end in zip(begins, np.append(begins[1:], b.num_rows)):
                here, kind = tuple(key[:2, begin]), key[2, begin]
                some = pa.Table.from_batches([b.slice(begin, end - begin)])
                if kind == 0:
                    if here != at:
                        at, parts, block = here, [], None
                    parts.append(some)
                    continue
                if block is None:
                    block, parts = Block(parts, k), []
                out = []
                q_row, q_id, n2, least = (some.column(c).to_pylist() for c in ("row", "vec_id", "n2", "least"))
                v, dist = some.column("v").combine_chunks(), some.column("dist").combine_chunks()
                for i in range(len(q_row)):
                    of, score = block.search(q_row[i], v[i].values.to_numpy(), n2[i], dist[i].values.to_numpy(), least[i])
                    ids = pa.array(block.id[of], mask=block.null[of])
                    out.append(pa.RecordBatch.from_arrays([pa.array([q_row[i]] * len(of), pa.int64()), pa.array([q_id[i]] * len(of), pa.int64()), pa.array(block.row[of]), ids, pa.array(score)], ["q", "query_id", "row", "vec_id", "score"]))
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    both = blocks.union(sent).repartition("block", "salt").sortWithinPartitions("block", "salt", "kind", "row")
    return both.mapInArrow(run, "q long, query_id long, row long, vec_id long, score long")


def surviving(asks: DataFrame, vectors: DataFrame, blocks: int) -> DataFrame:
    """(row, block) for each query and each block but its own in a cell with a bound of its
    k-th score (``least``) or more. Cells are runs of blocks, at most ``CELLS`` of them
    whatever the table's size: their bounds, at most 2 MB, go to all tasks."""
    per = -(-blocks // CELLS)
    n = len(vectors.select("dist").first()[0])
    ends = [f(F.get("dist", F.lit(p))).alias(f"{f.__name__}{p}") for f in (F.min, F.max) for p in range(n)]
    cell = F.floor(F.col("row") / (BLOCK * per)).alias("cell")
    cells = vectors.groupBy(cell).agg(F.max("n2").alias("n2"), *ends).toArrow()
    number, longest = cells.column("cell").to_numpy(), cells.column("n2").to_numpy()
    low, high = (np.stack([cells.column(f"{f}{p}").to_numpy().astype(np.float64) for p in range(n)], axis=1) for f in ("min", "max"))
    shared = vectors.sparkSession.sparkContext.broadcast((number, longest, low, high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, longest, low, high = shared.value
        for b in batches:
            rows, dist = b.column(0).to_pylist(), b.column(3)
            out_row, out_cell = [], []
            for i, (row, n2, least) in enumerate(zip(rows, b.column(1).to_pylist(), b.column(2).to_pylist())):
                d = dist[i].values.to_numpy().astype(np.float64)
                gap = np.maximum(np.maximum(low - d, d - high).max(axis=1), 0)
                gap = np.maximum(gap - 1e-6 * (longest**0.5 + n2**0.5 + d.max()), 0)
                bound = (n2 + longest - gap * gap) / 2
                own = number[bound + 1e-9 * np.abs(bound) + 1 >= least]
                out_row.append(np.full(len(own), row))
                out_cell.append(own)
            if out_row:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (out_row, out_cell)], ["row", "cell"])

    found = asks.select("row", "n2", "least", "dist").mapInArrow(run, "row long, cell long")
    first = F.col("cell") * per
    found = found.select("row", F.explode(F.sequence(first, F.least(first + per, F.lit(blocks)) - 1)).alias("block"))
    return found.where(F.col("block") != F.floor(F.col("row") / BLOCK))


def top_products(rows: DataFrame, k: int = 10, every: int = 100, scale: float = 1024.0, pivots: int = 32, sample: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose vec_id ``every`` divides, the
    k other rows with the largest inner product of the vectors' components, times ``scale``
    and rounded down; of equal scores the smaller vec_id comes first, null last.

    By pivots: |d(q, p) - d(x, p)| is at most d(q, x), which bounds the product of q and x
    from above, by the pivot that bounds it best. Each query first meets the block of
    candidates that it lies in itself; its k-th score there rules out cells of blocks, and
    in each block that is left candidates are evaluated in order of their bounds until no
    bound reaches the k-th score. Nothing is left out that could score as much.

    Vectors that are null or hold null or non-finite components take no part (nor those
    whose squared length exceeds a double). A shorter vector counts as filled up with
    zeros. Scores beyond 64 bits count as the largest or smallest long. Rows with equal ids
    are different rows, each with its own ranks; a null id is no query and the last of
    equal scores. No rows or no queries give no rows; other columns are unread.
    """
    x = F.col("embedding").cast("array<double>")
    finite = F.forall("x", lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    vectors = rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.col("x").isNotNull() & F.coalesce(finite, F.lit(False)))
    shape = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if vectors.isEmpty():
        return shape
    placed = located(vectors, pivots_of(vectors, pivots, sample, scale), scale)
    last = placed.agg(F.max("row")).first()[0]
    asks = stored(placed.where(F.col("vec_id") % every == 0))
    if last is None or asks.isEmpty():
        return shape
    own = asks.select("row", F.floor(F.col("row") / BLOCK).alias("block"))
    near = stored(met(placed, asks.withColumn("least", F.lit(float("-inf"))), own, k))
    kth = near.groupBy("q").agg(F.when(F.count("*") == k, F.min("score")).cast("double").alias("kth"))
    bounded = stored(asks.join(kth, F.col("row") == F.col("q"), "left").withColumn("least", F.coalesce("kth", F.lit(float("-inf")))).drop("q", "kth"))
    pairs = stored(surviving(bounded, placed, last // BLOCK + 1))
    every_hit = near.union(met(placed, bounded, pairs, k))
    w = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return every_hit.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op12_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))


#: The same by evaluating every pair. DuckDB's lambdas see the columns they are given.
OP12_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""

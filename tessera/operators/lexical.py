"""A stored index of terms with per-block maxima, and search that skips blocks by them."""

from __future__ import annotations

import json
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import STOP, terms
from tessera.sources.store import folder, get_text, listed, put_text, written

ENTRY = "chunk_id string, document_id long, kind string, digest binary"
POSTING = "struct<chunk_id: string, document_id: bigint, kind: string, tf: bigint>"
BLOCKS = f"term string, most bigint, longest int, postings array<{POSTING}>, bucket int"


def chunk_terms(chunks: DataFrame) -> DataFrame:
    """(chunk_id, document_id, kind, own): all terms in label and content with repeats, without
    stop words."""
    text = F.concat_ws(" ", *[c for c in ("label", "content") if c in chunks.columns])
    own = F.filter(terms(text), lambda t: ~t.isin(STOP))
    return chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("document_id").cast("long").alias("document_id"), "kind", own.alias("own"))


class LexicalIndex:
    """Postings of chunks (chunk_id, document_id, kind, label, content), stored at ``at``.

    Blocks hold up to ``block`` postings of one term, from the longest chunk down, with the
    block's largest frequency and longest chunk. A task packs its own chunks, some
    ``run`` terms at a time, so no posting is shuffled; what it packs lies in the order of
    ``buckets`` buckets by a hash of the term, so that a search for few terms skips pages. A
    refresh adds a segment with the chunks that are new or changed and notes which
    postings of older segments no longer hold; what did not change is not read again,
    but for its digest. A manifest makes a segment visible whole or not at all.
    Chunk ids must be unique and not null. Null labels and contents count as empty.
    """

    def __init__(self, spark: SparkSession, at: str, block: int = 128, buckets: int = 32, run: int = 1 << 20):
        self.spark, self.at, self.block, self.buckets, self.run = spark, at.rstrip("/"), block, buckets, run

    def segments(self) -> list[int]:
        return sorted(int(x.removesuffix(".json")) for x in listed(self.spark, f"{self.at}/commits") if x.endswith(".json"))

    def _read(self, name: str, kind: str) -> DataFrame:
        """A table over all segments, with ``segment``."""
        paths = [f"{self.at}/{name}/segment={n}" for n in self.segments() if json.loads(get_text(self.spark, f"{self.at}/commits/{n}.json"))[name]]
        if not paths:
            return self.spark.createDataFrame([], f"{kind}, segment int")
        return self.spark.read.schema(f"{kind}, segment int").option("basePath", f"{self.at}/{name}").parquet(*paths)

    def stale(self) -> DataFrame:
        """(chunk_id, segment): chunks whose postings in a segment no longer hold."""
        return self._read("stale", "chunk_id string, of int").select("chunk_id", F.col("of").alias("segment"))

    def entries(self) -> DataFrame:
        return self._read("entries", ENTRY).join(self.stale(), ["chunk_id", "segment"], "left_anti")

    def refresh(self, chunks: DataFrame) -> int:
        """Make the index that of ``chunks``; how many of them had to be indexed."""
        number = max(self.segments(), default=-1) + 1
        label = F.col("label") if "label" in chunks.columns else F.lit(None).cast("string")
        rows = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("document_id").cast("long").alias("document_id"), "kind", label.alias("label"), "content")
        digest = F.unhex(F.md5(F.to_json(F.struct("document_id", "kind", "label", "content"))))
        now = rows.select("chunk_id", "document_id", "kind", digest.alias("digest"))
        before = self.entries()
        new = written(now.join(before, ["chunk_id", "digest"], "left_anti").select("chunk_id", "document_id", "kind", "digest"), f"{self.at}/entries/segment={number}")
        gone = before.join(now, ["chunk_id", "digest"], "left_anti").select("chunk_id", F.col("segment").alias("of"))
        gone = written(gone, f"{self.at}/stale/segment={number}")
        n = new.count()
        if n == 0 and gone.isEmpty():
            return 0
        fresh = rows.join(new.select("chunk_id"), "chunk_id", "left_semi") if number else rows
        self._pack(chunk_terms(fresh)).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.at}/blocks/segment={number}")
        put_text(self.spark, f"{self.at}/commits/{number}.json", json.dumps({"entries": True, "stale": True, "blocks": n > 0}))
        return n

    def _pack(self, rows: DataFrame) -> DataFrame:
        """Blocks of the terms of ``rows``, as of ``chunk_terms``."""
        block, buckets, most = self.block, self.buckets, self.run

        def packed(t: pa.Table) -> Iterator[pa.RecordBatch]:
            size = pc.list_value_length(t.column("own")).to_numpy()
            # from the longest chunk down; equal ones by id
            order = pc.sort_indices(pa.table({"size": size, "chunk_id": t.column("chunk_id")}), [("size", "descending"), ("chunk_id", "ascending")])
            t, size = t.take(order), size[order.to_numpy()]
            own = t.column("own").combine_chunks()
            word = own.flatten().dictionary_encode()
            if not len(word):
                return
            bucket = pa.array([crc32(w.encode()) % buckets for w in word.dictionary.to_pylist()], pa.int32())
            by_word = pc.sort_indices(pa.table({"bucket": bucket, "term": word.dictionary}), [("bucket", "ascending"), ("term", "ascending")])
            place = np.empty(len(by_word), np.int64)
            place[by_word.to_numpy()] = np.arange(len(by_word))
            chunk = np.repeat(np.arange(len(size)), size)
            key, tf = np.unique(place[word.indices.to_numpy()] * len(size) + chunk, return_counts=True)
            code, chunk = np.divmod(key, len(size))
            begins = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            n = np.diff(np.append(begins, len(code)))
            at = np.flatnonzero((np.arange(len(code)) - np.repeat(begins, n)) % block == 0)
            rows = t.select(["chunk_id", "document_id", "kind"]).take(pa.array(chunk)).combine_chunks()
            posting = pa.StructArray.from_arrays([*[rows.column(c).combine_chunks() for c in ("chunk_id", "document_id", "kind")], pa.array(tf)], ["chunk_id", "document_id", "kind", "tf"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(code)), pa.int32()), posting)
            of = by_word.take(pa.array(code[at]))
            cols = [word.dictionary.take(of), pa.array(np.maximum.reduceat(tf, at)), pa.array(size[chunk[at]], pa.int32()), lists, bucket.take(of)]
            out = pa.RecordBatch.from_arrays(cols, ["term", "most", "longest", "postings", "bucket"])
            yield from (out.slice(i, 4096) for i in range(0, len(out), 4096))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for b in batches:
                held.append(b)
                n += len(b.column("own").flatten())
                if n >= most:
                    yield from packed(pa.Table.from_batches(held))
                    held, n = [], 0
            if held:
                yield from packed(pa.Table.from_batches(held))

        return rows.mapInArrow(run, BLOCKS)

    def postings(self) -> DataFrame:
        """(chunk_id, term, tf) that hold."""
        held = self._read("blocks", BLOCKS).select("segment", "term", F.inline("postings"))
        return held.join(self.stale(), ["chunk_id", "segment"], "left_anti").select("chunk_id", "term", "tf")

    def search(self, queries: DataFrame, k: int, kind: str | None = None, document_id=None) -> DataFrame:
        """(query_id, chunk_id, score, rank): the k chunks of each query with the largest sum of
        frequencies of its terms, any of which matches; ties by chunk id.

        First the block of each term with the longest chunks is read; the k-th sum there is
        one that the answer reaches. No sum exceeds the length of its chunk, nor the chunk's
        frequency of one term with the largest ones of the query's other terms. A block
        that stays below the k-th sum by either can't hold a chunk of the answer, so its
        postings are not unpacked: no chunk is lost, as what it lacks in the sum is less
        than it lacked already. A posting that one query needs is unpacked and shuffled
        once, and its chunk's sums for all queries that ask its term are made in one task. Filters hold before the ranking, as soon as blocks are read. A query of stop words only
        has no rows.
        """
        spark = self.spark
        q = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term")).where(~F.col("term").isin(STOP))
        q = written(q.distinct(), folder(spark, "terms"))
        asked = q.select("term").distinct()
        # pages of other buckets are skipped; a row for each bucket
        buckets = [r.bucket for r in asked.select((F.crc32("term") % self.buckets).cast("int").alias("bucket")).distinct().collect()]
        blocks = self._read("blocks", BLOCKS).where(F.col("bucket").isin(buckets)).join(asked, "term").select("term", "segment", "most", "longest", "postings")
        if kind is not None or document_id is not None:
            of = lambda x: (F.lit(True) if kind is None else x.kind == kind) & (F.lit(True) if document_id is None else x.document_id == document_id)
            blocks = blocks.withColumn("postings", F.filter("postings", of)).where(F.size("postings") > 0)
        blocks = written(blocks, folder(spark, "blocks"))
        most = blocks.groupBy("term").agg(F.max("most").alias("top"))
        together = q.join(most, "term").groupBy("query_id").agg(F.sum("top").alias("all"))
        stale = self.stale()

        rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
        best = q.join(self._longest(blocks), "term").select("query_id", "segment", F.inline("postings"))
        sums = best.join(stale, ["chunk_id", "segment"], "left_anti").groupBy("query_id", "chunk_id").agg(F.sum("tf").cast("double").alias("score"))
        sure = sums.withColumn("r", F.row_number().over(rank)).where(F.col("r") == k).select("query_id", F.col("score").alias("least"))
        bounds = q.join(most, "term").join(together, "query_id").join(sure, "query_id", "left")
        # what this term has to bring at least
        least = F.coalesce("least", F.lit(0.0))
        bounds = bounds.select("term", F.struct("query_id", least.alias("least"), (least - F.col("all") + F.col("top")).alias("need")).alias("w"))
        # the queries of each term: a row for each term that is asked, so no larger than the queries
        bounds = written(bounds.groupBy("term").agg(F.collect_list("w").alias("asking")), folder(spark, "bounds"))
        some = F.exists("asking", lambda w: (F.col("most") >= w.need) & (F.col("longest") >= w.least))
        needed = blocks.join(F.broadcast(bounds), "term").where(some).select("term", "segment", F.inline("postings"))
        held = needed.join(stale, ["chunk_id", "segment"], "left_anti").select("chunk_id", "term", "tf")
        # a posting is shuffled once, however many queries ask its term: they meet it after that
        scored = self._sums(held.repartition("chunk_id").sortWithinPartitions("chunk_id"), bounds, dict(queries.dtypes)["query_id"])
        return scored.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)

    @staticmethod
    def _longest(blocks: DataFrame) -> DataFrame:
        """(term, segment, postings): the block of each term with the longest chunks. Each task
        sends on one block of a term, so those of a common term don't all meet in one."""
        one = blocks.groupBy("term").agg(F.max(F.struct("longest", "most", (-F.col("segment")).alias("less"), "postings")).alias("x"))
        return one.select("term", (-F.col("x.less")).alias("segment"), "x.postings")

    def _sums(self, held: DataFrame, bounds: DataFrame, kind: str) -> DataFrame:
        """(query_id, chunk_id, score): sums of tf for each query that asks the terms of ``held``,
        whose rows lie by chunk_id, of those chunks that reach the query's least sum. The
        terms of the queries go to all tasks, so a query set is what a driver can hold."""
        parts, asked = self._parts, self.spark.sparkContext.broadcast(bounds.toArrow().combine_chunks())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = asked.value
            if not len(own):
                return
            words, lists = own.column("term").chunk(0), own.column("asking").chunk(0)
            flat, size = lists.flatten(), lists.value_lengths().to_numpy()
            begin = np.cumsum(size) - size
            who = flat.field("query_id").dictionary_encode()
            code, n = who.indices.to_numpy(), len(who.dictionary)
            bound = np.zeros(n)
            bound[code] = flat.field("least").to_numpy()

            def sums(t: pa.Table) -> Iterator[pa.RecordBatch]:
                names = t.column("chunk_id").combine_chunks().dictionary_encode()
                term = pc.index_in(t.column("term"), value_set=words).to_numpy()
                many = size[term]
                at = np.repeat(np.arange(len(t)), many)
                each = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + begin[term][at]
                # chunks lie one after another, so each has its own cells
                total = np.bincount(names.indices.to_numpy().astype(np.int64)[at] * n + code[each], t.column("tf").to_numpy()[at], len(names.dictionary) * n)
                found = np.flatnonzero(total > 0)
                found = found[total[found] >= bound[found % n]]
                cols = [who.dictionary.take(pa.array(found % n)), names.dictionary.take(pa.array(found // n)), pa.array(total[found])]
                yield pa.RecordBatch.from_arrays(cols, ["query_id", "chunk_id", "score"])

            rest = None
            for b in (b for b in batches if b.num_rows):
                t = pa.Table.from_batches([b] if rest is None else [*rest.to_batches(), b])
                ids = t.column("chunk_id").combine_chunks().dictionary_encode().indices.to_numpy()
                end = int(np.flatnonzero(ids == ids[-1])[0])  # the last chunk may go on
                for i, z in parts(ids[:end]):
                    yield from sums(t.slice(i, z - i))
                rest = t.slice(end)
            if rest is not None:
                yield from sums(rest)

        return held.mapInArrow(run, f"query_id {kind}, chunk_id string, score double")

    @staticmethod
    def _parts(ids: np.ndarray, chunks: int = 512) -> Iterator[tuple[int, int]]:
        """Ranges of rows of at most ``chunks`` chunks, whole ones, so that cells stay few."""
        if len(ids):
            edge = np.append(np.flatnonzero(np.append(True, np.diff(ids) != 0))[::chunks], len(ids))
            yield from zip(edge[:-1].tolist(), edge[1:].tolist())

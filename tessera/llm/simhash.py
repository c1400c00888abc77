"""SimHash near-duplicate detection with pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .components import connected_components

BITS = 64


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the 64-bit hashes, as a signed long."""
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), 65536):  # memory stays bounded for very long texts
        ones += np.unpackbits(h[i : i + 65536].view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 values of all word shingles, as a signed long."""
    words = text.lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype="<u8"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long) for every document. A null text counts as empty: fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t or b"", shingle) for t in (x.as_py() for x in b.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "id long, fp long")


def block_masks(distance: int, agree: int = 3) -> list[int]:
    """Masks of ``agree`` blocks of ``distance + agree`` (as signed longs): two
    fingerprints within ``distance`` bits are equal under at least one of them."""
    n = distance + agree
    edge = [BITS * i // n for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:])]
    masks = [sum(c) for c in combinations(blocks, agree)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Index pairs that connect what links of at most ``distance`` bits connect.

    Grows one tree after another, comparing a point with those not reached yet,
    so no more pairs than points come out however dense the group is.
    """
    left, out = np.arange(len(fps)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= distance
            found = left[near]
            out += [(at, x) for x in found]
            queue += list(found)
            left = left[~near]
    return out


def near_links(nodes: DataFrame, distance: int = 3, chunk: int = 4096) -> DataFrame:
    """(u, v) links among distinct fingerprints (``node`` long, ``fp`` long).

    Each fingerprint goes to the 20 keys of three agreeing blocks of six (about 32
    bits, so chance meetings stay rare at any size). Keys that one fingerprint has
    alone are dropped. A key with more than ``chunk`` fingerprints is dealt over
    pairs of chunks, each pair one bounded group, so that every pair of its
    fingerprints still meets; each group gives a spanning forest, never all pairs.
    """
    keys = nodes.select(
        "node", "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in block_masks(distance)])).alias("c", "v")
    )
    size = keys.groupBy("c", "v").agg(F.count("*").alias("n")).where("n > 1")
    dealt = (
        keys.join(size, ["c", "v"])
        .withColumn("k", F.ceil(F.col("n") / chunk).cast("int"))
        .withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .select("c", "v", F.least("mine", "j").alias("i"), F.greatest("mine", "j").alias("j"), "fp", "node")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows: np.ndarray) -> pa.RecordBatch:
            u, v = [], []
            if len(rows):
                cut_at = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
                for g in np.split(rows, cut_at):
                    pairs = forest(np.ascontiguousarray(g[:, 4]), distance)
                    u += [g[a, 5] for a, _ in pairs]
                    v += [g[b, 5] for _, b in pairs]
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        rest = np.empty((0, 6), dtype=np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.concatenate([rest, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], axis=1)])
            last = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(axis=1))
            at = last[-1] + 1 if len(last) else 0  # the last group may go on
            yield links(rows[:at])
            rest = rows[at:]
        yield links(rest)

    return dealt.repartition("c", "v", "i", "j").sortWithinPartitions("c", "v", "i", "j").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, shingle: int = 3) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    Texts are lower-cased (A-Z), cut into words at ASCII white space and into
    shingles of ``shingle`` words. Fingerprints link when at most ``distance`` bits
    differ; ``component_id`` is the smallest id that links reach. Equal
    fingerprints are one node, so any number of copies costs one row.

    Null or empty texts have fingerprint zero and link like any other; a null id
    never is a component's id (null where all ids are null); repeated rows are
    repeated in the result; an empty table gives no rows; other columns are unread.
    """
    fp = cut(fingerprints(docs, id_col, text_col, shingle))
    nodes = cut(fp.groupBy("fp").agg(F.min("id").alias("node")))
    comp = connected_components(near_links(nodes.where("node is not null"), distance))
    named = nodes.join(comp, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fp.join(named, "fp", "left").select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

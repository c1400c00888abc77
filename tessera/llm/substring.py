"""Substring deduplication on words by level-wise doubling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .windows import WordCodes, alone, anchors, covered, gram_hash, member

ID = ["key", "anon", "tkey"]


def identity(id_col: str, text_col: str, by_text: bool = False) -> list[Column]:
    """What tells rows apart. ``key`` is the id, of any value; without one it is a hash of the
    text and ``anon`` is true, so rows that lack an id neither mix with others nor meet in
    one group. ``tkey`` also tells rows of one id apart by their text, where asked for."""
    own = F.xxhash64(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")))
    tkey = own if by_text else F.lit(0).cast("long")
    return [F.coalesce(F.col(id_col).cast("long"), own).alias("key"), F.col(id_col).isNull().alias("anon"), tkey.alias("tkey")]


def repeated_ids(rows: list[tuple], sizes: list[int]) -> list[pa.Array]:
    """The identity columns of ``rows``, each as often as its size says."""
    return [pa.array(np.repeat(np.array(c, dtype=t), sizes)) for c, t in zip(zip(*rows), (np.int64, bool, np.int64))]


def level_lengths(start: int, target: int) -> list[int]:
    out = [start]
    while out[-1] < target:
        out.append(min(2 * out[-1], target))
    return out


def alive(codes: np.ndarray, levels: list[int], rare: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the target length that may be repeated, given for each level done
    the hashes that this document alone has: starts, and the hash and place of each
    one's window at the next level."""
    target, k = levels[-1], len(rare)
    n = len(codes) - target + 1
    if n < 1:
        e = np.empty(0, dtype=np.int64)
        return e, e.astype(np.uint64), e
    starts = np.arange(n)
    h = gram_hash(codes, levels[0])
    at = anchors(h, target - levels[0] + 1)
    for level in range(k):
        twice = alone(h, at)[1]
        go = ~member(h[at], rare[level]) | member(h[at], twice)
        starts, at = starts[go], at[go]
        if not len(starts):
            break
        at = starts + np.minimum(at - starts, target - levels[level + 1])
        h = gram_hash(codes, levels[level + 1])
    return starts, h[at] if len(starts) else np.empty(0, dtype=np.uint64), at


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, start: int = 10, contents: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, with
    ``contents``, kept_text.

    Removes each word that a window of ``window`` words covers whose words also
    start earlier (smaller id, or same document and earlier start), judged on the
    input.

    The first level counts, per document, the hashes of ``start``-word windows that
    anchor a full window; documents learn which of those no other document has.
    Only windows around the others go on to the next level, twice as long, until
    the full length, whose 96-bit hashes name the document that has each first.
    What goes back are the hashes that *one* document has (alone or first), so a
    passage that any number of documents share is one row after the map-side
    combine, and no key is hot. Text is shuffled by id and reused for the last pass.

    Null text counts as empty, a null id as larger than any other (null in the
    result). Rows that share an id, or have no id and the same text, count as occurrences
    of one document, each of which keeps its first ones. Texts shorter than a window lose
    nothing; empty tables give no rows; other columns are unread.
    """
    levels = level_lengths(min(start, window), window)
    texts = docs.select(*identity(id_col, text_col)[:2], F.col(text_col).cast("binary").alias("text"))

    def hashes(rows: DataFrame, level: int) -> DataFrame:
        """(h, key, anon): distinct hashes of each document's windows at ``level``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes = WordCodes()
            for b in batches:
                hs, ks = [], []
                lists = [c for c in b.columns[3:]]
                for i, (*k, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2))):
                    words = (t.as_py() or b"").split()
                    if len(words) < window:
                        continue
                    _, h, at = alive(codes.of(words), levels, [as_set(x, i) for x in lists])
                    if len(h):
                        hs.append(np.unique(h).view(np.int64))
                        ks.append(k)
                if hs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs)), *repeated_ids(ks, [len(h) for h in hs])], ["h", "key", "anon"])

        return rows.mapInArrow(run, "h long, key long, anon boolean")

    known = texts
    rare = []
    for level in range(len(levels) - 1):
        own = hashes(known, level).groupBy("h").agg(F.count("*").alias("n"), F.min("key").alias("key"), F.min("anon").alias("anon")).where("n = 1")
        rare.append(cut(own.groupBy("key", "anon").agg(F.collect_list("h").alias(f"r{level}"))))
        known = known.join(rare[-1], ["key", "anon"], "left")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for b in batches:
            his, los, ks = [], [], []
            for i, (k, anon, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2))):
                words = (t.as_py() or b"").split()
                if len(words) < window:
                    continue
                c = codes.of(words)
                s, h, _ = alive(c, levels, [as_set(x, i) for x in b.columns[3:]])
                if len(s):
                    hi, first = np.unique(h, return_index=True)
                    # a pair of 0 or 1 and the key says that the document has candidates
                    his.append(np.append(hi, np.uint64(anon)).view(np.int64))
                    los.append(np.append(gram_hash(c, window, 1)[s[first]] >> np.uint64(32), np.array([k]).view(np.uint64)).view(np.int64))
                    ks.append((k, anon))
            if his:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(his)), pa.array(np.concatenate(los)), *repeated_ids(ks, [len(h) for h in his])], ["hi", "lo", "key", "anon"])

    # as two longs, which hash aggregates update in place: the smallest id, and the smallest key of rows without
    owner = [F.min(F.when(c, F.col("key"))).alias(x) for c, x in ((~F.col("anon"), "named"), (F.col("anon"), "other"))]
    first = known.mapInArrow(full, "hi long, lo long, key long, anon boolean").groupBy("hi", "lo").agg(*owner)
    first = first.select("hi", F.coalesce("named", "other").alias("key"), F.col("named").isNull().alias("anon")).groupBy("key", "anon").agg(F.collect_list("hi").alias("first"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for b in batches:
            out = []
            firsts = b.column(b.num_columns - 1)
            for i, (k, anon, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2))):
                words = (t.as_py() or b"").split()
                kept = words
                if firsts[i].is_valid:
                    s, h, _ = alive(codes.of(words), levels, [as_set(x, i) for x in b.columns[3:-1]])
                    mine = np.zeros(len(s), dtype=bool)
                    mine[np.unique(h, return_index=True)[1]] = True  # this document's first
                    gone = covered(s[~(mine & member(h, as_set(firsts, i)))], window, len(words))
                    kept = [w for w, x in zip(words, gone) if not x]
                text = b" ".join(kept)
                out.append((None if anon else k, len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text.decode("utf-8", "replace") if contents else None))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())[: 4 + contents]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + contents])

    return known.join(first, ["key", "anon"], "left").mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * contents)


def as_set(column: pa.Array, i: int) -> np.ndarray:
    """Row i of a list column as sorted unsigned values; none for null."""
    x = column[i]
    return np.sort(x.values.to_numpy(zero_copy_only=False).view(np.uint64)) if x.is_valid else np.empty(0, dtype=np.uint64)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), contents=False)

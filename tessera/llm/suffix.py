"""Suffix-array deduplication on bytes: induced sorting and permuted common prefixes."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .substring import ID, as_set, identity, repeated_ids
from .windows import alone, anchors, byte_hash, covered, member


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; t ends with a unique 0."""
    up = np.sign(np.diff(t.astype(np.int32)))
    n = len(up)
    nxt = np.where(up != 0, np.arange(n), n)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    return np.append(np.append(up, 1)[nxt] > 0, True)


def _induce(t: np.ndarray, small: np.ndarray, size: np.ndarray, n_large: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array that sorted leftmost-smaller suffixes induce.

    Buckets are taken in turn; within a bucket, entries are handled in waves (one
    wave per repetition of the bucket's symbol), each wave as whole arrays.
    """
    sa = np.full(len(t), -1, dtype=np.int32)
    begin = np.concatenate(([0], np.cumsum(size)))
    middle, end = begin[:-1] + n_large, begin[1:]

    def put(pred: np.ndarray, edge: np.ndarray, step: int) -> None:
        c = t[pred]
        order = np.argsort(c, kind="stable")
        c, pred = c[order], pred[order]
        n = np.bincount(c, minlength=len(size))
        rank = np.arange(len(c)) - (np.cumsum(n) - n)[c]
        sa[edge[c] + (rank if step > 0 else -1 - rank)] = pred
        edge += step * n

    def below(entries: np.ndarray, large: bool) -> np.ndarray:
        pred = entries[entries > 0] - 1
        return pred[small[pred] != large]

    seeds = np.argsort(t[lms], kind="stable")
    seeds, n_seed = lms[seeds], np.bincount(t[lms], minlength=len(size))
    at = np.cumsum(n_seed) - n_seed
    used = np.flatnonzero(size)
    head = begin[:-1].copy()
    for c in used:
        lo = begin[c]
        while lo < head[c]:
            lo, wave = head[c], sa[lo : head[c]]
            put(below(wave, True), head, 1)
        if n_seed[c]:
            put(below(seeds[at[c] : at[c] + n_seed[c]], True), head, 1)
    tail = end.copy()
    for c in used[::-1]:
        hi = end[c]
        while hi > tail[c]:
            hi, wave = tail[c], sa[tail[c] : hi][::-1]
            put(below(wave, False), tail, -1)
        if n_large[c]:
            put(below(sa[begin[c] : middle[c]][::-1], False), tail, -1)
    sa[0] = len(t) - 1  # the sentinel is nobody's predecessor
    return sa


def _order(names: np.ndarray) -> np.ndarray:
    """Suffix order of the reduced string: ranks over 1, 2, 4, ... names, each round
    only among suffixes that are still tied."""
    m = len(names)
    order = np.argsort(names, kind="stable")
    s = names[order]
    new = np.append(True, s[1:] != s[:-1])
    rank = np.empty(m, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(m), 0))
    k = 1
    while True:
        slot = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(slot):
            return order
        at = order[slot]
        key = rank[at] * (m + 1) + np.where(at + k < m, rank[np.minimum(at + k, m - 1)] + 1, 0)
        o = np.argsort(key, kind="stable")
        at, key = at[o], key[o]
        first = np.append(True, key[1:] != key[:-1])
        order[slot], new[slot] = at, first
        rank[at] = np.maximum.accumulate(np.where(first, slot, 0))
        k *= 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of small non-negative integers that end with a unique 0."""
    small = _types(t)
    is_lms = np.append(False, small[1:] & ~small[:-1])
    lms = np.flatnonzero(is_lms).astype(np.int32)
    size = np.bincount(t)
    n_large = np.bincount(t[~small], minlength=len(size))
    if len(lms) < 2:
        return _induce(t, small, size, n_large, lms)
    sa = _induce(t, small, size, n_large, lms)
    found = sa[is_lms[sa]]  # sorted by their substring up to the next of the kind
    length = np.zeros(len(t), dtype=np.int32)
    length[lms] = np.append(np.diff(lms), 1)
    a, b = found[:-1], found[1:]
    same = length[a] == length[b]
    for k in range(int(length.max()) + 1):
        on = np.flatnonzero(same & (length[a] >= k))
        if not len(on):
            break
        same[on] = t[a[on] + k] == t[np.minimum(b[on] + k, len(t) - 1)]
    name = np.empty(len(t), dtype=np.int64)
    name[found] = np.cumsum(np.append(0, ~same))
    if not same.any():
        return _induce(t, small, size, n_large, found)
    return _induce(t, small, size, n_large, lms[_order(name[lms])])


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position, the suffix before it in order and their common prefix.

    Where the symbols before both are equal too, the prefix is one shorter than at
    the position before; only the other positions compare symbols, four at a time.
    """
    n = len(t)
    phi = np.full(n, -1, dtype=np.int32)
    phi[sa[1:]] = sa[:-1]
    back = np.append(np.uint16(0), t[:-1])
    fresh = (phi <= 0) | (back != back[phi])
    fresh[0] = True
    pad = np.concatenate((t, np.zeros(8, dtype=t.dtype))).astype(np.uint64)
    four = pad[:-3] | (pad[1:-2] << np.uint64(16)) | (pad[2:-1] << np.uint64(32)) | (pad[3:] << np.uint64(48))
    i = np.flatnonzero(fresh & (phi >= 0))
    lcp = np.zeros(n, dtype=np.int32)
    j, at, off = phi[i], i, 0
    while len(at):
        x = four[np.minimum(at + off, n)] ^ four[np.minimum(j + off, n)]
        end = x != 0
        low = x[end] & (~x[end] + np.uint64(1))
        lcp[at[end]] = off + (np.bitwise_count(low - np.uint64(1)).astype(np.int32) >> 4)
        at, j, off = at[~end], j[~end], off + 4
    place = np.arange(n, dtype=np.int32)
    last = np.maximum.accumulate(np.where(fresh, place, np.int32(0)))
    return phi, np.maximum(lcp[last] - (place - last), 0)


def repeated(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment, which of its ``length``-byte windows occurs twice or more
    among all windows of all segments."""
    sizes = np.array([len(s) for s in segments])
    t = np.frombuffer(b"\0".join(segments) + b"\0\0", dtype=np.uint8).astype(np.uint16) + np.uint16(2)
    ends = np.cumsum(sizes + 1) - 1
    t[ends], t[-1] = 1, 0
    phi, lcp = permuted_lcp(t, suffix_array(t))
    hit = np.zeros(len(t), dtype=bool)
    at = np.flatnonzero(lcp >= length)
    begins = ends - sizes
    room = ends[np.searchsorted(ends, at)] - at
    at = at[room >= length]
    hit[at] = hit[phi[at]] = True
    return [hit[b : b + max(0, n - length + 1)] for b, n in zip(begins, sizes)]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends (exclusive) of the runs of True."""
    d = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def candidates(text: bytes, length: int, gram: int, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts whose anchor is not the document's alone, the anchors' places, gram hashes."""
    h = byte_hash(text, gram)
    at = anchors(h, length - gram + 1)
    values = h[at]
    go = ~member(values, rare) | member(values, alone(h, at)[1])
    return np.flatnonzero(go), at[go], h


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = 32, block: int = 3 << 19, crowd: int = 20_000, contents: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and,
    with ``contents``, kept (binary).

    Removes each byte that a ``length``-byte string covers which also starts
    anywhere else; overlaps count; strings are judged on the input.

    1. Anchors: every window has one ``gram``-byte anchor; documents learn which
       anchors no other document has.
    2. Around the others, documents cut segments (windows with one anchor); equal
       segments are combined before and after the shuffle by anchor.
    3. Shards of whole anchors, about ``block`` bytes each, get a suffix array by
       induced sorting and permuted common prefixes; windows found once go back to
       the one document that has them. The segments of an anchor that more than
       ``crowd`` documents have are dealt by their windows' 128-bit hashes instead,
       so that no task has to hold an unbounded group.
    4. Documents drop what their other candidate windows cover.

    Null text counts as empty, a null id is passed through, ids have any value. Rows that
    share an id, or have none, are documents of their own; repeated rows count as
    copies. Texts under ``length`` bytes lose nothing. Empty tables give no rows; other
    columns are unread.
    """
    # ids alone tell rows apart unless one comes twice, which a count over ids says
    several = not docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    texts = docs.select(*identity(id_col, text_col, several), F.col(text_col).cast("binary").alias("text"))
    kinds = "key long, anon boolean, tkey long"
    whose = [F.min(x).alias(x) for x in ID]

    def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, ks = [], []
            for *k, t in zip(*(b.column(j).to_pylist() for j in range(3)), b.column(3)):
                t = t.as_py() or b""
                if len(t) >= length:
                    h = byte_hash(t, gram)
                    hs.append(alone(h, anchors(h, length - gram + 1))[0].view(np.int64))
                    ks.append(k)
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs)), *repeated_ids(ks, [len(h) for h in hs])], ["h", *ID])

    own = texts.mapInArrow(anchor_rows, f"h long, {kinds}").groupBy("h").agg(F.count("*").alias("n"), *whose)
    own = own.where((F.col("n") == 1) | (F.col("n") > crowd)).withColumn("crowded", F.col("n") > crowd)
    own = own.withColumn("key", F.when(F.col("crowded"), F.pmod("h", F.lit(4096))).otherwise(F.col("key")))
    lists = cut(own.groupBy("crowded", *ID).agg(F.collect_list("h").alias("rare")))
    rare = lists.where("not crowded").select(*ID, "rare")
    crowded = lists.where("crowded").select(F.explode("rare").alias("h"))
    n_crowded = crowded.count()
    known = texts.join(rare, ID, "left")

    def segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, (*k, t) in enumerate(zip(*(b.column(j).to_pylist() for j in range(3)), b.column(3))):
                t = t.as_py() or b""
                if len(t) < length:
                    continue
                s, at, h = candidates(t, length, gram, as_set(b.column(4), i))
                if len(s):
                    # says that the document has candidates
                    out.append((k[0], struct.pack("<q?q", *k), -1, *k))
                    cut_at = np.flatnonzero((np.diff(s) != 1) | (np.diff(at) != 0)) + 1
                    lo, hi = np.append(0, cut_at), np.append(cut_at, len(s)) - 1
                    hv = h[at[lo]].view(np.int64)
                    out += [(v, t[x : y + length], x, *k) for v, x, y in zip(hv.tolist(), s[lo].tolist(), s[hi].tolist())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()))], ["h", "seg", "s", *ID])

    segments = known.mapInArrow(segment_rows, f"h long, seg binary, s long, {kinds}")
    distinct = segments.groupBy("h", "seg").agg(F.count("*").alias("n"), F.min("s").alias("s"), *whose)

    def shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: list[tuple]) -> pa.RecordBatch:
            out = [(-1, -1, *k) for _, _, _, s, *k in rows if s < 0]
            rows = [r for r in rows if r[3] >= 0]
            if rows:
                for (_, _, n, s, *k), hit in zip(rows, repeated([r[1] for r in rows], length)):
                    if n == 1:
                        out += [(a, z, *k) for a, z in zip(*((x + s).tolist() for x in runs(~hit)))]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()))], ["a", "z", *ID])

        rows, size, last = [], 0, None
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if size >= block and r[0] != last:
                    yield solve(rows)
                    rows, size = [], 0
                last = r[0]
                rows.append(r)
                size += len(r[1])
        yield solve(rows)

    if 0 < n_crowded <= 100_000:  # under a megabyte; more are joined by a shuffle
        crowded = F.broadcast(crowded)
    cool = distinct.join(crowded, "h", "left_anti") if n_crowded else distinct
    single = cool.select("h", "seg", "n", "s", *ID).repartition("h").sortWithinPartitions("h").mapInArrow(shard_rows, f"a long, z long, {kinds}")
    if n_crowded:

        def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cols, ks = [[], [], [], []], []
                for _, seg, n, s, *k in zip(*(c.to_pylist() for c in b.columns)):
                    hi, lo = (byte_hash(seg, length, lane).view(np.int64) for lane in (0, 1))
                    ks.append(k)
                    for c, x in zip(cols, (hi, lo, np.full(len(hi), n), s + np.arange(len(hi)))):
                        c.append(x)
                if ks:
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c)) for c in cols), *repeated_ids(ks, [len(x) for x in cols[0]])], ["hi", "lo", "n", "s", *ID])

        windows = distinct.join(crowded, "h", "left_semi").select("h", "seg", "n", "s", *ID).mapInArrow(window_rows, f"hi long, lo long, n long, s long, {kinds}")
        once = windows.groupBy("hi", "lo").agg(F.sum("n").alias("n"), F.min("s").alias("s"), *whose).where("n = 1")
        single = single.union(once.select(F.col("s").alias("a"), (F.col("s") + 1).alias("z"), *ID))
    back = single.groupBy(*ID).agg(F.collect_list("a").alias("a"), F.collect_list("z").alias("z"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, (k, anon, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2))):
                t = t.as_py() or b""
                kept, spans = t, 0
                if b.column(4)[i].is_valid:
                    s, _, _ = candidates(t, length, gram, as_set(b.column(3), i))
                    edge = np.zeros(len(t) + 2, dtype=np.int64)
                    a, z = (np.array(b.column(c)[i].as_py()) for c in (4, 5))
                    np.add.at(edge, a[a >= 0], 1)
                    np.add.at(edge, z[a >= 0], -1)
                    s = s[np.cumsum(edge)[s] == 0]
                    gone = covered(s, length, len(t))
                    kept, spans = np.frombuffer(t, dtype=np.uint8)[~gone].tobytes(), len(runs(gone)[0])
                out.append((None if anon else k, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if contents else None))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())[: 5 + contents]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + contents])

    return known.join(back, ID, "left").select("key", "anon", "text", "rare", "a", "z").mapInArrow(
        remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * contents
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), contents=False)

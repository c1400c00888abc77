"""Near duplicates by exact shingle Jaccard: SimHash links first, a prefix filter finds the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, gathered, stored
from .components import connected_components
from .pieces import slices
from .simhash import majority, near_links
from .windows import U, WordCodes, gram_hash, mix

BUCKETS = 1 << 18  # of the counts by which shingles are ordered, rare ones first
SLICE = 8 << 20  # bytes of text in work at a time
TEXTS = 4096  # in a partition, where there are few


def shingle_set(text: bytes | None, codes: WordCodes, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all shingles; a shorter text is one shingle."""
    c = codes.of((text or b"").lower().split())  # of bytes: ASCII letters and white space only
    n = min(len(c), shingle)
    h = gram_hash(c, n) if n else c
    return np.unique(mix(h, np.full(len(h), U(n))))


def bucket_counts(docs: DataFrame, shingle: int) -> np.ndarray:
    """How many shingles of all texts fall into each bucket; a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n = WordCodes(), np.zeros(BUCKETS, dtype=np.int64)
        for b in (s for b in batches for s in slices(b, 1, SLICE)):
            if b.num_rows:
                h = np.concatenate([shingle_set(t.as_py(), codes, shingle) for t in b.column(1)])
                n += np.bincount((h % U(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["at", "n"])

    found = docs.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[found["at"].to_numpy()] = found["n"].to_numpy()
    return out


def prefix_keys(docs: DataFrame, counts: np.ndarray, shingle: int, percent: int) -> DataFrame:
    """(key, id, n, sig): the shingles of each text of which a text at least ``percent``
    % similar has one among its own: all but the most common ones, in one order for
    all texts. ``n`` is the size of the text's set and ``sig`` a hash of it."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = WordCodes(), shared.value
        for b in (s for b in batches for s in slices(b, 1, SLICE)):
            keys, row, size, sig = [np.empty(0, dtype=U)], [], [], []
            own = {}  # of equal sets in a batch the smallest id's goes on
            for i, (k, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1))):
                h = shingle_set(t.as_py(), codes, shingle)
                name = xxhash.xxh64_intdigest(h.tobytes())
                if k is not None and (name not in own or k < own[name][0]):
                    own[name] = k, i, h
            for name, (_, i, h) in own.items():
                most = len(h) - -(-percent * len(h) // 100) + 1
                keys.append(h[np.lexsort((h, counts[(h % U(BUCKETS)).astype(np.int64)]))[:most]] if len(h) else h)
                row += [i] * len(keys[-1])
                size += [len(h)] * len(keys[-1])
                sig += [name] * len(keys[-1])
            cols = [pa.array(np.concatenate(keys).view(np.int64)), b.column(0).take(pa.array(row, pa.int64())), pa.array(size, pa.int64()), pa.array(np.array(sig, dtype=U).view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, ["key", "id", "n", "sig"])

    return docs.mapInArrow(run, "key long, id long, n long, sig long")


def hashed_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, sig, hs): the set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for b in (s for b in batches for s in slices(b, 1, SLICE)):
            sets = [shingle_set(t.as_py(), codes, shingle) for t in b.column(1)]
            sig = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], dtype=U).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sig), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], ["id", "sig", "hs"])

    return docs.mapInArrow(run, "id long, sig long, hs array<long>")


def fingerprinted(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, sig, fp): a hash of the set of each text, and its SimHash fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for b in (s for b in batches for s in slices(b, 1, SLICE)):
            sets = [shingle_set(t.as_py(), codes, shingle) for t in b.column(1)]
            sig = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], dtype=U).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sig), pa.array([majority(h) for h in sets], pa.int64())], ["id", "sig", "fp"])

    return docs.mapInArrow(run, "id long, sig long, fp long")


def alike(pairs: DataFrame, docs: DataFrame, ids: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The pairs (u, su, v, sv) that are at least ``percent`` % similar, and the sets of ``ids``."""
    found = hashed_sets(docs.join(ids, "id", "left_semi").dropDuplicates(["id", "t"]), shingle)
    sets = stored(gathered(found, docs.count(), TEXTS))
    hu, hv = (sets.select(F.col("id").alias(x), F.col("sig").alias(f"s{x}"), F.col("hs").alias(f"h{x}")) for x in "uv")
    both = F.size(F.array_intersect("hu", "hv"))
    return pairs.join(hu, ["u", "su"]).join(hv, ["v", "sv"]).where(100 * both >= percent * (F.size("hu") + F.size("hv") - both)), sets


def simhash_links(docs: DataFrame, nodes: DataFrame, shingle: int, percent: int, distance: int) -> DataFrame:
    """(u, v): links of SimHash fingerprints that differ in at most ``distance`` bits, those of
    them whose sets are ``percent`` % similar. ``nodes`` has (node, sig, fp) of each different
    set; of those with one fingerprint each is held against the smallest, which stands for them."""
    n = nodes.where("node is not null")
    most = n.count()
    first = stored(gathered(n.groupBy("fp").agg(F.min(F.struct("node", "sig")).alias("x")).select("fp", "x.*"), most))
    sig = lambda x: first.select(F.col("node").alias(x), F.col("sig").alias(f"s{x}"))
    near = near_links(first.select("node", "fp"), distance).distinct().join(sig("u"), "u").join(sig("v"), "v").select("u", "su", "v", "sv")
    equal = n.select("fp", F.col("node").alias("u"), F.col("sig").alias("su")).join(first.select("fp", F.col("node").alias("v"), F.col("sig").alias("sv")), "fp").where("su <> sv")
    pairs = near.unionByName(equal.select("u", "su", "v", "sv"))
    # a fingerprint has 20 keys, in each of which a forest links it, and equal ones one first id
    pairs = stored(gathered(pairs, 21 * most))
    ids = stored(gathered(pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct(), most))
    return alike(pairs, docs, ids, shingle, percent)[0].select("u", "v")


def similar_forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Index pairs that connect what links of at least ``percent`` % connect; like
    ``simhash.forest``, no more pairs than sets come out."""
    size = np.array([len(s) for s in sets])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    start = np.append(0, np.cumsum(size))
    left, out = np.ones(len(sets), dtype=bool), []
    for first in range(len(sets)):
        if not left[first]:
            continue
        left[first] = False
        queue = [first]
        while queue and left.any():
            at = queue.pop()
            mark = np.zeros(len(values), dtype=bool)
            mark[flat[start[at] : start[at + 1]]] = True
            both = np.bincount(owner[mark[flat]], minlength=len(sets))
            found = np.flatnonzero(left & (100 * both >= percent * (size + size[at] - both)))
            left[found] = False
            out += [(at, int(x)) for x in found]
            queue += [int(x) for x in found]
            if 4 * left[owner].sum() < len(owner):  # what is reached needs no more looks
                stay = left.copy()
                stay[queue] = True
                keep = stay[owner]
                flat, owner = flat[keep], owner[keep]
                size_now = np.bincount(owner, minlength=len(sets))
                start = np.append(0, np.cumsum(size_now))
    return out


def jaccard_links(docs: DataFrame, shingle: int, percent: int, small: int = 32, chunk: int = 1024, known: DataFrame | None = None) -> tuple[DataFrame, int]:
    """(u, v) links that connect all pairs of ids at least ``percent`` % similar, but for those
    that ``known`` (sig, c) has in one component already; and how many they are at most.

    Two such texts share a key of ``prefix_keys``. Where at most ``small`` different
    sets have a key, all their pairs are compared, each pair once; the sets of a more
    common key are dealt over pairs of chunks, each one bounded group that gives a
    spanning forest. Nothing is sampled or capped.
    """
    counts = bucket_counts(docs, shingle)
    found = prefix_keys(docs, counts, shingle, percent)
    most = int(counts.sum()) * (100 - percent) // 100 + docs.count()
    # most keys are one text's alone: counts, combined before their shuffle, tell which, and
    # the keys are made again rather than stored, so that only shared ones take up disk
    shared = found.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
    keys = found.join(shared, "key", "left_semi").groupBy("key", "sig").agg(F.min("id").alias("node"), F.first("n").alias("n"))
    keys = stored(gathered(keys, most))
    most = keys.count()
    c = F.col("node") if known is None else F.coalesce("c", "node")
    keys = (keys if known is None else keys.join(known, "sig", "left")).withColumn("c", c)
    # a key whose sets are all connected already has no pair that is wanted
    size = keys.groupBy("key").agg(F.count("*").alias("k"), F.min("c").alias("low"), F.max("c").alias("high")).where("k > 1 and low < high").select("key", "k")
    keys = stored(gathered(keys.join(size, "key"), most))
    few, many = keys.where(F.col("k") <= small), keys.where(F.col("k") > small)
    a, b = few.select("key", F.col("node").alias("u"), F.col("sig").alias("su"), F.col("n").alias("nu"), F.col("c").alias("cu")), few.select("key", F.col("node").alias("v"), F.col("sig").alias("sv"), F.col("n").alias("nv"), F.col("c").alias("cv"))
    fits = (100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")) & (F.col("su") < F.col("sv")) & (F.col("cu") != F.col("cv"))
    # two sets have in common the keys they share and at most what lies beyond one's own keys; those
    # that share a more common key too are compared below, so here all that they share is counted
    beyond = F.ceil(F.lit(percent) * F.greatest("nu", "nv") / 100) - 1
    enough = (100 + percent) * F.least("nu", "nv", F.col("shared") + beyond) >= percent * (F.col("nu") + F.col("nv"))
    met = a.join(b, "key").where(fits).groupBy("u", "su", "nu", "v", "sv", "nv").agg(F.count("*").alias("shared"))
    pairs = stored(gathered(met.where(enough).select("u", "su", "v", "sv"), most * small // 2))
    # as a table the ids have a known size, by which Spark sends them to the texts or shuffles both
    ids = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).union(many.select("node")).distinct()
    ids = stored(gathered(ids, docs.count()))
    same, sets = alike(pairs, docs, ids, shingle, percent)
    hu = sets.select(F.col("id").alias("u"), F.col("sig").alias("su"), F.col("hs").alias("hu"))
    dealt = (
        many.withColumn("c", F.ceil(F.col("k") / chunk).cast("int"))
        .withColumn("mine", F.pmod(F.xxhash64("sig"), F.col("c")).cast("int"))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
        .select("key", F.least("mine", "j").alias("i"), F.greatest("mine", "j").alias("j"), F.col("node").alias("u"), F.col("sig").alias("su"))
        .join(hu, ["u", "su"])
        .select("key", "i", "j", "u", "hu")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
            pairs = similar_forest(sets, percent) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in pairs], pa.int64()), pa.array([ids[b] for _, b in pairs], pa.int64())], ["u", "v"])

        group, ids, sets = None, [], []
        for b in batches:
            for i in range(b.num_rows):
                at = tuple(b.column(c)[i].as_py() for c in range(3))
                if at != group:
                    yield links(ids, sets)
                    group, ids, sets = at, [], []
                ids.append(b.column(3)[i].as_py())
                sets.append(b.column(4)[i].values.to_numpy(zero_copy_only=False).astype(np.int64))
        yield links(ids, sets)

    crowded = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "u long, v long")
    most = pairs.count() + (many.agg(F.sum(F.ceil(F.col("k") / chunk))).first()[0] or 0)
    return same.select("u", "v").union(crowded), most


def jaccard_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, shingle: int = 5, distance: int = 3, **how) -> DataFrame:
    """(doc_id, component_id) of every id: the smallest id that links reach.

    Texts are lower-cased (A-Z), cut into words at ASCII white space and into
    shingles of ``shingle`` words (a shorter text is one). Two link when their sets
    of shingles, compared by 64-bit hashes, are at least ``percent`` % alike
    (common to all of both). Texts without words link to each other.

    SimHash goes first: fingerprints of the sets that differ in at most ``distance`` bits
    link their texts, if the sets are alike. Texts may be alike and differ in more bits,
    so what SimHash left apart meets by ``jaccard_links``: no link is lost.

    A null id never is a component's id (null where all equal texts' ids are null);
    repeated rows are repeated in the result; an empty table gives no rows.
    """
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    rows = cut(fingerprinted(d, shingle))
    nodes = stored(gathered(rows.groupBy("sig").agg(F.min("id").alias("node"), F.first("fp").alias("fp")), d.count()))
    most = nodes.count()
    # equal sets, among them the empty ones, link by their hash
    equal = rows.join(nodes.select("sig", "node"), "sig").where("id != node").select(F.col("id").alias("u"), F.col("node").alias("v"))
    close = cut(gathered(simhash_links(d, nodes, shingle, percent, distance), 21 * most))
    known = nodes.join(connected_components(close, close.count()), "node").select("sig", F.col("component").alias("c"))
    known = stored(gathered(known, most))
    links, found = jaccard_links(d, shingle, percent, known=known, **how)
    comp = connected_components(links.union(close).union(equal), found + close.count() + d.count())
    named = nodes.join(comp, "node", "left").select("sig", F.coalesce("component", "node").alias("component_id"))
    return rows.join(named, "sig", "left").select(F.col("id").alias("doc_id"), "component_id")

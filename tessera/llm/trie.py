"""The trie of shared conversation prefixes, with sums over subtrees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .scan import running_sums

PIECE = 1000  # ids of a row while they are gathered for a digest


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """(c, pos, key, n): each turn's place in its conversation from 0, a digest of role and
    text, and the text's code points.

    Turns are in order of ``turn`` (null first), equal ones by role, then text. Texts
    travel only where turns are equal; else their digests do.
    """
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    # a table, so that Spark knows its size and sends it to all tasks only if that is small
    ties = stored(rows.groupBy("c", "turn").agg(F.count("*").alias("n")).where("n > 1").select(F.col("c").alias("tc"), F.col("turn").alias("tt")))
    tied = rows.join(ties, (F.col("c") == F.col("tc")) & F.col("turn").eqNullSafe(F.col("tt")), "left")
    slim = tied.select(
        "c", "turn", *(F.when(F.col("tc").isNotNull(), F.col(x)).alias(x) for x in ("role", "text")), F.monotonically_increasing_id().alias("any"), F.lit(1).cast("long").alias("pos"),
        F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("key"), F.length("text").cast("long").alias("n"),
    )
    out = running_sums(slim, "c", ["turn", "role", "text", "any"], ["pos"], drop=("turn", "role", "text", "any"))
    return out.withColumn("pos", F.col("pos") - 1)


def shared(c: Column) -> Column:
    """How many first turns a conversation takes from its base."""
    return F.crc32(c.cast("string")) % 6


def rebuild(turns: DataFrame, shared_turns=shared, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations (c, total) and their turns (c, depth, key, n, total).

    Conversation c takes the first h (at most ``most``) turns of conversation c - c % 100,
    fewer if that has fewer, and its own ones after the first h.
    """
    sizes = stored(turns.groupBy("c").agg(F.count("*").alias("own")))
    h, base = shared_turns(F.col("c")), F.col("c") - F.col("c") % 100
    bases = sizes.select(F.col("c").alias("base"), F.col("own").alias("there"))
    whole = sizes.withColumn("base", base).join(bases, "base", "left").withColumn("taken", F.least(h, F.coalesce("there", F.lit(0))))
    whole = stored(whole.select("c", "base", "taken", (F.col("taken") + F.greatest(F.col("own") - h, F.lit(0))).alias("total")))
    head = turns.where((F.col("pos") < most) & (F.col("c") % 100 == 0)).withColumnRenamed("c", "base")
    head = head.join(whole, "base").where(F.col("pos") < F.col("taken")).select("c", (F.col("pos") + 1).alias("depth"), "key", "n", "total")
    tail = turns.where(F.col("pos") >= h).join(whole, "c").select("c", (F.col("pos") - h + F.col("taken") + 1).alias("depth"), "key", "n", "total")
    return whole.select("c", "total"), head.union(tail)


def nodes_of(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each conversation and node on its way, root included: (c, e: depth, r: the
    node's smallest member, ended, n_convs, leaves: 1 if childless, saved: its own).

    A way's key is a sum of hashes of (turn, depth) in 128 bits, so it can be summed by any
    number of tasks; (r, e) names a node from then on.
    """
    depth = F.col("depth")
    keyed = turns.select("c", "depth", "n", (depth == F.col("total")).alias("ended"), F.xxhash64("key", "depth").alias("k1"), F.xxhash64(F.lit(1), "depth", "key").alias("k2"))
    ways = running_sums(keyed, "c", ["depth"], ["k1", "k2"])
    node = stored(ways.groupBy("depth", "k1", "k2").agg(F.min("c").alias("r"), F.count("*").alias("n_convs"), F.count_if("ended").alias("n_ends"), F.max("n").alias("n")))
    value = [F.col("n_convs"), (F.col("n_convs") == F.col("n_ends")).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("n")).alias("saved")]
    deeper = ways.drop("n").join(node, ["depth", "k1", "k2"]).select("c", depth.alias("e"), "r", "ended", *value)
    root = conversations.agg(F.min("c").alias("r"), F.count("*").alias("n_convs"), F.count_if(F.col("total") > 0).alias("longer")).first()
    childless = F.lit(int(root.longer == 0)).cast("long")
    zero, own = F.lit(0).cast("long"), [F.lit(root.n_convs).cast("long").alias("n_convs"), childless.alias("leaves")]
    return stored(deeper.union(conversations.select("c", zero.alias("e"), F.lit(root.r).cast("long").alias("r"), (F.col("total") == 0).alias("ended"), *own, zero.alias("saved"))))


def bands(ways: DataFrame, height: int) -> DataFrame:
    """(c, band, xs): the nodes on c's way in each band of ``height`` levels and the root of
    the band below, where c is the smallest member of one at least: ``height`` + 1 at most."""
    band = F.floor(F.col("e") / height)
    both = F.when((F.col("e") > 0) & (F.col("e") % height == 0), F.array(band, band - 1)).otherwise(F.array(band))
    more = [x for x in ("n_convs",) if x in ways.columns]
    grouped = ways.select("c", F.explode(both).alias("band"), F.struct("e", "r", "leaves", "saved", *more).alias("x")).groupBy("c", "band").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    # the smallest member of a node is that of all below on its own way
    return stored(grouped.where(F.element_at("xs", -1)["r"] == F.col("c")))


def subtree_sums(ways: DataFrame, own: DataFrame, top: int, height: int) -> DataFrame:
    """(r, e, leaves, saved, n_children) of each node; ``own`` are the bands of ``ways``.

    A node sends its values to its ancestors within its band only. The roots of the bands,
    with those sums, are a tree of a ``height``-th of the levels; its sums are found in the
    same way, and each is sent to the ancestors in the band above. So rounds grow with the
    logarithm of the depth ``top``, and a node is sent ``height`` times at most.
    """
    member = F.filter("xs", lambda x: x["r"] == F.col("c"))
    above = F.filter("xs", lambda x: (x["e"] <= F.col("v.e")) & (F.floor(x["e"] / height) == F.col("band")))
    pairs = own.select("c", "band", "xs", F.explode(member).alias("v")).select("c", "band", "v", F.explode(above).alias("a"))
    inside = F.floor(F.col("v.e") / height) == F.col("band")
    sums = [F.sum(F.when(inside, F.col(f"v.{x}")).otherwise(0)).alias(x) for x in ("leaves", "saved")]
    found = pairs.groupBy(F.col("a.r").alias("r"), F.col("a.e").alias("e")).agg(*sums, F.count_if(F.col("v.e") == F.col("a.e") + 1).alias("n_children"))
    if top < height:
        return found
    found = stored(found)
    value = found.select(F.col("r").alias("c"), "e", "leaves", "saved")
    roots = ways.where(F.col("e") % height == 0).select("c", "e", "r").join(value, ["c", "e"], "left").withColumn("e", F.floor(F.col("e") / height))
    below = subtree_sums(roots, bands(roots, height), top // height, height).select(F.col("r").alias("c"), (F.col("e") * height).alias("ve"), "leaves", "saved")
    crossing = pairs.where(~inside).select("c", F.col("v.e").alias("ve"), F.col("a.r").alias("r"), F.col("a.e").alias("e")).join(below, ["c", "ve"])
    crossing = crossing.groupBy("r", "e").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    total = [(F.col(x) + F.coalesce(f"more_{x}", F.lit(0))).alias(x) for x in ("leaves", "saved")]
    return found.join(crossing, ["r", "e"], "left").select("r", "e", *total, "n_children")


def end_digests(ends: DataFrame) -> DataFrame:
    """(r, e, ends_sha256) of rows (r, e, c): each node's ids in ascending order, in decimal
    and joined by commas. Ids are joined in pieces of ``PIECE`` where they lie sorted;
    the task that takes a node's digest reads its pieces one after the other."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, at, ids = [], None, []
            for r, e, c in zip(*(x.to_pylist() for x in b.columns)):
                if (r, e) != at or len(ids) == PIECE:
                    if ids:
                        out.append((*at, ids[0], ",".join(map(str, ids))))
                    at, ids = (r, e), []
                ids.append(c)
            if ids:
                out.append((*at, ids[0], ",".join(map(str, ids))))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string())], ["r", "e", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, h = None, None
        for b in batches:
            out = []
            for r, e, _, ids in zip(*(x.to_pylist() for x in b.columns)):
                if (r, e) == at:
                    h.update(b"," + ids.encode())
                    continue
                if at is not None:
                    out.append((*at, h.hexdigest()))
                at, h = (r, e), hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["r", "e", "ends_sha256"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, h.hexdigest())], ["r", "e", "ends_sha256"])

    pieces = ends.select("r", "e", "c").repartitionByRange("r", "e", "c").sortWithinPartitions("r", "e", "c").mapInArrow(join, "r long, e long, first long, ids string")
    return pieces.repartition("r", "e").sortWithinPartitions("r", "e", "first").mapInArrow(digest, "r long, e long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, height: int = 8, shared_turns=shared) -> DataFrame:
    """One row for each node of the trie of the rebuilt conversations: conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without a conv_id take no part. Null roles and texts are empty ones; of equal
    turns, null ones included, the order is by role, then text, and repeated rows are turns
    of their own. Negative ids have their base towards zero, as ``%`` has it. An empty
    table has no root, so no rows. Other columns are unread.

    No task reads a whole conversation: turns are numbered and their keys summed by ranges
    (``running_sums``), sums climb by bands of ``height`` levels (``subtree_sums``).
    """
    whole, turns = rebuild(turns_in_order(conversations), shared_turns)
    ways = nodes_of(whole, turns)
    top = int(whole.agg(F.max("total")).first()[0] or 0)
    own = bands(ways, height)
    x = F.transform("xs", lambda x, i: F.struct(x["e"].alias("e"), x["n_convs"].alias("n_convs"), x["r"].alias("r"), F.when(i > 0, F.get("xs", i - 1)["r"]).alias("parent"), i.alias("i")))
    nodes = own.select(F.explode(F.filter(x, lambda x: (x["r"] == F.col("c")) & ((x["i"] > 0) | (x["e"] == 0)))).alias("x")).select("x.*")
    ends = end_digests(ways.where("ended"))
    none = hashlib.sha256(b"").hexdigest()
    out = nodes.join(subtree_sums(ways, own, top, height), ["r", "e"]).join(ends, ["r", "e"], "left")
    return out.select(
        F.col("r").alias("conv_id"), F.col("e").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))

"""Spelling variants: words one edit apart, by pairs of trie nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, stored, table

#: What is between two runs of letters: ASCII letters and the code points from C0 to FF.
BETWEEN = r"[^A-Za-zÀ-ÿ]+"
#: Letters that are left when A-Z are lower-cased; no more words than these differ at one place.
LETTERS = 26 + 64
SLICE = 1 << 20  # letters whose keys are made at a time


def words_of(docs: DataFrame, damage: int = 97, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n) of all runs of letters with ``least`` occurrences or more; a run loses one
    letter where ``damage`` divides its hash with the document's id. Occurrences are
    counted before they are shuffled."""
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.split(ascii_lower(F.coalesce("text", F.lit(""))), BETWEEN)).alias("run"))
    h = F.crc32(F.concat("d", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = run.where(F.length("run") >= shortest).select(F.when(h % damage == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= shortest)
    return word.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def shared_letters(a: str, b: str) -> int:
    m, i = min(len(a), len(b)), 0
    while i < m and a[i] == b[i]:
        i += 1
    return i


def numbered(words: DataFrame, col: str, number: str) -> DataFrame:
    """``words`` with ``number``, each one's place in order of ``col`` from 0, and ``nodes``:
    the numbers of the trie nodes on its way (node i ends with its letter i + 1).

    Words are dealt by ranges and sorted; a node gets its number where the first word that
    has it is met. What a task's first words share with the last word of the task before
    gets that word's numbers when the table is read; this takes the first and the last
    word of each task at the driver.
    """
    kinds = ", ".join(f"`{c}` {t}" for c, t in words.dtypes)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, path, start, at = TaskContext.get().partitionId(), "", [], 0, 0
        for b in (b for b in batches if b.num_rows):
            sizes, flat = [], []
            for w in b.column(col).to_pylist():
                same = shared_letters(last, w)
                path = path[:same] + list(range(start + same + 1, start + len(w) + 1))
                flat += path
                sizes.append(len(w))
                start, last = start + len(w), w
            n = b.num_rows
            nodes = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes))), pa.array(flat, pa.int64())).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, nodes, pa.array(np.arange(at, at + n)), pa.array(np.full(n, part, dtype=np.int32))], [*b.schema.names, "nodes", number, "__part"])
            at += n

    found = stored(words.repartitionByRange(col).sortWithinPartitions(col).mapInArrow(local, f"{kinds}, nodes array<long>, {number} long, __part int"))
    edge = F.struct(F.col(col).alias("word"), "nodes")
    ends = found.groupBy("__part").agg(F.min(col).alias("first"), F.max_by(edge, number).alias("last"), F.count("*").alias("n"), F.sum(F.length(col)).alias("letters"))
    before: dict[int, tuple] = {}
    rank, offset, word, way = 0, 0, "", np.empty(0, dtype=np.int64)
    for r in ends.orderBy("__part").collect():
        same = way[: shared_letters(word, r.first)]
        before[r["__part"]] = (rank, offset, same)
        own = np.array(r.last.nodes, dtype=np.int64)
        # the first word's nodes have the local numbers 1, 2, ...
        way = np.where(own <= len(same), np.append(0, same)[np.minimum(own, len(same))], own + offset)
        rank, offset, word = rank + r.n, offset + r.letters, r.last.word

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for b in batches if b.num_rows):
            parts, nodes, places = b.column("__part").to_numpy(), b.column("nodes"), b.column(number).to_numpy().copy()
            sizes, flat = pc.list_value_length(nodes).to_numpy(), nodes.flatten().to_numpy().copy()
            whose = np.repeat(parts, sizes)
            for part in np.unique(parts).tolist():
                rank, offset, same = before[part]
                places[parts == part] += rank
                own = flat[whose == part]
                flat[whose == part] = np.where(own <= len(same), np.append(0, same)[np.minimum(own, len(same))], own + offset)
            new = {"nodes": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat)), number: pa.array(places)}
            names = [c for c in b.schema.names if c != "__part"]
            yield pa.RecordBatch.from_arrays([new.get(c, b.column(c)) for c in names], names)

    return found.mapInArrow(shift, f"{kinds}, nodes array<long>, {number} long")


def node_pairs(words: DataFrame) -> DataFrame:
    """(p, s, kind, id, less: -n) of each word (id, n, word, nodes, back: the reversed word's).

    A word without letter i is the pair of the node of its first i letters and that of the
    reversed rest; kind 1 where letter i differs from the one before, so that of a run
    of equal letters the first stands for all, else 0. Kind 2 are the pairs of the word
    whole, cut at each place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for b in batches if b.num_rows):
            sizes = pc.list_value_length(b.column("nodes")).to_numpy().astype(np.int64)
            total, at = np.cumsum(sizes), 0
            while at < len(sizes):
                base = total[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(total, base + SLICE)))
                some = b.slice(at, end - at)
                n = sizes[at:end]
                place = lambda m: np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                # each way with the root, 0, in front
                first = np.cumsum(n + 1) - (n + 1)
                ways = []
                for c in ("nodes", "back"):
                    way = np.zeros((n + 1).sum(), dtype=np.int64)
                    way[np.delete(np.arange(len(way)), first)] = some.column(c).flatten().to_numpy()
                    ways.append(way)
                letters = np.frombuffer("".join(some.column("word").to_pylist()).encode("utf-32-le"), dtype=np.uint32)
                i, j = place(n), place(n + 1)
                fresh = np.append(True, letters[1:] != letters[:-1]) | (i == 0)
                whole, one = np.repeat(first, n + 1), np.repeat(first, n)
                p = np.concatenate((ways[0][one + i], ways[0][whole + j]))
                s = np.concatenate((ways[1][one + np.repeat(n, n) - 1 - i], ways[1][whole + np.repeat(n, n + 1) - j]))
                kind = np.concatenate((fresh.astype(np.int8), np.full(len(j), 2, dtype=np.int8)))
                of = pa.array(np.concatenate((np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(n)), n + 1))))
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(s), pa.array(kind), some.column("id").take(of), pc.negate(some.column("n").take(of))], ["p", "s", "kind", "id", "less"])
                at = end

    return words.select("id", "n", "word", "nodes", "back").mapInArrow(run, "p long, s long, kind byte, id long, less long")


def near_words(words: DataFrame) -> DataFrame:
    """(id, n_near, best: (-n, id) of the most frequent near word) of each word with a near one.

    The words of a pair are one letter apart, and no more than ``LETTERS`` and the one that
    is the pair without another letter, so each finds its own among them. Two words that
    differ by a replaced letter share the pair of its place alone; a longer and a
    shorter one that of the first letter of a run alone: nothing is counted twice.
    """
    groups = node_pairs(words).groupBy("p", "s").agg(F.sort_array(F.collect_list(F.struct("less", "id", "kind"))).alias("xs")).where(F.size("xs") > 1)
    one_apart = lambda x, y: (x["id"] != y["id"]) & (((x["kind"] < 2) & (y["kind"] < 2)) | (x["kind"] + y["kind"] == 3))
    own = F.transform("xs", lambda x: F.struct(x["id"].alias("id"), F.filter("xs", lambda y: one_apart(x, y)).alias("near")))
    each = groups.select(F.explode(own).alias("x")).select("x.id", F.size("x.near").alias("k"), F.get("x.near", F.lit(0)).alias("y")).where("k > 0")
    return each.groupBy("id").agg(F.sum("k").alias("n_near"), F.min(F.struct("y.less", "y.id")).alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """(id, root) of links (id, to) without cycles: each round doubles the steps taken."""
    now = stored(forms.select("id", F.col("to").alias("root")))
    while True:
        on = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        now = stored(now.select("id", "root").join(on, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("id", "root")


def spelling_variants(docs: DataFrame, ratio: int = 2, **how) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word; see ``words_of`` for its parameters.

    The form is the near word (one letter inserted, deleted or replaced) of largest n, the
    smallest in code-point order of several, if its n is ``ratio`` times the word's or
    more; the root is the last form. So n grows along forms, which have no cycles.

    A null text has no words, a null doc_id counts as empty text before the colon.
    Repeated rows count each; runs of any length are words. No words give no rows; other
    columns are unread.
    """
    counted = stored(words_of(docs, **how))
    forward = stored(numbered(counted, "word", "id"))
    back = numbered(forward.select("id", F.reverse("word").alias("rev")), "rev", "place").select("id", F.col("nodes").alias("back"))
    near = near_words(forward.join(back, "id"))
    # ids are in code-point order, so the best (-n, id) is the smallest word of the most frequent
    words = stored(forward.select("id", "word", "n").join(near, "id", "left").withColumn("to", F.when(-F.col("best.less") >= F.col("n") * ratio, F.col("best.id"))))
    roots = last_forms(words.where("to is not null").select("id", "to"))
    name = words.select(F.col("id").alias("to"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    last = words.select(F.col("id").alias("root_id"), F.col("word").alias("last"))
    found = words.join(name, "to", "left").join(roots.withColumnRenamed("root", "root_id"), "id", "left").join(last, "root_id", "left")
    return found.select("word", "form", F.coalesce("last", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))

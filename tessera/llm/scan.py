"""Running sums over a sorted table, whatever share of the rows one key has."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _sums(batch: pa.RecordBatch, key: str, sums: list[str], last, carry: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Keys of the batch and its running sums, begun with ``carry`` where its first key is ``last``."""
    keys = batch.column(key).to_numpy(zero_copy_only=False)
    begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(begins, len(keys)))
    out = []
    for j, s in enumerate(sums):
        x = batch.column(s).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        total = np.cumsum(x)
        before = total[begins] - x[begins]
        if keys[0] == last:
            before[0] -= carry[j]
        out.append(total - np.repeat(before, sizes))
    return keys, out


def running_sums(rows: DataFrame, key: str, order: list[str], sums: list[str], drop: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with the long columns ``sums`` replaced by their running sums (inclusive,
    modulo 2**64) within the long column ``key``, in ascending ``order``.

    Rows are dealt by ranges of key and order, so a key with most of the rows is spread
    over many tasks like any other. Each task sums its own rows in Arrow batches; the
    table is written once, and what a key has before a task's first row is added when it
    is read. That takes one row of each task at the driver. Columns in ``drop`` only order
    the rows. Keys must not be null.
    """
    kinds = dict(rows.dtypes)
    keep = [c for c in rows.columns if c not in drop]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carry, at = TaskContext.get().partitionId(), None, np.zeros(len(sums), dtype=np.uint64), 0
        for b in (b for b in batches if b.num_rows):
            keys, found = _sums(b, key, sums, last, carry)
            last, carry = keys[-1], np.array([x[-1] for x in found], dtype=np.uint64)
            new = dict(zip(sums, (pa.array(x.view(np.int64)) for x in found)))
            cols = [new[c] if c in new else b.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(b.num_rows, part, dtype=np.int32)), pa.array(np.arange(at, at + b.num_rows))], [*keep, "__part", "__at"])
            at += b.num_rows

    dealt = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    summed = stored(dealt.mapInArrow(local, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", __part int, __at long"))
    ends = summed.groupBy("__part").agg(F.min(key).alias("first"), F.max_by(F.struct(F.col(key).alias("key"), F.array(*sums).alias("sums")), "__at").alias("end"))
    carries: dict[int, tuple] = {}
    last, total = None, None
    for r in ends.orderBy("__part").collect():
        tail = np.array(r.end.sums, dtype=np.int64).view(np.uint64)
        if r.first == last:
            carries[r["__part"]] = (last, total)
            tail = tail + total if r.end.key == last else tail
        last, total = r.end.key, tail
    if not carries:
        return summed.select(*keep)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for b in batches if b.num_rows):
            keys, parts = b.column(key).to_numpy(zero_copy_only=False), b.column("__part").to_numpy()
            more = np.zeros((len(sums), b.num_rows), dtype=np.uint64)
            for part in np.unique(parts).tolist():
                if part in carries:
                    own = (parts == part) & (keys == carries[part][0])
                    more[:, own] = carries[part][1][:, None]
            cols = [pa.array((b.column(c).to_numpy().view(np.uint64) + more[sums.index(c)]).view(np.int64)) if c in sums else b.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays(cols, keep)

    return summed.drop("__at").mapInArrow(add, ", ".join(f"`{c}` {kinds[c]}" for c in keep))

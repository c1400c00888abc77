"""Token ids in files of byte planes, compressed plane by plane, with a chunk index."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table
from .pieces import SPACES, Ragged, Remembered, cut_pieces, slices

BLOCK = 1 << 16  # ids of a block


def pack(ids: np.ndarray, level: int = 1) -> tuple[bytes, list[int]]:
    """Blocks of ``BLOCK`` ids, each transposed to four byte planes that are
    compressed one by one; and the index: where each plane begins, and the end."""
    z, out, index = zstandard.ZstdCompressor(level=level), [], [0]
    for i in range(0, len(ids), BLOCK):
        for plane in np.ascontiguousarray(ids[i : i + BLOCK].astype("<u4").view(np.uint8).reshape(-1, 4).T):
            out.append(z.compress(plane.tobytes()))
            index.append(index[-1] + len(out[-1]))
    return b"".join(out), index


def unpack(data: bytes, index: list[int], begin: int = 0, end: int | None = None) -> np.ndarray:
    """The ids from ``begin`` to ``end``; only the blocks that hold them are read."""
    z, out = zstandard.ZstdDecompressor(), []
    blocks = (len(index) - 1) // 4
    first, last = begin // BLOCK, blocks if end is None else -(-end // BLOCK)
    for k in range(first, min(last, blocks)):
        planes = [z.decompress(data[index[4 * k + p] : index[4 * k + p + 1]]) for p in range(4)]
        out.append(np.stack([np.frombuffer(p, dtype=np.uint8) for p in planes], axis=1).reshape(-1).view("<u4"))
    ids = np.concatenate(out) if out else np.empty(0, dtype="<u4")
    return ids[begin - first * BLOCK : None if end is None else end - first * BLOCK]


class Pieces:
    """Ids of texts by the tokenizers library, which gets each distinct piece once.

    The vocabulary's pattern always splits where white space follows anything else, and
    looks no further than the white space and the word after it, so a text's ids are
    those of its pieces (``cut_pieces``), whatever white space they have.
    """

    def __init__(self, path: str, end_id: int, most: int = 1_500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab()
        self.size = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)  # bytes of each token
        self.size[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.remembered, self.end_id = Remembered(self.find, most), end_id

    def find(self, pieces: list[bytes]) -> Ragged:
        """Pieces with white space at the front only are encoded end to end, since the
        library splits them there, and told apart by the bytes that tokens stand for;
        the others, at a text's begin or end, one by one."""
        texts = [p.decode() for p in pieces]
        inner = np.fromiter((t[0] in SPACES and t[-1] not in SPACES and "<" not in t for t in texts), dtype=bool, count=len(texts))
        flat, sizes = [np.empty(0, dtype=np.int32)], np.zeros(len(pieces), dtype=np.int64)
        order = []
        joined = np.flatnonzero(inner)
        for i in range(0, len(joined), 10_000):
            some = joined[i : i + 10_000]
            own = [pieces[k] for k in some.tolist()]
            ids = np.array(self.library.encode_batch_fast([b"".join(own).decode()], add_special_tokens=False)[0].ids, dtype=np.int32)
            cut = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(p) for p in own]))
            sizes[some] = np.diff(cut + 1, prepend=0)
            flat.append(ids)
            order.append(some)
        single = np.flatnonzero(~inner)
        for i in range(0, len(single), 10_000):
            some = single[i : i + 10_000]
            found = [x.ids for x in self.library.encode_batch_fast([texts[k] for k in some.tolist()], add_special_tokens=False)]
            sizes[some] = [len(x) for x in found]
            flat.append(np.array([x for ids in found for x in ids], dtype=np.int32))
            order.append(some)
        order = np.concatenate(order)
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        return Ragged(np.concatenate(flat), sizes[order]).take(back)

    def encode(self, texts: pa.Array) -> Ragged:
        """Ids of each text and the end id."""
        distinct, number, edge = cut_pieces(texts)
        ids = self.remembered.of(distinct).join(Ragged(np.array([self.end_id], dtype=np.int32), np.ones(1, dtype=np.int64)))
        number = np.insert(number.astype(np.int64), edge[1:], len(distinct))
        out = ids.take(number)
        return Ragged(out.flat, np.diff(out.ends[edge + np.arange(len(edge))]))


@lru_cache(maxsize=1)
def worker_pieces(path: str, end_id: int) -> Pieces:
    """One for all tasks of a Python worker, so that they share what it remembers."""
    return Pieces(path, end_id)


def write_tokens(docs: DataFrame, path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", chunk_ids: int = 1 << 20) -> DataFrame:
    """The chunks, written to the shared folder and read as a table.

    Documents are dealt by ranges of id and sorted, so files follow ascending ids.
    A chunk holds whole documents, about ``chunk_ids`` ids (one longer document is
    one chunk): part and chunk number, the part's ids before it, its number of ids,
    its documents' ids and lengths, its blocks' bytes and their index.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, before = TaskContext.get().partitionId(), 0, 0
        pieces = worker_pieces(path, end_id)
        keys, lens, parts, size = [], [], [], 0

        def flush():
            ids = np.concatenate(parts)
            data, index = pack(ids)
            row = [[part], [chunk], [before], [len(ids)], [keys], [lens], [data], [index]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())]
            names = ["part", "chunk", "before", "n_ids", "doc_ids", "lens", "data", "index"]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], names)

        for s in (s for b in batches for s in slices(b, 1)):
            ids, own, at = pieces.encode(s.column(1)), s.column(0).to_pylist(), 0
            while at < len(own):
                # up to the document with which the chunk is full
                end = min(len(own), int(np.searchsorted(ids.ends, ids.ends[at] + chunk_ids - size)))
                keys += own[at:end]
                lens += np.diff(ids.ends[at : end + 1]).tolist()
                parts.append(ids.flat[ids.ends[at] : ids.ends[end]])
                size += len(parts[-1])
                at = end
                if size >= chunk_ids:
                    yield flush()
                    chunk, before = chunk + 1, before + size
                    keys, lens, parts, size = [], [], [], 0
        if keys:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    # by a hash of the text too, so that rows without an id are spread
    rows = rows.repartitionByRange("id", F.xxhash64("t")).sortWithinPartitions("id", F.xxhash64("t"), "t")
    kinds = "part int, chunk int, before long, n_ids long, doc_ids array<long>, lens array<long>, data binary, index array<long>"
    return stored(rows.mapInArrow(run, kinds), "uncompressed")  # planes are compressed already


def read_tokens(chunks: DataFrame, contents: bool = False) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32 and, with
    ``contents``, ids. ``start`` adds the ids of all parts before, one row per part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, before, keys, lens, data, index in zip(*(c.to_pylist() for c in b.columns)):
                ids = unpack(data, index)
                ends = np.cumsum(np.asarray(lens, dtype=np.int64))
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lens)]
                cols = [pa.array(keys, pa.int64()), pa.array([part] * len(keys), pa.int32()), pa.array(before + ends - lens, pa.int64()), pa.array(lens, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "part", "at", "n_tokens", "ids_crc32"]
                if contents:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32), pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    docs = chunks.select("part", "before", "doc_ids", "lens", "data", "index").mapInArrow(
        run, "doc_id long, part int, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * contents
    )
    # as many rows as parts, which the number of shuffle partitions bounds
    total = chunks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = total.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    out = docs.join(F.broadcast(offset), "part").withColumn("start", F.col("offset") + F.col("at"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * contents)


def token_files(docs: DataFrame, contents: bool = False, **how) -> DataFrame:
    """Encode, write and read back; see ``write_tokens`` and ``read_tokens``.

    A null text counts as empty: its end id alone. Null ids come first; rows that
    share an id follow each other in order of a hash of their texts. Empty tables give no rows.
    """
    return read_tokens(write_tokens(docs, **how), contents)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))

"""Texts of an Arrow column cut at white space into pieces, and ids of distinct pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode's White_Space: one byte in UTF-8, two, three.
ONE = np.zeros(256, dtype=bool)
ONE[[9, 10, 11, 12, 13, 32]] = True
TWO = [0xC285, 0xC2A0]
THREE = [0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080]
#: The same as characters.
SPACES = frozenset(map(chr, np.flatnonzero(ONE).tolist())) | {x.to_bytes(n).decode() for some, n in ((TWO, 2), (THREE, 3)) for x in some}
LEAD = np.zeros(256, dtype=bool)
LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def white(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text are part of a white-space character."""
    w = ONE[data]
    at = np.flatnonzero(LEAD[data])
    if len(at):
        last = len(data) - 1
        byte = lambda k: data[np.minimum(at + k, last)].astype(np.int64)
        two = byte(0) << 8 | byte(1)
        three = two << 8 | byte(2)
        for found, n in ((at[np.isin(two, TWO)], 2), (at[np.isin(three, THREE)], 3)):
            for k in range(n):
                w[found + k] = True
    return w


def slices(batch: pa.RecordBatch, column: int, most: int = 24 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of the batch with about ``most`` bytes of text at a time, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def cut_pieces(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Pieces are runs of white space and what follows it up to the next run: the distinct
    pieces, the number of each piece in the order of the texts, and where each text
    begins and ends among them. A null text has no pieces."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    begins = np.zeros(len(data) + 1, dtype=bool)
    w = white(data)
    begins[1:-1] = w[1:] & ~w[:-1]
    begins[off] = True
    at = np.flatnonzero(begins)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])
    coded = pieces.dictionary_encode()
    edge = np.frombuffer(coded.dictionary.buffers()[1], dtype=np.int64)[: len(coded.dictionary) + 1].tolist()
    distinct = (coded.dictionary.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
    return [distinct[a:z] for a, z in zip(edge, edge[1:])], coded.indices.to_numpy(), np.searchsorted(at, off)


class Ragged:
    """Lists of numbers of different length, end to end."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.ends = flat, np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))

    def take(self, which: np.ndarray) -> Ragged:
        begin, size = self.ends[which], self.ends[which + 1] - self.ends[which]
        shift = begin - (np.cumsum(size) - size)
        return Ragged(self.flat[np.repeat(shift, size) + np.arange(size.sum())], size)

    def join(self, other: Ragged) -> Ragged:
        return Ragged(np.concatenate((self.flat, other.flat)), np.concatenate((np.diff(self.ends), np.diff(other.ends))))


class Remembered:
    """Ids of pieces that were met before. With more than ``most`` of them, all but those
    of the texts at hand are forgotten."""

    def __init__(self, find: Callable[[list[bytes]], Ragged], most: int):
        self.find, self.most = find, most
        self.place: dict[bytes, int] = {}
        self.ids = Ragged(np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64))

    def of(self, pieces: list[bytes]) -> Ragged:
        """The ids of each of these distinct pieces."""
        place = np.array([self.place.get(p, -1) for p in pieces], dtype=np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            if len(self.place) + len(new) > self.most:
                old = np.flatnonzero(place >= 0)
                self.ids = self.ids.take(place[old])
                self.place = {pieces[i]: k for k, i in enumerate(old.tolist())}
                place[old] = np.arange(len(old))
            unseen = [pieces[i] for i in new.tolist()]
            first = len(self.place)
            self.ids = self.ids.join(self.find(unseen))
            place[new] = np.arange(first, first + len(new))
            self.place.update(zip(unseen, range(first, first + len(new))))
        return self.ids.take(place)

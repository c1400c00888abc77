"""BPE encoding and decoding through a minimal acyclic transducer of frequent words."""

from __future__ import annotations

import hashlib
import json
import mmap
import struct
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import most_frequent, shared_dir, stored, table
from .pieces import Ragged, Remembered, cut_pieces, slices

SLICE = 8 << 20  # bytes of text in work at a time
#: Unicode's White_Space.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def unassigned(pieces: list[bytes]) -> set[str]:
    """The characters of some pieces that Python's Unicode tables don't know."""
    return {c for c in set(b"".join(pieces).decode()) if unicodedata.category(c) == "Cn"}


class Vocabulary:
    """A byte-level BPE file with word ends: its pattern, ids and ranked merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.rank = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"\s", SPACE)).findall
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.letter = byte_letters()
        self.path, self.library = path, None

    def split(self, text: str, unknown: set[str]) -> list[str]:
        """The words of a text without special tokens, normalised. Python's tables and the
        library's class code points alike but for those that Python's lack, so texts with
        such ones (``unknown``) are split by the library."""
        if not unknown or unknown.isdisjoint(text):
            return self.words(self.normal(text))
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.byte = {x: b for b, x in enumerate(self.letter)}
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.byte[x] for x in w).decode() for w, _ in found]

    def normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def symbols(self, word: bytes) -> list[str]:
        s = [self.letter[b] for b in word]
        s[-1] += self.suffix
        return s

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the lowest-ranked pair is merged until none is left."""
        s, none, rank = self.symbols(word), 1 << 30, self.rank.get
        ranks = [rank(p, none) for p in zip(s, s[1:])]  # of each symbol with the next
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            s[i : i + 2] = [s[i] + s[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((s[i - 1], s[i]), none)
            if i < len(ranks):
                ranks[i] = rank((s[i], s[i + 1]), none)
        return [self.ids[x] for x in s]


class Merges:
    """The same merges for many words at once, as arrays."""

    NONE = np.int32(1 << 30)

    def __init__(self, vocabulary: Vocabulary, longest: int = 32):
        v = self.vocabulary = vocabulary
        self.longest = longest  # longer words are rare and merged one by one
        pairs = np.array([(v.ids[a] << 32 | v.ids[b], v.ids[a + b], rank) for (a, b), rank in v.rank.items()], dtype=np.int64).reshape(-1, 3)
        pairs = pairs[np.argsort(pairs[:, 0])]
        self.pair, self.merged, self.rank = pairs[:, 0], np.empty(len(pairs), dtype=np.int32), pairs[:, 2].astype(np.int32)
        self.merged[self.rank] = pairs[:, 1]
        self.inner = np.array([v.ids.get(x, -1) for x in v.letter], dtype=np.int32)
        self.last = np.array([v.ids.get(x + v.suffix, -1) for x in v.letter], dtype=np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.rank[at], self.NONE)

    def of(self, words: list[bytes]) -> Ragged:
        size = np.array([len(w) for w in words], dtype=np.int64)
        order, flat, sizes = [], [], []

        def add(which: np.ndarray, ids: np.ndarray) -> None:
            order.append(which)
            flat.append(ids.ravel())
            sizes.append(np.full(len(which), ids.shape[1]))

        for n in np.unique(size).tolist():
            which = np.flatnonzero(size == n)
            if n > self.longest:
                for i in which.tolist():
                    add(np.array([i]), np.array([self.vocabulary.merge(words[i])], dtype=np.int32))
                continue
            letters = np.frombuffer(b"".join([words[i] for i in which.tolist()]), dtype=np.uint8).reshape(-1, n)
            s = np.concatenate((self.inner[letters[:, :-1]], self.last[letters[:, -1:]]), axis=1)
            r = self.ranks(s[:, :-1], s[:, 1:])
            while n > 1:  # each round merges one pair of every word that still has one
                at = r.argmin(axis=1)
                low = r[np.arange(len(r)), at]
                over = low == self.NONE
                if over.any():
                    add(which[over], s[over])
                    go = ~over
                    which, s, r, at, low = which[go], s[go], r[go], at[go], low[go]
                if not len(which):
                    break
                row, n = np.arange(len(which)), n - 1
                s = np.take_along_axis(s, np.arange(n) + (np.arange(n) > at[:, None]), axis=1)
                r = np.take_along_axis(r, np.arange(n - 1) + (np.arange(n - 1) >= at[:, None]), axis=1)
                s[row, at] = self.merged[low]
                k = np.flatnonzero(at > 0)
                r[k, at[k] - 1] = self.ranks(s[k, at[k] - 1], s[k, at[k]])
                k = np.flatnonzero(at < n - 1)
                r[k, at[k]] = self.ranks(s[k, at[k]], s[k, at[k] + 1])
            if len(which):
                add(which, s)
        if not order:
            return Ragged(np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64))
        order = np.concatenate(order)
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        return Ragged(np.concatenate(flat), np.concatenate(sizes)).take(back)


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """A minimal acyclic automaton of the words, as flat arrays.

    Words are added in byte order; once a word leaves a path, its states are frozen,
    and equal ones (same finality, same edges) become one, so suffixes are shared.
    Each edge holds how many words lie before it, which adds up to a word's rank;
    the rank points into the id outputs.
    """
    entries = sorted(dict(entries).items())
    register: dict[tuple, int] = {}
    frozen: list[tuple] = []  # (final, ((label, state), ...))
    path: list[list] = [[False, []]]  # states of the last word, not frozen yet

    def freeze(depth: int) -> None:
        while len(path) > depth + 1:
            final, edges = path.pop()
            key = (final, tuple(map(tuple, edges)))
            if key not in register:
                register[key] = len(frozen)
                frozen.append(key)
            path[-1][1][-1][1] = register[key]

    last = b""
    for word, _ in entries:
        same = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
        freeze(same)
        for b in word[same:]:
            path[-1][1].append([b, -1])
            path.append([False, []])
        path[-1][0] = True
        last = word
    freeze(0)
    frozen.append((path[0][0], tuple(map(tuple, path[0][1]))))
    count = []
    first, labels, targets, before = [0], bytearray(), [], []
    for final, edges in frozen:  # children come first
        n = int(final)
        for b, s in edges:
            labels.append(b)
            targets.append(s)
            before.append(n)
            n += count[s]
        count.append(n)
        first.append(len(labels))
    out = np.concatenate([np.asarray(ids, dtype="<i4") for _, ids in entries]) if entries else np.empty(0, "<i4")
    ends = np.cumsum([0] + [len(ids) for _, ids in entries])
    arrays = [np.asarray(x, dtype="<i4") for x in (first, [f for f, _ in frozen], targets, before, ends, out)]
    head = struct.pack("<7i", *map(len, arrays), len(labels))
    return head + b"".join(a.tobytes() for a in arrays) + bytes(labels)


class Lexicon:
    """The compiled automaton, memory-mapped: all workers of a machine share its pages."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        sizes = struct.unpack_from("<7i", self.map)
        at, arrays = 28, []
        for n in sizes[:6]:
            arrays.append(memoryview(self.map)[at : at + 4 * n].cast("i"))
            at += 4 * n
        self.first, self.final, self.target, self.before, self.ends, self.out = arrays
        self.labels, self.root = at, sizes[1] - 1

    def get(self, word: bytes) -> list[int] | None:
        s, rank, base, find = self.root, 0, self.labels, self.map.find
        for i in range(len(word)):
            at = find(word[i : i + 1], base + self.first[s], base + self.first[s + 1]) - base
            if at < 0:
                return None
            rank += self.before[at]
            s = self.target[at]
        return list(self.out[self.ends[rank] : self.ends[rank + 1]]) if self.final[s] else None


class Encoder:
    """Ids of texts. White space never is part of a token here, so a text is the sequence
    of its pieces, and each distinct piece is taken apart once."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None, most: int = 1_000_000):
        self.vocabulary, self.lexicon, self.merges = vocabulary, lexicon, Merges(vocabulary)
        self.remembered = Remembered(self.find, most)
        top = max(vocabulary.tokens) + 1
        self.number, self.token = pa.array(map(str, range(top))), pa.array([vocabulary.tokens.get(i, "") for i in range(top)])

    def words(self, words: list[bytes]) -> Ragged:
        """From the automaton or, for words it lacks, from the merges, exactly."""
        get = self.lexicon.get if self.lexicon else lambda w: None
        found = [get(w) for w in words]
        known = [i for i, ids in enumerate(found) if ids]
        unseen = [i for i, ids in enumerate(found) if not ids]
        flat = np.array([x for i in known for x in found[i]], dtype=np.int32)
        ids = Ragged(flat, np.array([len(found[i]) for i in known], dtype=np.int64)).join(self.merges.of([words[i] for i in unseen]))
        back = np.empty(len(words), dtype=np.int64)
        back[known + unseen] = np.arange(len(words))
        return ids.take(back)

    def find(self, pieces: list[bytes]) -> Ragged:
        v, place, number, sizes, unknown = self.vocabulary, {}, [], [], unassigned(pieces)
        for piece in pieces:
            n = len(number)
            for i, part in enumerate(v.parts(piece.decode()) if b"<" in piece else (piece.decode(),)):
                if i % 2:
                    number.append(-1 - v.special[part])
                else:
                    number += [place.setdefault(w, len(place)) for w in v.split(part, unknown)]
            sizes.append(len(number) - n)
        number = np.array(number, dtype=np.int64)
        own = self.words([w.encode() for w in place])
        # a special token is a list of one id after those of the words
        special = np.unique(number[number < 0])
        ids = own.join(Ragged((-1 - special).astype(np.int32), np.ones(len(special), dtype=np.int64)))
        number = np.where(number < 0, len(place) + np.searchsorted(special, number), number)
        out = ids.take(number)
        edge = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        return Ragged(out.flat, np.diff(out.ends[edge]))

    def encode(self, texts: pa.Array) -> Ragged:
        distinct, number, edge = cut_pieces(texts)
        out = self.remembered.of(distinct).take(number)
        return Ragged(out.flat, np.diff(out.ends[edge]))

    def joined(self, ids: Ragged, names: pa.Array, most: int = 2_000_000) -> Iterator[bytes]:
        """Each text's ids or tokens, joined by one space; ``most`` ids at a time, so that memory stays bounded."""
        at, texts = 0, len(ids.ends) - 1
        while at < texts:
            end = max(at + 1, int(np.searchsorted(ids.ends, ids.ends[at] + most, side="right")) - 1)
            own = names.take(pa.array(ids.flat[ids.ends[at] : ids.ends[end]]))
            lists = pa.LargeListArray.from_arrays(pa.array(ids.ends[at : end + 1] - ids.ends[at]), own)
            yield from (x.as_py().encode() for x in pc.binary_join(lists, " "))
            at = end


@lru_cache(maxsize=1)
def worker_vocabulary(path: str) -> Vocabulary:
    """One for all tasks of a Python worker."""
    return Vocabulary(path)


@lru_cache(maxsize=1)
def worker_encoder(path: str, lexicon: str) -> Encoder:
    """One for all tasks of a Python worker, so that they share what it remembers."""
    return Encoder(worker_vocabulary(path), Lexicon(SparkFiles.get(lexicon)))


def frequent_words(docs: DataFrame, path: str, text_col: str = "text", most: int = 50_000) -> list[str]:
    """The most frequent words of all texts, at most ``most``, none that is seen once.
    Words are counted in full, per task first and then by word; only those above the
    cut-off reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, words = worker_vocabulary(path), Counter()

        def flush():
            rows = pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], ["w", "n"])
            words.clear()
            return rows

        for s in (s for b in batches for s in slices(b, 0, SLICE)):
            distinct, number, _ = cut_pieces(s.column(0))
            unknown = unassigned(distinct)
            for piece, n in zip(distinct, np.bincount(number, minlength=len(distinct)).tolist()):
                for w in v.split(piece.decode(), unknown):
                    words[w] += n
            if len(words) > 300_000:
                yield flush()
        yield flush()

    counts = docs.select(text_col).mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return [r.w for r in most_frequent(stored(counts.where("n > 1")), most).select("w").collect()]


def ship_lexicon(docs: DataFrame, path: str, text_col: str = "text", most: int = 50_000) -> str:
    """Compile the frequent words' automaton and write it to the shared folder; Spark
    gives its file to each executor, also to those that join later. Returns the file's
    name there."""
    v = Vocabulary(path)
    words = [w.encode() for w in frequent_words(docs, path, text_col, most)]
    data = compile_lexicon((w, v.merge(w)) for w in words)
    name, sc = f"lexicon-{uuid.uuid4().hex}.fst", docs.sparkSession.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(docs.sparkSession).rstrip('/')}/{name}")
    out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(data))
    out.close()
    sc.addFile(at.toString())
    return name


def bpe_round_trip(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = 50_000, contents: tuple[str, ...] = ("ids", "decoded")
) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, as
    ``contents`` names them, ids (array of int) and decoded.

    Encodes whole texts as the file at ``path`` says (no special tokens added; their
    strings in a text give their ids) and decodes the ids again: without a decoder in
    the file, tokens joined by one space. The two digests are of the ids and of the
    decoded text. No document is shuffled: both passes are maps.

    A null text counts as empty: no tokens. Null ids and repeated rows are passed
    through; empty tables give no rows; other columns are unread.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    name = ship_lexicon(docs, path, text_col, lexicon_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = worker_encoder(path, name)
        sha = lambda texts: pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
        for b in (s for b in batches for s in slices(b, 1, SLICE)):
            ids = e.encode(b.column(1))
            cols = [b.column(0), pa.array(np.diff(ids.ends)), sha(e.joined(ids, e.number)), sha(e.joined(ids, e.token))]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if "ids" in contents:
                cols.append(pa.ListArray.from_arrays(pa.array(ids.ends.astype(np.int32)), pa.array(ids.flat)))
            if "decoded" in contents:
                cols.append(pa.array([t.decode() for t in e.joined(ids, e.token)], pa.string()))
            names += [c for c in ("ids", "decoded") if c in contents]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ("ids" in contents) + ", decoded string" * ("decoded" in contents)
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, schema)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), contents=())

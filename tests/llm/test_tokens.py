import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe, tokenfile

EXTRA = [
    (900, "x<|endoftext|>y <|startoftext|>\n\n<|endoftext|> z"), (901, "a\x1cb\x1f c d\xa0e\x85f"), (902, "ΑΣ Σ É é ﬁ İ ǅ"),
    (903, "  two  spaces \n\n\n and\t\ttabs \n x  "), (904, "it's I'LL don't 'S 1234 ½ ١٢ 漢字かな 👍🏽!!??"), (905, "a" * 3000), (906, " \n \n b"),
]


SPACES = [" ", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", "\u2009", "\x85", "\x1c", "\x1f", "\u180e", "\u200b", "\ufeff", "\u3000"]
BITS = ["a", "b", "hello", "world's", "l'été", "É", "12", "3.14", "漢字", "👍🏽", "<|endoftext|>", "<|startoftext|>", "<|endoftext", "'s", "...", "ß", "x\u0301", "ΑΣ", "İ", "ab" * 40, "qzxvbnmlk"]


def odd_texts(n, seed=1):
    r = random.Random(seed)
    return ["a\n\n\nb\xa0c\xa0d", "hello \n\n world\u2009x\u2009y z\x85w", "", None] + ["".join(r.choice(SPACES if r.random() < 0.5 else BITS) for _ in range(r.randrange(30))) for _ in range(n)]


def test_odd_white_space_and_special_tokens():
    texts = odd_texts(3000)
    for path, encoder, end in (
        (public_tokenizers.path("byte_bpe_50k.json"), tokenfile.Pieces(public_tokenizers.path("byte_bpe_50k.json"), 2, most=500), [2]),
        (public_tokenizers.path("word_bpe_49k.json"), bpe.Encoder(bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json")), most=500), []),
    ):
        library = Tokenizer.from_file(path)
        for i in range(0, len(texts), 300):
            ids = encoder.encode(pa.array(texts[i : i + 302]).slice(2))
            for k, t in enumerate(texts[i + 2 : i + 302]):
                assert ids.flat[ids.ends[k] : ids.ends[k + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids + end, t


def test_array_merges():
    v = bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghét漢") for _ in range(r.randrange(1, 40))).encode() for _ in range(2000)]
    got = bpe.Merges(v, longest=20).of(words)
    assert [got.flat[a:z].tolist() for a, z in zip(got.ends, got.ends[1:])] == [v.merge(w) for w in words]


@pytest.fixture(scope="module")
def more(spark, rows):
    r = rows[:60] + EXTRA
    return r, spark.createDataFrame(r, "doc_id long, text string").repartition(3)


def test_round_trip(more):
    rows, df = more
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: r for r in bpe.bpe_round_trip(df, lexicon_words=150).collect()}
    for k, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        r = got[k]
        assert r.ids == ids, (text, ids, r.ids)
        assert r.decoded == t.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(r.decoded))


def test_lexicon_shares_suffixes(tmp_path):
    words = [(w.encode(), [i, i + 1]) for i, w in enumerate(["walking", "talking", "walked", "talked", "w", "é"])]
    (tmp_path / "x").write_bytes(bpe.compile_lexicon(words))
    x = bpe.Lexicon(str(tmp_path / "x"))
    assert all(x.get(w) == ids for w, ids in words)
    assert x.get(b"walk") is None and x.get(b"walkings") is None and x.get(b"") is None
    assert len(x.final) < 14


def test_token_files(more):
    rows, df = more
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, want = 0, []
    for k, text in sorted(rows):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()), ids))
        start += len(ids)
    got = sorted(tuple(r) for r in tokenfile.token_files(df, contents=True, chunk_ids=300).collect())
    assert got == want


def test_planes():
    ids = np.random.default_rng(0).integers(0, 1 << 32, 200_000, dtype=np.uint32)
    data, index = tokenfile.pack(ids)
    assert (tokenfile.unpack(data, index) == ids).all()
    assert (tokenfile.unpack(data, index, 65_000, 140_001) == ids[65_000:140_001]).all()
    assert len(tokenfile.unpack(*tokenfile.pack(ids[:0]))) == 0


def test_empty_and_null_ids(nothing, spark):
    assert bpe.bpe_round_trip(nothing).count() == 0 and tokenfile.token_files(nothing).count() == 0
    d = spark.createDataFrame([(None, "b"), (None, "a"), (1, None)], "doc_id long, text string")
    assert [tuple(r)[:3] for r in tokenfile.token_files(d).orderBy("start").collect()] == [(None, 0, 2), (None, 2, 2), (1, 4, 1)]
    assert bpe.bpe_round_trip(d).count() == 3


def test_clashing_names_and_repeated_rows(spark):
    d = spark.createDataFrame([(1, "b c", 5, "x", 7), (1, "b c", 5, "x", 7)], "doc_id long, text string, id int, ids string, part int")
    assert [tuple(r)[:3] for r in tokenfile.token_files(d).orderBy("start").collect()] == [(1, 0, 3), (1, 3, 3)]
    assert {r.n_tokens for r in bpe.bpe_round_trip(d).collect()} == {2}


def test_frequent_words(spark):
    d = spark.createDataFrame([(1, "x " * 700 + "y " * 600 + "z z once"), (2, None), (3, "z y")], "doc_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    assert sorted(bpe.frequent_words(d, path)) == ["x", "y", "z"]
    assert bpe.frequent_words(d, path, most=1) == ["x"] and bpe.frequent_words(d, path, most=0) == []


def test_every_character_last_in_a_slice():
    """What ends a slice is looked at as a character, whatever its bytes."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), tokenfile.Pieces(path, 2, most=2000)
    texts = ["ダ", "“VOILÀ", "plain", "あ一"] + [x for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000 for x in ("a " + chr(c),)]
    want = library.encode_batch(texts, add_special_tokens=False)
    for i in range(0, len(texts), 37):  # each of these ends a slice of its own
        ids = encoder.encode(pa.array(texts[max(0, i - 1) : i + 1]))
        assert ids.flat[: ids.ends[-1]].tolist() == [y for w in want[max(0, i - 1) : i + 1] for y in [*w.ids, 2]]
    for i in range(0, len(texts), 2000):
        ids = encoder.encode(pa.array(texts[i : i + 2000]))
        assert ids.flat.tolist() == [y for w in want[i : i + 2000] for y in [*w.ids, 2]]
    for last in [chr(c) for c in range(0x80, 0x10000, 11) if not 0xD800 <= c < 0xE000]:
        assert encoder.find([b"x", last.encode()]).flat.tolist() == [*library.encode("x").ids, *library.encode(last, add_special_tokens=False).ids]


def test_code_points_that_python_does_not_know():
    """All below U+30000, alone, after a letter, a digit, a mark and between letters."""
    path = public_tokenizers.path("word_bpe_49k.json")
    library, encoder = Tokenizer.from_file(path), bpe.Encoder(bpe.Vocabulary(path), most=5000)
    chars = [chr(c) for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000]
    texts = [x for c in chars for x in (c, "a" + c, "1" + c, "!" + c, f"É{c}x{c}{c}")]
    for i in range(0, len(texts), 20_000):
        some = texts[i : i + 20_000]
        ids = encoder.encode(pa.array(some))
        want = [x.ids for x in library.encode_batch(some, add_special_tokens=False)]
        assert [ids.flat[a:z].tolist() for a, z in zip(ids.ends, ids.ends[1:])] == want

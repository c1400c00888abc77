import math
import random
import re
import struct
from collections import Counter

import pytest
import xxhash

from tessera.llm.quality import quality_rules
from tessera.llm.urls import judge_urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(windows)
    hit = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_base_counts(spark, docs, rows, nothing):
    labels = spark.createDataFrame([(k, 1, 0) for k, _ in rows[:40]] + [(None, 1, 0), (50, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules(docs, labels).collect()}
    for k, t in rows:
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(t), (k, t)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and r.score >= -0.2)
    assert quality_rules(nothing, labels).count() == 0


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def grams(text, n):
    """Buckets of a text's words and of its pairs of neighbours."""
    h = [signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in WORD.findall(text or "")]
    pair = lambda a, b: signed(xxhash.xxh64_intdigest(struct.pack("<q", b), seed=xxhash.xxh64_intdigest(struct.pack("<q", a), seed=42)))
    return [x % n for x in h] + [pair(a, b) % n for a, b in zip(h, h[1:])]


def test_scores_are_those_of_brute_force(spark, docs, rows):
    n, good = 512, {k for k, _ in rows if 10 < k < 70}
    labels = spark.createDataFrame([(k, 1, 0) for k in good] + [(3, 0, 0), (4, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    raw, trusted = Counter(), Counter()
    for k, t in rows:
        raw.update(grams(t, n))
        trusted.update(grams(t, n) if k in good else [])
    a, b = sum(raw.values()) + n, sum(trusted.values()) + n
    weight = {x: round(1000 * math.log((trusted[x] + 1) / b / ((raw[x] + 1) / a))) for x in raw}
    for r in quality_rules(docs, labels, n_buckets=n, threshold=0.0).collect():
        own = grams(dict(rows)[r.doc_id], n)
        assert r.score == pytest.approx(sum(weight[x] for x in own) / 1000 / max(len(own), 1), abs=1e-9)
        assert r.kept == (not r.base_failed and r.score >= 0)


def test_quality_edges(spark):
    d = spark.createDataFrame([(None, "a b", 1, 2, 3), (None, "a b", 1, 2, 3), (4, None, 5, 6, 7)], "doc_id long, text string, h int, n_words int, t int")
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_rules(d, nothing).collect()
    assert sorted(r.n_words for r in got) == [0, 2, 2] and all(r.base_failed and not r.kept and r.score == 0 for r in got)


def test_url_edges(spark):
    pages = spark.createDataFrame([(None, "http://a.org/x", 1, "k"), (None, "http://a.org/x", 1, "k"), (3, None, 2, "b")], "page_id long, url string, bucket int, key string")
    got = [tuple(r) for r in judge_urls(pages).collect()]
    assert sorted(got, key=str) == sorted([(None, "a.org", "/x", "org/", "allow")] * 2 + [(3, "", "", None, "allow")], key=str)
    assert {r.verdict for r in judge_urls(pages, [], default="block").collect()} == {"block"}
    assert judge_urls(pages.where("false")).count() == 0
    rules = spark.createDataFrame([("block", "org", "/"), ("block", "org", "/"), ("allow", "a.org", "/x")], "action string, host string, path string")
    assert {r.rule for r in judge_urls(pages, rules).collect()} == {"a.org/x", None}


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/x?y", "http://example.org/en/12", "http://org", "http://xorg/", "https://a.com/de/#f", "http://com/fr/", "http://example.org?/es/"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[4] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[5] == ("org", "", None, "allow") and got[6] == ("xorg", "/", None, "allow")
    assert got[7] == ("a.com", "/de/", "com/de/", "block") and got[8] == ("com", "/fr/", "com/fr/", "allow") and got[9] == ("example.org", "", None, "allow")


def test_many_nested_rules_against_all_pairs(spark):
    r = random.Random(5)
    label = lambda: r.choice(["a", "b", "c", "ab", "", "a\x01b", "z\x02"])
    host = lambda n: ".".join(label() for _ in range(r.randrange(n)))
    path = lambda: "".join(r.choice("/ab") for _ in range(r.randrange(5)))
    rules = [(r.choice(["allow", "block"]), h, path()) for h in (host(6) for _ in range(300)) if not set("\x01\x02") & set(h)]
    pages = [(i, f"http://{host(7)}{p}") for i in range(600) for p in [r.choice(["", "/"]) and "/" + path()]]
    pages += [(1000 + i, "x://hot.a.b.c/ab/" + path()) for i in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        out = judge_urls(spark.createDataFrame(pages, "page_id long, url string").repartition(9), spark.createDataFrame([*rules, (None, "a", "/"), ("allow", None, "/"), ("block", "q", None)], "action string, host string, path string"))
        got = {x.page_id: x for x in out.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(got) == len(pages)
    for i, _ in pages:
        x = got[i]
        fit = [(len(h) + len(p), a, h + p) for a, h, p in rules if (x.host == h or x.host.endswith("." + h)) and x.path.startswith(p)]
        assert (x.verdict, x.rule) == (max(fit)[1:] if fit else ("allow", None)), (x, sorted(fit)[-3:])
    assert sum(x.rule is not None for x in got.values()) > 300

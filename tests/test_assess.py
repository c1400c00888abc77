"""Replies, findings, cases and rankings."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import admission, assess, labels, trace
from tessera.operators.embedding import HashEncoder
from tessera.operators.graph import expand_via_graph, resolve_targets
from tessera.plans import search
from tessera.plans.catalog import QUERIES


def test_parse_model_json(spark):
    good = '{"risk": "high", "n": 3}'
    rows = [
        (1, good), (2, f"```json\n{good}\n```"), (3, f"Sure: {good} I hope that helps"), (4, f"```\n{good}```\nmore"), (5, '{"risk": "high"}'), (6, "no idea"), (7, ""), (8, None),
        (9, '{"risk": "high", "n": "many"}'), (10, '{"risk": "a } b", "n": 4}'), (11, '{"risk": null, "n": 1}'), (12, '{"n": 5, "risk": "low", "more": [1]}'), (13, "{" + good),
    ]
    got = {r.id: (r.parsed and (r.parsed.risk, r.parsed.n), r.bad) for r in assess.parse_model_json(spark.createDataFrame(rows, "id long, text string"), "risk string, n long", ["risk", "n"]).collect()}
    want = {i: ("high", 3) for i in (1, 2, 3, 4)} | {10: ("a } b", 4), 12: ("low", 5)}
    assert got == {i: (want.get(i), i not in want) for i, _ in rows}
    lists = assess.parse_model_json(spark.createDataFrame([(1, 'It is [{"a": 1}, {"a": 2}] then')], "id long, text string").withColumn("parsed", F.lit("old")), "a long", ["a"])
    assert lists.count() == 1


HIT = "clause_id long, chunk_id string, content string"


def test_clause_audit_loses_no_clause(spark):
    text = "Every tool goes back to the nail it came from before the store closes."
    hits = [(c, "s1", text) for c in (1, 2, 3, 4, 5, 6, 8)] + [(1, "s2", "Something else entirely is written here."), (9, "s3", text)]
    said = lambda *f: json.dumps({"findings": [dict(zip(("issue", "chunk_id", "quote", "risk"), x)) for x in f]})
    q = "goes back to the nail it came from"
    replies = [
        (1, said(("a", "s1", q, "low"), ("b", "s2", q, "high"), ("c", "s3", q, "high"))), (2, "```json\n" + said() + "\n```"), (3, "sorry"), (5, said(("d", "s1", "never said at all here", "high"))),
        (6, '{"findings": [{"issue": 7'), (7, said(("e", "s1", q, "low"))), (8, said(("f", "s1", q, "odd"), ("f", "s1", q, "odd"))), (9, said(("g", None, None, None))), (77, said()),
    ]
    key = spark.range(1).select(assess.finding_key(F.lit(q)).alias("k")).first().k
    predictions = spark.createDataFrame([(key, "medium", 0.9), (key, "medium", 0.9)], "key string, label string, confidence double")
    frame = lambda rows, kind: spark.createDataFrame(rows, kind).repartition(3)
    out = assess.clause_audit(frame([(c,) for c in [*range(1, 10), 1]], "clause_id long"), frame(hits, HIT), frame(replies, "clause_id long, text string"), predictions)
    got = sorted(((r.clause_id, r.status, r.issue, r.risk, r.risk_source, r.discarded, r.error) for r in out.collect()), key=str)
    unread = "reply is not the JSON asked for"
    assert got == sorted([
        (1, "finding", "a", "medium", "classifier", 2, None), (2, "clean", None, None, None, 0, None), (3, "failed", None, None, None, 0, unread), (4, "failed", None, None, None, 0, "no reply"),
        (5, "discarded", None, None, None, 1, None), (6, "failed", None, None, None, 0, unread), (7, "skipped", None, None, None, 0, None),
        (8, "finding", "f", "medium", "classifier", 0, None), (8, "finding", "f", "medium", "classifier", 0, None), (9, "discarded", None, None, None, 1, None),
    ], key=str)
    assert assess.clause_audit(frame([], "clause_id long"), frame(hits, HIT), frame(replies, "clause_id long, text string"), predictions).count() == 0


def test_override_risk(spark):
    f = spark.createDataFrame([("a", "low", 1), ("b", "low", 2), ("c", "low", 3), ("d", "high", 4), (None, "low", 5), ("e", None, 6)], "key string, risk string, label int")
    p = spark.createDataFrame([("a", "high", 0.6), ("b", "high", 0.59), ("c", "extreme", 0.99), ("d", "high", 0.8), (None, "high", 1.0), ("e", "low", None)], "key string, label string, confidence double")
    got = {r.n: (r.risk, r.risk_source, r.risk_confidence, r.changed) for r in assess.override_risk(f.withColumnRenamed("label", "n"), p).collect()}
    model = lambda risk: (risk, "model", None, False)
    assert got == {1: ("high", "classifier", 0.6, True), 2: model("low"), 3: model("low"), 4: ("high", "classifier", 0.8, False), 5: model("low"), 6: model(None)}


def test_rankings(spark):
    rows = [("r", "a", "neutral", 0.9, 9), ("r", "b", "opposes", 0.5, 1), ("r", "c", "supports", 0.5, 2), ("r", "d", "supports", 0.5, 2), ("r", "e", "supports", 0.7, 0), ("q", "z", "neutral", None, 0)]
    ranked = assess.rank_cases(spark.createDataFrame(rows, "run string, case_id string, stance string, confidence double, cited_by long").withColumn("quote", F.lit("x")))
    assert [(r.case_id, r["rank"]) for r in ranked.where("run = 'r'").orderBy("rank").collect()] == [("e", 1), ("c", 2), ("d", 3), ("b", 4), ("a", 5)]
    memo = {r.run: r.memo for r in assess.memo_input(ranked, 30).collect()}
    assert memo["r"].startswith("e | supports | 0.70 | x\nc | s") and len(memo["r"]) == 30
    n = {r.level: r.n for r in assess.level_counts(ranked, "stance", [*assess.STANCES, "none"]).collect()}
    assert n == {"supports": 3, "opposes": 1, "neutral": 2, "none": 0}


def test_memo_ends_in_the_break_before_a_line(spark):
    ranked = spark.createDataFrame([("r", 1, "a", "supports", 0.5, "x" * 11), ("r", 2, "b", "opposes", 0.5, "y")], "run string, rank int, case_id string, stance string, confidence double, quote string")
    line = "a | supports | 0.50 | " + "x" * 11
    assert [assess.memo_input(ranked, len(line) + n).first().memo for n in (0, 1, 2)] == [line, line + "\n", line + "\nb"]


def test_case_research(spark):
    kind = "run long, chunk_id string, document_id long, content string"
    text = "It was held that the ladder belongs to whoever paid for its rungs."
    hits = spark.createDataFrame([(1, "a", 10, text), (1, "b", 11, text), (1, "b", 11, text), (2, "c", 12, text)], kind)
    far = spark.createDataFrame([(1, "d", 13, text), (1, "a", 10, text)], kind)
    q = "the ladder belongs to whoever paid"
    said = [(1, "a", "neutral", 0.9, q), (1, "b", "supports", 0.4, q), (1, "d", "opposes", 0.8, q), (2, "c", "supports", 0.9, "nothing of the kind was said"), (3, "a", "supports", 1.0, q)]
    out = assess.case_research(hits, far, spark.createDataFrame(said, "run long, chunk_id string, stance string, confidence double, quote string"), spark.createDataFrame([(13, 5)], "document_id long, cited_by long"))
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "a", False, "neutral", 0.9, 0, 3, 0), (1, "b", False, "supports", 0.4, 0, 2, 0), (1, "d", True, "opposes", 0.8, 5, 1, 0), (2, None, None, None, None, None, None, 1)]


def test_graph(spark):
    e = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (2, None), (3, "C"), (4, "A"), (4, "A")], "source_id long, target_ref string")
    named = spark.createDataFrame([(1, "A"), (4, "A"), (3, "C"), (5, None)], "doc_id long, source_ref string")
    got = resolve_targets(e, named)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "A", 4), (1, "B", None), (2, "A", 1), (2, None, None), (3, "C", None), (4, "A", 1), (4, "A", 1)], key=str)
    hits = spark.createDataFrame([(9, 2, 1), (9, 4, 2), (9, 7, 4), (8, 1, 1)], "query_id long, document_id long, rank int")
    chunks = spark.createDataFrame([("x", 1, [1.0, 0.0]), ("y", 1, [0.6, 0.8]), ("z", 1, None), ("w", 4, [0.0, 1.0])], "chunk_id string, document_id long, embedding array<float>")
    queries = spark.createDataFrame([(9, [0.0, 1.0]), (8, [1.0, 0.0])], "query_id long, vector array<float>")
    assert sorted(map(tuple, expand_via_graph(hits, got, queries, chunks).collect())) == [(8, 4, "w", 0.0), (9, 1, "y", 0.8)]
    assert expand_via_graph(hits.where("false"), got, queries, chunks).count() == 0


def test_passages_of_cited_documents_are_found_by_both_arms(spark):
    """By words alone where no vector stands out, and the vectors' best first otherwise."""
    from tessera.operators.graph import passages

    e = HashEncoder(64)
    v = lambda t: e.encode([t])[0]
    text = [("4-0", 4, None, "nothing of it"), ("4-1", 4, "Section 12", "nothing of it"), ("4-2", 4, None, None), ("5-0", 5, None, "see CASE-12 here"), ("5-1", 5, None, "case 12 case 12"), ("6-0", 6, None, "CASE-12")]
    chunks = spark.createDataFrame([(c, d, l, t, v(t) if t and d == 5 else None) for c, d, l, t in text], "chunk_id string, document_id long, label string, content string, embedding array<float>")
    targets = spark.createDataFrame([(4, "CASE-12"), (4, "CASE-12"), (5, "CASE-12"), (7, "CASE-12")], "target_id long, ref string")
    got = sorted(map(tuple, passages(targets, chunks, e).collect()))
    both = round(1 / 61 + 0.1 / 62, 9)
    assert got == [(4, "CASE-12", "4-1", round(0.1 / 61, 9)), (5, "CASE-12", "5-0", both)]


def test_labels(spark):
    assert len(labels.RISK) == 41 and {v: list(labels.RISK.values()).count(v) for v in ("high", "medium", "low")} == {"high": 13, "medium": 21, "low": 7}
    c = spark.createDataFrame([(1, "Exclusivity", "old"), (2, "Insurance", "old"), (2, "Insurance", "old"), (3, "Parties", "old")], "id long, clause_type string, risk string")
    assert sorted((r.id, r.risk) for r in labels.map_labels(c).collect()) == [(1, "high"), (2, "medium"), (2, "medium"), (3, "low")]
    odd = c.union(spark.createDataFrame([(4, "Indemnity", None), (5, None, None)], c.schema))
    assert sorted((r.clause_type or "", r.n) for r in labels.unmapped(odd).collect()) == [("", 1), ("Indemnity", 1)]
    with pytest.raises(Exception, match="no risk for the clause type"):
        labels.map_labels(odd).select("id").collect()
    assert labels.map_labels(c.where("false")).count() == 0 == labels.unmapped(c).count()


def test_admission(spark, tmp_path):
    body = b"<p>" + b"readable text " * 30 + b"</p>"
    files = {"a/one.pdf": b"%PDF" + body, "b/one.txt": b"%PDF" + body, "short.pdf": b"%PDF<b>hi</b>", "wrong.pdf": body, "bad.pdf": b"%PDF" + b"\xff\xfe" * 300, "large.pdf": b"%PDF" + b"x" * 5000}
    for name, data in files.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    out = admission.admit(admission.files(spark, f"{tmp_path}/in"), largest=4000)
    good, bad = admission.keep(out, f"{tmp_path}/kept")
    rows = {r.path.split("/in/")[1]: r for r in good.collect()}
    # the name doesn't matter, and the same content is the same document
    assert set(rows) == {"a/one.pdf", "b/one.txt"} and len({r.source_ref for r in rows.values()}) == 1 and rows["a/one.pdf"].text == ("readable text " * 30).strip()
    assert {r.path.split("/in/")[1]: r.verdict for r in bad.collect()} == {"short.pdf": "too_little_text", "wrong.pdf": "wrong_type", "bad.pdf": "unreadable", "large.pdf": "too_large"}
    none = spark.createDataFrame([("x", 5, None), ("y", 0, b"")], "path string, length long, content binary")
    assert {r.verdict for r in admission.admit(none).collect()} == {"empty"} and admission.admit(none.where("false")).count() == 0


EVENT = "run string, seq long, node string, attempt int, status string, at long"


def test_spans_status_and_counters(spark):
    rows = [
        ("a", 1, "plan", 1, "started", 1000), ("a", 2, "plan", 1, "failed", 5000), ("a", 3, "plan", 2, "started", 6000), ("a", 4, "plan", 2, "retrying", 6500), ("a", 5, "plan", 2, "completed", 9999),
        ("a", 6, None, None, "ok", 12_999), ("a", 7, "late", 1, "started", 13_000), ("b", 1, "plan", 1, "started", 0), ("b", 2, "write", 1, "completed", 10), ("b", 2, "write", 1, "completed", 10),
    ]
    e = spark.createDataFrame(rows, EVENT).repartition(3)
    assert {tuple(r) for r in trace.node_spans(e).collect()} == {("a", "plan", 1, "failed", 4000), ("a", "plan", 2, "completed", 3999), ("a", "late", 1, "open", None), ("b", "plan", 1, "open", None), ("b", "write", 1, "completed", None)}
    assert {tuple(r) for r in trace.run_status(e).collect()} == {("a", "ok", 11, 6), ("b", "running", None, 3)}
    assert {tuple(r) for r in trace.counters(e).collect()} == {("a", 1, 1, 100), ("b", 0, 2, 67)}
    only = spark.createDataFrame([("c", 1, "x", 1, "completed", 1), (None, 1, None, None, "error", 1)], EVENT)
    assert {tuple(r) for r in trace.counters(only).collect()} == {("c", 0, 1, 95), (None, 0, 0, 100)}
    assert all(f(e.where("false")).count() == 0 for f in (trace.node_spans, trace.run_status, trace.counters, trace.until_done))


def test_findings_are_verified_once(spark, monkeypatch):
    seen, verify = spark.sparkContext.accumulator(0), search.verify_claims

    @F.udf("string")
    def read(x):
        seen.add(1)
        return x

    monkeypatch.setattr(search, "verify_claims", lambda s, d: verify(s, d).withColumn("quote", read.asNondeterministic()("quote")))
    at = "/root/testdata/sf0.001"
    assert QUERIES["findings_by_risk"](spark, at).count() > 0
    assert seen.value == verify(spark, at).count()

"""Claims against what was retrieved: quotes that hold, and those that must not."""

import pytest

from tessera.operators.verify import feedback, groundedness, rejections, verify_claims

HITS = [
    ("r", "s4", "The lender may ask for a deposit of up to one tenth of the tool's price, and returns it within three working days after the tool came back."),
    ("r", "s9", "Café-owners—and only they—may keep a tool “overnight”, if the clerk agrees in writing."),
    ("r", "s7", None),
    ("other", "s5", "A tool that was lost is paid for in full by whoever signed for it last."),
]
#: Quotes that aren't in the chunk they name, or name none that was retrieved.
MADE_UP = [
    ("s4", "the lender keeps the deposit if the tool comes back with any scratch at all", "quote_not_found"),
    ("s4", "the lender may never ask for more than half of the tool's own price", "quote_not_found"),
    ("s4", "three working days", "quote_too_short"),
    ("s4", "", "quote_too_short"),
    ("s5", "A tool that was lost is paid for in full", "unknown_chunk"),  # another run's
    ("s99", "The lender may ask for a deposit", "unknown_chunk"),
    (None, "The lender may ask for a deposit", "unknown_chunk"),
    ("s7", "The lender may ask for a deposit", "quote_not_found"),  # nothing in it
]
REAL = [
    ("s4", "a deposit of up to one tenth of the tool's price"),
    (" s4\n", "RETURNS it   within three\nworking days"),
    ("s4", "returns it within (three) working days... after the tool came back"),
    ("s9", "may keep a tool \"overnight\", if the clerk agrees"),
    ("s9", "Café-owners-and only they-may keep a tool"),
    ("s4", "and returns it within three working days after the tool came home"),  # eleven of twelve words in a row
]


@pytest.fixture(scope="module")
def judged(spark):
    rows = [("r", c, q, False, want) for c, q, want in MADE_UP] + [("r", c, q, True, "verified") for c, q in REAL]
    claims = spark.createDataFrame(rows, "run string, chunk_id string, quote string, real boolean, want string")
    return verify_claims(claims, spark.createDataFrame(HITS, "run string, chunk_id string, content string"))


def test_verdicts(judged):
    for r in judged.collect():
        assert r.verdict == r.want, r.quote


def test_groundedness(judged):
    assert {(r.real, r.rate, r.n, r.failing) for r in groundedness(judged).collect()} == {(False, 1.0, 8, 0), (True, 1.0, 6, 0)}


def test_open_claims_are_counted(spark):
    rows = [(None, "verified"), (None, "unknown_chunk"), (True, "verified"), (False, "verified")]
    got = groundedness(spark.createDataFrame(rows, "real boolean, verdict string")).collect()
    assert {tuple(r) for r in got} == {(None, None, 2, 0), (True, 1.0, 1, 0), (False, 0.0, 1, 1)}


def test_ties_repeats_nulls_and_nothing(spark):
    kind, hit = "run string, chunk_id string, quote string, ratio string", "run string, chunk_id string, content string, verdict int"
    claims = spark.createDataFrame([("r", "c", "one two three four five", "x")] * 2 + [(None, None, None, None)], kind)
    hits = spark.createDataFrame([("r", "c", "b", 1), ("r", "c", "a one two three four five", 2), (None, None, "x", 3)], hit)
    # of two contents of one chunk the smaller counts, however rows are dealt; a null run has no hits
    assert sorted((r.run or "", r.verdict) for r in verify_claims(claims, hits).collect()) == [("", "unknown_chunk"), ("r", "verified"), ("r", "verified")]
    assert verify_claims(claims.where("false"), hits).count() == 0
    assert {r.verdict for r in verify_claims(claims, hits.where("false")).collect()} == {"unknown_chunk"}


def test_ratio_counts_the_longest_run(spark):
    hits = spark.createDataFrame([("r", "c", "a b c d e x y z f g h i j")], "run string, chunk_id string, content string")
    claims = spark.createDataFrame([("r", "c", "a b c d e f g h i j"), ("r", "c", "q q q q"), ("r", "c", "x y z f g h")], "run string, chunk_id string, quote string")
    assert sorted(r.ratio for r in verify_claims(claims, hits).collect()) == [0.0, 0.5, 1.0]


def test_feedback_and_rejections(spark):
    rows = [("r", "b", 1, "quote_not_found"), ("r", "a2", 1, "unknown_chunk"), ("r", "a", 1, "quote_too_short"), ("r", None, 2, "quote_too_short"), ("r", "c", 2, "verified"), ("q", "d", 1, "verified"), ("p", "e", 1, "unknown_chunk")]
    judged = spark.createDataFrame(rows, "run string, issue string, attempt int, verdict string")
    got = {x.run: x.feedback for x in feedback(judged).collect()}
    assert got == {"r": "- a: quote_too_short\n- a2: unknown_chunk\n- b: quote_not_found\n- no issue: quote_too_short", "p": "- e: unknown_chunk"}
    assert {tuple(x) for x in rejections(judged).collect()} == {("quote_not_found", 1, 0), ("unknown_chunk", 2, 1), ("quote_too_short", 2, 1)}
    assert feedback(judged.where("false")).count() == 0 == rejections(judged.where("false")).count()

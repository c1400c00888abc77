import duckdb
import pytest

from tessera.plans.catalog import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(rows):
    f = lambda x: round(x, 5) if isinstance(x, float) else [f(y) for y in x] if isinstance(x, (list, tuple)) else x
    return sorted(repr([f(x) for x in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, con, name):
    got = QUERIES[name](spark, DIR)
    if name not in ORACLE:
        assert got.count() > 0
        return
    want = con.sql(ORACLE[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert plain(map(tuple, got.select(*cols).collect())) == plain(want.select(*cols).fetchall())


def test_feedback_names_every_rejected_claim(spark):
    bad = QUERIES["verify_claims"](spark, DIR).where("verdict <> 'verified'").count()
    assert sum(len(r.feedback.split("\n")) for r in QUERIES["rejection_feedback"](spark, DIR).collect()) == bad

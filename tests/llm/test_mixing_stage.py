"""What the pipeline's mixing stage writes, against the weights."""

import random

import pytest

import corpus_pipeline
from tessera.llm.common import stored
from tessera.llm.mixing import DOMAINS, WEIGHTS

from .conftest import DOCS


def test_tokens_of_the_stage_have_the_weights(spark, tmp_path):
    r = random.Random(8)
    common = [f"c{i}" for i in range(60)]
    own = [[f"{d}{i}" for i in range(40)] for d in DOMAINS]
    rows = [(i, r.choice((0, 0, 0, 1, 1, 2)), r.randrange(20, 80)) for i in range(6000)]
    texts = [(i, k, " ".join(r.choice(own[k] if r.random() < 0.5 else common) for _ in range(n))) for i, k, n in rows]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, _, t in texts], DOCS)
    spark.createDataFrame([(i, int(k == 0), int(k == 2)) for i, k, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.mixing_stage(spark, stored(docs), str(tmp_path)).collect()
    kept = {x.doc_id for x in out}
    assert len(kept) == len(out)
    tokens = [sum(n for i, k, n in rows if k == d and i in kept) for d in range(3)]
    for d, n in zip(DOMAINS, tokens):
        assert n / sum(tokens) == pytest.approx(WEIGHTS[d], abs=0.006)
    assert tokens[0] > 0.97 * sum(n for _, k, n in rows if k == 0)


def test_rows_stay_the_same_when_files_are_cut_otherwise(spark, tmp_path):
    """Spark cuts a table's files by the cores there are; a stage reads its rows several times."""
    r = random.Random(9)
    texts = [" ".join(f"w{r.randrange(500)}" for _ in range(60)) for _ in range(300)]
    rows = [(i, texts[i % 290], "en", "s", 1) for i in range(400)]
    spark.createDataFrame(rows, DOCS).repartition(6).write.parquet(f"{tmp_path}/d")
    key, kept = "spark.sql.leafNodeDefaultParallelism", {}
    try:
        for name, stage in (("exact", corpus_pipeline.exact_stage), ("near", corpus_pipeline.near_stage)):
            spark.conf.set(key, "3")
            out = stage(spark, spark.read.parquet(f"{tmp_path}/d"), "")
            spark.conf.set(key, "17")
            kept[name] = sorted(x.doc_id for x in out.collect())
    finally:
        spark.conf.unset(key)
    assert kept["exact"] == kept["near"] == list(range(290))

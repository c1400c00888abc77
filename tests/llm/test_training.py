"""The language model learns from all trusted documents, however many there are."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm.perplexity import learns, perplexities

from .conftest import DOCS
from .test_models import LABELS, kneser_ney


def test_model_learns_from_all_trusted_documents(spark):
    r = random.Random(2)
    rows = [(i, f"own{i} " + " ".join(f"w{r.randrange(40)}" for _ in range(6))) for i in range(2600)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    labels = spark.createDataFrame([(i, int(i % 10 > 0), int(i % 10 == 1)) for i, _ in rows], LABELS)
    ids = {x.doc_id for x in labels.where("quality = 1 and toxic = 0").where(learns(F.col("doc_id"))).collect()}
    assert len(ids) > 1000
    model = kneser_ney([t.encode() for i, t in rows if i in ids])
    got = {x.doc_id: x.perplexity for x in perplexities(docs, labels).collect()}
    assert all(got[i] == pytest.approx(model(t.encode()), rel=1e-6) for i, t in rows)

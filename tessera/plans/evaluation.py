"""Labels, splits, classification and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import evaluation as e
from tessera.operators import labels
from tessera.sources import views as v

from . import search
from .registry import query

_CLAUSES = "clauses AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'high' WHEN quality = 0 THEN 'medium' ELSE 'low' END AS risk FROM labels)"


def _clauses(spark, d):
    risk = F.when(F.col("toxic") == 1, "high").when(F.col("quality") == 0, "medium").otherwise("low")
    return v.table(spark, d, "labels").select("doc_id", risk.alias("risk"))


_TYPES = list(labels.RISK)


@query(f"""SELECT doc_id, {_TYPES}[doc_id % {len(_TYPES)} + 1] AS clause_type, CASE WHEN doc_id % {len(_TYPES)} < {len(labels.HIGH)} THEN 'high' WHEN doc_id % {len(_TYPES)} < {len(labels.HIGH) + len(labels.MEDIUM)} THEN 'medium' ELSE 'low' END AS risk FROM labels""")
def map_labels(spark, d):
    """Labelled documents as clauses of the 41 types, and the risk of each."""
    own = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("doc_id") % len(_TYPES) + 1).cast("int"))
    return labels.map_labels(v.table(spark, d, "labels").select("doc_id", own.alias("clause_type")))


@query(f"WITH {_CLAUSES} SELECT risk, count(*) AS n FROM clauses GROUP BY risk")
def class_distribution(spark, d):
    return _clauses(spark, d).groupBy("risk").agg(F.count("*").alias("n"))


@query(f"WITH {_CLAUSES} SELECT level AS risk, count(doc_id) AS n FROM (VALUES ('high'), ('medium'), ('low'), ('none')) l(level) LEFT JOIN clauses ON risk = level GROUP BY level")
def risk_summary(spark, d):
    levels = spark.createDataFrame([(x,) for x in ("high", "medium", "low", "none")], "risk string")
    return levels.join(class_distribution(spark, d), "risk", "left").select("risk", F.coalesce("n", F.lit(0)).alias("n"))


_SPLIT = f"{_CLAUSES}, parts AS (SELECT doc_id, risk, row_number() OVER (PARTITION BY risk ORDER BY md5('7' || doc_id), doc_id) <= floor(0.2 * count(*) OVER (PARTITION BY risk)) AS test FROM clauses)"


@query(f"WITH {_SPLIT} SELECT * FROM parts")
def stratified_split(spark, d):
    return e.stratified_split(_clauses(spark, d), "doc_id", "risk")


@query(f"WITH {_SPLIT} SELECT doc_id, risk, (SELECT mode(risk) FROM parts WHERE NOT test) AS predicted FROM parts WHERE test")
def majority_baseline(spark, d):
    parts = stratified_split(spark, d)
    most = parts.where("not test").groupBy("risk").count().orderBy(F.desc("count"), "risk").limit(1).select(F.col("risk").alias("predicted"))
    return parts.where("test").select("doc_id", "risk").crossJoin(F.broadcast(most))


@query(f"""WITH {_SPLIT}, p AS (SELECT risk, CASE WHEN doc_id % 5 = 0 THEN 'low' ELSE risk END AS predicted FROM parts), cells AS (SELECT l, count(*) FILTER (risk = l AND predicted = l)::DOUBLE AS tp,
  count(*) FILTER (predicted = l) AS np, count(*) FILTER (risk = l) AS nr, count(*) FILTER (risk = predicted) AS hits, count(*) AS total FROM p, (VALUES ('high'), ('medium'), ('low')) x(l) GROUP BY l),
  s AS (SELECT l, coalesce(tp / nullif(np, 0), 0) AS precision, coalesce(tp / nullif(nr, 0), 0) AS recall, coalesce(2 * tp / nullif(np + nr, 0), 0) AS f1, hits / total AS accuracy FROM cells)
  SELECT l AS risk, round(precision, 6)::DOUBLE AS precision, round(recall, 6)::DOUBLE AS recall, round(f1, 6)::DOUBLE AS f1, round(accuracy, 6)::DOUBLE AS accuracy, round(avg(f1) OVER (), 6)::DOUBLE AS macro_f1 FROM s""")
def classification_report(spark, d):
    """Precision, recall and F1 of each class, and accuracy and macro-F1 with each row; what
    would be divided by zero is 0. The high class's F1 is its row's."""
    p = _clauses(spark, d).withColumn("predicted", F.when(F.col("doc_id") % 5 == 0, "low").otherwise(F.col("risk")))
    return e.report(p, ["high", "medium", "low"])


_ARMS = f"""{search.HYBRID}, arms AS (SELECT 'vector' AS retriever, query_id, rank, document_id FROM knn JOIN chunks USING (chunk_id) WHERE rank <= 8
    UNION ALL SELECT 'lexical', query_id, rank, document_id FROM lex JOIN chunks USING (chunk_id) WHERE rank <= 8 UNION ALL SELECT 'hybrid', query_id, rank, document_id FROM hybrid JOIN chunks USING (chunk_id)),
  good AS (SELECT arms.*, relevance.query_id IS NOT NULL AS good FROM arms LEFT JOIN relevance USING (query_id, document_id)), wanted AS (SELECT query_id, count(*) AS wanted FROM relevance GROUP BY query_id),
  scores AS (SELECT retriever, query_id, count(*) FILTER (good) / 8.0 AS p, count(DISTINCT document_id) FILTER (good) / any_value(wanted) AS rec, coalesce(max(1.0 / rank) FILTER (good), 0) AS rr
    FROM queries CROSS JOIN (VALUES ('vector'), ('lexical'), ('hybrid')) x(retriever) JOIN wanted USING (query_id) LEFT JOIN good USING (retriever, query_id) GROUP BY ALL)"""


def by_arm(x) -> dict:
    """Scores of each retriever's hits against the query set's documents."""
    relevant = x.asked.select(F.col("id").alias("query_id"), F.explode("relevant").alias("document_id"))
    docs = x.chunks.select("chunk_id", "document_id")
    arms = {"vector": x.arms[0].where("rank <= 8"), "lexical": x.arms[1], "hybrid": x.fused}
    return {name: e.scores(hits.join(docs, "chunk_id"), x.queries, relevant) for name, hits in arms.items()}


@query(f"{_ARMS} SELECT query_id, round(p, 6)::DOUBLE AS precision, round(rec, 6)::DOUBLE AS recall, round(rr, 6)::DOUBLE AS rr, rr > 0 AS hit FROM scores WHERE retriever = 'hybrid'")
def score_queries(spark, d):
    return by_arm(search.Retrieval(spark, d))["hybrid"]


_TIMINGS = "timings AS (SELECT ['vector', 'lexical', 'hybrid'][event_id % 3 + 1] AS retriever, round(value, 2) AS ms FROM events)"


@query(f"""{_ARMS}, {_TIMINGS}, t AS (SELECT retriever, list_sort(list(ms)) AS o FROM timings GROUP BY retriever)
  SELECT retriever, round(avg(p), 6)::DOUBLE AS precision, round(avg(rec), 6)::DOUBLE AS recall, round(avg(rr), 6)::DOUBLE AS mrr, round(avg((rr > 0)::INT), 6)::DOUBLE AS hit_rate,
    any_value(o[len(o) // 2 + 1]) AS p50, any_value(o[least(floor(len(o) * 0.95)::INT, len(o) - 1) + 1]) AS p95 FROM scores JOIN t USING (retriever) GROUP BY retriever""")
def aggregate_metrics(spark, d):
    """Means of each retriever's scores, and its latencies (events stand for what was timed)."""
    name = F.element_at(F.array(*map(F.lit, ("vector", "lexical", "hybrid"))), (F.col("event_id") % 3 + 1).cast("int"))
    timings = v.table(spark, d, "events").select(name.alias("retriever"), F.round("value", 2).alias("ms"))
    return e.means(by_arm(search.Retrieval(spark, d))).join(e.nearest_ranks(timings, "retriever", "ms"), "retriever")


@query(f"{_ARMS} SELECT query_id FROM scores WHERE retriever = 'hybrid' AND rr = 0")
def missed_queries(spark, d):
    """Queries without one relevant document among their hits."""
    return score_queries(spark, d).where("not hit").select("query_id")


_DELTA = "round(max({c}) FILTER (retriever = 'hybrid') - max({c}) FILTER (retriever <> 'hybrid'), 6)"


@query(f"""{_ARMS}, m AS (SELECT retriever, round(avg(rr), 6)::DOUBLE AS mrr, round(avg(rec), 6)::DOUBLE AS recall FROM scores GROUP BY retriever), x AS (SELECT {_DELTA.format(c='mrr')} AS mrr_delta, {_DELTA.format(c='recall')} AS recall_delta FROM m)
  SELECT *, CASE WHEN recall_delta > 0 THEN 'adds recall' WHEN mrr_delta >= 0 THEN 'holds ranking' ELSE 'does not pay' END AS verdict FROM x""")
def fusion_delta(spark, d):
    """What fusion adds to the better of its arms."""
    m = e.means(by_arm(search.Retrieval(spark, d)))
    most = lambda c, own: F.max(F.when((F.col("retriever") == "hybrid") == F.lit(own), F.col(c)))
    x = m.agg(*[F.round(most(c, True) - most(c, False), 6).alias(f"{c}_delta") for c in ("mrr", "recall")])
    return x.withColumn("verdict", F.when(F.col("recall_delta") > 0, "adds recall").when(F.col("mrr_delta") >= 0, "holds ranking").otherwise("does not pay"))


#: Weights of both arms and how deep the lexical one goes.
GRID = [(wv, wl, depth) for wv, wl in ((1.0, 0.0), (1.0, 0.1), (1.0, 1.0), (0.1, 1.0)) for depth in (1, 3)]


@query(f"""{search.ALL}, grid AS (SELECT * FROM (VALUES {", ".join(map(str, GRID))}) g(wv, wl, depth)), f AS (SELECT wv, wl, depth, query_id, chunk_id, round(sum(s), 9) AS score, min(a * 1000 + rank) AS first FROM (
  SELECT wv, wl, depth, query_id, chunk_id, 0 AS a, rank, wv / (60 + rank) AS s FROM knn, grid UNION ALL SELECT wv, wl, depth, query_id, chunk_id, 1, rank, wl / (60 + rank) FROM lex, grid WHERE rank <= depth) GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY wv, wl, depth, query_id ORDER BY score DESC, first, chunk_id) AS place FROM f),
  good AS (SELECT wv, wl, depth, query_id, max(1.0 / place) AS rr FROM r JOIN chunks USING (chunk_id) JOIN relevance USING (query_id, document_id) WHERE place <= 8 GROUP BY ALL)
  SELECT wv::DOUBLE AS wv, wl::DOUBLE AS wl, depth, round(avg(coalesce(rr, 0)), 6)::DOUBLE AS mrr FROM queries CROSS JOIN grid LEFT JOIN good USING (wv, wl, depth, query_id) GROUP BY ALL""")
def weight_sweep(spark, d):
    """Fusion over a grid of weights and depths; the arms' hits are found once and every
    setting joins them."""
    x = search.Retrieval(spark, d)
    grid = F.explode(F.array(*[F.struct(F.lit(a).alias("wv"), F.lit(b).alias("wl"), F.lit(n).alias("depth")) for a, b, n in GRID])).alias("g")
    arm = lambda hits, i, w: hits.select("query_id", "chunk_id", "rank", F.lit(i).alias("a"), grid).select("g.*", "query_id", "chunk_id", "rank", F.struct("a", "rank").alias("first"), (F.col(f"g.{w}") / (F.col("rank") + 60)).alias("s"))
    both = arm(x.arms[0], 0, "wv").unionByName(arm(x.arms[1], 1, "wl").where("rank <= depth"))
    setting = ["wv", "wl", "depth", "query_id"]
    f = both.groupBy(*setting, "chunk_id").agg(F.round(F.sum("s"), 9).alias("score"), F.min("first").alias("first"))
    w = Window.partitionBy(*setting).orderBy(F.desc("score"), "first", "chunk_id")
    f = f.withColumn("place", F.row_number().over(w)).where("place <= 8").join(x.chunks.select("chunk_id", "document_id"), "chunk_id")
    relevant = x.asked.select(F.col("id").alias("query_id"), F.explode("relevant").alias("document_id"))
    rr = f.join(relevant, ["query_id", "document_id"]).groupBy(*setting).agg(F.max(1.0 / F.col("place")).alias("rr"))
    every = x.queries.select("query_id", grid).select("query_id", "g.*")
    return every.join(rr, setting, "left").groupBy("wv", "wl", "depth").agg(F.round(F.avg(F.coalesce("rr", F.lit(0.0))), 6).alias("mrr"))


@query("""SELECT event_type AS stage, round(median(value), 6) AS p50, round(list_sort(list(value))[least(floor(count(value) * 0.95)::INT, count(value) - 1) + 1], 6) AS p95, round(avg(value), 6) AS mean, count(value) AS n,
  list_sort(list(value))[least(floor(count(value) * 0.95)::INT, count(value) - 1) + 1] <= 300 AS on_target FROM events GROUP BY event_type""")
def latency_summary(spark, d):
    """Median, nearest-rank 95th percentile, mean, number and verdict per stage."""
    return e.latency_summary(v.table(spark, d, "events").select(F.col("event_type").alias("stage"), "value"), 300)


@query("""WITH t AS (SELECT event_type AS stage, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1 AS cold FROM events)
  SELECT stage, round(avg(value) FILTER (cold), 6) AS cold, round(avg(value) FILTER (NOT cold), 6) AS warm, round(avg(value) FILTER (cold) / greatest(avg(value) FILTER (NOT cold), 0.001), 6) AS ratio FROM t GROUP BY stage""")
def cold_warm_ratio(spark, d):
    """How much longer a stage takes a user's first time, when nothing is cached, than later."""
    events = v.table(spark, d, "events")
    first = events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    t = events.join(first, ["user_id", "event_type"]).withColumn("cold", F.col("event_id") == F.col("first"))
    mean = lambda c: F.avg(F.when(c, F.col("value")))
    s = t.groupBy(F.col("event_type").alias("stage")).agg(mean(F.col("cold")).alias("cold"), mean(~F.col("cold")).alias("warm"))
    return s.select("stage", F.round("cold", 6).alias("cold"), F.round("warm", 6).alias("warm"), F.round(F.col("cold") / F.greatest("warm", F.lit(0.001)), 6).alias("ratio"))


def _baselines(spark, d):
    parts = stratified_split(spark, d).where("test").select("doc_id", "risk")
    model = parts.withColumn("predicted", F.when(F.col("doc_id") % 5 == 0, "low").otherwise(F.col("risk")))
    return e.report(model, LEVELS).agg(F.max("macro_f1").alias("model")), e.report(majority_baseline(spark, d), LEVELS).agg(F.max("macro_f1").alias("baseline"))


LEVELS = ["high", "medium", "low"]
_F1 = "(SELECT round(avg(f1), 6)::DOUBLE FROM (SELECT coalesce(2.0 * count(*) FILTER (risk = l AND predicted = l) / nullif(count(*) FILTER (risk = l) + count(*) FILTER (predicted = l), 0), 0) AS f1 FROM {t}, (VALUES ('high'), ('medium'), ('low')) x(l) GROUP BY l))"


@query(f"""WITH {_SPLIT}, m AS (SELECT risk, CASE WHEN doc_id % 5 = 0 THEN 'low' ELSE risk END AS predicted FROM parts WHERE test), b AS (SELECT risk, (SELECT mode(risk) FROM parts WHERE NOT test) AS predicted FROM parts WHERE test)
  SELECT {_F1.format(t='m')} AS model, {_F1.format(t='b')} AS baseline, round({_F1.format(t='m')} - {_F1.format(t='b')}, 6) AS gain, {_F1.format(t='m')} - {_F1.format(t='b')} > 0.02 AS worth_it""")
def macro_gain(spark, d):
    model, base = _baselines(spark, d)
    gain = F.col("model") - F.col("baseline")
    return model.crossJoin(F.broadcast(base)).select("model", "baseline", F.round(gain, 6).alias("gain"), (gain > 0.02).alias("worth_it"))


@query()
def tfidf_logistic(spark, d):
    """Words and word pairs in two documents or more, weighed by tf-idf, classes balanced, a
    logistic regression over all training clauses; the report on the held-out ones."""
    return e.tfidf_logistic_report(stratified_split(spark, d).join(v.table(spark, d, "documents").select("doc_id", "text"), "doc_id"))

"""Splits, baselines and measures of classifiers, retrievers and latencies."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizerModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.store import folder, written

from .assess import order_of

LEVELS = ["high", "medium", "low"]


def stratified_split(rows: DataFrame, id_col: str, class_col: str, share: float = 0.2, seed: str = "7") -> DataFrame:
    """The id, the class and ``test``: of each class, ``share`` of the rows, rounded down, are for
    testing: those with the smallest hashes of seed and id. Which hash is the last, counts
    by the hashes' first four digits tell; only the one bucket where the cut-off lies is
    sorted, so no task orders a class. Rows of a null class are a class; ids are unique."""
    c = rows.select(id_col, class_col).withColumn("h", F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string")))).withColumn("b", F.left("h", F.lit(4)))
    sizes = c.groupBy(class_col, "b").agg(F.count("*").alias("n"))
    w = Window.partitionBy(class_col).orderBy("b")
    edge = sizes.withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("goal", F.floor(share * F.sum("n").over(Window.partitionBy(class_col))))
    edge = edge.where("before <= goal and goal < before + n").select(F.col(class_col).alias("of"), F.col("b").alias("at"), (F.col("goal") - F.col("before")).alias("more"))
    j = c.join(F.broadcast(edge), F.col(class_col).eqNullSafe(F.col("of")), "left")  # a row for each class
    inside = j.where("b = at").withColumn("test", F.row_number().over(Window.partitionBy(class_col, "b").orderBy("h", id_col)) <= F.col("more"))
    out = j.where("b <> at or at is null").withColumn("test", F.coalesce(F.col("b") < F.col("at"), F.lit(True)))
    return out.unionByName(inside).select(id_col, class_col, "test")


def report(p, levels):
    cells = p.groupBy("risk", "predicted").agg(F.count("*").alias("n"))
    l = F.explode(F.array(*map(F.lit, levels)))
    at = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    said, real = F.col("predicted") == F.col("l"), F.col("risk") == F.col("l")
    s = cells.select("*", l.alias("l")).groupBy("l").agg(at(said & real).alias("tp"), at(said).alias("np"), at(real).alias("nr"), at(F.col("risk") == F.col("predicted")).alias("hits"), F.sum("n").alias("total"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    s = s.select(F.col("l").alias("risk"), ratio(F.col("tp"), F.col("np")).alias("precision"), ratio(F.col("tp"), F.col("nr")).alias("recall"), ratio(2 * F.col("tp"), F.col("np") + F.col("nr")).alias("f1"), ratio(F.col("hits"), F.col("total")).alias("accuracy"))
    s = s.withColumn("macro_f1", F.avg("f1").over(Window.partitionBy(F.lit(1))))  # a row for each class
    return s.select("risk", *[F.round(c, 6).alias(c) for c in s.columns[1:]])


def scores(hits, queries, relevant, k=8):
    """(query_id, precision, recall, rr, hit): hits (query_id, document_id, rank) against
    (query_id, document_id); a document found twice counts twice for precision, once for
    recall; a query without hits has zeros."""
    rel = relevant.select("query_id", "document_id", F.lit(True).alias("good"))
    n = relevant.groupBy("query_id").agg(F.count_distinct("document_id").alias("wanted"))
    good = F.coalesce("good", F.lit(False))
    s = hits.join(rel, ["query_id", "document_id"], "left").groupBy("query_id").agg(
        (F.count_if(good) / float(k)).alias("p"), F.count_distinct(F.when(good, F.col("document_id"))).alias("found"), F.max(F.when(good, 1.0 / F.col("rank")).otherwise(0.0)).alias("rr")
    )
    q = queries.select("query_id").join(s, "query_id", "left").join(n, "query_id", "left").na.fill(0)
    rec = F.when(F.col("wanted") > 0, F.col("found") / F.col("wanted")).otherwise(0.0)
    return q.select("query_id", F.round("p", 6).alias("precision"), F.round(rec, 6).alias("recall"), F.round("rr", 6).alias("rr"), (F.col("rr") > 0).alias("hit"))


def means(arms: dict):
    """(retriever, precision, recall, mrr, hit_rate) of scores by retriever."""
    out = None
    for name, s in arms.items():
        one = s.agg(*[F.round(F.avg(F.col(c).cast("double")), 6).alias(to) for c, to in (("precision", "precision"), ("recall", "recall"), ("rr", "mrr"), ("hit", "hit_rate"))]).withColumn("retriever", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def _grams(words: str) -> Column:
    """The words and the pairs of neighbours."""
    after = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.concat(words, F.zip_with(F.slice(words, 1, F.size(after)), after, lambda a, b: F.concat(a, F.lit(" "), b)))


def vocabulary(rows: DataFrame, words: str, most: int) -> list[str]:
    """The ``most`` words and pairs that occur most often in the arrays ``words``, of those in two
    rows or more; ties in alphabetical order. Of a gram's rows only the first and the last id
    are kept, so a task holds one short row for each of its grams. ``rows`` must be stored,
    as rows are numbered by where they lie."""
    numbered = rows.select(_grams(words).alias("grams"), F.monotonically_increasing_id().alias("id"))
    n = numbered.select(F.explode("grams").alias("gram"), "id").groupBy("gram").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))
    return [r.gram for r in n.where("first < last").orderBy(F.desc("n"), "gram").limit(most).select("gram").collect()]


def tfidf_logistic_report(parts, iterations: int = 1000):
    """``report`` of the held-out clauses (doc_id, risk, test, text); the fit stops before
    ``iterations`` where it has converged. Texts are cut into words once and into counts of
    grams once; what passes over the rows more often reads these tables."""
    spark = parts.sparkSession
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    rows = parts.select("risk", "test", (order_of("risk", LEVELS) - 1.0).alias("label"), words.alias("w"))
    rows = written(rows, folder(spark, "words")).where("size(w) > 0")  # not before, or texts that no clause has are cut as well
    model = CountVectorizerModel.from_vocabulary(vocabulary(rows.where("not test"), "w", 50_000), "grams", "tf")
    rows = written(model.transform(rows.withColumn("grams", _grams("w"))).select("risk", "test", "label", "tf"), folder(spark, "grams"))
    train = rows.where("not test")
    n = train.groupBy("label").agg(F.count("*").alias("k"))
    total = n.agg(F.sum("k").alias("all"), F.count("*").alias("classes"))
    weights = n.crossJoin(F.broadcast(total)).select("label", (F.col("all") / (F.col("classes") * F.col("k"))).alias("weight"))
    train = train.join(F.broadcast(weights), "label")  # a row for each class
    model = Pipeline(stages=[IDF(inputCol="tf", outputCol="features"), LogisticRegression(maxIter=iterations, regParam=0.01, weightCol="weight")]).fit(train)
    out = model.transform(rows.where("test")).withColumn("predicted", F.element_at(F.array(*map(F.lit, LEVELS)), F.col("prediction").cast("int") + 1))
    return report(out.select("risk", "predicted"), LEVELS)


def order_statistics(rows: DataFrame, by: str, value: str, places: dict[str, Column]) -> DataFrame:
    """(by, n and one column for each place): the values at places from 0 in ascending order,
    which are given as columns of ``n``, the number of values that are not null.

    Equal values are counted first. Counts over 4,096 cells between the smallest and the
    largest value tell the few cells that the places fall into, and only these are
    ordered, so no task sorts a group.
    """
    per = rows.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("value")).agg(F.count("*").alias("c"))
    n = per.groupBy(by).agg(F.sum("c").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    per = per.join(F.broadcast(n), by).withColumn("cell", F.when(F.col("hi") > F.col("lo"), F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 4096)).otherwise(0))  # a row for each group
    before = Window.partitionBy(by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    coarse = per.groupBy(by, "cell").agg(F.sum("c").alias("k")).withColumn("first", F.coalesce(F.sum("k").over(before), F.lit(0)))
    wanted = n.select(by, "n", F.explode(F.array(*[F.struct(F.lit(x).alias("name"), p.cast("long").alias("place")) for x, p in places.items()])).alias("w")).select(by, "n", "w.*")
    near = wanted.join(coarse, by).where("first <= place and place < first + k").select(by, "n", "name", "place", "cell", "first")
    inside = Window.partitionBy(by, "cell").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    fine = per.drop("n", "lo", "hi").join(near.select(by, "cell").distinct(), [by, "cell"], "left_semi").withColumn("skip", F.coalesce(F.sum("c").over(inside), F.lit(0)))
    at = near.join(fine, [by, "cell"]).where("first + skip <= place and place < first + skip + c")
    return at.groupBy(by, "n").agg(*[F.max(F.when(F.col("name") == x, F.col("value"))).alias(x) for x in places])


def nearest_ranks(timings: DataFrame, by: str, value: str) -> DataFrame:
    """(by, p50, p95) without interpolation: the values at n // 2 and at 95 % of n, at most the last."""
    n = F.col("n")
    return order_statistics(timings, by, value, {"p50": F.floor(n / 2), "p95": F.least(F.floor(n * 0.95), n - 1)}).select(by, "p50", "p95")


def latency_summary(timings: DataFrame, target: float) -> DataFrame:
    """(stage, p50: true median, p95: nearest rank, mean, n, on_target: p95 up to ``target``) of
    timings (stage, value); nulls are left out."""
    n = F.col("n")
    x = order_statistics(timings, "stage", "value", {"a": F.floor((n - 1) / 2), "b": F.floor(n / 2), "p95": F.least(F.floor(n * 0.95), n - 1)})
    mean = timings.groupBy("stage").agg(F.round(F.avg("value"), 6).alias("mean"))
    out = x.join(mean, "stage")
    return out.select("stage", F.round((F.col("a") + F.col("b")) / 2, 6).alias("p50"), F.round("p95", 6).alias("p95"), "mean", "n", (F.col("p95") <= target).alias("on_target"))

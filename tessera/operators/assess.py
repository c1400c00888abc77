"""What is done with model outputs: JSON replies, risk levels, stances, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .verify import verify_claims

RISKS = ["high", "medium", "low"]
STANCES = ["supports", "opposes", "neutral"]


def extract_json(text: Column) -> Column:
    """The JSON in a reply: what a code fence holds, then from the first brace to the last,
    else from the first bracket to the last, else all."""
    fenced = F.nullif(F.regexp_extract(text, r"(?sU)```(?:json)?\s*(.+?)\s*```", 1), F.lit(""))
    t = F.coalesce(fenced, text)

    def between(a: str, z: str) -> Column:
        first, last = F.instr(t, a), F.length(t) - F.instr(F.reverse(t), z) + 1
        return F.when((first > 0) & (F.instr(t, z) > 0) & (last > first), F.substr(t, first, last - first + 1))

    return F.coalesce(between("{", "}"), between("[", "]"), t)


def parse_model_json(replies: DataFrame, schema: str, required: list[str], text_col: str = "text") -> DataFrame:
    """The columns of ``replies`` with ``parsed`` and ``bad``: a reply that is no JSON or
    lacks a required field is quarantined (bad, parsed null), and no other row is hurt."""
    full = f"{schema}, _bad string"
    x = F.from_json(extract_json(F.col(text_col)), full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    r = replies.withColumn("x", x)
    lacking = F.col("x").isNull() | F.col("x._bad").isNotNull()
    for c in required:
        lacking = lacking | F.col(f"x.{c}").isNull()
    parsed = F.when(~lacking, F.col("x").dropFields("_bad"))
    return r.withColumn("parsed", parsed).withColumn("bad", lacking).drop("x")


def override_risk(findings: DataFrame, predictions: DataFrame, least: float = 0.6) -> DataFrame:
    """A classifier's level (key, label, confidence) takes the place of a finding's risk when
    it is confident enough and a known level; risk_source, risk_confidence and changed tell so.
    Findings without a key, or whose key has no prediction, keep theirs; of several
    predictions of a key the most confident counts. Other columns are carried along."""
    p = predictions.groupBy("key").agg(F.max(F.struct("confidence", "label")).alias("p")).select("key", "p.label", "p.confidence")
    j = findings.join(p, "key", "left")
    use = F.coalesce((F.col("confidence") >= least) & F.col("label").isin(RISKS), F.lit(False))
    return j.select(
        *[c for c in findings.columns if c != "risk"], F.when(use, F.col("label")).otherwise(F.col("risk")).alias("risk"), F.when(use, "classifier").otherwise("model").alias("risk_source"),
        F.when(use, F.col("confidence")).alias("risk_confidence"), (use & (F.col("label") != F.col("risk"))).alias("changed"),
    )


def level_counts(rows: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """(level, n): zero where no row has the level."""
    n = rows.groupBy(F.col(column).alias("level")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(1, numPartitions=1).select(F.explode(F.array(*map(F.lit, levels))).alias("level"))
    return every.join(n, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"))


def order_of(column: str, levels: list[str]) -> Column:
    place = F.array_position(F.array(*map(F.lit, levels)), F.col(column))
    return F.when(place > 0, place).otherwise(len(levels) + 1)


def rank_cases(cases: DataFrame) -> DataFrame:
    """Cases of each run by use: those that take a side first, then by confidence, then by
    how often they are cited; ties by id. Null confidences and counts come last, a null
    stance takes a side no more than neutral does and comes after it."""
    w = Window.partitionBy("run").orderBy(F.when(F.col("stance").isNull(), 2).when(F.col("stance") == "neutral", 1).otherwise(0), F.desc("confidence"), F.desc("cited_by"), "case_id")
    return cases.withColumn("rank", F.row_number().over(w))


def memo_input(ranked: DataFrame, most: int = 12_000) -> DataFrame:
    """(run, memo): the run's cases as one text, cut to ``most`` characters. No more rows
    than can fill it are gathered."""
    line = F.concat_ws(" | ", F.col("case_id"), F.col("stance"), F.format_string("%.2f", "confidence"), F.left("quote", F.lit(most)))
    w = Window.partitionBy("run").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = ranked.select("run", "rank", line.alias("line")).withColumn("before", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)))
    rows = rows.where(F.col("before") <= most)  # at most itself, the break before the line is the last character
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x.line), "\n")
    return rows.groupBy("run").agg(F.left(text, F.lit(most)).alias("memo"))


FINDINGS = "findings array<struct<issue: string, chunk_id: string, quote: string, risk: string>>"


def clause_audit(clauses: DataFrame, hits: DataFrame, replies: DataFrame, predictions: DataFrame) -> DataFrame:
    """(clause_id, status, issue, chunk_id, quote, risk, risk_source, discarded, error): the
    findings of all clauses in one plan.

    ``hits`` (clause_id, chunk_id, content) are what each clause retrieved, ``replies``
    (clause_id, text) what the model said in its last attempt, ``predictions`` as of
    ``override_risk`` with the quote's ``finding_key``. Findings whose quote is not in the chunk they name,
    among the clause's own hits, are discarded. A clause has a row for each finding that
    holds (status finding), or else one row that says why it has none: skipped (nothing
    retrieved), failed (no reply, or none that can be read, with ``error``), clean (the
    model found nothing), discarded (nothing held). So one bad reply costs one clause.
    Of several replies of a clause the smallest text counts; null ids join nothing.
    """
    had = hits.groupBy("clause_id").agg(F.count("*").alias("n_hits"))
    one = replies.groupBy("clause_id").agg(F.min("text").alias("text"))
    read = parse_model_json(clauses.select("clause_id").distinct().join(had, "clause_id", "left").join(one, "clause_id", "left"), FINDINGS, ["findings"])
    status = F.when(F.col("n_hits").isNull(), "skipped").when(F.col("bad"), "failed").when(F.size("parsed.findings") == 0, "clean").otherwise("discarded")
    error = F.when(F.col("status") == "failed", F.when(F.col("text").isNull(), "no reply").otherwise("reply is not the JSON asked for"))
    read = read.withColumn("status", status).withColumn("error", error)
    said = read.where("status = 'discarded'").select(F.col("clause_id").alias("run"), F.explode("parsed.findings").alias("f")).select("run", "f.*")
    judged = verify_claims(said, hits.withColumnRenamed("clause_id", "run"))
    rejected = judged.where("verdict <> 'verified'").groupBy(F.col("run").alias("clause_id")).agg(F.count("*").alias("discarded"))
    good = judged.where("verdict = 'verified'").select("run", "issue", "chunk_id", "quote", "risk", finding_key(F.col("quote")).alias("key"))
    found = override_risk(good, predictions).select(F.col("run").alias("clause_id"), F.lit("finding").alias("found"), "issue", "chunk_id", "quote", "risk", "risk_source")
    out = read.select("clause_id", "status", "error").join(rejected, "clause_id", "left").join(found, "clause_id", "left")
    return out.select("clause_id", F.coalesce("found", "status").alias("status"), "issue", "chunk_id", "quote", "risk", "risk_source", F.coalesce("discarded", F.lit(0)).alias("discarded"), "error")


def finding_key(quote: Column) -> Column:
    return F.left(F.sha2(quote, 256), F.lit(32))


def case_research(hits: DataFrame, graph_hits: DataFrame, assessments: DataFrame, authority: DataFrame) -> DataFrame:
    """(run, case_id, via_graph, stance, confidence, cited_by, rank, discarded): the cases of
    each run, those found by the citation graph flagged, verified and ranked.

    Both hits are (run, chunk_id, document_id, content), ``assessments`` (run, chunk_id,
    stance, confidence, quote), ``authority`` (document_id, cited_by). A hit without an
    assessment, or with one whose quote isn't in it, is discarded; a run that has none
    left keeps one row without a case. A chunk that both find is not of the graph.
    """
    cols = ["run", "chunk_id", "document_id", "content"]
    both = hits.select(*cols, F.lit(False).alias("via_graph")).unionByName(graph_hits.select(*cols, F.lit(True).alias("via_graph")))
    every = both.groupBy("run", "chunk_id").agg(F.min(F.struct("via_graph", "document_id", "content")).alias("x")).select("run", "chunk_id", "x.*")
    said = assessments.groupBy("run", "chunk_id").agg(F.min(F.struct("stance", "confidence", "quote")).alias("x")).select("run", "chunk_id", "x.*")
    own = every.select("run", "chunk_id", "via_graph", "document_id").join(said, ["run", "chunk_id"], "left")
    judged = verify_claims(own, every)
    discarded = judged.groupBy("run").agg(F.count_if(F.col("verdict") != "verified").alias("discarded"))
    good = judged.where("verdict = 'verified'").join(authority.select("document_id", "cited_by"), "document_id", "left").na.fill(0, ["cited_by"])
    ranked = rank_cases(good.withColumnRenamed("chunk_id", "case_id")).select("run", "case_id", "via_graph", "stance", "confidence", "cited_by", "rank")
    return discarded.join(ranked, "run", "left").select("run", "case_id", "via_graph", "stance", "confidence", "cited_by", "rank", "discarded")

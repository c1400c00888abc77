"""Assessment pipelines: model outputs as input tables, derived from the claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import assess as a
from tessera.sources import views as v
from tessera.sources.store import folder, written

from . import graph, search
from .registry import query

_REPLIES = """replies AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '```json' || chr(10) || j || chr(10) || '```' WHEN 1 THEN 'Here it is: ' || j || ' Thanks.' WHEN 2 THEN j
  WHEN 3 THEN 'no answer' ELSE replace(j, '"risk"', '"level"') END AS text, j FROM (SELECT event_id, '{"risk": "' || event_type || '", "n": ' || event_id || '}' AS j FROM events))"""


def replies(spark, d):
    e = v.table(spark, d, "events")
    j = F.concat(F.lit('{"risk": "'), "event_type", F.lit('", "n": '), F.col("event_id").cast("string"), F.lit("}"))
    m = F.col("event_id") % 5
    text = F.when(m == 0, F.concat(F.lit("```json\n"), j, F.lit("\n```"))).when(m == 1, F.concat(F.lit("Here it is: "), j, F.lit(" Thanks."))).when(m == 2, j).when(m == 3, "no answer")
    return e.select("event_id", text.otherwise(F.replace(j, F.lit('"risk"'), F.lit('"level"'))).alias("text"))


@query(f"WITH {_REPLIES} SELECT event_id, CASE WHEN event_id % 5 < 3 THEN json_extract_string(j, '$.risk') END AS risk, CASE WHEN event_id % 5 < 3 THEN json_extract(j, '$.n')::BIGINT END AS n, event_id % 5 >= 3 AS bad FROM replies")
def parse_model_json(spark, d):
    r = a.parse_model_json(replies(spark, d), "risk string, n long", ["risk", "n"])
    return r.select("event_id", "parsed.risk", "parsed.n", "bad")


FINDINGS = f"""{search.VERIFIED}, findings AS (SELECT claim_id, run, chunk_id, quote, ['high', 'medium', 'low'][run % 3 + 1] AS risk, left(sha256(quote), 32) AS key FROM verified WHERE verdict = 'verified'),
  predictions AS (SELECT key, CASE WHEN ascii(key) % 4 = 0 THEN 'unclear' ELSE ['high', 'medium', 'low'][ascii(key) % 3 + 1] END AS label, round((ascii(substr(key, 2, 1)) % 10) / 10.0, 1)::DOUBLE AS confidence FROM (SELECT DISTINCT key FROM findings)),
  final AS (SELECT f.claim_id, f.run, f.chunk_id, f.quote, f.key, CASE WHEN use THEN label ELSE risk END AS risk, CASE WHEN use THEN 'classifier' ELSE 'model' END AS risk_source, CASE WHEN use THEN confidence END AS risk_confidence,
    use AND label <> risk AS changed FROM (SELECT findings.*, label, confidence, coalesce(confidence >= 0.6 AND label IN ('high', 'medium', 'low'), false) AS use FROM findings LEFT JOIN predictions USING (key)) f)"""


def findings(spark, d):
    """Verified claims with the risk that the model gave, and a key of their text."""
    c = search.verify_claims(spark, d).where("verdict = 'verified'")
    risk = F.element_at(F.array(*map(F.lit, a.RISKS)), (F.col("run") % 3 + 1).cast("int"))
    return c.select("claim_id", "run", "chunk_id", "quote", risk.alias("risk"), F.left(F.sha2("quote", 256), F.lit(32)).alias("key"))


def predictions(found):
    k = found.select("key").distinct()
    level = F.element_at(F.array(*map(F.lit, a.RISKS)), F.ascii("key") % 3 + 1)
    return k.select("key", F.when(F.ascii("key") % 4 == 0, "unclear").otherwise(level).alias("label"), F.round((F.ascii(F.substring("key", 2, 1)) % 10) / 10.0, 1).alias("confidence"))


@query(f"{FINDINGS} SELECT * FROM final")
def override_risk(spark, d):
    f = written(findings(spark, d), folder(spark, "findings"))  # or the claims would be verified again for the predictions
    return a.override_risk(f, predictions(f))


@query(f"{FINDINGS} SELECT claim_id, risk, list_position(['high', 'medium', 'low'], risk)::INT AS place FROM final")
def findings_by_risk(spark, d):
    f = override_risk(spark, d).select("claim_id", "risk", a.order_of("risk", a.RISKS).cast("int").alias("place"))
    return f.orderBy("place", "claim_id")


_SIX = "array_to_string(string_split(content, ' ')[1:6], ' ')"
_AUDIT = f"""{search.HYBRID}, hits AS (SELECT query_id AS run, chunk_id, content, rank FROM hybrid JOIN chunks USING (chunk_id)),
  claims AS (SELECT run || '-' || rank AS claim_id, run, CASE rank WHEN 3 THEN 'none' ELSE chunk_id END AS chunk_id, CASE rank WHEN 2 THEN array_to_string(list_reverse(string_split(content, ' ')[1:6]), ' ') ELSE {_SIX} END AS quote, true AS real
    FROM hits WHERE rank <= 4 AND run % 5 < 3), {search.JUDGED},
  held AS (SELECT run, claim_id, chunk_id, quote, ['high', 'medium', 'low'][split_part(claim_id, '-', 2)::INT % 3 + 1] AS said, left(sha256(quote), 32) AS key FROM verified WHERE verdict = 'verified'),
  found AS (SELECT *, ['high', 'medium', 'low'][ascii(key) % 3 + 1] AS label, ascii(key) % 4 <> 0 AND (ascii(substr(key, 2, 1)) % 10) / 10.0 >= 0.6 AS use FROM held),
  lost AS (SELECT run, count(*) AS discarded FROM verified WHERE verdict <> 'verified' GROUP BY run)"""


def model_replies(hits):
    """What a model might say of each clause's first four hits (clause_id, chunk_id, content,
    rank): quotes, one with its words turned round, one of no chunk; of every fifth
    clause nothing to be read, of another fifth that nothing is wrong."""
    words = F.split("content", " ")
    quote = F.array_join(F.when(F.col("rank") == 2, F.reverse(F.slice(words, 1, 6))).otherwise(F.slice(words, 1, 6)), " ")
    risk = F.element_at(F.array(*map(F.lit, a.RISKS)), (F.col("rank") % 3 + 1).cast("int"))
    one = F.struct(F.col("rank"), F.concat(F.lit("issue "), F.col("rank")).alias("issue"), F.when(F.col("rank") == 3, "none").otherwise(F.col("chunk_id")).alias("chunk_id"), quote.alias("quote"), risk.alias("risk"))
    found = hits.where("rank <= 4").groupBy("clause_id").agg(F.sort_array(F.collect_list(one)).alias("findings"))
    m = F.col("clause_id") % 5
    said = F.concat(F.lit("```json\n"), F.to_json(F.struct("findings")), F.lit("\n```"))
    return found.select("clause_id", F.when(m == 4, "I can't say.").when(m == 3, '{"findings": []}').otherwise(said).alias("text"))


@query(f"""{_AUDIT}, rows AS (SELECT run AS clause_id, 'finding' AS status, 'issue ' || split_part(claim_id, '-', 2) AS issue, chunk_id, quote, CASE WHEN use THEN label ELSE said END AS risk, CASE WHEN use THEN 'classifier' ELSE 'model' END AS risk_source, NULL AS error FROM found
  UNION ALL SELECT query_id, CASE WHEN query_id NOT IN (SELECT run FROM hits) THEN 'skipped' WHEN query_id % 5 = 4 THEN 'failed' WHEN query_id % 5 = 3 THEN 'clean' ELSE 'discarded' END, NULL, NULL, NULL, NULL, NULL,
    CASE WHEN query_id % 5 = 4 AND query_id IN (SELECT run FROM hits) THEN 'reply is not the JSON asked for' END FROM queries WHERE query_id NOT IN (SELECT run FROM found))
  SELECT rows.*, coalesce(discarded, 0) AS discarded FROM rows LEFT JOIN lost ON run = clause_id""")
def clause_audit(spark, d):
    """Queries as clauses: their hits, the model's replies, verification, risk, findings."""
    x = search.Retrieval(spark, d)
    hits = x.fused.join(x.chunks.select("chunk_id", "content"), "chunk_id").select(F.col("query_id").alias("clause_id"), "chunk_id", "content", "rank")
    hits = written(hits, folder(spark, "clause-hits"))
    quotes = model_replies(hits)
    said = a.parse_model_json(quotes, a.FINDINGS, ["findings"]).select(F.explode("parsed.findings.quote").alias("quote"))
    clauses = x.queries.select(F.col("query_id").alias("clause_id"))
    return a.clause_audit(clauses, hits, quotes, predictions(said.select(a.finding_key(F.col("quote")).alias("key"))))


CASES = f"""{search.VERIFIED}, {v.EDGES}, authority AS (SELECT target_ref, count(*) AS n FROM edges GROUP BY target_ref),
  cases AS (SELECT claim_id AS case_id, run, quote, verdict, ['supports', 'opposes', 'neutral'][len(quote) % 3 + 1] AS stance, round((len(quote) % 100) / 100.0, 2)::DOUBLE AS confidence, coalesce(n, 0) AS cited_by
    FROM verified LEFT JOIN authority ON target_ref = 'CASE-' || split_part(claim_id, '-', 1)),
  ranked AS (SELECT * EXCLUDE verdict, row_number() OVER (PARTITION BY run ORDER BY (stance = 'neutral'), confidence DESC, cited_by DESC, case_id) AS rank FROM cases WHERE verdict = 'verified')"""


def cases(spark, d):
    """A case for each claim: its stance and confidence as a model would give them, and how
    often its document is cited."""
    c = search.verify_claims(spark, d)
    n = v.edges(spark, d).groupBy(F.col("target_ref").alias("ref")).agg(F.count("*").alias("cited_by"))
    stance = F.element_at(F.array(*map(F.lit, a.STANCES)), F.length("quote") % 3 + 1)
    own = c.select(F.col("claim_id").alias("case_id"), "run", "quote", "verdict", stance.alias("stance"), F.round((F.length("quote") % 100) / 100.0, 2).alias("confidence"), F.concat(F.lit("CASE-"), F.split_part("claim_id", F.lit("-"), F.lit(1))).alias("ref"))
    return own.join(n, "ref", "left").drop("ref").na.fill(0, ["cited_by"])


@query(f"{CASES} SELECT * FROM ranked")
def rank_cases(spark, d):
    return a.rank_cases(cases(spark, d).where("verdict = 'verified'").drop("verdict"))


@query(f"{CASES} SELECT case_id, stance, confidence, list_position(['supports', 'opposes', 'neutral'], stance)::INT AS place FROM ranked")
def cases_by_stance(spark, d):
    c = rank_cases(spark, d).select("case_id", "stance", "confidence", a.order_of("stance", a.STANCES).cast("int").alias("place"))
    return c.orderBy("place", F.desc("confidence"), "case_id")


@query(f"{CASES} SELECT level, count(case_id) AS n FROM (VALUES ('supports'), ('opposes'), ('neutral')) l(level) LEFT JOIN ranked ON stance = level GROUP BY level")
def stance_summary(spark, d):
    return a.level_counts(rank_cases(spark, d), "stance", a.STANCES)


_RESEARCH = f"""{graph.EXPANDED}, both_hits AS (SELECT query_id AS run, chunk_id, false AS via_graph FROM hybrid UNION ALL SELECT query_id, chunk_id, true FROM passage),
  hits AS (SELECT run, chunk_id, via_graph, document_id, content FROM both_hits JOIN chunks USING (chunk_id)),
  claims AS (SELECT chunk_id AS claim_id, run, chunk_id, CASE WHEN length(content) % 7 = 3 THEN '' WHEN length(content) % 4 = 0 THEN array_to_string(list_reverse(string_split(content, ' ')[1:6]), ' ') ELSE {_SIX} END AS quote, true AS real FROM hits),
  {search.JUDGED}, cites AS (SELECT target_id, count(*) AS n FROM resolved GROUP BY target_id),
  ranked AS (SELECT hits.run, hits.chunk_id AS case_id, via_graph, ['supports', 'opposes', 'neutral'][length(content) % 3 + 1] AS stance, round((length(content) % 100) / 100.0, 2)::DOUBLE AS confidence, coalesce(n, 0) AS cited_by
    FROM hits JOIN verified ON verified.run = hits.run AND verified.claim_id = hits.chunk_id LEFT JOIN cites ON target_id = document_id WHERE verdict = 'verified'),
  lost AS (SELECT run, count(*) FILTER (verdict <> 'verified') AS discarded FROM verified GROUP BY run)"""


def assessments(hits):
    """What a model might say of each hit (run, chunk_id, content); of some it says nothing,
    of others what isn't there."""
    n, words = F.length("content"), F.slice(F.split("content", " "), 1, 6)
    quote = F.array_join(F.when(n % 4 == 0, F.reverse(words)).otherwise(words), " ")
    stance = F.element_at(F.array(*map(F.lit, a.STANCES)), n % 3 + 1)
    return hits.where(n % 7 != 3).select("run", "chunk_id", stance.alias("stance"), F.round((n % 100) / 100.0, 2).alias("confidence"), quote.alias("quote"))


@query(f"""{_RESEARCH} SELECT lost.run, case_id, via_graph, stance, confidence, cited_by,
  CASE WHEN case_id IS NOT NULL THEN row_number() OVER (PARTITION BY lost.run ORDER BY (stance = 'neutral'), confidence DESC, cited_by DESC, case_id) END AS rank, discarded FROM lost LEFT JOIN ranked USING (run)""")
def case_research(spark, d):
    """Queries as fact patterns: their hits and those that the citation graph adds, assessed,
    verified and ranked."""
    x, edges = search.Retrieval(spark, d), written(graph.resolve_targets(spark, d), folder(spark, "edges"))
    own = x.chunks.select("chunk_id", "document_id", "content")
    as_hits = lambda h: written(h.select(F.col("query_id").alias("run"), "chunk_id").join(own, "chunk_id"), folder(spark, "hits"))
    near, far = as_hits(x.fused), as_hits(graph.expanded(x, edges))
    n = edges.where("target_id is not null").groupBy(F.col("target_id").alias("document_id")).agg(F.count("*").alias("cited_by"))
    return a.case_research(near, far, assessments(near.unionByName(far)), n)


@query(f"""{CASES} SELECT run, left(string_agg(concat_ws(' | ', case_id, stance, printf('%.2f', confidence), left(quote, 12000)), chr(10) ORDER BY rank), 12000) AS memo FROM ranked GROUP BY run""")
def memo_input(spark, d):
    return a.memo_input(rank_cases(spark, d))


@query("SELECT doc_id, text || ' [SEP] ' || passage AS pair FROM documents JOIN (SELECT item_id AS doc_id, text AS passage FROM benchmark) USING (doc_id)")
def stance_pair(spark, d):
    passages = v.table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("passage"))
    return v.table(spark, d, "documents").select("doc_id", "text").join(passages, "doc_id").select("doc_id", F.concat_ws(" [SEP] ", "text", "passage").alias("pair"))

"""Citation graph: references, edges, resolution and authority."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import citations as c
from tessera.operators import graph as g
from tessera.operators.embedding import HashEncoder
from tessera.sources import views as v
from tessera.sources.store import folder, written

from . import search
from .registry import query

_SQL = [("SCR", r"\[?(1[89]\d{2}|20\d{2})\]?\s*(?:(\d{1,2})\s*)?S\.?\s*C\.?\s*R\.?\s*(\d{1,4})", r"SCR-\1-\2-\3"), ("AIR", r"A\.?\s*I\.?\s*R\.?\s*\.?\s*(1[89]\d{2}|20\d{2})\s*(?:S\.?\s*C\.?|[A-Z][a-z]{2,})\s*\.?\s*(\d{1,4})", r"AIR-\1-\2"), ("SCC", r"\((1[89]\d{2}|20\d{2})\)\s*(\d{1,2})\s*S\.?\s*C\.?\s*C\.?\s*(\d{1,4})", r"SCC-\1-\2-\3")]
_REFS = "refs AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, replace(regexp_replace(unnest(regexp_extract_all(text, '(?i){p}')), '(?i){p}', '{to}'), '--', '-') AS target_ref FROM judgments" for k, p, to in _SQL) + ")"


@query(f"WITH {v.JUDGMENTS}, {_REFS} SELECT * FROM refs")
def extract_reporter_refs(spark, d):
    return c.extract_reporter_refs(v.judgments(spark, d)).select("doc_id", "kind", "target_ref")


_CITED = " ".join(f"WHEN '{raw}' THEN '{ref}'" for raw, ref in v.CITED.items())


@query(f"WITH {v.JUDGMENTS} SELECT doc_id, CASE raw {_CITED} END AS target_ref FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{'|'.join(v.CITED)}')) AS raw FROM judgments)")
def extract_case_names(spark, d):
    """Every case name by identity: what leads in, goes on after it or marks a company is off."""
    return c.extract_case_names(v.judgments(spark, d)).select("doc_id", "target_ref")


@query("""SELECT doc_id, 'x' || doc_id || ' y' AS party FROM documents""")
def normalise_party(spark, d):
    """A party's name with narration, sentence, suffix and article around it."""
    name = F.concat(F.lit("as was said by the X"), "doc_id", F.lit(" Y  Co. Ltd. governs this and all"))
    return v.table(spark, d, "documents").select("doc_id", c.normalise_party(name).alias("party"))


@query(f"WITH {v.JUDGMENTS} SELECT doc_id, len(regexp_extract_all(text, 'For the Respondent vs The Petitioner')) AS dropped FROM judgments")
def drop_non_parties(spark, d):
    """How many names of a text have a side that is no party."""
    raw = F.regexp_extract_all("text", F.lit(c.CASE_NAME), 0)
    side = lambda x, g: c.is_party(c.normalise_party(F.regexp_extract(x, c.CASE_NAME, g)))
    return v.judgments(spark, d).select("doc_id", F.size(F.filter(raw, lambda x: ~(side(x, 1) & side(x, 2)))).cast("long").alias("dropped"))


@query(f"WITH {v.JUDGMENTS}, {_REFS} SELECT doc_id, target_ref FROM refs GROUP BY ALL")
def dedupe_refs(spark, d):
    refs = c.extract_reporter_refs(v.judgments(spark, d))
    return c.dedupe_refs(refs).select("doc_id", "target_ref")


@query()
def citation_context(spark, d):
    return c.extract_citations(v.judgments(spark, d)).select("doc_id", "target_ref", "kind", "raw", "context", "rank")


@query()
def judgment_header(spark, d):
    return c.judgment_header(v.judgments(spark, d))


_NODES = "nodes AS (SELECT doc_id AS target_id, 'CASE-' || doc_id AS target_ref FROM documents)"
_RESOLVED = f"{v.EDGES}, {_NODES}, resolved AS (SELECT source_id, target_ref, CASE WHEN target_id <> source_id THEN target_id END AS target_id FROM edges LEFT JOIN nodes USING (target_ref))"


@query(f"WITH {_RESOLVED} SELECT * FROM resolved")
def resolve_targets(spark, d):
    named = v.table(spark, d, "documents").select("doc_id", F.concat(F.lit("CASE-"), "doc_id").alias("source_ref"))
    return g.resolve_targets(v.edges(spark, d), named)


@query(f"WITH {v.EDGES} SELECT DISTINCT source_id, target_ref FROM edges")
def add_edges(spark, d):
    """Adding all edges to those of even documents adds the odd ones' only."""
    e = v.edges(spark, d).dropDuplicates(["source_id", "target_ref"])
    have = e.where("source_id % 2 = 0")
    return have.unionByName(e.join(have, ["source_id", "target_ref"], "left_anti"))


@query(f"WITH {_RESOLVED} SELECT source_id, target_ref, target_id FROM resolved WHERE source_id = 7")
def cites(spark, d):
    return resolve_targets(spark, d).where("source_id = 7")


@query(f"WITH {_RESOLVED} SELECT target_id, source_id FROM resolved WHERE target_id = 3")
def cited_by(spark, d):
    return resolve_targets(spark, d).where("target_id = 3").select("target_id", "source_id")


@query(f"WITH {_RESOLVED} SELECT doc_id, count(source_id) AS authority FROM documents LEFT JOIN resolved ON target_id = doc_id GROUP BY doc_id")
def authority_counts(spark, d):
    n = resolve_targets(spark, d).where("target_id is not null").groupBy(F.col("target_id").alias("doc_id")).agg(F.count("*").alias("n"))
    return v.table(spark, d, "documents").select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("authority"))


@query(f"WITH {_RESOLVED} SELECT target_ref, count(*) AS n FROM resolved WHERE target_id IS NULL GROUP BY target_ref")
def dangling_report(spark, d):
    return resolve_targets(spark, d).where("target_id is null").groupBy("target_ref").agg(F.count("*").alias("n"))


EXPANDED = f"""{search.HYBRID}, {_RESOLVED}, h AS (SELECT query_id, document_id, rank FROM hybrid JOIN chunks USING (chunk_id)),
  reached AS (SELECT query_id, target_id, min(rank) AS hit, min(target_ref) AS ref FROM h JOIN resolved ON source_id = document_id WHERE rank <= 3 AND target_id IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM h s WHERE s.query_id = h.query_id AND s.document_id = target_id) GROUP BY query_id, target_id),
  expanded AS (SELECT query_id, target_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hit, ref) AS r FROM reached) WHERE r <= 3),
  passage AS (SELECT * FROM (SELECT query_id, target_id, chunk_id, {search.COS} AS score, row_number() OVER (PARTITION BY query_id, target_id ORDER BY {search.COS} DESC, chunk_id) AS r
    FROM expanded JOIN queries USING (query_id) JOIN embedded ON document_id = target_id WHERE embedding IS NOT NULL) WHERE r = 1)"""


_CITED_BY_REF = EXPANDED[: EXPANDED.index("  expanded AS")] + f"""  cited AS (SELECT query_id, target_id, ref FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hit, ref) AS r FROM reached) WHERE r <= 3),
  asked AS (SELECT DISTINCT target_id, ref FROM cited), named AS (SELECT DISTINCT ref FROM asked), {v.hashed("r_hash", "ref", "ref", "named", v.DIMS)},
  own AS (SELECT target_id, ref, chunk_id, round(list_cosine_similarity(embedded.embedding::DOUBLE[], r_hash.embedding::DOUBLE[]), 6) AS cos FROM asked JOIN r_hash USING (ref) JOIN embedded ON document_id = target_id),
  rterms AS (SELECT * FROM (SELECT ref, unnest(list_distinct(regexp_extract_all(lower(ref), '[\\p{{L}}\\p{{N}}]+'))) AS term FROM named) WHERE term NOT IN ({search._STOP})),
  near AS (SELECT target_id, ref, chunk_id, 0 AS a, row_number() OVER (PARTITION BY target_id, ref ORDER BY cos DESC, chunk_id) AS rank FROM own WHERE cos IS NOT NULL QUALIFY rank <= 20),
  worded AS (SELECT target_id, ref, chunk_id, sum(tf) AS n FROM own JOIN rterms USING (ref) JOIN postings USING (chunk_id, term) GROUP BY ALL),
  words AS (SELECT target_id, ref, chunk_id, 1 AS a, row_number() OVER (PARTITION BY target_id, ref ORDER BY n DESC, chunk_id) AS rank FROM worded QUALIFY rank <= 3),
  summed AS (SELECT target_id, ref, chunk_id, round(sum(CASE a WHEN 0 THEN 1.0 ELSE 0.1 END / (60 + rank)), 9)::DOUBLE AS score, min(a * 1000 + rank) AS f FROM (SELECT * FROM near UNION ALL SELECT * FROM words) GROUP BY ALL),
  passage AS (SELECT * FROM summed QUALIFY row_number() OVER (PARTITION BY target_id, ref ORDER BY score DESC, f, chunk_id) = 1)"""


@query(f"{_CITED_BY_REF} SELECT query_id, target_id, chunk_id, score FROM cited JOIN passage USING (target_id, ref)")
def expand_via_graph(spark, d):
    """Documents that a query's three best hits cite and that it has not seen, three at
    most by hit rank and reference, each with its best passage by hybrid search within it
    for the reference that it is cited by."""
    x = search.Retrieval(spark, d)
    cited = written(g.cited_documents(_documents(x), resolve_targets(spark, d)), folder(spark, "cited"))
    return cited.join(g.passages(cited, x.chunks, HashEncoder(v.DIMS)), ["target_id", "ref"]).drop("ref")


def _documents(x):
    return x.fused.join(x.chunks.select("chunk_id", "document_id"), "chunk_id").select("query_id", "document_id", "rank")


def expanded(x, edges):
    """The same with the passages nearest to the query."""
    return g.expand_via_graph(_documents(x), edges, x.queries, x.chunks)

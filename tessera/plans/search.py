"""Retrieval and verification."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import retrieval as r
from tessera.operators.verify import feedback, groundedness, misjudged, rejections
from tessera.operators.verify import verify_claims as verify
from tessera.functions.text import STOP, fold_quote
from tessera.sources import corpus
from tessera.sources import views as v
from tessera.sources.store import folder, written

from .registry import query

_STOP = ", ".join(f"'{w}'" for w in STOP)
COS = "round(list_cosine_similarity(embedding::DOUBLE[], vector::DOUBLE[]), 6)"
KNN = f"""knn AS (SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM (SELECT query_id, chunk_id, {COS} AS score FROM embedded, queries WHERE embedding IS NOT NULL)) WHERE rank <= 24)"""
INDEX = f"""postings AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(concat_ws(' ', label, content)), '[\\p{{L}}\\p{{N}}]+')) AS term FROM chunks)
  WHERE term NOT IN ({_STOP}) GROUP BY ALL)"""
TERMS = f"""qterms AS (SELECT * FROM (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+'))) AS term FROM queries) WHERE term NOT IN ({_STOP}))"""
LEX = """lex AS (SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM (SELECT query_id, chunk_id, sum(tf)::DOUBLE AS score FROM qterms JOIN postings USING (term) GROUP BY ALL)) WHERE rank <= {k})"""
ALL = f"WITH {v.EVAL}, {KNN}, {INDEX}, {TERMS}, {LEX.format(k=3)}"
FUSED = """fused AS (SELECT query_id, chunk_id, round(sum(s), 9) AS score, string_agg(DISTINCT arm, ',' ORDER BY arm) AS matched_by, min(a * 1000 + rank) AS f
  FROM (SELECT query_id, chunk_id, 'vector' AS arm, 0 AS a, rank, {wv} / (60 + rank) AS s FROM knn UNION ALL SELECT query_id, chunk_id, 'lexical', 1, rank, {wl} / (60 + rank) FROM lex) GROUP BY ALL),
  hybrid AS (SELECT * EXCLUDE f FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f, chunk_id) AS rank FROM fused) WHERE rank <= 8)"""
HYBRID = f"{ALL}, {FUSED.format(wv=1.0, wl=0.1)}"


@query(f"""WITH {v.EMBEDDED} SELECT chunk_id, {COS} AS score, row_number() OVER (ORDER BY {COS} DESC, chunk_id) AS rank
  FROM embedded, (SELECT embedding AS vector FROM embeddings WHERE vec_id = 0) WHERE embedding IS NOT NULL AND kind = 'src7' QUALIFY rank <= 8""")
def vector_search(spark, d):
    """The chunks of one kind that are nearest to a vector."""
    vector = v.table(spark, d, "embeddings").where("vec_id = 0").first().embedding
    return r.vector_search(vector, v.embedded(spark, d), 8, kind="src7")


@query(f"WITH {v.EMBEDDED}, {v.QUERIES}, {KNN} SELECT * FROM knn")
def knn_join(spark, d):
    return r.knn_join(v.queries(spark, d), v.embedded(spark, d), 24)


@query(f"WITH {v.CHUNKS}, {INDEX} SELECT * FROM postings")
def lexical_index(spark, d):
    """What the stored index holds once it is brought up to date."""
    return corpus.index(spark, d).postings()


@query(f"WITH {v.QUERIES}, {TERMS} SELECT * FROM qterms")
def lexical_query_terms(spark, d):
    return r.query_terms(v.queries(spark, d))


@query(f"WITH {v.CHUNKS}, {v.QUERIES}, {INDEX}, {TERMS}, {LEX.format(k=8)} SELECT * FROM lex")
def lexical_search(spark, d):
    return corpus.index(spark, d).search(v.queries(spark, d), 8)


@query(f"""WITH {v.CHUNKS}, {v.QUERIES}, {INDEX.replace("FROM chunks)", "FROM chunks WHERE kind = 'src7' AND document_id = 7)")}, {TERMS}, {LEX.format(k=8)} SELECT * FROM lex""")
def lexical_search_in_document(spark, d):
    """The same within one kind and document: filters hold before the ranking."""
    return corpus.index(spark, d).search(v.queries(spark, d), 8, kind="src7", document_id=7)


class Retrieval:
    """Query set, corpus and hits of both arms, found once for all that rides on them."""

    def __init__(self, spark, d, limit: int = 8):
        self.asked = written(corpus.query_set(spark, d), folder(spark, "asked"))
        self.queries = corpus.eval_queries(self.asked)
        self.chunks = corpus.encoded(spark, d)
        self.arms = r.hybrid_arms(self.queries, self.chunks, corpus.index(spark, d), limit)
        self.fused = r.fuse(self.arms, limit)


@query(f"{HYBRID} SELECT * FROM hybrid")
def hybrid_search(spark, d):
    return Retrieval(spark, d).fused


@query(f"{ALL}, {FUSED.format(wv=1.0, wl=1.0)} SELECT * FROM hybrid")
def rrf_fuse(spark, d):
    return r.fuse(Retrieval(spark, d).arms, weights=(1.0, 1.0))


#: Under it, the nearest chunk is not among the best by words: 1 / 61 + 0.1 / 63 is more, 1 / 61 less.
WEAK = 0.0179


@query(f"{HYBRID} SELECT query_id, max(score) AS best FROM queries LEFT JOIN hybrid USING (query_id) GROUP BY ALL HAVING coalesce(max(score), 0) < {WEAK}")
def weak_retrieval(spark, d):
    x = Retrieval(spark, d)
    return r.weak(x.queries, x.fused, WEAK)


@query("""WITH a AS (SELECT user_id AS clause, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt, value AS score FROM events), b AS (SELECT *, score >= 50 AS good FROM a WHERE attempt <= 2)
  SELECT clause, attempt, score, CASE WHEN good THEN 'accepted' WHEN attempt = 2 THEN 'exhausted' ELSE 'open' END AS outcome
  FROM b QUALIFY row_number() OVER (PARTITION BY clause ORDER BY coalesce(good, false) DESC, CASE WHEN good THEN attempt ELSE -attempt END) = 1""")
def final_attempt(spark, d):
    """A user's events as attempts at a clause, their values as scores."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = v.table(spark, d, "events").select(F.col("user_id").alias("clause"), F.row_number().over(w).alias("attempt"), F.col("value").alias("score"))
    return r.final_attempt(e, 50.0)


@query(f"{HYBRID}, top5 AS (SELECT query_id, string_agg(content, chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM hybrid JOIN chunks USING (chunk_id) WHERE rank <= 5 GROUP BY ALL) SELECT query_id, coalesce(context, 'No context found.') AS context FROM queries LEFT JOIN top5 USING (query_id)")
def render_context(spark, d):
    x = Retrieval(spark, d)
    hits = x.fused.where("rank <= 5").join(x.chunks.select("chunk_id", "content"), "chunk_id")
    block = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda y: y.content), "\n---\n")
    ctx = hits.groupBy("query_id").agg(block.alias("context"))
    return x.queries.select("query_id").join(ctx, "query_id", "left").select("query_id", F.coalesce("context", F.lit("No context found.")).alias("context"))


# letters that decompose into one letter and one mark; the mark becomes a space
_MARKED = [c for c in map(chr, range(0xC0, 0x180)) if len(x := unicodedata.normalize("NFKD", c)) == 2 and unicodedata.combining(x[1])]
_PLAIN = "".join(unicodedata.normalize("NFKD", c)[0] for c in _MARKED)
_MARKED = "".join(_MARKED)
_FOLD = (
    "lower(trim(regexp_replace(regexp_replace(translate(translate(regexp_replace({c}, '([" + _MARKED + "])', '\\1 ', 'g'), '" + _MARKED + "', '" + _PLAIN + "'), '‘’“”–—', '''''\"\"--'),"
    " '[^\\p{{L}}\\p{{N}}_\\s''\"-]', ' ', 'g'), '\\s+', ' ', 'g')))"
)
#: From the relations claims and hits to verified.
JUDGED = f"""j AS (SELECT claim_id, trim(claims.chunk_id) AS chunk_id, claims.run, real, quote, {_FOLD.format(c="quote")} AS q, {_FOLD.format(c="content")} AS s, hits.chunk_id IS NOT NULL AS known
  FROM claims LEFT JOIN hits ON claims.run = hits.run AND trim(claims.chunk_id) = hits.chunk_id), w AS (SELECT *, string_split(q, ' ') AS words FROM j),
ratios AS (SELECT * EXCLUDE (q, s, words, known), CASE WHEN NOT known THEN NULL WHEN q = '' THEN 0.0 WHEN contains(s, q) THEN 1.0 WHEN len(words) < 4 THEN 0.0 ELSE
  round(list_max(list_transform(range(0, len(words)), lambda i: list_max(list_transform(range(1, len(words) - i + 1), lambda k: CASE WHEN contains(s, array_to_string(words[i + 1 : i + k], ' ')) THEN k ELSE 0 END)))) / len(words), 6) END::DOUBLE AS ratio,
  len(words) AS n, known FROM w),
verified AS (SELECT * EXCLUDE (n, known), CASE WHEN NOT known THEN 'unknown_chunk' WHEN n < 4 THEN 'quote_too_short' WHEN ratio < 0.85 THEN 'quote_not_found' ELSE 'verified' END AS verdict FROM ratios)"""
VERIFIED = f"WITH {v.CLAIMS}, {JUDGED}"


@query(f"{VERIFIED} SELECT * FROM verified")
def verify_claims(spark, d):
    return verify(v.claims(spark, d), v.hits(spark, d))


@query(f"{VERIFIED} SELECT claim_id, ratio FROM verified")
def quote_run_ratio(spark, d):
    return verify_claims(spark, d).select("claim_id", "ratio")


_ATTEMPT = "(ascii(substr(claim_id, length(claim_id), 1)) % 2 + 1)"


@query(f"{VERIFIED} SELECT run, string_agg('- issue ' || claim_id || ': ' || verdict, chr(10) ORDER BY claim_id) AS feedback FROM verified WHERE verdict <> 'verified' GROUP BY run")
def rejection_feedback(spark, d):
    """What each run is told: all issues whose quotes failed, and why."""
    return feedback(verify_claims(spark, d).withColumn("issue", F.concat(F.lit("issue "), "claim_id")))


@query(f"""{VERIFIED}, a AS (SELECT *, {_ATTEMPT} AS attempt FROM verified) SELECT verdict, count(*) AS n, count(*) FILTER (attempt = last) AS discarded
  FROM (SELECT *, max(attempt) OVER (PARTITION BY run) AS last FROM a) WHERE verdict <> 'verified' GROUP BY verdict""")
def rejection_stats(spark, d):
    """Rejections by reason; those of a run's last attempt are discarded for good, the others
    went back to the model."""
    return rejections(verify_claims(spark, d).withColumn("attempt", F.expr(_ATTEMPT)))


@query(f"""{VERIFIED} SELECT real, round(avg(CASE WHEN (verdict = 'verified') = real THEN 1.0 WHEN real IS NOT NULL THEN 0.0 END), 6) AS rate, count(*) AS n,
  count(*) FILTER ((verdict = 'verified') <> real) AS failing FROM verified GROUP BY real""")
def groundedness_rates(spark, d):
    return groundedness(verify_claims(spark, d))


@query(f"{VERIFIED} SELECT (SELECT count(*) FROM verified WHERE real IS NULL) AS open, (SELECT count(*) FROM verified WHERE (verdict = 'verified') <> real) AS failing, (SELECT min(claim_id) FROM verified WHERE (verdict = 'verified') <> real) AS first")
def groundedness_failures(spark, d):
    """How many claims can't be told apart from outside, how many of the others are judged
    wrongly, and the first of these."""
    verified = written(verify_claims(spark, d), folder(spark, "verified"))
    bad = misjudged(verified).agg(F.count("*").alias("failing"), F.min("claim_id").alias("first")).withColumn("k", F.lit(1))
    return verified.agg(F.count_if(F.col("real").isNull()).alias("open")).withColumn("k", F.lit(1)).join(bad, "k").drop("k")


@query(f"WITH {v.CHUNKS} SELECT chunk_id, md5({_FOLD.format(c='content')}) AS folded FROM chunks")
def normalise_quote(spark, d):
    return v.chunks(spark, d).select("chunk_id", F.md5(fold_quote(F.col("content"))).alias("folded"))

"""The given tables as the relations that the operators work on, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(docs: DataFrame) -> DataFrame:
    """Lines of documents as chunks; ``docs`` may be a stream."""
    cut = docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("ordinal", "content")).where(F.col("content").rlike(r"\S"))
    return cut.select(
        F.concat_ws("-", "doc_id", "ordinal").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("source").alias("kind"),
        F.col("lang").alias("title"), "ordinal", F.when(F.col("ordinal") % 3 == 0, F.concat(F.lit("Section "), "ordinal")).alias("label"), "content",
    )


def chunks(spark, d) -> DataFrame:
    """Lines of documents; the first line of a document has its vector, if any."""
    return lines(table(spark, d, "documents"))


CHUNKS = """chunks AS (SELECT doc_id || '-' || ordinal AS chunk_id, doc_id AS document_id, kind, title, ordinal, CASE WHEN ordinal % 3 = 0 THEN 'Section ' || ordinal END AS label, content FROM (
  SELECT doc_id, source AS kind, lang AS title, unnest(string_split(text, chr(10))) AS content,
         unnest(range(len(string_split(text, chr(10)))))::INT AS ordinal FROM documents) WHERE regexp_matches(content, '\\S'))"""


def embedded(spark, d) -> DataFrame:
    return chunks(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("document_id"), F.when(F.lit(True), F.col("embedding")).alias("embedding")), "document_id", "left").withColumn("embedding", F.when(F.col("ordinal") == 0, F.col("embedding")))


EMBEDDED = CHUNKS + """, embedded AS (SELECT chunks.*, CASE WHEN ordinal = 0 THEN embedding END AS embedding
  FROM chunks LEFT JOIN embeddings ON vec_id = document_id)"""


def queries(spark, d) -> DataFrame:
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return q.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id")


QUERIES = "queries AS (SELECT item_id AS query_id, text AS query, embedding AS vector FROM benchmark JOIN embeddings ON vec_id = item_id)"


def hashed(name: str, key: str, text: str, source: str, dims: int) -> str:
    """SQL of what ``HashEncoder`` gives: ``name`` (key, embedding) of the texts in ``source``."""
    return f"""{name}_n AS (SELECT {key}, ('0x' || md5(w)[1:2])::INT * {dims} // 256 AS i, count(*) AS n FROM (SELECT {key}, unnest(string_split({text}, ' ')) AS w FROM {source}) WHERE w <> '' GROUP BY ALL),
  {name} AS (SELECT {key}, list((coalesce(n, 0) / norm)::FLOAT ORDER BY i) AS embedding FROM (SELECT {key}, sqrt(sum(n * n)) AS norm FROM {name}_n GROUP BY {key}) CROSS JOIN range({dims}) r(i) LEFT JOIN {name}_n USING ({key}, i) GROUP BY {key})"""


DIMS = 64  # of the encoder that evaluation uses


def relevance(spark, d) -> DataFrame:
    """(query_id, document_id): documents that hold the first 60 characters of a benchmark
    item's first line, if these are three words or more. Windows of three words find them
    by an equi-join, then the text decides."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    begin = F.left(F.element_at(F.split("text", "\n"), 1), F.lit(60))
    items = table(spark, d, "benchmark").select("item_id", begin.alias("begin"), F.array_join(F.slice(F.split(begin, r"\s+"), 1, 3), " ").alias("w")).where(F.size(F.split("begin", r"\s+")) >= 3)
    words = docs.select("doc_id", F.split("text", r"\s+").alias("s"))
    three = words.where("size(s) > 2").select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("s") - 2), lambda i: F.array_join(F.slice("s", i, 3), " "))).alias("w"))
    met = three.join(items, "w").select("doc_id", "item_id", "begin").distinct()
    return met.join(docs, "doc_id").where(F.contains("text", F.col("begin"))).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("document_id"))


#: Whether a document is relevant to a benchmark item.
ABOUT = """(contains(documents.text, left(string_split(benchmark.text, chr(10))[1], 60)) AND len(string_split_regex(left(string_split(benchmark.text, chr(10))[1], 60), '\\s+')) >= 3)"""
EVAL = f"""{CHUNKS}, {hashed("c_hash", "chunk_id", "content", "chunks", DIMS)}, {hashed("q_hash", "item_id", "text", "benchmark", DIMS)},
  embedded AS (SELECT chunks.*, embedding FROM chunks LEFT JOIN c_hash USING (chunk_id)),
  relevance AS (SELECT item_id AS query_id, doc_id AS document_id FROM benchmark JOIN documents ON {ABOUT}),
  queries AS (SELECT item_id AS query_id, text AS query, embedding AS vector FROM benchmark JOIN q_hash USING (item_id) WHERE item_id IN (SELECT query_id FROM relevance))"""


def edges(spark, d) -> DataFrame:
    """Each document cites three others by reference, spread over all documents; every
    fifth reference is unknown."""
    docs = table(spark, d, "documents").select("doc_id")
    n = docs.agg(F.count("*").alias("n_docs"))
    e = docs.select("doc_id", F.explode(F.array(F.lit(3), F.lit(7), F.lit(11))).alias("k")).crossJoin(F.broadcast(n))
    to = (F.col("doc_id") * F.col("k") + 3) % F.col("n_docs")
    ref = F.concat(F.when((F.col("doc_id") + F.col("k")) % 5 == 0, "X-").otherwise("CASE-"), to.cast("string"))
    return e.select(F.col("doc_id").alias("source_id"), ref.alias("target_ref"))


EDGES = """edges AS (SELECT doc_id AS source_id, CASE WHEN (doc_id + k) % 5 = 0 THEN 'X-' ELSE 'CASE-' END || ((doc_id * k + 3) % (SELECT count(*) FROM documents)) AS target_ref
  FROM documents, (VALUES (3), (7), (11)) v(k))"""


def claims_of(c: DataFrame) -> DataFrame:
    """A quote of twelve words from each line of every text: as it is, with words turned
    round, or too short, against its own chunk or none. Ten documents are a run.

    ``real`` says whether it is one that holds; null where that is open: words with
    accents fall apart when they are folded, so a few may count as enough, and words
    turned round may read the same."""
    m = F.col("document_id") % 5
    words = F.split("content", " ", 13)
    plain = F.array_join(F.slice(words, 1, 12), " ")
    quote = F.when(m == 1, F.array_join(F.reverse(F.slice(words, 1, 12)), " ")).when(m == 2, F.array_join(F.slice(words, 1, 2), " ")).otherwise(plain)
    at = F.when(m == 3, F.lit(" none ")).otherwise(F.concat(F.lit(" "), "chunk_id", F.lit(" ")))
    n, ascii = F.size(F.regexp_extract_all(quote, F.lit(r"\p{L}+"), 0)), quote.rlike(r"^[\x00-\x7F]*$")
    real = F.when((m == 3) | (F.col("document_id") % 10 == 4), False).when((n < 4) & ascii, False).when((n >= 4) & m.isin(0, 4), True).when((n >= 4) & (m == 1) & (quote != plain), False)
    return c.select(F.col("chunk_id").alias("claim_id"), at.alias("chunk_id"), quote.alias("quote"), F.floor(F.col("document_id") / 10).alias("run"), real.alias("real"))


def claims(spark, d) -> DataFrame:
    return claims_of(chunks(spark, d))


def hits(spark, d) -> DataFrame:
    """(run, chunk_id, content): the chunks that each run retrieved, all but those of the
    documents whose id ends in 4."""
    return chunks(spark, d).where("document_id % 10 <> 4").select(F.floor(F.col("document_id") / 10).alias("run"), "chunk_id", "content")


CLAIMS = CHUNKS + """, quoted AS (SELECT *, array_to_string(string_split(content, ' ')[1:12], ' ') AS plain, CASE document_id % 5 WHEN 1 THEN array_to_string(list_reverse(string_split(content, ' ')[1:12]), ' ')
    WHEN 2 THEN array_to_string(string_split(content, ' ')[1:2], ' ') ELSE array_to_string(string_split(content, ' ')[1:12], ' ') END AS quote FROM chunks),
  claims AS (SELECT chunk_id AS claim_id, CASE WHEN document_id % 5 = 3 THEN ' none ' ELSE ' ' || chunk_id || ' ' END AS chunk_id, quote, document_id // 10 AS run,
    CASE WHEN document_id % 5 = 3 OR document_id % 10 = 4 THEN false WHEN n < 4 AND length(quote) = strlen(quote) THEN false WHEN n >= 4 AND document_id % 5 IN (0, 4) THEN true WHEN n >= 4 AND document_id % 5 = 1 AND quote <> plain THEN false END AS real
    FROM (SELECT *, len(regexp_extract_all(quote, '\\p{L}+')) AS n FROM quoted)),
  hits AS (SELECT document_id // 10 AS run, chunk_id, content FROM chunks WHERE document_id % 10 <> 4)"""


def statutes(spark, d) -> DataFrame:
    """Texts as statutes: a numbered heading before every fifth line or so, sub-provisions
    between, and a chapter before some sections."""
    docs = table(spark, d, "documents")

    def line(x, i):
        at = (i * 7 + F.col("doc_id")) % 5
        section = F.concat(F.when((i * 7 + F.col("doc_id")) % 15 == 0, F.concat(F.lit("CHAPTER "), i + 1, F.lit("\n"))).otherwise(""), (i + 1).cast("string"), F.lit(". "), x)
        return F.when(at == 0, section).when(at == 2, F.concat(F.lit("("), i + 1, F.lit(") "), x)).otherwise(x)

    return docs.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


def judgments(spark, d) -> DataFrame:
    """Texts with references: sentences that cite stand after every third line."""
    docs = table(spark, d, "documents")
    said = F.array(*[F.lit(x) for x in CITING])
    line = lambda x, i: F.concat(x, F.when((i + F.col("doc_id")) % 3 == 0, F.concat(F.lit(" "), F.element_at(said, ((i + F.col("doc_id")) % len(CITING) + 1).cast("int")))).otherwise(""))
    return docs.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


CITING = [
    "Reference is made to [1962] 3 S.C. R. 87 and AIR 1949 SC 512.", "(1988) 4 SCC 75 leads elsewhere.", "See Harrow vs Benton on this point.",
    "For the Respondent vs The Petitioner nothing was filed.", "So too Quillon Timber Ltd. vs Province of Oriel was read.", "Petition No. 41 of 1967 of the Oriel High Court.", "None of this cites anything.",
]
#: The cases among them, as they stand there and by identity.
CITED = {"See Harrow vs Benton": "CASE-harrow-v-benton", "Quillon Timber Ltd. vs Province of Oriel": "CASE-quillon timber-v-oriel"}
JUDGMENTS = f"""judgments AS (SELECT doc_id, list_aggregate(list_transform(string_split(text, chr(10)), lambda x, i: x || CASE WHEN (i - 1 + doc_id) % 3 = 0
  THEN ' ' || ([{", ".join("'" + x + "'" for x in CITING)}])[(i - 1 + doc_id) % {len(CITING)} + 1] ELSE '' END), 'string_agg', chr(10)) AS text FROM documents)"""


def rulings(docs: DataFrame, n_docs: int) -> DataFrame:
    """(doc_id, source_ref, text): texts that are known by a reporter reference, and cite
    that of another one in a last line; every fifth cites one that nobody has."""
    ref = lambda k: (F.floor(k / 10_000) % 90 + 10, k % 10_000)
    volume, page = ref(F.col("doc_id"))
    to_volume, to_page = ref((F.col("doc_id") * 7 + 3) % n_docs)
    year = F.when(F.col("doc_id") % 5 == 0, "1977").otherwise("1988")
    cited = F.concat(F.lit("\nCompare ("), year, F.lit(") "), to_volume, F.lit(" SCC "), to_page, F.lit("."))
    return docs.select("doc_id", F.concat(F.lit("SCC-1988-"), volume, F.lit("-"), page).alias("source_ref"), F.concat("text", cited).alias("text"))


RULINGS = """rulings AS (SELECT doc_id, 'SCC-1988-' || (doc_id // 10000 % 90 + 10) || '-' || (doc_id % 10000) AS source_ref,
  text || chr(10) || 'Compare (' || CASE WHEN doc_id % 5 = 0 THEN '1977' ELSE '1988' END || ') ' || (k // 10000 % 90 + 10) || ' SCC ' || (k % 10000) || '.' AS text,
  'SCC-' || CASE WHEN doc_id % 5 = 0 THEN '1977' ELSE '1988' END || '-' || (k // 10000 % 90 + 10) || '-' || (k % 10000) AS target_ref
  FROM (SELECT *, (doc_id * 7 + 3) % (SELECT count(*) FROM documents) AS k FROM documents))"""


def trace_events(events: DataFrame) -> DataFrame:
    """(run, seq, node, status, at: microseconds): a user's day is a run. Each event is a
    node that starts and, but for every eleventh, completes, fails or tries again; every
    fifth ends the run well, every fourteenth with an error. ``events`` may be a stream,
    without the column ``attempt``."""
    k, us = F.col("event_id"), F.unix_micros(F.col("ts").cast("timestamp"))
    over = us + F.round(F.col("value") * 1000).cast("long")
    row = lambda i, node, status, at: F.struct((k * 3 + i).alias("seq"), node.alias("node"), status.alias("status"), at.alias("at"))
    rows = F.array(
        row(0, F.col("event_type"), F.lit("started"), us),
        F.when(k % 11 != 0, row(1, F.col("event_type"), F.when(k % 7 == 0, "failed").when(k % 13 == 0, "retrying").otherwise("completed"), over)),
        F.when((k % 5 == 0) | (k % 14 == 0), row(2, F.lit(None).cast("string"), F.when(k % 14 == 0, "error").otherwise("ok"), over)),
    )
    run = F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd"))
    own = [c for c in ("attempt",) if c in events.columns]
    return events.select(run.alias("run"), *own, F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("x")).select("run", *own, "x.*")


def attempts(events: DataFrame) -> DataFrame:
    """Events with the number of times the run has been at the node by then."""
    w = Window.partitionBy("user_id", F.to_date("ts"), "event_type").orderBy("event_id")
    return events.withColumn("attempt", F.row_number().over(w))


TRACE_EVENTS = """trace_events AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS run, attempt, x.* FROM (SELECT *, unnest(list_filter([
  {'seq': event_id * 3, 'node': event_type, 'status': 'started', 'at': us},
  CASE WHEN event_id % 11 <> 0 THEN {'seq': event_id * 3 + 1, 'node': event_type, 'status': CASE WHEN event_id % 7 = 0 THEN 'failed' WHEN event_id % 13 = 0 THEN 'retrying' ELSE 'completed' END, 'at': us + round(value * 1000)::BIGINT} END,
  CASE WHEN event_id % 5 = 0 OR event_id % 14 = 0 THEN {'seq': event_id * 3 + 2, 'node': NULL, 'status': CASE WHEN event_id % 14 = 0 THEN 'error' ELSE 'ok' END, 'at': us + round(value * 1000)::BIGINT} END
  ], lambda x: x IS NOT NULL)) AS x FROM (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, ts::DATE, event_type ORDER BY event_id) AS attempt FROM events)))"""


def traces(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("run"), "event_id", F.col("event_type").alias("node"), "ts", (F.col("event_id") % 7 == 0).alias("failed"))


TRACES = "traces AS (SELECT user_id AS run, event_id, event_type AS node, ts, event_id % 7 = 0 AS failed FROM events)"

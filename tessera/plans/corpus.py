"""Sources, point reads, text preparation, identity and embedding flow."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.operators import admission, embedding
from tessera.operators import corpus as c
from tessera.sources import views as v
from tessera.sources.store import folder

from .registry import query

_STRIP = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_COLLAPSE = "trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


@query("SELECT doc_id, length(text) AS n FROM documents WHERE length(text) BETWEEN 40 AND 2000")
def scan_parquet_corpus(spark, d):
    return v.table(spark, d, "documents").select("doc_id", F.length("text").alias("n")).where("n between 40 and 2000")


@query(f"SELECT 'docs#' || (row_number() OVER (ORDER BY doc_id) - 1) AS source_ref, doc_id FROM documents WHERE length({_STRIP.format(c='text')}) >= 1000")
def judgment_batches(spark, d):
    long = v.table(spark, d, "documents").where(F.length(t.strip(F.col("text"))) >= 1000).select("doc_id")
    # positions by ranges of id: counts per range, then numbers inside it, so no single task orders all
    # a fixed number of ranges, which adaptive execution leaves alone, so both branches cut alike
    ranged = long.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").withColumn("part", F.spark_partition_id())
    size = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = size.alias("a").join(size.alias("b"), F.expr("b.part < a.part"), "left").groupBy("a.part").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    own = ranged.withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy("doc_id")) - 1).join(F.broadcast(before), "part")
    return own.select(F.concat(F.lit("docs#"), (F.col("before") + F.col("i")).cast("string")).alias("source_ref"), "doc_id")


@query("""WITH f AS (SELECT page_id, page_id % 5 <> 0 AS pdf, trim(regexp_replace(html, '<[^>]*>', '', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM pages WHERE html IS NOT NULL)
  SELECT page_id, CASE WHEN NOT pdf THEN 'wrong_type' WHEN length(t) < 200 THEN 'too_little_text' ELSE 'admitted' END AS verdict, CASE WHEN pdf AND length(t) >= 200 THEN length(t) END AS chars FROM f""")
def binary_admission(spark, d):
    """Pages as files, most of them with the first bytes of the type that is asked for, read
    as files, judged by what is in them and parted into admitted ones and a quarantine."""
    at = folder(spark, "uploads")
    html = F.concat(F.when(F.col("page_id") % 5 != 0, "%PDF").otherwise(""), "html")
    v.table(spark, d, "pages").where("html is not null").select("page_id", html.alias("value")).repartition("page_id").write.partitionBy("page_id").text(f"{at}/files")
    good, bad = admission.keep(admission.admit(admission.files(spark, f"{at}/files")), f"{at}/kept")
    page = F.regexp_extract("path", r"page_id=(\d+)", 1).cast("long").alias("page_id")
    return good.select(page, "verdict", F.length("text").alias("chars")).unionByName(bad.select(page, "verdict", F.lit(None).cast("int").alias("chars")))


_LINKS = "list_filter(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1), lambda x: NOT contains(x, '#'))"


@query(f"SELECT page_id, {_LINKS}[1] AS link, coalesce(len(list_distinct({_LINKS})), 0) AS n, CASE WHEN coalesce(len({_LINKS}), 0) = 0 THEN 'no link' END AS error FROM pages")
def pick_links(spark, d):
    """The first link of each page that isn't excluded; a page without one says so."""
    links = F.coalesce(F.filter(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)), lambda x: ~F.contains(x, F.lit("#"))), F.array().cast("array<string>"))
    return v.table(spark, d, "pages").select("page_id", F.try_element_at(links, F.lit(1)).alias("link"), F.size(links).cast("long").alias("n"), F.when(F.size(links) == 0, "no link").alias("error"))


#: Sources with their priorities: a static dimension.
REGISTRY = [(f"src{i}", f"Source {i}", i % 4 + 1) for i in range(12)]


@query(f"""WITH r(key, title, priority) AS (VALUES {", ".join(map(str, REGISTRY))}) SELECT key, title, priority, count(doc_id) AS n FROM r LEFT JOIN documents ON source = key WHERE priority <= 2 GROUP BY ALL ORDER BY priority, key""")
def statute_registry(spark, d):
    """Registered sources up to a priority, with how many documents there are of each."""
    r = spark.createDataFrame(REGISTRY, "key string, title string, priority int").where("priority <= 2")
    n = v.table(spark, d, "documents").groupBy(F.col("source").alias("key")).agg(F.count("*").alias("n"))
    return r.join(n, "key", "left").select("key", "title", "priority", F.coalesce("n", F.lit(0)).alias("n")).orderBy("priority", "key")


@query("SELECT doc_id, lang FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 10")
def list_documents(spark, d):
    return v.table(spark, d, "documents").where("lang = 'en'").orderBy(F.desc("n_chars"), "doc_id").offset(10).limit(20).select("doc_id", "lang")


@query(f"WITH {v.CHUNKS} SELECT doc_id, count(chunk_id) AS n_chunks FROM documents LEFT JOIN chunks ON document_id = doc_id GROUP BY doc_id")
def document_page_with_counts(spark, d):
    n = v.chunks(spark, d).groupBy(F.col("document_id").alias("doc_id")).agg(F.count("*").alias("n"))
    return v.table(spark, d, "documents").select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_chunks"))


@query("SELECT doc_id, source, n_chars FROM documents WHERE source = 'src1' AND doc_id = 21")
def get_by_source_ref(spark, d):
    return v.table(spark, d, "documents").where("source = 'src1' and doc_id = 21").select("doc_id", "source", "n_chars")


@query(f"WITH {v.CHUNKS} SELECT chunk_id, content FROM chunks WHERE document_id IN (SELECT item_id FROM benchmark) AND ordinal = 0")
def get_many_chunks(spark, d):
    ids = v.table(spark, d, "benchmark").select(F.col("item_id").alias("document_id"))
    return v.chunks(spark, d).where("ordinal = 0").join(ids, "document_id", "left_semi").select("chunk_id", "content")


@query(f"WITH {v.CHUNKS} SELECT chunk_id, ordinal FROM chunks WHERE document_id = 7 ORDER BY ordinal")
def chunks_of_document(spark, d):
    return v.chunks(spark, d).where("document_id = 7").orderBy("ordinal").select("chunk_id", "ordinal")


@query(f"WITH {v.CHUNKS} SELECT chunk_id, left(sha256(text), 12) AS short_hash FROM chunks JOIN documents ON doc_id = document_id")
def chunk_provenance(spark, d):
    h = v.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.substring(F.sha2("text", 256), 1, 12).alias("short_hash"))
    return v.chunks(spark, d).select("chunk_id", "document_id").join(h, "document_id").select("chunk_id", "short_hash")


@query(f"WITH {v.EMBEDDED} SELECT chunk_id FROM embedded WHERE embedding IS NULL")
def pending_embedding(spark, d):
    return v.embedded(spark, d).where("embedding is null").select("chunk_id")


@query(f"WITH {v.CHUNKS} SELECT chunk_id, CASE WHEN ordinal % 2 = 0 THEN title || ', Line ' || ordinal ELSE title END AS citation FROM chunks")
def citation_label(spark, d):
    label = F.when(F.col("ordinal") % 2 == 0, F.concat(F.lit("Line "), "ordinal"))
    return v.chunks(spark, d).select("chunk_id", F.concat_ws(", ", "title", label).alias("citation"))


@query("""SELECT page_id, coalesce(nullif(left(trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '([^/\\\\]*)$', 1), '(?i)\\.pdf$', ''), '[\\x00-\\x1f\\x7f]', '', 'g'), '\\s+', ' ', 'g')), 200), ''), 'Untitled document') AS title FROM pages""")
def safe_title(spark, d):
    return v.table(spark, d, "pages").select("page_id", t.safe_title(F.col("url")).alias("title"))


@query("SELECT doc_id, nullif(regexp_extract('Section ' || (doc_id % 40) || CASE WHEN doc_id % 3 = 0 THEN '(2)' ELSE '' END, '^(Section [0-9]+[A-Z]?)', 1), '') AS section FROM documents")
def section_of(spark, d):
    label = F.concat(F.lit("Section "), F.col("doc_id") % 40, F.when(F.col("doc_id") % 3 == 0, "(2)").otherwise(""))
    return v.table(spark, d, "documents").select("doc_id", t.section_of(label).alias("section"))


_NORM = "text"
for _p, _to in t.REPAIRS:
    _p = _p.replace("(?U)", "").replace("(\\w)-\\n(\\w)", "([\\pL\\pN_])-\\n([\\pL\\pN_])")
    _NORM = f"regexp_replace({_NORM}, '{_p}', '{_to.replace('$', chr(92))}', 'g')" if chr(10) not in _to else f"regexp_replace({_NORM}, '{_p}', {' || '.join(['chr(10)'] * len(_to))}, 'g')"
NORM = _STRIP.format(c=_NORM)


@query(f"SELECT doc_id, md5({NORM}) AS h, length({NORM}) AS n FROM documents")
def normalise_document(spark, d):
    n = v.table(spark, d, "documents").select("doc_id", t.normalise_document(F.col("text")).alias("x"))
    return n.select("doc_id", F.md5("x").alias("h"), F.length("x").cast("long").alias("n"))


@query("SELECT doc_id, greatest(1, length(text) // 4)::INT AS tokens FROM documents")
def token_estimate(spark, d):
    return v.table(spark, d, "documents").select("doc_id", t.token_estimate(F.col("text")).alias("tokens"))


@query(f"""WITH {v.CHUNKS}, x AS (SELECT *, length(regexp_replace(content, '[^\\p{{L}}]', '', 'g')) AS n, count(*) OVER (PARTITION BY document_id) AS spans FROM chunks)
  SELECT chunk_id FROM x WHERE spans = 1 OR (n >= 80 AND n >= 0.45 * length(content))""")
def substance_filter(spark, d):
    c = v.chunks(spark, d).withColumn("n", t.letters(F.col("content"))).withColumn("spans", F.count("*").over(Window.partitionBy("document_id")))
    return c.where((F.col("spans") == 1) | ((F.col("n") >= 80) & (F.col("n") >= 0.45 * F.length("content")))).select("chunk_id")


@query(f"WITH {v.CHUNKS} SELECT chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY ordinal) - 1 AS position FROM chunks")
def assign_ordinal(spark, d):
    w = Window.partitionBy("document_id").orderBy("ordinal")
    return v.chunks(spark, d).select("chunk_id", (F.row_number().over(w) - 1).cast("long").alias("position"))


@query(f"SELECT doc_id, {_COLLAPSE.format(c='text')} AS text FROM documents WHERE length({_COLLAPSE.format(c='text')}) BETWEEN 40 AND 2000")
def collapse_whitespace(spark, d):
    return v.table(spark, d, "documents").select("doc_id", t.collapse_whitespace(F.col("text")).alias("text")).where("length(text) between 40 and 2000")


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, d):
    return v.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("SELECT doc_id, left(sha256('model-1' || chr(31) || text), 32) AS key FROM documents")
def content_key(spark, d):
    return v.table(spark, d, "documents").select("doc_id", t.content_key(F.lit("model-1"), F.col("text")).alias("key"))


@query("SELECT page_id, 'upload-' || left(sha256(html), 16) AS ref FROM pages")
def upload_ref(spark, d):
    return v.table(spark, d, "pages").select("page_id", F.concat(F.lit("upload-"), F.substring(F.sha2(F.col("html").cast("binary"), 256), 1, 16)).alias("ref"))


_CHANGES = """changes AS (SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN 'new' WHEN doc_id % 4 = 0 THEN 'changed' ELSE 'unchanged' END AS change FROM documents)"""


def _documents(spark, d):
    """Documents as they come in."""
    docs = v.table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.lit("judgment").alias("kind"), F.concat(F.lit("docs#"), "doc_id").alias("source_ref"), F.sha2("text", 256).alias("content_hash"))


def _stored(spark, d):
    """The stored corpus lacks every tenth document and has an older text of every fourth."""
    own = _documents(spark, d).where("id % 10 <> 9")
    return own.withColumns({"content_hash": F.when(F.col("id") % 4 == 0, "old").otherwise(F.col("content_hash")), "created_at": F.lit(1), "updated_at": F.lit(1)})


@query(f"WITH {_CHANGES} SELECT * FROM changes")
def detect_changes(spark, d):
    return c.detect_changes(_documents(spark, d), _stored(spark, d)).select(F.col("id").alias("doc_id"), "change")


@query(f"WITH {_CHANGES} SELECT doc_id, sha256(text) AS hash, CASE change WHEN 'new' THEN 2 ELSE 1 END AS created, CASE change WHEN 'unchanged' THEN 1 ELSE 2 END AS updated FROM changes JOIN documents USING (doc_id)")
def upsert_documents(spark, d):
    """The corpus after the incoming rows, which come twice."""
    twice = _documents(spark, d).unionByName(_documents(spark, d))
    return c.upsert_documents(twice, _stored(spark, d), 2).select(F.col("id").alias("doc_id"), F.col("content_hash").alias("hash"), F.col("created_at").alias("created"), F.col("updated_at").alias("updated"))


@query(f"""WITH {v.CHUNKS}, {_CHANGES} SELECT chunk_id, CASE WHEN change = 'unchanged' THEN 0 ELSE 1 END AS fresh FROM chunks JOIN changes ON doc_id = document_id
  UNION ALL SELECT chunk_id || '-old', 0 FROM chunks JOIN changes ON doc_id = document_id WHERE change = 'unchanged' AND ordinal % 2 = 0""")
def replace_chunks(spark, d):
    """The stored chunks have stale ones besides (every second, with another id): those of
    changed documents go, those of unchanged ones stay."""
    now = v.chunks(spark, d).select("chunk_id", "document_id", F.lit(0).alias("fresh"), "ordinal")
    stored = now.unionByName(now.where("ordinal % 2 = 0").withColumn("chunk_id", F.concat("chunk_id", F.lit("-old")))).drop("ordinal")
    touched = detect_changes(spark, d).where("change <> 'unchanged'").select(F.col("doc_id").alias("document_id"))
    fresh = now.join(touched, "document_id", "left_semi").select("chunk_id", "document_id", F.lit(1).alias("fresh"))
    return c.replace_chunks(stored, touched, fresh).select("chunk_id", "fresh")


@query(f"""WITH {v.CHUNKS}, {v.EDGES} SELECT 'edge' AS what, source_id || ' ' || target_ref AS name, CASE WHEN target_ref LIKE 'CASE-%' AND substr(target_ref, 6)::BIGINT % 10 <> 0 THEN substr(target_ref, 6)::BIGINT END AS target_id FROM edges WHERE source_id % 10 <> 0
  UNION ALL SELECT 'chunk', chunk_id, NULL FROM chunks WHERE document_id % 10 <> 0 UNION ALL SELECT 'document', doc_id::VARCHAR, NULL FROM documents WHERE doc_id % 10 <> 0""")
def delete_document(spark, d):
    """What is left when every tenth document is deleted, and the targets of the edges."""
    docs = _documents(spark, d)
    e = v.edges(spark, d).withColumn("target_id", F.when(F.col("target_ref").startswith("CASE-"), F.substr("target_ref", F.lit(6)).try_cast("long")))
    docs, chunks, e = c.delete_documents(docs, v.chunks(spark, d), e, docs.where("id % 10 = 0"))
    row = lambda df, what, name, target=F.lit(None).cast("long"): df.select(F.lit(what).alias("what"), name.alias("name"), target.alias("target_id"))
    left = row(e, "edge", F.concat_ws(" ", "source_id", "target_ref"), F.col("target_id"))
    return left.unionByName(row(chunks, "chunk", F.col("chunk_id"))).unionByName(row(docs, "document", F.col("id").cast("string")))


@query(f"""WITH {v.EMBEDDED}, {v.EDGES}, kept AS (SELECT doc_id, CASE WHEN doc_id % 100 = 1 THEN 'same' ELSE doc_id::VARCHAR END AS ref FROM documents WHERE doc_id % 50 <> 0)
  SELECT 'unique_document' AS rule, count(*) AS violations FROM (SELECT 1 FROM kept GROUP BY ref HAVING count(*) > 1)
  UNION ALL SELECT 'unique_chunk', count(*) FROM (SELECT 1 FROM chunks GROUP BY document_id, ordinal HAVING count(*) > 1)
  UNION ALL SELECT 'unique_edge', count(*) FROM (SELECT 1 FROM edges GROUP BY source_id, target_ref HAVING count(*) > 1)
  UNION ALL SELECT 'token_count', count(*) FROM chunks WHERE length(content) // 4 < 3
  UNION ALL SELECT 'self_edge', count(*) FROM edges WHERE target_ref = 'CASE-' || source_id
  UNION ALL SELECT 'dimension', count(*) FROM embedded WHERE len(embedding) <> 64 OR (embedding IS NOT NULL AND document_id % 7 = 0)
  UNION ALL SELECT 'orphan_chunk', count(*) FROM chunks WHERE document_id NOT IN (SELECT doc_id FROM kept)""")
def constraint_report(spark, d):
    """Over tables that break most rules: references given twice, documents that are missing,
    counts below zero, vectors too short."""
    docs = _documents(spark, d).where("id % 50 <> 0").withColumn("source_ref", F.when(F.col("id") % 100 == 1, "same").otherwise(F.col("source_ref")))
    short = F.when(F.col("document_id") % 7 == 0, F.slice("embedding", 1, 8)).otherwise(F.col("embedding"))
    chunks = v.embedded(spark, d).withColumns({"token_count": F.floor(F.length("content") / 4) - 3, "embedding": short})
    e = v.edges(spark, d).withColumn("target_id", F.when(F.col("target_ref").startswith("CASE-"), F.substr("target_ref", F.lit(6)).try_cast("long")))
    return c.constraint_report(docs, chunks, e, 64)


@query(f"WITH {v.EMBEDDED} SELECT document_id, count(*) AS written, count(embedding) AS embedded, count(*) - count(embedding) AS skipped FROM embedded GROUP BY document_id")
def ingest_summary(spark, d):
    has = F.col("embedding").isNotNull()
    return v.embedded(spark, d).groupBy("document_id").agg(F.count("*").alias("written"), F.count_if(has).alias("embedded"), F.count_if(~has).alias("skipped"))


@query("SELECT key, count(*) AS wanted, bool_or(doc_id % 3 = 0) AS cached FROM (SELECT doc_id, left(sha256('m' || chr(31) || text), 32) AS key FROM documents) GROUP BY key")
def embed_plan(spark, d):
    """Each different text once, and whether the cache (every third document's) has it."""
    keyed = v.table(spark, d, "documents").select("doc_id", t.content_key(F.lit("m"), F.col("text")).alias("key"))
    cache = keyed.where("doc_id % 3 = 0").select("key").distinct().withColumn("hit", F.lit(True))
    return keyed.groupBy("key").agg(F.count("*").alias("wanted")).join(cache, "key", "left").select("key", "wanted", F.coalesce("hit", F.lit(False)).alias("cached"))


@query("SELECT doc_id, sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0) AS cached FROM documents")
def predict_cached(spark, d):
    keyed = v.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    cache = keyed.where("doc_id % 3 = 0").select("key").distinct().withColumn("hit", F.lit(True))
    return keyed.join(cache, "key", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("cached"))


@query("SELECT label, list(m ORDER BY i) AS mean FROM (SELECT label, i, round(avg(x), 6) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i) GROUP BY label")
def mean_pool(spark, d):
    e = v.table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    m = e.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m"))
    return m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s.m).alias("mean"))


@query("SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 4) + 0.0) AS unit FROM embeddings")
def l2_normalise(spark, d):
    e = v.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x))
    return e.withColumn("n", norm).select("vec_id", F.transform("e", lambda x: F.round(x / F.col("n"), 4)).alias("unit"))


@query(f"""WITH {v.EMBEDDED}, {v.hashed("fresh", "chunk_id", "content", "chunks", 16)} SELECT chunk_id, list_transform(CASE WHEN ordinal % 2 = 1 THEN fresh.embedding ELSE embedded.embedding END, lambda x: round(x::DOUBLE, 4) + 0.0) AS embedding
  FROM embedded LEFT JOIN fresh USING (chunk_id)""")
def apply_embeddings(spark, d):
    """New vectors of every second line in the chunks' table."""
    e = v.embedded(spark, d).select("chunk_id", "ordinal", "content", "embedding")
    new = embedding.embed_batches(e.where("ordinal % 2 = 1").select("chunk_id", "content"), embedding.HashEncoder())
    return c.apply_embeddings(e, new).select("chunk_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 4)).alias("embedding"))

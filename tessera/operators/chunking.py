"""Structural chunking: sections, chapters, sub-provisions and windows of sentences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import is_substantive, normalise_document, strip, token_estimate

# The headings of statutes. Unicode classes; only \n ends a line.
FLAGS = "(?Umd)"
SECTION = r"(?i)^\s*(?:Section\s+)?(\d+[A-Z]?)\.\s+(?=\S)"
CHAPTER = r"^\s*(CHAPTER\s+(?:[IVXLC]+|\d+)\b[^\n]*)"
SUBSECTION = r"^\s*\((\d+|[a-z]{1,3}|[ivxl]{1,6})\)\s+"
SENTENCE_END = r"(?<=[.;:])\s+(?=[A-Z(])"

MARK = "\ue000"  # put before each heading, then cut at; in a text it becomes a space


def cut_before(text: Column, pattern: str) -> Column:
    """The text cut before each match: what comes before the first, then one part each."""
    return F.split(F.regexp_replace(text, FLAGS + pattern, MARK + "$0"), MARK)


def split_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_tokens: int = 24) -> DataFrame:
    """(doc_id, pos, label, chapter, content): one row per numbered section of a normalised
    text, each with the latest chapter heading before it. The text before the first
    heading is the preamble, kept from ``min_tokens`` on; a text without headings is
    one row with no label. Null and empty texts give no rows."""
    parts = docs.select(F.col(id_col).alias("doc_id"), cut_before(F.translate(text_col, MARK, " "), SECTION).alias("parts"))
    p = parts.select("doc_id", (F.size("parts") == 1).alias("plain"), F.posexplode("parts").alias("pos", "part"))
    head = F.regexp_extract_all("part", F.lit(FLAGS + CHAPTER), 1)
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("chapter", F.last(strip(F.try_element_at(head, F.lit(-1))), ignorenulls=True).over(before))
    number = F.regexp_extract("part", FLAGS + SECTION, 1)
    label = F.when(F.col("pos") > 0, F.concat(F.lit("Section "), number)).when(~F.col("plain"), F.lit("Preamble"))
    p = p.select("doc_id", "pos", label.alias("label"), "chapter", strip(F.col("part")).alias("content"))
    return p.where((F.col("content") != "") & ((F.coalesce("label", F.lit("")) != "Preamble") | (token_estimate(F.col("content")) >= min_tokens)))


def split_subsections(label: Column, content: Column) -> Column:
    """Array of (label, content): the sub-provisions of a section, each with the section's
    opening words; the section itself where it has fewer than two."""
    parts = cut_before(content, SUBSECTION)
    head = strip(F.element_at(parts, 1))
    number = lambda x: F.regexp_extract(x, FLAGS + SUBSECTION, 1)
    one = lambda x: F.struct(F.concat(label, F.lit("("), number(x), F.lit(")")).alias("label"), F.concat_ws("\n", F.nullif(head, F.lit("")), strip(x)).alias("content"))
    return F.when(F.size(parts) < 3, F.array(F.struct(label.alias("label"), content.alias("content")))).otherwise(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), one))


def spans(size: list[int], most: int, overlap: int) -> list[tuple[int, int]]:
    """(first, end) of greedy windows of at most ``most`` tokens over sentences of these sizes;
    each begins with the sentences at the end of the one before that together have at most
    ``overlap`` tokens."""
    out, first, total = [], 0, 0  # the window now open, and its tokens
    for i, n in enumerate(size):
        if i > first and total + n > most:
            out.append((first, i))
            before, first, total = first, i, 0
            while first > before and total + size[first - 1] <= overlap:
                first -= 1
                total += size[first]
        total += n
    return [*out, (first, len(size))] if size else out


def windows(sentences: list[str], most: int, overlap: int) -> list[str]:
    """The sentences of each of ``spans`` as one text."""
    return [" ".join(sentences[a:z]).strip() for a, z in spans([max(1, len(s) // 4) for s in sentences], most, overlap)]


def pack_sentences(content: Column, max_tokens: int = 512, overlap_tokens: int = 48) -> Column:
    """Array of windows of the sentences of ``content``, as ``windows`` makes them. The fold over
    sentences that carries a tail along is a vectorised Arrow function; it sees their sizes
    only, so that no text goes through a Python worker."""

    @F.pandas_udf("array<struct<first: int, size: int>>")
    def pack(sizes: pd.Series) -> pd.Series:
        return sizes.map(lambda s: None if s is None else [{"first": a + 1, "size": z - a} for a, z in spans(list(map(int, s)), max_tokens, overlap_tokens)])

    sentences = F.split(content, "(?Ud)" + SENTENCE_END)
    edge = "[\\s\x1c-\x1f]+"  # what Python's strip takes for white space
    text = lambda w: F.regexp_replace(F.array_join(F.slice(sentences, w["first"], w["size"]), " "), f"(?U)^{edge}|{edge}\\z", "")
    return F.transform(pack(F.transform(sentences, token_estimate)), text)


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 512, min_tokens: int = 24, overlap_tokens: int = 48) -> DataFrame:
    """(doc_id, ordinal, label, chapter, content, token_count): the chunks of each document.

    Texts are normalised and cut into sections; a section of over ``max_tokens`` is cut
    at its sub-provisions, and one that is still longer into overlapping windows
    ("[part n]"). Chunks under ``min_tokens`` or with little prose are dropped where
    the document has others. Ordinals count from 0. Documents are shuffled once, by id.

    Null or blank texts give no rows; ids must be unique and not null.
    """
    long = lambda c: token_estimate(c) > max_tokens
    norm = docs.select(F.col(id_col).alias("doc_id"), normalise_document(F.col(text_col)).alias("text")).where("text <> ''")
    s = split_sections(norm)
    whole = F.array(F.struct("label", "content"))
    s = s.select("doc_id", "pos", "chapter", F.posexplode(F.when(long(F.col("content")), split_subsections(F.col("label"), F.col("content"))).otherwise(whole)).alias("sub", "x"))
    s = s.select("doc_id", "pos", "sub", "chapter", "x.*").where("content <> ''")
    # of what isn't too long, a Python worker sees nulls
    parts = F.coalesce(pack_sentences(F.when(long(F.col("content")), F.col("content")), max_tokens, overlap_tokens), F.array("content"))
    s = s.withColumn("long", long(F.col("content"))).select("doc_id", "pos", "sub", "chapter", "label", "long", F.posexplode(parts).alias("part", "content"))
    label = F.when(F.col("long"), F.concat("label", F.lit(" [part "), F.col("part") + 1, F.lit("]"))).otherwise(F.col("label"))
    s = s.withColumn("label", label).withColumn("content", strip(F.col("content")))
    s = s.withColumn("spans", F.count("*").over(Window.partitionBy("doc_id"))).withColumn("token_count", token_estimate(F.col("content")))
    s = s.where((F.col("spans") == 1) | ((F.col("token_count") >= min_tokens) & is_substantive(F.col("content"))))
    order = Window.partitionBy("doc_id").orderBy("pos", "sub", "part")
    return s.select("doc_id", (F.row_number().over(order) - 1).alias("ordinal"), "label", "chapter", "content", "token_count")

"""Exact deduplication by 128-bit content hash with a byte comparison inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, ascii_lower, cut, table


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest=md5_128, row_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row
    with the smallest id stays (``keep="largest"``: the largest).

    Rows are grouped by ``digest`` (128 bits) *and* bytes, combined before the
    shuffle, so a group of any number of copies travels as one row per task. Where
    a digest has a single text, which is all but always so, the rows only meet its
    small per-digest row; where texts collide, the rows of that digest alone are
    matched again by their bytes. Row joins are plain equi joins on the digest,
    whose large partitions Spark splits.

    A null text counts as empty. A null id never is ``keep_id`` unless the whole
    group has null ids; then ``keep_id`` is null and its rows are kept. Rows that
    repeat id and text get the same decision, unless ``row_col`` names a column that
    numbers the rows: then one row of each group is kept, of equal ids the one with
    the smallest number, and the column is returned too. No rows in, no rows out;
    other columns are unread.
    """
    best = F.min if keep == "smallest" else F.max
    number = F.lit(0).cast("long") if row_col is None else F.col(row_col).cast("long")
    if keep != "smallest":
        number = -number
    lacks = F.lit(keep == "smallest") == F.col("doc_id").isNull()  # sorts null ids last, or first for the largest
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), number.alias("row"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    rows = rows.withColumn("h", digest(F.col("norm")))
    # as longs and booleans, which hash aggregates can update in place, where rows aren't numbered
    first = best("doc_id").alias("first") if row_col is None else best(F.struct(lacks.alias("lacks"), "doc_id", "row")).alias("first")
    again = best("first").alias("first")
    texts = rows.groupBy("h", "norm").agg(first, F.count("*").alias("group_size"))
    groups = cut(texts.groupBy("h").agg(F.count("*").alias("n_texts"), again, F.sum("group_size").alias("group_size")))
    slim = rows.select("doc_id", "row", "h", F.sha2("norm", 256).alias("text_sha256"))
    out = slim.join(groups.where("n_texts = 1").drop("n_texts"), "h").drop("h")
    if groups.where("n_texts > 1").limit(1).count():
        clash = groups.where("n_texts > 1").select("h")
        own = rows.join(clash, "h", "left_semi").groupBy("h", "norm").agg(first, F.count("*").alias("group_size"))
        out = out.unionByName(
            rows.join(clash, "h", "left_semi").join(own, ["h", "norm"]).select("doc_id", "row", F.sha2("norm", 256).alias("text_sha256"), "first", "group_size")
        )
    keep_id = F.col("first") if row_col is None else F.col("first.doc_id")
    kept = F.col("doc_id").eqNullSafe(keep_id) if row_col is None else F.col("row") == F.col("first.row")
    number = [] if row_col is None else [(F.col("row") if keep == "smallest" else -F.col("row")).alias(row_col)]
    return out.select("doc_id", keep_id.alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256", *number)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


OP1_SQL = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS norm FROM documents)
WINDOW w AS (PARTITION BY norm)
"""

"""Helpers that the text operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col):
    """A-Z to a-z and nothing else (``lower`` would fold all of Unicode)."""
    return F.translate(col, UPPER, UPPER.lower())


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only where the session names none (local tests) a temporary one is set.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = tempfile.mkdtemp(prefix="spark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, with no lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: smaller than a checkpoint
    and pruned by column when read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame, rows: int, each: int = 1 << 17) -> DataFrame:
    """``df`` of at most ``rows`` rows in no more partitions than rows of that size need,
    ``each`` in one, and at least one for each core. What is written next has as many files,
    and for each an executor starts processes, where the file system is a local one."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def most_frequent(rows: DataFrame, most: int, count: str = "n") -> DataFrame:
    """The rows with the largest counts, at most ``most``: all from a cut-off on, which is
    exact to nine bits. A histogram of the counts, of at most 256 rows for each power
    of two, tells it, so the driver gets nothing that grows; ``rows`` is read twice."""
    low = F.greatest(F.lit(0), F.length(F.bin(count)) - 9)
    coarse = F.call_function("shiftleft", F.call_function("shiftright", F.col(count), low), low)
    left, least = most, None
    for r in rows.groupBy(coarse.alias("coarse")).agg(F.count("*").alias("k")).orderBy(F.desc("coarse")).collect():
        if r.k > left:
            break
        left, least = left - r.k, r.coarse
    return rows.where(F.lit(False)) if least is None else rows.where(F.col(count) >= least)

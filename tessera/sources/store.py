"""Tables in the folder that driver and executors share, and several that change together."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one that the session names (a temporary one where it
    names none, as in tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-ckpt-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, at: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` computed once, as the Parquet table ``at``; what was there is replaced."""
    df.write.mode("overwrite").partitionBy(*by).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no folder."""
    p, fs = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """The file is there whole or not at all: it is written beside and renamed."""
    (p, fs), (beside, _) = _at(spark, path), _at(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(beside)
    out.write(bytearray(text.encode()))
    out.close()
    fs.rename(beside, p)


def get_text(spark: SparkSession, path: str) -> str:
    p, fs = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


class Tables:
    """Tables in ``parts`` partitions by a hash of a key, which change in numbered commits.

    A commit writes the partitions it touches beside the old ones, then a manifest that
    says which commit has each partition of each table, and how far each source of
    batches has come. Only the manifest makes it visible, so readers see all tables
    change at once; a commit that is tried again overwrites its own files.
    """

    def __init__(self, spark: SparkSession, at: str, schemas: dict[str, str], parts: int = 16):
        self.spark, self.at, self.schemas, self.parts = spark, at.rstrip("/"), schemas, parts

    def part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def last(self) -> int:
        """The number of the last commit, -1 before the first."""
        return max((int(x.removesuffix(".json")) for x in listed(self.spark, f"{self.at}/commits") if x.endswith(".json")), default=-1)

    def manifest(self, number: int) -> dict[str, dict[str, int]]:
        empty = {t: {} for t in [*self.schemas, "sources"]}
        return empty if number < 0 else json.loads(get_text(self.spark, f"{self.at}/commits/{number}.json"))

    def has(self, source: str, batch: int) -> bool:
        return self.manifest(self.last())["sources"].get(source, -1) >= batch

    def read(self, table: str, parts: list[int] | None = None) -> DataFrame:
        """The table after the last commit, or some of its partitions."""
        held = self.manifest(self.last())[table]
        paths = [f"{self.at}/{table}/commit={n}/part={p}" for p, n in held.items() if parts is None or int(p) in parts]
        kind = f"{self.schemas[table]}, part int"
        if not paths:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).option("basePath", f"{self.at}/{table}").parquet(*paths).drop("commit")

    def commit(self, source: str, batch: int, changed: dict[str, tuple[DataFrame, list[int]]]) -> None:
        """``changed``: of each table the new rows (with ``part``) of the named partitions."""
        last = self.last()
        held, number = self.manifest(last), last + 1
        for table, (rows, parts) in changed.items():
            if not parts:
                continue
            at = f"{self.at}/{table}/commit={number}"
            # a partition is one shuffle partition, so one file
            rows.repartition("part").write.mode("overwrite").partitionBy("part").parquet(at)
            there = {x.removeprefix("part=") for x in listed(self.spark, at) if x.startswith("part=")}
            for p in map(str, parts):
                held[table].pop(p, None)
                if p in there:
                    held[table][p] = number
        held["sources"][source] = batch
        put_text(self.spark, f"{self.at}/commits/{number}.json", json.dumps(held))

"""URL rules by a sort-merge range join over reversed-host keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import UPPER, ascii_lower, stored, table

#: (action, host, path); a rule holds for its host and all subdomains.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def labels(host: Column) -> Column:
    """From the top label down; control characters that keys use are none of a label."""
    return F.reverse(F.split(F.translate(host, "\x01\x02", "\x03\x03"), "\\."))


def host_key(host: Column) -> Column:
    """The labels, each closed by \\x01: a host's subdomains are the keys from its own up to
    the one that ends in \\x02 instead."""
    return F.concat(F.array_join(labels(host), "\x01"), F.lit("\x01"))


def nested(rules: DataFrame) -> DataFrame:
    """(lo, chain): each rule host's key and those of the rule hosts it lies in, itself last.
    As many as it has labels at most, found by a join on keys, so that it doesn't matter
    how many rules share a top label."""
    keys = rules.select(host_key(F.col("host")).alias("lo"), labels(F.col("host")).alias("l")).dropDuplicates(["lo"])
    around = F.transform(F.sequence(F.lit(1), F.size("l")), lambda i: F.concat(F.array_join(F.slice("l", 1, i), "\x01"), F.lit("\x01")))
    up = keys.select("lo", F.explode(around).alias("up")).join(keys.select(F.col("lo").alias("up")), "up")
    return up.groupBy("lo").agg(F.sort_array(F.collect_list("up")).alias("chain"))  # a key sorts before those in its interval


def innermost(urls: DataFrame, chains: DataFrame) -> DataFrame:
    """``urls`` (with ``key``) and ``top``, the key of the innermost rule host that they lie in,
    empty for none.

    Keys of pages and the ends of the rules' intervals are dealt by ranges and swept in
    order. The stack of open intervals is known by its top: where an interval ends, the
    top is the one around it, which ``chains`` tells. What is open where a range begins
    is the top at the end of the ranges before it, one row for each. Pages of one host are
    spread by a hash.
    """
    around = F.coalesce(F.get("chain", F.size("chain") - 2), F.lit(""))
    ends = F.array(F.struct(F.col("lo").alias("key"), F.col("lo").alias("top")), F.struct(F.concat(F.expr("left(lo, length(lo) - 1)"), F.lit("\x02")).alias("key"), around.alias("top")))
    bounds = chains.select(F.inline(ends)).withColumn("page", F.lit(0))
    both = urls.withColumn("page", F.lit(1)).unionByName(bounds, allowMissingColumns=True).withColumn("spread", F.xxhash64("page_id", "host", "path"))
    dealt = stored(both.repartitionByRange("key", "page", "spread").withColumn("part", F.spark_partition_id()))
    end = dealt.groupBy("part").agg(F.max_by("top", F.when(F.col("page") == 0, F.col("key"))).alias("end"))
    begin = end.select("part", F.last("end", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("begin"))
    sweep = Window.partitionBy("part").orderBy("key", "page").rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.withColumn("now", F.last("top", ignorenulls=True).over(sweep)).where("page = 1")
    return swept.join(F.broadcast(begin), "part").select(*urls.columns, F.coalesce("now", "begin", F.lit("")).alias("top"))  # as many rows as ranges


def judge_urls(pages: DataFrame, rules: DataFrame | list | None = None, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    The longest rule that fits decides (of equal ones, block); without one, the
    verdict is ``default`` and ``rule`` is null.

    A sweep over sorted keys finds the innermost rule host of each page (``innermost``).
    It and the rule hosts around it are asked for the page's path, cut to each length that
    their rules' paths have, by an equi-join: no page meets a rule that doesn't fit. So the
    work for a page grows with its labels and with the lengths of paths, not with the
    number of rules.

    A null url, or one without ``://``, has empty host and path and fits no rule. Null ids
    and repeated rows are kept; empty tables give no rows. Rules (action, host, path) with
    a null host or action are left out, a null path fits all; rule hosts are in lower case.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        own = [F.struct(*[F.lit(x).alias(c) for c, x in zip(("action", "host", "path"), r)]) for r in (RULES if rules is None else rules)]
        none = F.array().cast("array<struct<action:string,host:string,path:string>>")
        rules = spark.range(1, numPartitions=1).select(F.inline(F.array(*own) if own else none))
    rules = stored(rules.where("host is not null and action is not null").select("action", "host", F.coalesce("path", F.lit("")).alias("path")).distinct())
    chains = stored(nested(rules))
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host")))
    sizes = rules.select(host_key(F.col("host")).alias("at"), F.length("path").alias("size")).distinct()
    probes = chains.select("lo", F.explode("chain").alias("at")).join(sizes, "at").groupBy(F.col("lo").alias("top")).agg(F.collect_list(F.struct("at", "size")).alias("probes"))
    asked = innermost(urls, chains).drop("key").join(stored(probes), "top", "left").select("row", "page_id", "host", "path", F.explode_outer("probes").alias("p"))
    asked = asked.select("row", "page_id", "host", "path", "p.at", F.when(F.length("path") >= F.col("p.size"), F.expr("left(path, p.size)")).alias("begin"))
    own = rules.select(host_key(F.col("host")).alias("at"), F.col("path").alias("begin"), F.col("host").alias("rule_host"), "action")
    met = asked.join(own, ["at", "begin"], "left")
    fits = (F.col("host") == F.col("rule_host")) | F.endswith("host", F.concat(F.lit("."), "rule_host"))
    rule = F.when(fits, F.struct((F.length("rule_host") + F.length("begin")).alias("n"), "action", F.concat("rule_host", "begin").alias("rule")))
    best = met.groupBy("row", "page_id", "host", "path").agg(F.max(rule).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


OP4_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0), '{UPPER}', '{UPPER.lower()}') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), r(action, rhost, rpath) AS (VALUES {", ".join(str(r) for r in RULES)})
SELECT page_id, host, path, max_by(rhost || rpath, length(rhost) + length(rpath)) AS rule,
       coalesce(max_by(action, length(rhost) + length(rpath)), 'allow') AS verdict
FROM p LEFT JOIN r ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath)
GROUP BY page_id, host, path
"""

"""URL filters: a sort-merge range join of pages and host/path rules.

Canonical key: the host with its labels reversed, a slash, then the path
(``a.example.org/es/x`` -> ``org.example.a//es/x``); no host holds a slash, so its end is known. A rule covers its host and all
subdomains, so a url is looked up under each suffix of its host; under one such
key a rule is a *prefix*, that is an interval of the sorted keys.

The sweep: rules and look-up keys are put into one global sort order (range
partitioning), and each key takes the last rule at or before it. Every rule
carries its stack -- itself and the rules that enclose it, innermost last. If a
rule ``a`` is a prefix of key ``x`` then every key sorted between them starts with
``a`` too, so ``a`` is on the stack of that last rule: popping the entries that are
no prefix of ``x`` leaves exactly the active nested rules, and the top one is the
longest. A rule that is open at a partition's start comes from one row per
partition (bounded by their number).

Pages are reduced to distinct (host, path) before the sort, so a hot url is one
key; distinct urls of a hot host spread over range partitions by their path.

Defined cases: null url or one without ``://`` -> empty host and path, no rule, the
default verdict. Repeated pages each get their row. Only page_id and url are read,
so further columns can't clash. Of equally long rules the one with the longer host
wins; of rules with equal host and path, block wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mercato.llm.common import freeze, read_table

#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
DEFAULT_VERDICT = "allow"
ASCII_UP, ASCII_LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1),
                       ASCII_UP, ASCII_LOW)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def rule_stacks(rules: DataFrame) -> DataFrame:
    """rules(host, path, verdict) -> (key, stack): for each rule key the enclosing
    rules and itself, ordered by length. The enclosing rules are the rules among the
    key's own prefixes: an equi-join, not a scan of all pairs of rules."""
    keyed = (rules.select(F.concat(_reversed(F.lower("host")), F.lit("/"), F.coalesce("path", F.lit(""))).alias("key"),
                          F.concat(F.lower("host"), F.coalesce("path", F.lit(""))).alias("rule"),
                          F.length("host").alias("host_len"), "verdict")
             .groupBy("key", "rule", "host_len").agg(F.max("verdict").alias("verdict")))
    prefixes = keyed.select(F.col("key").alias("own"), F.explode(
        F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substring(F.col("key"), F.lit(1), n))).alias("key"))
    entry = F.struct(F.length("rule").alias("size"), "host_len", "key", "rule", "verdict")
    return (prefixes.join(keyed, "key").groupBy("own")
            .agg(F.array_sort(F.collect_list(entry)).alias("stack"))
            .select(F.col("own").alias("key"), "stack"))


def match_urls(urls: DataFrame, rules: DataFrame, partitions: int | None = None) -> DataFrame:
    """urls(host, path), distinct -> (host, path, rule, verdict) of those that a rule fits."""
    spark = urls.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    labels = F.reverse(F.split("host", r"\.", -1))
    points = (urls.where(F.col("host") != "")
              .select("host", "path", F.explode(F.transform(
                  F.sequence(F.lit(1), F.size(labels)),
                  lambda k: F.concat(F.array_join(F.slice(labels, F.lit(1), k), "."), F.lit("/"), F.col("path")))).alias("key"))
              .withColumn("stack", F.lit(None).cast("array<struct<size:int,host_len:int,key:string,rule:string,verdict:string>>"))
              .withColumn("kind", F.lit(1)))
    opens = (rule_stacks(rules).withColumn("host", F.lit("")).withColumn("path", F.lit(""))
             .withColumn("kind", F.lit(0)).select(points.columns))
    # range partitioning samples; the ids are used twice, so they are frozen
    order = ["key", "kind", "host"]
    swept = freeze(points.unionByName(opens).repartitionByRange(n, *order)
                   .withColumn("pid", F.spark_partition_id()))
    # one row a partition: the last rule in it; carried to the partitions after it
    last = swept.where("kind = 0").groupBy("pid").agg(F.max_by("stack", "key").alias("last_stack"))
    pids = spark.range(n).select(F.col("id").cast("int").alias("pid")).join(last, "pid", "left")
    carry = pids.select("pid", F.last("last_stack", ignorenulls=True).over(
        Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    running = Window.partitionBy("pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    active = (swept.join(F.broadcast(carry), "pid")   # n rows
              .withColumn("open", F.coalesce(F.last("stack", ignorenulls=True).over(running), "carry"))
              .where("kind = 1"))
    return (active.withColumn("top", F.when(F.col("open").isNotNull(), F.try_element_at(
                F.filter("open", lambda r: F.startswith(F.col("key"), r["key"])), F.lit(-1))))
            .where("top is not null").groupBy("host", "path").agg(F.max("top").alias("top"))
            .select("host", "path", F.col("top.rule").alias("rule"), F.col("top.verdict").alias("verdict")))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """pages(page_id, url, ...) -> (page_id, host, path, rule, verdict), a row for each page."""
    parsed = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    found = match_urls(parsed.select("host", "path").distinct(), rules)
    return (parsed.join(found, ["host", "path"], "left")
            .select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")))


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"), rules_frame(spark))


SQL = r"""
WITH p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
hit AS (
  SELECT DISTINCT ON (host, path) u.host, u.path, r.h || r.p AS rule, r.v
  FROM (SELECT DISTINCT host, path FROM p) u
  JOIN r ON (u.host = r.h OR u.host LIKE '%.' || r.h) AND starts_with(u.path, r.p)
  ORDER BY u.host, u.path, length(r.h || r.p) DESC)
SELECT page_id, p.host, p.path, hit.rule, coalesce(hit.v, 'allow') AS verdict
FROM p LEFT JOIN hit ON p.host = hit.host AND p.path = hit.path
"""

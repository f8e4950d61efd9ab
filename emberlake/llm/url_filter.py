"""URL rules by expanding each URL into host-suffix and path-prefix expressions and joining on short hash prefixes."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import SMALL, UPPER

#: Hex digits of the hash prefix that the join compares: 32 bits.
PREFIX = 8
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def rest(url: Column) -> Column:
    """What follows the first ://, up to ? or #; null without ://."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^([^?#]*)", 1))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(rest(url), r"^([^/]*)", 1), UPPER, SMALL), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest(url), r"^[^/]*((?s:.*))$", 1), F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """host, path, verdict, expression, digest and its prefix. Of equal expressions block wins."""
    df = spark.createDataFrame([(h, p, v) for h, p, v in rules], "rule_host string, rule_path string, rule_verdict string")
    df = df.groupBy("rule_host", "rule_path").agg(F.min_by("rule_verdict", F.when(F.col("rule_verdict") == "block", 0).otherwise(1)).alias("rule_verdict"))
    expression = F.concat("rule_host", "rule_path")
    digest = F.sha2(expression, 256)
    return df.withColumn("expression", expression).withColumn("digest", digest).withColumn("prefix", F.substring("digest", 1, PREFIX))


def expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Host suffixes of the given numbers of labels with path prefixes of the given lengths, as far as the URL has them: only these can equal a rule."""
    n = F.size(F.split(host, r"\."))
    suffixes = F.array(*[F.when(n >= k, F.substring_index(host, ".", -k)) for k in labels])
    prefixes = F.array(*[F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in lengths])
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    return F.filter(pairs, lambda x: x.isNotNull())


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for each row.

    Null URLs and those without :// have an empty host and path, so no rule fits and they get `default`,
    as does every URL that no rule fits. Of fitting rules the longest expression wins, then the longer
    host. Repeated rows each get their row. Rules come as a DataFrame of any size; each distinct
    (host, path) is expanded and joined once, whatever its share of the rows.
    """
    shapes = rules.agg(F.array_sort(F.collect_set(F.size(F.split("rule_host", r"\.")))).alias("labels"), F.array_sort(F.collect_set(F.length("rule_path"))).alias("lengths")).first()
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keys = parts.select("host", "path").where("host != ''").distinct()
    expanded = keys.withColumn("e", F.explode(expressions(F.col("host"), F.col("path"), shapes.labels or [], shapes.lengths or []))) if shapes.labels else keys.withColumn("e", F.lit("")).limit(0)
    expanded = expanded.withColumn("d", F.sha2("e", 256)).withColumn("d_prefix", F.substring("d", 1, PREFIX))
    found = expanded.join(rules, F.col("d_prefix") == rules.prefix).where((F.col("d") == F.col("digest")) & (F.col("e") == F.col("expression")))
    best = found.groupBy("host", "path").agg(F.max_by(F.struct("expression", "rule_verdict"), F.struct(F.length("expression"), F.length("rule_host"))).alias("best"))
    best = best.withColumnsRenamed({"host": "h", "path": "p"})
    joined = parts.join(best, (parts.host == best.h) & (parts.path == best.p), "left")
    return joined.select("page_id", "host", "path", F.col("best.expression").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))

"""URL filters as a sort-merge range join. DataFrame functions only.

A host becomes a canonical key, its labels in reverse with a dot after each: a rule's host is then a
prefix, and all its subdomains are the interval of keys that start with it. Such intervals nest or
are apart. Rules and urls are sorted together by key; the sweep carries the rule host that started last,
which names the stack of active rules: it and the hosts above it. Of that stack, entries whose
interval has ended are popped, and of those whose path is a prefix of the url's path, the longest
rule wins (of equal length, the longer host). Stacks stay in a table of their own, a row for each
rule host; it is broadcast up to `most_bytes`, measured, and joined by a shuffle beyond.

Urls are dealt to buckets by a hash of the whole row, so a host of any size is spread evenly; each
bucket gets the starts of all rule hosts. There are four buckets for each shuffle partition, or as
many as keep the starts of all buckets together at `most_starts`, and one at least.

Host: after the first :// up to /, ?, # or the end, A-Z lower-cased. Path: from there up to ?, # or
the end. Both are empty for a null url or one without ://. No rule: the default verdict. Repeated
rows and null ids are judged row by row; an empty table gives an empty result; other columns are
ignored. Rules with a null host or path fit nothing; of equal rules the least verdict holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modelloom.llm.common import LOWER, UPPER

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules])
    return spark.range(1).select(F.inline(rows))


def host_of(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _stacks(rules: DataFrame) -> DataFrame:
    """For each distinct rule host, in key order: key, stack (all rules of it and of the hosts above it, longest first)."""
    own = rules.filter("host IS NOT NULL AND path IS NOT NULL").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    own = own.withColumn("key", host_key(F.col("host")))
    entry = F.struct(
        (-F.length(F.concat("host", "path"))).alias("rank"), (-F.length("host")).alias("rank2"),
        F.col("key"), F.col("path"), F.concat("host", "path").alias("rule"), F.col("verdict"),
    )
    by_host = own.groupBy("key").agg(F.collect_list(entry).alias("own"))
    labels = F.slice(F.split("key", r"\."), 1, F.size(F.split("key", r"\.")) - 1)
    above = by_host.select("key", labels.alias("labels")).select(
        "key", F.explode(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda n: F.concat(F.array_join(F.slice("labels", 1, n), "."), F.lit(".")))).alias("up")
    )
    met = above.join(by_host.select(F.col("key").alias("up"), "own"), "up")
    return met.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("own"))).alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", buckets: int | None = None, most_starts: int = 4_000_000, most_bytes: int = 32 << 20) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule (null: none), verdict."""
    stacks = _stacks(rules)
    size = F.aggregate("stack", F.lit(0).cast("long"), lambda n, r: n + 96 + F.octet_length(r["key"]) + F.octet_length(r["path"]) + F.octet_length(r["rule"]))
    n_hosts, n_bytes = stacks.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    buckets = max(1, min(buckets or 4 * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), most_starts // max(1, n_hosts)))
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.pmod(F.xxhash64("page_id", "url"), F.lit(buckets)).cast("int").alias("bucket"))
    urls = urls.withColumn("key", host_key(F.col("host"))).withColumn("kind", F.lit(1))
    starts = stacks.select("key", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), F.lit(0).alias("kind"), F.col("key").alias("top"))
    sweep = Window.partitionBy("bucket").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = urls.unionByName(starts, allowMissingColumns=True).withColumn("top", F.last("top", ignorenulls=True).over(sweep)).filter("kind = 1")
    by = stacks.select(F.col("key").alias("top"), "stack")
    both = both.join(F.broadcast(by) if n_bytes <= most_bytes else by.hint("merge"), "top", "left")
    fits = F.filter("stack", lambda r: F.startswith(F.col("key"), r["key"]) & F.startswith(F.col("path"), r["path"]))
    return both.withColumn("best", F.get(fits, 0)).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )

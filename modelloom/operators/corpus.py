"""Corpus management: duplicates by either of two keys, representatives, hashes of structure."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelloom.operators import grouped, metrics

# Venue tiers, best first.
TIERS = ("A_star", "A", "B", "C", "preprint", "unranked")


def quality_rank(tier: Column) -> Column:
    """Position of a tier; unknown ones last."""
    at = F.array_position(F.array(*map(F.lit, TIERS)), F.coalesce(tier, F.lit("")))
    return F.when(at > 0, at - 1).otherwise(F.lit(len(TIERS)).cast("long"))


def duplicate_groups(df: DataFrame, key: str, keys: list[str]) -> DataFrame:
    """id, root: rows linked, over others too, by an equal value of any of the keys. Rows link to their values, not to each other."""
    links = None
    for i, k in enumerate(keys):
        e = df.filter(F.col(k).isNotNull()).select(F.lit(0).alias("fid"), F.concat(F.lit("r"), F.col(key).cast("string")).alias("src"), F.concat(F.lit(f"k{i}:"), F.col(k).cast("string")).alias("dst"))
        links = e if links is None else links.unionByName(e)
    nodes = links.select("fid", F.col("src").alias("id")).unionByName(links.select("fid", F.col("dst").alias("id"))).unionByName(df.select(F.lit(0).alias("fid"), F.concat(F.lit("r"), F.col(key).cast("string")).alias("id")))
    parts = metrics.components(nodes.distinct(), links)
    mine = parts.filter(F.col("id").startswith("r")).select(F.substring("id", 2, 40).cast(df.schema[key].dataType).alias("id"), "root")
    least = mine.groupBy("root").agg(F.min("id").alias("group_id"), F.count("*").alias("group_size"))
    return mine.join(least, "root").select("id", "group_id", "group_size")


def representatives(df: DataFrame, group: str, citations: Column, tier: Column, index: str) -> DataFrame:
    """The row of each group with most citations, then the best tier, then the least index."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(citations.desc(), quality_rank(tier), index))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def structure_hash(lines: DataFrame, by: str, kind: str, line: str) -> DataFrame:
    """SHA-256 of a graph's sorted node lines and sorted edge lines. kind: N or E."""
    side = lambda k: F.array_join(F.array_sort(F.collect_list(F.when(F.col(kind) == k, F.col(line)))), "\n")
    return lines.groupBy(by).agg(F.sha2(F.concat(F.lit("N\n"), side("N"), F.lit("\nE\n"), side("E")).cast("binary"), 256).alias("hash"))


def select_representatives(clusters: DataFrame, records: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """cluster, chosen, reason, ranked. clusters: cluster, id (null for a cluster without members); records: id, citations, tier;
    fallback: cluster, id of a benchmark. Members rank by citations, tier and id. The first stands for the cluster if it is cited;
    else the benchmark, if there is one; else the first all the same. A cluster of no member has its benchmark, or null.

    Two aggregates find the first and the list of all, which is as long as the cluster."""
    ranked = clusters.join(records, "id", "left").withColumn("rank", F.struct((-F.coalesce("citations", F.lit(0))).cast("long").alias("minus"), quality_rank(F.col("tier")).alias("tier"), F.col("id")))
    rank = F.when(F.col("id").isNotNull(), F.col("rank"))
    per = ranked.groupBy("cluster").agg(F.min(rank).alias("top"), F.transform(F.array_sort(F.collect_list(rank)), lambda x: x["id"]).alias("ranked"))
    spare = fallback.select("cluster", F.col("id").alias("spare")) if fallback is not None else per.select("cluster", F.col("top.id").alias("spare")).limit(0)
    per = per.join(spare, "cluster", "left")
    cited, has = F.coalesce(F.col("top.minus") < 0, F.lit(False)), F.col("top").isNotNull()
    # The reasons.
    reason = F.when(cited, "highest_citation").when(~has | F.col("spare").isNotNull(), "benchmark_fallback").otherwise("next_highest_fallback")
    return per.select("cluster", F.when(cited, F.col("top.id")).otherwise(F.coalesce("spare", "top.id")).alias("chosen"), reason.alias("reason"), "ranked")


# Fixed value: the version of the manifest's layout.
MANIFEST_VERSION = "1"


def manifest(search_date: str, queries: list[str] = (), notes: str = "") -> str:
    """What was searched, and when, as JSON."""
    if not search_date:
        raise ValueError("search date: empty")
    return json.dumps({"manifest_schema_version": MANIFEST_VERSION, "frozen_search_date": search_date, "queries": list(queries), "notes": notes})


def manifests(texts: DataFrame, column: str = "value") -> DataFrame:
    """Manifests read back, a row each; corrupt is the text of one of another version or without a date."""
    df = texts.select(F.from_json(column, "manifest_schema_version string, frozen_search_date string, queries array<string>, notes string").alias("m"), F.col(column).alias("_text"))
    good = (F.coalesce("m.manifest_schema_version", F.lit(MANIFEST_VERSION)) == MANIFEST_VERSION) & (F.coalesce("m.frozen_search_date", F.lit("")) != "")
    own = lambda c, default: F.when(good, F.coalesce(c, default)).alias(c.split(".")[1])
    return df.select(F.when(good, F.col("m.frozen_search_date")).alias("frozen_search_date"), own("m.queries", F.array().cast("array<string>")), own("m.notes", F.lit("")), F.when(~good, F.col("_text")).alias("corrupt"))


def isomorphism_classes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """fid, same_as: the least fid whose schema graph is the same but for names. nodes, edges: as operators.views has them.

    Nodes match by class and subtype, edges by type and role. Blocks come from two rounds of neighbour colours, as joins and
    aggregates; only graphs of one block are compared by search, each with one graph of every class found so far."""
    n = nodes.select("fid", "id", F.concat_ws("|", "cls", "subtype").alias("kind"))
    e = edges.select("fid", "src", "dst", F.concat_ws("|", "type", F.coalesce("role", F.lit(""))).alias("kind"))
    colour = n.select("fid", "id", F.xxhash64("kind").alias("colour"))
    for _ in range(2):
        at = lambda x: colour.select("fid", F.col("id").alias(x), F.col("colour").alias("c_" + x))  # noqa: E731, B023
        met = e.join(at("src"), ["fid", "src"]).join(at("dst"), ["fid", "dst"])
        near = met.select("fid", F.col("src").alias("id"), F.xxhash64(F.lit(0), "kind", "c_dst").alias("x")).unionByName(met.select("fid", F.col("dst").alias("id"), F.xxhash64(F.lit(1), "kind", "c_src").alias("x")))
        sums = near.groupBy("fid", "id").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"))
        colour = colour.join(sums, ["fid", "id"], "left").select("fid", "id", F.xxhash64("colour", F.col("s").cast("string")).alias("colour"))
    block = colour.groupBy("fid").agg(F.sum(F.col("colour").cast("decimal(38,0)")).cast("string").alias("block"), F.count("*").alias("size"))
    graphs = n.groupBy("fid").agg(F.collect_list(F.struct("id", "kind")).alias("nodes")).join(e.groupBy("fid").agg(F.collect_list(F.struct("src", "dst", "kind")).alias("edges")), "fid", "left").join(block, "fid")

    def one(pdf):
        import pandas as pd

        found: list = []
        out = []
        for fid, ns, es in sorted(zip(pdf["fid"], pdf["nodes"], pdf["edges"]), key=lambda x: x[0]):
            graph = {x["id"]: x["kind"] for x in ns}, [(x["src"], x["dst"], x["kind"]) for x in (es if es is not None else [])]
            same = next((f for f, g in found if grouped.isomorphic(g, graph)), None)
            if same is None:
                found.append((fid, graph))
            out.append((fid, fid if same is None else same))
        return pd.DataFrame(out, columns=["fid", "same_as"])

    return graphs.groupBy("block", "size").applyInPandas(one, "fid string, same_as string")


def isomorphism_report(clusters: DataFrame, classes: DataFrame) -> DataFrame:
    """cluster, size, pairs, same_pairs, pair_rate, largest, whole_rate, representative. clusters: cluster, fid; classes: fid, same_as."""
    of = clusters.join(classes, "fid").groupBy("cluster", "same_as").agg(F.count("*").alias("n"), F.min("fid").alias("least"))
    pairs = lambda n: n * (n - 1) / 2
    per = of.groupBy("cluster").agg(F.sum("n").alias("size"), F.sum(pairs(F.col("n"))).cast("long").alias("same_pairs"), F.max("n").alias("largest"), F.min(F.struct(-F.col("n"), "least")).alias("best"))
    per = per.withColumn("pairs", pairs(F.col("size")).cast("long"))
    return per.select("cluster", "size", "pairs", "same_pairs", F.when(F.col("pairs") == 0, 1.0).otherwise(F.col("same_pairs") / F.col("pairs")).alias("pair_rate"), "largest", (F.col("largest") / F.col("size")).alias("whole_rate"), F.col("best.least").alias("representative"))

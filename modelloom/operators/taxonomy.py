"""Named clusterings of entities, level by level: variables and parameters, then constraints and objectives, then whole models; and
models by their words alone, for their domain and for the way of solving.

A level's entities become bags of tokens in Spark, TF-IDF vectors, and then one group each for the
clustering itself, which is sequential and as large as a level of the catalog.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelloom.functions import lexical
from modelloom.operators import grouped, metrics, mining, signatures, views
from modelloom.operators.tables import cut
from modelloom.sources.formulations import terms

THRESHOLD = 0.7


def _none() -> Column:
    return F.array().cast("array<string>")


def _entities(f: DataFrame, *parts: str) -> DataFrame:
    sigs = signatures.signatures(f).filter(F.col("part").isin(*parts))
    return sigs.select("fid", F.concat_ws("::", "fid", "part", "name").alias("doc"), "text", signatures.tokens().alias("facets"))


def entities_v(f: DataFrame) -> DataFrame:
    """doc, text, facets of variables and parameters: their signatures."""
    return _entities(f, "variable", "parameter").drop("fid")


def entities_c(f: DataFrame, named: DataFrame) -> DataFrame:
    """Constraints and objectives: their signatures, the cluster names of the variables that they refer to, and flags. named: doc, name."""
    goal = f.filter("objective IS NOT NULL").select(F.col("id").alias("fid"), F.concat_ws("::", "id", F.lit("objective"), "objective.name").alias("goal"))
    t = terms(f).join(goal, "fid", "left").withColumn("doc", F.when(F.col("ctype") == "objective", F.col("goal")).otherwise(F.concat_ws("::", "fid", F.lit("constraint"), F.substring("container", 12, 1000))))
    refs = t.filter("ref_kind = 'variable'").select("doc", F.concat_ws("::", "fid", F.lit("variable"), "ref").alias("ref")).distinct()
    names = refs.join(named.select(F.col("doc").alias("ref"), "name"), "ref").groupBy("doc").agg(F.array_sort(F.collect_list(F.concat(F.lit("vcluster:"), "name"))).alias("more"))
    c = f.select(F.col("id").alias("fid"), F.explode("constraints").alias("x"))
    aggregates = F.exists(F.concat("x.lhs", "x.rhs"), lambda t: t["operator"] != "none")
    flags = F.array_compact(F.array(F.when((F.col("x.kind") == "big_m") | F.col("x.indicator").isNotNull(), "cflag:big_m"), F.when(aggregates, "cflag:aggregation")))
    c = c.select(F.concat_ws("::", "fid", F.lit("constraint"), "x.name").alias("doc"), flags.alias("flags"))
    met = _entities(f, "constraint", "objective").join(names, "doc", "left").join(c, "doc", "left")
    return met.select("doc", "text", F.concat("facets", F.coalesce("more", _none()), F.coalesce("flags", _none())).alias("facets"))


# The edges of the buckets of measures, and the greatest diameter that is told apart.
DENSITIES, RATIOS, SIZES, FARTHEST = (0.05, 0.15, 0.30), (0.75, 1.25, 2.0), (10.0, 50.0, 200.0, 1000.0), 12


def _bucket(value: Column, edges: tuple[float, ...]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= value)).cast("string")


def model_features(f: DataFrame) -> DataFrame:
    """fid, facets: family, kinds and domains with repetition, presence flags, and measures of the schema graph by bucket."""
    nodes, edges = views.schema_nodes(f), views.schema_edges(f)
    each = lambda prefix, c: F.transform(F.filter(F.col(c), lambda x: x.isNotNull()), lambda x: F.concat(F.lit(f"{prefix}:"), x))
    kinds = F.concat(F.array(F.concat(F.lit("family:"), "family")), each("ckind", "constraints.kind"), each("cdom", "constraints.domain_class"), each("vdom", "variables.domain"), each("vrole", "variables.domain_role"))
    flags = views.flags(f)
    on = F.array_compact(F.array(*[F.when(F.col(c), F.lit(f"flag:{c}")) for c in flags.columns if c != "fid"]))
    word = lambda prefix, c: F.concat(F.lit(f"{prefix}:"), c.cast("string"))
    measured = F.array(
        word("density_bin", _bucket(F.col("density"), DENSITIES)), word("cvr_bin", _bucket(F.col("ratio"), RATIOS)), word("size_bin", _bucket(F.col("size"), SIZES)),
        word("diam", F.least(F.coalesce("diameter", F.lit(0)), F.lit(FARTHEST))), word("coherent", F.col("coherent")), word("complete", F.col("complete").cast("int")),
    )
    met = metrics.summary(nodes, edges).join(metrics.of_documents(nodes, edges), "fid").join(flags.select("fid", on.alias("flags")), "fid")
    return met.join(f.select(F.col("id").alias("fid"), kinds.alias("kinds")), "fid").select("fid", F.concat("kinds", "flags", measured).alias("facets"))


def entities_m(f: DataFrame, named_v: DataFrame, named_c: DataFrame) -> DataFrame:
    """Whole models: their features, and the cluster names of their parts, with repetition. named: doc, name."""
    of = lambda named, prefix: named.select(F.split("doc", "::")[0].alias("fid"), F.concat(F.lit(f"{prefix}:"), "name").alias("t"))
    names = of(named_v, "vtype").unionByName(of(named_c, "cfamily")).groupBy("fid").agg(F.array_sort(F.collect_list("t")).alias("more"))
    met = model_features(f).join(names, "fid", "left")
    return met.select(F.col("fid").alias("doc"), F.lit("").alias("text"), F.concat("facets", F.coalesce("more", _none())).alias("facets"))


def entities_text(f: DataFrame, tags_twice: bool) -> DataFrame:
    """Whole models by their words alone: tags count once more for the domain than for the way of solving."""
    text = F.concat_ws(" ", "name", "description", F.array_join("tags", " "))
    return f.select(F.col("id").alias("doc"), (F.concat_ws(" ", F.array_join("tags", " "), text) if tags_twice else text).alias("text"), _none().alias("facets"))


def bags(entities: DataFrame) -> DataFrame:
    every = F.concat(lexical.concepts(F.col("text")), F.col("facets"))
    return entities.select("doc", F.explode_outer(every).alias("concept")).filter("concept IS NOT NULL").groupBy("doc", "concept").agg(F.count("*").alias("tf"))


def named_clusters(entities: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc, cluster, name: clusters are numbered by their least member; named after the concept of most weight, later ones of a name _2, _3, ...; without any concept: -1, unassigned."""
    w = mining.tf_idf(bags(entities))
    concepts = mining.vocabulary(w)
    dense = w.join(concepts, "concept").groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("position", "weight"))).alias("m"))
    n = concepts.count()
    vec = F.transform(F.sequence(F.lit(0), F.lit(max(n - 1, 0))), lambda i: F.coalesce(F.element_at(F.col("m"), i.cast(dense.schema["m"].dataType.keyType)), F.lit(0.0)))
    rows = entities.select("doc").join(dense, "doc", "left").select(F.lit(0).alias("grp"), F.col("doc").alias("id"), F.when(F.col("m").isNull(), F.array(F.lit(0.0))).otherwise(vec).alias("vec"))
    rows = rows.withColumn("vec", F.when(F.size("vec") < max(n, 1), F.array_repeat(F.lit(0.0), max(n, 1))).otherwise(F.col("vec")))
    found = grouped.cluster_groups(rows, threshold).select(F.col("id").alias("doc"), "cluster")
    sums = found.filter("cluster >= 0").join(w, "doc").groupBy("cluster", "concept").agg(F.round(F.sum("weight"), 9).alias("weight"))
    top = mining.top_per_group(sums, "cluster", [F.col("weight").desc(), "concept"], 1).select("cluster", F.col("concept").alias("base"))
    names = mining.unique_names(top, "base", "cluster").select("cluster", "name")
    return found.join(names, "cluster", "left").select("doc", "cluster", F.coalesce("name", F.lit("unassigned")).alias("name"))


def induce(f: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """level, doc, cluster, name of all five levels; a level is written before the next reads its names."""
    v = cut(named_clusters(entities_v(f), threshold))
    c = cut(named_clusters(entities_c(f, v), threshold))
    m = named_clusters(entities_m(f, v, c), threshold)
    # The names of the levels.
    levels = {"V": v, "C": c, "M": m, "domain": named_clusters(entities_text(f, True), threshold), "solution_approach": named_clusters(entities_text(f, False), threshold)}
    return reduce(DataFrame.unionByName, [df.select(F.lit(x).alias("level"), "doc", "cluster", "name") for x, df in levels.items()])


def _apart(vectors: np.ndarray) -> np.ndarray:
    """Cosine distances; a vector of zeros is at 1 from all but itself."""
    size = np.linalg.norm(vectors, axis=1)
    unit = vectors / np.where(size > 0, size, 1)[:, None]
    d = np.clip(1 - unit @ unit.T, 0, 2)
    np.fill_diagonal(d, 0)
    return d


def stability(vectors: np.ndarray, threshold: float = THRESHOLD, draws: int = 25, seed: int = 0) -> dict[str, float]:
    """How far a clustering by a threshold holds: mean silhouette, Rand indices of bootstrap draws, and those of two other ways to cluster."""
    d = _apart(vectors)
    labels = grouped.average_linkage(d, threshold)
    drawn = grouped.bootstrap(d, labels, draws, seed, threshold) or [1.0]
    k = select_k(d)[0]
    out = {"silhouette": float(np.mean(silhouettes(d, np.array(labels)))) if len(d) else 0.0, "ari_mean": float(np.mean(drawn)), "ari_min": float(min(drawn)), "ari_max": float(max(drawn))}
    out["fixed_k"] = float(grouped.rand_index(labels, grouped.average_linkage(d, k=k)))
    # Every other concept, in their order; too few concepts aren't halved.
    out["halved"] = float(grouped.rand_index(labels, grouped.average_linkage(_apart(vectors[:, ::2]), threshold))) if vectors.shape[1] >= 4 else 1.0
    return out


def stability_report(rows: DataFrame, threshold: float = THRESHOLD, draws: int = 25, seed: int = 0) -> DataFrame:
    """grp and the measures of stability(), a row each. rows: grp, id, vec (dense). A group is one task, as large as what is clustered."""

    def one(pdf):
        import pandas as pd

        pdf = pdf.sort_values("id")
        return pd.DataFrame([{"grp": pdf["grp"].iloc[0], **stability(np.stack(pdf["vec"].to_list()), threshold, draws, seed)}])

    kind = rows.schema["grp"].dataType.simpleString()
    return rows.groupBy("grp").applyInPandas(one, f"grp {kind}, silhouette double, ari_mean double, ari_min double, ari_max double, fixed_k double, halved double")


def silhouettes(d: np.ndarray, labels: np.ndarray) -> list[float]:
    """One for each item; 0 alone in its cluster, or with one cluster only."""
    out = []
    for i in range(len(d)):
        own = labels == labels[i]
        own[i] = False
        others = set(labels.tolist()) - {labels[i]}
        if not own.any() or not others:
            out.append(0.0)
            continue
        a, b = d[i, own].mean(), min(d[i, labels == c].mean() for c in others)
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return out


def select_k(d: np.ndarray, least: int = 2, most: int = 8) -> tuple[int, float]:
    """The number of clusters of the best mean silhouette, the smaller of equals; (1, 0) if there is none to try."""
    best = (1, 0.0)
    for k in range(max(2, least), min(most, len(d) - 1) + 1):
        labels = np.array(grouped.average_linkage(d, k=k))
        s = silhouettes(d, labels)
        if best[0] == 1 or float(np.mean(s)) > best[1] + 1e-12:
            best = (k, float(np.mean(s)))
    return best


def local_index(nodes: DataFrame) -> DataFrame:
    """Tensor-ready nodes: fid, cls, id, index within its class, subtype code in order of names."""
    within = F.row_number().over(Window.partitionBy("fid", "cls").orderBy("id")) - 1
    code = F.dense_rank().over(Window.partitionBy("fid", "cls").orderBy("subtype")) - 1
    return nodes.select("fid", "cls", "id", within.alias("index"), code.alias("subtype_code"))


def layout(nodes: DataFrame) -> DataFrame:
    """Coordinates of a layered drawing: a row for each class, 140 apart in it."""
    # The classes from top to bottom.
    rows = F.create_map(*[F.lit(x) for i, c in enumerate(("objective", "operator", "constraint", "variable", "parameter", "index")) for x in (c, 60 + 110 * i)])
    return local_index(nodes).select("fid", "id", "cls", (30 + 140 * F.col("index") + 55).alias("x"), F.element_at(rows, F.col("cls")).alias("y"))


def svg(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """fid, svg: a line for each edge under a circle for each node."""
    at = layout(nodes)
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    a, b = (at.select("fid", F.col("id").alias(s), F.col("x").alias(f"x{s}"), F.col("y").alias(f"y{s}")) for s in ("src", "dst"))
    lines = edges.join(a, ["fid", "src"]).join(b, ["fid", "dst"]).select("fid", F.lit(0).alias("z"), F.format_string('<line x1="%d" y1="%d" x2="%d" y2="%d" stroke="#888"/>', "xsrc", "ysrc", "xdst", "ydst").alias("s"))
    dots = at.select("fid", F.lit(1).alias("z"), F.format_string('<g><circle cx="%d" cy="%d" r="22" fill="#fff" stroke="#333"/><text x="%d" y="%d" text-anchor="middle">%s</text></g>', "x", "y", "x", "y", esc(F.col("id"))).alias("s"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("z", "s"))), lambda p: p["s"])
    return lines.unionByName(dots).groupBy("fid").agg(F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg">'), F.array_join(parts, ""), F.lit("</svg>")).alias("svg"))

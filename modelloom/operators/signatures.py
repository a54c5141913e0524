"""Typed signatures of the parts of formulations, their features as long rows, label vocabularies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelloom.operators import mining

#: Columns of a signature.
FIELDS = ("domain", "role", "kind", "shape", "quantifiers", "comparator", "referents")


def canonical() -> Column:
    """One stable text of a signature's columns. Its field names and their order."""
    box = lambda c: F.concat(F.lit("["), F.array_join(c, ","), F.lit("]"))
    parts = [("domain", F.col("domain")), ("role", F.col("role")), ("kind", F.col("kind")), ("shape", box("shape")), ("quant", box("quantifiers")), ("cmp", F.col("comparator")), ("refs", box("referents"))]
    return F.concat_ws("|", *[F.concat(F.lit(f"{n}="), c) for n, c in parts])


def signatures(f: DataFrame) -> DataFrame:
    """fid, part (variable, parameter, constraint, objective, model), name, text and the signature's columns. f: parsed formulations."""
    none, empty = F.array().cast("array<string>"), F.lit("")

    def of(items: str, part: str, domain: Column, role: Column, kind: Column, shape: Column, quantifiers: Column = none, comparator: Column = empty, referents: Column = none) -> DataFrame:
        x = f.select(F.col("id").alias("fid"), F.explode(items).alias("x"))
        return x.select("fid", F.lit(part).alias("part"), F.col("x.name").alias("name"), F.trim(F.concat_ws(" ", "x.name", "x.description")).alias("text"), F.coalesce(domain, empty).alias("domain"), role.alias("role"), kind.alias("kind"), shape.alias("shape"), quantifiers.alias("quantifiers"), comparator.alias("comparator"), referents.alias("referents"))

    pattern = F.transform("x.quantifiers", lambda q: F.concat_ws(":", q["index"], q["over"], F.when(q["restriction"] != "none", q["restriction"])))
    kinds = F.array_sort(F.transform(F.concat("x.lhs", "x.rhs"), lambda t: t["ref_kind"]))
    parts = [
        of("variables", "variable", F.col("x.domain_role"), F.col("x.role"), F.col("x.domain"), F.col("x.shape")),
        of("parameters", "parameter", F.col("x.domain_class"), F.lit("parameter"), F.col("x.kind"), F.col("x.shape")),
        of("constraints", "constraint", F.col("x.domain_class"), F.lit("constraint"), F.col("x.kind"), F.transform("x.quantifiers", lambda q: q["over"]), pattern, F.col("x.comparator"), kinds),
    ]
    o = f.filter("objective IS NOT NULL")
    head = lambda df, part, name, text, domain, kind, shape: df.select(F.col("id").alias("fid"), F.lit(part).alias("part"), name.alias("name"), F.trim(text).alias("text"), F.lit(domain).alias("domain"), F.lit(part).alias("role"), kind.alias("kind"), shape.alias("shape"), none.alias("quantifiers"), empty.alias("comparator"), none.alias("referents"))
    parts.append(head(o, "objective", F.col("objective.name"), F.concat_ws(" ", "objective.name", "objective.description"), "objective_defining", F.concat("objective.sense", F.lit("/"), "objective.combination"), none))
    parts.append(head(f, "model", F.col("name"), F.concat_ws(" ", "name", "description", F.array_join("tags", " ")), "", F.col("family"), F.col("indices.name")))
    return reduce(DataFrame.unionByName, parts)


def tokens() -> Column:
    """All facets of a signature's columns as words, with repetition; facets without a value are left out."""
    each = lambda prefix, c: F.transform(c, lambda x: F.concat(F.lit(f"{prefix}:"), x))
    given = lambda c: F.when(F.col(c) != "", F.array(c)).otherwise(F.array().cast("array<string>"))
    one = lambda c: F.array(F.col(c))
    return F.concat(each("domain", given("domain")), each("role", one("role")), each("kind", one("kind")), F.array(F.concat(F.lit("arity:"), F.size("shape").cast("string"))), each("over", "shape"), each("cmp", given("comparator")), each("quant", "quantifiers"), each("ref", "referents"))


def features(sigs: DataFrame) -> DataFrame:
    """fid, part, name, feature, value: facets of the signature at 1, concepts of the text with their counts. Zero-length facets are left out."""
    facet = lambda prefix, c: F.concat(F.lit(f"{prefix}:"), c)
    each = lambda prefix, c: F.transform(c, lambda x: F.concat(F.lit(f"{prefix}:"), x))
    one = F.array(F.when(F.col("domain") != "", facet("domain", F.col("domain"))), facet("role", F.col("role")), facet("kind", F.col("kind")), facet("arity", F.size("shape").cast("string")))
    every = F.array_distinct(F.concat(F.array_compact(one), each("over", F.col("shape")), each("quant", F.col("quantifiers"))))
    who = ["fid", "part", "name"]
    facets = sigs.select(*who, F.explode(every).alias("feature"), F.lit(1.0).alias("value"))
    bags = mining.concept_bags(sigs.select(F.struct(*who).alias("doc"), "text")).select("doc.*", facet("concept", F.col("concept")).alias("feature"), F.col("tf").cast("double").alias("value"))
    return facets.unionByName(bags)


def vocabulary(names: DataFrame, column: str, unassigned: bool = True) -> DataFrame:
    """label, position: the admissible labels of a level, from the names of its clusters, sorted and distinct."""
    labels = names.select(F.col(column).alias("concept")).filter("concept IS NOT NULL")
    if unassigned:
        labels = labels.unionByName(names.sparkSession.range(1).select(F.lit("unassigned").alias("concept")))
    return mining.vocabulary(labels).select(F.col("concept").alias("label"), "position")

"""Graph views of formulations as two relations, and what is measured or checked on the documents themselves.

nodes: fid, id, cls, subtype, label, shape. edges: fid, src, dst, type, role, label, sign, coefficient.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelloom.functions import lexical
from modelloom.sources.formulations import terms


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def schema_nodes(f: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")

    def of(items: str, prefix: str, cls: str, subtype: str, shape: str | None = None) -> DataFrame:
        x = f.select(F.col("id").alias("fid"), F.explode(items).alias("x"))
        return x.select("fid", F.concat(F.lit(f"{prefix}:"), "x.name").alias("id"), F.lit(cls).alias("cls"), F.expr(subtype).alias("subtype"), F.col("x.name").alias("label"), (F.col(shape) if shape else none).alias("shape"))

    objective = f.filter("objective IS NOT NULL").select(F.col("id").alias("fid"), F.lit("objective:0").alias("id"), F.lit("objective").alias("cls"), F.col("objective.sense").alias("subtype"), F.col("objective.name").alias("label"), none.alias("shape"))
    operators = terms(f).filter("operator != 'none' AND ref_kind != 'literal'")
    operators = operators.select("fid", _operator_id().alias("id"), F.lit("operator").alias("cls"), F.col("operator").alias("subtype"), F.col("operator").alias("label"), F.col("operator_over").alias("shape"))
    return _all([
        of("indices", "index", "index", "if(x.cyclic, 'cyclic', if(x.ordered, 'ordered', 'set'))"),
        of("parameters", "param", "parameter", "x.kind", "x.shape"),
        of("variables", "var", "variable", "x.domain", "x.shape"),
        of("constraints", "constraint", "constraint", "x.kind"),
        objective, operators,
    ])


def _place() -> Column:
    return F.concat("side", F.lit("["), "pos", F.lit("]"))


def _operator_id() -> Column:
    return F.concat(F.lit("op:"), "container", F.lit("/"), _place(), F.lit("/"), "operator")


def schema_edges(f: DataFrame) -> DataFrame:
    none, text = F.lit(None).cast("int"), F.lit(None).cast("string")

    def shapes(items: str, prefix: str) -> DataFrame:
        x = f.select(F.col("id").alias("fid"), F.explode(items).alias("x")).select("fid", "x.name", F.explode("x.shape").alias("index"))
        return x.select("fid", F.concat(F.lit(f"{prefix}:"), "name").alias("src"), F.concat(F.lit("index:"), "index").alias("dst"), F.lit("uses_index").alias("type"), F.lit("shape").alias("role"), F.lit("").alias("label"), none.alias("sign"), text.alias("coefficient"))

    t = terms(f).filter("ref_kind != 'literal'")
    target = F.concat(F.when(F.col("ref_kind") == "variable", "var:").otherwise("param:"), "ref")
    kind = F.when(F.col("ref_kind") == "parameter", "uses_parameter").when(F.col("ctype") == "objective", "var_in_objective").otherwise("var_in_constraint")
    through = F.col("operator") != "none"
    one = F.struct(F.when(through, _operator_id()).otherwise(F.col("container")).alias("src"), target.alias("dst"), kind.alias("type"), F.col("role"), F.when(through, "").otherwise(_place()).alias("label"), F.col("sign"), F.col("coefficient"))
    into = F.struct(F.col("container").alias("src"), _operator_id().alias("dst"), F.lit("operator_input").alias("type"), F.col("role"), _place().alias("label"), none.alias("sign"), text.alias("coefficient"))
    main = t.select("fid", F.explode(F.when(through, F.array(into, one)).otherwise(F.array(one))).alias("e")).select("fid", "e.*")
    declared = f.select(F.col("id").alias("fid"), F.explode("parameters.name").alias("coef_param"))
    named = t.join(declared, ["fid", "coef_param"], "left_semi")
    coef = named.select("fid", F.col("container").alias("src"), F.concat(F.lit("param:"), "coef_param").alias("dst"), F.lit("uses_parameter").alias("type"), F.lit("coef").alias("role"), _place().alias("label"), none.alias("sign"), text.alias("coefficient"))
    return _all([shapes("parameters", "param"), shapes("variables", "var"), main, coef])


def hybrid_labels(f: DataFrame) -> DataFrame:
    """fid, container, side, pos, label: -coef·[I=i-1 mod T, ...] for each term that is no literal."""
    t = terms(f).filter("ref_kind != 'literal'")
    inner = F.expr("array_join(transform(bindings, b -> concat(b.index, '=', b.expr, if(b.modulo is null, '', concat(' mod ', b.modulo)))), ', ')")
    plain = F.expr("coef_param is null and coef_num = 1")
    coef = F.when(plain, "").otherwise(F.concat("coefficient", F.when(F.size("bindings") > 0, "·").otherwise("")))
    box = F.when(F.size("bindings") > 0, F.concat(F.lit("["), inner, F.lit("]"))).otherwise("")
    return t.select("fid", "container", "side", "pos", F.concat(F.when(F.col("sign") == 1, "").otherwise("-"), coef, box).alias("label"))


def hybrid_edges(f: DataFrame) -> DataFrame:
    """The edges of the hybrid view: those of the schema view, a term's edge to what it refers to labelled with its offsets. Nodes are the same."""
    labels = hybrid_labels(f).select("fid", "container", F.concat("side", F.lit("["), "pos", F.lit("]")).alias("place"), F.col("label").alias("compact"))
    e = schema_edges(f).withColumn("term", F.col("sign").isNotNull())
    through = F.col("src").startswith("op:")
    inner = F.regexp_extract("src", r"^op:(.*)/([a-z]+\[[0-9]+\])/[^/]*$", 1)
    e = e.withColumn("container", F.when(through, inner).otherwise(F.col("src"))).withColumn("place", F.when(through, F.regexp_extract("src", r"^op:(.*)/([a-z]+\[[0-9]+\])/[^/]*$", 2)).otherwise(F.col("label")))
    met = e.join(labels, ["fid", "container", "place"], "left")
    return met.select("fid", "src", "dst", "type", "role", F.when(F.col("term"), F.col("compact")).otherwise(F.col("label")).alias("label"), "sign", "coefficient")


def flags(f: DataFrame) -> DataFrame:
    """fid and the five presence flags, one projection over the nested rows."""
    every = "concat(flatten(transform(constraints, c -> concat(c.lhs, c.rhs))), coalesce(objective.terms, array()))"
    return f.select(
        F.col("id").alias("fid"),
        F.expr("exists(parameters, p -> p.kind = 'big_m') or exists(constraints, c -> c.kind = 'big_m')").alias("big_m"),
        F.expr("exists(variables, v -> v.domain in ('integer', 'binary'))").alias("integer_vars"),
        F.expr(f"exists({every}, t -> exists(t.bindings, b -> coalesce(b.modulo, '') != ''))").alias("modulo_offset"),
        F.expr(f"exists(variables, v -> v.role = 'slack') or exists({every}, t -> coalesce(t.role, '') = 'slack')").alias("soft_slack"),
        F.expr(f"exists({every}, t -> t.operator != 'none')").alias("aggregation"),
    )


def type_counts(f: DataFrame) -> DataFrame:
    """fid, tag, n: constraints by keyword type, zeros kept."""
    c = f.select(F.col("id").alias("fid"), F.explode("constraints").alias("c"))
    tags = c.select("fid", F.explode(lexical.type_tags(F.concat_ws(" ", "c.name", "c.description"))).alias("tag")).groupBy("fid", "tag").agg(F.count("*").alias("n"))
    every = f.select(F.col("id").alias("fid"), F.explode(F.array(*map(F.lit, lexical.TYPE_PATTERNS))).alias("tag"))
    return every.join(tags, ["fid", "tag"], "left").fillna(0, ["n"])


def findings(f: DataFrame) -> DataFrame:
    """fid, code, subject of all errors: shapes, quantifiers, references and coefficients that are not declared, bindings unlike the shape, the family's rule."""
    named = lambda c: f.select(F.col("id").alias("fid"), F.explode(f"{c}.name").alias("name")).distinct()
    indices, variables, parameters = named("indices"), named("variables"), named("parameters")
    used = _all([f.select(F.col("id").alias("fid"), F.explode(c).alias("x")).select("fid", F.explode("x.shape").alias("name")) for c in ("variables", "parameters")])
    q = f.select(F.col("id").alias("fid"), F.explode("constraints").alias("c")).select("fid", "c.name", F.posexplode("c.quantifiers").alias("pos", "q"), "c.quantifiers")
    t = terms(f)
    v, p = t.filter("ref_kind = 'variable'"), t.filter("ref_kind = 'parameter'")
    say = lambda df, code, subject: df.select("fid", F.lit(code).alias("code"), F.col(subject).alias("subject"))
    missing = lambda df, column, known: df.filter(F.col(column).isNotNull()).join(known.withColumnRenamed("name", column), ["fid", column], "left_anti")
    shapes = _all([f.select(F.col("id").alias("fid"), F.lit(k).alias("ref_kind"), F.explode(c).alias("x")).select("fid", "ref_kind", F.col("x.name").alias("ref"), "x.shape") for c, k in (("variables", "variable"), ("parameters", "parameter"))])
    unlike = t.join(shapes, ["fid", "ref_kind", "ref"]).filter("array_sort(array_distinct(bindings.index)) != array_sort(array_distinct(shape))")
    family = f.select(F.col("id").alias("fid"), F.col("family").alias("subject"), F.expr("exists(variables, v -> v.domain in ('integer', 'binary'))").alias("whole"))
    family = family.filter("(subject = 'lp' AND whole) OR (subject = 'milp' AND NOT whole)")
    return _all([
        say(missing(used, "name", indices), "unknown-index", "name"),
        say(missing(q.select("fid", F.col("q.over").alias("over")), "over", indices), "unknown-index", "over"),
        say(q.filter("q.restriction_other is not null and not exists(quantifiers, o -> o.index = q.restriction_other)").select("fid", F.col("q.restriction_other").alias("o")), "unknown-quantifier", "o"),
        say(missing(q.select("fid", F.col("q.where.parameter").alias("w")), "w", parameters), "unknown-parameter", "w"),
        say(missing(v, "ref", variables), "unknown-variable", "ref"),
        say(missing(p, "ref", parameters), "unknown-parameter", "ref"),
        say(missing(t, "coef_param", parameters), "unknown-coefficient", "coef_param"),
        say(t.filter("ref_kind = 'literal' and size(bindings) > 0"), "bound-literal", "container"),
        say(unlike, "bindings-shape", "ref"), say(family, "family", "subject"),
    ])


def structure_lines(f: DataFrame) -> DataFrame:
    """fid, kind, line: what the structure hash reads. Names go, but those of index families in shapes."""
    nodes, edges = schema_nodes(f), schema_edges(f)
    sig = F.concat_ws("|", "cls", "subtype", F.array_join("shape", ","))
    n = nodes.select("fid", "id", sig.alias("sig"))
    e = edges.join(n.select("fid", F.col("id").alias("src"), F.col("sig").alias("a")), ["fid", "src"]).join(n.select("fid", F.col("id").alias("dst"), F.col("sig").alias("b")), ["fid", "dst"])
    return n.select("fid", F.lit("N").alias("kind"), F.col("sig").alias("line")).unionByName(e.select("fid", F.lit("E").alias("kind"), F.concat_ws(">", "a", "type", "role", "b").alias("line")))

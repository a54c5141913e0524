"""Grounding whole formulations: index tuples are products of ranges, terms are joins with parameter tables.

For each constraint one plan enumerates its instances; each term adds the columns it needs. The
result is the sparse matrix (variables, rows, coefs) of the instance, of any size.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelloom.operators.grounding import RESTRICTIONS, shifted
from modelloom.sources.instances import parameter_table
from modelloom.sources.model import Model, Row, Variable


class Unsupported(ValueError):
    """What no linear program expresses."""


def _base(expr: str) -> str:
    return "".join(itertools.takewhile(lambda c: c.isalnum() or c == "_", expr.strip()))


def _name(prefix: str, keys: list[Column]) -> Column:
    return F.concat_ws("_", F.lit(prefix), *[k.cast("string") for k in keys])


class Grounder:
    """f: a row of sources.formulations. cards: size of each index. params: number or nested lists, or a table (k0, ..., value)."""

    def __init__(self, spark: SparkSession, f, cards: dict[str, int], params: dict):
        for i in f["indices"]:
            if cards.get(i["name"], 0) <= 0:
                raise ValueError(f"size of {i['name']}: missing or not positive")
        if any(c["indicator"] for c in f["constraints"]):
            raise Unsupported("indicator trigger")
        if f["objective"] and f["objective"]["combination"] == "lexicographic":
            raise Unsupported("lexicographic objective")
        self.spark, self.f, self.cards = spark, f, cards
        self.params = {k: v if isinstance(v, DataFrame) else parameter_table(spark, v) for k, v in params.items()}
        self.shapes = {x["name"]: list(x["shape"]) for x in (*f["variables"], *f["parameters"])}
        self.cyclic = {i["name"] for i in f["indices"] if i["cyclic"]}

    def _range(self, family: str, name: str) -> DataFrame:
        return self.spark.range(self.cards[family]).withColumnRenamed("id", name)

    def _product(self, axes: list[tuple[str, str]]) -> DataFrame:
        return reduce(DataFrame.crossJoin, [self._range(f, n) for f, n in axes]) if axes else self.spark.range(1).select(F.lit(0).alias("_one"))

    def variables(self) -> DataFrame:
        parts = []
        for v in self.f["variables"]:
            keys = [f"k{i}" for i in range(len(v["shape"]))]
            lower = v["lower"] if v["lower"] is not None or v["domain"] not in ("non_negative", "binary") else 0.0
            upper = v["upper"] if v["upper"] is not None or v["domain"] != "binary" else 1.0
            rows = self._product(list(zip(v["shape"], keys)))
            domain = v["domain"] if v["domain"] in ("integer", "binary") else "continuous"
            parts.append(rows.select(_name(v["name"], [F.col(k) for k in keys]).alias("var"), F.lit(domain).alias("domain"), F.lit(lower).cast("double").alias("lower"), F.lit(upper).cast("double").alias("upper")))
        return reduce(DataFrame.unionByName, parts)

    def instances(self, c) -> DataFrame:
        """row and a column for each quantifier."""
        out = None
        for q in c["quantifiers"]:
            own = self._range(q["over"], q["index"])
            if out is None:
                out = own
            elif q["restriction"] == "none":
                out = out.crossJoin(own)
            else:
                out = out.join(own, RESTRICTIONS[q["restriction"]](own[q["index"]], out[q["restriction_other"]]))
            if q["where"]:
                keep = self.params[q["where"]["parameter"]].filter(F.col("value") == {"true": 1.0, "false": 0.0}.get(q["where"]["equals"], None) if q["where"]["equals"] in ("true", "false") else F.col("value") == float(q["where"]["equals"]))
                out = out.join(keep.select(F.col("k0").alias(q["index"])), q["index"], "left_semi")
        out = self._product([]) if out is None else out
        names = [q["index"] for q in c["quantifiers"]]
        return out.withColumn("row", F.concat_ws("_", F.lit(c["name"]), *[F.concat(F.lit(n), F.col(n).cast("string")) for n in names]))

    def _occurrences(self, rows: DataFrame, t, scope: list[str], side: int) -> tuple[DataFrame, DataFrame | None]:
        """(row, var (null: a constant), coef of the term in each instance; rows that it makes degenerate)."""
        if t["operator"] not in ("none", "sum"):
            raise Unsupported(f"operator {t['operator']}")
        if t["operator"] == "sum":
            for b in t["bindings"]:
                if (base := _base(b["expr"])) not in scope:
                    rows, scope = rows.crossJoin(self._range(b["index"], base)), [*scope, base]
        keys = []
        for b in t["bindings"]:
            base, wrap = _base(b["expr"]), b["modulo"] or (b["index"] if b["index"] in self.cyclic else None)
            size = F.lit(self.cards[wrap or b["index"]])
            keys.append(shifted(F.col(base), b["offset"], size, wrap is not None) if base in scope else F.lit(None).cast("long"))
        names = [f"_k{i}" for i in range(len(keys))]
        rows = rows.withColumns(dict(zip(names, keys)))
        outside = reduce(lambda a, b: a | b, [F.col(n).isNull() for n in names], F.lit(False))
        lost = rows.filter(outside).select("row").distinct() if names and t["operator"] == "none" else None
        rows = rows.filter(~outside).withColumn("_c", F.lit(float(side * t["sign"])))
        if t["ref_kind"] == "literal":
            return rows.select("row", F.lit(None).cast("string").alias("var"), (F.col("_c") * float(t["coefficient"])).alias("coef")), lost
        number = _float(t["coefficient"])
        if number is not None:
            rows = rows.withColumn("_c", F.col("_c") * number)
        else:
            shape = self.shapes.get(t["coefficient"])
            if shape is None:
                raise Unsupported(f"coefficient {t['coefficient']} is not declared")
            if shape and shape != self.shapes.get(t["ref"]) and not set(shape) <= set(scope):
                raise Unsupported(f"coefficient {t['coefficient']}: its index can't be told")
            at = [] if not shape else names if shape == self.shapes.get(t["ref"]) else shape
            rows = self._looked_up(rows, t["coefficient"], at)
        if t["ref_kind"] == "parameter":
            rows = self._looked_up(rows, t["ref"], names)
            return rows.select("row", F.lit(None).cast("string").alias("var"), F.col("_c").alias("coef")), lost
        return rows.select("row", _name(t["ref"], [F.col(n) for n in names]).alias("var"), F.col("_c").alias("coef")), lost

    def _looked_up(self, rows: DataFrame, param: str, keys: list[str]) -> DataFrame:
        table = self.params[param].select(*[F.col(f"k{i}").alias(f"_p{i}") for i in range(len(keys))], F.col("value").alias("_v"))
        on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_p{i}") for i, k in enumerate(keys)], F.lit(True))
        met = rows.join(table, on) if keys else rows.crossJoin(F.broadcast(table.limit(1)))
        return met.withColumn("_c", F.col("_c") * F.col("_v")).drop("_v", *[f"_p{i}" for i in range(len(keys))])

    def matrix(self) -> tuple[DataFrame, DataFrame]:
        """(rows: row, comparator, rhs; coefs: row, var, coef). Degenerate instances are left out; the objective is the row named objective."""
        flat, rows, lost = [], [], []
        for c in self.f["constraints"]:
            own, scope = self.instances(c), [q["index"] for q in c["quantifiers"]]
            rows.append(own.select("row", F.lit(c["comparator"]).alias("comparator")))
            for side, terms in ((1, c["lhs"]), (-1, c["rhs"])):
                for t in terms:
                    x, y = self._occurrences(own, t, scope, side)
                    flat.append(x)
                    lost += [y] if y is not None else []
        if self.f["objective"]:
            goal = self._product([]).withColumn("row", F.lit("objective"))
            rows.append(goal.select("row", F.lit(self.f["objective"]["sense"]).alias("comparator")))
            flat += [self._occurrences(goal, t, [], 1)[0] for t in self.f["objective"]["terms"]]
        union = lambda x: reduce(DataFrame.unionByName, x)
        sums = union(flat).groupBy("row", "var").agg(F.round(F.sum("coef"), 9).alias("coef"))
        keep = union(rows)
        if lost:
            keep = keep.join(union(lost).filter("row != 'objective'").distinct(), "row", "left_anti")
        constant = sums.filter("var IS NULL").select("row", F.col("coef").alias("constant"))
        rhs = F.coalesce(F.col("constant"), F.lit(0.0))
        out = keep.join(constant, "row", "left").select("row", "comparator", F.when(F.col("row") == "objective", rhs).otherwise(0.0 - rhs).alias("rhs"))
        return out, sums.filter("var IS NOT NULL AND coef != 0").join(keep.select("row"), "row", "left_semi").select("row", "var", "coef")

    def view(self) -> DataFrame:
        """id, cls, label, degenerate of the instance graph's nodes: here instances with a reference outside its axis stay, marked."""
        parts = []
        for v in self.f["variables"]:
            keys = [f"k{i}" for i in range(len(v["shape"]))]
            rows = self._product(list(zip(v["shape"], keys)))
            ident = F.concat_ws("_", F.lit(f"varinst:{v['name']}"), *[F.concat(F.lit(s), F.col(k).cast("string")) for s, k in zip(v["shape"], keys)])
            label = F.concat(F.lit(v["name"]), F.lit("["), F.concat_ws(",", *keys), F.lit("]")) if keys else F.lit(v["name"])
            parts.append(rows.select(ident.alias("id"), F.lit("variable").alias("cls"), label.alias("label"), F.lit(False).alias("degenerate")))
        for c in self.f["constraints"]:
            own, scope = self.instances(c), [q["index"] for q in c["quantifiers"]]
            lost = [y for side, terms in ((1, c["lhs"]), (-1, c["rhs"])) for t in terms for y in [self._occurrences(own, t, scope, side)[1]] if y is not None]
            rows = own.select("row")
            if lost:
                rows = rows.join(reduce(DataFrame.unionByName, lost).distinct().withColumn("_l", F.lit(True)), "row", "left")
            else:
                rows = rows.withColumn("_l", F.lit(None).cast("boolean"))
            parts.append(rows.select(F.concat(F.lit("cinst:"), "row").alias("id"), F.lit("constraint").alias("cls"), F.col("row").alias("label"), F.coalesce("_l", F.lit(False)).alias("degenerate")))
        if self.f["objective"]:
            parts.append(self._product([]).select(F.lit("objinst:0").alias("id"), F.lit("objective").alias("cls"), F.lit(self.f["objective"]["name"]).alias("label"), F.lit(False).alias("degenerate")))
        return reduce(DataFrame.unionByName, parts)

    def edges(self) -> DataFrame:
        """src, dst, type, role, label, sign, coefficient of the instance graph: instances of constraints and the objective to instances of
        variables. A sum has its index families as names of its scope; what lies outside an axis has no edge."""
        parts = []
        for c in self.f["constraints"]:
            own, scope = self.instances(c), [q["index"] for q in c["quantifiers"]]
            own = own.withColumn("src", F.concat(F.lit("cinst:"), "row"))
            parts += [self._term_edges(own, t, scope, f"{side}[{i}]", "ground_var_in_constraint") for side in ("lhs", "rhs") for i, t in enumerate(c[side])]
        if self.f["objective"]:
            goal = self._product([]).withColumn("src", F.lit("objinst:0"))
            parts += [self._term_edges(goal, t, [], f"obj[{i}]", "ground_var_in_objective") for i, t in enumerate(self.f["objective"]["terms"])]
        return reduce(DataFrame.unionByName, [p for p in parts if p is not None])

    def _term_edges(self, rows: DataFrame, t, scope: list[str], label: str, kind: str) -> DataFrame | None:
        if t["ref_kind"] != "variable":
            return None
        if t["operator"] == "sum":
            for k in t["operator_over"]:
                rows, scope = rows.drop(k).crossJoin(self._range(k, k)), [*scope, k]
        keys = {}
        for b in t["bindings"]:
            wrap = b["modulo"] or (b["index"] if b["index"] in self.cyclic else None)
            base = _base(b["expr"])
            keys[b["index"]] = shifted(F.col(base), b["offset"], F.lit(self.cards[wrap or b["index"]]), wrap is not None) if base in scope else F.lit(None).cast("long")
        shape = self.shapes[t["ref"]]
        dst = F.concat_ws("_", F.lit(f"varinst:{t['ref']}"), *[F.concat(F.lit(s), keys.get(s, F.lit(None)).cast("string")) for s in shape])
        inside = reduce(lambda a, b: a & b, [k.isNotNull() for k in keys.values()], F.lit(True))
        return rows.filter(inside).select("src", dst.alias("dst"), F.lit(kind).alias("type"), F.lit(t["role"]).cast("string").alias("role"), F.lit(label).alias("label"), F.lit(t["sign"]).alias("sign"), F.lit(t["coefficient"]).alias("coefficient"))

    def model(self) -> Model:
        """All of it on the driver, for the small programs that solve() takes."""
        rows, coefs = self.matrix()
        m = Model(self.f["id"])
        for v in self.variables().orderBy("var").collect():
            m.variables[v["var"]] = Variable(v["var"], v["domain"], v["lower"], v["upper"])
        of: dict[str, dict[str, float]] = {}
        for t in coefs.orderBy("row", "var").collect():
            of.setdefault(t["row"], {})[t["var"]] = t["coef"]
        for r in rows.orderBy("row").collect():
            if r["row"] == "objective":
                m.sense, m.objective, m.constant = r["comparator"], of.get("objective", {}), r["rhs"]
            else:
                m.rows.append(Row(r["row"], of.get(r["row"], {}), r["comparator"], r["rhs"]))
        return m


def _float(x: str) -> float | None:
    try:
        return float(x)
    except ValueError:
        return None

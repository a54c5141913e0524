"""Grounding: quantifiers over index domains, bindings with offsets, sums, and the sparse matrix of a model.

A domain is a table of (value, attributes). What the output holds is the product of its quantifiers'
domains, less what restrictions and filters drop; nothing else is multiplied out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESTRICTIONS = {
    "none": lambda own, other: F.lit(True),
    "ne_other": lambda own, other: own != other,
    "lt_other": lambda own, other: own < other,
    "le_other": lambda own, other: own <= other,
    "gt_other": lambda own, other: own > other,
    "ge_other": lambda own, other: own >= other,
    "ordered_pair": lambda own, other: own < other,
}


def domain(df: DataFrame, key: str, index: str) -> DataFrame:
    return df.select(F.col(key).alias(index)).distinct()


def quantify(domains: list[tuple[str, DataFrame, str, str | None]]) -> DataFrame:
    """All index tuples of the quantifiers (index, domain, restriction, the index it compares with), left to right."""
    out = None
    for index, values, restriction, other in domains:
        values = values.select(F.col(values.columns[0]).alias(index))
        if out is None:
            out = values
        elif restriction == "none":
            out = out.crossJoin(values)
        else:
            out = out.join(values, RESTRICTIONS[restriction](values[index], out[other]))
    return out


def where_equals(tuples: DataFrame, index: str, values: DataFrame, key: str, value: str, equals) -> DataFrame:
    """Tuples whose index has the parameter value `equals`: an equi-join, its filter before it."""
    keep = values.filter(F.col(value).cast("double") == float(equals)).select(F.col(key).alias(index)).distinct()
    return tuples.join(keep, index, "left_semi")


def shifted(value: Column, offset: int, size: Column, cyclic: bool) -> Column:
    """The position that a binding with an offset stands for; null outside an axis that is not cyclic."""
    at = value + offset
    return F.pmod(at, size) if cyclic else F.when((at >= 0) & (at < size), at)


def instances(tuples: DataFrame, references: dict[str, Column]) -> DataFrame:
    """Each instance with its resolved references and degenerate: whether any is outside its axis."""
    out = tuples.withColumns(references)
    return out.withColumn("degenerate", reduce(lambda a, b: a | b, [F.col(n).isNull() for n in references]))


def coefficients(terms: DataFrame, by: list[str], value: Column) -> DataFrame:
    """The sparse matrix: coefficients of equal (row, variable) added up, zeros dropped."""
    return terms.groupBy(*by).agg(F.round(F.sum(value), 6).alias("coef")).filter("coef != 0")


def normalized(lhs: DataFrame, rhs: DataFrame, by: list[str], value: str) -> DataFrame:
    """lhs - rhs in one row form."""
    both = lhs.select(*by, F.col(value).alias("_v")).unionByName(rhs.select(*by, (-F.col(value)).alias("_v")))
    return coefficients(both, by, F.col("_v"))

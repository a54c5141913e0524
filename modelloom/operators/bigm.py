"""Tightest constants for indicator rows over a box of bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def extremum(terms: DataFrame, by: list[str], coef: Column, lower: Column, upper: Column, largest: bool) -> DataFrame:
    """The greatest (least) value of sum coef * x over the box; null if a bound that it needs is missing. Zero coefficients need none."""
    edge = F.when((coef > 0) == F.lit(largest), upper).otherwise(lower)
    used = coef != 0
    total = F.sum(F.when(used, coef * edge).otherwise(0.0))
    return terms.groupBy(*by).agg(F.when(~F.bool_or(used & edge.isNull()), total).alias("extremum"))


def big_m(rows: DataFrame) -> DataFrame:
    """rows: row, comparator (le, ge, eq), rhs, hi, lo (extrema of the left side), active (0 or 1).

    Each row becomes one inequality for each side that holds: body <= rhs + M (1 - b) for le, body >= rhs - M (1 - b)
    for ge, with b in place of 1 - b if active is 0. coef is that of b in the body, bound the new right side.
    """
    sides = F.explode(F.when(F.col("comparator") == "eq", F.array(F.lit("le"), F.lit("ge"))).otherwise(F.array("comparator")))
    out = rows.withColumn("side", sides)
    m = F.greatest(F.lit(0.0), F.when(F.col("side") == "le", F.col("hi") - F.col("rhs")).otherwise(F.col("rhs") - F.col("lo")))
    sign = F.when(F.col("side") == "le", 1).otherwise(-1)
    on = F.col("active") == 1
    out = out.withColumn("m", m)
    return out.select("row", "side", "m", (F.when(on, sign).otherwise(-sign) * F.col("m")).alias("coef"), (F.col("rhs") + F.when(on, sign * F.col("m")).otherwise(0.0)).alias("bound"))

"""Validation: one DataFrame of findings for each rule, and a verdict over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def undeclared(references: DataFrame, reference: str, declared: DataFrame, name: str, code: str) -> DataFrame:
    """code, subject: references to what is not declared."""
    missing = references.filter(F.col(reference).isNotNull()).join(declared.select(F.col(name).alias(reference)), reference, "left_anti")
    return missing.select(F.lit(code).alias("code"), F.col(reference).cast("string").alias("subject"))


def unused(declared: DataFrame, name: str, references: DataFrame, reference: str, code: str) -> DataFrame:
    rest = declared.join(references.select(F.col(reference).alias(name)), name, "left_anti")
    return rest.select(F.lit(code).alias("code"), F.col(name).cast("string").alias("subject"))


def duplicates(df: DataFrame, name: str, code: str = "duplicate-names") -> DataFrame:
    return df.groupBy(name).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(code).alias("code"), F.col(name).cast("string").alias("subject"), "n")


def bound_conflicts(df: DataFrame, name: str, lower: str, upper: str) -> DataFrame:
    return df.filter(F.col(lower) > F.col(upper)).select(F.lit("bound-conflict").alias("code"), F.col(name).cast("string").alias("subject"))


def verdict(findings: DataFrame, subject: str = "source") -> DataFrame:
    """findings: source, level (ok, info, warn, error)."""
    worst = F.max(F.when(F.col("level") == "error", 2).when(F.col("level") == "warn", 1).otherwise(0))
    return findings.groupBy(subject).agg(worst.alias("w")).select(subject, F.when(F.col("w") == 2, "invalid").when(F.col("w") == 1, "valid_with_warnings").otherwise("valid").alias("verdict"))

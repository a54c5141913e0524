"""The labelling loop over tables: rules and a classifier decide, answers come as a table, decisions are rows of a log.

Only the classifier is fitted on the driver, on a bounded sample; it judges entities in Spark. Labels are what replaying the log gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modelloom.operators import mining
from modelloom.operators.grouped import LinearSvm
from modelloom.operators.tables import cut

#: Labelled entities that a classifier is fitted on at most, those of least hash.
MOST = 5_000
LOG = "loop int, entity string, gate string, value string, source string, confidence double"


def labels(log: DataFrame) -> DataFrame:
    """entity, value, source, confidence: the last record of each entity that took effect."""
    kept = log.filter((F.col("gate") != "defer") & F.col("value").isNotNull() & F.col("source").isNotNull())
    return mining.latest(kept.select("entity", "loop", "value", "source", "confidence"), "entity", ["loop"]).drop("loop")


def fitted(features: DataFrame, known: DataFrame, most: int = MOST, seed: int = 0) -> LinearSvm | None:
    """features: id, feature, value; known: id, label."""
    some = known.orderBy(F.xxhash64("id"), "id").limit(most)
    rows = features.join(F.broadcast(some), "id").groupBy("id", "label").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("f")).orderBy("id").collect()
    return LinearSvm(seed=seed).fit([dict(r["f"]) for r in rows], [r["label"] for r in rows]) if rows else None


def guesses(features: DataFrame, model: LinearSvm) -> DataFrame:
    """id, guess, sure of each entity that has a feature."""
    bags = features.groupBy("id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("feature", "value")))).alias("f"))

    def run(batches):
        import json

        import pandas as pd

        for pdf in batches:
            found = [model.predict(json.loads(f)) for f in pdf["f"]]
            yield pd.DataFrame({"id": pdf["id"], "guess": [g for g, _ in found], "sure": [float(c) for _, c in found]})

    return bags.mapInPandas(run, "id string, guess string, sure double")


def decided(features: DataFrame, rules: DataFrame, model: LinearSvm | None, answers: DataFrame, loop: int) -> DataFrame:
    """Rows of the log, one for each entity of features. rules: feature, label, confidence; answers: id, label."""
    fired = mining.apply_rules(features, rules).select("id", F.col("label").alias("rule"), F.col("confidence").alias("rule_sure"), "conflict")
    base = features.select("id").distinct().join(fired, "id", "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))
    guess = guesses(features, model) if model else features.sparkSession.createDataFrame([], "id string, guess string, sure double")
    met = base.join(guess, "id", "left").join(answers.select("id", F.col("label").alias("answer")), "id", "left")
    met = met.withColumn("gate", mining.gate(F.col("rule"), F.col("conflict"), F.col("guess"), F.coalesce("sure", F.lit(0.0)), F.lit(model is not None)))
    by_rule, asked = (F.col("gate") == "auto") & F.col("rule").isNotNull(), (F.col("gate") == "adjudicate") & F.col("answer").isNotNull()
    source = F.when(by_rule, "rule").when(F.col("gate") == "auto", "clf").when(asked, "human")
    value = F.when(by_rule, F.col("rule")).when(F.col("gate") == "auto", F.col("guess")).when(asked, F.col("answer"))
    confidence = F.when(by_rule, F.col("rule_sure")).when(asked, 1.0).otherwise(F.coalesce("sure", F.lit(0.0)))
    return met.select(F.lit(loop).alias("loop"), F.col("id").alias("entity"), "gate", value.alias("value"), source.alias("source"), confidence.cast("double").alias("confidence"))


def promoted(features: DataFrame, answered: DataFrame, rules: DataFrame, confidence: float = 0.9) -> DataFrame:
    """New rules: concepts all of whose answered entities have one label. answered: id, label."""
    per = features.filter(F.col("feature").startswith("concept:")).join(answered, "id").groupBy("feature").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    one = per.filter("label = other").select("feature", "label", F.lit(confidence).alias("confidence"))
    return one.join(rules.select("feature", "label"), ["feature", "label"], "left_anti")


def guardrails(loops: DataFrame) -> DataFrame:
    """loop, precision, previous, delta, rollback: back goes a loop whose precision is less than the one's before. loops: loop, precision; a row for each loop."""
    previous = F.lag("precision").over(Window.orderBy("loop"))
    out = loops.select("loop", "precision", previous.alias("previous")).withColumn("delta", F.col("precision") - F.col("previous"))
    return out.withColumn("rollback", F.coalesce(F.col("delta") < 0, F.lit(False)))


def precision(gold: DataFrame, known: DataFrame) -> DataFrame:
    """One row, precision: of the gold entities that have a label, the share that has the right one; 1 if none has any. gold: id, label."""
    met = gold.join(known.select(F.col("entity").alias("id"), "value"), "id")
    return met.agg(F.coalesce(F.avg((F.col("label") == F.col("value")).cast("double")), F.lit(1.0)).alias("precision"))


def run_loop(features: DataFrame, log: DataFrame, rules: DataFrame, model: LinearSvm | None, answers: DataFrame, gold: DataFrame, history: DataFrame) -> dict:
    """One loop over the entities without a label: log, rules, model and history (loop, precision) as they are after it, and whether it was rolled back."""
    loop = history.count()
    todo = features.join(labels(log).select(F.col("entity").alias("id")), "id", "left_anti")
    new = cut(decided(todo, rules, model, answers, loop))
    log = log.unionByName(new)
    known = cut(labels(log))
    more = cut(promoted(features, new.filter("source = 'human'").select(F.col("entity").alias("id"), F.col("value").alias("label")), rules))
    learnt = known.filter("source IN ('rule', 'human')").select(F.col("entity").alias("id"), F.col("value").alias("label"))
    history = cut(history.unionByName(precision(gold, known).select(F.lit(loop).alias("loop"), "precision")))
    back = guardrails(history).filter(F.col("loop") == loop).first()["rollback"]
    return {"log": log, "rules": rules if back else cut(rules.unionByName(more)), "model": model if back else fitted(features, learnt) or model, "history": history, "rolled_back": back}

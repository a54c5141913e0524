"""Vectorizing, comparing, labelling: TF-IDF, silhouettes, agreement, rules, gates and label logs."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelloom.functions import lexical
from modelloom.functions import vectors as V
from modelloom.operators.tables import cut


def concept_bags(texts: DataFrame) -> DataFrame:
    """doc, concept, tf. texts: doc, text. Tokens are counted first, and lemmas and concepts looked up once for each token of a
    document; only documents with both words of some phrase are folded word by word."""
    parts = texts.select("doc", F.explode_outer(lexical.split_compounds(F.col("text"))).alias("token"))
    counts = parts.filter(F.col("token").isNotNull() & lexical.is_token(F.col("token"))).groupBy("doc", "token").agg(F.count("*").alias("n"))
    lemmas = counts.select("doc", lexical.lemmatize(F.col("token")).alias("lemma"), "n")
    index = lexical.phrase_index()
    pairs = [k.split(" ") for k in index if " " in k]
    met = F.collect_set("lemma").alias("met")
    both = reduce(lambda a, b: a | b, [F.array_contains("met", a) & F.array_contains("met", b) for a, b in pairs])
    folded = lemmas.filter(F.col("lemma").isin(sorted({w for p in pairs for w in p}))).groupBy("doc").agg(met).filter(both).select("doc")
    single = texts.sparkSession.createDataFrame([(k, v) for k, v in index.items() if " " not in k], "lemma string, concept string")  # the thesaurus
    plain = lemmas.join(folded, "doc", "left_anti").join(F.broadcast(single), "lemma", "left").select("doc", F.coalesce("concept", "lemma").alias("concept"), "n")
    # explode() would evaluate the concepts once more, in a filter that Spark puts before it
    word = texts.join(folded, "doc", "left_semi").select("doc", F.explode_outer(lexical.concepts(F.col("text"))).alias("concept"))
    both = plain.unionByName(word.filter("concept IS NOT NULL").withColumn("n", F.lit(1).cast("long")))
    return both.groupBy("doc", "concept").agg(F.sum("n").alias("tf"))


def vocabulary(bags: DataFrame) -> DataFrame:
    """Distinct concepts in order, with their position. bags: doc, concept. Ranked within first letters, so no task sorts all of them."""
    words = bags.select("concept").distinct().withColumn("head", F.substring("concept", 1, 1))
    heads = words.groupBy("head").agg(F.count("*").alias("n"))
    heads = heads.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("head").orderBy("concept")) - 1
    return words.withColumn("rank", rank).join(heads, "head").select("concept", (F.col("before") + F.col("rank")).alias("position"))


def tf_idf(bags: DataFrame) -> DataFrame:
    """doc, concept, weight: tf * (ln((1 + N) / (1 + df)) + 1), scaled to length 1. bags: doc, concept, tf."""
    bags = cut(bags)  # read three times
    n = bags.select("doc").distinct().agg(F.count("*").alias("n"))
    df = bags.groupBy("concept").agg(F.count_distinct("doc").alias("df"))
    w = bags.join(df, "concept").join(F.broadcast(n)).withColumn("w", F.col("tf") * V.inverse_frequency(F.col("n"), F.col("df")))
    size = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))
    return w.select("doc", "concept", F.when(size > 0, F.col("w") / size).otherwise(0.0).alias("weight"))


def distances(vectors: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """a, b, distance of every pair a < b. vectors: id, vec. The result is as large as the pairs: for the sets that are clustered."""
    size = F.sqrt(V.dot(F.col("vec"), F.col("vec")))  # once for each vector, not for each pair
    a = vectors.select(F.col("id").alias("a"), F.col("vec").alias("va"), size.alias("na"))
    b = (others or vectors).select(F.col("id").alias("b"), F.col("vec").alias("vb"), size.alias("nb"))
    cosine = F.when(F.col("na") * F.col("nb") == 0, 0.0).otherwise(V.dot(F.col("va"), F.col("vb")) / (F.col("na") * F.col("nb")))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - cosine)).alias("distance"))


#: Vectors of a block: two of them are one key of label_distances, so its square is the rows of a task at once.
PAIR_BLOCK = 1024


def _block_distances(table: pa.Table) -> pa.Table:
    """All pairs of two blocks of a label, or of one. table: id, vec, label, own, p, q."""
    ids, vecs = table["id"].combine_chunks(), table["vec"].to_pylist()
    own, p, q = table["own"].to_numpy(), table["p"][0].as_py(), table["q"][0].as_py()
    length = np.array([-1 if v is None else len(v) for v in vecs])
    x = np.zeros((len(vecs), max(1, length.max())))
    for n in np.unique(length[length > 0]):
        at = np.flatnonzero(length == n)
        x[at, :n] = np.array([vecs[i] for i in at], float)  # a null in a vector is no number
    x[length < 0] = np.nan
    size = np.sqrt(np.einsum("ij,ij->i", x, x))
    left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
    key = ids.to_numpy(zero_copy_only=False)
    with np.errstate(all="ignore"):
        sizes = size[left, None] * size[right]
        d = np.where(sizes == 0, 1.0, 1 - x[left] @ x[right].T / sizes)
        d[(length[left, None] != length[right]) & (sizes != 0)] = np.nan
        # As cosine_distance has it: what is no number is at 2.
        d = np.where(np.isnan(d), 2.0, np.clip(d, 0, 2))
    i, j = np.nonzero(key[left, None] < key[right] if p == q else key[left, None] != key[right])
    a, b, distance = left[i], right[j], d[i, j]
    if p != q:
        swap = key[a] > key[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
    return pa.table({"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b)), "distance": np.floor(distance * 1e6 + 0.5) / 1e6})


def label_distances(vectors: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """a, b, distance (to 6 digits) of every pair a < b of one label. vectors: id, vec, label.

    The result is as large as the pairs. A label's vectors are dealt to blocks of about `block`, and two blocks are a key, so a
    large label is no task of its own, and a task's pairs are one product of matrices."""
    vectors = vectors.filter("id IS NOT NULL AND label IS NOT NULL")
    many = vectors.groupBy("label").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = vectors.join(many, "label").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("id", "vec", "label", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    # By number, as rows in say little of rows out; and dealt anew, as being dealt by label would do for the groups.
    dealt = dealt.repartition(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), "label", "p", "q")
    kind = vectors.schema["id"].dataType.simpleString()
    return dealt.groupBy("label", "p", "q").applyInArrow(_block_distances, f"a {kind}, b {kind}, distance double")


def sparse_distances(weights: DataFrame) -> DataFrame:
    """a, b, distance of pairs that share a concept (all others are at 1). weights: doc, concept, weight, of length 1."""
    a = weights.select(F.col("doc").alias("a"), "concept", F.col("weight").alias("wa"))
    b = weights.select(F.col("doc").alias("b"), "concept", F.col("weight").alias("wb"))
    dot = a.join(b, "concept").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    return dot.select("a", "b", F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - F.col("dot"))).alias("distance"))


def silhouettes(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """id, silhouette. pairs: a < b, distance; labels: id, label. A cluster of one, or only one cluster: 0."""
    both = pairs.select("a", "b", "distance").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    own = labels.select(F.col("id").alias("a"), F.col("label").alias("la"))
    other = labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    mean = both.join(own, "a").join(other, "b").groupBy("a", "la", "lb").agg(F.avg("distance").alias("mean"))
    sides = mean.groupBy("a").agg(F.max(F.when(F.col("la") == F.col("lb"), F.col("mean"))).alias("inner"), F.min(F.when(F.col("la") != F.col("lb"), F.col("mean"))).alias("outer"))
    s = (F.col("outer") - F.col("inner")) / F.greatest("outer", "inner")
    s = F.when(F.col("inner").isNull() | F.col("outer").isNull() | (F.greatest("outer", "inner") == 0), 0.0).otherwise(s)
    return own.join(sides, "a", "left").select(F.col("a").alias("id"), F.coalesce(s, F.lit(0.0)).alias("silhouette"))


#: Sums of all labels, in bytes, that may go to each executor.
MOST_SUMS = 32 << 20


def label_silhouettes(vectors: DataFrame) -> DataFrame:
    """id, label, silhouette by cosine distance. vectors: id, vec, label. A label of one, or only one label: 0.

    No pair is made: the mean distance of a vector to a label's is 1 less its product with the mean of their unit vectors. The
    sums of all labels are one row, broadcast if it is of a checked size; beyond, the pairs' way (silhouettes) is for few vectors."""
    size = F.sqrt(V.dot(F.col("vec"), F.col("vec")))
    unit = vectors.select("id", "label", F.transform("vec", lambda x: F.when(size > 0, x / size).otherwise(0.0).cast("double")).alias("u"))
    sums = unit.select("label", F.posexplode("u").alias("pos", "x")).groupBy("label", "pos").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    sums = sums.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("sum"), F.max("n").alias("n"))
    sums = cut(sums)
    needed = sums.agg(F.coalesce(F.sum(8 * F.size("sum") + 64), F.lit(0))).first()[0]
    if needed > MOST_SUMS:
        raise ValueError(f"label_silhouettes: the sums of all labels take {needed} bytes, over {MOST_SUMS}")
    every = sums.agg(F.collect_list(F.struct("label", "sum", "n")).alias("every"))
    own, other = F.filter("every", lambda g: g["label"] == F.col("label")), F.filter("every", lambda g: g["label"] != F.col("label"))
    met = unit.join(F.broadcast(every)).withColumn("own", F.get(own, 0)).withColumn("others", other)
    rest = F.col("own.n") - 1
    inner = F.when(rest > 0, (rest - V.dot(F.col("u"), F.col("own.sum")) + V.dot(F.col("u"), F.col("u"))) / rest)
    outer = F.array_min(F.transform("others", lambda g: 1 - V.dot(F.col("u"), g["sum"]) / g["n"]))
    floor = lambda c: F.when(c.isNotNull(), F.greatest(F.lit(0.0), c))  # noqa: E731 - greatest() would take a null for 0
    met = met.select("id", "label", floor(inner).alias("inner"), floor(outer).alias("outer"))
    s = (F.col("outer") - F.col("inner")) / F.greatest("outer", "inner")
    none = F.col("inner").isNull() | F.col("outer").isNull() | (F.greatest("outer", "inner") == 0)
    return met.select("id", "label", F.when(none, 0.0).otherwise(s).alias("silhouette"))


def adjusted_rand(pairs: DataFrame) -> DataFrame:
    """One row, ari, of two labellings of the same items. pairs: x, y. No items, or nothing to expect: 1."""
    cells = pairs.groupBy("x", "y").agg(F.count("*").alias("n"))
    both = cells.agg(F.sum(V.pairs_of(F.col("n"))).alias("both"), F.sum("n").alias("all"))
    side = lambda c: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(V.pairs_of(F.col("n"))).alias(f"by_{c}"))
    m = both.join(side("x")).join(side("y"))  # one row each
    expected = F.col("by_x") * F.col("by_y") / V.pairs_of(F.col("all"))
    most = (F.col("by_x") + F.col("by_y")) / 2
    plain = (F.coalesce("all", F.lit(0)) <= 1) | (most == expected)
    return m.select(F.round(F.when(plain, 1.0).otherwise((F.col("both") - expected) / (most - expected)), 9).alias("ari"))


def cohen_kappa(pairs: DataFrame) -> DataFrame:
    """One row, kappa, of two raters. pairs: x, y. No items, or chance agreement of 1: 1."""
    cells = pairs.groupBy("x", "y").agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    x = cells.groupBy(F.col("x").alias("label")).agg(F.sum("n").alias("nx"))
    y = cells.groupBy(F.col("y").alias("label")).agg(F.sum("n").alias("ny"))
    chance = x.join(y, "label").agg(F.coalesce(F.sum(F.col("nx") * F.col("ny")), F.lit(0)).alias("by_chance"))
    po, pe = F.col("same") / F.col("all"), F.col("by_chance") / (F.col("all") * F.col("all"))
    return total.join(chance).select(F.round(F.when(F.coalesce("all", F.lit(0)) == 0, 1.0).when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)), 9).alias("kappa"))


def distribution(df: DataFrame, label: str) -> DataFrame:
    n = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return n.select("label", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def drift(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """One row, drift: half the sum of the differences of the two distributions."""
    p, q = distribution(before, label), distribution(after, label).withColumnRenamed("share", "other")
    return p.join(q, "label", "full").agg(F.round(F.coalesce(F.sum(F.abs(F.coalesce("share", F.lit(0.0)) - F.coalesce("other", F.lit(0.0)))), F.lit(0.0)) / 2, 9).alias("drift"))


def gold_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """label, tp, fp, fn. gold: id, label; predicted: id, label. No prediction is a miss of the gold label alone."""
    m = gold.join(predicted.select("id", F.col("label").alias("guess")), "id", "left")
    hit = F.col("label") == F.col("guess")
    rows = m.select(F.explode(F.when(F.col("guess").isNull(), F.array(F.struct(F.col("label"), F.lit(0).alias("tp"), F.lit(0).alias("fp"), F.lit(1).alias("fn")))).when(
        hit, F.array(F.struct(F.col("label"), F.lit(1).alias("tp"), F.lit(0).alias("fp"), F.lit(0).alias("fn"))),
    ).otherwise(F.array(
        F.struct(F.col("label"), F.lit(0).alias("tp"), F.lit(0).alias("fp"), F.lit(1).alias("fn")),
        F.struct(F.col("guess").alias("label"), F.lit(0).alias("tp"), F.lit(1).alias("fp"), F.lit(0).alias("fn")),
    ))).alias("r"))
    return rows.groupBy(F.col("r.label").alias("label")).agg(*[F.sum(f"r.{c}").alias(c) for c in ("tp", "fp", "fn")])


def apply_rules(features: DataFrame, rules: DataFrame) -> DataFrame:
    """id, label, confidence, conflict of the rules that fire. features: id, feature; rules: feature, label, confidence."""
    fired = features.join(rules, "feature").groupBy("id").agg(F.sort_array(F.collect_set("label")).alias("labels"), F.max("confidence").alias("confidence"))
    conflict = F.size("labels") > 1
    return fired.select("id", F.when(~conflict, F.col("labels")[0]).alias("label"), F.when(~conflict, F.col("confidence")).alias("confidence"), conflict.alias("conflict"))


def gate(rule_label: Column, conflict: Column, model_label: Column, confidence: Column, trained: Column, sure: float = 0.7, unsure: float = 0.4) -> Column:
    """auto, adjudicate or defer."""
    agree = rule_label.isNull() | (rule_label == model_label)
    return (
        F.when(~trained, F.when(rule_label.isNotNull() & ~conflict, "auto").otherwise("adjudicate"))
        .when(conflict, "adjudicate")
        .when((confidence >= sure) & agree, "auto")
        .when(confidence < unsure, "defer")
        .otherwise("adjudicate")
    )


def latest(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last record of each key: an aggregate, so only one record of a key leaves each task."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def replay(log: DataFrame) -> DataFrame:
    """Records that took effect: not deferred, with a value and a source; human 1.0, rules 0.9, otherwise the model's confidence."""
    kept = log.filter((F.col("gate") != "defer") & F.col("value").isNotNull() & F.col("source").isNotNull())
    return kept.withColumn("confidence", F.when(F.col("source") == "human", 1.0).when(F.col("source") == "rule", 0.9).otherwise(F.col("confidence")))


def top_per_group(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_rank") <= k).withColumnRenamed("_rank", "rank")


def unique_names(df: DataFrame, base: str, order: str) -> DataFrame:
    """The second and later of one base get _2, _3, ... in order."""
    nth = F.row_number().over(Window.partitionBy(base).orderBy(order))
    return df.withColumn("name", F.when(nth == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("_"), nth)))

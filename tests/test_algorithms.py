import random

import numpy as np
import pytest

from modelloom.functions import lexical as L
from modelloom.functions import vectors as V
from modelloom.operators import checks, corpus, grouped, metrics, mining
from pyspark.sql import functions as F


def test_average_linkage_by_hand():
    d = np.array([[0, 0.1, 0.9, 0.9], [0.1, 0, 0.9, 0.9], [0.9, 0.9, 0, 0.2], [0.9, 0.9, 0.2, 0]])
    assert grouped.average_linkage(d) == [0, 0, 1, 1]
    assert grouped.average_linkage(d, k=1) == [0, 0, 0, 0] and grouped.average_linkage(d, threshold=0.15) == [0, 0, 1, 2]


def test_rand_index():
    assert grouped.rand_index([0, 0, 1, 1], [5, 5, 7, 7]) == 1 and grouped.rand_index([], []) == 1
    assert grouped.rand_index([0, 0, 1, 1], [0, 1, 0, 1]) == pytest.approx(-0.5)
    assert grouped.bootstrap(np.zeros((2, 2)), [0, 1], draws=3) == [1.0] * 3


def test_clusters_of_groups(spark):
    rows = [(0, 1, [1.0, 0.0]), (0, 2, [0.9, 0.1]), (0, 3, [0.0, 1.0]), (0, 4, [0.0, 0.0]), (1, 5, [1.0, 1.0])]
    got = {r["id"]: r["cluster"] for r in grouped.cluster_groups(spark.createDataFrame(rows, "grp int, id int, vec array<double>")).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: -1, 5: 0}


def _all_pairs(u, threshold):
    """Clusters by the mean of all distances, each time; equally near ones to 12 digits."""
    d, groups = np.clip(1 - u @ u.T, 0, 2), [[i] for i in range(len(u))]
    while len(groups) > 1:
        least, a, b = min((round(float(d[np.ix_(x, y)].mean()), 12), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
        if least > threshold + 1e-12:
            break
        groups[a] += groups.pop(b)
    at = {i: c for c, g in enumerate(groups) for i in g}
    return [at[i] for i in range(len(u))]


def test_average_linkage_of_vectors_agrees_with_all_pairs():
    rng = np.random.default_rng(2)
    for turn in range(24):
        n, dim = int(rng.integers(1, 24)), int(rng.integers(2, 6))
        v = rng.normal(size=(4, dim))[rng.integers(0, 4, n)] + rng.normal(size=(n, dim)) * rng.choice([0, 0.1, 0.5])
        v = np.round(v) if turn % 3 == 0 else v
        v = v[np.linalg.norm(v, axis=1) > 0]
        u = v / np.linalg.norm(v, axis=1)[:, None]
        for threshold in (0.1, 0.7, 2.5):
            assert grouped.average_linkage_of(u, threshold) == _all_pairs(u, threshold)
    assert grouped.average_linkage_of(np.zeros((0, 3))) == []


def test_large_group_is_clustered_without_its_pairs():
    import tracemalloc

    rng = np.random.default_rng(3)
    v = rng.normal(size=(40, 16))[np.arange(3000) % 40] + rng.normal(size=(3000, 16)) * 0.05
    tracemalloc.start()
    got = grouped.average_linkage_of(v / np.linalg.norm(v, axis=1)[:, None])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len({tuple(got[i::40]) for i in range(40)}) <= 40 and all(len(set(got[i::40])) == 1 for i in range(40))
    assert most < 8 * 3000 * 3000  # less than one matrix of all distances


def test_distances_within_labels_agree_with_columns(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.normal(size=3)], int(i % 3 == 0)) for i in rng.permutation(60)]
    rows += [(60, [0.0] * 3, 0), (61, None, 0), (62, [1.0, 2.0], 0), (63, [1.0, None, 2.0], 0), (64, [], 0), (65, [1.0] * 3, None), (None, [1.0] * 3, 0), (7, [1.0] * 3, 1), (7, [2.0] * 3, 1)]
    v = spark.createDataFrame(rows, "id long, vec array<float>, label int")
    other = v.select(F.col("id").alias("b"), F.col("vec").alias("vb"), "label")
    want = v.join(other, "label").filter("id < b").select(F.col("id").alias("a"), "b", F.round(V.cosine_distance(F.col("vec"), F.col("vb")), 6).alias("distance"))
    for block in (7, 1000):
        got = mining.label_distances(v, block)
        assert got.columns == ["a", "b", "distance"]
        assert sorted((r.a, r.b, f"{r.distance:.5f}") for r in got.collect()) == sorted((r.a, r.b, f"{r.distance:.5f}") for r in want.collect())
    assert mining.label_distances(v.limit(0)).count() == 0


def test_distances_deal_a_large_label_out(spark):
    v = spark.range(400).selectExpr("id", "array(1.0D, CAST(id AS DOUBLE)) AS vec", "1 AS label")
    dealt = mining.label_distances(v, 40)
    assert "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().toString()
    parts = [r.n for r in dealt.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(parts) == 400 * 399 // 2 and len(parts) > 1


def test_linear_svm():
    rows = [{"a": 1.0}, {"b": 1.0}, {"a": 1.0, "c": 1.0}, {"b": 1.0, "c": 1.0}]
    m = grouped.LinearSvm(seed=3).fit(rows, ["x", "y", "x", "y"])
    assert [m.predict(r)[0] for r in rows] == ["x", "y", "x", "y"] and sum(m.probabilities({"a": 1.0}).values()) == pytest.approx(1)
    assert grouped.LinearSvm().predict({"a": 1.0}) == (None, 0.0)


def test_isomorphism_of_renamed_and_changed_graphs():
    rng = random.Random(5)
    nodes = {i: rng.choice("vc") for i in range(9)}
    edges = [(rng.randrange(9), rng.randrange(9), rng.choice("lr")) for _ in range(16)]
    to = dict(zip(range(9), rng.sample(range(100, 200), 9)))
    other = ({to[i]: c for i, c in nodes.items()}, [(to[a], to[b], k) for a, b, k in edges])
    assert grouped.isomorphic((nodes, edges), other)
    changed = [*other[1][:-1], (other[1][-1][0], other[1][-1][1], "z")]
    assert not grouped.isomorphic((nodes, edges), (other[0], changed))


def test_components_and_diameter(spark):
    edges = spark.createDataFrame([(0, i, i + 1) for i in range(1, 12)] + [(0, 20, 21), (1, 1, 2)], "fid int, src long, dst long")
    nodes = edges.select("fid", F.col("src").alias("id")).unionByName(edges.select("fid", F.col("dst").alias("id"))).distinct().withColumn("cls", F.lit("variable"))
    roots = {(r["fid"], r["id"]): r["root"] for r in metrics.components(nodes, edges).collect()}
    assert {roots[0, i] for i in range(1, 13)} == {1} and roots[0, 21] == 20 and roots[1, 2] == 1
    assert {r["fid"]: r["diameter"] for r in metrics.diameter(nodes, edges).collect()} == {0: 11, 1: 1}


def test_duplicates_over_either_key(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "y"), (4, "c", None), (5, None, None)], "id long, k1 string, k2 string")
    got = {r["id"]: (r["group_id"], r["group_size"]) for r in corpus.duplicate_groups(df, "id", ["k1", "k2"]).collect()}
    assert got == {1: (1, 3), 2: (1, 3), 3: (1, 3), 4: (4, 1), 5: (5, 1)}


def test_lexical(spark):
    def one(column, text):
        return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]

    assert one(L.split_compounds, r"\sum rollingStock x_{i,t} t12b") == ["rolling", "stock", "x", "i", "t", "t", "12", "b"]
    assert one(L.tokenize, "The headway of trains is 5 per x") == ["headway", "trains"]
    assert one(L.concepts, "Rolling stock and time separations; delays, dispatching, capacity flow conservations") == ["rolling_stock", "headway", "delay", "rescheduling", "capacity", "flow"]
    for w in ("capacities", "boxes", "loss", "scheduling", "delayed", "indices", "es", "ring", "trains", "buses"):
        assert one(L.lemmatize, w) == L.lemma(w)
    assert one(L.bibliographic_key.__class__ and (lambda c: L.bibliographic_key(c, F.lit(2020), F.lit("A-1"))), "Café–X") == "café x|2020|a 1"
    assert one(lambda c: L.binding_offset(c), "t - 1") == -1 and one(L.binding_base, " i2+1") == "i2"
    assert one(lambda c: L.format_scores(c), "ROWS\nCOLUMNS\n")[0]["format"] == "mps"
    assert one(L.dangling_tail, "x + y +  \n") is True and one(L.repair_unicode, "a ≤ b − c…") == "a <= b - c..."
    assert one(L.fence_blocks, "x\n```lp\nmin\n```\n```\nb\n```") == ["min", "b"]


def test_agreement_edges(spark):
    none = spark.createDataFrame([], "x int, y int")
    assert mining.adjusted_rand(none).first()["ari"] == 1 and mining.cohen_kappa(none).first()["kappa"] == 1
    same = spark.createDataFrame([(1, 1), (1, 1)], "x int, y int")
    assert mining.cohen_kappa(same).first()["kappa"] == 1


def test_checks(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0), ("b", 0.0, 1.0), ("b", None, 1.0)], "name string, lo double, hi double")
    assert [r["subject"] for r in checks.bound_conflicts(df, "name", "lo", "hi").collect()] == ["a"]
    assert [(r["subject"], r["n"]) for r in checks.duplicates(df, "name").collect()] == [("b", 2)]

import numpy as np
import pytest

from modelloom.operators import checks, labelling, metrics, review, taxonomy, views
from modelloom.sources import formulations as fm

LP = "Minimize\n obj: 2 x + 3 y\nSubject To\n c1: x + y >= 4\nBounds\n x <= 3\nEnd\n"


def codes(text, fmt=None):
    return {c[2] for c in review.review(text, fmt)[0]}


def test_reviews_of_noisy_texts(spark):
    assert {"format-detected", "parse-ok", "solve-optimal"} <= codes(LP)
    assert {"markdown-fences", "parse-ok"} <= codes(f"Here:\n```lp\n{LP}```\n")
    assert {"bom-stripped", "nul-bytes"} <= codes(b"\xef\xbb\xbf" + LP.encode() + b"\0")
    assert "not-utf8" in codes(LP.encode() + b"\\ caf\xe9\n")
    assert "unicode-normalized" in codes(LP.replace(">=", "≥"))
    assert codes(" ") == {"empty-input"} and "format-undetected" in codes("hello")
    assert "all-parsers-failed" in codes("Minimize\n obj: x*y\nSubject To\n c: x >= 1\nEnd\n")
    assert "parse-fallback" in codes(LP, "mps")
    assert {"bound-conflict", "solve-infeasible"} <= codes(LP.replace("x <= 3", "5 <= x <= 3"))
    assert "solve-infeasible" in codes(LP.replace("End", " c2: x + y <= 1\nEnd").replace("Bounds\n x <= 3\n", ""))
    assert {"mps-no-endata"} <= codes("NAME a\nROWS\n N o\n G c\nCOLUMNS\n x o 1 c 1\nRHS\n R c 1\n")
    rows = review.reviews(spark.createDataFrame([("a", LP, None), ("b", None, None), ("c", "hello", "lp")], "source string, text string, fmt string"))
    assert {(r.source, r.verdict) for r in checks.verdict(rows).collect()} == {("a", "valid"), ("b", "invalid"), ("c", "invalid")}


def test_taxonomy(spark):
    f = fm.catalog(spark).cache()
    got = taxonomy.induce(f).collect()
    count = {x: len([r for r in got if r.level == x]) for x in ("V", "C", "M", "domain", "solution_approach")}
    assert count == {"V": 22, "C": 7 + 5, "M": 5, "domain": 5, "solution_approach": 5}
    names = {(r.level, r.cluster): set() for r in got}
    for r in got:
        names[r.level, r.cluster].add(r.name)
    assert all(len(v) == 1 for v in names.values())
    assert len({(level, *v) for (level, _), v in names.items()}) == len(names)


def test_select_k():
    d = np.full((6, 6), 0.9)
    for a in ((0, 1), (2, 3), (4, 5)):
        d[np.ix_(a, a)] = 0.1
    np.fill_diagonal(d, 0)
    assert taxonomy.select_k(d)[0] == 3 and taxonomy.select_k(d[:2, :2]) == (1, 0.0)


def test_drawing_and_indices(spark):
    f = fm.catalog(spark).filter("id = 'periodic'")
    nodes, edges = views.schema_nodes(f), views.schema_edges(f)
    text = taxonomy.svg(nodes, edges).first()["svg"]
    assert text.startswith("<svg") and text.count("<circle") == nodes.count() and text.count("<line") == edges.count()
    at = {(r["cls"], r["index"]) for r in taxonomy.local_index(nodes).collect()}
    assert {("variable", 0), ("variable", 1), ("operator", 1)} <= at and len(at) == nodes.count()


def test_loop_learns_and_replays():
    entities = {f"e{i}": {f"concept:{'cost' if i % 2 else 'flow'}": 1.0, f"id:{i}": 1.0} for i in range(12)}
    truth = {e: ("price" if "concept:cost" in f else "network") for e, f in entities.items()}
    asked = []

    def ask(e):
        asked.append(e)
        return truth[e] if len(asked) <= 4 else None

    state = labelling.State()
    first = labelling.run_loop(state, entities, ask, truth)
    assert first["asked"] == 4 and first["promoted"] == 2 and len(state.labels) == 4
    second = labelling.run_loop(state, entities, lambda e: None, truth)
    assert second["labelled"] == 12 and second["precision"] == 1.0 and not second["rolled_back"]
    assert labelling.replay(state.log) == state.labels
    bad = labelling.State(rules=[("concept:cost", "wrong", 0.9)], precision=[1.0])
    assert labelling.run_loop(bad, entities, ask, truth)["rolled_back"] and bad.model is None


def test_gate():
    assert labelling.gate(None, False, "a", 0.8, True) == "auto" and labelling.gate("b", False, "a", 0.8, True) == "adjudicate"
    assert labelling.gate(None, False, "a", 0.3, True) == "defer" and labelling.gate("b", False, None, 0, False) == "auto" and labelling.gate("b", True, "b", 0.9, True) == "adjudicate"


def test_model_features(spark):
    f = fm.catalog(spark).filter("id = 'lots'")
    got = set(taxonomy.model_features(f).first()["facets"])
    assert {"family:milp", "ckind:big_m", "vdom:binary", "flag:big_m", "coherent:1", "complete:1", "cvr_bin:0", "size_bin:0"} <= got and any(x.startswith("diam:") for x in got)


def test_stability(spark):
    near = np.array([[1, 0, 0, 0], [0.9, 0.1, 0, 0], [0, 0, 1, 0], [0, 0, 0.9, 0.1]])
    got = taxonomy.stability(near)
    assert got["silhouette"] > 0.9 and got["ari_mean"] == got["fixed_k"] == 1.0 and got["ari_min"] <= got["ari_max"]
    rows = spark.createDataFrame([("a", i, [float(y) for y in x]) for i, x in enumerate(near)], "grp string, id int, vec array<double>")
    assert taxonomy.stability_report(rows).first()["silhouette"] == pytest.approx(got["silhouette"])


def test_loop_over_tables(spark):
    from modelloom.operators import labelling_tables as lt

    names = [f"e{i}" for i in range(12)]
    truth = {e: "price" if i % 2 else "network" for i, e in enumerate(names)}
    features = spark.createDataFrame([(e, f, 1.0) for i, e in enumerate(names) for f in (f"concept:{'cost' if i % 2 else 'flow'}", f"id:{e}")], "id string, feature string, value double")
    answers = spark.createDataFrame([(e, truth[e]) for e in names[:4]], "id string, label string")
    gold = spark.createDataFrame(list(truth.items()), "id string, label string")
    empty = lambda s: spark.createDataFrame([], s)
    first = lt.run_loop(features, empty(lt.LOG), empty("feature string, label string, confidence double"), None, answers, gold, empty("loop int, precision double"))
    assert not first["rolled_back"] and {(r["feature"], r["label"]) for r in first["rules"].collect()} == {("concept:cost", "price"), ("concept:flow", "network")}
    second = lt.run_loop(features, first["log"], first["rules"], first["model"], empty("id string, label string"), gold, first["history"])
    assert {r["entity"]: r["value"] for r in lt.labels(second["log"]).collect()} == truth and not second["rolled_back"]
    wrong = spark.createDataFrame([("concept:cost", "wrong", 0.9)], "feature string, label string, confidence double")
    third = lt.run_loop(features, empty(lt.LOG), wrong, None, answers, gold, spark.createDataFrame([(0, 1.0)], "loop int, precision double"))
    assert third["rolled_back"] and third["model"] is None and third["rules"].count() == 1


def test_measures_of_documents_are_those_of_any_graph(spark):
    f = fm.catalog(spark).filter("id IN ('lots', 'clashes')")
    nodes, edges = views.schema_nodes(f), views.schema_edges(f).filter("type != 'uses_index'")
    got = {r["fid"]: (r["parts"], r["coherent"], r["diameter"]) for r in metrics.of_documents(nodes, edges).collect()}
    whole = {r["fid"]: (r["parts"], r["coherent"]) for r in metrics.coherence(nodes, edges).collect()}
    far = {r["fid"]: r["diameter"] for r in metrics.diameter(nodes, edges).collect()}
    assert got == {x: (*whole[x], far[x]) for x in whole}

"""Emitters, instances, LaTeX rules, reviews of documents, and the command line."""

import json

import pytest

from modelloom import cli
from modelloom.operators import corpus, grouped, review, signatures, templates, views
from modelloom.sources import emit, formats, instances, latex, latex_rules
from modelloom.sources import formulations as fm
from modelloom.sources.model import FormatError, linear

LP = "Maximize\n obj: 3 x + 2 y + 1\nSubject To\n c1: x + y <= 4\n c2: x - y >= -2\nBounds\n 0 <= x <= 3\nGenerals\n y\nEnd\n"


def test_affine_expressions():
    assert linear("2 3 x") == ({"x": 3.0}, 2.0) and linear("x 2") == ({"x": 1.0}, 2.0) and linear("x y") == ({"x": 1.0, "y": 1.0}, 0.0)
    assert linear("x/2 - 4y + 1e-1*z + .5") == ({"x": 0.5, "y": -4.0, "z": 0.1}, 0.5)
    for text in ("x*2/3", "x*y", "2/x", "3 x +", "x*", "(x)", "x/0", "*x", ".", "x & y"):
        with pytest.raises(FormatError):
            linear(text)


def test_scripts_compile_and_name_everything():
    m = formats.read_lp(LP)
    for name, write in emit.CODE.items():
        text = write(m)
        compile(text, name, "exec")
        assert "v['x']" in text and "v['y']" in text and "c1" in text and "c2" in text
    assert "GRB.MAXIMIZE" in emit.gurobipy(m) and "LpMaximize" in emit.pulp(m) and "3*v['x'] + 2*v['y'] + 1" in emit.pyomo(m)


def test_script_builds_the_model():
    class Recorder(dict):
        def addVar(self, **kw):
            self[kw["name"]] = kw
            return Expr({kw["name"]: 1})

        def setObjective(self, e, sense):
            self["objective"] = (e, sense)

        def addConstr(self, e, name):
            self[name] = e

        def update(self): ...

    class Expr:
        def __init__(self, c, k=0):
            self.c, self.k = c, k

        def __add__(self, o, s=1):
            o = o if isinstance(o, Expr) else Expr({}, o)
            return Expr({x: self.c.get(x, 0) + s * o.c.get(x, 0) for x in {**self.c, **o.c}}, self.k + s * o.k)

        def __sub__(self, o):
            return self.__add__(o, -1)

        def __rmul__(self, n):
            return Expr({x: n * v for x, v in self.c.items()}, n * self.k)

        def __le__(self, b):
            return (self.c, "le", b)

        def __ge__(self, b):
            return (self.c, "ge", b)

    import sys
    import types

    fake = types.ModuleType("gurobipy")
    fake.GRB = types.SimpleNamespace(BINARY="B", INTEGER="I", CONTINUOUS="C", INFINITY=1e100, MAXIMIZE=-1, MINIMIZE=1)
    fake.Model = lambda name, env=None: Recorder()
    old = sys.modules.get("gurobipy")
    sys.modules["gurobipy"] = fake
    try:
        space = {"__name__": "built"}
        exec(emit.gurobipy(formats.read_lp(LP)), space)
        built = space["build_model"]()
    finally:
        sys.modules.pop("gurobipy") if old is None else sys.modules.update(gurobipy=old)
    assert built["c1"] == ({"x": 1, "y": 1}, "le", 4) and built["c2"] == ({"x": 1, "y": -1}, "ge", -2)
    assert built["objective"][0].c == {"x": 3, "y": 2} and built["objective"][0].k == 1 and built["y"]["vtype"] == "I" and built["x"]["ub"] == 3


def test_stub_and_algebra(spark):
    rows = {r["id"]: r for r in fm.catalog(spark).drop("corrupt").collect()}
    for r in rows.values():
        compile(emit.pyomo_stub(r), r["id"], "exec")
    assert "m.u = pyo.Var(m.T, domain=pyo.Integers, bounds=(0.0, 3.0))" in emit.pyomo_stub(rows["periodic"])
    text = emit.algebra(rows["clashes"])
    assert r"\max\quad & \sum_{N} gain \cdot pick_{N}" in text and r"\forall a \in N, \forall b \in N, b < a" in text and r"pick_{N} \in \{0,1\}" in text


def test_instances():
    cards, params = instances.read('{"cardinalities": {"I": "3"}, "parameters": {"c": {"0,1": 5, "1,0": 6}, "h": 2}}')
    assert cards == {"I": 3} and instances.lookup(params["c"], (1, 0)) == 6.0 and instances.lookup(params["h"], ()) == 2.0
    assert instances.lookup([[1, 2], [3, 4]], (1, 0)) == 3.0 and instances.lookup({(0,): 1}, (0,)) == 1.0 and instances.lookup({0: 7}, (0,)) == 7.0
    with pytest.raises(KeyError):
        instances.lookup(params["c"], (2, 2))
    with pytest.raises(TypeError):
        instances.lookup("x", ())
    names = instances.Names()
    assert [names.get(n, "f") for n in ("a b", "a_b", "1x", "!!", "!!")] == ["a_b", "a_b_2", "_1x", "f", "f_2"]


def test_flat_models_are_formulations_again(spark):
    m = formats.read_lp(LP)
    f = fm.parse(spark.createDataFrame([(json.dumps(instances.to_formulation(m)),), (fm.CATALOG[0],)], "value string"))
    assert [(r["id"], r["flat"], r["family"]) for r in f.selectExpr("id", f"{instances.FLAT} AS flat", f"{instances.FAMILY} AS family").collect()] == [("model", True, "MILP"), ("coverage", False, "MILP")]
    assert views.findings(f).count() == 0
    back = templates.Grounder(spark, f.filter("id = 'model'").first(), {}, {}).model()
    assert grouped.solve(back)[1] == pytest.approx(grouped.solve(m)[1]) == pytest.approx(12)


def test_latex_rules(spark):
    text = "%@ head a<=b\n\\begin{align}\n x * y ≤ 3 \\underset{i \\in \\mathbb{I}}{\\sum} \\mathop{\\max} \\underbrace{z}   = 4\n\\end{align}\nafter >="
    got, rewrites = latex_rules.normalize(text)
    assert got == "%@ head a<=b\n\\begin{align}\n x \\cdot y \\le 3 \\sum_{i \\in \\mathcal{I}} \\max {z} = 4\n\\end{align}\nafter >="
    assert [r.rule for r in rewrites] == ["u2264_le", "star_cdot", "mathbb_mathcal", "underset_bigop", "mathop_unwrap", "underbrace_unwrap", "collapse_ws"]
    assert all(text[r.start : r.end] == r.before or r.rule in ("underset_bigop",) for r in rewrites) and rewrites[0].line == 3
    texts = [text, "a <= b * c", "", "$1 \\mathrm{Set} x\\times", "\\overset{a}{b}  c != d == e"]
    column = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", latex_rules.normalized(fm.F.col("t")).alias("n"))
    assert [r["n"] for r in column.orderBy("i").collect()] == [latex_rules.normalize(t)[0] for t in texts]
    doc = latex.write(fm.catalog(spark).filter("id = 'clashes'").first()).replace(r"\le ", "≤ ")
    found, rewrites, bad = latex_rules.ingest(doc)
    assert found["id"] == "clashes" and not bad and "u2264_le" in {r.rule for r in rewrites}
    assert latex_rules.ingest("nothing")[2][0]["stage"] == "parse"
    assert latex_rules.ingest(doc, lambda d: ["fault"])[2] == [{"stage": "validate", "message": "fault"}]


def test_review_has_no_size_limit_but_a_time_limit():
    many = "Minimize\n obj: " + " + ".join(f"x{i}" for i in range(80)) + "\nSubject To\n" + "".join(f" c{i}: x{i} >= 2\n d{i}: x{i} <= 1\n" for i in range(80)) + "End\n"
    assert "solve-infeasible" in {c[2] for c in review.review(many, "lp")[0]}
    assert ("solver-status", "warn") in {(c[2], c[1]) for c in review.review(many, "lp", seconds=0)[0]}


def test_reviews_of_documents(spark):
    codes = lambda t, f=None: {c[2] for c in review.review(t, f)[0]}
    assert {"parse-ok", "counts", "skipped"} <= codes(fm.CATALOG[0]) and not {"unknown-index", "unused-symbol"} & codes(fm.CATALOG[0])
    assert {"unknown-index", "unknown-parameter"} <= codes(fm.FAULTY[0]) and "unknown-variable" in codes(fm.FAULTY[1])
    assert "all-parsers-failed" in codes('{"a": 1}', "json")
    assert "parse-ok" in codes(latex.write(fm.catalog(spark).first()))


def test_selection_and_manifests(spark):
    clusters = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4), ("d", None)], "cluster string, id long")
    records = spark.createDataFrame([(1, 5, "C"), (2, 5, "A"), (3, 0, None), (4, 0, "B")], "id long, citations int, tier string")
    spare = spark.createDataFrame([("b", 99), ("d", 98)], "cluster string, id long")
    got = {r["cluster"]: (r["chosen"], r["reason"], r["ranked"]) for r in corpus.select_representatives(clusters, records, spare).collect()}
    assert got == {"a": (2, "highest_citation", [2, 1]), "b": (99, "benchmark_fallback", [3]), "c": (4, "next_highest_fallback", [4]), "d": (98, "benchmark_fallback", [])}
    texts = [corpus.manifest("2024-01-02", ["q"]), '{"manifest_schema_version": "9", "frozen_search_date": "x"}', "{", "{}"]
    rows = corpus.manifests(spark.createDataFrame([(t,) for t in texts], "value string")).collect()
    assert [(r["frozen_search_date"], r["queries"], r["corrupt"] is None) for r in rows] == [("2024-01-02", ["q"], True), (None, None, False), (None, None, False), (None, None, False)]
    with pytest.raises(ValueError):
        corpus.manifest("")


def test_isomorphism(spark):
    other = fm.CATALOG[1].replace('"make"', '"build"').replace('"id": "lots"', '"id": "copy"')
    odd = fm.CATALOG[1].replace('"binary"', '"integer"').replace('"id": "lots"', '"id": "odd"')
    f = fm.parse(spark.createDataFrame([(t,) for t in (fm.CATALOG[1], other, odd)], "value string"))
    classes = corpus.isomorphism_classes(views.schema_nodes(f), views.schema_edges(f))
    assert {r["fid"]: r["same_as"] for r in classes.collect()} == {"copy": "copy", "lots": "copy", "odd": "odd"}


def test_concepts_of_signatures(spark):
    rows = signatures.features(signatures.signatures(fm.catalog(spark))).filter("fid = 'lots' AND name = 'balance'").collect()
    got = {r["feature"]: r["value"] for r in rows}
    assert got["role:constraint"] == 1.0 and got["quant:P:P"] == 1.0 and got["concept:flow"] == 1.0


def test_command_line(spark, tmp_path, capsys):
    doc, lp = tmp_path / "lots.json", tmp_path / "m.lp"
    doc.write_text(fm.CATALOG[1])
    lp.write_text(LP)
    (tmp_path / "i.json").write_text('{"cardinalities": {"P": 4}, "parameters": {"need": [9, 3, 4, 2], "fixed": 5, "most": 100}}')

    def out(*args):
        assert cli.main([str(a) for a in args]) == 0
        return capsys.readouterr().out

    assert json.loads(out("validate", lp))["valid"] and json.loads(out("solve", lp))["objective"] == 12
    assert "GRB" in out("convert", lp, "--target", "gurobipy") and json.loads(out("convert", lp, "--target", "json"))["family"] == "milp"
    assert len(json.loads(out("view", doc, "--view", "ground", "--instance", tmp_path / "i.json", "--card", "P=3"))["nodes"]) == 9 + 6 + 1
    assert r"\begin{align*}" in out("export", doc)
    assert cli.main(["solve", str(tmp_path / "none.lp")]) == 1
    bad = tmp_path / "bad.lp"
    bad.write_text("hello")
    assert cli.main(["validate", str(bad)]) == 1

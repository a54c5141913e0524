"""Texts that build a model elsewhere: scripts for solver libraries, a skeleton of a template, one-way LaTeX. No library is needed."""

from __future__ import annotations

from modelloom.sources.latex import _plain
from modelloom.sources.model import Model, Variable, number

_SIGN = {"le": "<=", "ge": ">=", "eq": "=="}


def affine(coefs: dict[str, float], constant: float = 0.0, of: str = "v") -> str:
    """A Python expression over of["name"]; 0.0 if there is nothing."""
    out = ""
    for name, c in coefs.items():
        size = "" if abs(c) == 1 else f"{number(abs(c))}*"
        out += (" - " if c < 0 else " + ") + f"{size}{of}[{name!r}]" if out else ("-" if c < 0 else "") + f"{size}{of}[{name!r}]"
    if constant:
        out += f"{' - ' if constant < 0 else ' + '}{number(abs(constant))}" if out else number(constant)
    return out or "0.0"


def _script(m: Model, imports: list[str], build: str, start: list[str], variable, objective, row, end: list[str], main: list[str]) -> str:
    body = [*start, "v = {}", *(line for x in m.variables.values() for line in variable(x)), objective(affine(m.objective, m.constant), m.sense == "max")]
    body += [row(r.name, affine(r.coefs), _SIGN[r.comparator], number(r.rhs)) for r in m.rows]
    inside = "\n".join(f"    {line}" for line in [*body, *end])
    last = "\n".join(f"    {line}" for line in main)
    return f'"""The model {m.name}."""\n\n' + "\n".join(imports) + f"\n\n\n{build}\n{inside}\n\n\nif __name__ == \"__main__\":\n{last}\n"


def _bounds(v: Variable) -> tuple[str, str]:
    return tuple("None" if x is None else number(x) for x in (v.lower, v.upper))  # type: ignore[return-value]


def gurobipy(m: Model) -> str:
    def variable(v: Variable) -> list[str]:
        kind = {"binary": "GRB.BINARY", "integer": "GRB.INTEGER"}.get(v.domain, "GRB.CONTINUOUS")
        low, high = ("-GRB.INFINITY" if v.lower is None else number(v.lower)), ("GRB.INFINITY" if v.upper is None else number(v.upper))
        limits = "" if v.domain == "binary" else f"lb={low}, ub={high}, "
        return [f"v[{v.name!r}] = m.addVar({limits}vtype={kind}, name={v.name!r})"]

    return _script(
        m, ["import gurobipy as gp", "from gurobipy import GRB"], "def build_model(env=None):", [f"m = gp.Model({m.name!r}, env=env)"], variable,
        lambda e, most: f"m.setObjective({e}, GRB.{'MAXIMIZE' if most else 'MINIMIZE'})", lambda n, e, s, b: f"m.addConstr({e} {s} {b}, name={n!r})",
        ["m.update()", "return m"], ["m = build_model()", "m.optimize()", "print(m.Status, [(x.VarName, x.X) for x in m.getVars()] if m.Status == GRB.OPTIMAL else None)"],
    )


def pulp(m: Model) -> str:
    def variable(v: Variable) -> list[str]:
        low, high = _bounds(v)
        kind = {"binary": "cat='Binary'", "integer": f"lowBound={low}, upBound={high}, cat='Integer'"}.get(v.domain, f"lowBound={low}, upBound={high}")
        return [f"v[{v.name!r}] = pulp.LpVariable({v.name!r}, {kind})"]

    return _script(
        m, ["import pulp"], "def build_problem():", [f"prob = pulp.LpProblem({m.name!r}, pulp.{'LpMaximize' if m.sense == 'max' else 'LpMinimize'})"], variable,
        lambda e, most: f"prob += pulp.LpAffineExpression({e}), 'objective'", lambda n, e, s, b: f"prob += {e} {s} {b}, {n!r}",
        ["return prob"], ["prob = build_problem()", "prob.solve()", "print(pulp.LpStatus[prob.status], [(x.name, x.value()) for x in prob.variables()])"],
    )


def pyomo(m: Model) -> str:
    def variable(v: Variable) -> list[str]:
        low, high = _bounds(v)
        kind = {"binary": "Binary", "integer": "Integers"}.get(v.domain, "Reals")
        return [f"v[{v.name!r}] = pyo.Var(domain=pyo.{kind}, bounds=({low}, {high}))", f"m.add_component({v.name!r}, v[{v.name!r}])"]

    return _script(
        m, ["import pyomo.environ as pyo"], "def build_model():", [f"m = pyo.ConcreteModel(name={m.name!r})"], variable,
        lambda e, most: f"m.obj = pyo.Objective(expr={e}, sense=pyo.{'maximize' if most else 'minimize'})", lambda n, e, s, b: f"m.add_component({n!r}, pyo.Constraint(expr=({e}) {s} {b}))",
        ["return m"], ["m = build_model()", "m.pprint()"],
    )


CODE = {"gurobipy": gurobipy, "pulp": pulp, "pyomo": pyomo}
# Domains of variables in Pyomo.
_DOMAINS = {"continuous": "Reals", "non_negative": "NonNegativeReals", "integer": "Integers", "binary": "Binary"}


def pyomo_stub(f) -> str:
    """A formulation's sets, parameters and variables, with a rule to fill in for each constraint and the objective."""
    f = _plain(f)
    sets = lambda xs: ", ".join(f"m.{x}" for x in xs)
    out = [f'"""{f["name"]} ({f["id"]}, {f["family"]}): rules are to be filled in."""', "", "import pyomo.environ as pyo", "", "", "def build_model():", "    m = pyo.ConcreteModel()"]
    out += [f"    m.{i['name']} = pyo.Set(ordered={bool(i.get('ordered'))})" + ("  # cyclic" if i.get("cyclic") else "") for i in f.get("indices", [])]
    out += [f"    m.{p['name']} = pyo.Param({', '.join([*([sets(p['shape'])] if p.get('shape') else []), 'mutable=True'])})" for p in f.get("parameters", [])]
    for v in f["variables"]:
        limits = [f"bounds=({v.get('lower')!r}, {v.get('upper')!r})"] if "lower" in v or "upper" in v else []
        out.append(f"    m.{v['name']} = pyo.Var({', '.join([*([sets(v['shape'])] if v.get('shape') else []), 'domain=pyo.' + _DOMAINS[v.get('domain', 'continuous')], *limits])})")

    def rule(name: str, args: list[str], text: str, made: str) -> list[str]:
        return ["", f"    def {name}_rule({', '.join(['m', *args])}):", f'        """{text}"""', "        raise NotImplementedError", "", f"    m.{name} = {made}"]

    if f.get("objective"):
        o = f["objective"]
        out += rule("obj", [], o.get("description") or o.get("name", "objective"), f"pyo.Objective(rule=obj_rule, sense=pyo.{'maximize' if o['sense'] == 'max' else 'minimize'})")
    for c in f.get("constraints", []):
        q = c.get("quantifiers", [])
        out += rule(c["name"], [x["index"] for x in q], c.get("description") or c["name"], f"pyo.Constraint({', '.join([*([sets([x['over'] for x in q])] if q else []), f'rule={c['name']}_rule'])})")
    return "\n".join([*out, "    return m", ""])


_COMPARE = {"le": r"\le", "ge": r"\ge", "eq": "="}
_BETWEEN = {"ne_other": r"\ne", "lt_other": "<", "le_other": r"\le", "gt_other": ">", "ge_other": r"\ge", "ordered_pair": "<"}
_IN = {"binary": r"\in \{0,1\}", "integer": r"\in \mathbb{Z}", "non_negative": r"\ge 0", "continuous": r"\in \mathbb{R}"}
_AROUND = {"max": r"\max\;%s", "min": r"\min\;%s", "abs": r"\left|%s\right|"}


def algebra(f) -> str:
    """The formulation's algebra as one align* block, to be read by people only."""
    f = _plain(f)

    def term(t: dict) -> str:
        if t.get("ref_kind") == "literal":
            return number(float(t["coefficient"]))
        c = str(t.get("coefficient", "1"))
        body = ("" if c in ("1", "1.0") else rf"{c} \cdot ") + t["ref"] + (f"_{{{','.join(b['expr'] for b in t['bindings'])}}}" if t.get("bindings") else "")
        op = t.get("operator", "none")
        return rf"\sum_{{{','.join(t.get('operator_over', []))}}} {body}" if op == "sum" else _AROUND.get(op, "%s") % body

    def side(terms: list[dict]) -> str:
        signed = [("-" if t.get("sign", 1) < 0 else "+", term(t)) for t in terms]
        return " ".join(f"{s} {x}" if i else ("-" if s == "-" else "") + x for i, (s, x) in enumerate(signed)) or "0"

    lines = [rf"\{f['objective']['sense']}\quad & {side(f['objective']['terms'])}"] if f.get("objective") else []
    for c in f.get("constraints", []):
        q = c.get("quantifiers", [])
        parts = [rf"\forall {x['index']} \in {x['over']}" for x in q]
        parts += [f"{x['index']} {_BETWEEN[x['restriction']]} {x['restriction_other']}" for x in q if x.get("restriction", "none") in _BETWEEN]
        parts += [f"{x['where']['parameter']}_{{{x['index']}}} = {x['where']['equals']}" for x in q if x.get("where")]
        lines.append(f"& {side(c.get('lhs', []))} {_COMPARE[c['comparator']]} {side(c.get('rhs', []))}" + (rf" & \quad {', '.join(parts)}" if parts else ""))
    lines += [f"& {v['name']}" + (f"_{{{','.join(v['shape'])}}}" if v.get("shape") else "") + f" {_IN[v.get('domain', 'continuous')]}" for v in f["variables"]]
    return "\n".join([r"\begin{align*}", *(rf"  {x} \\" for x in lines), r"\end{align*}"])

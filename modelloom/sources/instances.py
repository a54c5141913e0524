"""Data of instances, and flat models as formulations."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from modelloom.sources.model import Model


def read(data: dict | str) -> tuple[dict[str, int], dict]:
    """(cards, params) of {"cardinalities": ..., "parameters": ...}, or of its JSON."""
    data = json.loads(data) if isinstance(data, str) else data
    return {str(k): int(v) for k, v in data.get("cardinalities", {}).items()}, dict(data.get("parameters", {}))


def load(path: str) -> tuple[dict[str, int], dict]:
    return read(Path(path).read_text(encoding="utf-8"))


def cells(value, key: tuple[int, ...] = ()) -> list[tuple]:
    """(k0, ..., value) of a number, nested lists, or a mapping from "0,1", 0 or (0, 1)."""
    if isinstance(value, dict):
        keys = {k: tuple(int(x) for x in k.split(",")) if isinstance(k, str) else tuple(k) if isinstance(k, (tuple, list)) else (int(k),) for k in value}
        return [(*keys[k], float(v)) for k, v in value.items()]
    if isinstance(value, (list, tuple)):
        return [c for i, x in enumerate(value) for c in cells(x, (*key, i))]
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise TypeError(f"no number: {value!r}")
    return [(*key, float(value))]


def parameter_table(spark: SparkSession, value) -> DataFrame:
    """k0, k1, ..., value."""
    rows = cells(value)
    return spark.createDataFrame(rows, ", ".join([*(f"k{i} long" for i in range(len(rows[0]) - 1)), "value double"]))


def lookup(value, key: tuple[int, ...]) -> float:
    """The value at a place; KeyError if it has none."""
    return {c[:-1]: c[-1] for c in cells(value)}[tuple(key)]


class Names:
    """Identifiers for any names: other characters become _, what is left of none gets the fallback, and repeats are numbered."""

    def __init__(self, used: set[str] | None = None):
        self.used = set(used or ())

    def get(self, name: str, fallback: str) -> str:
        plain = re.sub(r"[^A-Za-z0-9_]+", "_", name).strip("_") or fallback
        plain = f"_{plain}" if plain[0].isdigit() else plain
        out, n = plain, 1
        while out in self.used:
            n += 1
            out = f"{plain}_{n}"
        self.used.add(out)
        return out


def to_formulation(m: Model, description: str = "") -> dict:
    """A flat model as a document without indices: it is a formulation again, and grounds to the same model."""
    names = Names()
    of = {v: names.get(v, f"x{i + 1}") for i, v in enumerate(m.variables)}
    rows = Names(names.used)
    const = lambda x, role: {"constant": x, "role": role}
    terms = lambda coefs, role: [{"ref": of[v], "coefficient": repr(abs(c)), "sign": -1 if c < 0 else 1, "role": role} for v, c in coefs.items()]

    def variable(name: str, v) -> dict:
        free = v.domain == "continuous" and v.lower == 0
        out = {"name": name, "domain": "non_negative" if free else v.domain, "lower": None if free or v.domain == "binary" else v.lower, "upper": v.upper}
        return {k: x for k, x in out.items() if x is not None}

    goal = terms(m.objective, "objective")
    if m.constant or not goal:
        goal.append(const(m.constant, "objective"))
    whole = any(v.domain in ("integer", "binary") for v in m.variables.values())
    return {
        "schema_version": "0.1.0", "id": re.sub("[^a-z0-9_.-]+", "_", m.name.lower()), "name": m.name, "family": "milp" if whole else "lp", "description": description,
        "variables": [variable(of[x], v) for x, v in m.variables.items()],
        "constraints": [{"name": rows.get(r.name, f"c{i + 1}"), "comparator": r.comparator, "lhs": terms(r.coefs, "lhs") or [const(0.0, "lhs")], "rhs": [const(r.rhs, "rhs")]} for i, r in enumerate(m.rows)],
        "objective": {"sense": m.sense, "name": "objective", "terms": goal},
    }


#: Whether a parsed formulation (its columns) has nothing that an instance must fill in.
FLAT = (
    "size(indices) = 0 and forall(variables, v -> size(v.shape) = 0) and coalesce(objective.combination, '') != 'lexicographic' "
    "and forall(constraints, c -> size(c.quantifiers) = 0 and c.indicator is null) "
    "and forall(concat(flatten(transform(constraints, c -> concat(c.lhs, c.rhs))), coalesce(objective.terms, array())), "
    "t -> size(t.bindings) = 0 and t.operator = 'none' and t.ref_kind != 'parameter' and try_cast(t.coefficient as double) is not null)"
)
#: LP, MIP (all variables whole) or MILP, by the variables' domains.
FAMILY = (
    "case when not exists(variables, v -> v.domain in ('integer', 'binary')) then 'LP' "
    "when forall(variables, v -> v.domain in ('integer', 'binary')) then 'MIP' else 'MILP' end"
)

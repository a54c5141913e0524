"""The SQL of the queries over formulations: the same documents, read as JSON."""

from __future__ import annotations

from modelloom.functions.lexical import TYPE_PATTERNS
from modelloom.sources.formulations import CATALOG, FAULTY


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _documents(texts: list[str]) -> str:
    """f: fid, j. p, v, i: declared parameters, variables, indices. c: constraints. t: terms, each with its place."""
    docs = ", ".join(map(_quoted, texts))
    items = lambda name: f"SELECT fid, unnest(json_extract(j, '$.{name}[*]')) AS x FROM f"
    side = lambda s: f"SELECT fid, 'constraint:' || (x->>'name') AS container, 'constraint' AS ctype, '{s}' AS side, unnest(json_extract(x, '$.{s}[*]')) AS x, unnest(range(len(json_extract(x, '$.{s}[*]')))) AS pos FROM c"
    return f"""WITH f AS (SELECT j->>'id' AS fid, j FROM (SELECT CAST(unnest([{docs}]) AS JSON) AS j)),
p AS ({items("parameters")}), v AS ({items("variables")}), i AS ({items("indices")}), c AS ({items("constraints")}),
raw AS ({side("lhs")} UNION ALL {side("rhs")} UNION ALL
  SELECT fid, 'objective:0', 'objective', 'obj', unnest(json_extract(j, '$.objective.terms[*]')), unnest(range(len(json_extract(j, '$.objective.terms[*]')))) FROM f),
t AS (SELECT fid, container, ctype, side, pos, side || '[' || pos || ']' AS place, x, (x->'constant') IS NOT NULL AS literal, x->>'ref' AS ref, coalesce(x->>'ref_kind', 'variable') AS ref_kind,
  coalesce(x->>'operator', 'none') AS op, coalesce(CAST(x->>'sign' AS INT), 1) AS sign, x->>'role' AS role, coalesce(x->>'coefficient', '1') AS coefficient,
  'op:' || container || '/' || side || '[' || pos || ']/' || coalesce(x->>'operator', 'none') AS op_id FROM raw)
"""


_F, _ALL = _documents(CATALOG), _documents(CATALOG + FAULTY)
_SHAPE = "coalesce(array_to_string(CAST(x->'shape' AS VARCHAR[]), ','), '')"

NODES = f"""n AS (SELECT fid, 'index:' || (x->>'name') AS id, 'index' AS cls, CASE WHEN x->>'cyclic' = 'true' THEN 'cyclic' WHEN x->>'ordered' = 'true' THEN 'ordered' ELSE 'set' END AS subtype, x->>'name' AS label, '' AS shape FROM i
UNION ALL SELECT fid, 'param:' || (x->>'name'), 'parameter', coalesce(x->>'kind', 'scalar'), x->>'name', {_SHAPE} FROM p
UNION ALL SELECT fid, 'var:' || (x->>'name'), 'variable', coalesce(x->>'domain', 'continuous'), x->>'name', {_SHAPE} FROM v
UNION ALL SELECT fid, 'constraint:' || (x->>'name'), 'constraint', coalesce(x->>'kind', 'linear'), x->>'name', '' FROM c
UNION ALL SELECT fid, 'objective:0', 'objective', j->>'$.objective.sense', coalesce(j->>'$.objective.name', 'objective'), '' FROM f
UNION ALL SELECT fid, op_id, 'operator', op, op, coalesce(array_to_string(CAST(x->'operator_over' AS VARCHAR[]), ','), '') FROM t WHERE op <> 'none' AND NOT literal)"""

EDGES = """e AS (SELECT fid, 'param:' || (x->>'name') AS src, 'index:' || unnest(CAST(x->'shape' AS VARCHAR[])) AS dst, 'uses_index' AS type, 'shape' AS role, '' AS label, CAST(NULL AS INT) AS sign, CAST(NULL AS VARCHAR) AS coefficient FROM p
UNION ALL SELECT fid, 'var:' || (x->>'name'), 'index:' || unnest(CAST(x->'shape' AS VARCHAR[])), 'uses_index', 'shape', '', NULL, NULL FROM v
UNION ALL SELECT fid, container, op_id, 'operator_input', role, place, NULL, NULL FROM t WHERE op <> 'none' AND NOT literal
UNION ALL SELECT fid, CASE WHEN op <> 'none' THEN op_id ELSE container END, CASE WHEN ref_kind = 'variable' THEN 'var:' ELSE 'param:' END || ref,
  CASE WHEN ref_kind = 'parameter' THEN 'uses_parameter' WHEN ctype = 'objective' THEN 'var_in_objective' ELSE 'var_in_constraint' END, role, CASE WHEN op <> 'none' THEN '' ELSE place END, sign, coefficient FROM t WHERE NOT literal
UNION ALL SELECT t.fid, container, 'param:' || coefficient, 'uses_parameter', 'coef', place, NULL, NULL FROM t JOIN p ON p.fid = t.fid AND p.x->>'name' = coefficient WHERE NOT literal)"""

SCHEMA_NODES = f"{_F}, {NODES} SELECT * FROM n"
SCHEMA_EDGES = f"{_F}, {EDGES} SELECT * FROM e"

HYBRID_LABELS = f"""{_F}, b AS (SELECT fid, container, side, pos, sign, coefficient, unnest(json_extract(x, '$.bindings[*]')) AS y, unnest(range(len(json_extract(x, '$.bindings[*]')))) AS nth FROM t WHERE NOT literal),
box AS (SELECT fid, container, side, pos, string_agg((y->>'index') || '=' || (y->>'expr') || CASE WHEN y->>'modulo' IS NULL THEN '' ELSE ' mod ' || (y->>'modulo') END, ', ' ORDER BY nth) AS s FROM b GROUP BY ALL)
SELECT fid, container, side, pos, CASE WHEN sign = 1 THEN '' ELSE '-' END || CASE WHEN try_cast(coefficient AS DOUBLE) = 1 THEN '' ELSE coefficient || CASE WHEN s IS NULL THEN '' ELSE '·' END END || coalesce('[' || s || ']', '') AS label
FROM t LEFT JOIN box USING (fid, container, side, pos) WHERE NOT literal"""

FLAGS = f"""{_F} SELECT fid,
EXISTS (FROM p WHERE p.fid = f.fid AND x->>'kind' = 'big_m') OR EXISTS (FROM c WHERE c.fid = f.fid AND x->>'kind' = 'big_m') AS big_m,
EXISTS (FROM v WHERE v.fid = f.fid AND x->>'domain' IN ('integer', 'binary')) AS integer_vars,
EXISTS (FROM t WHERE t.fid = f.fid AND len(json_extract_string(x, '$.bindings[*].modulo')) > 0) AS modulo_offset,
EXISTS (FROM v WHERE v.fid = f.fid AND x->>'role' = 'slack') OR EXISTS (FROM t WHERE t.fid = f.fid AND role = 'slack') AS soft_slack,
EXISTS (FROM t WHERE t.fid = f.fid AND op <> 'none') AS aggregation FROM f"""

_TAGS = ", ".join(f"({_quoted(t)}, {_quoted(p)})" for t, p in TYPE_PATTERNS.items())
TYPES = f"""{_F} SELECT f.fid, tag, count(c.x) FILTER (regexp_matches((c.x->>'name') || ' ' || coalesce(c.x->>'description', ''), pattern, 'i')) AS n
FROM f JOIN (VALUES {_TAGS}) k(tag, pattern) ON true LEFT JOIN c ON c.fid = f.fid GROUP BY ALL"""

FINDINGS = f"""{_ALL}, d AS (SELECT fid, 'index' AS what, x->>'name' AS name, NULL AS shape FROM i UNION ALL SELECT fid, 'parameter', x->>'name', coalesce(CAST(x->'shape' AS VARCHAR[]), []) FROM p UNION ALL SELECT fid, 'variable', x->>'name', coalesce(CAST(x->'shape' AS VARCHAR[]), []) FROM v),
q AS (SELECT fid, unnest(json_extract(x, '$.quantifiers[*]')) AS q, json_extract_string(x, '$.quantifiers[*].index') AS own FROM c),
need AS (SELECT fid, 'unknown-index' AS code, 'index' AS what, unnest(shape) AS subject FROM d WHERE shape IS NOT NULL
UNION ALL SELECT fid, 'unknown-index', 'index', q->>'over' FROM q UNION ALL SELECT fid, 'unknown-parameter', 'parameter', q->>'$.where.parameter' FROM q
UNION ALL SELECT fid, 'unknown-' || ref_kind, ref_kind, ref FROM t WHERE NOT literal
UNION ALL SELECT fid, 'unknown-coefficient', 'parameter', coefficient FROM t WHERE NOT literal AND try_cast(coefficient AS DOUBLE) IS NULL)
SELECT fid, code, subject FROM need WHERE subject IS NOT NULL AND NOT EXISTS (FROM d WHERE d.fid = need.fid AND d.what = need.what AND d.name = subject)
UNION ALL SELECT fid, 'unknown-quantifier', q->>'restriction_other' FROM q WHERE q->>'restriction_other' IS NOT NULL AND NOT list_contains(own, q->>'restriction_other')
UNION ALL SELECT fid, 'bound-literal', container FROM t WHERE literal AND len(json_extract(x, '$.bindings[*]')) > 0
UNION ALL SELECT t.fid, 'bindings-shape', ref FROM t JOIN d ON d.fid = t.fid AND d.what = ref_kind AND d.name = ref WHERE NOT literal AND list_sort(list_distinct(json_extract_string(t.x, '$.bindings[*].index'))) <> list_sort(list_distinct(shape))
UNION ALL SELECT fid, 'family', j->>'family' FROM f WHERE (j->>'family') = CASE WHEN EXISTS (FROM v WHERE v.fid = f.fid AND x->>'domain' IN ('integer', 'binary')) THEN 'lp' ELSE 'milp' END"""

HASHES = f"""{_F}, {NODES}, {EDGES}, s AS (SELECT fid, id, cls || '|' || subtype || '|' || shape AS sig FROM n),
l AS (SELECT fid, 'N' AS kind, sig AS line FROM s UNION ALL SELECT e.fid, 'E', a.sig || '>' || type || '>' || role || '>' || b.sig FROM e JOIN s a ON a.fid = e.fid AND a.id = src JOIN s b ON b.fid = e.fid AND b.id = dst)
SELECT fid, sha256('N' || chr(10) || coalesce(string_agg(line, chr(10) ORDER BY line) FILTER (kind = 'N'), '') || chr(10) || 'E' || chr(10) || coalesce(string_agg(line, chr(10) ORDER BY line) FILTER (kind = 'E'), '')) AS hash FROM l GROUP BY fid"""

GROUND_TEMPLATE = """WITH s AS (SELECT s_suppkey AS k, n_regionkey AS r, s_acctbal AS a, s_suppkey % 7 + 1 AS price FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT 'served_D' || r AS row, 'open_' || k AS var, round(CAST(a AS DOUBLE), 9) AS coef FROM s WHERE a <> 0
UNION ALL SELECT 'money', 'open_' || k, CAST(price AS DOUBLE) FROM s
UNION ALL SELECT 'served_D' || d, 'miss_' || d, 1.0 FROM range(5) x(d) UNION ALL SELECT 'objective', 'miss_' || d, d + 1.0 FROM range(5) x(d)"""

GROUND_NODES = """SELECT 'varinst:' || v || '_P' || p AS id, 'variable' AS cls, v || '[' || p || ']' AS label, false AS degenerate FROM (VALUES ('make'), ('stock'), ('setup')) x(v), range(25) y(p)
UNION ALL SELECT 'cinst:' || c || '_P' || p, 'constraint', c || '_P' || p, c = 'balance' AND p = 0 FROM (VALUES ('balance'), ('only_if_set_up')) x(c), range(25) y(p)
UNION ALL SELECT 'objinst:0', 'objective', 'objective', false"""

HYBRID_EDGES = f"""{_F}, {EDGES}, h AS ({HYBRID_LABELS[len(_F) :].removeprefix(", ").replace("b AS (", "SELECT fid, container, side || '[' || pos || ']' AS place, label FROM (WITH b AS (", 1)}))
SELECT e.fid, src, dst, type, role, CASE WHEN sign IS NULL THEN e.label ELSE h.label END AS label, sign, coefficient FROM e LEFT JOIN h ON h.fid = e.fid AND sign IS NOT NULL
  AND (src = 'op:' || h.container || '/' || place || '/sum' OR (src = h.container AND e.label = place))"""

GROUND_EDGES = """WITH k AS (SELECT * FROM range(25) x(p))
SELECT 'cinst:balance_P' || p AS src, 'varinst:' || v || '_P' || (p + o) AS dst, 'ground_var_in_constraint' AS type, 'lhs' AS role, 'lhs[' || nth || ']' AS label, sign, '1' AS coefficient
FROM k, (VALUES ('stock', -1, 0, 1), ('make', 0, 1, 1), ('stock', 0, 2, -1)) x(v, o, nth, sign) WHERE p + o >= 0
UNION ALL SELECT 'cinst:only_if_set_up_P' || p, 'varinst:make_P' || p, 'ground_var_in_constraint', 'lhs', 'lhs[0]', 1, '1' FROM k
UNION ALL SELECT 'cinst:only_if_set_up_P' || p, 'varinst:setup_P' || p, 'ground_var_in_constraint', 'rhs', 'rhs[0]', 1, 'most' FROM k
UNION ALL SELECT 'objinst:0', 'varinst:' || v || '_P' || p, 'ground_var_in_objective', 'objective', 'obj[' || nth || ']', 1, c FROM k, (VALUES ('stock', 0, '1'), ('setup', 1, 'fixed')) x(v, nth, c)"""

_SIGS = f"""{_F}, q AS (SELECT fid, x->>'name' AS name, unnest(json_extract(x, '$.quantifiers[*]')) AS q, unnest(range(len(json_extract(x, '$.quantifiers[*]')))) AS nth FROM c),
qs AS (SELECT fid, name, list(q->>'over' ORDER BY nth) AS shape, list((q->>'index') || ':' || (q->>'over') || CASE WHEN coalesce(q->>'restriction', 'none') = 'none' THEN '' ELSE ':' || (q->>'restriction') END ORDER BY nth) AS quant FROM q GROUP BY ALL),
rs AS (SELECT fid, container, list(CASE WHEN literal THEN 'literal' ELSE ref_kind END ORDER BY CASE WHEN literal THEN 'literal' ELSE ref_kind END) AS refs FROM t GROUP BY ALL),
s AS (SELECT fid, 'variable' AS part, x->>'name' AS name, coalesce(x->>'domain_role', '') AS domain, coalesce(x->>'role', 'primary') AS role, coalesce(x->>'domain', 'continuous') AS kind, coalesce(CAST(x->'shape' AS VARCHAR[]), []) AS shape, CAST([] AS VARCHAR[]) AS quant, '' AS cmp, CAST([] AS VARCHAR[]) AS refs FROM v
UNION ALL SELECT fid, 'parameter', x->>'name', coalesce(x->>'domain_class', ''), 'parameter', coalesce(x->>'kind', 'scalar'), coalesce(CAST(x->'shape' AS VARCHAR[]), []), [], '', [] FROM p
UNION ALL SELECT c.fid, 'constraint', x->>'name', coalesce(x->>'domain_class', ''), 'constraint', coalesce(x->>'kind', 'linear'), coalesce(shape, []), coalesce(quant, []), x->>'comparator', coalesce(refs, [])
  FROM c LEFT JOIN qs ON qs.fid = c.fid AND qs.name = x->>'name' LEFT JOIN rs ON rs.fid = c.fid AND rs.container = 'constraint:' || (x->>'name')
UNION ALL SELECT fid, 'objective', coalesce(j->>'$.objective.name', 'objective'), 'objective_defining', 'objective', (j->>'$.objective.sense') || '/' || coalesce(j->>'$.objective.combination', 'sum'), [], [], '', [] FROM f
UNION ALL SELECT fid, 'model', j->>'name', '', 'model', j->>'family', json_extract_string(j, '$.indices[*].name'), [], '', [] FROM f)
"""
SIGNATURES = f"""{_SIGS} SELECT fid, part, name, 'domain=' || domain || '|role=' || role || '|kind=' || kind || '|shape=[' || coalesce(array_to_string(shape, ','), '') || ']|quant=[' || coalesce(array_to_string(quant, ','), '') || ']|cmp=' || cmp || '|refs=[' || coalesce(array_to_string(refs, ','), '') || ']' AS signature FROM s"""
FACETS = f"""{_SIGS} SELECT DISTINCT fid, part, name, feature, 1.0::DOUBLE AS value FROM (
SELECT fid, part, name, unnest(list_concat(['role:' || role, 'kind:' || kind, 'arity:' || len(shape)], list_transform(shape, lambda o: 'over:' || o), list_transform(quant, lambda o: 'quant:' || o))) AS feature FROM s
UNION ALL SELECT fid, part, name, 'domain:' || domain FROM s WHERE domain <> '')"""

ISOMORPHISM = f"""{_F}, n AS (SELECT count(*) AS n FROM nation), k AS (SELECT j->>'family' AS cluster, count(*) AS docs, min(fid) AS least FROM f GROUP BY 1)
SELECT cluster, CAST(docs * n AS BIGINT) AS size, CAST(docs * n * (docs * n - 1) / 2 AS BIGINT) AS pairs, CAST(docs * n * (n - 1) / 2 AS BIGINT) AS same_pairs,
  docs * n * (n - 1) / (docs * n * (docs * n - 1)) AS pair_rate, n AS largest, n / (docs * n) AS whole_rate, least || '_0' AS representative FROM k, n"""

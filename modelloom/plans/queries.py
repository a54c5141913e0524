"""Queries of the library over the test tables: name to function of (spark, sf_dir), and the SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelloom.functions import lexical as L
from modelloom.functions import vectors as V
from modelloom.operators import bigm, checks, corpus, grounding, grouped, metrics, mining, review, signatures, taxonomy, templates, views
from modelloom.plans import formulation_sql as S
from modelloom.sources import formats, formulations, latex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- grounding


def _pairs(restriction: str, test: str):
    def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = grounding.domain(table(spark, sf_dir, "nation"), "n_nationkey", "i")
        return grounding.quantify([("i", d, "none", None), ("j", d, restriction, "i")])

    query(f"SELECT a.n_nationkey AS i, b.n_nationkey AS j FROM nation a JOIN nation b ON b.n_nationkey {test} a.n_nationkey", f"ground_pairs_{restriction.removesuffix('_other')}")(pairs)


for _r, _t in (("ne_other", "<>"), ("lt_other", "<"), ("le_other", "<="), ("gt_other", ">"), ("ge_other", ">="), ("ordered_pair", "<")):
    _pairs(_r, _t)


@query("SELECT s_suppkey AS s, n_nationkey AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1")
def ground_where_filter(spark, sf_dir):
    tuples = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").alias("n"))
    return grounding.where_equals(tuples, "n", table(spark, sf_dir, "nation"), "n_nationkey", "n_regionkey", 1).select("s", "n")


@query("SELECT a.n_nationkey AS i, b.n_nationkey AS prev, b.n_nationkey IS NULL AS degenerate FROM nation a LEFT JOIN nation b ON b.n_nationkey = a.n_nationkey - 1")
def ground_offset_drop(spark, sf_dir):
    d = grounding.domain(table(spark, sf_dir, "nation"), "n_nationkey", "i")
    return grounding.instances(d, {"prev": grounding.shifted(F.col("i"), -1, F.lit(25), False)})


@query("SELECT n_nationkey AS i, (n_nationkey + 3) % 25 AS later, ((n_nationkey - 3) % 25 + 25) % 25 AS earlier FROM nation")
def ground_cyclic_wrap(spark, sf_dir):
    d = grounding.domain(table(spark, sf_dir, "nation"), "n_nationkey", "i")
    return d.select("i", grounding.shifted(F.col("i"), 3, F.lit(25), True).alias("later"), grounding.shifted(F.col("i"), -3, F.lit(25), True).alias("earlier"))


@query(
    "SELECT 'view' AS mode, count(*) AS kept, count(*) FILTER (n_nationkey IN (0, 24)) AS degenerate FROM nation "
    "UNION ALL SELECT 'solver', count(*) FILTER (n_nationkey NOT IN (0, 24)), 0 FROM nation"
)
def degenerate_flags(spark, sf_dir):
    d = grounding.domain(table(spark, sf_dir, "nation"), "n_nationkey", "i")
    own = grounding.instances(d, {"prev": grounding.shifted(F.col("i"), -1, F.lit(25), False), "next": grounding.shifted(F.col("i"), 1, F.lit(25), False)})
    view = own.agg(F.lit("view").alias("mode"), F.count("*").alias("kept"), F.count_if("degenerate").alias("degenerate"))
    solver = own.filter("NOT degenerate").agg(F.lit("solver").alias("mode"), F.count("*").alias("kept"), F.lit(0).cast("long").alias("degenerate"))
    return view.select("mode", "kept", "degenerate").unionByName(solver.select("mode", "kept", "degenerate"))


@query(
    "SELECT l_suppkey AS row, l_partkey AS var, round(sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END), 6) AS coef FROM lineitem "
    "GROUP BY l_suppkey, l_partkey HAVING round(sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END), 6) <> 0"
)
def ground_sum_coo(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("var"), "l_quantity", "l_returnflag")
    return grounding.coefficients(li, ["row", "var"], F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")))


@query("SELECT l_returnflag AS row, l_linenumber AS var, round(sum(l_tax) - sum(l_discount), 6) AS coef FROM lineitem GROUP BY 1, 2 HAVING round(sum(l_tax) - sum(l_discount), 6) <> 0")
def flat_normalize(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("row"), F.col("l_linenumber").alias("var"), "l_tax", "l_discount")
    side = lambda c: li.groupBy("row", "var").agg(F.sum(c).alias("v"))
    return grounding.normalized(side("l_tax"), side("l_discount"), ["row", "var"], "v")


# ---- big-M


def _box(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.round(F.sum(F.col("l_tax") - F.col("l_discount")), 6).alias("coef"))
    return li.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("double").alias("upper")), "l_partkey").withColumn("lower", F.lit(0.0))


_BOX = "SELECT l_suppkey, round(sum(l_tax - l_discount), 6) AS coef, any_value(p_size) AS upper FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey, l_partkey"


@query(f"SELECT l_suppkey AS row, round(sum(CASE WHEN coef > 0 THEN coef * upper ELSE 0 END), 3) AS hi, round(sum(CASE WHEN coef < 0 THEN coef * upper ELSE 0 END), 3) AS lo FROM ({_BOX}) GROUP BY 1")
def bigm_extremum(spark, sf_dir):
    t = _box(spark, sf_dir)
    side = lambda up, n: bigm.extremum(t, ["l_suppkey"], F.col("coef"), F.col("lower"), F.col("upper"), up).select("l_suppkey", F.round("extremum", 3).alias(n))
    return side(True, "hi").join(side(False, "lo"), "l_suppkey").withColumnRenamed("l_suppkey", "row")


@query(
    "WITH r AS (SELECT o_custkey AS row, CASE o_custkey % 3 WHEN 0 THEN 'le' WHEN 1 THEN 'ge' ELSE 'eq' END AS comparator, round(min(o_totalprice) + 10, 2) AS rhs, "
    "round(max(o_totalprice), 2) AS hi, round(min(o_totalprice), 2) AS lo, o_custkey % 2 AS active FROM orders GROUP BY o_custkey), "
    "s AS (SELECT *, 'le' AS side FROM r WHERE comparator <> 'ge' UNION ALL SELECT *, 'ge' AS side FROM r WHERE comparator <> 'le'), "
    "m AS (SELECT *, greatest(0, CASE WHEN side = 'le' THEN hi - rhs ELSE rhs - lo END) AS m, CASE WHEN side = 'le' THEN 1 ELSE -1 END AS k FROM s) "
    "SELECT row, side, round(m, 2) AS m, round(CASE WHEN active = 1 THEN k ELSE -k END * m, 2) AS coef, round(rhs + CASE WHEN active = 1 THEN k * m ELSE 0 END, 2) AS bound FROM m"
)
def bigm_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("row")).agg(F.round(F.min("o_totalprice") + 10, 2).alias("rhs"), F.round(F.max("o_totalprice"), 2).alias("hi"), F.round(F.min("o_totalprice"), 2).alias("lo"))
    o = o.withColumn("comparator", F.element_at(F.array(*map(F.lit, ("le", "ge", "eq"))), (F.col("row") % 3 + 1).cast("int"))).withColumn("active", F.col("row") % 2)
    return bigm.big_m(o).select("row", "side", *[F.round(c, 2).alias(c) for c in ("m", "coef", "bound")])


# ---- graphs: of each nation, its customers (variables), their orders (constraints) and itself (objective)


def _graph(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("fid"), "c_custkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("fid"))
    oc = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    nodes = c.select("fid", (F.col("c_custkey") * 2).alias("id"), F.lit("variable").alias("cls"))
    nodes = nodes.unionByName(oc.select("fid", (F.col("o_orderkey") * 2 + 1).alias("id"), F.lit("constraint").alias("cls")))
    nodes = nodes.unionByName(n.select("fid", (-1 - F.col("fid")).cast("long").alias("id"), F.lit("objective").alias("cls")))
    return nodes, oc.select("fid", (F.col("o_orderkey") * 2 + 1).alias("src"), (F.col("c_custkey") * 2).alias("dst"))


_GRAPH = (
    "WITH c AS (SELECT c_nationkey AS fid, c_custkey FROM customer), oc AS (SELECT fid, o_orderkey, c_custkey FROM orders JOIN c ON o_custkey = c_custkey), "
    "m AS (SELECT n_nationkey AS fid, (SELECT count(*) FROM c WHERE fid = n_nationkey) AS v, (SELECT count(*) FROM oc WHERE fid = n_nationkey) AS k FROM nation) "
)


@query(_GRAPH + "SELECT * FROM (SELECT fid, 'variable' AS cls, v AS n FROM m UNION ALL SELECT fid, 'constraint', k FROM m UNION ALL SELECT fid, 'objective', 1 FROM m) WHERE n > 0")
def node_counts(spark, sf_dir):
    return metrics.node_counts(_graph(spark, sf_dir)[0])


@query(
    _GRAPH + "SELECT fid, round(CASE WHEN v + k > 0 THEN k / ((v + k + 1.0) * (v + k)) ELSE 0 END, 9) AS density, "
    "round(CASE WHEN v > 0 THEN k / v ELSE CASE WHEN k > 0 THEN 'inf'::DOUBLE ELSE 0 END END, 9) AS ratio, greatest(k, 1) * greatest(v, 1) AS size, v > 0 AND k > 0 AS complete FROM m"
)
def structural_summary(spark, sf_dir):
    return metrics.summary(*_graph(spark, sf_dir))


@query(_GRAPH + "SELECT fid, v + 1 AS parts, CASE WHEN v = 0 THEN 1 ELSE 0 END AS coherent FROM m")
def coherence_components(spark, sf_dir):
    return metrics.coherence(*_graph(spark, sf_dir))


def _geo(spark, sf_dir):
    """One graph: regions, nations and suppliers."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    up = n.select(F.lit(0).alias("fid"), F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    low = s.select(F.lit(0).alias("fid"), F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"))
    edges = up.unionByName(low)
    return edges.select("fid", F.col("src").alias("id")).unionByName(edges.select("fid", F.col("dst").alias("id"))).distinct().withColumn("cls", F.lit("variable")), edges


@query(
    """WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS a, 'r' || n_regionkey AS b FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w(s, x, d) AS (SELECT DISTINCT a, a, 0 FROM u UNION SELECT s, u.b, d + 1 FROM w JOIN u ON u.a = x WHERE d < 6),
p AS (SELECT s, x, min(d) AS d FROM w GROUP BY s, x), c AS (SELECT s, min(x) AS root FROM p GROUP BY s), k AS (SELECT root, count(*) AS n FROM c GROUP BY root),
best AS (SELECT root FROM k ORDER BY n DESC, root LIMIT 1)
SELECT 0 AS fid, max(d) AS diameter FROM p JOIN c USING (s) WHERE root = (SELECT root FROM best)"""
)
def graph_diameter(spark, sf_dir):
    return metrics.diameter(*_geo(spark, sf_dir))


# ---- validation


@query("SELECT 'unknown-customer' AS code, CAST(o_custkey AS VARCHAR) AS subject FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def validate_undeclared(spark, sf_dir):
    known = table(spark, sf_dir, "customer").filter("c_acctbal > 0")
    return checks.undeclared(table(spark, sf_dir, "orders"), "o_custkey", known, "c_custkey", "unknown-customer")


@query("SELECT 'unused-symbol' AS code, CAST(c_custkey AS VARCHAR) AS subject FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def unused_symbols(spark, sf_dir):
    return checks.unused(table(spark, sf_dir, "customer"), "c_custkey", table(spark, sf_dir, "orders"), "o_custkey", "unused-symbol")


@query("SELECT 'duplicate-names' AS code, p_name AS subject, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def duplicate_names(spark, sf_dir):
    return checks.duplicates(table(spark, sf_dir, "part"), "p_name")


@query("SELECT source, CASE max(CASE WHEN n_chars < 100 THEN 2 WHEN n_chars < 200 THEN 1 ELSE 0 END) WHEN 2 THEN 'invalid' WHEN 1 THEN 'valid_with_warnings' ELSE 'valid' END AS verdict FROM documents GROUP BY source")
def verdicts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", F.when(F.col("n_chars") < 100, "error").when(F.col("n_chars") < 200, "warn").otherwise("ok").alias("level"))
    return checks.verdict(d)


# ---- lexical

_SPLIT = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\\[A-Za-z]+', ' ', 'g'), '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g')"
_STOP = ", ".join(f"'{w}'" for w in L.STOP_WORDS)
_TOKENS = "list_filter(string_split(lower(regexp_replace(" + _SPLIT.format("text") + f", '[^0-9A-Za-z]+', ' ', 'g')), ' '), lambda t: length(t) >= 2 AND NOT regexp_full_match(t, '[0-9]+') AND t NOT IN ({_STOP}))"
_LEMMA = (
    "CASE " + " ".join(f"WHEN t = '{k}' THEN '{v}'" for k, v in L.IRREGULAR.items()) + " WHEN ends_with(t, 'ies') AND length(t) > 4 THEN t[:-4] || 'y' "
    "WHEN length(t) > 3 AND regexp_matches(t, '(s|x|z|ch|sh)es$') THEN t[:-3] WHEN ends_with(t, 's') AND NOT ends_with(t, 'ss') AND length(t) > 3 THEN t[:-2] "
    "WHEN ends_with(t, 'ing') AND length(t) > 5 THEN t[:-4] WHEN ends_with(t, 'ed') AND length(t) > 4 THEN t[:-3] ELSE t END"
)


@query(f"SELECT conv_id, turn, array_to_string({_TOKENS}, ' ') AS tokens FROM conversations")
def tokenize(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(L.tokenize(F.col("text")), " ").alias("tokens"))


@query(f"SELECT conv_id, turn, array_to_string(list_transform({_TOKENS}, lambda t: {_LEMMA}), ' ') AS lemmas FROM conversations")
def lemmatize(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.transform(L.tokenize(F.col("text")), L.lemmatize), " ").alias("lemmas"))


def _bags(spark, sf_dir, name="documents"):
    key = {"documents": F.col("doc_id"), "benchmark": F.col("item_id")}[name]
    return mining.concept_bags(table(spark, sf_dir, name).select(key.alias("doc"), "text"))


_SINGLE = {k: v for k, v in L.phrase_index().items() if " " not in k}
_CONCEPT = "CASE " + " ".join(f"WHEN w = '{k}' THEN '{v}'" for k, v in _SINGLE.items()) + " ELSE w END"


def _bag_sql(name: str, key: str) -> str:
    # No phrase of two lemmas is in the test texts; the phrase scan itself is tested on its own.
    return f"SELECT {key} AS doc, concept, count(*) AS tf FROM (SELECT {key}, {_CONCEPT} AS concept FROM (SELECT {key}, unnest(list_transform({_TOKENS}, lambda t: {_LEMMA})) AS w FROM {name})) GROUP BY 1, 2"


@query(_bag_sql("documents", "doc_id"))
def concept_bag(spark, sf_dir):
    return _bags(spark, sf_dir)


@query(f"SELECT concept, row_number() OVER (ORDER BY concept) - 1 AS position FROM (SELECT DISTINCT concept FROM ({_bag_sql('documents', 'doc_id')}))")
def vocabulary(spark, sf_dir):
    return mining.vocabulary(_bags(spark, sf_dir))


_TFIDF = "WITH b AS ({0}), n AS (SELECT count(DISTINCT doc) AS n FROM b), d AS (SELECT concept, count(*) AS df FROM b GROUP BY concept), w AS (SELECT doc, concept, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM b JOIN d USING (concept), n) "


@query(_TFIDF.format(_bag_sql("documents", "doc_id")) + "SELECT doc, concept, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc)), 6) AS weight FROM w")
def tfidf_vectors(spark, sf_dir):
    return mining.tf_idf(_bags(spark, sf_dir)).select("doc", "concept", F.round("weight", 6).alias("weight"))


@query(
    _TFIDF.format(_bag_sql("benchmark", "item_id")) + ", v AS (SELECT doc, concept, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS x FROM w) "
    "SELECT a.doc AS a, b.doc AS b, round(greatest(0, least(2, 1 - sum(a.x * b.x))), 6) AS distance FROM v a JOIN v b ON a.concept = b.concept AND a.doc < b.doc GROUP BY 1, 2"
)
def sparse_distances(spark, sf_dir):
    return mining.sparse_distances(mining.tf_idf(_bags(spark, sf_dir, "benchmark"))).select("a", "b", F.round("distance", 6).alias("distance"))


def _tags_sql() -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(s, '{p}', 'i') THEN '{t}' END" for t, p in L.TYPE_PATTERNS.items()) + "], lambda x: x IS NOT NULL), ',')"


@query(f"SELECT doc_id, {_tags_sql()} AS tags FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'track capacity order' WHEN 1 THEN 'Big-M constraint' WHEN 2 THEN 'flow  balance, headway' ELSE 'cancelled re-timing' END || ' ' || text AS s FROM documents)")
def classify_keywords(spark, sf_dir):
    head = F.element_at(F.array(*map(F.lit, ("track capacity order", "Big-M constraint", "flow  balance, headway", "cancelled re-timing"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(L.type_tags(F.concat_ws(" ", head, "text")), ",").alias("tags"))


@query("SELECT p_partkey, CASE WHEN p_type ILIKE '%steel%' THEN 'metal' WHEN p_type ILIKE '%copper%' THEN 'metal' WHEN p_type ILIKE 'promo%' THEN 'offer' ELSE 'other' END AS role FROM part")
def first_match_role(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_type").ilike("%steel%") | F.col("p_type").ilike("%copper%"), "metal").when(F.col("p_type").ilike("promo%"), "offer").otherwise("other").alias("role"))


@query("SELECT p_partkey, lower(trim(regexp_replace(p_brand, '[^0-9A-Za-z_]+', ' ', 'g'))) || '|' || p_size || '|' || lower(trim(regexp_replace(p_name, '[^0-9A-Za-z_]+', ' ', 'g'))) AS key, regexp_replace(lower(p_type), '[^a-z0-9_.-]+', '_', 'g') AS slug FROM part")
def bibliographic_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", L.bibliographic_key(F.col("p_brand"), F.col("p_size"), F.col("p_name")).alias("key"), L.slug(F.col("p_type")).alias("slug"))


def _sniff_sql() -> str:
    def re2(p: str) -> tuple[str, str]:
        import re

        m = re.match(r"\(\?([msi]+)\)", p)
        return (p[m.end() :], m[1]) if m else (p, "")

    scores = []
    for i, f in enumerate(L.FORMATS):
        cases = " + ".join("CASE WHEN regexp_matches(s, '(?{0}){1}') THEN {2} ELSE 0 END".format(fl or "s", p.replace("'", "''"), n) for q, n in L.INDICATORS[f] for p, fl in [re2(q)])
        scores.append(f"SELECT doc_id, '{f}' AS format, {i} AS rank, {cases} AS score FROM d")
    return " UNION ALL ".join(scores)


_SAMPLES = ("Minimize\n obj: x\nSubject To\n c: x >= 1\nEnd\n", "ROWS\n N obj\nCOLUMNS\n x obj 1\nRHS\nENDATA\n", "var x >= 0;\nminimize cost: 2 * x;\nsubject to c: x >= 1;\n", "using JuMP\n@variable(m, x >= 0)\n@objective(m, Min, x)\n", "")


def _sample() -> Column:
    return F.element_at(F.array(*map(F.lit, _SAMPLES)), (F.col("doc_id") % 5 + 1).cast("int"))


def _commented() -> Column:
    """A model in one of the formats, with the whole text of the document before it as comments."""
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("doc_id") % 5 + 1).cast("int"))
    lines = F.regexp_replace(F.coalesce("text", F.lit("")), r"\R", "\n")
    return F.concat(pick(("\\ ", "* ", "# ", "# ", "\\ ")), F.replace(lines, F.lit("\n"), F.concat(F.lit("\n"), pick(("\\ ", "* ", "# ", "# ", "\\ ")))), F.lit("\n"), _sample())


_SAMPLE_SQL = "CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SAMPLES)) + " END"


@query(f"WITH d AS (SELECT doc_id, {_SAMPLE_SQL} || text AS s FROM documents), r AS ({_sniff_sql()}) SELECT doc_id, arg_min(format, (-score, rank)) AS format, max(score) AS score FROM r WHERE score > 0 GROUP BY doc_id")
def sniff_format(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.get(L.format_scores(F.concat(_sample(), "text")), 0).alias("r"))
    return d.filter("r IS NOT NULL").select("doc_id", "r.format", "r.score")


@query(
    "SELECT doc_id, len(b) AS blocks, coalesce(b[1], '') AS head FROM (SELECT doc_id, regexp_extract_all(s, '(?s)```[ \\t]*[A-Za-z0-9_+-]*[ \\t]*\\r?\\n(.*?)\\r?\\n?```', 1) AS b "
    "FROM (SELECT doc_id, text || chr(10) || '```lp' || chr(10) || left(text, 20) || chr(10) || '```' AS s FROM documents))"
)
def fences(spark, sf_dir):
    b = L.fence_blocks(F.concat("text", F.lit("\n```lp\n"), F.left(F.col("text"), F.lit(20)), F.lit("\n```")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(b).alias("blocks"), F.coalesce(F.get(b, 0), F.lit("")).alias("head"))


def _repair_sql(x: str) -> str:
    for a, b in L.REPAIRS.items():
        x = f"replace({x}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return x


@query("SELECT doc_id, md5(" + _repair_sql("text || ' − ≤ … ’'") + ") AS repaired, regexp_matches(rtrim(text, ' ' || chr(10) || chr(9)), '[\\\\+\\-*/=,(&_^{\\[]$') AS dangling FROM documents")
def unicode_repair(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(L.repair_unicode(F.concat("text", F.lit(" − ≤ … ’"))).cast("binary")).alias("repaired"), L.dangling_tail(F.col("text")).alias("dangling"))


# ---- vectors, clusters, agreement


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


_COSINE = "1 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round(greatest(0, {_COSINE}), 6) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label = b.label")
def cosine_pairs(spark, sf_dir):
    return mining.label_distances(_vectors(spark, sf_dir))


@query(
    f"WITH p AS (SELECT a.vec_id AS id, a.label AS la, b.label AS lb, greatest(0, {_COSINE}) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), "
    "m AS (SELECT id, la, lb, avg(d) AS d FROM p GROUP BY 1, 2, 3), s AS (SELECT id, any_value(la) AS label, max(d) FILTER (la = lb) AS i, min(d) FILTER (la <> lb) AS o FROM m GROUP BY id) "
    "SELECT label, round(avg(coalesce((o - i) / greatest(o, i), 0)), 6) AS silhouette FROM s GROUP BY label"
)
def silhouette_by_label(spark, sf_dir):
    return mining.label_silhouettes(_vectors(spark, sf_dir)).groupBy("label").agg(F.round(F.avg("silhouette"), 6).alias("silhouette"))


@query(
    "WITH p AS (SELECT label AS x, vec_id % 7 AS y FROM embeddings), c AS (SELECT x, y, count(*) AS n FROM p GROUP BY 1, 2), s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS i, "
    "(SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY x)) AS a, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY y)) AS b, (SELECT sum(n) * (sum(n) - 1) / 2 FROM c) AS t) "
    "SELECT round((i - a * b / t) / ((a + b) / 2 - a * b / t), 9) AS ari FROM s"
)
def adjusted_rand(spark, sf_dir):
    return mining.adjusted_rand(table(spark, sf_dir, "embeddings").select(F.col("label").alias("x"), (F.col("vec_id") % 7).alias("y")))


@query(
    "WITH s AS (SELECT count(*) AS n, count(*) FILTER (quality = toxic) AS same, sum(quality) AS q, sum(toxic) AS t FROM labels) "
    "SELECT round((same / n - (q * t + (n - q) * (n - t)) / (n * n)) / (1 - (q * t + (n - q) * (n - t)) / (n * n)), 9) AS kappa FROM s"
)
def kappa_quality_toxic(spark, sf_dir):
    return mining.cohen_kappa(table(spark, sf_dir, "labels").select(F.col("quality").alias("x"), F.col("toxic").alias("y")))


@query(
    "WITH p AS (SELECT lang, count(*) / (SELECT count(*) FROM documents WHERE doc_id % 2 = 0) AS p FROM documents WHERE doc_id % 2 = 0 GROUP BY lang), "
    "q AS (SELECT lang, count(*) / (SELECT count(*) FROM documents WHERE doc_id % 2 = 1) AS q FROM documents WHERE doc_id % 2 = 1 GROUP BY lang) "
    "SELECT round(sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2, 9) AS drift FROM p FULL JOIN q USING (lang)"
)
def drift_tv(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return mining.drift(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1"), "lang")


@query(
    "WITH m AS (SELECT l.quality AS g, CASE WHEN l.doc_id % 5 = 0 THEN NULL WHEN d.n_chars > 500 THEN 1 ELSE 0 END AS p FROM labels l JOIN documents d USING (doc_id)) "
    "SELECT label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM (SELECT g AS label, CASE WHEN g = p THEN 1 ELSE 0 END AS tp, 0 AS fp, CASE WHEN p IS NULL OR g <> p THEN 1 ELSE 0 END AS fn FROM m "
    "UNION ALL SELECT p, 0, 1, 0 FROM m WHERE p <> g) GROUP BY label"
)
def gold_scores(spark, sf_dir):
    gold = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    made = table(spark, sf_dir, "documents").filter("doc_id % 5 != 0").select(F.col("doc_id").alias("id"), F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("label"))
    return mining.gold_scores(gold, made)


_CONF = "round((e.event_id % 100) / 100.0, 2)"


@query(
    f"SELECT event_id, CASE WHEN user_id % 10 = 0 THEN CASE WHEN event_type = 'click' AND event_id % 7 <> 0 THEN 'auto' ELSE 'adjudicate' END WHEN event_id % 7 = 0 THEN 'adjudicate' "
    f"WHEN {_CONF} >= 0.7 AND (event_type <> 'click' OR event_id % 3 = 0) THEN 'auto' WHEN {_CONF} < 0.4 THEN 'defer' ELSE 'adjudicate' END AS gate FROM events e"
)
def gate_decisions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rule = F.when(F.col("event_type") == "click", "a")
    model = F.when(F.col("event_id") % 3 == 0, "a").otherwise("b")
    return e.select("event_id", mining.gate(rule, F.col("event_id") % 7 == 0, model, F.round((F.col("event_id") % 100) / 100, 2), F.col("user_id") % 10 != 0).alias("gate"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS value, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def latest_labels(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("value"))
    return mining.latest(e, "user_id", ["ts", "event_id"]).select("user_id", "value", "event_id")


_LOG = "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'adjudicate' ELSE 'defer' END AS gate, CASE WHEN event_id % 11 <> 0 THEN event_type END AS value, CASE event_id % 4 WHEN 0 THEN 'human' WHEN 1 THEN 'rule' WHEN 2 THEN 'model' END AS source, round((event_id % 50) / 50.0, 2) AS confidence FROM events"


@query(f"SELECT event_id, value, source, CASE source WHEN 'human' THEN 1.0 WHEN 'rule' THEN 0.9 ELSE confidence END AS confidence FROM ({_LOG}) WHERE gate <> 'defer' AND value IS NOT NULL AND source IS NOT NULL")
def replay_log(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    log = e.select(
        k, F.element_at(F.array(*map(F.lit, ("auto", "adjudicate", "defer"))), (k % 3 + 1).cast("int")).alias("gate"), F.when(k % 11 != 0, F.col("event_type")).alias("value"),
        F.when(k % 4 == 0, "human").when(k % 4 == 1, "rule").when(k % 4 == 2, "model").alias("source"), F.round((k % 50) / 50, 2).alias("confidence"),
    )
    return mining.replay(log).select("event_id", "value", "source", "confidence")


@query(
    "WITH f AS (SELECT doc_id AS id, 'lang:' || lang AS feature FROM documents UNION ALL SELECT doc_id, 'source:' || source FROM documents), "
    "r(feature, label, confidence) AS (VALUES ('lang:en', 'english', 0.9), ('lang:de', 'other', 0.8), ('source:src1', 'english', 0.7), ('source:src2', 'other', 0.6)), "
    "x AS (SELECT id, list_sort(list_distinct(list(label))) AS l, max(confidence) AS c FROM f JOIN r USING (feature) GROUP BY id) "
    "SELECT id, CASE WHEN len(l) = 1 THEN l[1] END AS label, CASE WHEN len(l) = 1 THEN CAST(c AS DOUBLE) END AS confidence, len(l) > 1 AS conflict FROM x"
)
def rule_layer(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    f = d.select(F.col("doc_id").alias("id"), F.explode(F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source"))).alias("feature"))
    rules = spark.sql("SELECT * FROM VALUES ('lang:en', 'english', 0.9D), ('lang:de', 'other', 0.8D), ('source:src1', 'english', 0.7D), ('source:src2', 'other', 0.6D) AS t(feature, label, confidence)")
    return mining.apply_rules(f, rules)


@query("SELECT label, concept, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY weight DESC, concept) AS rank FROM (SELECT source AS label, lang AS concept, count(*) AS weight FROM documents GROUP BY 1, 2)) WHERE rank <= 2")
def top_concepts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("label"), F.col("lang").alias("concept")).agg(F.count("*").alias("weight"))
    return mining.top_per_group(d, "label", [F.col("weight").desc(), "concept"], 2)


@query("SELECT p_partkey AS id, CASE n WHEN 1 THEN base ELSE base || '_' || n END AS name FROM (SELECT p_partkey, p_brand AS base, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)")
def unique_names(spark, sf_dir):
    return mining.unique_names(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("base")), "base", "id").select("id", "name")


# ---- corpus


@query(
    """WITH RECURSIVE d AS (SELECT c_custkey AS id, CAST(floor(c_acctbal / 2) AS BIGINT) AS k1, c_nationkey * 1000 + c_custkey % 97 AS k2 FROM customer),
e AS (SELECT a.id AS x, b.id AS y FROM d a JOIN d b ON (a.k1 = b.k1 OR a.k2 = b.k2)),
w(x, y) AS (SELECT x, y FROM e UNION SELECT w.x, e.y FROM w JOIN e ON e.x = w.y),
g AS (SELECT x AS id, min(y) AS group_id FROM w GROUP BY x) SELECT id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size FROM g"""
)
def dedup_groups(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.floor(F.col("c_acctbal") / 2).alias("k1"), (F.col("c_nationkey") * 1000 + F.col("c_custkey") % 97).alias("k2"))
    return corpus.duplicate_groups(c, "id", ["k1", "k2"])


_TIER = "CASE p_size % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE 6 END"


@query(f"SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CAST(floor(p_retailprice / 100) AS BIGINT) DESC, {_TIER}, p_partkey) AS n FROM part) WHERE n = 1")
def representatives(spark, sf_dir):
    tier = F.element_at(F.array(*map(F.lit, ("A_star", "A", "B", "C", "preprint", "unknown"))), (F.col("p_size") % 6 + 1).cast("int"))
    return corpus.representatives(table(spark, sf_dir, "part"), "p_brand", F.floor(F.col("p_retailprice") / 100), tier, "p_partkey").select("p_brand", "p_partkey")


@query(
    "WITH l AS (SELECT o_custkey AS id, 'N' AS k, 'order|' || o_orderstatus AS line FROM orders UNION ALL SELECT o_custkey, 'E', o_orderstatus || '>' || o_orderpriority FROM orders) "
    "SELECT id, sha256('N' || chr(10) || coalesce(string_agg(line, chr(10) ORDER BY line) FILTER (k = 'N'), '') || chr(10) || 'E' || chr(10) || coalesce(string_agg(line, chr(10) ORDER BY line) FILTER (k = 'E'), '')) AS hash FROM l GROUP BY id"
)
def structure_hash(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    n = o.select(F.col("o_custkey").alias("id"), F.lit("N").alias("kind"), F.concat(F.lit("order|"), "o_orderstatus").alias("line"))
    e = o.select(F.col("o_custkey").alias("id"), F.lit("E").alias("kind"), F.concat_ws(">", "o_orderstatus", "o_orderpriority").alias("line"))
    return corpus.structure_hash(n.unionByName(e), "id", "kind", "line")


# ---- formulations: SQL reads the same documents as JSON; for sequential algorithms, known answers are in the tests


@query(S.SCHEMA_NODES)
def schema_nodes(spark, sf_dir):
    return views.schema_nodes(formulations.catalog(spark)).withColumn("shape", F.array_join("shape", ","))


@query(S.SCHEMA_EDGES)
def schema_edges(spark, sf_dir):
    return views.schema_edges(formulations.catalog(spark))


@query(S.HYBRID_LABELS)
def hybrid_labels(spark, sf_dir):
    return views.hybrid_labels(formulations.catalog(spark))


@query(S.FLAGS)
def presence_flags(spark, sf_dir):
    return views.flags(formulations.catalog(spark))


@query(S.FINDINGS)
def formulation_findings(spark, sf_dir):
    return views.findings(formulations.catalog(spark, faulty=True))


@query(S.TYPES)
def formulation_types(spark, sf_dir):
    return views.type_counts(formulations.catalog(spark))


@query(S.GROUND_TEMPLATE)
def ground_template(spark, sf_dir):
    """Suppliers as sites that reach regions by their balance, as a sparse matrix."""
    f = formulations.catalog(spark).filter("id = 'coverage'").first()
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    reach = s.select(F.col("n_regionkey").cast("long").alias("k0"), F.col("s_suppkey").cast("long").alias("k1"), F.col("s_acctbal").cast("double").alias("value"))
    price = s.select(F.col("s_suppkey").cast("long").alias("k0"), (F.col("s_suppkey") % 7 + 1).cast("double").alias("value"))
    n = s.count()
    return templates.Grounder(spark, f, {"D": 5, "S": n}, {"reach": reach, "price": price, "worth": [1, 2, 3, 4, 5], "budget": 9}).matrix()[1]


@query()
def cluster_embeddings(spark, sf_dir):
    """The vectors of each label by average linkage."""
    return grouped.cluster_groups(_vectors(spark, sf_dir).select(F.col("label").alias("grp"), "id", "vec"))


@query()
def parse_formats(spark, sf_dir):
    """Texts of all formats, each with a whole document as its comments, through the readers, and what fails."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("path"), F.element_at(F.array(*map(F.lit, ("lp", "mps", "ampl", "jump", "lp"))), (F.col("doc_id") % 5 + 1).cast("int")).alias("fmt"), _commented().alias("text"))
    return formats.parse(d).select("path", "fmt", "stage", "message", F.to_json("model").alias("model"))


@query(S.GROUND_NODES)
def ground_view(spark, sf_dir):
    f = formulations.catalog(spark).filter("id = 'lots'").first()
    return templates.Grounder(spark, f, {"P": 25}, {"need": [3] * 25, "fixed": 5, "most": 100}).view()


@query()
def review_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("source"), _commented().alias("text"), F.lit(None).cast("string").alias("fmt"))
    return review.reviews(d)


@query()
def taxonomy_levels(spark, sf_dir):
    return taxonomy.induce(formulations.catalog(spark))


@query()
def drawings(spark, sf_dir):
    f = formulations.catalog(spark)
    return taxonomy.svg(views.schema_nodes(f), views.schema_edges(f))


@query()
def latex_texts(spark, sf_dir):
    """fid, text and description; one Python call for each formulation."""
    f = formulations.catalog(spark)

    def run(batches):
        import json

        import pandas as pd

        for pdf in batches:
            docs = [json.loads(x) for x in pdf["doc"]]
            yield pd.DataFrame({"fid": [d["id"] for d in docs], "text": [latex.write(d) for d in docs], "description": [latex.describe(d) for d in docs]})

    return f.select(F.to_json(F.struct(*[c for c in f.columns if c != "corrupt"])).alias("doc")).mapInPandas(run, "fid string, text string, description string")


@query(S.HASHES)
def structure_hashes(spark, sf_dir):
    return corpus.structure_hash(views.structure_lines(formulations.catalog(spark)), "fid", "kind", "line")


def _renamed(spark, sf_dir) -> DataFrame:
    """The catalog once for each nation, each document with a name of its own: graphs that are the same but for names."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("k"))
    return formulations.catalog(spark).crossJoin(F.broadcast(n)).withColumn("id", F.concat("id", F.lit("_"), "k")).drop("k")


@query(S.ISOMORPHISM)
def isomorphism_classes(spark, sf_dir):
    """Which schema graphs are the same but for names: of the catalog's documents, each in a copy for every nation."""
    f = _renamed(spark, sf_dir)
    classes = corpus.isomorphism_classes(views.schema_nodes(f), views.schema_edges(f))
    return corpus.isomorphism_report(f.select(F.col("family").alias("cluster"), F.col("id").alias("fid")), classes)


@query(S.HYBRID_EDGES)
def hybrid_view(spark, sf_dir):
    return views.hybrid_edges(formulations.catalog(spark))


@query(S.GROUND_EDGES)
def ground_edges(spark, sf_dir):
    f = formulations.catalog(spark).filter("id = 'lots'").first()
    return templates.Grounder(spark, f, {"P": 25}, {"need": [3] * 25, "fixed": 5, "most": 100}).edges()


@query(S.SIGNATURES)
def signature_texts(spark, sf_dir):
    return signatures.signatures(formulations.catalog(spark)).select("fid", "part", "name", signatures.canonical().alias("signature"))


@query(S.FACETS)
def signature_features(spark, sf_dir):
    return signatures.features(signatures.signatures(formulations.catalog(spark))).filter("NOT startswith(feature, 'concept:')")


@query("SELECT label, row_number() OVER (ORDER BY label) - 1 AS position FROM (SELECT DISTINCT n_name AS label FROM nation UNION SELECT 'unassigned')")
def label_vocabulary(spark, sf_dir):
    return signatures.vocabulary(table(spark, sf_dir, "nation"), "n_name")


@query(
    "WITH r AS (SELECT s_nationkey AS cluster, s_suppkey AS id, CASE WHEN s_nationkey % 3 = 0 THEN 0 ELSE greatest(0, floor(s_acctbal)) END AS cites, CASE s_suppkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 6 END AS q FROM supplier), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY cites DESC, q, id) AS place FROM r) "
    "SELECT cluster, CASE WHEN any_value(cites) FILTER (place = 1) > 0 THEN any_value(id) FILTER (place = 1) WHEN cluster % 2 = 0 THEN -1 - cluster ELSE any_value(id) FILTER (place = 1) END AS chosen, "
    "CASE WHEN any_value(cites) FILTER (place = 1) > 0 THEN 'highest_citation' WHEN cluster % 2 = 0 THEN 'benchmark_fallback' ELSE 'next_highest_fallback' END AS reason, string_agg(id, ',' ORDER BY place) AS ranked FROM k GROUP BY cluster"
)
def representative_choices(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    cites = F.when(F.col("s_nationkey") % 3 == 0, 0).otherwise(F.greatest(F.lit(0), F.floor("s_acctbal"))).cast("long")
    tier = F.element_at(F.array(F.lit("A"), F.lit("C"), F.lit("?")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    clusters, records = s.select(F.col("s_nationkey").alias("cluster"), F.col("s_suppkey").cast("long").alias("id")), s.select(F.col("s_suppkey").cast("long").alias("id"), cites.alias("citations"), tier.alias("tier"))
    spare = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("cluster"), (-1 - F.col("n_nationkey")).cast("long").alias("id"))
    return corpus.select_representatives(clusters, records, spare).withColumn("ranked", F.array_join(F.col("ranked").cast("array<string>"), ","))

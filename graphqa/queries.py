"""Registered queries over the star schema seen as a graph, each with its SQL equivalent."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stats
from .functions import terms
from .operators import annotate as ops
from .operators.validate import Validator
from .plans import reduce as red
from .plans.compile import Compiler
from .plans.shapes import Constraint, Shape
from .plans.sparql import parse
from .sources import turtle
from .sources.store import BASE, key_of, node, tpch_store
from .storage import shared_dir
from .streaming import regroup

PREFIX = f"PREFIX : <{BASE}>\n"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def ask(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return Compiler(tpch_store(spark, sf_dir)).run(parse(PREFIX + text))


def path(p: str) -> dict:
    return {"path": BASE + p.lstrip("^"), "inverse": p.startswith("^")}


def at_least(p: str, n: int, ref: str | None = None, value: str | None = None) -> Constraint:
    return Constraint("min", n=n, ref=ref, value=value, **path(p))


def at_most(p: str, n: int, ref: str | None = None, value: str | None = None) -> Constraint:
    return Constraint("max", n=n, ref=ref, value=value, **path(p))


def shape(name: str, cls: str | None, *constraints: Constraint, query: str | None = None) -> Shape:
    return Shape(name, cls and BASE + cls, query and PREFIX + query, tuple(constraints))


def facts(spark: SparkSession, sf_dir: str, shapes: list[Shape], names: list[str] | None = None) -> DataFrame:
    return Validator(tpch_store(spark, sf_dir), shapes).facts(names)


def keyed(df: DataFrame) -> DataFrame:
    return df.select(key_of("instance").alias("k"), "shape", "valid", "reason")


# ---- annotate ------------------------------------------------------------------------------

BUILDING = "SELECT ?c WHERE { ?c a :customer . ?c :c_mktsegment 'BUILDING' }"
TEN = [shape("Buyer", "customer", at_least("^o_custkey", 10))]
N_ORDERS = "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey"


@registered(f"SELECT c_custkey, coalesce(n, 0) >= 10 AS valid FROM customer LEFT JOIN ({N_ORDERS}) ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def annotate_min(spark, sf_dir):
    store, query = tpch_store(spark, sf_dir), parse(PREFIX + BUILDING)
    solutions = ops.with_ids(Compiler(store).run(query.as_result_query()))
    narrowed = red.replaced_targets(TEN, ["Buyer"], query)
    joined = ops.join_facts(ops.unpivot(solutions, ["c"]), Validator(store, TEN, narrowed).facts())
    return joined.select(key_of("instance").alias("c_custkey"), F.col("validation.valid").alias("valid"))


@registered(f"""SELECT c_custkey AS c, 'tpch:nation/' || c_nationkey AS n, 1 AS n_triples_type, 3 AS n_triples,
  CASE WHEN coalesce(n, 0) >= 10 THEN 'ts:satisfiesShape' ELSE 'ts:violatesShape' END AS report
FROM customer LEFT JOIN ({N_ORDERS}) ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'""")
def annotate_simple(spark, sf_dir):
    from .api import annotated

    text = PREFIX + "SELECT ?c ?n WHERE { ?c a :customer . ?c :c_mktsegment 'BUILDING' . ?c :c_nationkey ?n }"
    out = annotated(tpch_store(spark, sf_dir), {"query": text, "schema_dir": TEN, "target_shape": {"?c": "Buyer"}, "write_stats": False})
    typed = F.size(F.filter("triples", lambda t: t["p"].contains("type")))
    return out.select(F.substring_index(F.col("bindings")["c"], "/", -1).cast("bigint").alias("c"), F.col("bindings")["n"].alias("n"), typed.alias("n_triples_type"), F.size("triples").alias("n_triples"), F.col("report")[0]["p"].alias("report"))


# ---- graph patterns ------------------------------------------------------------------------


@registered("SELECT c_custkey AS c, c_name AS name, c_nationkey AS n FROM customer")
def bgp_star(spark, sf_dir):
    df = ask(spark, sf_dir, "SELECT ?c ?name ?n WHERE { ?c a :customer . ?c :c_name ?name . ?c :c_nationkey ?n }")
    return df.select(key_of("c").alias("c"), "name", key_of("n").alias("n"))


@registered("SELECT o_orderkey AS o, r_name AS r FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE o_orderstatus = 'F'")
def bgp_path(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT ?o ?r WHERE { ?o :o_orderstatus 'F' . ?o :o_custkey ?c . ?c :c_nationkey ?n . ?n :n_regionkey ?g . ?g :r_name ?r }").select(key_of("o").alias("o"), "r")


@registered("SELECT DISTINCT c_nationkey AS n FROM customer JOIN orders ON o_custkey = c_custkey")
def bgp_inverse(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT DISTINCT ?n WHERE { ?n ^:c_nationkey ?c . ?c ^:o_custkey ?o }").select(key_of("n").alias("n"))


@registered("SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey")
def bgp_optional(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT ?c ?o WHERE { ?c a :customer . OPTIONAL { ?c ^:o_custkey ?o . ?o :o_orderstatus 'P' } }").select(key_of("c").alias("c"), key_of("o").alias("o"))


@registered("SELECT DISTINCT a.l_orderkey AS o, a.l_suppkey AS a, b.l_suppkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey")
def bgp_filter_neq(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT DISTINCT ?o ?a ?b WHERE { ?o :suppliedBy ?a . ?o :suppliedBy ?b . FILTER(?a != ?b) }").select(key_of("o").alias("o"), key_of("a").alias("a"), key_of("b").alias("b"))


@registered("SELECT p_partkey AS p, p_size AS size FROM part WHERE p_size >= 20 AND (p_size < 30 OR p_brand = 'Brand#11') AND NOT p_size IN (25, 26)")
def bgp_filter_numeric(spark, sf_dir):
    text = "SELECT ?p ?size WHERE { ?p :p_size ?size . ?p :p_brand ?b . FILTER(?size >= 20 && (?size < 30 || ?b = 'Brand#11') && ?size NOT IN (25, 26)) }"
    return ask(spark, sf_dir, text).select(key_of("p").alias("p"), F.col("size").cast("int").alias("size"))


@registered("SELECT c_custkey AS c, c_mktsegment AS s FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def bgp_values(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT ?c ?s WHERE { VALUES ?s { 'BUILDING' 'MACHINERY' } ?c :c_mktsegment ?s }").select(key_of("c").alias("c"), "s")


@registered("SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier")
def bgp_union(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT ?name WHERE { { ?x :c_name ?name } UNION { ?x :s_name ?name } }")


@registered("SELECT DISTINCT c_custkey AS c FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderpriority = '1-URGENT'")
def bgp_subselect(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT DISTINCT ?c WHERE { { SELECT ?c WHERE { ?c :c_mktsegment 'BUILDING' } } { SELECT DISTINCT ?c WHERE { ?o :o_custkey ?c . ?o :o_orderpriority '1-URGENT' } } }").select(key_of("c").alias("c"))


@registered("SELECT n_name AS name FROM nation ORDER BY n_name LIMIT 7 OFFSET 5")
def bgp_slice(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT ?name WHERE { ?n :n_name ?name } ORDER BY ?name LIMIT 7 OFFSET 5")


@registered("SELECT c_nationkey AS n, count(*) AS customers, count(DISTINCT c_mktsegment) AS segments FROM customer GROUP BY c_nationkey")
def bgp_group_count(spark, sf_dir):
    df = ask(spark, sf_dir, "SELECT ?n (COUNT(?c) AS ?customers) (COUNT(DISTINCT ?s) AS ?segments) WHERE { ?c :c_nationkey ?n . ?c :c_mktsegment ?s } GROUP BY ?n")
    return df.select(key_of("n").alias("n"), "customers", "segments")


@registered("SELECT 'p_name' AS p, p_name AS o FROM part WHERE p_partkey = 7 UNION ALL SELECT 'p_brand', p_brand FROM part WHERE p_partkey = 7 UNION ALL SELECT 'p_type', p_type FROM part WHERE p_partkey = 7 UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR) FROM part WHERE p_partkey = 7")
def bgp_variable_predicate(spark, sf_dir):
    df = ask(spark, sf_dir, f"SELECT ?p ?o WHERE {{ <{BASE}part/7> ?p ?o . FILTER(isLiteral(?o)) }}")
    return df.select(F.substring_index("p", ":", -1).alias("p"), "o")


@registered("""
SELECT r_regionkey AS r, n.n_nationkey AS x, n.n_name AS name FROM region
LEFT JOIN (SELECT * FROM nation WHERE n_name LIKE 'F%') f ON f.n_regionkey = r_regionkey
JOIN nation n ON f.n_nationkey IS NULL OR n.n_nationkey = f.n_nationkey""")
def bgp_optional_chain(spark, sf_dir):
    text = "SELECT ?r ?x ?name WHERE { ?r a :region OPTIONAL { ?r ^:n_regionkey ?x . ?x :n_name ?f FILTER(STRSTARTS(?f, 'F')) } ?x :n_name ?name }"
    return ask(spark, sf_dir, text).select(key_of("r").alias("r"), key_of("x").alias("x"), "name")


@registered("SELECT c_custkey AS c, c_mktsegment AS k FROM customer")
def bgp_optional_twice(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT ?c ?k WHERE { ?c a :customer OPTIONAL { ?c :nothing ?k } OPTIONAL { ?c :c_mktsegment ?k } }").select(key_of("c").alias("c"), "k")


@registered("""
SELECT p_name AS name, n_name AS nation FROM part, nation WHERE p_size = 7
UNION ALL SELECT s_name, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def bgp_union_join(spark, sf_dir):
    text = "SELECT ?name ?nation WHERE { { ?x :p_name ?name . ?x :p_size 7 } UNION { ?x :s_name ?name . ?x :s_nationkey ?n } ?n :n_name ?nation }"
    return ask(spark, sf_dir, text)


@registered("SELECT c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def bgp_minus(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT ?c WHERE { ?c a :customer MINUS { ?o :o_custkey ?c . ?o :o_orderpriority '1-URGENT' } }").select(key_of("c").alias("c"))


@registered("""
SELECT c_custkey AS c FROM customer WHERE c_mktsegment <> 'BUILDING' AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')
AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '5-LOW')""")
def bgp_exists(spark, sf_dir):
    text = """SELECT ?c WHERE { ?c :c_mktsegment ?s FILTER(?s != 'BUILDING' && EXISTS { ?c ^:o_custkey ?o . ?o :o_orderstatus 'P' })
    FILTER NOT EXISTS { ?q :o_custkey ?c . ?q :o_orderpriority ?l FILTER(?l = '5-LOW') } }"""
    return ask(spark, sf_dir, text).select(key_of("c").alias("c"))


@registered("SELECT p_partkey AS p, CAST(p_size * 2 AS DOUBLE) AS twice FROM part WHERE p_size * 2 > 60")
def bgp_bind(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT ?p ?twice WHERE { ?p :p_size ?s BIND(?s * 2 AS ?twice) FILTER(?twice > 60) }").select(key_of("p").alias("p"), F.col("twice").cast("double").alias("twice"))


@registered("SELECT o_orderkey AS o, r_name AS r FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE o_orderpriority = '1-URGENT'")
def bgp_sequence_path(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT ?o ?r WHERE { ?o :o_orderpriority '1-URGENT' ; :o_custkey/:c_nationkey/:n_regionkey/:r_name ?r }").select(key_of("o").alias("o"), "r")


@registered("SELECT c_custkey AS c, c_name || chr(92) || 'new' || chr(10) || 'é😀\"' AS name, CASE WHEN c_custkey % 2 = 0 THEN 'en' ELSE '' END AS lang FROM customer")
def ntriples_scan(spark, sf_dir):
    """Escapes of every kind, in files that split."""
    path = f"{shared_dir(spark)}/ntriples-{uuid.uuid4().hex}"
    made = [F.lit(f"<{BASE}customer/"), F.col("c_custkey"), F.lit(f'> <{BASE}c_name> "'), F.col("c_name"), F.lit('\\\\new\\n\\u00e9\\U0001F600\\""'), F.when(F.col("c_custkey") % 2 == 0, "@en").otherwise(""), F.lit(" . # note")]
    spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(*made)).write.text(path)
    return turtle.read_rdf(spark, path, "ntriples").select(key_of("s").alias("c"), F.col("o").alias("name"), F.col("o_lang").alias("lang"))


@registered("SELECT c_custkey AS x, c_name AS name FROM customer WHERE c_custkey = 42")
def const_subject_star(spark, sf_dir):
    q = parse(PREFIX + f"SELECT ?name WHERE {{ <{BASE}customer/42> :c_name ?name }}").make_star()
    return Compiler(tpch_store(spark, sf_dir)).run(q).select(key_of("x").alias("x"), "name")


@registered("SELECT count(*) > 0 AS answer FROM customer WHERE c_mktsegment = 'BUILDING'")
def ask_boolean(spark, sf_dir):
    return ask(spark, sf_dir, "ASK { ?c :c_mktsegment 'BUILDING' }")


# ---- query rewrites ------------------------------------------------------------------------


@registered("SELECT c_custkey AS x FROM customer WHERE c_mktsegment = 'BUILDING' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def query_intersect(spark, sf_dir):
    a, b = parse(PREFIX + BUILDING), parse(PREFIX + "SELECT ?v WHERE { ?v ^:o_custkey ?x . ?x :o_orderstatus 'F' }")
    return Compiler(tpch_store(spark, sf_dir)).run(a.intersect(b, "c")).select(key_of("x").alias("x"))


@registered(f"SELECT c_custkey AS k, 'Buyer' AS shape, coalesce(n, 0) >= 10 AS valid, 'Buyer' AS reason FROM customer LEFT JOIN ({N_ORDERS}) ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def target_replacement(spark, sf_dir):
    narrowed = red.replaced_targets(TEN, ["Buyer"], parse(PREFIX + BUILDING))
    return keyed(Validator(tpch_store(spark, sf_dir), TEN, narrowed).facts())


@registered(f"SELECT c_custkey AS k, 'Buyer' AS shape, coalesce(n, 0) >= 10 AS valid, 'Buyer' AS reason FROM customer LEFT JOIN ({N_ORDERS}) ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def query_extension(spark, sf_dir):
    narrowed = red.replaced_targets(TEN, ["Buyer"], parse(PREFIX + BUILDING), True, {"Buyer": f"?x :c_nationkey <{BASE}nation/3>"})
    return keyed(Validator(tpch_store(spark, sf_dir), TEN, narrowed).facts())


@registered("SELECT 'bgp' AS q, 'c' AS target, '^o_custkey,c_name' AS predicates UNION ALL SELECT 'path', 'o', 'o_custkey,c_name'")
def query_analysis(spark, sf_dir):
    qs = {"bgp": "SELECT ?n ?c WHERE { ?c ^:o_custkey ?o . ?c :c_name ?n }", "path": "SELECT ?o WHERE { ?o :o_custkey ?c . ?c :c_name ?n }"}
    rows = [(k, q.target_var(), ",".join(p.replace(BASE, "") for p in q.predicates(ignore_inverse=False))) for k, t in qs.items() for q in [parse(PREFIX + t)]]
    return spark.createDataFrame(rows, "q string, target string, predicates string")


# ---- shapes --------------------------------------------------------------------------------


def one_shape(name: str, *constraints: Constraint, cls: str = "customer", extra: tuple[Shape, ...] = ()):
    def run(spark, sf_dir):
        return keyed(facts(spark, sf_dir, [shape("S", cls, *constraints), *extra], ["S"]))

    run.__name__ = name
    return run


def customers(test: str, reason: str = "'S'") -> str:
    return f"SELECT c_custkey AS k, 'S' AS shape, {test} AS valid, {reason} AS reason FROM customer LEFT JOIN ({N_ORDERS}) ON o_custkey = c_custkey"


registered(customers("coalesce(n, 0) >= 10"))(one_shape("min_count", at_least("^o_custkey", 10)))
registered(customers("coalesce(n, 0) <= 12"))(one_shape("max_count", at_most("^o_custkey", 12)))
registered(customers("coalesce(n, 0) BETWEEN 8 AND 12"))(one_shape("min_max", at_least("^o_custkey", 8), at_most("^o_custkey", 12)))
registered("SELECT c_custkey AS k, 'S' AS shape, coalesce(n, 0) = 0 AS valid, CASE WHEN coalesce(n, 0) = 0 THEN 'S' ELSE 'Pending' END AS reason FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey")(one_shape("zero_max", at_most("^o_custkey", 0, ref="Pending"), extra=(shape("Pending", None, query="SELECT ?x WHERE { ?x :o_orderstatus 'P' }"),)))
registered("SELECT c_custkey AS k, 'S' AS shape, c_mktsegment = 'BUILDING' AS valid, 'S' AS reason FROM customer")(one_shape("value_constraint", at_least("c_mktsegment", 1, value="BUILDING")))
registered(customers("coalesce(n, 0) >= 15 OR c_mktsegment = 'BUILDING'"))(one_shape("or_constraint", Constraint("or", options=(at_least("^o_custkey", 15), at_least("c_mktsegment", 1, value="BUILDING")))))
registered("SELECT c_custkey AS k, 'S' AS shape, true AS valid, 'S' AS reason FROM customer")(one_shape("no_constraint"))

LINES = "SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_orderkey"


def _qualified(kind, n):
    return (kind("^o_custkey", n, ref="BigOrder"),), (shape("BigOrder", "orders", at_least("hasPart", 5)),)


def qualified_sql(test: str) -> str:
    return f"SELECT c_custkey AS k, 'S' AS shape, {test} AS valid, CASE WHEN {test} THEN 'S' ELSE 'BigOrder' END AS reason FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders JOIN ({LINES}) l ON l_orderkey = o_orderkey AND l.n >= 5 GROUP BY o_custkey) ON o_custkey = c_custkey"


for _name, _kind, _n, _op in (("qualified_min", at_least, 3, ">="), ("qualified_max", at_most, 4, "<=")):
    _c, _extra = _qualified(_kind, _n)
    registered(qualified_sql(f"coalesce(n, 0) {_op} {_n}"))(one_shape(_name, *_c, extra=_extra))


@registered("SELECT n_nationkey AS k, 'Nation' AS shape, coalesce(n, 0) >= 30 AS valid, CASE WHEN coalesce(n, 0) >= 30 THEN 'Nation' ELSE 'Rich' END AS reason FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal IS NOT NULL GROUP BY 1) ON c_nationkey = n_nationkey")
def no_target_shape(spark, sf_dir):
    return keyed(facts(spark, sf_dir, [shape("Nation", "nation", at_least("^c_nationkey", 30, ref="Rich")), shape("Rich", None, at_least("c_acctbal", 1))], ["Nation"]))


CHAIN = [
    shape("Order", "orders", at_least("hasPart", 3)),
    shape("Customer", "customer", at_least("^o_custkey", 5, ref="Order")),
    shape("Nation", "nation", at_least("^c_nationkey", 20, ref="Customer")),
    shape("Region", "region", at_least("^n_regionkey", 2, ref="Nation")),
]
CHAIN_SQL = f"""
WITH o AS (SELECT o_orderkey, o_custkey, coalesce(n, 0) >= 3 AS ok FROM orders LEFT JOIN ({LINES}) ON l_orderkey = o_orderkey),
c AS (SELECT c_custkey, c_nationkey, count(*) FILTER (o.ok) >= 5 AS ok FROM customer LEFT JOIN o ON o_custkey = c_custkey GROUP BY ALL),
n AS (SELECT n_nationkey, n_regionkey, count(*) FILTER (c.ok) >= 20 AS ok FROM nation LEFT JOIN c ON c_nationkey = n_nationkey GROUP BY ALL),
r AS (SELECT r_regionkey, count(*) FILTER (n.ok) >= 2 AS ok FROM region LEFT JOIN n ON n_regionkey = r_regionkey GROUP BY ALL),
f AS (SELECT o_orderkey AS k, 'Order' AS shape, ok AS valid, 'Order' AS reason FROM o
UNION ALL SELECT c_custkey, 'Customer', ok, CASE WHEN ok THEN 'Customer' ELSE 'Order' END FROM c
UNION ALL SELECT n_nationkey, 'Nation', ok, CASE WHEN ok THEN 'Nation' ELSE 'Customer' END FROM n
UNION ALL SELECT r_regionkey, 'Region', ok, CASE WHEN ok THEN 'Region' ELSE 'Nation' END FROM r)
"""


@registered(CHAIN_SQL + "SELECT * FROM f")
def chain_validation(spark, sf_dir):
    return keyed(facts(spark, sf_dir, CHAIN))


@registered(CHAIN_SQL + "SELECT shape, count(*) FILTER (valid) AS valid, count(*) FILTER (NOT valid) AS invalid FROM f GROUP BY shape")
def shape_stats(spark, sf_dir):
    return ops.shape_stats(facts(spark, sf_dir, CHAIN))


@registered(f"""
WITH ok AS (SELECT c_custkey FROM customer JOIN ({N_ORDERS}) ON o_custkey = c_custkey WHERE n >= 10)
SELECT c_custkey AS k, 'Customer' AS shape, c_custkey IN (SELECT * FROM ok) AS valid, CASE WHEN c_custkey IN (SELECT * FROM ok) THEN 'Customer' ELSE 'Order' END AS reason FROM customer
UNION ALL SELECT o_orderkey, 'Order', o_custkey IN (SELECT * FROM ok), CASE WHEN o_custkey IN (SELECT * FROM ok) THEN 'Order' ELSE 'Customer' END FROM orders""")
def recursive_pair(spark, sf_dir):
    return keyed(facts(spark, sf_dir, [shape("Customer", "customer", at_least("^o_custkey", 10, ref="Order")), shape("Order", "orders", at_least("o_custkey", 1, ref="Customer"))]))


def _kcore_sql(rounds: int = 12) -> str:
    out = "WITH e AS (SELECT DISTINCT o_custkey AS c, l_partkey AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey),\nc0 AS MATERIALIZED (SELECT c_custkey AS c FROM customer), p0 AS MATERIALIZED (SELECT p_partkey AS p FROM part)"
    for k in range(1, rounds + 1):
        live = f"e JOIN c{k - 1} USING (c) JOIN p{k - 1} USING (p)"
        out += f",\nc{k} AS MATERIALIZED (SELECT c FROM {live} GROUP BY c HAVING count(*) >= 20), p{k} AS MATERIALIZED (SELECT p FROM {live} GROUP BY p HAVING count(*) >= 22)"
    return out + f"\nSELECT c AS k, 'Customer' AS shape FROM c{rounds} UNION ALL SELECT p, 'Part' FROM p{rounds}"


@registered(_kcore_sql())
def recursive_kcore(spark, sf_dir):
    shapes = [shape("Customer", "customer", at_least("bought", 20, ref="Part")), shape("Part", "part", at_least("^bought", 22, ref="Customer"))]
    return facts(spark, sf_dir, shapes).where("valid").select(key_of("instance").alias("k"), "shape")


# ---- reduction -----------------------------------------------------------------------------


@registered(customers("coalesce(n, 0) >= 10"))
def constraint_removal(spark, sf_dir):
    shapes = [shape("S", "customer", at_least("^o_custkey", 10), at_least("c_mktsegment", 1, value="BUILDING"))]
    query = parse(PREFIX + "SELECT ?c WHERE { ?c a :customer . ?c ^:o_custkey ?o }")
    return keyed(facts(spark, sf_dir, red.reduced_shapes(shapes, "S", query, remove=True)))


@registered("SELECT * FROM (VALUES ('Nation', 0), ('Customer', 1), ('Order', 2)) t(shape, place)")
def node_order(spark, sf_dir):
    return spark.createDataFrame(list(zip(red.node_order(CHAIN, ["Nation"]), range(9), strict=False)), "shape string, place int")


@registered("SELECT * FROM (VALUES ('Customer', 'Nation', 1.0::DOUBLE), ('Region', 'Order', 1.0::DOUBLE)) t(one, two, share)")
def overlap(spark, sf_dir):
    return spark.createDataFrame([(a, b, red.overlap(CHAIN, a, b)) for a, b in (("Customer", "Nation"), ("Region", "Order"))], "one string, two string, share double")


# ---- stages of the pipeline ----------------------------------------------------------------


@registered("SELECT o_orderkey AS o, 'c' AS var, 'tpch:customer/' || o_custkey AS instance FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, 'o', 'tpch:orders/' || o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def unpivot_results(spark, sf_dir):
    s = ops.with_ids(ask(spark, sf_dir, "SELECT ?o ?c WHERE { ?o :o_orderstatus 'P' . ?o :o_custkey ?c }"))
    long = ops.unpivot(s, ["o", "c"])
    return long.join(s.select("id", "o"), "id").select(key_of("o").alias("o"), "var", "instance")


def _facts_and_validation(spark, sf_dir):
    s = ops.with_ids(ask(spark, sf_dir, "SELECT ?o ?c WHERE { ?o :o_orderpriority '1-URGENT' . ?o :o_custkey ?c }"))
    return ops.unpivot(s, ["o", "c"]), facts(spark, sf_dir, TEN)


URGENT = f"(SELECT o.o_orderkey, o.o_custkey, coalesce(n.n, 0) >= 10 AS valid FROM orders o LEFT JOIN ({N_ORDERS}) n ON n.o_custkey = o.o_custkey WHERE o_orderpriority = '1-URGENT')"


@registered(f"SELECT 'o' AS var, o_orderkey AS k, NULL::BOOLEAN AS valid FROM {URGENT} UNION ALL SELECT 'c', o_custkey, valid FROM {URGENT}")
def left_join_facts(spark, sf_dir):
    return ops.join_facts(*_facts_and_validation(spark, sf_dir)).select("var", key_of("instance").alias("k"), F.col("validation.valid").alias("valid"))


@registered(f"SELECT 'c' AS var, o_custkey AS k, valid FROM {URGENT}")
def inner_join_facts(spark, sf_dir):
    return ops.equi_join(*_facts_and_validation(spark, sf_dir), ["instance"]).select("var", key_of("instance").alias("k"), "valid")


@registered("SELECT p_partkey AS k, CAST(p_size AS VARCHAR) AS key, p_size || '^^<int>' AS term FROM part")
def strip_datatype(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    t = terms.render(F.col("p_size").cast("string"), F.lit("literal"), F.lit("int"), F.lit(""))
    return p.select(F.col("p_partkey").alias("k"), terms.strip_datatype(t).alias("key"), t.alias("term"))


@registered(f"SELECT o_orderkey AS o, 2 AS n_facts, 1 AS n_validated FROM {URGENT}")
def regroup_blocking(spark, sf_dir):
    done = ops.regroup_blocking(ops.join_facts(*_facts_and_validation(spark, sf_dir)))
    return _counted(done)


def _counted(done: DataFrame) -> DataFrame:
    o = F.filter("result", lambda x: x["var"] == "o")[0]["instance"]
    return done.select(F.substring_index(o, "/", -1).cast("bigint").alias("o"), F.size("result").alias("n_facts"), F.size(F.filter("result", lambda x: x["validation"].isNotNull())).alias("n_validated"))


@registered(f"SELECT o_orderkey AS o, 2 AS n_facts, 1 AS n_validated FROM {URGENT} JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
def regroup_complete(spark, sf_dir):
    s, v = _facts_and_validation(spark, sf_dir)
    building = ask(spark, sf_dir, BUILDING).select(F.col("c").alias("instance"))
    split = v.join(building, "instance", "left_semi").unionAll(v.join(building, "instance", "left_anti").withColumn("shape", F.lit("Other")))
    return _counted(ops.regroup_complete(ops.join_facts(s, split), {"c": ["Buyer"]}))


@registered(ORACLE_SQL["regroup_complete"])
def stream_complete_early(spark, sf_dir):
    """The complete solutions again, each emitted from a stream of facts as soon as it is complete."""
    s, v = _facts_and_validation(spark, sf_dir)
    building = ask(spark, sf_dir, BUILDING).select(F.col("c").alias("instance"))
    split = v.join(building, "instance", "left_semi").unionAll(v.join(building, "instance", "left_anti").withColumn("shape", F.lit("Other")))
    path = f"{shared_dir(spark)}/facts-{uuid.uuid4().hex}"
    ops.join_facts(s, split).select("id", F.lit(2).alias("n_vars"), "var", "instance", "validation.*").write.parquet(f"{path}/in")
    early = regroup.complete_early(regroup.read_facts(spark, f"{path}/in"), {"c": ["Buyer"]})
    got = regroup.drain(early, path).groupBy("id").agg(F.max(F.when(F.col("var") == "o", F.col("instance"))).alias("o"), F.count("*").cast("int").alias("n_facts"), F.count("shape").cast("int").alias("n_validated"))
    return got.select(key_of("o").alias("o"), "n_facts", "n_validated")


@registered(f"SELECT DISTINCT CASE WHEN valid THEN 'validTargets' ELSE 'invalidTargets' END AS bucket, o_custkey AS k, 'Buyer' AS reason FROM {URGENT}")
def target_buckets(spark, sf_dir):
    return ops.test_output(ops.join_facts(*_facts_and_validation(spark, sf_dir)), {"c": ["Buyer"]}).select("bucket", key_of("instance").alias("k"), "reason")


EXPLAINED = "SELECT ?c ?n WHERE { ?c a :customer . ?c :c_mktsegment 'BUILDING' . ?c :c_nationkey ?n }"


def _explained(spark, sf_dir, column: str) -> DataFrame:
    store, query = tpch_store(spark, sf_dir), parse(PREFIX + EXPLAINED)
    solutions = ops.with_ids(Compiler(store).run(query.as_result_query()))
    joined = ops.join_facts(ops.unpivot(solutions, ["c", "n"]), Validator(store, TEN, red.replaced_targets(TEN, ["Buyer"], query)).facts())
    return ops.simple_output(ops.regroup_blocking(joined), query).select(F.explode(column).alias("t")).select("t.*")


@registered("""SELECT ':customer/' || c_custkey AS s, ':c_nationkey' AS p, ':nation/' || c_nationkey AS o FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT ':customer/' || c_custkey, ':c_mktsegment', 'BUILDING' FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT ':customer/' || c_custkey, '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', ':customer' FROM customer WHERE c_mktsegment = 'BUILDING'""")
def explain_triples(spark, sf_dir):
    return _explained(spark, sf_dir, "triples")


@registered(f"SELECT ':customer/' || c_custkey AS s, CASE WHEN coalesce(n, 0) >= 10 THEN 'ts:satisfiesShape' ELSE 'ts:violatesShape' END AS p, 'Buyer' AS o FROM customer LEFT JOIN ({N_ORDERS}) ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def report_triples(spark, sf_dir):
    return _explained(spark, sf_dir, "report")


@registered("SELECT event_type AS test, CAST(floor(min(epoch(ts))) AS BIGINT) AS tfft, CAST(floor(max(epoch(ts))) AS BIGINT) AS totaltime, count(*) AS comp FROM events GROUP BY event_type")
def stats_summary(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("test"), F.unix_timestamp("ts").alias("at"))
    return stats.summary(e, 0, keys=("test",)).select("test", F.col("tfft").cast("bigint").alias("tfft"), F.col("totaltime").cast("bigint").alias("totaltime"), "comp")


@registered("SELECT event_type AS test, user_id AS approach, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS answer, event_id AS time FROM events")
def trace(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("test"), F.col("user_id").alias("approach"), "event_id")
    return stats.trace(e, "event_id")


@registered(f"SELECT event_id, user_id, coalesce(n, 0) >= 10 AS valid FROM events LEFT JOIN (SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN ({N_ORDERS}) ON o_custkey = c_custkey) ON c_custkey = user_id WHERE c_custkey IS NOT NULL UNION ALL SELECT event_id, user_id, NULL FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)")
def events_stream_annotate(spark, sf_dir):
    source = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    rows = stream.select("event_id", "user_id", node("customer", "user_id").alias("instance"))
    out = regroup.annotate_stream(rows, "instance", facts(spark, sf_dir, TEN)).select("event_id", "user_id", "valid")
    return regroup.drain(out, f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}")

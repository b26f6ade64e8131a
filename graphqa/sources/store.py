"""Graphs as tables: one table of instances per class, one of (s, o) per predicate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import RDF_TYPE, render


class GraphStore:
    """What the compiler and the validator read. Both methods give sets: no row occurs twice."""

    spark: SparkSession

    def instances(self, cls: str) -> DataFrame:
        """(s) of the nodes of a class."""
        raise NotImplementedError

    def edges(self, predicate: str) -> DataFrame:
        """(s, o) of a predicate."""
        raise NotImplementedError

    def triples(self) -> DataFrame:
        """(s, p, o, o_kind) of the whole graph."""
        raise NotImplementedError


class TripleStore(GraphStore):
    """Over one table of triples; filters on p reach its files."""

    def __init__(self, triples: DataFrame):
        self.spark, self.table = triples.sparkSession, triples

    def instances(self, cls: str) -> DataFrame:
        return self.table.where((F.col("p") == RDF_TYPE) & (F.col("o") == cls)).select("s").distinct()

    def edges(self, predicate: str) -> DataFrame:
        return self.table.where(F.col("p") == predicate).select("s", self._object()).distinct()

    def triples(self) -> DataFrame:
        return self.table.select("s", "p", self._object(), "o_kind").distinct()

    @staticmethod
    def _object():
        return render(F.col("o"), F.col("o_kind"), F.col("o_dt"), F.col("o_lang")).alias("o")


class MappedStore(GraphStore):
    """A virtual graph over tables: nothing is copied, each scan reads the columns it needs."""

    def __init__(self, spark: SparkSession, classes: dict[str, Callable[[], DataFrame]], predicates: dict[str, tuple[str, Callable[[], DataFrame]]]):
        self.spark, self.classes, self.predicates = spark, classes, predicates

    def _empty(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def instances(self, cls: str) -> DataFrame:
        return self.classes[cls]() if cls in self.classes else self._empty("s string")

    def edges(self, predicate: str) -> DataFrame:
        if predicate == RDF_TYPE:
            return self._typed()
        return self.predicates[predicate][1]() if predicate in self.predicates else self._empty("s string, o string")

    def _typed(self) -> DataFrame:
        out = self._empty("s string, o string")
        for cls, make in self.classes.items():
            out = out.unionAll(make().select("s", F.lit(cls).alias("o")))
        return out

    def triples(self) -> DataFrame:
        out = self._typed().select("s", F.lit(RDF_TYPE).alias("p"), "o", F.lit("iri").alias("o_kind"))
        for p, (kind, make) in self.predicates.items():
            out = out.unionAll(make().select("s", F.lit(p).alias("p"), "o", F.lit(kind).alias("o_kind")))
        return out


BASE = "tpch:"
#: Table, its key, and the columns that point to other tables.
_TABLES = {
    "region": ("r_regionkey", {}, ["r_name"]),
    "nation": ("n_nationkey", {"n_regionkey": "region"}, ["n_name"]),
    "customer": ("c_custkey", {"c_nationkey": "nation"}, ["c_name", "c_acctbal", "c_mktsegment"]),
    "supplier": ("s_suppkey", {"s_nationkey": "nation"}, ["s_name", "s_acctbal"]),
    "part": ("p_partkey", {}, ["p_name", "p_brand", "p_type", "p_size"]),
    "orders": ("o_orderkey", {"o_custkey": "customer"}, ["o_orderstatus", "o_orderpriority", "o_totalprice"]),
}


def node(table: str, key: str):
    return F.concat(F.lit(f"{BASE}{table}/"), F.col(key).cast("string"))


def key_of(c: str):
    """The number at the end of a node's IRI."""
    return F.substring_index(F.col(c), "/", -1).cast("bigint")


def tpch_store(spark: SparkSession, sf_dir: str) -> MappedStore:
    """The star schema as a graph: a class per table, a node per key, an edge per foreign key, literals otherwise."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    classes: dict = {}
    predicates: dict = {}
    for t, (key, links, values) in _TABLES.items():
        classes[f"{BASE}{t}"] = lambda t=t, key=key: read(t).where(F.col(key).isNotNull()).select(node(t, key).alias("s"))
        for c, to in links.items():
            predicates[f"{BASE}{c}"] = ("iri", lambda t=t, key=key, c=c, to=to: read(t).where(F.col(c).isNotNull()).select(node(t, key).alias("s"), node(to, c).alias("o")))
        for c in values:
            predicates[f"{BASE}{c}"] = ("literal", lambda t=t, key=key, c=c: read(t).where(F.col(c).isNotNull()).select(node(t, key).alias("s"), F.col(c).cast("string").alias("o")))

    def of_lines(to: str, column: str):
        return lambda: read("lineitem").select("l_orderkey", column).distinct().select(node("orders", "l_orderkey").alias("s"), node(to, column).alias("o"))

    def bought():
        lines = read("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
        return read("orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey").select("o_custkey", "l_partkey").distinct().select(node("customer", "o_custkey").alias("s"), node("part", "l_partkey").alias("o"))

    predicates[f"{BASE}hasPart"] = ("iri", of_lines("part", "l_partkey"))
    predicates[f"{BASE}suppliedBy"] = ("iri", of_lines("supplier", "l_suppkey"))
    predicates[f"{BASE}bought"] = ("iri", bought)
    return MappedStore(spark, classes, predicates)

"""SHACL validation as joins and counts; recursive schemas by a greatest fixpoint."""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.compile import Compiler
from ..plans.reduce import components, dependencies, target_query
from ..plans.shapes import Constraint, Shape
from ..plans.sparql import Query
from ..sources.store import GraphStore
from ..storage import materialize

MAX_ROUNDS = 100


class NonStratifiedSchema(ValueError):
    """A cycle with an upper bound on members of itself that doesn't settle."""


class Validator:
    """Facts (instance, shape, valid, reason) of a schema over a graph.

    A reference to a shape with a target counts that shape's own valid targets only; one without a
    target is judged for all nodes that references lead to. Within a cycle all targets start as
    members and violators go until none is left, so what nothing refutes is valid. narrowed: target
    queries that take the place of a shape's own for what is judged and reported.
    """

    def __init__(self, store: GraphStore, shapes: list[Shape], narrowed: dict[str, Query] | None = None):
        self.store, self.shapes, self.compiler = store, {s.id: s for s in shapes}, Compiler(store)
        self.narrowed = narrowed or {}
        self.edges = dependencies(shapes)
        self.verdicts: dict[str, DataFrame] = {}
        self.written: dict[str, DataFrame] = {}  # edges that a cycle reads in each round

    # ---- domains ---------------------------------------------------------------------------

    def _of(self, q: Query) -> DataFrame:
        df = self.compiler.run(q)
        return df.select(F.col(df.columns[0]).alias("s")).where("s is not null").distinct()

    def targets(self, name: str) -> DataFrame:
        """What the shape judges: its targets, or for a shape without one all nodes that references reach."""
        shape = self.shapes[name]
        if name in self.narrowed:
            return self._of(self.narrowed[name])
        q = target_query(shape)
        if q is not None:
            return self._of(q)
        leads = [self._values(leaf).select(F.col("o").alias("s")) for s in self.shapes.values() for c in s.constraints for leaf in (c.options or (c,)) if leaf.ref == name]
        return reduce(DataFrame.unionAll, leads).distinct() if leads else self.store.spark.createDataFrame([], "s string")

    def _values(self, c: Constraint) -> DataFrame:
        df = self.written.get(c.path) or self.store.edges(c.path)
        if c.inverse:
            df = df.select(F.col("o").alias("s"), F.col("s").alias("o"))
        return df.where(F.substring_index("o", "^^<", 1) == c.value) if c.value is not None else df

    # ---- one shape -------------------------------------------------------------------------

    def judge(self, name: str, domain: DataFrame, members: dict[str, DataFrame]) -> DataFrame:
        """(s, valid, reason) for the nodes of a domain; one aggregation for all of the shape's counts."""
        shape = self.shapes[name]
        leaves = [x for c in shape.constraints for x in (c.options or (c,))]
        if not leaves:
            return domain.select("s", F.lit(True).alias("valid"), F.lit(name).alias("reason"))
        rows = []
        for k, c in enumerate(leaves):
            df = self._values(c)
            if c.ref is not None:
                df = df.join(members[c.ref].select(F.col("s").alias("o")), "o", "left_semi") if c.ref in members else df.where("false")
            rows.append(df.select("s", F.lit(k).alias("k")))
        counts = reduce(DataFrame.unionAll, rows).groupBy("s").agg(*[F.count_if(F.col("k") == k).alias(f"n{k}") for k in range(len(leaves))])
        j = domain.join(counts, "s", "left")
        number = iter(range(len(leaves)))
        tests: list[tuple[Column, str]] = []
        for c in shape.constraints:
            own = [_holds(x, F.coalesce(F.col(f"n{next(number)}"), F.lit(0))) for x in (c.options or (c,))]
            tests.append((reduce(Column.__or__, own), next(iter(c.refs()), name)))
        failed = F.coalesce(*[F.when(~ok, F.lit(why)) for ok, why in tests])
        return j.select("s", failed.isNull().alias("valid"), F.coalesce(failed, F.lit(name)).alias("reason"))

    # ---- the schema ------------------------------------------------------------------------

    def run(self) -> None:
        members: dict[str, DataFrame] = {}
        used = Counter(r for refs in self.edges.values() for r in refs)
        for group in components(self.edges):
            if len(group) == 1 and group[0] not in self.edges[group[0]]:
                name = group[0]
                v = self.judge(name, self.targets(name), members)
                self.verdicts[name] = materialize(v) if used[name] > 1 else v
            else:
                self._fixpoint(group, members)
            for name in group:
                members[name] = self.verdicts[name].where("valid").select("s")

    def _fixpoint(self, group: list[str], members: dict[str, DataFrame]) -> None:
        for path in {c.path for n in group for k in self.shapes[n].constraints for c in (k.options or (k,)) if c.ref in group}:
            self.written[path] = materialize(self.store.edges(path))
        domains = {n: materialize(self.targets(n)) for n in group}
        falls = not any(c.kind == "max" and c.ref in group for n in group for k in self.shapes[n].constraints for c in (k.options or (k,)))
        now = dict(domains)
        sizes, seen = {n: d.count() for n, d in domains.items()}, set()
        for _ in range(MAX_ROUNDS):
            verdicts = {n: self.judge(n, now[n] if falls else domains[n], members | now) for n in group}
            after = {n: materialize(v.where("valid").select("s")) for n, v in verdicts.items()}
            new = {n: d.count() for n, d in after.items()}
            if new == sizes and (falls or all(after[n].join(now[n], "s", "left_anti").isEmpty() for n in group)):
                break
            mark = None if falls else tuple(a.agg(F.sum(F.xxhash64("s").cast("decimal(38,0)"))).first()[0] for a in after.values())
            if mark is not None and (mark in seen):
                raise NonStratifiedSchema(f"no stable result for {', '.join(group)}")
            seen.add(mark)
            now, sizes = after, new
        else:
            raise NonStratifiedSchema(f"{', '.join(group)} did not settle in {MAX_ROUNDS} rounds")
        for n in group:
            self.verdicts[n] = materialize(self.judge(n, domains[n], members | now))

    def facts(self, names: list[str] | None = None) -> DataFrame:
        """(instance, shape, valid, reason) of the targets of shapes that have some."""
        if not self.verdicts:
            self.run()
        shown = [n for n in (names or self.shapes) if n in self.shapes and (self.shapes[n].has_target or n in self.narrowed)]
        out = [self.verdicts[n].select(F.col("s").alias("instance"), F.lit(n).alias("shape"), "valid", "reason") for n in shown]
        return reduce(DataFrame.unionAll, out) if out else self.store.spark.createDataFrame([], "instance string, shape string, valid boolean, reason string")


def _holds(c: Constraint, n: Column) -> Column:
    return n >= c.n if c.kind == "min" else n <= c.n

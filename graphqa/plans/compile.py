"""Query trees to DataFrames: a string column per variable, null where unbound."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import RDF_TYPE, Inverse, Iri, Lit, Var, flat, strip_datatype
from ..sources.store import GraphStore
from .sparql import Bind, Filter, Group, Minus, Optional, Query, Triple, Union, Values, certain


class Compiler:
    """Patterns become scans of one class or predicate each; joins are equi-joins on shared variables.

    Catalyst chooses join strategies; here only an order is fixed in which each pattern shares a
    variable with those before it.
    """

    def __init__(self, store: GraphStore):
        self.store = store

    def run(self, q: Query) -> DataFrame:
        if q.ask:
            found = not self.group(q.where).limit(1).isEmpty()
            return self.store.spark.createDataFrame([(found,)], "answer boolean")
        df = self.group(q.where)
        if q.aggregates or q.group_by:
            df = self._aggregated(df, q)
        names = [n for n in q.projection() if not n.startswith("_b")]
        for n in names:
            if n not in df.columns:
                df = df.withColumn(n, F.lit(None).cast("string"))
        df = df.select(*names)
        if q.distinct:
            df = df.distinct()
        if q.order_by:
            df = df.orderBy(*[(F.col(n).asc_nulls_first() if up else F.col(n).desc_nulls_last()) for n, up in q.order_by])
        if q.offset:
            df = df.offset(q.offset)
        return df if q.limit is None else df.limit(q.limit)

    def _aggregated(self, df: DataFrame, q: Query) -> DataFrame:
        made = []
        for f, v, once, name in q.aggregates:
            c = F.col(v) if v else F.lit(1)
            if f in ("SUM", "AVG"):
                c = number(c)
            if f == "COUNT":
                out = F.count_distinct(c) if once and v else F.count_distinct(*df.columns) if once else F.count(c)
            else:
                out = {"SUM": F.sum_distinct if once else F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[f](c)
            made.append(out.alias(name))
        return df.groupBy(*q.group_by).agg(*made) if made else df.select(*q.group_by).distinct()

    # ---- groups ----------------------------------------------------------------------------

    def group(self, g: Group) -> DataFrame:
        """Items in order: what OPTIONAL, MINUS and BIND follow is joined before them; filters come last."""
        df, known, waiting = None, frozenset(), []

        def joined() -> None:
            nonlocal df, known
            patterns = sorted(dict.fromkeys(i for i in waiting if isinstance(i, Triple)), key=Triple.rank)
            parts = [(self.part(i), certain(i)) for i in [*(i for i in waiting if not isinstance(i, Triple)), *patterns]]
            if df is not None:
                parts.insert(0, (df, known))
            waiting.clear()
            df, known = self._joined(parts)

        for i in g.items:
            if isinstance(i, (Optional, Minus, Bind)):
                if waiting or df is None:
                    joined()
                if isinstance(i, Optional):
                    df = self._optional(df, known, i)
                elif isinstance(i, Minus):
                    df = self._without(df, known, i.group)
                else:
                    df = df.withColumn(i.name, self.condition(i.expr, df.columns).cast("string"))
            elif not isinstance(i, Filter):
                waiting.append(i)
        if waiting or df is None:
            joined()
        for e in (x for i in g.items if isinstance(i, Filter) for x in _conjuncts(i.expr)):
            if isinstance(e, tuple) and e[0] in ("exists", "notexists"):
                df = self._existing(df, known, e[1], "left_semi" if e[0] == "exists" else "left_anti")
            else:
                df = df.where(self.condition(e, df.columns))
        return df

    def part(self, i) -> DataFrame:
        make = {Triple: self.pattern, Values: self.values, Query: self.run, Group: self.group, Union: self.union}[type(i)]
        return make(i)

    def _joined(self, parts: list[tuple[DataFrame, frozenset]]) -> tuple[DataFrame, frozenset]:
        if not parts:
            return self.store.spark.range(1).select(), frozenset()
        (df, known), left = parts[0], list(parts[1:])
        while left:
            linked = next((p for p in left if set(p[0].columns) & set(df.columns)), None)
            if linked is None:
                linked = left[0]
                if any(set(a[0].columns) & set(b[0].columns) for k, a in enumerate(left) for b in left[k + 1 :] if a is linked or b is linked):
                    tail = self._joined(left)
                    return self._natural(df, known, *tail, "inner"), known | tail[1]
            left.remove(linked)
            df, known = self._natural(df, known, *linked, "inner"), known | linked[1]
        return df, known

    @staticmethod
    def _compatible(a: DataFrame, known_a: frozenset, b: DataFrame, known_b: frozenset) -> tuple[DataFrame, list[Column], list[str]]:
        """b with its columns renamed, the conditions on shared variables, and these.

        A variable bound on both sides must be equal, as a key that Spark can shuffle on; one that may be
        unbound there fits anything.
        """
        shared = [c for c in a.columns if c in b.columns]
        other = b.select(*[F.col(f"`{c}`").alias(f"_r_{c}") for c in b.columns])
        on = []
        for c in shared:
            x, y = F.col(f"`{c}`"), F.col(f"`_r_{c}`")
            on.append(x == y if c in known_a and c in known_b else x.isNull() | y.isNull() | (x == y))
        return other, on, shared

    def _natural(self, a: DataFrame, known_a: frozenset, b: DataFrame, known_b: frozenset, how: str, conditions=None) -> DataFrame:
        """a joined with b on the variables they share; a variable unbound in a takes b's value."""
        if conditions is None and all(c in known_a and c in known_b for c in a.columns if c in b.columns):
            shared = [c for c in a.columns if c in b.columns]
            if shared:
                return a.join(b, shared, how)
            return a.crossJoin(b) if how == "inner" else a.join(b, F.lit(True), how)
        other, on, shared = self._compatible(a, known_a, b, known_b)
        on += conditions or []
        j = a.join(other, reduce(Column.__and__, on) if on else F.lit(True), how)
        merged = [F.coalesce(f"`{c}`", f"`_r_{c}`").alias(c) if c in shared and c not in known_a else F.col(f"`{c}`") for c in a.columns]
        return j.select(*merged, *[F.col(f"`_r_{c}`").alias(c) for c in b.columns if c not in shared])

    @staticmethod
    def _merged(df: DataFrame, known: frozenset, right: DataFrame) -> dict[str, Column]:
        """Variables of a renamed right side as a condition sees them beside df's."""
        new = {c: F.col(f"`_r_{c}`") for c in right.columns if c not in df.columns}
        return new | {c: F.coalesce(f"`{c}`", f"`_r_{c}`") for c in right.columns if c in df.columns and c not in known}

    def _optional(self, df: DataFrame, known: frozenset, o: Optional) -> DataFrame:
        inner = Group(tuple(i for i in o.group.items if not isinstance(i, Filter)))
        right = self.group(inner)
        filters = [i.expr for i in o.group.items if isinstance(i, Filter)]
        rename = self._merged(df, known, right)
        conditions = [self.condition(e, [*df.columns, *right.columns], rename) for e in filters]
        return self._natural(df, known, right, certain(inner), "left", conditions or None)

    def _without(self, df: DataFrame, known: frozenset, g: Group) -> DataFrame:
        """MINUS: rows go that fit a solution of g with which they have a bound variable in common."""
        right, bound = self.group(g), certain(g)
        other, on, shared = self._compatible(df, known, right, bound)
        if not shared:
            return df
        if not any(c in known and c in bound for c in shared):
            on.append(reduce(Column.__or__, [F.col(f"`{c}`").isNotNull() & F.col(f"`_r_{c}`").isNotNull() for c in shared]))
        return df.join(other, reduce(Column.__and__, on), "left_anti")

    def _existing(self, df: DataFrame, known: frozenset, g: Group, how: str) -> DataFrame:
        """FILTER EXISTS as a semi-join, NOT EXISTS as an anti-join; filters of g see the outer variables too."""
        inner = Group(tuple(i for i in g.items if not isinstance(i, Filter)))
        right = self.group(inner)
        other, on, _ = self._compatible(df, known, right, certain(inner))
        rename = self._merged(df, known, right)
        on += [self.condition(i.expr, [*df.columns, *right.columns], rename) for i in g.items if isinstance(i, Filter)]
        return df.join(other, reduce(Column.__and__, on) if on else F.lit(True), how)

    def union(self, u: Union) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(self.group, u.groups))

    def values(self, v: Values) -> DataFrame:
        rows = [tuple(None if t is None else flat(t) for t in r) for r in v.rows]
        return F.broadcast(self.store.spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in v.names)))  # written in the query

    # ---- patterns --------------------------------------------------------------------------

    def pattern(self, t: Triple) -> DataFrame:
        s, p, o = t.s, t.p, t.o
        if isinstance(p, Inverse):
            s, p, o = o, p.of, s
        if isinstance(p, Var):
            df = self.store.triples().select(F.col("s").alias("_s"), F.col("p").alias("_p"), F.col("o").alias("_o"))
            places = [("_s", s), ("_p", p), ("_o", o)]
        elif p == Iri(RDF_TYPE) and isinstance(o, Iri):
            df, places = self.store.instances(o.value).select(F.col("s").alias("_s")), [("_s", s)]
        else:
            df = self.store.edges(p.value).select(F.col("s").alias("_s"), F.col("o").alias("_o"))
            places = [("_s", s), ("_o", o)]
        out: dict[str, str] = {}
        for c, term in places:
            if not isinstance(term, Var):
                df = df.where(_matches(F.col(c), term))
            elif term.name in out:
                df = df.where(F.col(c) == F.col(out[term.name]))
            else:
                out[term.name] = c
        df = df.select(*[F.col(c).alias(n) for n, c in out.items()])
        return df if out else df.limit(1)

    # ---- filters ---------------------------------------------------------------------------

    def condition(self, e, columns: list[str], rename: dict[str, Column] | None = None) -> Column:
        """A boolean column; errors and unbound variables give null, which fails."""
        rename = rename or {}
        sub = lambda x: self.condition(x, columns, rename)
        if isinstance(e, Var):
            return rename.get(e.name, F.col(f"`{e.name}`")) if e.name in columns or e.name in rename else F.lit(None).cast("string")
        if isinstance(e, (Iri, Lit)):
            return F.lit(flat(e))
        op, *args = e
        if op in ("||", "&&"):
            a, b = sub(args[0]), sub(args[1])
            return a | b if op == "||" else a & b
        if op == "!":
            return ~sub(args[0])
        if op in ("=", "!=", "<", ">", "<=", ">="):
            return _compared(op, sub(args[0]), sub(args[1]), [x for x in args if isinstance(x, Iri)])
        if op in ("in", "notin"):
            x = sub(args[0])
            found = reduce(Column.__or__, [_compared("=", x, sub(a), [a] if isinstance(a, Iri) else []) for a in args[1]], F.lit(False))
            return ~found if op == "notin" else found
        if op in ("+", "-", "*", "/"):
            a, b = number(sub(args[0])), number(sub(args[1]))
            return {"+": a + b, "-": a - b, "*": a * b, "/": a / b}[op].cast("string")
        if op == "bound":
            return sub(args[0]).isNotNull()
        if op == "regex":
            pattern = args[1].value if isinstance(args[1], Lit) else None
            if pattern is None:
                raise ValueError("REGEX needs a constant pattern")
            flags = args[2].value if len(args) > 2 else ""
            return lexical(sub(args[0])).rlike(f"(?{flags}){pattern}" if flags else pattern)
        if op == "if":
            return F.when(sub(args[0]), sub(args[1])).otherwise(sub(args[2]))
        c = [sub(a) for a in args]
        iri = r"^[A-Za-z][A-Za-z0-9+.\-]*:[^\s<>\"]*$"
        simple = {
            "isiri": lambda x: x.rlike(iri),
            "isuri": lambda x: x.rlike(iri),
            "isblank": lambda x: x.startswith("_:"),
            "isliteral": lambda x: ~x.rlike(iri) & ~x.startswith("_:"),
            "str": lexical,
            "lang": lambda x: F.regexp_extract(x, r"@([A-Za-z]+(?:-[A-Za-z0-9]+)*)$", 1),
            "datatype": lambda x: F.regexp_extract(x, r"\^\^<([^>]*)>$", 1),
            "contains": lambda x, y: F.contains(lexical(x), lexical(y)),
            "strstarts": lambda x, y: F.startswith(lexical(x), lexical(y)),
            "strends": lambda x, y: F.endswith(lexical(x), lexical(y)),
            "strlen": lambda x: F.length(lexical(x)).cast("string"),
            "ucase": lambda x: F.upper(lexical(x)),
            "lcase": lambda x: F.lower(lexical(x)),
            "abs": lambda x: F.abs(number(x)).cast("string"),
            "ceil": lambda x: F.ceil(number(x)).cast("string"),
            "floor": lambda x: F.floor(number(x)).cast("string"),
            "round": lambda x: F.round(number(x)).cast("string"),
            "concat": lambda *xs: F.concat(*map(lexical, xs)),
            "coalesce": lambda *xs: F.coalesce(*xs),
        }
        return simple[op](*c)


def _conjuncts(e) -> list:
    return [x for a in e[1:] for x in _conjuncts(a)] if isinstance(e, tuple) and e[0] == "&&" else [e]


def lexical(c: Column) -> Column:
    """A flat term's value: without datatype and language."""
    return F.regexp_replace(c, r"(\^\^<[^>]*>|(?<=.)@[A-Za-z]+(-[A-Za-z0-9]+)*)$", "")


def number(c: Column) -> Column:
    return strip_datatype(c.cast("string")).try_cast("double")


def _matches(c: Column, term) -> Column:
    """Constants in patterns match by value; a plain literal also in a typed form."""
    if isinstance(term, Lit) and term.datatype:
        return (c == term.flat()) | (c == term.value)
    if isinstance(term, Lit) and not term.lang:
        return strip_datatype(c) == term.value
    return c == flat(term)


def _compared(op: str, a: Column, b: Column, iris: list) -> Column:
    """Numbers as numbers where both sides are; otherwise values as text."""
    test = {"=": Column.__eq__, "!=": Column.__ne__, "<": Column.__lt__, ">": Column.__gt__, "<=": Column.__le__, ">=": Column.__ge__}[op]
    if iris:
        return test(a, b)
    x, y = number(a), number(b)
    return F.when(x.isNotNull() & y.isNotNull(), test(x, y)).otherwise(test(strip_datatype(a), strip_datatype(b)))

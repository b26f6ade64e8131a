"""Solutions joined with validation facts, regrouped and projected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.terms import Var, flat, prefixed, strip_datatype, verdict, verdict_predicate
from ..plans.sparql import Query


def with_ids(solutions: DataFrame) -> DataFrame:
    """Different solutions with an id made of their content, and how often each occurs.

    The id depends on nothing but the row, so a recomputed task gives the same one.
    """
    names = solutions.columns
    return solutions.groupBy(*names).agg(F.count("*").alias("copies")).withColumn("id", F.md5(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).cast("binary")))


def unpivot(solutions: DataFrame, names: list[str]) -> DataFrame:
    """(id, copies, var, instance): a row per bound variable of a solution."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("var"), F.col(n).alias("instance")) for n in names])).alias("x")
    return solutions.select("id", "copies", pairs).select("id", "copies", "x.*").where("instance is not null")


def equi_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on shared columns whose terms may differ in datatype suffixes; columns of the right side win."""
    names = {k: f"_key_{k}" for k in keys}
    a = left.withColumns({n: strip_datatype(F.col(k)) for k, n in names.items()})
    b = right.withColumns({n: strip_datatype(F.col(k)) for k, n in names.items()})
    own = [c for c in right.columns if c not in left.columns]
    j = a.alias("l").join(b.alias("r"), [F.col(f"l.{n}") == F.col(f"r.{n}") for n in names.values()], how)
    merged = [F.coalesce(F.col(f"r.{c}"), F.col(f"l.{c}")).alias(c) if c in right.columns else F.col(f"l.{c}") for c in left.columns]
    return j.select(*merged, *[F.col(f"r.{c}") for c in own])


def join_facts(facts: DataFrame, validation: DataFrame, how: str = "left") -> DataFrame:
    """facts with a nullable struct `validation` (shape, valid, reason) per matching fact."""
    v = validation.select(strip_datatype(F.col("instance")).alias("_key"), F.struct("shape", "valid", "reason").alias("validation"))
    return facts.withColumn("_key", strip_datatype(F.col("instance"))).join(v, "_key", how).drop("_key")


def regroup_blocking(joined: DataFrame) -> DataFrame:
    """(id, copies, result): all facts of each solution."""
    return joined.groupBy("id").agg(F.first("copies").alias("copies"), F.sort_array(F.collect_list(F.struct("var", "instance", "validation"))).alias("result"))


def acceptable(targets: dict[str, list[str]]) -> Column:
    """No validation, a variable without target shapes, or a fact of one of the variable's shapes."""
    asked = [F.lower("var") == v.lower() for v in targets]
    fits = [(F.lower("var") == v.lower()) & F.col("validation.shape").isin(shapes) for v, shapes in targets.items()]
    no = F.lit(False)
    return F.coalesce(F.col("validation").isNull() | ~reduce(Column.__or__, asked, no) | reduce(Column.__or__, fits, no), no)


def complete_facts(joined: DataFrame, targets: dict[str, list[str]]) -> DataFrame:
    """The facts of solutions of which each bound variable has an acceptable one; of several only the first.

    Other facts of such solutions stay. The order by shape makes the choice deterministic.
    """
    j = joined.withColumn("ok", acceptable(targets))
    one = Window.partitionBy("id", "var", "ok").orderBy(F.col("validation.shape").asc_nulls_first(), F.col("validation.reason"))
    j = j.withColumn("rank", F.row_number().over(one)).where(~F.col("ok") | (F.col("rank") == 1))
    every = Window.partitionBy("id")
    j = j.withColumn("n_ok", F.size(F.collect_set(F.when(F.col("ok"), F.col("var"))).over(every))).withColumn("n_vars", F.size(F.collect_set("var").over(every)))
    return j.where("n_ok = n_vars").drop("ok", "rank", "n_ok", "n_vars")


def regroup_complete(joined: DataFrame, targets: dict[str, list[str]]) -> DataFrame:
    """(id, copies, result) of the complete solutions only."""
    return regroup_blocking(complete_facts(joined, targets))


def simple_output(collected: DataFrame, query: Query) -> DataFrame:
    """(id, copies, bindings, triples, report) per solution.

    bindings: projected variables; triples: the query's patterns with values put in, those with an
    unbound end left out; report: a triple per validation fact.
    """
    all_pairs = F.transform("result", lambda x: F.struct(x["var"].alias("key"), x["instance"].alias("value")))
    df = collected.withColumn("row", F.map_from_entries(F.array_distinct(all_pairs)))
    shown = F.map_filter("row", lambda k, v: k.isin(query.projection()))
    short = lambda c: prefixed(c, query.prefixes)

    def term(t) -> Column:
        return short(F.col("row")[t.name]) if isinstance(t, Var) else F.lit(t.n3(query.prefixes) if not hasattr(t, "datatype") else flat(t))

    patterns = [F.struct(term(t.s).alias("s"), term(t.p).alias("p"), term(t.o).alias("o")) for t in query.triples()]
    triples = F.filter(F.array(*patterns), lambda t: t["s"].isNotNull() & t["p"].isNotNull() & t["o"].isNotNull()) if patterns else F.array().cast("array<struct<s:string,p:string,o:string>>")
    checked = F.filter("result", lambda x: x["validation"].isNotNull())
    report = F.transform(checked, lambda x: F.struct(short(x["instance"]).alias("s"), verdict_predicate(x["validation"]["valid"]).alias("p"), x["validation"]["shape"].alias("o")))
    return df.select("id", "copies", shown.alias("bindings"), triples.alias("triples"), F.array_distinct(report).alias("report"))


def test_output(joined: DataFrame, targets: dict[str, list[str]]) -> DataFrame:
    """(bucket, instance, reason): validated instances by whether a target shape or another one judged them, and how."""
    names = list({s for shapes in targets.values() for s in shapes})
    v = joined.where("validation is not null").select("instance", "validation.*")
    own = F.col("shape").isin(names)
    bucket = F.when(own & F.col("valid"), "validTargets").when(own, "invalidTargets").when(F.col("valid"), "advancedValid").otherwise("advancedInvalid")
    return v.select(bucket.alias("bucket"), "instance", "reason").distinct()


def shape_stats(validation: DataFrame) -> DataFrame:
    """(shape, valid, invalid): counts."""
    return validation.groupBy("shape").agg(F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"))


def shape_members(validation: DataFrame) -> DataFrame:
    """(shape, instance, verdict): a row for each instance judged, so that no row holds a whole shape."""
    return validation.select("shape", "instance", verdict(F.col("valid")).alias("verdict"))

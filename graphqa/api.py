"""The runs: annotate a query's answers, validate only, reduce a schema, compare two."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame

from . import stats
from .config import Config
from .operators import annotate as ops
from .operators.validate import Validator
from .plans import reduce as red
from .plans.compile import Compiler
from .plans.shapes import Shape, bare, load_shapes
from .plans.sparql import Query, parse
from .sources.store import GraphStore
from .storage import materialize


def _prepared(config: Config) -> tuple[Query | None, list[Shape], dict[str, list[str]], Config]:
    """Query in star form where it has one, reduced shapes, targets by variable, and the options that can hold."""
    query = parse(config.query) if config.query else None
    star = query.make_star() if query is not None else None
    shapes = load_shapes(config.schema_dir, config.shape_format)
    known = star or query
    targets = red.unify_target_shape(config.target_shape, known)
    if known is not None and (known.target_var() is None or not targets or "UNDEF" in targets):
        # Nothing says which variable the shapes are for: answers can neither replace targets nor drop constraints.
        config = replace(config, replace_target_query=False, remove_constraints=False, collect_all_validation_results=True)
    shapes = red.reduced_shapes(shapes, targets or None, known, config.prune_shape_network and bool(targets), config.remove_constraints)
    return known, shapes, targets, config


def _validator(store: GraphStore, query: Query | None, shapes: list[Shape], targets: dict[str, list[str]], config: Config) -> Validator:
    narrowed = {}
    if query is not None and config.replace_target_query and targets and query.target_var() is not None:
        own = [s for v, names in targets.items() if v in (query.target_var().lower(), "UNDEF") for s in names]
        narrowed = red.replaced_targets(shapes, own, query, config.merge_old_target_query, config.query_extension_per_target_shape)
    return Validator(store, shapes, narrowed)


def annotated(store: GraphStore, options: dict | Config) -> DataFrame:
    """Answers with their explaining and validating triples (simple), or validated instances by bucket (test)."""
    config = options if isinstance(options, Config) else Config.from_dict(options)
    query, shapes, targets, config = _prepared(config)
    if query is None:
        raise ValueError("a query is needed")
    clock = stats.Clock()
    test = config.output_format == "test"
    executed = query if test or not config.reasoning else query.as_result_query()
    timed = config.write_stats and bool(config.outputs)
    done = materialize if timed else lambda df: df  # each stage is run within its time; else all are one plan
    with clock.stage("query"):
        solutions = done(ops.with_ids(Compiler(store).run(executed)))
        names = [c for c in solutions.columns if c not in ("id", "copies")]
        facts = ops.unpivot(solutions, names)
    with clock.stage("validation"):
        validation = done(_validator(store, query, shapes, targets, config).facts())
        if config.outputs:
            validation.write.mode("overwrite").partitionBy("shape", "valid").parquet(f"{config.folder()}/validation")
    with clock.stage("join"):
        joined = ops.join_facts(facts, validation)
        if test:
            out = ops.test_output(joined, targets)
        else:
            collected = ops.regroup_blocking(joined) if config.collect_all_validation_results else ops.regroup_complete(joined, targets)
            out = ops.simple_output(collected, query)
        out = done(out)
    if timed:
        stats.append_csv(f"{config.folder()}/stats.csv", stats.STATS, clock.row(config.test_identifier, config.backend))
    return out


def answers(store: GraphStore, options: dict) -> Iterator[dict]:
    """The annotated answers one by one, without holding them all."""
    for r in annotated(store, options).toLocalIterator():
        yield r.asDict(recursive=True)


def to_json(df: DataFrame) -> list[str]:
    """Every row as JSON; for results that fit the driver."""
    return list(df.toJSON().toLocalIterator())


def validate_only(store: GraphStore, options: dict | Config, detail: bool = True) -> DataFrame:
    """A row per judged instance (shape, instance, verdict), or without detail counts (shape, valid, invalid)."""
    config = options if isinstance(options, Config) else Config.from_dict(options)
    query, shapes, targets, config = _prepared(config)
    facts = _validator(store, query, shapes, targets, config).facts()
    return ops.shape_members(facts) if detail else ops.shape_stats(facts)


def reduced_names(options: dict | Config) -> list[str]:
    """The shapes that a run would use, target shapes first; reads no data."""
    config = options if isinstance(options, Config) else Config.from_dict(options)
    shapes = load_shapes(config.schema_dir, config.shape_format)
    query = parse(config.query) if config.query else None
    targets = red.target_shapes(red.unify_target_shape(config.target_shape, query))
    if not targets:
        return [s.id for s in shapes]
    if config.remove_constraints and query is not None:
        shapes = red.remove_constraints(shapes, targets, query)
    order = red.node_order(shapes, targets, config.traversal_strategy.upper() == "BFS")
    first = config.start_shape_for_validation and bare(config.start_shape_for_validation)
    return [first, *[s for s in order if s != first]] if first in order else order


def overlap(options: dict, one: str, two: str) -> float:
    config = Config.from_dict(dict(options))
    return red.overlap(load_shapes(config.schema_dir, config.shape_format), one, two)


def query_from_file(path: str) -> Query:
    return parse(Path(path).read_text(encoding="utf-8"))

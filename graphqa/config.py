"""Options of a run, under all names that are accepted."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field, fields
from pathlib import Path

#: Accepted names of options.
ALIASES = {
    "schemaDir": "schema_dir", "schema_directory": "schema_dir", "targetShape": "target_shape", "outputDirectory": "output_directory", "shapeFormat": "shape_format", "schema_format": "shape_format",
    "workInParallel": "work_in_parallel", "useSelectiveQueries": "selective_queries", "maxSplit": "max_split", "ORDERBYinQueries": "order_by_in_queries", "traversalStrategy": "traversal_strategy", "external_endpoint": "endpoint",
}


@dataclass
class Config:
    """Options that only steered another engine's execution are accepted and change nothing."""

    query: str | None = None
    endpoint: str | None = None
    schema_dir: object = None
    target_shape: object = None
    outputs: bool = False
    output_directory: str = "./output/"
    shape_format: str = "SHACL"
    backend: str = "travshacl"
    traversal_strategy: str = "DFS"
    heuristic: str = "TARGET IN BIG"
    replace_target_query: bool = True
    merge_old_target_query: bool = True
    start_with_target_shape: bool = True
    start_shape_for_validation: str | None = None
    remove_constraints: bool = False
    output_format: str = "simple"
    prune_shape_network: bool = True
    test_identifier: str = field(default_factory=lambda: str(uuid.uuid1()))
    reasoning: bool = True
    collect_all_validation_results: bool = False
    write_stats: bool = True
    query_extension_per_target_shape: dict | None = None
    work_in_parallel: bool = False
    selective_queries: bool = True
    max_split: int = 256
    order_by_in_queries: bool = True
    memory_size: int = 100_000_000
    run_in_serial: bool = False
    use_pipes: bool = False

    def __post_init__(self):
        for f in fields(self):
            if f.type == "bool":
                setattr(self, f.name, as_bool(getattr(self, f.name), f.name))
        if self.output_format not in ("simple", "test"):
            raise ValueError(f"output_format: {self.output_format}")
        if self.backend not in ("travshacl", "s2spy"):
            raise ValueError(f"backend: {self.backend}")
        if self.backend == "s2spy" and not self.start_with_target_shape:
            raise ValueError("backend s2spy needs start_with_target_shape")
        if self.remove_constraints and not self.prune_shape_network:
            raise ValueError("remove_constraints needs prune_shape_network")
        if self.use_pipes and self.run_in_serial:
            raise ValueError("use_pipes excludes run_in_serial")

    @classmethod
    def from_dict(cls, options: dict) -> Config:
        """A dict whose `config` may name a JSON file or hold further options; the dict's own win."""
        base = options.get("config")
        if isinstance(base, str):
            base = json.loads(base) if base.lstrip().startswith("{") else json.loads(Path(base).read_text(encoding="utf-8"))
        merged = {**(base or {}), **{k: v for k, v in options.items() if k != "config"}}
        known = {f.name for f in fields(cls)}
        return cls(**{ALIASES.get(k, k): v for k, v in merged.items() if ALIASES.get(k, k) in known})

    def folder(self) -> str:
        return str(Path(self.output_directory, re.sub(r"[^\w\-_.]", "_", self.test_identifier)))


def as_bool(value, name: str = "option") -> bool:
    if isinstance(value, bool):
        return value
    if isinstance(value, str) and value.lower() in ("true", "false"):
        return value.lower() == "true"
    raise ValueError(f"{name}: not a boolean: {value!r}")

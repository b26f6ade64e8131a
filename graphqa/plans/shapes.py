"""SHACL shapes from Turtle, JSON or a parsed graph."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace
from pathlib import Path

from ..functions.terms import RDF_TYPE
from ..sources.turtle import RDF, parse_turtle

SH = "http://www.w3.org/ns/shacl#"


@dataclass(frozen=True)
class Constraint:
    """At least (`min`) or at most (`max`) n values along a path, counting those with a value or of a shape only; `or` has options."""

    kind: str
    path: str = ""
    inverse: bool = False
    n: int = 0
    ref: str | None = None
    value: str | None = None
    options: tuple[Constraint, ...] = ()

    def refs(self) -> list[str]:
        return [r for o in self.options for r in o.refs()] if self.kind == "or" else [self.ref] if self.ref else []

    def signed_path(self) -> str:
        return "^" * self.inverse + self.path


@dataclass(frozen=True)
class Shape:
    id: str
    target_class: str | None = None
    target_query: str | None = None
    constraints: tuple[Constraint, ...] = ()
    prefixes: tuple[tuple[str, str], ...] = ()

    @property
    def has_target(self) -> bool:
        return self.target_class is not None or self.target_query is not None

    def references(self) -> dict[str, str]:
        """Referenced shape to path; of several paths the last."""
        out: dict[str, str] = {}
        for c in self.constraints:
            for leaf in c.options or (c,):
                if leaf.ref:
                    out[leaf.ref] = leaf.signed_path()
        return out


def _split(base: Constraint, low: int | None, high: int | None) -> list[Constraint]:
    return [replace(base, kind=k, n=n) for k, n in (("min", low), ("max", high)) if n is not None]


class _Graph:
    def __init__(self, triples: list[tuple]):
        self.by: dict[tuple[str, str], list[tuple]] = {}
        for s, p, *o in triples:
            self.by.setdefault((s, p), []).append(tuple(o))
        self.triples = triples

    def all(self, s: str, p: str) -> list[str]:
        return [o[0] for o in self.by.get((s, p), [])]

    def one(self, s: str, p: str) -> str | None:
        return next(iter(self.all(s, p)), None)

    def items(self, head: str) -> list[str]:
        out = []
        while head and head != RDF + "nil":
            out += self.all(head, RDF + "first")
            head = self.one(head, RDF + "rest")
        return out


def shapes_from_graph(triples: list[tuple]) -> list[Shape]:
    """Shapes of parsed triples (s, p, o, ...), in order of appearance."""
    g = _Graph(triples)
    out = []
    for s in dict.fromkeys(t[0] for t in triples if t[1] == RDF_TYPE and t[2] == SH + "NodeShape"):
        constraints: list[Constraint] = []
        for t in triples:
            if t[0] == s and t[1] == SH + "property":
                constraints += _property(g, t[2])
            elif t[0] == s and t[1] == SH + "or":
                options = [c for o in g.items(t[2]) for p in (g.all(o, SH + "property") or [o]) for c in _property(g, p)]
                constraints.append(Constraint("or", options=tuple(options)))
        out.append(Shape(s, g.one(s, SH + "targetClass"), _target_query(g, s), tuple(constraints)))
    return out


def _target_query(g: _Graph, s: str) -> str | None:
    q = g.one(s, SH + "targetQuery")
    if q is None:
        t = g.one(s, SH + "target")
        q = t and g.one(t, SH + "select")
    return q


def _property(g: _Graph, p: str) -> list[Constraint]:
    path, inverse = g.one(p, SH + "path") or "", False
    if g.one(path, SH + "inversePath"):
        path, inverse = g.one(path, SH + "inversePath"), True
    number = lambda k: None if g.one(p, SH + k) is None else int(g.one(p, SH + k))
    base = Constraint("min", path, inverse, value=g.one(p, SH + "hasValue"))
    out = _split(base, number("minCount"), number("maxCount"))
    if base.value is not None and not out:
        out = [replace(base, n=1)]
    ref = g.one(p, SH + "qualifiedValueShape")
    if ref is not None:
        ref = g.one(ref, SH + "node") or ref
        out += _split(replace(base, ref=ref), number("qualifiedMinCount"), number("qualifiedMaxCount"))
    elif g.one(p, SH + "node"):
        out += [replace(base, ref=g.one(p, SH + "node"), n=number("minCount") or 1)]
    if g.one(p, SH + "or"):
        out.append(Constraint("or", options=tuple(c for o in g.items(g.one(p, SH + "or")) for c in _property(g, o))))
    return out


def _expand(term: str, prefixes: dict[str, str]) -> str:
    term = term.strip()
    if term.startswith("<"):
        return term[1:-1]
    p, colon, local = term.partition(":")
    return prefixes[p] + local if colon and p in prefixes else term


def shape_from_json(doc: dict) -> Shape:
    """Keys: name, prefix, targetDef {query, class}, constraintDef.conjunctions [[{path, min, max, value, shape, options}]]."""
    prefixes = {p: ns.strip("<>") for p, ns in (doc.get("prefix") or {}).items()}

    def leaf(c: dict) -> list[Constraint]:
        if c.get("options"):
            return [Constraint("or", options=tuple(x for o in c["options"] for x in leaf(o)))]
        path = c["path"].strip()
        inverse = path.startswith("^")
        value = c.get("value")
        base = Constraint("min", _expand(path.lstrip("^"), prefixes), inverse, ref=c.get("shape"), value=None if value is None else _expand(str(value), prefixes).strip("\"'"))
        low, high = c.get("min"), c.get("max")
        return _split(base, None if low is None else int(low), None if high is None else int(high)) or [replace(base, n=1)]

    groups = (doc.get("constraintDef") or {}).get("conjunctions") or []
    constraints = tuple(x for group in groups for c in group for x in leaf(c))
    target = doc.get("targetDef") or {}
    cls = target.get("class")
    return Shape(doc["name"], _expand(cls, prefixes) if cls else None, None if cls else target.get("query"), constraints, tuple(prefixes.items()))


def load_shapes(source, form: str = "SHACL") -> list[Shape]:
    """Shapes of a directory, a file, Turtle triples, or a list of JSON documents."""
    if isinstance(source, list):
        return [shape_from_json(x) if isinstance(x, dict) else x for x in source] if source and not isinstance(source[0], tuple) else shapes_from_graph(source)
    path = Path(source)
    as_json = form.upper() == "JSON"
    files = sorted(path.glob("*.json" if as_json else "*.ttl")) if path.is_dir() else [path]
    out: list[Shape] = []
    for f in files:
        text = f.read_text(encoding="utf-8")
        out += [shape_from_json(json.loads(text))] if as_json else shapes_from_graph(parse_turtle(text))
    return out


def bare(name: str) -> str:
    """A shape's name without angle brackets."""
    return re.sub(r"^<(.*)>$", r"\1", name.strip())

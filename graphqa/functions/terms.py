"""RDF terms: plan-time classes, and column functions for their flat string form."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"


@dataclass(frozen=True)
class Iri:
    value: str

    def n3(self, prefixes: dict[str, str] | None = None) -> str:
        return shorten(self.value, prefixes) if prefixes else f"<{self.value}>"


@dataclass(frozen=True)
class Lit:
    value: str
    datatype: str = ""
    lang: str = ""

    def flat(self) -> str:
        return f"{self.value}^^<{self.datatype}>" if self.datatype else f"{self.value}@{self.lang}" if self.lang else self.value

    def n3(self, prefixes: dict[str, str] | None = None) -> str:
        quoted = '"' + self.value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
        return quoted + (f"^^<{self.datatype}>" if self.datatype else f"@{self.lang}" if self.lang else "")


@dataclass(frozen=True)
class Var:
    name: str

    def n3(self, prefixes: dict[str, str] | None = None) -> str:
        return f"?{self.name}"


@dataclass(frozen=True)
class Inverse:
    """The path `^iri`."""

    of: Iri

    def n3(self, prefixes: dict[str, str] | None = None) -> str:
        return "^" + self.of.n3(prefixes)


def flat(term) -> str:
    """The string by which a constant is matched in rows."""
    return term.flat() if isinstance(term, Lit) else term.value


def shorten(iri: str, prefixes: dict[str, str] | None) -> str:
    """Prefixed form under the longest fitting namespace, else `<iri>`."""
    fits = [(len(ns), p, ns) for p, ns in (prefixes or {}).items() if iri.startswith(ns) and ns]
    if not fits:
        return f"<{iri}>"
    _, p, ns = max(fits)
    return f"{p}:{iri[len(ns):]}"


def render(value: Column, kind: Column, datatype: Column, lang: Column) -> Column:
    """`value^^<datatype>`, `value@lang` or the bare value."""
    return F.when((kind == "literal") & (F.coalesce(datatype, F.lit("")) != ""), F.concat(value, F.lit("^^<"), datatype, F.lit(">"))).when((kind == "literal") & (F.coalesce(lang, F.lit("")) != ""), F.concat(value, F.lit("@"), lang)).otherwise(value)


def strip_datatype(c: Column) -> Column:
    """The join key of a flat term: without its datatype; a language tag stays."""
    return F.substring_index(c, "^^<", 1)


def prefixed(c: Column, prefixes: dict[str, str]) -> Column:
    """IRIs in prefixed form by the longest namespace, everything else unchanged."""
    out = c
    for p, ns in sorted(prefixes.items(), key=lambda x: len(x[1])):
        out = F.when(c.startswith(ns), F.concat(F.lit(f"{p}:"), F.substring(c, F.lit(len(ns) + 1), F.length(c)))).otherwise(out)
    return out


def verdict(valid: Column) -> Column:
    return F.when(valid, F.lit("Valid")).otherwise(F.lit("Invalid"))


def verdict_predicate(valid: Column) -> Column:
    return F.when(valid, F.lit("ts:satisfiesShape")).otherwise(F.lit("ts:violatesShape"))

"""Turtle, N-Triples and RDF/XML to triples."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import RDF_TYPE, XSD

SCHEMA = "s string, p string, o string, o_kind string, o_dt string, o_lang string"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
_TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<long>\"{3}.*?(?<!\\)\"{3}|'{3}.*?(?<!\\)'{3})|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<directive>@prefix\b|@base\b)|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<dt>\^\^)|(?P<bnode>_:[\w.-]*\w)|(?P<num>[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)
    |(?P<name>[\w-]*(?:\.[\w-]+)*:(?:[\w%:-]|\\.|\.(?=[\w%:-]))*)|(?P<word>[A-Za-z]\w*)|(?P<punct>[][;,.()])""",
    re.X | re.S,
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
_PLAIN = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


def unescape(s: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _PLAIN.get(m[3], m[3]), s)


class TurtleParser:
    """Recursive descent over tokens; triples as tuples in the order of SCHEMA."""

    def __init__(self, text: str):
        self.tokens = self._split(text)
        self.at, self.blanks = 0, 0
        self.prefixes: dict[str, str] = {}
        self.base = ""
        self.triples: list[tuple] = []

    @staticmethod
    def _split(text: str) -> list[tuple[str, str]]:
        out, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"unreadable Turtle at {text[at:at + 40]!r}")
            at = m.end()
            if m.lastgroup != "space":
                out.append((m.lastgroup, m[0]))
        return out

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, expected: str | None = None) -> tuple[str, str]:
        t = self.peek()
        if expected is not None and t[1] != expected:
            raise ValueError(f"expected {expected!r}, found {t[1]!r}")
        self.at += 1
        return t

    def parse(self) -> list[tuple]:
        while self.peek()[0] != "end":
            kind, word = self.peek()
            if kind == "directive" or kind == "word" and word.lower() in ("prefix", "base"):
                self.take()
                if word.lower().lstrip("@") == "prefix":
                    name = self.take()[1]
                    self.prefixes[name[:-1]] = self.iri(self.take()[1])
                else:
                    self.base = self.iri(self.take()[1])
                if kind == "directive":
                    self.take(".")
                continue
            subject = self.node()
            if self.peek()[1] != ".":
                self.properties(subject[0])
            self.take(".")
        return self.triples

    def iri(self, token: str) -> str:
        value = unescape(token[1:-1])
        return value if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", value) else self.base + value

    def properties(self, subject: str) -> None:
        while True:
            if self.peek()[1] in (".", "]"):
                return
            kind, word = self.peek()
            if kind == "word" and word == "a":
                self.take()
                predicate = RDF_TYPE
            else:
                predicate = self.node()[0]
            while True:
                self.triples.append((subject, predicate, *self.node()))
                if self.peek()[1] != ",":
                    break
                self.take()
            if self.peek()[1] != ";":
                return
            while self.peek()[1] == ";":
                self.take()

    def blank(self) -> str:
        self.blanks += 1
        return f"_:b{self.blanks}"

    def node(self) -> tuple[str, str, str, str]:
        kind, word = self.take()
        if kind == "iri":
            return self.iri(word), "iri", "", ""
        if kind == "name":
            prefix, _, local = word.partition(":")
            if prefix not in self.prefixes:
                raise ValueError(f"unknown prefix {prefix!r}")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local), "iri", "", ""
        if kind == "bnode":
            return word, "bnode", "", ""
        if kind in ("str", "long"):
            n = 3 if kind == "long" else 1
            value = unescape(word[n:-n])
            if self.peek()[0] == "dt":
                self.take()
                return value, "literal", self.node()[0], ""
            if self.peek()[0] == "lang":
                return value, "literal", "", self.take()[1][1:]
            return value, "literal", "", ""
        if kind == "num":
            return word, "literal", XSD + ("double" if "e" in word.lower() else "decimal" if "." in word else "integer"), ""
        if kind == "word" and word in ("true", "false"):
            return word, "literal", XSD + "boolean", ""
        if word == "[":
            me = self.blank()
            self.properties(me)
            self.take("]")
            return me, "bnode", "", ""
        if word == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.node())
            self.take(")")
            head = (RDF + "nil", "iri", "", "")
            for item in reversed(items):
                me = self.blank()
                self.triples += [(me, RDF + "first", *item), (me, RDF + "rest", *head)]
                head = (me, "bnode", "", "")
            return head
        raise ValueError(f"unexpected {word!r}")


def parse_turtle(text: str) -> list[tuple]:
    return TurtleParser(text).parse()


def parse_rdfxml(text: str) -> list[tuple]:
    """Node elements, property elements, rdf:about/ID/resource/nodeID, datatypes, languages and nested nodes."""
    out: list[tuple] = []
    count = 0
    base = ""

    def name(tag: str) -> str:
        return tag[1:].replace("}", "", 1) if tag[0] == "{" else tag

    def resolve(v: str) -> str:
        return v if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", v) else base + v

    def node(e: ET.Element) -> tuple[str, str]:
        nonlocal count
        get = lambda k: e.get(f"{{{RDF}}}{k}")
        if get("about") is not None:
            me = resolve(get("about")), "iri"
        elif get("ID") is not None:
            me = resolve("#" + get("ID")), "iri"
        elif get("nodeID") is not None:
            me = "_:" + get("nodeID"), "bnode"
        else:
            count += 1
            me = f"_:x{count}", "bnode"
        if name(e.tag) != RDF + "Description":
            out.append((me[0], RDF_TYPE, name(e.tag), "iri", "", ""))
        for k, v in e.attrib.items():
            if not k.startswith((f"{{{RDF}}}", "{http://www.w3.org/XML/1998/namespace}")):
                out.append((me[0], name(k), v, "literal", "", ""))
        for p in e:
            resource, ident = p.get(f"{{{RDF}}}resource"), p.get(f"{{{RDF}}}nodeID")
            if resource is not None:
                out.append((me[0], name(p.tag), resolve(resource), "iri", "", ""))
            elif ident is not None:
                out.append((me[0], name(p.tag), "_:" + ident, "bnode", "", ""))
            elif len(p):
                for child in p:
                    out.append((me[0], name(p.tag), *node(child), "", ""))
            else:
                out.append((me[0], name(p.tag), p.text or "", "literal", p.get(f"{{{RDF}}}datatype") or "", p.get("{http://www.w3.org/XML/1998/namespace}lang") or ""))
        return me

    root = ET.fromstring(text)
    base = root.get("{http://www.w3.org/XML/1998/namespace}base") or ""
    for e in root if name(root.tag) == RDF + "RDF" else [root]:
        node(e)
    return out


def _decoded(c: Column) -> Column:
    """Escapes of N-Triples decoded from left to right, each once: pieces between and escapes are told apart first."""
    piece = r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+"
    pieces = F.regexp_extract_all(c, F.lit(f"(?s)({piece})"), F.lit(1))
    fixed = {"\\t": "\t", "\\n": "\n", "\\r": "\r", "\\b": "\b", "\\f": "\f"}

    def one(x: Column) -> Column:
        code = F.lpad(F.substring(x, F.lit(3), F.length(x)), 8, "0")
        out = F.when(x.rlike("^\\\\[uU][0-9A-Fa-f]{4}"), F.decode(F.unhex(code), "UTF-32"))
        for mark, char in fixed.items():
            out = out.when(x == mark, F.lit(char))
        return out.when(F.startswith(x, F.lit("\\")), F.substring(x, F.lit(2), F.length(x))).otherwise(x)

    return F.when(F.contains(c, F.lit("\\")), F.array_join(F.transform(pieces, one), "")).otherwise(c)


def triples_of(spark: SparkSession, text: str, form: str = "turtle") -> DataFrame:
    """Triples of a text held by the driver."""
    rows = parse_rdfxml(text) if form == "rdfxml" else parse_turtle(text)
    return spark.createDataFrame(rows, SCHEMA).dropDuplicates()


def read_rdf(spark: SparkSession, path: str, form: str) -> DataFrame:
    """Triples of files: `turtle` and `rdfxml` a file per task, `ntriples` a line per row, so that it splits."""
    if form == "ntriples":
        line = r"^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|\"(?:[^\"\\]|\\.)*\")(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?\s*\.\s*(?:#.*)?$"
        part = lambda k: F.regexp_extract("value", line, k)
        o = part(3)
        kind = F.when(o.startswith("<"), "iri").when(o.startswith("_:"), "bnode").otherwise("literal")
        plain = _decoded(o.substr(F.lit(2), F.length(o) - 2))
        bare = lambda c: _decoded(F.regexp_replace(c, "^<(.*)>$", "$1"))
        blank = F.col("value").rlike(r"^\s*(#.*)?$")
        rows = spark.read.text(path).where(~blank)
        bad = F.raise_error(F.concat(F.lit("unreadable N-Triples line: "), F.substring("value", 1, 200)))
        rows = rows.where(F.when(F.col("value").rlike(line), True).otherwise(bad.cast("boolean")))
        return rows.select(bare(part(1)).alias("s"), part(2).alias("p"), F.when(kind == "literal", plain).otherwise(bare(o)).alias("o"), kind.alias("o_kind"), part(4).alias("o_dt"), part(5).alias("o_lang")).dropDuplicates()
    parse = parse_rdfxml if form == "rdfxml" else parse_turtle

    def run(batches):
        import pyarrow as pa

        fields = [x.split()[0] for x in SCHEMA.split(", ")]
        for b in batches:
            for file, value in zip(b.column("file").to_pylist(), b.column("value").to_pylist(), strict=True):
                mark = f"_:{abs(hash(file)) % (1 << 40):x}-"
                rows = [tuple(mark + x[2:] if isinstance(x, str) and x.startswith("_:") and (k == 0 or k == 2 and r[3] == "bnode") else x for k, x in enumerate(r)) for r in parse(value)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows, strict=True)], names=fields)

    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.mapInArrow(run, SCHEMA).dropDuplicates()


def read_text(path: str) -> str:
    return Path(path).read_text(encoding="utf-8")

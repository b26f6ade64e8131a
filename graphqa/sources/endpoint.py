"""SPARQL over HTTP as a Spark data source: one partition per page of answers."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ACCEPT = "application/sparql-results+json"


def check_url(url: str) -> str:
    if urllib.parse.urlsplit(url).scheme not in ("http", "https"):
        raise ValueError(f"not an http(s) endpoint: {url}")
    return url


def fetch(url: str, query: str, timeout: float = 600) -> dict:
    """The decoded answer document."""
    full = f"{check_url(url)}{'&' if '?' in url else '?'}{urllib.parse.urlencode({'query': query, 'format': ACCEPT})}"
    with urllib.request.urlopen(urllib.request.Request(full, headers={"Accept": ACCEPT}), timeout=timeout) as r:
        return json.load(r)


def flat_term(t: dict | None) -> str | None:
    """A result term in flat form."""
    if t is None:
        return None
    if t.get("datatype") and t["type"] in ("typed-literal", "literal"):
        return f"{t['value']}^^<{t['datatype']}>"
    return f"{t['value']}@{t['xml:lang']}" if t.get("xml:lang") else t["value"]


def decode(document: dict) -> tuple[list[str], list[list[str | None]]]:
    names = document["head"].get("vars", [])
    return names, [[flat_term(b.get(v)) for v in names] for b in document["results"]["bindings"]]


def ask(url: str, query: str) -> bool:
    return bool(fetch(url, query)["boolean"])


class _Page(InputPartition):
    def __init__(self, offset: int | None):
        super().__init__(offset)
        self.offset = offset


class _Reader(DataSourceReader):
    def __init__(self, names: list[str], options: dict):
        self.names, self.options = names, options

    def partitions(self):
        size, total = int(self.options.get("pageSize", 0)), int(self.options.get("total", 0))
        return [_Page(k) for k in range(0, total, size)] if size and total else [_Page(None)]

    def read(self, partition):
        url, query, size = self.options["url"], self.options["query"], int(self.options.get("pageSize", 0))
        offset, alone = partition.offset or 0, partition.offset is None
        while True:
            names, rows = decode(fetch(url, f"{query} LIMIT {size} OFFSET {offset}" if size else query))
            at = [names.index(v) if v in names else None for v in self.names]
            for r in rows:
                yield tuple(None if k is None else r[k] for k in at)
            if not (size and alone and len(rows) == size):
                return
            offset += size


class SparqlSource(DataSource):
    """Options: url, query, vars (comma-separated); pageSize and total to read pages in parallel."""

    @classmethod
    def name(cls) -> str:
        return "sparql"

    def schema(self) -> str:
        return ", ".join(f"`{v.strip().lstrip('?')}` string" for v in self.options["vars"].split(","))

    def reader(self, schema) -> _Reader:
        return _Reader(list(schema.fieldNames()), dict(self.options))


def read_endpoint(spark: SparkSession, url: str, query: str, names: list[str], page_size: int = 0, total: int = 0) -> DataFrame:
    check_url(url)
    spark.dataSource.register(SparqlSource)
    return spark.read.format("sparql").options(url=url, query=query, vars=",".join(names), pageSize=str(page_size), total=str(total)).load()

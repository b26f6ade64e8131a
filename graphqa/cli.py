"""python -m graphqa.cli RUN --data FILE --config FILE [-q QUERY-FILE]: prints a JSON line per result."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import api
from .sources.store import TripleStore
from .sources.turtle import read_rdf, read_text


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("run", choices=["annotate", "validate", "reduce", "overlap"])
    p.add_argument("--data", help="graph file or folder")
    p.add_argument("--form", default="turtle", choices=["turtle", "ntriples", "rdfxml"])
    p.add_argument("--config", help="JSON file of options")
    p.add_argument("-q", "--query", help="file of a query")
    p.add_argument("--shapes", nargs=2, metavar="SHAPE", help="two shapes to compare")
    a = p.parse_args(argv)
    options: dict = {"config": a.config} if a.config else {}
    if a.query:
        options["query"] = read_text(a.query)
    if a.run == "reduce":
        print(json.dumps(api.reduced_names(options)))
        return 0
    if a.run == "overlap":
        print(json.dumps(api.overlap(options, *a.shapes)))
        return 0
    spark = SparkSession.builder.appName("graphqa").getOrCreate()
    store = TripleStore(read_rdf(spark, a.data, a.form))
    df = api.annotated(store, options) if a.run == "annotate" else api.validate_only(store, options)
    for line in api.to_json(df):
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())

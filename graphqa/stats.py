"""Times of a run, and their files."""

from __future__ import annotations

import csv
import time
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATS = ["test", "approach", "total_execution_time", "query_time", "network_validation_time", "join_time"]
MATRIX = ["test", "approach", "tfft", "totaltime", "comp"]


class Clock:
    """Start and end of named stages."""

    def __init__(self):
        self.spans: dict[str, tuple[float, float]] = {}
        self.began = time.time()

    @contextmanager
    def stage(self, topic: str):
        start = time.time()
        yield
        self.spans[topic] = (start, time.time())

    def of(self, topic: str) -> float:
        a, b = self.spans.get(topic, (0.0, 0.0))
        return b - a

    def row(self, test: str, approach: str) -> list:
        end = max((b for _, b in self.spans.values()), default=self.began)
        return [test, approach, end - self.began, self.of("query"), self.of("validation"), self.of("join")]


def append_csv(path: str, header: list[str], row: list) -> None:
    new = not Path(path).exists()
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "a", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        if new:
            w.writerow(header)
        w.writerow(row)


def trace(results: DataFrame, at: str = "at", test: str = "test", approach: str = "approach") -> DataFrame:
    """(test, approach, answer, time): each answer's number within its test, by time."""
    w = Window.partitionBy(test, approach).orderBy(at)
    return results.select(test, approach, F.row_number().over(w).cast("long").alias("answer"), F.col(at).alias("time"))


def summary(results: DataFrame, start: float, at: str = "at", keys: tuple[str, ...] = ("test", "approach")) -> DataFrame:
    """(…, tfft, totaltime, comp): time to the first answer, to the last, and their number."""
    return results.groupBy(*keys).agg((F.min(at) - start).alias("tfft"), (F.max(at) - start).alias("totaltime"), F.count("*").alias("comp"))

"""Helpers shared by the training-data operators: tables, shared storage, components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch handed to Python; documents can be 100 KB each.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def small_batches(spark: SparkSession) -> None:
    """Prepare a session for Python stages: small Arrow batches, as some texts are very long, and this package on every executor."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        package = Path(__file__).resolve().parent.parent
        path = Path(tempfile.mkdtemp(prefix="graphqa-ship-"), f"{package.name}.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        sc.addPyFile(str(path))
        _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir; a temporary one is made only in local mode, where the driver is the only machine."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="graphqa-checkpoint-")
        sc.setCheckpointDir(where)
    elif sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(where)
    return where.rstrip("/")


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for what runs within."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, as compressed Parquet."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphqa-{uuid.uuid4().hex}"
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):  # shuffle files go once the rows are written
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Remove the files of a checkpoint() that no result reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` as UTF-8; bytes.split() cuts at just these six characters."""
    return text.encode().split() if text else []


def _undirected(edges: DataFrame) -> DataFrame:
    """Pairs (a, b) as (hi, lo) without loops or repeats."""
    return edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for each id in edges (a, b); component is the smallest id that it reaches.

    Distributed union-find by alternating large-star and small-star steps, DataFrame operations
    only. A step takes a minimum per vertex (partial aggregation, so a hub is cheap) and joins it
    back; it never gathers a neighbourhood. Each round is written to the shared folder. Empty
    input gives no rows; null ends are ignored; repeated and reversed pairs count once.
    """
    now = checkpoint(_undirected(edges.where("a is not null and b is not null")))

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())

    before = mark(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.hi", "e.lo").where("hi <> lo").distinct()
        after = checkpoint(small)
        drop_written(now)
        now, last = after, before
        before = mark(now)
        if before == last:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionAll(now.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 48 bits of an MD5, the same on any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))

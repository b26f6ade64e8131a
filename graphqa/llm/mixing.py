"""Operator 5: mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import uniform

#: Without given weights a source weighs its document count to this power (flattened proportions).
TEMPERATURE = 0.5
SEED = 17


def poisson_table(rate: float) -> list[float]:
    """Cumulative probabilities P(X <= k) from k = 0, until they round to 1."""
    out, total, k = [], 0.0, 0
    while k <= rate + 12 * math.sqrt(rate) + 30:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate > 0 else float(k == 0)
        out.append(total)
        k += 1
    return out


def _tables(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in pdfs:
        yield p.assign(cdf=[poisson_table(x) for x in p["rate"]])


def source_rates(docs: DataFrame, weights: dict | None = None, total: float | None = None) -> DataFrame:
    """(source, n_docs, rate): the mean number of copies of each document of a source.

    rate = share of the source in the target mix * total / n_docs; total: the expected number of
    rows out, by default the number of rows in. Sources missing from weights get none.
    """
    n = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count("*").alias("n_docs"))
    if weights is None:
        n = n.withColumn("w", F.pow(F.col("n_docs").cast("double"), F.lit(TEMPERATURE)))
    else:
        pairs = [F.lit(x) for kv in weights.items() for x in kv if kv[0] is not None]
        given = F.element_at(F.create_map(*pairs), F.col("source")) if pairs else F.lit(None)
        n = n.withColumn("w", F.coalesce(F.when(F.col("source").isNull(), F.lit(weights.get(None, 0.0))).otherwise(given), F.lit(0.0)).cast("double"))
    both = n.agg(F.sum("w").alias("w_all"), F.sum("n_docs").alias("n_all"))
    want = F.lit(float(total)) if total is not None else F.col("n_all").cast("double")
    return n.join(F.broadcast(both)).select("source", "n_docs", F.coalesce(F.col("w") / F.nullif("w_all", F.lit(0.0)) * want / F.col("n_docs"), F.lit(0.0)).alias("rate"))


def mix(docs: DataFrame, weights: dict | None = None, total: float | None = None, seed: int = SEED) -> DataFrame:
    """Each row of docs as often as a Poisson draw with its source's rate says, in random order.

    The draw inverts the Poisson distribution at a uniform number hashed from (seed, doc_id), so a
    rerun or a lost executor gives the same rows. Adds copy (0, 1, ...), n_copies and shuffle_key,
    by which rows are range-partitioned and sorted: a global shuffle. Columns of docs with these
    names are replaced. A null doc_id draws as the text "null"; a null source is a source; repeated
    rows draw alike; text may be null, empty or long; an empty table gives no rows.
    """
    t = source_rates(docs, weights, total).mapInPandas(_tables, "source string, n_docs long, rate double, cdf array<double>").select(F.col("source").alias("_source"), F.col("cdf").alias("_cdf"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    d = docs.drop("copy", "n_copies", "shuffle_key").withColumn("_u", uniform(key, seed))
    d = d.join(t, d["source"].cast("string").eqNullSafe(t["_source"]))
    d = d.withColumn("n_copies", F.size(F.filter("_cdf", lambda c: c <= F.col("_u"))).cast("long")).where("n_copies > 0")
    d = d.drop("_u", "_cdf", "_source").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_copies") - 1)))
    d = d.withColumn("shuffle_key", F.md5(F.concat(F.lit(f"{seed}/"), key, F.lit("/"), F.col("copy").cast("string")).cast("binary")))
    return d.repartitionByRange("shuffle_key").sortWithinPartitions("shuffle_key")

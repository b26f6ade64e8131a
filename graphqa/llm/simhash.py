"""Operator 6: SimHash near-duplicates, candidates pruned by pigeonring chains."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, connected_components, small_batches

BITS, SEGMENTS = 64, 8
MAX_BITS = 2
#: Fingerprints in one bucket up to which its pairs are compared directly; larger buckets link through shared neighbours.
HOT_BUCKET = 128
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of the 3-word shingles, unsigned; 0 without words."""
    words = text.encode().translate(LOWER).split() if text else []
    if not words:
        return 0
    shingles = list(map(b" ".join, zip(words, words[1:], words[2:]))) if len(words) >= 3 else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, len(shingles))
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 14):  # very long texts: bounded memory
        ones += np.unpackbits(hashes[k : k + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.fromiter((fingerprint(x) for x in b.column("text").to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(f.view(np.int64))], names=[key, "fp"])

    return run


def fingerprints(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, fp) with fp as a signed 64-bit number."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    return docs.select(key, F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints(key), f"{key} {kind}, fp long")


def _ring(fp: str, start: str) -> str:
    """SQL: fp turned left so that segment `start` leads."""
    w = BITS // SEGMENTS
    return f"(shiftleft({fp}, {w} * {start}) | if({start} = 0, 0L, shiftrightunsigned({fp}, {BITS} - {w} * {start})))"


def links(fps: DataFrame) -> DataFrame:
    """(a, b): pairs of different fingerprints within two bits, by which all classes join up.

    Pigeonring: with 8 segments and a budget of 2 bits, some start has running differences within
    l * 2 / 8 over its next l segments, for each l. So three consecutive segments agree (the key,
    24 bits), seven differ by one bit at most, all by two. A bucket of more than HOT_BUCKET
    fingerprints is handled exactly without pairs: each fingerprint and its 64 one-bit neighbours
    are keys; two fingerprints share one if and only if they differ by at most two bits.
    """
    w = BITS // SEGMENTS
    keyed = checkpoint(fps.select("fp").distinct().withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)))).withColumn("ring", F.expr(_ring("fp", "s"))).select("fp", "ring", F.expr(f"shiftleft(cast(s as long), {3 * w}) | shiftrightunsigned(ring, {BITS - 3 * w})").alias("key")))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = checkpoint(keyed.join(sizes, "key"))
    cold = shared.where(F.col("n") <= HOT_BUCKET)
    a, b = cold.select("key", F.col("fp").alias("a"), F.col("ring").alias("ra")), cold.select("key", F.col("fp").alias("b"), F.col("ring").alias("rb"))
    near = f"bit_count(shiftrightunsigned(ra ^ rb, {w})) <= 1 and bit_count(ra ^ rb) <= {MAX_BITS}"
    direct = a.join(b, "key").where("a < b").where(near).select("a", "b")
    hot = shared.where(F.col("n") > HOT_BUCKET).select("fp").distinct()
    around = hot.select("fp", F.explode(F.expr(f"concat(array(fp), transform(sequence(0, {BITS - 1}), i -> fp ^ shiftleft(1L, i)))")).alias("near"))
    through = around.groupBy("near").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # 65 at most: its own neighbours
    linked = through.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
    return direct.unionAll(linked).distinct()


def simhash_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of docs (doc_id, text).

    Documents whose fingerprints differ by at most two bits are linked; component_id is the
    smallest doc_id reachable. Null, empty and blank texts have fingerprint zero and link like any
    other; equal texts link; a repeated doc_id gives repeated rows; rows with a null doc_id are
    left out of component ids (null there unless a document with an id shares their class); an empty table
    gives no rows; other columns are not read. Copies cost one row per distinct fingerprint.
    """
    own = checkpoint(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")))
    first = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    comp = connected_components(links(own)).select(F.col("id").alias("fp"), F.col("component").alias("root"))
    classes = checkpoint(first.join(comp, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = classes.join(least, "root").select("fp", "component_id")
    return own.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One whole row of docs for each group of linked documents: that of the smallest doc_id.

    A row without a doc_id stays only if its group has none with one; of rows with the same doc_id, or
    of a group without any, the one whose content hashes least stays, of repeated rows one.
    """
    row, text = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).cast("binary")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.md5(text.cast("binary"))  # equal texts have equal fingerprints
    prints = checkpoint(fingerprints(docs.select(key.alias("doc_key"), text.alias("text")), "doc_key").distinct())
    comp = connected_components(links(prints)).select(F.col("id").alias("fp"), F.col("component").alias("root"))
    rooted = prints.join(comp, "fp", "left").select("doc_key", F.coalesce("root", "fp").alias("root"))
    rows = docs.select(key.alias("doc_key"), F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), row.alias("row")).alias("at"))
    lead = rows.join(rooted, "doc_key").groupBy("root").agg(F.min("at").alias("at")).select(F.col("at.row").alias("_row"))
    return docs.withColumn("_row", row).join(lead, "_row", "left_semi").dropDuplicates(["_row"]).drop("_row")

"""Operator 3: quality rules with thresholds learnt from mergeable quantile sketches."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import checkpoint, small_batches, words_of

SYMBOLS = re.compile(r"[#*$%&|<>]")
SPACES = " \t\n\r\x0b\x0c"
WINDOW = 8
MIN_WORDS = 20
#: Metrics judged adaptively, per 1000; each a whole number, so sketches are exact to merge.
METRICS = ("word_len", "symbols", "dup_lines", "repeats")
#: Sub-buckets for each power of two: a quantile is right to 1/32.
FINE = 32
#: To each group's sketch its language's and the whole corpus's are merged, each scaled to so many documents:
#: a small group leans on them, a large one outweighs them, and no size is a switch.
PRIOR = 100
#: A value is rejected beyond the 90 % quantile by SPREAD times its distance from the median, or below the 10 % one alike;
#: distances below the floor count as the floor. Beyond 10 % of a group, junk would be its normal.
SPREAD = 3.0
FLOOR = {"word_len": 250, "symbols": 10, "dup_lines": 100, "repeats": 60}


def text_stats(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines); null counts as empty."""
    words = words_of(text)
    if not words:
        return 0, 0, len(SYMBOLS.findall(text or "")), 0, 0, 0
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    lines = [x for x in text.split("\n") if x.encode().split()] if "\n" in text else [text]
    return n, chars, len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), _repeated(words), len(lines)


def _repeated(words: list[bytes]) -> int:
    """How many words stand in an 8-word window that occurs twice or more."""
    n = len(words)
    if n <= WINDOW:
        return 0
    windows = list(zip(*(words[k : n - WINDOW + 1 + k] for k in range(WINDOW)), strict=True))
    if len(set(windows)) == len(windows):
        return 0
    times, total, until = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            total += i + WINDOW - max(i, until)
            until = i + WINDOW
    return total


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [text_stats(x) for x in b.column("text").to_pylist()]
        cols = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 6
        kept = [k for k in b.schema.names if k != "text"]
        yield pa.RecordBatch.from_arrays([b.column(k) for k in kept] + cols, names=kept + [x.split()[0] for x in COUNTS.split(", ")])


def _bucket(v: Column) -> Column:
    """A whole number's bucket: exact below FINE, then FINE to a power of two."""
    e = F.length(F.bin(F.greatest(v, F.lit(1)))) - 1
    return F.when(v < FINE, v).otherwise(FINE * (e - 4) + F.call_function("shiftright", v, (e - 5).cast("int")) - FINE).cast("long")


def _value(b: Column) -> Column:
    """The middle of a bucket."""
    e = F.floor(b / FINE) + 4
    low = (F.lit(FINE) + b % FINE) * F.pow(F.lit(2.0), e - 5)
    return F.when(b < FINE, b.cast("double")).otherwise(low + F.pow(F.lit(2.0), e - 6))


def thresholds(stats: DataFrame) -> DataFrame:
    """(lang, source, metric, low, high) from the sketches of all documents that pass the base rules.

    A sketch is a histogram over logarithmic buckets: adding counts merges two of them. Rows are
    pre-aggregated by (lang, source, metric, bucket), so a hot source costs one row per bucket.
    """
    long = stats.where("not base_failed").select("lang", "source", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), _bucket(F.col(m)).alias("b")) for m in METRICS])).alias("x")).select("lang", "source", "x.*")
    fine = checkpoint(long.groupBy("lang", "source", "metric", "b").agg(F.count("*").alias("n")))
    groups = fine.select("lang", "source", "metric").distinct()
    by_lang = fine.groupBy("lang", "metric", "b").agg(F.sum("n").alias("n"))
    of_all = fine.groupBy("metric", "b").agg(F.sum("n").alias("n"))

    def prior(sketch: DataFrame, keys: list[str]) -> DataFrame:
        """The sketch scaled to PRIOR documents, for each group within it; weights in millionths of a document."""
        named = [F.col(k).alias(f"_{k}") for k in keys]
        total = sketch.groupBy(*keys).agg(F.sum("n").alias("total")).select(*named, "total")
        part = sketch.join(total, [sketch[k].eqNullSafe(total[f"_{k}"]) for k in keys]).select(*named, "b", F.floor(F.col("n") * (PRIOR * 1_000_000) / F.col("total")).cast("long").alias("w"))
        return groups.join(part, [groups[k].eqNullSafe(part[f"_{k}"]) for k in keys]).select("lang", "source", "metric", "b", "w")

    own = fine.select("lang", "source", "metric", "b", (F.col("n") * 1_000_000).alias("w"))
    mixed = own.unionAll(prior(by_lang, ["lang", "metric"])).unionAll(prior(of_all, ["metric"])).groupBy("lang", "source", "metric", "b").agg(F.sum("w").alias("w"))
    h = mixed.groupBy("lang", "source", "metric").agg(F.sort_array(F.collect_list(F.struct("b", "w"))).alias("h"), F.sum("w").alias("total"))  # at most FINE * 60 buckets

    def at(q: int) -> Column:
        """The value below which q percent of the weight is."""
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).cast("long").alias("b"))
        step = lambda a, x: F.when(a["seen"] * 100 >= F.col("total") * q, a).otherwise(F.struct((a["seen"] + x["w"]).alias("seen"), x["b"].alias("b")))
        return _value(F.aggregate("h", start, step, lambda a: a["b"]))

    t = h.select("lang", "source", "metric", *[at(q).alias(f"q{q}") for q in (10, 50, 90)])
    floor = F.element_at(F.create_map(*[F.lit(x) for kv in FLOOR.items() for x in kv]), F.col("metric")).cast("double")
    t = t.withColumn("floor", floor)
    below, above = F.greatest(F.col("q50") - F.col("q10"), F.col("floor")), F.greatest(F.col("q90") - F.col("q50"), F.col("floor"))
    return t.select("lang", "source", "metric", (F.col("q10") - SPREAD * below).alias("low"), (F.col("q90") + SPREAD * above).alias("high"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text, lang, source): word counts, base_failed, kept, failed_rules.

    n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words are as in the contract;
    base_failed: fewer than 20 words, or over 30 % of them in repeated 8-word windows. Other rules
    reject a document whose metric lies beyond its language and source's own threshold. Null text
    counts as empty (base_failed); a null lang or source is a group of its own; repeated rows are
    each judged; an empty table gives none; other columns, whatever their names, are not read.
    Documents that failed do not shape thresholds.
    """
    j = _judged(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string")))
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.concat_ws(",", "failed_rules").alias("failed_rules"))


def _judged(docs: DataFrame) -> DataFrame:
    """docs (text, lang, source and other columns) without text, with counts, base_failed, failed_rules and kept."""
    small_batches(docs.sparkSession)
    others = [f for f in docs.schema.fields if f.name != "text"]
    s = docs.select("text", *[F.col(f"`{f.name}`") for f in others]).mapInArrow(_stats, StructType([*others, *StructType.fromDDL(COUNTS).fields]))
    per = lambda a, b: F.floor(F.lit(1000) * F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("long")
    s = s.withColumns({"word_len": per("word_chars", "n_words"), "symbols": per("n_symbols", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words")})
    s = checkpoint(s.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))))
    t = thresholds(s).groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("metric", F.struct("low", "high")))).alias("limits"))  # four entries
    j = s.join(t, s["lang"].eqNullSafe(t["lang"]) & s["source"].eqNullSafe(t["source"]), "left").select(s["*"], "limits")
    outside = [F.when((F.col(m) < F.col("limits")[m]["low"]) | (F.col(m) > F.col("limits")[m]["high"]), F.lit(m)) for m in METRICS]
    j = j.withColumn("failed_rules", F.array_compact(F.array(*outside)))
    return j.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, whole, that the rules keep.

    A verdict follows from text, lang and source alone, so rows meet theirs by these (the text by
    its MD5): rows with the same doc_id or none are judged each for itself, repeated rows alike.
    """
    text, parts = F.col("text").cast("string"), ("lang", "source")
    key = F.md5(text.cast("binary"))
    good = _judged(docs.select(key.alias("_key"), text.alias("text"), *[F.col(c).cast("string").alias(c) for c in parts])).where("kept").select("_key", *[F.col(c).alias(f"_{c}") for c in parts]).distinct()
    return docs.join(good, [key == good["_key"], *[docs[c].cast("string").eqNullSafe(good[f"_{c}"]) for c in parts]], "left_semi")

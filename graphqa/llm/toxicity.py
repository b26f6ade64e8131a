"""Operator 10: toxicity by the nearest labelled examples, found in a block-max inverted index."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, small_batches

#: Bounds of what is learnt from: labelled rows (those with the smallest hash of doc_id), and terms.
MAX_EXAMPLES, MAX_TERMS = 20_000, 4096
#: A term must stand in so many toxic examples, and so many times as often among them as among the others.
MIN_TOXIC, MIN_LIFT = 5, 10.0
NEIGHBOURS, BLOCK = 15, 64
CUT = 0.7
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7)


def terms_of(text: str | None) -> Counter:
    """Lower-case words, and word beginnings of 4 to 7 letters (as `abcd*`), with their counts."""
    words = Counter(WORD.findall(text.lower())) if text else Counter()
    out: Counter = Counter(words)
    for w, n in words.items():
        for k in PREFIXES:
            if len(w) > k:
                out[w[:k] + "*"] += n
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, label, documents) with counts summed per few batches, so memory stays bounded."""
    seen: dict[tuple[str, int], int] = Counter()

    def flush() -> Iterator[pa.RecordBatch]:
        keys = list(seen)
        for k in range(0, len(keys), 50_000):
            part = keys[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.string()), pa.array([x[1] for x in part], pa.int32()), pa.array([seen[x] for x in part], pa.int64())], names=["term", "toxic", "n"])
        seen.clear()

    for b in batches:
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            seen.update((t, toxic) for t in terms_of(text))
        if len(seen) > 400_000:
            yield from flush()
    yield from flush()


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds two MinHash values of the text's 5-word shingles."""
    for b in batches:
        s1, s2 = [], []
        for text in b.column("text").to_pylist():
            w = WORD.findall((text or "").lower())
            h = np.array([zlib.crc32(" ".join(x).encode()) for x in zip(*(w[k:] for k in range(5)), strict=False)] or [zlib.crc32(" ".join(w).encode())], np.uint64)
            s1.append(int(h.min()))
            s2.append(int((h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(1)).min()))
        yield b.append_column("s1", pa.array(s1, pa.int64())).append_column("s2", pa.array(s2, pa.int64()))


@dataclass
class Index:
    """Examples as TF-IDF vectors of length 1 in an inverted index whose postings carry block maxima."""

    terms: dict[str, int]
    idf: np.ndarray
    ids: np.ndarray  # doc_id of each example, grouped so that like examples share blocks
    labels: np.ndarray
    starts: list[np.ndarray]  # per term: where each of its blocks begins among its postings
    blocks: list[np.ndarray]  # per term: block numbers
    peaks: list[np.ndarray]  # per term: the largest weight in the block
    posts: list[np.ndarray]  # per term: example numbers
    weights: list[np.ndarray]
    base: float  # share of toxic rows among examples without a term
    steps: tuple[np.ndarray, np.ndarray] | None = None  # raw vote, calibrated score

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers (ascending) and weights of length 1."""
        get, seen = self.terms.get, Counter()
        words = Counter(WORD.findall(text.lower())) if text else {}
        for w, n in words.items():
            if (i := get(w)) is not None:
                seen[i] += n
            for k in PREFIXES:
                if len(w) > k and (i := get(w[:k] + "*")) is not None:
                    seen[i] += n
        at = np.array(sorted(seen), np.int64)
        v = (1 + np.log(np.array([seen[i] for i in at.tolist()], np.float64))) * self.idf[at] if len(at) else np.zeros(0)
        return at, v / np.sqrt((v * v).sum()) if len(at) else v

    def nearest(self, at: np.ndarray, v: np.ndarray, k: int = NEIGHBOURS, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest cosine (ties: the smaller number) and the cosines; exact.

        Blocks are visited by falling upper bound (sum over terms of weight times block maximum),
        until the next bound is below the k-th cosine found.
        """
        n_blocks = -(-len(self.ids) // BLOCK)
        bound = np.zeros(n_blocks)
        for t, w in zip(at.tolist(), v.tolist(), strict=True):
            bound[self.blocks[t]] += w * self.peaks[t]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best_n, best_c = np.zeros(0, np.int64), np.zeros(0)
        step = 0
        while step < len(order):
            if len(best_c) == k and bound[order[step]] < best_c[-1] - 1e-9:
                break
            now = order[step : step + 4]
            step += 4
            got = np.zeros((len(now), BLOCK))
            for t, w in zip(at.tolist(), v.tolist(), strict=True):
                where = np.searchsorted(self.blocks[t], now)
                for row, (b, i) in enumerate(zip(now.tolist(), where.tolist(), strict=True)):
                    if i < len(self.blocks[t]) and self.blocks[t][i] == b:
                        lo, hi = self.starts[t][i], self.starts[t][i + 1]
                        got[row, self.posts[t][lo:hi] - b * BLOCK] += w * self.weights[t][lo:hi]
            numbers = (now[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            cos = got.ravel()
            keep = (cos > 0) & (numbers != skip)
            best_n, best_c = np.append(best_n, numbers[keep]), np.append(best_c, cos[keep])
            top = np.lexsort((best_n, -best_c))[:k]
            best_n, best_c = best_n[top], best_c[top]
        return best_n, best_c

    def vote(self, n: np.ndarray, c: np.ndarray) -> float:
        """Votes weighted by closeness, 1 / (distance + 0.1), with one vote for the base rate."""
        w = 1 / (1.1 - np.minimum(c, 1.0))
        return float(((w * self.labels[n]).sum() + self.base) / (w.sum() + 1))

    def calibrated(self, raw: float) -> float:
        if self.steps is None or not len(self.steps[0]):
            return raw
        return float(np.interp(raw, *self.steps))

    def score(self, text: str | None) -> tuple[float, list[int]]:
        """The score, and the doc_ids of the three nearest toxic examples as evidence."""
        if not len(self.ids):
            return self.base, []
        at, v = self.vector(text)
        if not len(at):
            return self.base, []
        n, c = self.nearest(at, v)
        if not len(n):
            return self.base, []
        return self.calibrated(self.vote(n, c)), [int(self.ids[i]) for i in n if self.labels[i]][:3]


def build_index(terms: list[tuple[str, int]], n_docs: int, examples: list[tuple[int, int, str]], base: float | None = None) -> Index:
    """An index of examples (doc_id, label, text) over terms (term, documents with it)."""
    numbers = {t: i for i, (t, _) in enumerate(terms)}
    idf = np.array([np.log((1 + n_docs) / (1 + df)) + 1 for _, df in terms])
    ix = Index(numbers, idf, np.zeros(0, np.int64), np.zeros(0), [], [], [], [], [], 0.0)
    vectors = [(d, y, *ix.vector(x)) for d, y, x in examples]
    without = [y for _, y, at, _ in vectors if not len(at)]
    ix.base = (sum(without) + 0.5) / (len(without) + 50) if base is None else base
    vectors = sorted((x for x in vectors if len(x[2])), key=lambda x: (int(x[2][np.argmax(x[3])]), x[0]))
    ix.ids, ix.labels = np.array([x[0] for x in vectors], np.int64), np.array([x[1] for x in vectors], np.float64)
    rows = np.concatenate([np.full(len(x[2]), i) for i, x in enumerate(vectors)]) if vectors else np.zeros(0, np.int64)
    cols = np.concatenate([x[2] for x in vectors]) if vectors else rows
    vals = np.concatenate([x[3] for x in vectors]) if vectors else np.zeros(0)
    order = np.lexsort((rows, cols))
    rows, cols, vals = rows[order], cols[order], vals[order]
    cuts = np.searchsorted(cols, np.arange(len(terms) + 1))
    for t in range(len(terms)):
        post, w = rows[cuts[t] : cuts[t + 1]], vals[cuts[t] : cuts[t + 1]]
        b, first = np.unique(post // BLOCK, return_index=True)
        ix.blocks.append(b)
        ix.starts.append(np.append(first, len(post)))
        ix.peaks.append(np.maximum.reduceat(w, first) if len(w) else w)
        ix.posts.append(post)
        ix.weights.append(w)
    raw = np.array([ix.vote(*ix.nearest(x[2], x[3], skip=i)) for i, x in enumerate(vectors)])
    ix.steps = _monotone(raw, ix.labels) if len(raw) else None
    return ix


def _monotone(raw: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Calibration: the rising step function nearest to labels (pool adjacent violators), smoothed by one vote at 0.5."""
    pools: list[list[float]] = []  # sum of labels, rows, sum of raw
    for x, y in sorted(zip(raw.tolist(), labels.tolist(), strict=True)):
        pools.append([y, 1.0, x])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], a, strict=True)]
    return np.array([p[2] / p[1] for p in pools]), np.maximum.accumulate(np.array([(p[0] + 0.5) / (p[1] + 1) for p in pools]))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> Index:
    """Terms and examples from at most MAX_EXAMPLES labelled, not held-out rows."""
    small_batches(docs.sparkSession)
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    y = y.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    y = y.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(MAX_EXAMPLES)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = d.join(F.broadcast(y), "doc_id").select("doc_id", "text", "toxic")  # the broadcast has MAX_EXAMPLES rows at most
    own = checkpoint(own.mapInArrow(_signed, "doc_id long, text string, toxic int, s1 long, s2 long"))
    # One of a group of near copies, else their rare words would pass for signs of toxicity.
    own = checkpoint(own.groupBy("s1", "toxic").agg(F.min_by(F.struct("doc_id", "text", "s2"), "doc_id").alias("x")).select("toxic", "x.*").groupBy("s2", "toxic").agg(F.min_by(F.struct("doc_id", "text"), "doc_id").alias("x")).select("toxic", "x.*"))
    sizes = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    counts = own.mapInArrow(_counted, "term string, toxic int, n long").groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("q"))
    lift = (F.col("p") / F.lit(max(1, pos))) / ((F.col("q") + 0.5) / F.lit(max(1, neg)))
    chosen = counts.where((F.col("p") >= MIN_TOXIC) & (lift >= MIN_LIFT)).orderBy(F.desc(F.col("p") * F.log(lift)), "term").limit(MAX_TERMS).collect()
    names = {r["term"] for r in chosen}
    everywhere = {r["term"]: r["n"] for r in d.mapInArrow(_frequencies(names), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # MAX_TERMS + 1 rows at most
    terms = [(r["term"], everywhere.get(r["term"], 0)) for r in chosen]
    kept = _with_terms(own, names)
    found = [(r["doc_id"], r["toxic"], r["text"]) for r in kept.collect()]
    by = Counter(x[1] for x in found)
    base = (pos - by.get(1, 0) + 0.5) / (pos + neg - len(found) + 50)
    return build_index(terms, everywhere.get("", 0), sorted(found), base)


def _frequencies(terms: set[str]):
    """In how many documents each of the terms stands, and under the empty term the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            n[""] += b.num_rows
            for text in b.column("text").to_pylist():
                words = set(WORD.findall(text.lower())) if text else ()
                n.update(({w for w in words if w in terms}) | {p for w in words for k in PREFIXES if len(w) > k and (p := w[:k] + "*") in terms})
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["term", "n"])

    return run


def _with_terms(own: DataFrame, terms: set[str]) -> DataFrame:
    """(doc_id, toxic, text) with text cut down to the words that carry a term; rows without one are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, x, y in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                words = [w for w in WORD.findall((x or "").lower()) if w in terms or any(len(w) > k and w[:k] + "*" in terms for k in PREFIXES)]
                if words:
                    rows.append((d, y, " ".join(words)))
            cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string()), strict=True)], names=["doc_id", "toxic", "text"])

    return own.mapInArrow(run, "doc_id long, toxic int, text string")


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence), one row per row of docs (doc_id, text).

    Examples are labelled rows whose crc32(doc_id) mod 3 is not 1; at most MAX_EXAMPLES of them and
    MAX_TERMS terms are learnt from. The score is the calibrated, closeness-weighted vote of the 15
    nearest examples by exact TF-IDF cosine; a text without any term, an empty or a null one, gets the
    share of toxic rows among examples without terms. Terms are weighted by their frequency in all of docs; an example
    without a term has the zero vector, so it is nobody's neighbour and isn't kept. Null labels and labels of unknown documents
    are not used; a repeated label counts once (the largest); a null doc_id is not held out;
    repeated rows score alike; without labels every score is the prior; an empty table gives no
    rows; other columns are not read. evidence: doc_ids of the nearest toxic examples.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(learn(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for b in batches:
            got = [ix.score(x) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x[0] for x in got], pa.float64()), pa.array([x[1] for x in got], pa.list_(pa.int64()))], names=["doc_id", "score", "evidence"])

    s = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, evidence array<long>")
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "evidence")


def crc_of(doc_id: int) -> int:
    """As held_out() counts, for tests."""
    return zlib.crc32(str(doc_id).encode())

"""Operator 2: benchmark decontamination by latent semantic retrieval."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Passages of documents are 2 * HALF words, a new one every HALF words.
HALF = 32
#: Terms are hashed to so many dimensions; the latent space has RANK of them. Both fixed, so the projection has 16 MB.
DIMS, RANK, OVER = 1 << 15, 128, 8
POWER_ROUNDS = 1
SEED = 11
#: Benchmark rows that are searched for at once; larger benchmarks are searched in blocks.
ITEMS = 20_000
#: Latent cosine of a candidate; shared words and longest common subsequence, as parts of the item's words.
MIN_COSINE, MIN_LCS, PARAPHRASE_LCS = 0.25, 0.8, 0.6
#: Part of a benchmark passage's latent length that a candidate covers in its direction; a passage cut by half has about half.
MIN_COVER = 0.25
#: So many of an item's rare words must stand near each other before a place is compared, where the item has so many.
RARE = 3
#: Shorter items must stand in a document word for word; answers are this long at least.
SHORT, ANSWER = 8, 5
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & masks.get(y, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


class Benchmark:
    """One block of benchmark items: their words as numbers, and (after fit) their latent vectors."""

    def __init__(self, items: list[tuple[int, str]]):
        split = [(i, words_of(x), answer_of(x)) for i, x in items]
        split = [x for x in split if x[1]]
        vocabulary = sorted({w for _, ws, _ in split for w in ws})
        self.number = {w: k for k, w in enumerate(vocabulary)}
        places = np.random.default_rng(SEED + 1).permutation(DIMS)
        self.dim = places[np.arange(len(vocabulary)) % DIMS]  # unlike terms share a dimension only beyond DIMS terms
        self.ids = np.array([i for i, _, _ in split], np.int64)
        self.words = [np.array([self.number[w] for w in ws], np.int64) for _, ws, _ in split]
        self.counts = [Counter(ws.tolist()) for ws in self.words]
        self.answers = [[self.number[w] for w in ans] for _, _, ans in split]
        # Passages of items: as long as those of documents.
        self.passages = [(k, ws[at : at + 2 * HALF]) for k, ws in enumerate(self.words) for at in range(0, max(1, len(ws) - HALF), HALF)]
        self.owner = np.array([k for k, _ in self.passages], np.int64)

    def index(self, idf: np.ndarray) -> None:
        """Postings of each item's rarest words: no stretch that same() accepts has fewer than need[k] of them."""
        terms, items, self.need = [], [], np.ones(len(self.words), np.int64)
        for k, ws in enumerate(self.words):
            t, n = np.unique(ws, return_counts=True)
            order = np.lexsort((t, -idf[t]))
            t, n = t[order], n[order]
            least = len(ws) if len(ws) < SHORT else int(np.ceil(PARAPHRASE_LCS * len(ws) - 1e-9))
            left = np.append(len(ws) - np.cumsum(n), -1)  # words of the item that are not among its first k + 1
            for need in range(min(RARE, len(t)), 0, -1):
                spare = int(np.sort(n)[::-1][: need - 1].sum())
                if spare < least:
                    break
            size = int(np.argmax(left + spare < least)) + 1
            self.need[k] = min(need, size)
            terms.append(t[:size])
            items.append(np.full(len(t[:size]), k))
        term, item = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (terms, items))
        order = np.argsort(term, kind="stable")
        self.post_items = item[order]
        self.post_at = np.searchsorted(term[order], np.arange(len(self.number) + 1))
        self.wide = np.array([len(ws) + max(4, len(ws) // 4) for ws in self.words], np.int64)

    def places(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(item, place) where the item's rare words stand near enough to each other; none that holds an item is left out."""
        at = np.nonzero(ids >= 0)[0]
        n = self.post_at[ids[at] + 1] - self.post_at[ids[at]]
        at, n = at[n > 0], n[n > 0]
        if not len(at):
            return []
        start = np.repeat(self.post_at[ids[at]] - np.append(0, np.cumsum(n)[:-1]), n)
        item, place = self.post_items[start + np.arange(len(start))], np.repeat(at, n)
        order = np.argsort(item, kind="stable")
        item, place = item[order], place[order]
        term, found = ids[place], []
        last = np.searchsorted(item, item, side="right")
        stop = np.minimum(np.searchsorted(item * (len(ids) + 1) + place, item * (len(ids) + 1) + np.minimum(place + self.wide[item], len(ids)), side="left"), last)
        for k in np.nonzero(stop - np.arange(len(item)) >= self.need[item])[0].tolist():
            if len(set(term[k : stop[k]].tolist())) >= self.need[item[k]]:
                found.append((int(item[k]), int(place[k])))
        return found

    def groups(self, ids: np.ndarray) -> list[tuple[int, list[int]]]:
        """The places of an item together whose surroundings overlap."""
        out: list[tuple[int, list[int]]] = []
        for item, place in self.places(ids):
            if out and out[-1][0] == item and place - out[-1][1][-1] <= 2 * self.wide[item]:
                out[-1][1].append(place)
            else:
                out.append((item, [place]))
        return out

    def may_stand(self, item: int, text: list[int]) -> bool:
        """Whether a stretch has as many of the item's words as same() asks for at least."""
        counts, n = self.counts[item], len(self.words[item])
        least = n if n < SHORT else PARAPHRASE_LCS * n
        common = counts.keys() & set(text)
        return len(common) >= least or sum(map(counts.__getitem__, common)) >= least

    def encode(self, text: str | None) -> np.ndarray:
        """The text's words as numbers of benchmark words, -1 for others."""
        return np.fromiter(map(self.number.get, words_of(text), repeat(-1)), np.int64)


def answer_of(text: str) -> list[str]:
    """The words of the last sentence, with as many before it as make ANSWER."""
    sentences = [ws for s in re.split(r"[.!?\n]+", text or "") if (ws := words_of(s))]
    out: list[str] = []
    while sentences and len(out) < ANSWER:
        out = sentences.pop() + out
    return out


def _half_counts(ids: np.ndarray, n_terms: int) -> np.ndarray:
    """For each term, in how many HALF-word stretches of one document it stands."""
    at = np.nonzero(ids >= 0)[0]
    pairs = np.unique(at // HALF * n_terms + ids[at])
    return np.bincount(pairs % n_terms, minlength=n_terms)


def _document_counts(bench):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b0 = bench.value
        total, stretches = np.zeros(len(b0.number), np.int64), 0
        for b in batches:
            for text in b.column("text").to_pylist():
                ids = b0.encode(text)
                if len(ids):
                    total += _half_counts(ids, len(total))
                    stretches += -(-len(ids) // HALF)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(total[at], stretches), pa.int64())], names=["term", "n"])

    return run


def randomized_svd(rows: DataFrame, idf: np.ndarray, bench) -> np.ndarray:
    """Right singular vectors (DIMS, RANK) of the TF-IDF matrix whose rows are passages.

    Each round multiplies A'A with a thin matrix: partitions of passages give partial products, which
    meet by dimension and are summed there; so a row for each dimension, DIMS * (RANK + OVER) numbers
    at most, a fixed count, reaches the driver.
    """
    spark = rows.sparkSession
    width = RANK + OVER
    q = np.random.default_rng(SEED).standard_normal((DIMS, width)).astype(np.float32)

    def times(thin: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast((thin, idf))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (m, w), b0 = sent.value, bench.value
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for terms in b.column("terms").to_pylist():
                    t, n = np.unique(np.array(terms, np.int64), return_counts=True)
                    v = (n * w[t]).astype(np.float32)
                    v /= max(float(np.sqrt((v * v).sum())), 1e-9)
                    y = v @ m[b0.dim[t]]
                    for d, x in zip(b0.dim[t].tolist(), v.tolist(), strict=True):
                        sums[d] = sums.get(d, 0) + x * y
            keys = list(sums)
            for k in range(0, len(keys), 512):
                part = keys[k : k + 512]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([sums[d].astype(np.float32).tobytes() for d in part], pa.binary())], names=["dim", "v"])

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for d, v in zip(b.column("dim").to_pylist(), b.column("v").to_pylist(), strict=True):
                    sums[d] = sums.get(d, 0) + np.frombuffer(v, np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["dim", "v"])

        out = np.zeros((DIMS, width), np.float64)
        parts = rows.mapInArrow(run, "dim long, v binary").repartition("dim").mapInArrow(summed, "dim long, v binary")
        for r in parts.toLocalIterator():
            out[r["dim"]] = np.frombuffer(r["v"], np.float32)
        sent.destroy()
        return out

    for _ in range(POWER_ROUNDS + 1):
        q = np.linalg.qr(times(q))[0].astype(np.float32)
    small = q.T.astype(np.float64) @ times(q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    top = np.argsort(-values)[:RANK]
    top = top[values[top] > 1e-6 * max(float(values.max()), 1e-12)]
    return (q @ vectors[:, top]).astype(np.float32)


def _search(shared):
    """Adds the items found in text to the columns items and likeness."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench, project, latent = shared.value
        for b in batches:
            items, likeness = [], []
            for text, had, best in zip(*(b.column(k).to_pylist() for k in ("text", "items", "likeness")), strict=True):
                found = find(bench, project, latent, bench.encode(text))
                items.append(sorted(had + [i for i, _ in found]))
                likeness.append(max([best, *(x for _, x in found)]))
            yield b.set_column(b.schema.get_field_index("items"), "items", pa.array(items, pa.list_(pa.int64()))).set_column(b.schema.get_field_index("likeness"), "likeness", pa.array(likeness, pa.float64()))

    return run


def directions(latent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of latent vectors, and the vectors at length one."""
    lengths = np.sqrt((latent * latent).sum(axis=1))
    return lengths, latent / np.maximum(lengths, 1e-9)[:, None]


def find(bench: Benchmark, project: np.ndarray, latent: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> list[tuple[int, float]]:
    """(item_id, likeness) of the items that a document, given as word numbers, holds; latent: as of directions()."""
    if not len(ids) or not len(bench.ids):
        return []
    at = np.nonzero(ids >= 0)[0]
    if not len(at):
        return []
    text = ids.tolist()
    places = [(item, place) for item, near in bench.groups(ids) if bench.may_stand(item, text[max(0, near[0] - int(bench.wide[item])) : near[-1] + int(bench.wide[item])]) for place in near]
    if not places:  # same() accepts nothing anywhere
        return []
    half = at // HALF
    n_half = -(-len(ids) // HALF)
    first = np.nonzero(np.append(True, half[1:] != half[:-1]))[0]
    sums = np.zeros((n_half + 1, project.shape[1]), np.float32)
    sums[half[first]] = np.add.reduceat(project[ids[at]], first, axis=0)
    z = sums[:-1] + sums[1:]
    norm = np.sqrt((z * z).sum(axis=1))
    z /= np.maximum(norm, 1e-9)[:, None]
    lengths, unit = latent
    found: dict[int, float] = {}
    tried: set[tuple[int, int]] = set()
    able = np.zeros(len(bench.ids), bool)  # items that same() may accept somewhere
    able[[item for item, _ in places]] = True
    of = np.nonzero(able[bench.owner])[0]  # their passages
    lengths, unit, owners = lengths[of], unit[of], bench.owner[of]
    for k in range(0, len(z), 4096):
        cosine = z[k : k + 4096] @ unit.T
        window, passage = np.nonzero((cosine >= MIN_COSINE) & (cosine * norm[k : k + 4096, None] >= MIN_COVER * lengths))
        for w, item in zip((window + k).tolist(), owners[passage].tolist(), strict=True):
            if item in found or (item, w) in tried:
                continue
            tried.add((item, w))
            size = len(bench.words[item])
            likeness = same(bench, item, text[max(0, w * HALF - size - HALF) : (w + 2) * HALF + size + HALF])
            if likeness:
                found[item] = likeness
    for item, place in places:  # the exact way: what the latent space does not hold
        if item not in found:
            wide = int(bench.wide[item])
            likeness = same(bench, item, text[max(0, place - wide) : place + wide])
            if likeness:
                found[item] = likeness
    return sorted((int(bench.ids[i]), s) for i, s in found.items())


def same(bench: Benchmark, item: int, text: list[int]) -> float:
    """Part of the item's words that stand in order in a stretch of a document, 0 unless it holds the item.

    A leak: MIN_LCS of the words within a stretch hardly longer than the item; or a paraphrase with
    PARAPHRASE_LCS of them whose answer stands there word for word.
    """
    counts, n = bench.counts[item], len(bench.words[item])
    if not bench.may_stand(item, text):
        return 0.0
    own, answer = bench.words[item].tolist(), bench.answers[item]
    if n < SHORT:
        return 1.0 if any(text[k : k + n] == own for k in range(len(text) - n + 1)) else 0.0
    have = Counter(text)
    if sum(min(c, have[w]) for w, c in counts.items()) < PARAPHRASE_LCS * n:
        return 0.0
    best, wide = 0, n + max(4, n // 4)
    inside = list(accumulate(map(counts.__contains__, text), initial=0))
    for k in range(0, max(1, len(text) - wide + 1), max(1, n // 8)):
        if inside[min(len(text), k + wide)] - inside[k] > best:
            best = max(best, lcs(own, text[k : k + wide]))
    best = max(best, lcs(own, text[-wide:]))
    share = best / n
    if share >= MIN_LCS:
        return share
    if share >= PARAPHRASE_LCS and answer and any(text[k : k + len(answer)] == answer for k in range(len(text) - len(answer) + 1)):
        return share
    return 0.0


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, leaked, items, likeness), one row per row of docs (doc_id, text).

    items: the item_ids of benchmark (item_id, text) that the document holds, exactly or as a
    paraphrase; likeness: the largest part of an item's words found in order. Candidates come from
    cosines between passages in the latent space of a randomised SVD of the benchmark's TF-IDF
    passages, with document frequencies over all of docs, and from places that hold enough of an item's
    rarest words, which no accepted place lacks; the longest common subsequence and the
    item's answer (its last sentence) decide. Case and punctuation don't count. Null and empty texts
    hold nothing; null, empty or wordless items match nothing; a null item_id is left out; repeated
    items and rows are each judged; empty tables give no rows or no leaks; other columns are not read.
    A benchmark of more than ITEMS rows is searched in blocks by hash of item_id.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _judged(d, benchmark).select("doc_id", (F.size("items") > 0).alias("leaked"), "items", "likeness")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, whole and in place, that hold no benchmark item (see contamination)."""
    packed = docs.select(F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"))
    return _judged(packed, benchmark).where(F.size("items") == 0).select("own.*")


def _judged(d: DataFrame, benchmark: DataFrame) -> DataFrame:
    """d (text and other columns) with items and likeness."""
    spark = d.sparkSession
    sc = spark.sparkContext
    small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    blocks = max(1, -(-items.count() // ITEMS))
    out = d.withColumns({"items": F.array().cast("array<long>"), "likeness": F.lit(0.0)})
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()  # about ITEMS rows
        bench = Benchmark(sorted((r["item_id"], r["text"]) for r in rows))
        n = len(bench.number)
        if not n:
            continue
        sent = sc.broadcast(bench)
        counts = {r["term"]: r["n"] for r in d.select("text").mapInArrow(_document_counts(sent), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        df = np.array([counts.get(t, 0) for t in range(n)], np.float64)
        idf = np.log((2 + counts.get(-1, 0)) / (1 + df)) + 0.05
        bench.index(idf)
        passages = spark.createDataFrame([(p.tolist(),) for _, p in bench.passages], "terms array<long>").repartition(-(-len(bench.passages) // 2000))
        vectors = randomized_svd(passages, idf, sent)
        project = (vectors[bench.dim] * idf[:, None]).astype(np.float32)
        latent = np.stack([project[p].sum(axis=0) for _, p in bench.passages])
        out = out.mapInArrow(_search(sc.broadcast((bench, project, directions(latent)))), out.schema)
    return out

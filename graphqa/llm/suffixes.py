"""Operator 4: removal of repeated byte strings by two-stage suffix sorting.

Windows of SPAN bytes are dealt to groups by an anchor that their content picks: the least hash
among their GRAM-byte strings. Equal windows pick equal anchors, so a group sees all copies of its
windows. Windows whose anchor occurs once cannot repeat and go no further. Each group's suffixes
are sorted in two stages and neighbours compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, drop_written, small_batches

SPAN, GRAM = 200, 32
#: Bytes hashed at once; longer texts are cut into overlapping stretches.
STRETCH = 1 << 19
#: Bytes of fragments sorted at once; groups are never divided between two sorts.
SORT_BYTES = 1 << 20
#: Fragments of an anchor beyond which its group is dealt into parts that are reduced first, and fragments left over then that a task takes.
HOT, REST = 1024, 20_000

_W = SPAN - GRAM + 1
_POS = np.uint64((1 << 21) - 1)
_rng = np.random.default_rng(4)
_TABLE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, STRETCH + SPAN + GRAM + 1)
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _powers.append(p)
        del _powers[:-2]
    return _powers[0], _powers[1]


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor, hash) of each run of windows with one anchor.

    data: texts put together; ends: where each ends. Windows don't cross ends.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < SPAN:
        return none, none, none, np.zeros(0, np.uint64)
    up, down = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[:n], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    m = len(h)
    v = np.full(-(-m // _W) * _W + _W, ~np.uint64(0), np.uint64)
    v[:m] = (h & ~_POS) | np.arange(m, dtype=np.uint64)
    grid = v.reshape(-1, _W)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.ascontiguousarray(np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]).ravel()
    windows = n - SPAN + 1
    at = (np.minimum(after[:windows], before[_W - 1 : _W - 1 + windows]) & _POS).astype(np.int64)
    whole = np.ones(windows + SPAN, bool)
    for e in ends[:-1].tolist():  # windows that begin less than SPAN before an end
        whole[max(0, e - SPAN + 1) : e] = False
    starts = np.nonzero(whole[:windows])[0]
    if not len(starts):
        return none, none, none, np.zeros(0, np.uint64)
    a = at[starts]
    new = np.append(True, (a[1:] != a[:-1]) | (starts[1:] != starts[:-1] + 1))
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(starts)) - 1
    return starts[first], starts[last], a[first], h[a[first]]


def _stretches(texts: list[tuple[bytes, bytes]]) -> Iterator[list[tuple[bytes, int, bytes]]]:
    """Lists of (class, offset, bytes) of about STRETCH bytes; stretches of a text share SPAN - 1 bytes."""
    now, size = [], 0
    for c, t in texts:
        for at in range(0, max(1, len(t) - SPAN + 1), STRETCH):
            piece = t[at : at + STRETCH + SPAN - 1]
            if now and size + len(piece) > STRETCH + SPAN:
                yield now
                now, size = [], 0
            now.append((c, at, piece))
            size += len(piece)
    if now:
        yield now


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()  # a task's copies of a text are one; 16 bytes a row
    for b in batches:
        new = {}
        for c, x in zip(b.column("cls").to_pylist(), b.column("text").to_pylist(), strict=True):
            if c not in seen:
                seen.add(c)
                new[c] = x.encode()
        for part in _stretches(list(new.items())):
            ends = np.cumsum([len(x[2]) for x in part])
            first, last, _, h = anchors(np.frombuffer(b"".join(x[2] for x in part), np.uint8), ends)
            doc = np.searchsorted(ends, first, side="right")
            shift = np.array([x[1] for x in part], np.int64) - np.append(0, ends[:-1])
            cls = pa.array([x[0] for x in part], pa.binary()).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([cls, pa.array(h.view(np.int64)), pa.array(first + shift[doc]), pa.array(last + shift[doc])], names=["cls", "h", "first", "last"])


def suffix_order(data: bytes, need: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Positions where need holds, in the order of the suffixes' first SPAN bytes, in two stages.

    First, suffixes smaller than their successor are sorted directly. Then one scan over the
    buckets of first bytes induces the others: a suffix larger than its successor follows from the
    successor's place. need must hold from each position to the next smaller-type one. gaps: the
    separators, which sort before all bytes; the last byte must be one.
    """
    s = np.frombuffer(data, np.uint8).astype(np.int16) + 1
    s[gaps] = 0
    n = len(s)
    step = np.zeros(n, np.int64)
    step[:-1] = np.sign(s[1:] - s[:-1])
    step[-1] = 1
    at = np.where(step != 0, np.arange(n), n)
    decided = np.minimum.accumulate(at[::-1])[::-1]
    small = step[np.minimum(decided, n - 1)] > 0  # smaller than its successor
    direct = np.nonzero(small & need)[0]
    if data.count(0) == len(gaps):
        key = lambda i: data[i : i + SPAN]
    else:  # zero bytes within texts sort after separators
        wide = s.astype(">u2").tobytes()
        key = lambda i: wide[2 * i : 2 * (i + SPAN)]
    ranked = np.array(sorted(direct.tolist(), key=key), np.int64)
    heads = s[ranked]
    cuts = np.searchsorted(heads, np.arange(258))
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    out: list[np.ndarray] = []
    for c in range(257):
        done: list[np.ndarray] = []
        wave = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(wave):
            done.append(wave)
            p = wave - 1
            p = p[p >= 0]
            wave = p[(s[p] == c) & ~small[p] & need[p]]
        done.append(ranked[cuts[c] : cuts[c + 1]])
        bucket = np.concatenate(done)
        if not len(bucket):
            continue
        out.append(bucket)
        p = bucket - 1
        p = p[p >= 0]
        p = p[(s[p] > c) & need[p]]  # larger than its successor
        if len(p):
            p = p[np.argsort(s[p], kind="stable")]
            own, first = np.unique(s[p], return_index=True)
            for x, part in zip(own.tolist(), np.split(p, first[1:]), strict=True):
                waiting[x].append(part)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _need(lengths: np.ndarray, starts: np.ndarray, data: bytes) -> np.ndarray:
    """The window starts of each fragment, and from its last one on to the next smaller-type position."""
    s = np.frombuffer(data, np.uint8)
    need = np.zeros(len(s), bool)
    for a, n in zip(starts.tolist(), lengths.tolist(), strict=True):
        end = a + n - SPAN
        while end < a + n and (s[end] >= s[end + 1] or end + 1 == a + n):  # to a rise, or the separator
            end += 1
        need[a : end + 1] = True
    return need


def repeated(fragments: list[bytes]) -> list[np.ndarray]:
    """For each of these different fragments, whether the window at each start occurs at another start as well."""
    lengths = np.array([len(f) for f in fragments])
    starts = np.append(0, np.cumsum(lengths + 1)[:-1])
    data = b"\0".join(fragments) + b"\0"
    order = suffix_order(data, _need(lengths, starts, data), starts + lengths)
    frag = np.searchsorted(starts, order, side="right") - 1
    order = order[order - starts[frag] <= lengths[frag] - SPAN]
    padded = np.frombuffer(data + bytes(8), np.uint8)
    words = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view(np.uint64).ravel()
    alike = np.arange(1, len(order))  # neighbours whose common prefix is still growing
    for k in range(0, SPAN, 8):
        alike = alike[words[order[alike] + k] == words[order[alike - 1] + k]]
    twice = np.zeros(len(data), bool)
    twice[order[alike]] = True
    twice[order[alike - 1]] = True
    return [twice[a : a + n - SPAN + 1] for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of the bytes that the windows starting where hit holds cover."""
    at = np.nonzero(hit)[0]
    if not len(at):
        return []
    cut = np.nonzero(np.diff(at) > SPAN)[0]
    return list(zip(at[np.append(0, cut + 1)].tolist(), (at[np.append(cut, len(at) - 1)] + SPAN).tolist(), strict=True))


FRAGMENTS = "h long, parts int, part int, cls binary, first long, fragment binary"
MARKS = "h long, parts int, cls binary, first long, start long, stop long, fragment binary"


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for cls, text, spots in zip(b.column("cls").to_pylist(), b.column("text").to_pylist(), b.column("spots").to_pylist(), strict=True):
            t = text.encode()
            for x in spots:
                rows.append((x["h"], x["parts"], x["part"], cls, x["first"], t[x["first"] : x["last"] + SPAN]))
        yield from _batches(rows, FRAGMENTS)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batches(rows: list[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    fields = [x.split() for x in schema.split(", ")]
    for k in range(0, len(rows), 4096):
        yield pa.RecordBatch.from_arrays([pa.array(list(c), _TYPES[t]) for c, (_, t) in zip(zip(*rows[k : k + 4096], strict=True), fields, strict=True)], names=[f for f, _ in fields])


def _sorted_groups(last_round: bool):
    """Marks repeated windows group by group; input is sorted by (h, part). In the first round,
    different fragments of divided groups are handed on, with what is known of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(rows: list[dict]) -> Iterator[tuple]:
            same: dict[tuple[int, int, bytes], list[dict]] = {}
            for r in rows:
                same.setdefault((r["h"], r["part"], r["fragment"]), []).append(r)
            # Windows of different groups differ: one sort takes many groups.
            alone: dict[tuple[int, int], int] = {}
            for h, part, _ in same:
                alone[(h, part)] = alone.get((h, part), 0) + 1
            sort = [f for f in dict.fromkeys(f for h, part, f in same if alone[(h, part)] > 1)]
            hits = dict(zip(sort, repeated(sort), strict=True)) if sort else {}
            for (h, _, f), copies in same.items():
                places = {(r["cls"], r["first"]) for r in copies}
                hit = np.ones(len(f) - SPAN + 1, bool) if len(places) > 1 else hits.get(f)
                runs = _runs(hit) if hit is not None else []
                for cls, first in places:
                    for a, e in runs:
                        yield (h, 0, cls, first, first + a, first + e, None)
                if not last_round and copies[0]["parts"] > 1:
                    cls, first = min(places)
                    yield (h, copies[0]["parts"], cls, first, 0, 0, f)

        held: list[dict] = []
        size, key = 0, None
        for b in batches:
            for r in b.to_pylist():
                if (r["h"], r["part"]) != key:
                    key = (r["h"], r["part"])
                    if size > SORT_BYTES:
                        yield from _batches(list(work(held)), MARKS)
                        held, size = [], 0
                held.append(r)
                size += len(r["fragment"])
        if held:
            yield from _batches(list(work(held)), MARKS)

    return run


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for r in b.to_pylist():
            f = r["fragment"]
            rows += [(hashlib.blake2b(f[k : k + SPAN], digest_size=16).digest(), r["cls"], r["first"] + k) for k in range(len(f) - SPAN + 1)]
        yield from _batches(rows, "w binary, cls binary, start long")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for cls, text, marks in zip(b.column("cls").to_pylist(), b.column("text").to_pylist(), b.column("marks").to_pylist(), strict=True):
            t = text.encode()
            spans: list[list[int]] = []
            for m in sorted((x["start"], x["stop"]) for x in marks):
                if spans and m[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], m[1])
                else:
                    spans.append([*m])
            edges = [0, *(x for s in spans for x in s), len(t)]
            kept = b"".join(t[a:e] for a, e in zip(edges[::2], edges[1::2], strict=True))
            rows.append((cls, sum(e - a for a, e in spans), len(spans), hashlib.sha256(kept).hexdigest(), [x for s in spans for x in s]))
        cols = zip(*rows, strict=True) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())), strict=True)], names=["cls", "n_removed", "n_spans", "kept_sha256", "edges"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, edges), one row per row of docs (doc_id, text).

    Each byte that lies in a SPAN-byte string which starts anywhere else too, in the same text or
    another, is removed; edges lists starts and ends of the removed runs. Texts are UTF-8; a null
    text is empty; matches never cross texts; a text that another row repeats whole is removed whole
    if it has SPAN bytes. Null and repeated doc_ids are rows like others; an empty table gives none; other columns
    are not read. Equal texts count as one class, so copies cost a row of 16 bytes each. A group
    with more than HOT fragments is dealt out and reduced to its different fragments first; should
    more than REST of those be left, single windows are counted by a hash of 128 bits instead.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sha = F.sha2(F.col("text").cast("binary"), 256)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("sha", sha)
    d = d.withColumns({"cls": F.unhex(F.substring("sha", 1, 32)), "n_bytes": F.octet_length("text").cast("long")})
    long = d.where(F.col("n_bytes") >= SPAN)
    found = checkpoint(long.select("cls", "text").mapInArrow(_anchor_rows, "cls binary, h long, first long, last long"))
    place = F.xxhash64("cls", "first")
    dup = found.groupBy("h").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n")).where("a <> b")
    dup = checkpoint(dup.select("h", F.ceil(F.col("n") / HOT).cast("int").alias("parts")))  # written, so the join's sides are plain shuffles that AQE can split
    spots = found.join(dup, "h").withColumn("part", F.pmod(place, F.col("parts")).cast("int"))
    by_class = spots.groupBy("cls").agg(F.collect_set(F.struct("h", "parts", "part", "first", "last")).alias("spots"))  # bounded by a text
    lead = long.groupBy("cls").agg(F.min(F.coalesce("doc_id", F.lit(-1))).alias("lead"))
    wanted = by_class.join(lead, "cls")
    texts = long.select("cls", F.coalesce("doc_id", F.lit(-1)).alias("lead"), "text")
    touched = checkpoint(texts.join(wanted, ["cls", "lead"]).select("cls", "text", "spots"))
    drop_written(found)
    drop_written(dup)
    deal = touched.mapInArrow(_fragments, FRAGMENTS).repartition("h", "part").sortWithinPartitions("h", "part")
    first = checkpoint(deal.mapInArrow(_sorted_groups(False), MARKS))
    marks = first.where("fragment is null").select("cls", "start", "stop")
    rest = first.where("fragment is not null").select("h", "parts", F.lit(0).alias("part"), "cls", "first", "fragment")
    many = rest.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > REST).select("h")
    few = rest.join(many, "h", "left_anti").repartition("h").sortWithinPartitions("h")
    marks = marks.unionAll(few.mapInArrow(_sorted_groups(True), MARKS).select("cls", "start", "stop"))
    single = rest.join(many, "h", "left_semi").mapInArrow(_window_rows, "w binary, cls binary, start long")
    where = F.xxhash64("cls", "start")
    twice = single.groupBy("w").agg(F.min(where).alias("a"), F.max(where).alias("b")).where("a <> b").select("w")
    marks = marks.unionAll(single.join(twice, "w", "left_semi").select("cls", "start", (F.col("start") + SPAN).alias("stop")))
    by_class = marks.groupBy("cls").agg(F.collect_set(F.struct("start", "stop")).alias("marks"))
    cut = touched.select("cls", "text").join(by_class, "cls").mapInArrow(_cut, "cls binary, n_removed long, n_spans long, kept_sha256 string, edges array<long>")
    cut = checkpoint(cut.dropDuplicates(["cls"]))
    rows = d.select("doc_id", "cls", "sha", "n_bytes")
    copies = rows.groupBy("cls").agg(F.count("*").alias("copies")).where("copies > 1")
    j = rows.join(cut, "cls", "left").join(copies, "cls", "left")
    whole = F.col("copies").isNotNull() & (F.col("n_bytes") >= SPAN)
    zero = F.lit(0).cast("long")
    empty = hashlib.sha256(b"").hexdigest()
    return j.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(whole, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(whole, F.array(zero, F.col("n_bytes"))).otherwise(F.coalesce("edges", F.array().cast("array<long>"))).alias("edges"),
    )

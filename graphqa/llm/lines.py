"""Operator 8: fuzzy line deduplication by MinHash. DataFrame functions only."""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from random import Random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, connected_components, drop_written

#: Lines link at this Jaccard similarity of their sets of GRAM-character strings.
SIMILARITY, GRAM = 0.8, 5
#: Sets of sizes x and y are alike if UNDER times their common strings reach OVER times x + y.
OVER, UNDER = Fraction(str(SIMILARITY)).numerator, Fraction(str(SIMILARITY)).numerator + Fraction(str(SIMILARITY)).denominator
#: A signature has BANDS keys, each of ROWS minima: a pair of similarity 0.8 shares one with chance 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.998.
#: A row more costs nothing to sign and leaves fewer chance meetings.
BANDS, ROWS = 16, 5
#: Longs that hold 4 bits of each of 48 minima (those of 4 parts in 12 bands), and how many of these must agree before texts
#: are compared. Of a pair of similarity 0.8 some 39 do (about one in 2,000 has under AGREE), of one of 0.1 some 8.
SKETCH, AGREE = 3, 28
_SKETCH = [f"s{k}" for k in range(SKETCH)]
#: Masks that turn a hash of a string, rotated by TURN bits more for each, into BANDS orders.
_MASKS, TURN = [random.getrandbits(63) for random in [Random(8)] for _ in range(BANDS)], 4


def normal(text: Column) -> Column:
    """Lower case, white space runs within a line as one space."""
    odd = [F.contains(text, F.lit(x)) for x in ("  ", "\t", "\r", "\x0b", "\x0c")]
    return F.when(reduce(Column.__or__, odd), F.regexp_replace(text, r"[\s&&[^\n]]+", " ")).otherwise(text)


def _places(wide: Column) -> Column:
    """Where the strings of a line in UTF-32 begin; a line shorter than GRAM is one string."""
    return F.sequence(F.lit(0), F.greatest(F.floor(F.length(wide) / 4).cast("int") - GRAM, F.lit(0)))


def _gram(wide: Column, place: Column) -> Column:
    """The hash of the string that begins there: characters are four bytes each, so it's a slice."""
    return F.xxhash64(F.substring(wide, place * 4 + 1, F.lit(4 * GRAM)))


def _grams(line: Column) -> Column:
    """The set of a line's strings, as hashes."""
    wide = F.array(F.encode(line, "UTF-32"))  # an array of one binds it, so it's made once
    return F.array_distinct(F.flatten(F.transform(wide, lambda w: F.transform(_places(w), lambda i: _gram(w, i)))))


def _turned(h: Column, by: int) -> Column:
    """h rotated left by so many bits."""
    return F.shiftleft(h, by).bitwiseOR(F.shiftrightunsigned(h, 64 - by)) if by else h


def signatures(lines: DataFrame) -> DataFrame:
    """(alias, keys, s0..): the BANDS keys of each different line of lines (line_id, line), and 4 bits of each minimum.

    A string's hash puts it in one of ROWS parts of its line, by its last bits; a band's minima are those of each part under
    the band's order, so a string is hashed once and tried in BANDS orders only. The orders lead with different bits of the
    hash, as few strings of a short line are near any mask. A part without strings gives nothing, which lines can also
    have in common. Lines meet by alias, a 64-bit hash of line_id, copies within a task counted once before they are sent;
    minima and keys are then taken where the line is, without a further shuffle.
    """
    one = lines.groupBy(F.xxhash64("line_id").alias("alias")).agg(F.first("line").alias("line"))
    wide = one.select("alias", F.encode("line", "UTF-32").alias("wide"))
    each = wide.select("alias", "wide", F.explode(_places(F.col("wide"))).alias("i")).select("alias", _gram(F.col("wide"), F.col("i")).alias("h"))
    each = each.select("alias", F.shiftright(F.col("h").bitwiseAND(F.lit(0xFFFF).cast("long")) * ROWS, 16).cast("int").alias("part"), "h")
    least = each.groupBy("alias", "part").agg(*[F.min(_turned(F.col("h"), TURN * b).bitwiseXOR(F.lit(m))).alias(f"m{b}") for b, m in enumerate(_MASKS)])
    keys = [F.bit_xor(F.xxhash64(F.lit(b), "part", f"m{b}")).alias(f"k{b}") for b in range(BANDS)]
    bits = [F.call_function("shiftleft", F.col(f"m{b}").bitwiseAND(F.lit(15).cast("long")), 4 * (F.col("part") + 4 * (b % 4))) for b in range(4 * SKETCH)]
    sketch = [F.coalesce(F.bit_or(F.when(F.col("part") < 4, reduce(Column.bitwiseOR, bits[4 * k : 4 * k + 4]))), F.lit(0).cast("long")).alias(f"s{k}") for k in range(SKETCH)]
    return least.groupBy("alias").agg(*keys, *sketch).select("alias", F.array(*[f"k{b}" for b in range(BANDS)]).alias("keys"), *_SKETCH)


def buckets(signed: DataFrame) -> DataFrame:
    """(key, alias, n, leader, s0..): the lines of keys that n > 1 lines have.

    The leader is the line that shares most places in buckets with others, so the middle of a group of
    near copies leads in nearly all of the group's buckets. Keys are counted with a partial sum per
    task, and only then do the lines of shared keys meet their leader, in a join that Spark can
    split: a hot key is never in one task's hands.
    """
    keyed = signed.select("alias", F.explode("keys").alias("key"))
    shared = checkpoint(keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"))
    ranked = shared.join(shared.groupBy("alias").agg(F.sum("n").alias("met")), "alias")
    leaders = ranked.groupBy("key").agg(F.max(F.struct("met", "alias")).alias("first")).select("key", F.col("first.alias").alias("leader"))
    led = checkpoint(shared.join(leaders, "key").join(signed.drop("keys"), "alias").select("key", "alias", "n", "leader", *_SKETCH))
    drop_written(shared)
    return led


def _may_be_alike(a: str, b: str) -> Column:
    """Whether AGREE of the minima's bits in the sketches agree."""
    ones = F.lit(0x1111111111111111)
    differ = [F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")) for c in _SKETCH]
    marks = [reduce(Column.bitwiseOR, [F.shiftright(x, k) for k in range(4)]).bitwiseAND(ones) for x in differ]
    return reduce(Column.__add__, map(F.bit_count, marks)) <= 16 * SKETCH - AGREE


def _may_reach() -> Column:
    """Whether a and b can be alike, by what each lacks of their common leader's strings and has beyond them.

    Common are the leader's strings that neither lacks, and those beyond that both have: an equation,
    but for strings of the same short hash, so the texts decide. The sizes alone come first.
    """
    size = F.col("a.size") + F.col("b.size")
    lacks = F.greatest(*[F.col(f"{x}.top_size") - F.col(f"{x}.common") for x in "ab"])
    beyond = F.least(*[F.col(f"{x}.size") - F.col(f"{x}.common") for x in "ab"])
    most = F.least("a.size", "b.size", F.col("a.top_size") - lacks + beyond)
    common = lambda x: F.size(F.array_intersect(x, F.col("b.differ"))) + F.col("a.common") + F.col("b.common") - F.col("a.top_size")
    return (most * UNDER >= size * OVER) & F.exists(F.array("a.differ"), lambda x: common(x) * UNDER >= size * OVER)  # within a lambda, so the join's own code stays small


def _meet_first() -> Column:
    """Whether a and b share none of the keys before this one."""
    before = F.array_position("a.keys", F.col("a.key")).cast("int") - 1
    return ~F.arrays_overlap(F.slice("a.keys", F.lit(1), before), F.slice("b.keys", F.lit(1), before))


def _texts(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """(alias, line_id, line) of the lines in pairs."""
    ends = checkpoint(pairs.select(F.explode(F.array("a", "b")).alias("alias")).distinct())  # written, so that its size is known to the join
    own = lines.withColumn("alias", F.xxhash64("line_id")).join(ends, "alias", "left_semi")
    texts = checkpoint(own.groupBy("line_id", "alias").agg(F.first("line").alias("line")))
    drop_written(ends)
    return texts


def _short(strings: Column, mark: int) -> Column:
    """Hashes of strings, cut to 30 bits beside a mark."""
    return F.transform(strings, lambda h: h.bitwiseAND(F.lit((1 << 31) - 2).cast("long")).bitwiseOR(F.lit(mark).cast("long")).cast("int"))


def compared(pairs: DataFrame, lines: DataFrame, differences: bool = False) -> DataFrame:
    """(a, b, a_id, b_id, common, a_size, b_size, alike[, differ]) of pairs (a, b) of aliases, from the texts.

    The sizes are those of the sets of strings and of what they have in common; alike: their Jaccard
    similarity reaches SIMILARITY. differ: the strings that only b has and those that only a has, as short hashes.
    """
    pairs = checkpoint(pairs.distinct())
    own = _texts(pairs, lines)
    ends = [own.select(F.col("alias").alias(x), F.col("line_id").alias(f"{x}_id"), F.col("line").alias(f"{x}_line")) for x in "ab"]
    j = pairs.join(ends[0], "a").join(ends[1], "b").where("a_id <> b_id")
    sets = F.array(F.struct(_grams(F.col("a_line")).alias("x"), _grams(F.col("b_line")).alias("y")))  # bound once, used thrice
    more = (lambda s: [F.concat(_short(F.array_except(s["y"], s["x"]), 0), _short(F.array_except(s["x"], s["y"]), 1)).alias("differ")]) if differences else lambda s: []
    sizes = F.transform(sets, lambda s: F.struct(F.size(F.array_intersect(s["x"], s["y"])).alias("common"), F.size(s["x"]).alias("a_size"), F.size(s["y"]).alias("b_size"), *more(s)))
    found = j.select("a", "b", "a_id", "b_id", F.explode(sizes).alias("m")).select("a", "b", "a_id", "b_id", "m.*")
    found = checkpoint(found.withColumn("alike", F.col("common") * UNDER >= (F.col("a_size") + F.col("b_size")) * OVER))
    drop_written(own)
    drop_written(pairs)
    return found


def _apart(shared: DataFrame, signed: DataFrame, seen: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b): pairs of aliases in different components that may be alike and share a bucket, or were compared with the same leader.

    Lines that were compared with a leader meet once for that leader, and only if what they have in common with it
    lets them link. A line whose signature was too far from the leader's has no such record; it meets the others in
    each bucket that they share. One of a pair is always outside its leader's component.
    """
    rooted = shared.where("n > 2").join(known, "alias", "left").withColumn("root", F.coalesce("root", "alias"))
    main = rooted.where("alias = leader").select("key", F.col("root").alias("main"))
    rooted = rooted.where("alias <> leader").join(main, "key").join(seen.select(F.col("a").alias("alias"), F.col("b").alias("leader"), F.lit(True).alias("known")), ["alias", "leader"], "left")
    rooted = checkpoint(rooted.withColumn("known", F.coalesce("known", F.lit(False))))
    apart = (F.col("a.root") != F.col("b.root")) & ((F.col("b.root") == F.col("b.main")) | (F.col("a.alias") < F.col("b.alias"))) & _may_be_alike("a", "b")
    least, most = F.least("a.alias", "b.alias").alias("a"), F.greatest("a.alias", "b.alias").alias("b")

    each = rooted.where("known").drop("key", "n", "known").dropDuplicates(["leader", "alias"])
    each = each.join(each.where("root <> main").select("leader").distinct(), "leader", "left_semi")
    record = seen.select(F.col("a").alias("alias"), F.col("b").alias("leader"), "common", F.col("a_size").alias("size"), F.col("b_size").alias("top_size"), "differ")
    each = checkpoint(each.join(record, ["alias", "leader"]))
    by_leader = each.where("root <> main").alias("a").join(each.alias("b"), F.col("a.leader") == F.col("b.leader")).where(apart).where(_may_reach())

    keys = rooted.groupBy("key").agg(F.max(F.col("root") != F.col("main")).alias("out"), F.min("known").alias("all")).where("out and not all").select("key")
    rest = checkpoint(rooted.join(keys, "key", "left_semi").join(signed.select("alias", "keys"), "alias"))
    by_key = rest.where("root <> main").alias("a").join(rest.alias("b"), F.col("a.key") == F.col("b.key")).where("not (a.known and b.known)").where(apart).where(_meet_first())

    parts = [checkpoint(x.select(least, most)) for x in (by_leader, by_key)]
    for x in (rooted, each, rest):
        drop_written(x)
    return parts[0].unionAll(parts[1])


def components(lines: DataFrame) -> DataFrame:
    """(line_id, root) of the lines (line_id, line) that are linked with another one.

    All links with the lines that lead buckets give components. Only lines outside their leader's
    component are left: each is compared with those lines of other components that share its leader or
    a bucket, unless what both have in common with the leader rules a link out.
    So any two similar lines that share a bucket end in one component, without all pairs of a bucket.
    """
    signed = checkpoint(signatures(lines))
    shared = buckets(signed)
    led = shared.where("alias <> leader").alias("a").join(shared.where("alias = leader").alias("b"), F.col("a.key") == F.col("b.key")).where(_may_be_alike("a", "b"))
    seen = compared(led.select(F.col("a.alias").alias("a"), F.col("b.alias").alias("b")), lines, differences=True)
    links = seen.where("alike").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    found = checkpoint(connected_components(links).select(F.col("id").alias("line_id"), F.col("component").alias("root")))
    pairs = _apart(shared, signed, seen, found.select(F.xxhash64("line_id").alias("alias"), F.xxhash64("root").alias("root")))
    for x in (shared, signed, seen):
        drop_written(x)
    more = compared(pairs, lines)
    drop_written(pairs)
    more = more.where("alike").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    if more.isEmpty():
        return found
    root = lambda x: F.coalesce(f"{x}_root", x)
    both = more
    for x in "ab":
        both = both.join(found.select(F.col("line_id").alias(x), F.col("root").alias(f"{x}_root")), x, "left")
    joined = connected_components(both.select(root("a").alias("a"), root("b").alias("b")))
    ids = found.unionAll(more.select(F.explode(F.array("a", "b")).alias("line_id")).select("line_id", F.col("line_id").alias("root"))).groupBy("line_id").agg(F.min_by("root", F.when(F.col("root") == F.col("line_id"), 1).otherwise(0)).alias("root"))
    return ids.join(joined.select(F.col("id").alias("root"), "component"), "root", "left").select("line_id", F.coalesce("component", "root").alias("root"))


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, version, line_no, line_id, line) of the lines with a character that isn't white space.

    line is the normalised text, line_id its MD5, version a hash of the document's text.
    """
    d = docs.select("doc_id", "version", normal(F.lower("text")).alias("text"))
    x = d.select("doc_id", "version", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw")).select("doc_id", "version", "line_no", F.trim("raw").alias("line"))
    return x.where("line <> ''").select("doc_id", "version", "line_no", F.unhex(F.md5(F.col("line").cast("binary"))).alias("line_id"), "line")


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, version, removed): the numbers, from 0, of the lines of each document that repeat another line.

    Of each component of equal or similar lines the first by (doc_id, version, line_no) stays.
    """
    at = F.struct("doc_id", "version", "line_no")
    text = line_table(docs)  # not written: its texts are as large as the input
    every = checkpoint(text.select("doc_id", "version", "line_no", "line_id"))
    comp = components(text.select("line_id", "line"))
    first = every.groupBy("line_id").agg(F.min(at).alias("at"), F.count("*").alias("n"))
    rooted = checkpoint(first.join(comp, "line_id", "left").where("n > 1 or root is not null").select("line_id", "at", F.coalesce("root", "line_id").alias("root")))
    drop = rooted.join(rooted.groupBy("root").agg(F.min("at").alias("keep")), "root").select("line_id", "keep")
    gone = every.join(drop, "line_id").where(~at.eqNullSafe(F.col("keep")))
    return gone.groupBy("doc_id", "version").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_lines, n_removed, removed), one row per row of docs: text without repeated lines.

    Lines are cut at \\n and compared in lower case with white space evened out; lines of white space
    only stay. Two lines are alike if they are equal or if their sets of GRAM-character strings have a
    Jaccard similarity of SIMILARITY or more; a line shorter than GRAM is its own only string. Of a
    component of alike lines the first by (doc_id, version, line_no) stays. A null text has no lines
    and stays null; an empty one has one line. A null doc_id sorts first and is a document like
    others; rows with the same doc_id and text are one document and keep the same lines, rows with
    the same doc_id and different texts are documents of their own. An empty table gives no rows;
    other columns are not read. Lines are known by their MD5; a 64-bit alias only brings pairs
    together, which are then compared as texts.
    """
    text = F.col("text").cast("string")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("version"))
    gone = removed_lines(d).select(F.col("doc_id").alias("_d"), F.col("version").alias("_v"), "removed")
    j = d.join(gone, d["doc_id"].eqNullSafe(gone["_d"]) & (d["version"] == gone["_v"]), "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    lines = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("removed", i)), "\n")
    n_lines = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    return j.select("doc_id", F.when(F.size("removed") == 0, F.col("text")).otherwise(kept).alias("text"), n_lines.cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), "removed")

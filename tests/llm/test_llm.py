"""The training-data operators against brute force, on small tables with nulls, ties, empty and long texts."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from graphqa.llm import chat, decontaminate, htmltext, lines, mixing, quality, rangecoder, simhash, suffixes, tokenfile, toxicity
from graphqa.llm.common import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, copy string, key long"
WORDS = "the of and rain wind stone river lamp cloud green small house bread night train paper music water field glass".split()


def words(n, seed, vocabulary=None):
    r = random.Random(seed)
    return " ".join(r.choice(vocabulary or WORDS) + (str(r.randrange(50)) if r.random() < 0.5 else "") for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = [words(60, k) for k in range(12)]
    out = [(k, t, "en", f"s{k % 3}") for k, t in enumerate(base)]
    out += [(20, base[0], "en", "s0"), (21, base[1] + " tail", "en", None), (22, None, None, "s1"), (23, "", "en", "s1"), (24, " \n\t ", "de", "s2")]
    out += [(25, words(9000, 99), "en", "s0"), (26, "é" * 300 + "\n" + "é" * 300, "fr", "s1"), (27, "a\n\na", "en", "s2"), (27, "a\n\na", "en", "s2"), (None, words(30, 5), "en", "s0")]
    out += [(30, "x\0y" * 120, "en", "s2"), (31, (base[3] + "\n") * 2, "en", "s1"), (32, base[4][:210] + " | " + base[5][:260], "en", "s0")]
    return [(*r, len(r[1] or ""), 7, "clash", 1) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def sha(b):
    return hashlib.sha256(b).hexdigest()


# ---- 1 -------------------------------------------------------------------------------------


def test_chat(spark):
    t = [(1, 0, "system", "Be kind"), (1, 1, "ann", "Hi <|im_end|>"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, None, "?"), (1, 40, "ann", "bye"), (2, 0, "system", "alone"), (None, None, "eve", "é")]
    df = spark.createDataFrame(t, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as part", "'x' as speaker")
    got = {(r.conv_id, r.speaker, r.part): r for r in chat.rotate(df).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (None, "eve", 0)}
    ann = got[1, "ann", 0]
    assert ann.text.startswith("<|im_start|>system\nBe kind<|im_end|>\n<|im_start|>assistant\nHi <​|im_end|><|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>user\n?")
    assert ann.n_turns == 6 and [ann.text[m.start : m.end] for m in ann.mask] == ["Hi <​|im_end|><|im_end|>", "bye<|im_end|>"]
    assert [got[1, "bob", 0].text[m.start : m.end] for m in got[1, "bob", 0].mask] == ["<|im_end|>"] * 2
    assert chat.rotate(df.limit(0)).count() == 0


def test_chat_long_dialogues(spark, monkeypatch):
    """A dialogue of sparse turn numbers is whole; one beyond the bound comes in parts that start with the system turn."""
    rows = [(1, 100 * k, "ann" if k % 2 else "bob", f"a{k}" + " word" * 50) for k in range(70)] + [(1, -5, "system", "Be kind")]
    rows += [(2, k // 3, "system" if k == 0 else f"u{k % 3}", f"b{k:04d}") for k in range(500)] + [(None, k, "eve", f"c{k:04d}") for k in range(101)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    monkeypatch.setattr(chat, "MAX_TURNS", 100)
    got = {(r.conv_id, r.speaker, r.part): r for r in chat.rotate(df).collect()}
    assert got[1, "ann", 0].n_turns == 71 and got[1, "ann", 0].text.startswith("<|im_start|>system\nBe kind") and len(got[1, "ann", 0].mask) == 35
    assert sorted(k for k in got if k[0] == 2) == [(2, f"u{i}", p) for i in range(3) for p in range(5)]
    order = sorted((r for r in rows if r[0] == 2), key=lambda r: r[1:])
    for p in range(5):
        r, own = got[2, "u1", p], order[100 * p : 100 * p + 100]
        assert r.n_turns == 100 and re.findall(r"b\d{4}", r.text) == ["b0000"] * (p > 0) + [x[3] for x in own]
        assert [r.text[m.start : m.end] for m in r.mask] == [x[3] + "<|im_end|>" for x in own if x[2] == "u1"]
    assert [got[None, "eve", p].n_turns for p in (0, 1)] == [100, 1]
    assert "mapIn" not in chat.rotate(df)._jdf.queryExecution().toString()


# ---- 2 -------------------------------------------------------------------------------------


def test_decontamination(spark, docs, empty):
    vocabulary = [f"term{k}" for k in range(400)]
    items = [(k, words(20 + 3 * k, 1000 + k, vocabulary) + f". Answer is final{k} word{k} here{k} now{k} done{k}.") for k in range(8)]
    plant = [(100 + k, words(200, k) + " " + x.upper().replace(".", " ;") + " " + words(100, k + 50)) for k, x in items]
    x = items[3][1].split()
    plant.append((200, words(50, 3) + " " + " ".join(w for k, w in enumerate(x) if k % 8) + " " + words(90, 1)))  # 7 of 8 words
    plant.append((201, words(80, 8) + " " + " ".join(x[:8])))  # a part only
    plant.append((202, " ".join(w if k < len(x) - 6 and k % 3 else words(1, k) if k < len(x) - 6 else w for k, w in enumerate(x))))  # a paraphrase with the answer
    b = spark.createDataFrame([*items, (50, None), (51, ""), (None, "nothing here"), (0, items[0][1])], "item_id long, text string")
    all_docs = docs.select("doc_id", "text", "fp").unionByName(spark.createDataFrame(plant, "doc_id long, text string").selectExpr("*", "1L as fp"))
    got = {r.doc_id: r for r in decontaminate.contamination(all_docs, b).collect()}
    assert {d for d, r in got.items() if r.leaked} == {*range(100, 108), 200, 202}
    assert got[103].items == [3] and got[200].items == [3] and got[100].items == [0, 0]
    kept = decontaminate.drop_leaks(all_docs, b)
    assert kept.columns == all_docs.columns and kept.count() == all_docs.count() - 10
    assert decontaminate.contamination(empty, b).count() == 0 and decontaminate.contamination(docs, b.limit(0)).where("leaked").count() == 0


def test_items_outside_the_latent_space_are_found(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "RANK", 1)  # as 128 for a benchmark of very many items
    monkeypatch.setattr(decontaminate, "OVER", 1)
    vocabulary = [f"term{k}" for k in range(300)]
    items = [(k, words(4 + k % 13, 5000 + k, vocabulary)) for k in range(400)]
    docs = [(k, words(90, 9000 + k, vocabulary) + " " + items[k][1] + " " + words(90, 19000 + k, vocabulary)) for k in range(0, 400, 2)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r["items"] for r in decontaminate.contamination(d, b).collect()}
    assert [k for k, _ in docs if k not in got[k]] == []


def test_the_latent_space_is_asked_only_for_items_that_may_stand():
    """A document in which no item can stand isn't projected; where one can, only that item's passages are."""
    items = [(1, words(40, 3, [f"a{k}" for k in range(90)])), (2, words(30, 4, [f"b{k}" for k in range(90)]))]
    bench = decontaminate.Benchmark(items)
    bench.index(np.ones(len(bench.number)))
    assert decontaminate.find(bench, None, None, bench.encode(" ".join(items[0][1].split()[:5]) + " other words " * 60)) == []
    project = np.random.default_rng(1).standard_normal((len(bench.number), 8)).astype(np.float32)
    latent = decontaminate.directions(np.stack([project[p].sum(axis=0) for _, p in bench.passages]))
    latent[1][bench.owner == 1] = np.nan
    assert decontaminate.find(bench, project, latent, bench.encode("some words before " * 30 + items[0][1] + " and after" * 30)) == [(1, 1.0)]


def test_lcs():
    r = random.Random(1)
    for _ in range(50):
        a, b = [r.randrange(4) for _ in range(r.randrange(12))], [r.randrange(4) for _ in range(r.randrange(12))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.lcs(a, b) == t[-1][-1]


# ---- 3 -------------------------------------------------------------------------------------


def brute_stats(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    n = Counter(windows)
    inside = {k + j for k, x in enumerate(windows) if n[x] > 1 for j in range(8)}
    ls = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(ls) - len(set(ls)), len(inside)


def test_quality(docs, rows, empty):
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality_rules(docs).collect())
    want = []
    for r in rows:
        s = brute_stats(r[1])
        want.append((str(r[0]), *s, s[0] < 20 or 100 * s[4] > 30 * s[0]))
    assert got == sorted(want)
    assert quality.quality_rules(empty).count() == 0


def test_quality_thresholds_reject_junk_only(spark):
    clean = [(k, words(50 + k % 40, k), "en", f"s{k % 2}") for k in range(600)]
    junk = [(1000 + k, " ".join(w + "###" for w in words(60, k).split()), "en", "s0") for k in range(20)]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[k].kept for k in range(600)) and not any(got[1000 + k].kept for k in range(20))


def test_quality_each_metric_rejects(spark):
    clean = [(k, words(60 + k % 40, k), "en", "s0") for k in range(400)]
    start = words(12, 7)
    planted = {
        "word_len": "longestwordofall " + " ".join(w + "abcdefgh" for w in words(60, 1001).split()),
        "symbols": " ".join(w + ("#" if k % 8 == 0 else "") for k, w in enumerate(words(64, 1002).split())),
        "dup_lines": "\n".join([words(6, 1003 + k // 2 if k < 16 else 2000 + k) for k in range(20)]),
        "repeats": start + " " + words(60, 1004) + " " + start + " " + words(6, 1005),
    }
    rows = clean + [(1000 + k, t, "en", "s0") for k, t in enumerate(planted.values())]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[k].kept for k in range(400))
    for k, metric in enumerate(planted):
        assert not got[1000 + k].base_failed and metric in got[1000 + k].failed_rules.split(","), (metric, got[1000 + k])


def brute_limits(rows):
    """{(lang, source, metric): (low, high)} from whole lists of bucketed values, weights in millionths as in the sketches."""

    def bucket(v):
        e = max(v, 1).bit_length() - 1
        return v if v < 32 else 32 * (e - 4) + (v >> (e - 5)) - 32

    def value(b):
        e = b // 32 + 4
        return float(b) if b < 32 else (32 + b % 32) * 2.0 ** (e - 5) + 2.0 ** (e - 6)

    out = {}
    for m in quality.METRICS:
        every, langs, own = Counter(), {}, {}
        for lang, source, x in rows:
            b = bucket(x[m])
            every[b] += 1
            langs.setdefault(lang, Counter())[b] += 1
            own.setdefault((lang, source), Counter())[b] += 1
        for (lang, source), h in own.items():
            w = Counter({b: n * 10**6 for b, n in h.items()})
            for more in (langs[lang], every):
                for b, n in more.items():
                    w[b] += int(n * quality.PRIOR * 10**6 / sum(more.values()))
            total, q = sum(w.values()), {}
            for part in (10, 50, 90):
                seen = 0
                for b in sorted(w):
                    seen += w[b]
                    if seen * 100 >= total * part:
                        q[part] = value(b)
                        break
            floor = quality.FLOOR[m]
            out[lang, source, m] = (q[10] - quality.SPREAD * max(q[50] - q[10], floor), q[90] + quality.SPREAD * max(q[90] - q[50], floor))
    return out


def brute_kept(rows):
    """The verdict of each (text, lang, source)."""
    stats = []
    for text, lang, source in rows:
        n, chars, symbols, dup, rep = brute_stats(text)
        lines_ = len([x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
        metric = {"word_len": 1000 * chars // max(1, n), "symbols": 1000 * symbols // max(1, n), "dup_lines": 1000 * dup // max(1, lines_), "repeats": 1000 * rep // max(1, n)}
        stats.append((n < 20 or 100 * rep > 30 * n, lang, source, metric))
    limits = brute_limits([x[1:] for x in stats if not x[0]])
    return [not bad and all(limits[lang, source, m][0] <= x[m] <= limits[lang, source, m][1] for m in quality.METRICS) for bad, lang, source, x in stats]


def test_quality_verdicts_by_brute_force(spark):
    r = random.Random(3)
    rows = [(words(40 + r.randrange(60), k), r.choice(["en", "de", None]), r.choice(["a", "a", "a", "b", None])) for k in range(500)]
    rows += [(" ".join(w + "#" * r.randrange(3) for w in words(50, k).split()), "en", "a") for k in range(12)] + [(words(12, 7) + " " + words(60, k) + " " + words(12, 7), "de", "b") for k in range(6)]
    rows += [(None, "en", "a"), ("", "xx", "b"), rows[0]]
    df = spark.createDataFrame([(k % 400, *x) for k, x in enumerate(rows)], "doc_id long, text string, lang string, source string")
    want = brute_kept(rows)
    got = sorted((r.doc_id, r.kept) for r in quality.quality_rules(df).collect())
    assert got == sorted((k % 400, x) for k, x in enumerate(want)) and 0 < want.count(False) < 60
    kept = quality.keep_good(df.selectExpr("*", "'x' as _key", "1 as kept"))
    assert sorted(map(str, (tuple(r)[:4] for r in kept.collect()))) == sorted(str((k % 400, *x)) for k, x in enumerate(rows) if want[k])


def test_rows_with_one_id_are_judged_each(spark):
    good, bad = words(60, 1), "# " * 60
    df = spark.createDataFrame([(1, good), (1, bad), (None, words(60, 2)), (None, bad), (2, words(70, 3)), (2, words(70, 3))], "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source")
    assert sorted(str(r.doc_id) for r in quality.keep_good(df).collect()) == ["1", "2", "2", "None"]
    kept = simhash.keep_one(df)
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("1", good), ("1", bad), ("2", words(70, 3)), ("None", words(60, 2))])
    assert kept.columns == df.columns and simhash.keep_one(df.limit(0)).count() == 0 and quality.keep_good(df.limit(0)).count() == 0


# ---- 4 -------------------------------------------------------------------------------------


def brute_spans(texts):
    n = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if n[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        runs = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, sha(bytes(c for c, g in zip(t, gone, strict=True) if not g))))
    return out


def test_suffix_spans(docs, rows, empty):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.repeated_spans(docs).collect())
    texts = [(r[1] or "").encode() for r in rows]
    assert got == sorted((str(r[0]), *x) for r, x in zip(rows, brute_spans(texts), strict=True))
    assert suffixes.repeated_spans(empty).count() == 0


@pytest.mark.parametrize("hot,rest", [(3, 20_000), (3, 2)])
def test_suffix_spans_of_hot_groups(spark, monkeypatch, hot, rest):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "REST", rest)
    shared = words(60, 1)
    texts = [words(20, k) + shared[: 150 + 10 * k] + words(20, k + 99) + ("a" * 260 if k % 4 == 0 else "") for k in range(24)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.repeated_spans(df).collect())
    assert got == [(k, *x) for k, x in enumerate(brute_spans([t.encode() for t in texts]))]


def test_two_stage_order():
    r = random.Random(2)
    parts = [bytes(r.choice(b"\0ab") for _ in range(r.randrange(1, 90))) for _ in range(30)]
    data, ends = b"\0".join(parts) + b"\0", np.cumsum([len(p) + 1 for p in parts]) - 1
    order = suffixes.suffix_order(data, np.ones(len(data), bool), ends)
    assert sorted(order.tolist()) == list(range(len(data)))
    stops = {int(e) for e in ends}
    inner = [i for i in order.tolist() if i not in stops]
    text = lambda i: data[i : min(e for e in stops if e >= i)]
    assert [text(i) for i in inner] == sorted(text(i) for i in inner)


# ---- 5 -------------------------------------------------------------------------------------


def test_mixing(spark, empty):
    df = spark.range(4000).selectExpr("id as doc_id", "if(id < 3000, 'big', null) as source", "'t' as text", "9 as copy")
    got = mixing.mix(df, {"big": 1.0, None: 3.0}, total=8000).collect()
    n = Counter(r.source for r in got)
    assert abs(n["big"] - 2000) < 200 and abs(n[None] - 6000) < 300
    assert [r.shuffle_key for r in got] == sorted(r.shuffle_key for r in got)
    assert Counter((r.doc_id, r.copy) for r in got).most_common(1)[0][1] == 1
    assert mixing.mix(df, {"big": 1.0, None: 3.0}, total=8000).collect() == got
    assert mixing.mix(df, {"big": 1.0}).where("source is null").count() == 0
    assert mixing.mix(empty).count() == 0
    assert abs(sum(1 - c for c in mixing.poisson_table(3.5)) - 3.5) < 1e-6


# ---- 6 -------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(docs, rows, empty):
    f = [(r[0], brute_fingerprint(r[1])) for r in rows if r[0] is not None]
    comp = brute_components([(a, b) for a, x in f for b, y in f if (x ^ y).bit_count() <= 2], [a for a, _ in f])
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_groups(docs).where("doc_id is not null").collect()}
    assert got == {(a, f"{x:016x}", comp[a]) for a, x in f}
    assert simhash.simhash_groups(empty).count() == 0
    kept = simhash.keep_one(docs).collect()
    of_null = comp.get(next((a for a, x in f if x == brute_fingerprint(rows[-4][1])), None))  # the row without an id
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(comp.values())) and len(kept) == len(set(comp.values())) + (of_null is None)


@pytest.mark.parametrize("hot", [128, 2])
def test_simhash_links_are_whole(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_BUCKET", hot)
    r = random.Random(5)
    f = {r.getrandbits(64) for _ in range(30)}
    for x in list(f)[:20]:
        for _ in range(8):
            x ^= 1 << r.randrange(64)
            f.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in f]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {x.id: x.component for x in connected_components(simhash.links(df)).collect()}
    pairs = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    want = brute_components(pairs, signed)
    assert got == {i: c for i, c in want.items() if i in got} and {i for p in pairs for i in p} == set(got)


# ---- 7 -------------------------------------------------------------------------------------


def test_range_coder():
    r = np.random.default_rng(3)
    blocks = [np.minimum(r.geometric(0.05, n), 40000).astype(np.uint32) for n in (1, 7, 1000, 2500, 64)] + [np.full(500, 7, np.uint32), np.array([1 << 31, 5, 1 << 31], np.uint32), np.zeros(0, np.uint32)]
    coded = rangecoder.encode(blocks)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, rangecoder.decode(coded), strict=True))
    assert (rangecoder.decode([coded[3]])[0] == blocks[3]).all() and len(coded[5]) < 120
    zipf = (r.zipf(1.3, 200_000) % 30_000).astype(np.uint32)
    pieces = [zipf[k : k + 2048] for k in range(0, len(zipf), 2048)]
    bits = 8 * sum(map(len, rangecoder.encode(pieces))) / len(zipf)
    assert bits < 8.6, bits  # of 15 for plain ids; 10 bits of a slot alone would be more
    with pytest.raises(ValueError):
        rangecoder.decode([coded[2][:40] + b"?" + coded[2][41:]])


def test_coder_on_the_jvm_gives_the_same_bytes(spark):
    tokenfile.register_coder(spark)
    r = np.random.default_rng(5)
    blocks = [(r.zipf(1.2, n) % 49_000).astype(np.uint32) for n in (0, 1, 3, 129, 4096, 700)]
    blocks += [r.integers(0, 1 << 32, n, dtype=np.uint32) for n in (2, 900)] + [np.zeros(3000, np.uint32), np.tile(np.arange(300, dtype=np.uint32), 9)]
    df = spark.createDataFrame([(k, bytearray(b.astype("<u4").tobytes())) for k, b in enumerate(blocks)], "k int, ids binary").union(spark.createDataFrame([(99, None)], "k int, ids binary"))
    got = df.selectExpr("k", "graphqa_encode(ids) as coded", "graphqa_decode(graphqa_encode(ids)) as ids").orderBy("k").collect()
    assert [bytes(x.coded) for x in got[:-1]] == rangecoder.encode(blocks) and got[-1].coded is None
    assert [bytes(x.ids) for x in got[:-1]] == [b.astype("<u4").tobytes() for b in blocks]
    torn = bytearray(got[4].coded)
    torn[40] ^= 1
    for bad in (torn, got[4].coded[:-2], bytearray(b"GQR3")):
        with pytest.raises(Exception, match="damaged block"):
            spark.createDataFrame([(bad,)], "coded binary").selectExpr("graphqa_decode(coded)").collect()


def test_words_of_plain_letters_go_to_the_model_as_they_are():
    pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    encoder, r = tokenfile.Encoder(public.path("word_bpe_49k.json")), random.Random(2)
    texts = ["".join(map(chr, range(0x21, 0x7F))), "don't they're 'tis x'd''s 12'3", "é'sñ übers«"] + ["".join(r.choice("abcdeft'rs.,!_~^ 019é\n") for _ in range(200)) for _ in range(100)]
    for x in texts:
        assert encoder(x).tolist() == encoder.tk.encode(x, add_special_tokens=False).ids
    encoder.words.clear()
    encoder.words.level = None
    assert encoder("plain words, 2 of them").tolist() == encoder.tk.encode("plain words, 2 of them", add_special_tokens=False).ids


def test_token_file(spark, docs, rows, empty, tmp_path, monkeypatch):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(tokenfile, "MAX_BLOCK", 4096)
    where = public.path("word_bpe_49k.json")
    tk, at, want = tokenizers.Tokenizer.from_file(where), 0, []
    more = spark.createDataFrame([(40, "It's A <|endoftext|> TEST, don't²½ İstanbul   x")], "doc_id long, text string")
    df = docs.select("doc_id", "text", "copy").unionByName(more.selectExpr("*", "'c' as copy"))
    for d, t in sorted([(r[0], r[1]) for r in rows] + [(40, more.first().text)], key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    tokenfile.write_ids(df, str(tmp_path / "f"), where)
    assert sorted(map(str, map(tuple, tokenfile.digests(spark, str(tmp_path / "f")).collect()))) == sorted(map(str, want))
    ids = {(r.doc_id, r.part, r.doc_start): r.ids for r in tokenfile.read_pieces(spark, str(tmp_path / "f"), True).where("doc_id = 40").collect()}
    assert [*ids.values()][0][-1] == 2
    tokenfile.write_ids(empty, str(tmp_path / "e"), where)
    assert tokenfile.digests(spark, str(tmp_path / "e")).count() == 0


# ---- 8 -------------------------------------------------------------------------------------


def grams(s):
    return {s[k : k + 5] for k in range(len(s) - 4)} or {s}


def brute_removed(texts):
    """{doc: numbers of removed lines} by all pairs of lines; documents in order."""
    flat = [(d, n, y) for d, t in enumerate(texts) if t is not None for n, x in enumerate(t.split("\n")) if (y := " ".join(x.lower().split()))]
    g = [grams(x[2]) for x in flat]
    comp = brute_components([(i, j) for i in range(len(flat)) for j in range(i) if 5 * len(g[i] & g[j]) >= 4 * len(g[i] | g[j])], range(len(flat)))
    out = {}
    for i, (d, n, _) in enumerate(flat):
        if comp[i] != i:
            out.setdefault(d, []).append(n)
    return out


def test_fuzzy_lines(spark, empty):
    r, base = random.Random(7), [words(30, 300 + k) for k in range(40)]
    made = []
    for k in range(160):
        line = base[k % 40]
        if k >= 40:
            at = r.randrange(len(line))
            line = line[:at] + r.choice("xyz") + line[at + 1 :]
        made.append(line)
    texts = ["\n".join(made[k : k + 4]) for k in range(0, 160, 4)] + ["short\nshort\n\n \n}", "", None, "  " + base[0].upper() + " ", "}\né"]
    df = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)], "doc_id long, text string, removed string").repartition(3)
    got = {x.doc_id: x for x in lines.dedup_lines(df).collect()}
    assert {d: x.removed for d, x in got.items() if x.removed} == brute_removed(texts)
    assert got[0].text == texts[0] and got[40].text == "short\n\n \n}" and got[42].text is None and got[43].text == "" and got[44].text == "é"
    assert lines.dedup_lines(empty).count() == 0
    assert "mapIn" not in lines.dedup_lines(df)._jdf.queryExecution().toString()


def test_fuzzy_lines_of_null_and_repeated_ids(spark):
    rows = [(None, "the same line here"), (5, "own line of five\nThe  same line here"), (5, "another text with that id\nown line of five"), (5, "another text with that id\nown line of five"), (6, "x" * 200_000 + "\n" + "y" * 200_000), (7, "Y" * 200_000)]
    got = sorted((str(x.doc_id), x.text[:30], x.removed) for x in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    kept_first = [x for x in got if x[0] == "5"]
    assert got[-1] == ("None", "the same line here", []) and ("6", "x" * 30, []) in got and ("7", "", [0]) in got
    assert sum(len(x[2]) for x in kept_first if "own line" in x[1]) + sum(1 in x[2] for x in kept_first) >= 2 and all("here" not in x[1] for x in kept_first)


def test_fuzzy_lines_of_crowded_buckets(spark):
    """Lines that share an opening, each with a near copy, and a crowd of near copies of one line."""
    r = random.Random(11)
    opening = words(20, 1)
    own = [opening + " " + words(6, 700 + k) for k in range(150)]
    crowd = [(x[:at] + r.choice("0123456789") + x[at + 2 :]) for x in [words(25, 5)] for at in [r.randrange(len(x) - 2) for _ in range(150)]]
    texts = own + [x[:-3] + "#" + x[-2:] for x in own] + crowd
    r.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.removed for x in lines.dedup_lines(df).collect() if x.removed}
    assert got == brute_removed(texts)


def test_a_crowd_is_compared_with_its_middle(spark, monkeypatch):
    """Near copies of one line, some of them so far from it that they link with few others: all links, with few pairs compared."""
    r, middle = random.Random(21), words(60, 5).split()
    texts = []
    for k in range(300):
        edits = r.sample(range(len(middle)), 1 + k % 3 if k % 12 else 14)
        texts.append(" ".join(r.choice(WORDS) + str(k) if at in edits else x for at, x in enumerate(middle)))
    counts, own = [], lines._texts
    monkeypatch.setattr(lines, "_texts", lambda pairs, of: counts.append(pairs.count()) or own(pairs, of))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.removed for x in lines.dedup_lines(df).collect() if x.removed}
    assert got == brute_removed(texts) and 200 < len(got) < 299
    assert sum(counts) < 6000, counts  # of 44,850 pairs


def test_far_near_copies_are_ruled_out_by_what_they_lack(spark, monkeypatch):
    """Near copies with changes at places of their own, too many to link: hardly a text is compared, and all links are found."""
    r, middle = random.Random(31), words(60, 8).split()
    texts = []
    for k in range(240):
        edits = r.sample(range(len(middle)), 2 if k % 4 else 8)
        texts.append(" ".join(r.choice(WORDS) if at in edits else x for at, x in enumerate(middle)))
    counts, own = [], lines._texts
    monkeypatch.setattr(lines, "_texts", lambda pairs, of: counts.append(pairs.count()) or own(pairs, of))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.removed for x in lines.dedup_lines(df).collect() if x.removed}
    assert got == brute_removed(texts)
    assert len(counts) == 2 and counts[1] < 300, counts


def near_pairs(n, n_words, changes, seed, opening="", vocabulary=None):
    """Pairs of lines that differ by so many characters and reach the similarity."""
    r, out = random.Random(seed), []
    made = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(4, 16)))
    while len(out) < n:
        a = opening + " ".join(made() for _ in range(n_words))
        b = list(a)
        for _ in range(changes):
            b[r.randrange(len(opening), len(a))] = r.choice("0123456789")
        x, y = grams(a), grams("".join(b))
        if len(x & y) >= 0.8 * len(x | y):
            out.append((a, "".join(b)))
    return out


@pytest.mark.parametrize("n_words,changes,opening", [(4, 1, 0), (20, 2, 0), (20, 3, 0), (20, 4, 0), (12, 4, 20)])
def test_pairs_at_the_similarity_are_found(spark, n_words, changes, opening):
    made = near_pairs(400, n_words, changes, 5, words(opening, 9) + " " if opening else "")
    df = spark.createDataFrame([(f"{2 * k + e:06d}", x) for k, p in enumerate(made) for e, x in enumerate(p)], "line_id string, line string")
    root = {r.line_id: r.root for r in lines.components(df.selectExpr("cast(line_id as binary) line_id", "line")).collect()}
    assert sum(root.get(f"{2 * k:06d}".encode(), 1) == root.get(f"{2 * k + 1:06d}".encode(), 2) for k in range(400)) >= 0.985 * 400


def test_signing_hashes_a_string_once(spark):
    """A string is hashed once and tried in one order for each band; copies of a line give one signature, and lines are sent once."""
    df = spark.createDataFrame([(b"1", words(30, 1)), (b"1", words(30, 1)), (b"2", "ab"), (b"3", words(5, 2))], "line_id binary, line string").repartition(3)
    signed = lines.signatures(df)
    plan = signed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("min(") == lines.BANDS and plan.count("substring(") == 1
    assert signed._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = signed.collect()
    assert len(got) == len({r.alias for r in got}) == 3 and all(len(set(r["keys"])) == lines.BANDS for r in got)


# ---- 9 -------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no";</script></head><body>
<div class="cookie-notice">We use cookies</div><header>Site name</header><nav><ul><li><a href=x>Home</a></ul></nav><div id="wrap"><div class="post-{k}">
<h1>Title&nbsp;{k} &amp; more</h1><p>First <b>bold</b>
 line &lt;{k}&gt;<br>goes on<p>Second<!-- <p>hidden</p> --> paragraph {long}<ul><li>One<li>Two <a href=y>linked</a> item</ul>
<form><p>Search</p></form><div class="ad-box"><p>Buy</p></div><table><tr><td>Cell</td></tr></table></div>
<aside><p>Side</p></aside><section id="comments"><p>Reader says {long}</p></section></div><footer><p>Imprint</p></footer></body></html>"""


def test_main_text(spark, empty):
    pages = [(k, f"http://Host.example/{k}", PAGE.format(k=k, long="word " * 30)) for k in range(4)]
    pages += [(10, "http://host.example/x", "<p>Only this"), (11, None, None), (12, "", ""), (13, "http://b.example", "<html><body><article><p>A</p>b</article><p>c"), (13, "http://b.example", "plain &copy; text")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'h' as host", "1 as n")
    got = sorted(htmltext.main_text(df).collect(), key=lambda r: (r.page_id, r.n_chars))
    for k in range(4):
        assert got[k].text == f"Title {k} & more\nFirst bold line <{k}> goes on\nSecond paragraph " + ("word " * 30).strip() + "\nOne\nTwo linked item\nCell"
        assert got[k].by_consensus and got[k].n_chars == len(got[k].text)
    assert got[4].text == "Only this" and got[5].text == "" and got[6].text == ""
    assert sorted(r.text for r in got[7:]) == ["A\nb", "plain © text"]
    assert htmltext.main_text(df.limit(0)).count() == 0


def test_main_text_of_uneven_sections():
    page = htmltext.Page
    lead, body = "lead words " * 20, "body words " * 200
    html = f"<body><div class=top><a href=x>Home page link</a></div><div class='wrap'><h2>Title</h2><div class='lead'>{lead}</div><div><div class='story'><p>{body}<span class=notice>marked</span> end</p></div></div></div><div class=links><a href=y>more and more links</a></div></body>"
    p = page(html)
    assert p.inside({p.best()}) == f"Title\n{lead.strip()}\n{body}marked end"
    p = page(f"<body><div id=a><div class=story><p>{body}</div><div class=teasers><a href=z>{lead}</a></div></div></body>")
    assert p.inside({p.best()}) == body.strip()
    p = page(f"<article><p>{body}<i style='display: none'>no</i></p></article><p>{lead}</p>" + "<div>" * 3000 + "deep")
    assert p.inside({p.best()}) == body.strip()


# ---- 10 ------------------------------------------------------------------------------------


def test_toxicity(spark, empty):
    bad = "blorg snaffing grumbex vilothing yuckster".split()
    made = []
    for k in range(900):
        t = words(40, k)
        if k % 6 == 0:
            r = random.Random(k)
            w = t.split()
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(bad))
            t = " ".join(w)
        made.append((k, t, int(k % 6 == 0)))
    d = spark.createDataFrame([(k, t, "c") for k, t, _ in made] + [(5000, None, "c"), (5001, "", "c"), (None, made[0][1], "c")], "doc_id long, text string, score string")
    y = spark.createDataFrame([(k, v) for k, _, v in made] + [(0, 1), (9999, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(d, y).collect()}
    held = [k for k, _, _ in made if toxicity.crc_of(k) % 3 == 1]
    assert all(got[k].held_out == (k in set(held)) for k, _, _ in made) and not got[None].held_out
    right = sum(got[k].predicted == made[k][2] for k in held)
    assert right >= 0.97 * len(held), (right, len(held))
    assert 0 <= got[5000].score <= 1 and got[5000].score == got[5001].score and got[5000].predicted == 0
    assert toxicity.score_toxicity(empty, y).count() == 0 and toxicity.score_toxicity(d, y.limit(0)).where("predicted = 1").count() == 0


def test_nearest_is_exact():
    r = random.Random(4)
    terms = [(f"w{k}", r.randrange(1, 60)) for k in range(40)]
    texts = [" ".join(r.choice(terms)[0] for _ in range(r.randrange(1, 9))) for _ in range(400)]
    ix = toxicity.build_index(terms, 400, [(k, k % 2, t) for k, t in enumerate(texts)])
    dense = np.zeros((len(ix.ids), len(terms)))
    for i, d in enumerate(ix.ids):
        at, v = ix.vector(texts[d])
        dense[i, at] = v
    for q in texts[:60]:
        at, v = ix.vector(q)
        full = np.zeros(len(terms))
        full[at] = v
        n, c = ix.nearest(at, v)
        assert np.allclose(np.sort(dense @ full)[::-1][: len(c)], c)


def test_components(spark):
    r = random.Random(8)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)]
    got = {x.id: x.component for x in connected_components(spark.createDataFrame(pairs + [(None, 3)], "a long, b long")).collect()}
    want = brute_components(pairs, {x for p in pairs for x in p})
    assert got == {i: c for i, c in want.items() if i in got} and all(a == b for a, b in pairs if a not in got)

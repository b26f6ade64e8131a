"""Each stage and the whole pipeline on a small corpus."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import pytest

import corpus_pipeline

public_tokenizers, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")

WORDS = [f"{a}{b}" for a in "rain wind stone river lamp cloud green house bread night".split() for b in "ing er ly ness ful some".split()]


def text(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    item = text(30, 777)
    docs = [(k, text(80, k), "en", f"s{k % 2}") for k in range(60)]
    docs += [(60, docs[0][1], "en", "s0"), (61, text(5, 1), "en", "s1"), (62, text(40, 61) + " " + item + " " + text(40, 62), "en", "s0"), (63, None, "en", "s1")]
    spark.createDataFrame([(*x, len(x[1] or "")) for x in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, gone = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == columns
        gone.append(before - {r.doc_id for r in docs.collect()})
    assert gone[0] == {61, 63} and gone[1] == {60} and gone[2] == {62}


def brute_run(docs, item):
    """(doc_id, start, n_tokens, ids_crc32) of the whole pipeline, one document after the other."""
    from test_llm import brute_components, brute_fingerprint, brute_kept

    docs = [d for d, good in zip(docs, brute_kept([d[1:4] for d in docs]), strict=True) if good]
    prints = {d[0]: brute_fingerprint(d[1]) for d in docs}
    comp = brute_components([(a, b) for a, x in prints.items() for b, y in prints.items() if (x ^ y).bit_count() <= 2], list(prints))
    docs = [d for d in docs if comp[d[0]] == d[0] and item not in d[1]]
    n = Counter(d[3] for d in docs)
    tk = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out, at = [], 0
    for d in sorted(docs):
        rate = n[d[3]] ** 0.5 / sum(x**0.5 for x in n.values()) * len(docs) / n[d[3]]
        u, k, below = int(hashlib.md5(f"17:{d[0]}".encode()).hexdigest()[:12], 16) / 2**48, 0, math.exp(-rate)
        while below <= u:
            k += 1
            below += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        ids = struct.pack(f"<{len(x := [*tk.encode(d[1], add_special_tokens=False).ids, 2])}I", *x)
        for _ in range(k):
            out.append((d[0], at, len(x), zlib.crc32(ids)))
            at += len(x)
    return out


def test_run(spark, folder):
    docs = [tuple(r)[:4] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    got = [tuple(r) for r in corpus_pipeline.run(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()]
    assert got == brute_run(docs, item) and len({r[0] for r in got}) < len(got)


def test_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_without_and_with_one_id(spark, folder):
    """Rows of one doc_id, or none, go through each stage by themselves; other columns, with clashing names, do no harm."""
    docs = spark.createDataFrame([(1, text(60, 1)), (1, text(4, 2)), (None, text(60, 3)), (None, text(4, 4)), (2, text(60, 5)), (2, text(60, 5))], "doc_id long, text string")
    docs = docs.selectExpr("*", "'en' as lang", "'s' as source", "1L as n_chars", "0 as kept", "'x' as fp", "'y' as items", "'z' as own")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((str(r.doc_id), r.text) for r in docs.collect()) == sorted([("1", text(60, 1)), ("None", text(60, 3)), ("2", text(60, 5))])

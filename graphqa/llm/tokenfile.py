"""Operator 7: token ids of all documents in range-coded blocks, written and read back."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

END_ID = 2
#: A block closes at BLOCK ids; a document that would take it beyond MAX_BLOCK starts or is cut into blocks of its own.
BLOCK, MAX_BLOCK = 2048, 4096
#: Blocks handed on at once.
BATCH = 64
#: Words whose ids a worker remembers.
CACHE = 300_000
FILE = "part int, block int, ids_before long, n_ids int, doc_ids array<long>, doc_starts array<long>, doc_lens array<long>, payload binary"
PIECES = "part int, doc_start long, at long, doc_id long, n long, crc long"

# Texts in these characters only are cut into words here; all others go through the library whole.
_ODD = re.compile(r"[^\x20-\x7e\n¡¿À-ÖØ-öø-į]")
# The tokenizer's own pattern for words, restricted to those characters in lower case.
# Letters come first, as most words are; no other branch begins with one.
_WORD = re.compile(r"[a-zß-öø-į]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\s0-9a-zß-öø-į]+")
# The normalizer and pre-tokenizer for which the above holds.
_NORMAL = r"""Sequence(normalizers=[NFC(), Replace(pattern=Regex("\s+"), content=" "), Lowercase()])"""

_CUTS = r"""Sequence(pretokenizers=[Split(pattern=Regex("'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), behavior=Removed, invert=True), ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])"""


class _Words(dict):
    """Ids by word, as bytes."""

    def __init__(self, tk):
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.model, self.level = tk.model, ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        level = word if word.isascii() else self.level.pre_tokenize_str(word)[0][0]  # printable ASCII stands for itself
        ids = self[word] = array("I", [t.id for t in self.model.tokenize(level)]).tobytes()
        return ids


class Encoder:
    """Ids as Tokenizer.encode(text, add_special_tokens=False) gives them; common words are remembered."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        self.words = _Words(self.tk) if str(self.tk.normalizer) == _NORMAL and str(self.tk.pre_tokenizer) == _CUTS else None

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self.words is None or "<|" in text or _ODD.search(text):
            return np.array(self.tk.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.frombuffer(b"".join(map(self.words.__getitem__, _WORD.findall(text.lower()))), np.uint32)


_coders: dict[str, tuple] = {}


def register_coder(spark: SparkSession) -> None:
    """Have the session's functions graphqa_encode (ids as bytes to a block) and graphqa_decode.

    RangeCoder.java is rangecoder.py on the JVM, to the same bytes. Janino, with which Spark compiles its plans, compiles
    it on the driver, once for an application, and executors get it as a jar; no other compiler is needed.
    """
    sc = spark.sparkContext
    jvm = sc._jvm
    if sc.applicationId not in _coders:
        made = jvm.org.codehaus.janino.SimpleCompiler()
        made.cook(Path(__file__).with_name("RangeCoder.java").read_text())
        jar, classes = Path(tempfile.mkdtemp(prefix="graphqa-ship-"), "graphqa-rangecoder.jar"), made.getBytecodes()
        with zipfile.ZipFile(jar, "w") as z:
            for name in classes:
                z.writestr(name.replace(".", "/") + ".class", bytes(classes[name]))
        _coders[sc.applicationId] = jar, made.getClassLoader()
    jar, loader = _coders[sc.applicationId]
    spark.sql(f"ADD JAR '{jar}'")
    for name, of in (("graphqa_encode", "RangeCoder"), ("graphqa_decode", "RangeCoder$Decoder")):
        nothing = [sc._gateway.new_array(t, 0) for t in (jvm.Class, jvm.Object)]
        coder = loader.loadClass(of).getDeclaredConstructor(nothing[0]).newInstance(nothing[1])
        spark._jsparkSession.udf().register(name, coder, jvm.org.apache.spark.sql.types.DataTypes.BinaryType)


class _Packer:
    """Documents in order to blocks, their ids as bytes."""

    def __init__(self, part: int):
        self.part, self.block, self.total = part, 0, 0
        self.clear()

    def clear(self) -> None:
        self.ids, self.docs, self.starts, self.lens, self.n = [], [], [], [], 0

    def close(self) -> Iterator[tuple]:
        if self.n:
            yield (self.part, self.block, self.total - self.n, self.n, self.docs, self.starts, self.lens, np.concatenate(self.ids).astype("<u4").tobytes())
            self.block += 1
            self.clear()

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        start = self.total
        if self.n and self.n + len(ids) > MAX_BLOCK:
            yield from self.close()
        for k in range(0, len(ids), MAX_BLOCK):
            piece = ids[k : k + MAX_BLOCK]
            self.ids.append(piece)
            self.docs.append(doc_id)
            self.starts.append(start)
            self.lens.append(len(piece))
            self.n += len(piece)
            self.total += len(piece)
            if self.n >= BLOCK:
                yield from self.close()


def _writer(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pack = Encoder.of(path), _Packer(TaskContext.get().partitionId())
        waiting: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            cols = [pa.array(list(c), t) for c, t in zip(zip(*waiting, strict=True), types, strict=True)]
            waiting.clear()
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in FILE.split(", ")])

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                waiting.extend(pack.add(doc_id, np.append(encoder(text), np.uint32(end_id))))
                if len(waiting) >= BATCH:
                    yield from flush()
        waiting.extend(pack.close())
        if waiting:
            yield from flush()

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Write the ids of docs (doc_id, text) in ascending doc_id order as a file of coded blocks.

    tokenizer: the path of a tokenizer file. Rows are range-partitioned by doc_id; partition k is
    part k of the file. Null and empty texts give just the end id; a null doc_id comes first;
    repeated doc_ids follow each other, ordered by text; an empty table gives an empty file; other columns are not
    written. The files are committed by Spark's writer, so a lost executor's part is written anew.
    """
    small_batches(docs.sparkSession)
    register_coder(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    d = d.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    blocks = d.mapInArrow(_writer(tokenizer, end_id), FILE).withColumn("payload", F.call_function("graphqa_encode", "payload"))
    blocks.write.option("compression", "none").parquet(path)


def _reader(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), *[pa.int64()] * 5] + [pa.list_(pa.int64())] * with_ids
        names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids
        for b in batches:
            rows: list[tuple] = []
            for x in b.to_pylist():
                ids, at = memoryview(x["payload"]), 0
                if len(ids) != 4 * x["n_ids"]:
                    raise ValueError("a block's length is wrong")
                for doc, start, n in zip(x["doc_ids"], x["doc_starts"], x["doc_lens"], strict=True):
                    piece = ids[4 * at : 4 * (at + n)]
                    rows.append((x["part"], start, x["ids_before"] + at, doc, n, zlib.crc32(piece)) + ((np.frombuffer(piece, "<u4"),) if with_ids else ()))
                    at += n
            for k in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows[k : k + 4096], strict=True), types, strict=True)], names=names)

    return run


def read_pieces(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(part, doc_start, at, doc_id, n, crc[, ids]) of the pieces of documents in a file; checks each block's checksum."""
    small_batches(spark)
    register_coder(spark)
    blocks = spark.read.schema(FILE).parquet(path).withColumn("payload", F.call_function("graphqa_decode", "payload"))
    return blocks.mapInArrow(_reader(with_ids), PIECES + (", ids array<long>" if with_ids else ""))


def _times(a: int, b: int) -> int:
    """a * b modulo the CRC-32 polynomial, bits reflected."""
    out = 0
    for k in range(31, -1, -1):
        if b >> k & 1:
            out ^= a
        a = a >> 1 ^ (0xEDB88320 if a & 1 else 0)
    return out


_POWERS = [1 << 30]  # x, x^2, x^4, ...


def join_crc(first: int, second: int, n: int) -> int:
    """The CRC-32 of two byte strings put together, from each one's and the second's length."""
    shift, k, n = 1 << 31, 0, 8 * n
    while n >> k:
        while len(_POWERS) <= k:
            _POWERS.append(_times(_POWERS[-1], _POWERS[-1]))
        if n >> k & 1:
            shift = _times(shift, _POWERS[k])
        k += 1
    return _times(first, shift) ^ second


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        crcs = []
        for pieces in b.column("pieces").to_pylist():
            crc = pieces[0]["crc"]
            for p in pieces[1:]:
                crc = join_crc(crc, p["crc"], 4 * p["n"])
            crcs.append(crc)
        yield pa.RecordBatch.from_arrays([b.column(k) for k in ("part", "doc_start", "doc_id", "n_tokens")] + [pa.array(crcs, pa.int64())], names=["part", "doc_start", "doc_id", "n_tokens", "ids_crc32"])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone.

    Only a document's own pieces are gathered, as lengths and checksums that combine.
    """
    pieces = read_pieces(spark, path)
    own = pieces.groupBy("part", "doc_start", "doc_id").agg(F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("at", "n", "crc"))).alias("pieces"))
    own = own.mapInArrow(_joined, "part int, doc_start long, doc_id long, n_tokens long, ids_crc32 long")
    last = spark.read.schema(FILE).parquet(path).groupBy("part").agg(F.max(F.col("ids_before") + F.col("n_ids")).alias("n"))
    before = last.agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("parts")).select(F.explode(F.expr("transform(parts, (p, i) -> struct(p.part as part, aggregate(slice(parts, 1, i), 0L, (a, x) -> a + x.n) as before))")).alias("x")).select("x.*")
    return own.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("doc_start")).alias("start"), "n_tokens", "ids_crc32")

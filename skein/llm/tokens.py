"""Token ids on disk: fixed-width bit packing in blocks.

Format (`skein-ids-1`), a folder of two tables that Spark writes atomically:

* `blocks`: shard, block (from 0 in each shard), first (ids of the shard before it), bits, n_ids, payload (n_ids values of
  `bits` bits, least significant bit first, the last byte filled with zeros), doc_ids and lengths of the documents that
  begin in the block, and spill: the ids at its start that continue a document of the block before.
* `index`: shard, n_ids, start (ids of all shards before).

A block holds BLOCK_IDS ids but the last of a shard, so an id's block is a division away, and numpy unpacks a block at
once. Shards are ranges of the document key in ascending order.

Defined results: a null text counts as empty; every document ends with the end id, so an empty one has that id alone;
rows with a null key come first; repeated keys stay, ordered by their text; an empty table gives empty tables; further
columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import compress, islice
from operator import not_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import parts, python_batches, range_bucket, scratch, staged

BLOCK_IDS = 1 << 16
#: Words whose ids a worker keeps, and how many of them when they are too many.
CACHE, KEEP = 1_000_000, 300_000
#: Where a text may not be cut before single spaces and line ends: their pieces depend on their neighbours.
_RUNS = ("  ", " \n", "\n ", "\n\n\n")
BLOCKS = "shard long, block long, first long, bits int, n_ids int, payload binary, doc_ids array<long>, lengths array<long>, spill int"


def width(vocabulary: int) -> int:
    """The least number of bits that holds every id."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids[:, None].astype(np.uint64) >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, n: int, start: int = 0) -> np.ndarray:
    """n ids from the start-th of a block on."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", n, start * bits // 8).astype(np.uint32)
    low = start * bits // 8
    raw = np.unpackbits(np.frombuffer(payload, np.uint8)[low : ((start + n) * bits + 7) // 8], bitorder="little")
    raw = raw[start * bits - 8 * low :][: n * bits].reshape(n, bits)
    return (raw.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


class Encoder:
    """Texts to ids as little-endian bytes; the ids of words met before are kept.

    A byte-level tokenizer without a normaliser never joins what stands before a single space or line end with what
    follows, so a text is cut there, and only words not met before go through the library, many in one call. With any
    other tokenizer, and where a text holds a special token, other white space or longer runs of it, the library gets
    the text as a whole.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.begins = np.zeros(self.vocabulary, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.begins[i] = token[:1] in "\u0120\u010a"  # how byte-level vocabularies write a space and a line end
        self.known: dict[str, bytes] = {}
        self.ends = {x: self._ids(x).tobytes() for x in ".,"} if self.cuts else {}

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, fresh: set[str]) -> set[str]:
        """Learns the ids of new words, all but those with other white space, which are returned.

        A word stands for itself after a space, or, with the mark \\0, at the beginning of a text; one that begins with a
        line end has no space. Encoded as one text, each begins where a token has the space or line end.
        """
        odd = {w for w in fresh if not w.isprintable() and not (w[0] in "\n\0" and w[1:].isprintable())}
        heads = [w for w in fresh if w[:1] == "\0" and w not in odd]
        plain, tailed = [], []
        for w in fresh:
            # a comma or full stop after a letter is a piece of its own
            if w[-1:] in self.ends and w[-2:-1].isalpha():
                tailed.append(w)
            elif w[:1] != "\0" and w not in odd:
                plain.append(w)
        tailed = [w for w in tailed if w not in odd and w[0] != "\0"]
        plain += {w[:-1] for w in tailed}.difference(self.known, plain)
        for k in range(0, len(plain), 4000):
            some = plain[k : k + 4000]
            ids = self._ids("".join([w if w[:1] == "\n" else " " + w for w in some]))
            at = np.flatnonzero(self.begins[ids])
            if len(at) == len(some):
                raw, cut = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
                self.known.update(zip(some, [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)], strict=True))
            else:
                odd.update(some)
        for w in tailed:
            if (core := self.known.get(w[:-1])) is None:
                odd.add(w)
            else:
                self.known[w] = core + self.ends[w[-1]]
        for w in heads:
            self.known[w] = self._ids(w[1:]).tobytes()
        return odd

    def _cut(self, text: str) -> list[str] | None:
        if not self.cuts or text.endswith((" ", "\n\n")) or any(x in text for x in _RUNS) or any(x in text for x in self.special):
            return None
        out = text.replace("\n", " \n").split(" ")
        out[0] = "\0" + out[0]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for k in range(0, len(texts), 200):
            some = texts[k : k + 200]
            cut = [self._cut(t) for t in some]
            if len(self.known) > CACHE:
                # words met first are the frequent ones
                self.known = dict(islice(self.known.items(), KEEP))
            get = self.known.get
            got = [[] if c is None else list(map(get, c)) for c in cut]
            gaps = [list(compress(range(len(g)), map(not_, g))) for g in got]
            odd = self._learn({c[i] for c, at in zip(cut, gaps, strict=True) for i in at})
            for t, c, g, at in zip(some, cut, got, gaps, strict=True):
                if c is None or odd and not odd.isdisjoint(c):
                    out.append(self._ids(t).tobytes())
                else:
                    for i in at:
                        g[i] = get(c[i])
                    out.append(b"".join(g))
        return out


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


class _Shard:
    """Gathers the ids of a shard's documents into blocks."""

    def __init__(self, shard: int, bits: int):
        self.shard, self.bits, self.block, self.first = shard, bits, 0, 0
        self.parts: list[np.ndarray] = []
        self.held = self.spill = 0
        self.docs: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[dict]:
        self.docs.append(doc)
        self.lengths.append(len(ids))
        while len(ids) >= (room := BLOCK_IDS - self.held):
            self.parts.append(ids[:room])
            ids = ids[room:]
            yield self.close(min(len(ids), BLOCK_IDS))
        if len(ids):
            self.parts.append(ids)
            self.held += len(ids)

    def close(self, spill: int = 0) -> dict:
        ids = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint32)
        out = {"shard": self.shard, "block": self.block, "first": self.first, "bits": self.bits, "n_ids": len(ids), "payload": pack(ids, self.bits), "doc_ids": self.docs, "lengths": self.lengths, "spill": self.spill}
        self.block, self.first, self.parts, self.held, self.docs, self.lengths, self.spill = self.block + 1, self.first + len(ids), [], 0, [], [], spill
        return out


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> None:
    """Encodes every text and writes the two tables to folder, a path that all executors reach through Spark."""
    spark = docs.sparkSession
    python_batches(spark)
    schema = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("first", pa.int64()), ("bits", pa.int32()), ("n_ids", pa.int32()), ("payload", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("spill", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        end, bits = np.asarray([end_id], "<u4").tobytes(), width(max(code.vocabulary, end_id + 1))
        made, now = [], None
        for b in batches:
            codes = code.encode(b.column("text").to_pylist())
            for shard, doc, ids in zip(b.column("shard").to_pylist(), b.column("doc_id").to_pylist(), codes, strict=True):
                if now is None or now.shard != shard:
                    if now and now.docs or now and now.held:
                        made.append(now.close())
                    now = _Shard(shard, bits)
                made += now.add(doc, np.frombuffer(ids + end, "<u4"))
                if len(made) >= 16:
                    yield pa.RecordBatch.from_pylist(made, schema)
                    made = []
        if now and (now.docs or now.held):
            made.append(now.close())
        if made:
            yield pa.RecordBatch.from_pylist(made, schema)

    n = 2 * parts(docs)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("shard", range_bucket(rows, "doc_id", n))
    dealt = rows.repartitionById(n + 1, (F.col("shard") + 1).cast("int")).sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    dealt.mapInArrow(run, BLOCKS).write.option("compression", "zstd").parquet(f"{folder}/blocks")
    shards = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").groupBy("shard").agg(F.sum("n_ids").cast("long").alias("n_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long")).write.parquet(f"{folder}/index")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32.

    A block goes through Python by itself: it reports each document that begins in it and the pieces of one that goes on,
    as checksums that are then joined in order, so no task needs a whole shard.
    """
    spark_blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    index = spark.read.parquet(f"{folder}/index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                ids = unpack(r["payload"], r["bits"], r["n_ids"])
                at = r["spill"]
                if at:
                    out.append((r["shard"], r["first"], None, 0, at, zlib.crc32(ids[:at].astype("<u4").tobytes()), True))
                for doc, n in zip(r["doc_ids"], r["lengths"], strict=True):
                    have = ids[at : at + n]
                    out.append((r["shard"], r["first"] + at, doc, n, len(have), zlib.crc32(have.astype("<u4").tobytes()), False))
                    at += n
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["shard", "at", "doc_id", "n", "have", "crc", "more"])

    parts = staged(spark_blocks.mapInArrow(run, "shard long, at long, doc_id long, n long, have long, crc long, more boolean"), "id-checks")
    whole = parts.filter("not more and have = n").select("shard", "at", "doc_id", "n", "crc")
    cut = parts.filter("more or have < n")
    # the pieces of a document that a block's end cuts: its head names it, the others follow in the shard
    key = F.max(F.when(~F.col("more"), F.col("at"))).over(Window.partitionBy("shard").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    cut = cut.withColumn("head", key).groupBy("shard", "head").agg(F.max("doc_id").alias("doc_id"), F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "have", "crc"))).alias("pieces"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = []
            for pieces in b.column("pieces").to_pylist():
                total = 0
                for p in pieces:
                    total = crc_join(total, p["crc"], 4 * p["have"])
                crc.append(total)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("shard", "head", "doc_id", "n")), pa.array(crc, pa.int64())], ["shard", "at", "doc_id", "n", "crc"])

    whole = whole.unionByName(cut.mapInArrow(join, "shard long, at long, doc_id long, n long, crc long"))
    return whole.join(F.broadcast(index.select("shard", "start")), "shard").select("doc_id", (F.col("start") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def _times(matrix: list[int], vector: int) -> int:
    out = i = 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


@cache
def _zeros(k: int) -> tuple[int, ...]:
    """What 2**k zero bytes do to a CRC-32, as a matrix over its bits."""
    if k:
        half = list(_zeros(k - 1))
        return tuple(_times(half, half[i]) for i in range(32))
    bit = [0xEDB88320, *(1 << i for i in range(31))]
    for _ in range(3):
        bit = [_times(bit, bit[i]) for i in range(32)]
    return tuple(bit)


def crc_join(first: int, second: int, length: int) -> int:
    """The CRC-32 of two byte strings one after the other, from theirs and the second's length."""
    k = 0
    while length:
        if length & 1:
            first = _times(list(_zeros(k)), first)
        length >>= 1
        k += 1
    return first ^ second


def report(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the token files to the shared folder and describes each document from them."""
    spark = docs.sparkSession
    folder = f"{scratch(spark)}/skein/ids-{uuid.uuid4().hex}"
    write_ids(docs, folder, tokenizer, end_id)
    return read_documents(spark, folder)

"""Exact deduplication with counting quotient filters.

A text counts by its form with A-Z lower-cased, as UTF-8 bytes; its fingerprint is 64 bits of xxHash64. Each partition builds
a counting quotient filter of its fingerprints: the upper bits (quotient) say which run a fingerprint belongs to, the lower
ones (remainder) stand in ascending order inside the run, once each, with a count. A filter is cut into segments of
RUNS quotients: a bitmap of the runs in use, a bitmap of run ends, the remainders in as few whole bytes as they need, and
the counts above one with their places. Segments of all partitions meet by number and are merged run by run, remainders in
order, counts added: nothing is lost, the result is the filter of all rows.

Fingerprints with a count above one route their texts to verification: texts group by fingerprint and bytes (copies meet in
the partial aggregate, so a group with a third of all rows sends one text a task). Classes are those groups, told apart by
fingerprint and SHA-256; where the bytes of two texts have both in common, the job fails rather than guess. Other texts are
alone by their fingerprint.

Defined results: a null text counts as empty, empty texts are one class; texts of any length are read whole; of equal texts the
row with the largest key stays, a null key being the smallest; of rows with that key too, just one stays (the one stored
last); every row is returned; an empty table gives no rows; further columns are ignored by report() and kept by dedup().
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import maybe_broadcast, parts, python_batches, staged, unused

#: Quotients of a segment: 2 ** 8.
RUN_BITS = 8
RUNS = 1 << RUN_BITS
#: Fingerprints (8 bytes each) that may be broadcast; more of them are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Classes of more rows than this are joined by broadcast, if there are at most BROADCAST_KEYS of them.
HOT_ROWS = 10_000


def normal(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def fingerprint(body: bytes) -> int:
    return xxhash.xxh64_intdigest(body)


def count_sorted(prints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint once, ascending, counts added. Runs that are sorted already are merged."""
    order = np.argsort(prints, kind="stable")
    prints, counts = prints[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]])) if len(prints) else np.zeros(0, np.int64)
    return prints[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def encode(prints: np.ndarray, counts: np.ndarray, segment_bits: int) -> bytes:
    """One segment of a filter from its fingerprints (ascending, distinct) and their counts."""
    low = 64 - segment_bits - RUN_BITS
    runs = ((prints >> np.uint64(low)) & np.uint64(RUNS - 1)).astype(np.int64)
    remainders = prints & np.uint64((1 << low) - 1)
    used, ends = np.zeros(RUNS, np.uint8), np.ones(len(prints), np.uint8)
    used[runs] = 1
    ends[:-1] = runs[1:] != runs[:-1]
    width = -(-low // 8)
    packed = remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    many = np.flatnonzero(counts > 1)
    head = np.array([len(prints), len(many)], "<i8").tobytes()
    return b"".join((head, np.packbits(used).tobytes(), np.packbits(ends).tobytes(), packed.tobytes(), many.astype("<i8").tobytes(), counts[many].astype("<i8").tobytes()))


def decode(data: bytes, segment: int, segment_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and counts of one segment, as encode() got them."""
    low = 64 - segment_bits - RUN_BITS
    n, many = np.frombuffer(data, "<i8", 2)
    at = 16
    used = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, RUNS // 8, at)))
    at += RUNS // 8
    ends = np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at))[:n]
    at += -(-n // 8)
    width = -(-low // 8)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
    at += n * width
    runs = used[np.concatenate([[0], np.cumsum(ends, dtype=np.int64)[:-1]])].astype(np.uint64) if n else np.zeros(0, np.uint64)
    high = (np.uint64(segment) << np.uint64(RUN_BITS)) | runs
    counts = np.ones(n, np.int64)
    counts[np.frombuffer(data, "<i8", many, at)] = np.frombuffer(data, "<i8", many, at + 8 * many)
    return (high << np.uint64(low)) | wide.view("<u8").ravel().astype(np.uint64), counts


def merge(segments: list[bytes], segment: int, segment_bits: int) -> bytes:
    """The segment of all rows from those of its parts."""
    prints, counts = (np.concatenate(x) for x in zip(*(decode(s, segment, segment_bits) for s in segments), strict=True))
    return encode(*count_sorted(prints, counts), segment_bits)


def filters(prints: DataFrame, segment_bits: int) -> DataFrame:
    """segment, filter of each partition; prints has fp, a long whose bits are the fingerprint's."""

    def segments(values: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        number = (values >> np.uint64(64 - segment_bits)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        last = np.append(first[1:], len(values))
        return pa.RecordBatch.from_arrays([pa.array(number[first]), pa.array([encode(values[a:b], counts[a:b], segment_bits) for a, b in zip(first, last, strict=True)], pa.binary())], names=["segment", "filter"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts, held = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, held)) > max(1 << 20, len(values)):
                new = np.concatenate(held)
                values, counts = count_sorted(np.concatenate([values, np.sort(new)]), np.concatenate([counts, np.ones(len(new), np.int64)]))
                held = []
        new = np.sort(np.concatenate([*held, np.zeros(0, np.uint64)]))
        values, counts = count_sorted(np.concatenate([values, new]), np.concatenate([counts, np.ones(len(new), np.int64)]))
        if len(values):
            whole = segments(values, counts)
            for at in range(0, whole.num_rows, 1000):
                yield whole.slice(at, 1000)

    return prints.select("fp").mapInArrow(run, "segment long, filter binary")


def repeated(prints: DataFrame, segment_bits: int) -> DataFrame:
    """fp, n of the fingerprints that more than one row has, from the merged filters."""

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        segment = int(key[0])
        values, counts = decode(merge(list(p["filter"]), segment, segment_bits), segment, segment_bits)
        return pd.DataFrame({"fp": values[counts > 1].view(np.int64), "n": counts[counts > 1]})

    return filters(prints, segment_bits).groupBy("segment").applyInPandas(run, "fp long, n long")


def bodies(docs: DataFrame, text: str, columns: str, make: Callable[[list[bytes]], list[pa.Array]]) -> DataFrame:
    """docs' _key, the fingerprint of text and what make() says of the normal forms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_key", "fp", *(c.split()[0] for c in columns.split(", "))]
        for b in batches:
            some = [normal(t) for t in b.column(1).to_pylist()]
            prints = np.array([fingerprint(x) for x in some], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.int64()), *make(some)], names=names)

    return docs.select("_key", text).mapInArrow(run, f"_key {docs.schema['_key'].dataType.simpleString()}, fp long, {columns}")


def verified(docs: DataFrame, text: str, again: DataFrame) -> DataFrame:
    """fp, sha, size of the texts whose fingerprint comes again and that are equal byte by byte."""
    known = maybe_broadcast(again.select("fp"), BROADCAST_KEYS)
    texts = bodies(docs, text, "body binary", lambda some: [pa.array(some, pa.binary())]).join(known, "fp", "left_semi")
    same = texts.groupBy("fp", "body").agg(F.count("*").alias("size")).select("fp", F.sha2("body", 256).alias("sha"), "size")
    # two texts with both digests in common can't be told apart by them
    apart = same.groupBy("fp", "sha").agg(F.sum("size").alias("size"), F.count("*").alias("texts"))
    clash = F.raise_error(F.concat(F.lit("different texts with one fingerprint and SHA-256: "), F.col("sha"))).cast("long")
    return apart.select("fp", "sha", F.when(F.col("texts") == 1, F.col("size")).otherwise(clash).alias("size")).filter("size > 1")


def attach(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows with their class, if they have one. Large classes come by broadcast, so no task gets all rows of one."""
    hot = classes.filter(F.col("size") > HOT_ROWS)
    if hot.isEmpty():
        return rows.join(maybe_broadcast(classes, BROADCAST_KEYS), ["fp", "sha"], "left")
    hot = maybe_broadcast(hot, BROADCAST_KEYS)
    rest = rows.join(hot, ["fp", "sha"], "left_anti").join(maybe_broadcast(classes.filter(F.col("size") <= HOT_ROWS), BROADCAST_KEYS), ["fp", "sha"], "left")
    return rows.join(hot, ["fp", "sha"]).unionByName(rest)


def _classified(docs: DataFrame, text: str) -> DataFrame:
    """_key, sha, _top, size of each row of docs (_key, text); _stays says whether the row stays."""
    python_batches(docs.sparkSession)
    segment_bits = max(0, math.ceil(math.log2(parts(docs)))) + 2
    digest = lambda some: [pa.array([hashlib.sha256(x).hexdigest() for x in some])]
    rows = staged(bodies(docs, text, "sha string", digest).withColumn("_row", F.monotonically_increasing_id()), "texts")
    again = staged(repeated(rows, segment_bits), "repeated")
    equal = staged(verified(docs, text, again), "verified")
    # a null key is the smallest
    last = F.max(F.struct(F.col("_key").isNotNull().alias("has"), "_key", "_row"))
    tops = rows.join(maybe_broadcast(equal.select("fp", "sha"), BROADCAST_KEYS), ["fp", "sha"], "left_semi").groupBy("fp", "sha").agg(last.alias("_top"))
    classes = staged(tops.join(equal, ["fp", "sha"]).select("fp", "sha", F.col("_top._key").alias("_top"), F.col("_top._row").alias("_last"), "size"), "classes")
    out = attach(rows, classes)
    alone = F.col("size").isNull()
    return out.select("_key", "sha", "_row", F.when(alone, F.col("_key")).otherwise(F.col("_top")).alias("_top"), F.coalesce("size", F.lit(1)).alias("size"), (alone | (F.col("_row") == F.col("_last"))).alias("_stays"))


def _column(name: str) -> Column:
    return F.col(f"`{name}`")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each of docs: key, keep_id, group_size, kept, text_sha256."""
    rows = _classified(docs.select(_column(key).alias("_key"), _column(text).alias("_text")), "_text")
    return rows.select(F.col("_key").alias(key), F.col("_top").alias("keep_id"), F.col("size").alias("group_size"), F.col("_stays").alias("kept"), F.col("sha").alias("text_sha256"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, all columns, with one row of each class of equal texts.

    docs is stored first, each row with a number of its own, so the row that stays is the row that was counted.
    """
    (number,) = unused(docs, "_number")
    held = staged(docs.withColumn(number, F.monotonically_increasing_id()), "dedup")
    # the number orders rows of one key, as the key orders others
    rows = _classified(held.select(F.struct(_column(key).isNotNull().alias("has"), _column(key).alias("key"), _column(number).alias("number")).alias("_key"), _column(text).alias("_text")), "_text")
    gone = rows.filter(~F.col("_stays")).select(F.col("_key.number").alias(number))
    return held.join(gone, number, "left_anti").drop(number)

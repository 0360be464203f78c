"""Conflict-constrained best-fit packing of documents into sequences of a fixed capacity.

Documents longer than the capacity are cut into full pieces and a rest. Rows are dealt into shards of about SHARD_ROWS by
a hash of the key, so no key, source or group of copies decides a shard's size. In a shard, pieces go by falling length
into the bin with the least room that still takes them (best fit). Bins stand in order of their room and carry bitmaps
of the sources and duplicate clusters they hold; the search goes on from the tightest bin upwards until one has neither
the piece's source nor its cluster, however far that is; else a new bin opens.

The unit is the UTF-8 byte, the token of a byte-level model. Defined results: null and empty texts need no room and get no
bin (bin null); very long texts are cut like others, each piece for itself; a null source is a source of its own; repeated
rows (and those without a key) are packed each, dealt like any others; pieces of one length go by key, bins of one room by
age; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import parts, python_batches, staged

CAPACITY = 8192
SHARD_ROWS = 4096
SCHEMA = "doc_id long, keyed boolean, source string, cluster long, piece int, begin long, length long, shard long, bin int, at long"


class Bins:
    """Open bins in order of room, with bitmaps of what they hold."""

    def __init__(self, capacity: int, sources: int, clusters: int, size: int = 256):
        self.capacity, self.count = capacity, 0
        self.order_room = np.empty(size, np.int64)  # ascending
        self.order_bin = np.empty(size, np.int64)
        self.sources = np.zeros(((sources + 63) // 64, size), np.uint64)
        self.clusters = np.zeros(((clusters + 63) // 64, size), np.uint64)
        self.open = 0

    def _grow(self) -> None:
        self.order_room, self.order_bin = (np.concatenate([x, np.empty_like(x)]) for x in (self.order_room, self.order_bin))
        self.sources, self.clusters = (np.concatenate([x, np.zeros_like(x)], axis=1) for x in (self.sources, self.clusters))

    def place(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """The bin for a piece, and where in it the piece begins."""
        n = self.open
        s_bit, c_bit = np.uint64(1 << source % 64), np.uint64(1 << cluster % 64)
        s_map, c_map = self.sources[source // 64], self.clusters[cluster // 64]
        k = int(np.searchsorted(self.order_room[:n], length))
        step, found = 32, -1
        while k < n:  # successors, some at a time
            bins = self.order_bin[k : min(n, k + step)]
            free = ((s_map[bins] & s_bit) | (c_map[bins] & c_bit)) == 0
            if free.any():
                found = k + int(free.argmax())
                break
            k, step = k + step, 2 * step
        if found < 0:
            if self.count == len(self.order_bin) or self.count == self.sources.shape[1]:
                self._grow()
                s_map, c_map = self.sources[source // 64], self.clusters[cluster // 64]
            which, room = self.count, self.capacity
            self.count += 1
        else:
            which, room = int(self.order_bin[found]), int(self.order_room[found])
            self.order_room[found : n - 1] = self.order_room[found + 1 : n]
            self.order_bin[found : n - 1] = self.order_bin[found + 1 : n]
            n -= 1
        s_map[which] |= s_bit
        c_map[which] |= c_bit
        left = room - length
        if left:
            # of bins with the same room the oldest comes first
            low, high = np.searchsorted(self.order_room[:n], left), np.searchsorted(self.order_room[:n], left, side="right")
            k = int(low + np.searchsorted(self.order_bin[low:high], which))
            self.order_room[k + 1 : n + 1] = self.order_room[k:n].copy()
            self.order_bin[k + 1 : n + 1] = self.order_bin[k:n].copy()
            self.order_room[k], self.order_bin[k] = left, which
            n += 1
        self.open = n
        return which, self.capacity - room


def pack_shard(lengths: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int | None, int]]:
    """(row, piece, begin, length, bin, place in the bin) of every piece; sources and clusters are numbers from 0 on."""
    pieces = [(int(min(capacity, n - b)), int(r), p, b) for r, n in enumerate(lengths) for p, b in enumerate(range(0, max(int(n), 1), capacity))]
    pieces.sort(key=lambda x: (-x[0], x[1], x[2]))
    bins = Bins(capacity, int(sources.max(initial=0)) + 1, int(clusters.max(initial=0)) + 1)
    out = []
    for n, row, piece, begin in pieces:
        if n:
            which, at = bins.place(n, int(sources[row]), int(clusters[row]))
            out.append((row, piece, begin, n, which, at))
        else:
            out.append((row, piece, begin, 0, None, 0))
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row for each piece of each document: its bytes [begin, begin + length) go to (shard, bin) at position at.

    Duplicate clusters are the texts that are equal but for case and white space.
    """
    python_batches(docs.sparkSession)
    body = F.coalesce("text", F.lit(""))
    cluster = F.xxhash64(F.lower(F.trim(F.regexp_replace(body, r"\s+", " "))))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("keyed"), F.col("source").cast("string"), F.octet_length(body).alias("size"), cluster.alias("cluster"))
    # rows that are equal in all of this are counted, then numbered, so they spread like any others
    rows = staged(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")), "pack-rows")
    total = rows.agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    if (total["most"] or 0) > shard_rows:
        # many copies of one row: dealt in portions before each becomes rows
        portion = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(shard_rows).cast("long")))
        rows = rows.withColumn("from", portion).withColumn("n", F.least(F.col("n") - F.col("from"), F.lit(shard_rows))).repartition(parts(rows), F.xxhash64("doc_id", "size", "from"))
    else:
        rows = rows.withColumn("from", F.lit(0).cast("long"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("n") - 1))).drop("from", "n")
    # how many shards follows from the number of rows
    shards = max(1, -(-(total["all"] or 0) // shard_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "size", "copy"), F.lit(shards)))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["keyed", "doc_id", "size", "cluster", "copy"], kind="stable").reset_index(drop=True)
        got = pack_shard(p["size"].to_numpy(), pd.factorize(p["source"].astype(object).where(p["source"].notna(), None), use_na_sentinel=False)[0], pd.factorize(p["cluster"])[0], capacity)
        row, piece, begin, length, which, at = zip(*got, strict=True)
        row = list(row)
        return pd.DataFrame({"doc_id": p["doc_id"].to_numpy()[row], "keyed": p["keyed"].to_numpy()[row], "source": p["source"].to_numpy()[row], "cluster": p["cluster"].to_numpy()[row], "piece": piece, "begin": begin, "length": length, "shard": p["shard"].iloc[0], "bin": pd.array(which, "Int32"), "at": at})

    return rows.groupBy("shard").applyInPandas(run, SCHEMA).withColumn("doc_id", F.when(F.col("keyed"), F.col("doc_id"))).drop("keyed")


def audit(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Per document of a packing: doc_id, pieces, bytes, faults (of its pieces and of the bins that they are in)."""
    packed = staged(packed, "packed")
    whole = Window.partitionBy("shard", "bin")
    # a bin holds a piece of each source at most once, so such a window is never large
    bins = packed.filter("bin is not null").withColumns({
        "fill": F.sum("length").over(whole),
        "overlap": F.when(F.lag(F.col("at") + F.col("length")).over(whole.orderBy("at")) > F.col("at"), 1).otherwise(0),
        "same_source": F.count("*").over(Window.partitionBy("shard", "bin", "source")) - 1,
        "same_cluster": F.count("*").over(Window.partitionBy("shard", "bin", "cluster")) - 1,
    })
    wrong = F.when((F.col("fill") > capacity) | (F.col("overlap") > 0) | (F.col("same_source") > 0) | (F.col("same_cluster") > 0) | (F.col("length") > capacity), 1).otherwise(0)
    each = bins.select("doc_id", "begin", "length", wrong.alias("wrong")).unionAll(packed.filter("bin is null").select("doc_id", "begin", "length", F.when(F.col("length") > 0, 1).otherwise(0)))
    seen = each.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("length").alias("bytes"), F.sum("wrong").alias("faults"), F.max(F.col("begin") + F.col("length")).alias("end"), F.countDistinct("begin").alias("begins"))
    return seen.select("doc_id", "pieces", "bytes", (F.col("faults") + F.when((F.col("end") != F.col("bytes")) | (F.col("begins") != F.col("pieces")), 1).otherwise(0)).alias("faults"))

"""Benchmark decontamination by SimHash of item-sized windows. DataFrame functions only.

Texts and items are words (runs of letters and digits, lower case) and their five-word shingles. A window has as many
words as the item it is held against (a shorter text is one window). Every window that can reach the similarity gets a
64-bit SimHash of its shingles: with m shingles in the item and k in the window, a weighted Jaccard similarity of s needs
s / (1 + s) * (k + m) shingles in common, so a window with fewer shingles that occur anywhere in the benchmark is left
out, and no other is; where in an item they stand, and in which item, plays no part. Running sums of the votes, packed
several to a number, give each window's fingerprint in constant time. Fingerprints within RADIUS bits of an item's of that
size are all found: of BLOCKS blocks one differs by at most RADIUS // BLOCKS bits, and each item is indexed under every
value that near. What is found is verified exactly: the weighted Jaccard similarity of the shingle multisets (weight: how
often a shingle occurs) must reach SIMILARITY.

Defined results: null texts and texts of fewer than five words hold no window; items of fewer than five words match
nothing; rows with a null key are not searched (and never dropped); repeated rows give one result; rows of one key with
different texts are searched each, and the best window counts; repeated items are items each, those with one id and
different texts count as one with the best window of either; ties in similarity go to the first window; empty tables give
no rows; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import discard, let, maybe_broadcast, scan, staged

WORDS = 5
SIMILARITY = 0.8
#: The same in hundredths, for exact bounds.
LEAST = round(100 * SIMILARITY)
BITS = 64
#: At a similarity of 0.8 the fingerprints of two sets of shingles differ by 10 bits on average, deviation 3.
RADIUS = 20
BLOCKS = 8
#: Numbers in the items' tables that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 400_000
#: Keys (two numbers each) of documents that may be broadcast.
KEY_ROWS = 1_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), "")


def shingles(w: Column) -> Column:
    """Hashes of the five-word shingles of an array of words, in order; w must be a plain column, as each step reads it."""
    some = F.slice(w, F.lit(1), F.greatest(F.size(w) - (WORDS - 1), F.lit(0)))
    return F.transform(some, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WORDS)]))


def lanes(longest: int) -> int:
    """Votes that share a number, each with room for running sums over so many shingles (62 bits in all)."""
    return 3 if longest < 1 << 20 else 2


def _mask(per: int) -> int:
    return sum(1 << 63 // per * i for i in range(per))


def votes(h: Column, per: int) -> Column:
    """The bits of an array of hashes as running sums, per of them packed into a number (v0, v1 ...), a zero first."""
    size, n = 63 // per, -(-BITS // per)
    kind = "struct<" + ",".join(f"v{k}:bigint" for k in range(n)) + ">"

    def spread(y: Column, k: int) -> Column:
        x = F.shiftrightunsigned(y, per * k).bitwiseAND(F.lit((1 << per) - 1))
        return reduce(Column.bitwiseOR, [F.shiftleft(x, (size - 1) * i) for i in range(per)]).bitwiseAND(F.lit(_mask(per)))

    each = lambda f: F.struct(*[f(k).alias(f"v{k}") for k in range(n)])
    plus = lambda a, b: F.when(a.isNull(), b).otherwise(each(lambda k: a[f"v{k}"] + b[f"v{k}"]))
    return F.concat(F.array(each(lambda k: F.lit(0).cast("bigint"))), scan(F.transform(h, lambda y: each(lambda k: spread(y, k))), plus, kind))


def simhash(sums: Column, start: Column, length: Column, per: int) -> Column:
    """The fingerprint of a window: bit b is set where more than half of its hashes have it set.

    Differences of running sums are the packed votes; adding what lacks to a half carries a majority into the top bit.
    """
    size = 63 // per
    every = (F.lit(1 << (size - 1)) - F.floor(length / 2).cast("bigint") - 1) * F.lit(_mask(per))
    out = F.lit(0).cast("bigint")
    for k in range(-(-BITS // per)):
        v = F.get(sums, start + length)[f"v{k}"] - F.get(sums, start)[f"v{k}"] + every
        top = F.shiftrightunsigned(v, size - 1).bitwiseAND(F.lit(_mask(per)))
        own = reduce(Column.bitwiseOR, [F.shiftrightunsigned(top, (size - 1) * i) for i in range(per)]).bitwiseAND(F.lit((1 << per) - 1))
        out = out.bitwiseOR(F.shiftleft(own, per * k))
    return out


def block(h: Column, k: int) -> Column:
    size = BITS // BLOCKS
    return F.shiftrightunsigned(h, size * k).bitwiseAND(F.lit((1 << size) - 1)).cast("int")


def near_values() -> list[int]:
    """What to xor a block with to get every value within RADIUS // BLOCKS bits."""
    size = BITS // BLOCKS
    return [sum(1 << i for i in c) for d in range(RADIUS // BLOCKS + 1) for c in combinations(range(size), d)]


def multiset_jaccard(x: Column, y: Column) -> Column:
    """Sum of the lesser counts over that of the greater ones; x and y are plain columns.

    A value common to both counts once; only those that are repeated in both are counted out.
    """

    def repeated(a: Column) -> Column:
        return let(F.array_sort(a), lambda s: F.array_distinct(F.filter(s, lambda v, i: (i > 0) & (v == F.get(s, i - 1)))))

    times = lambda a, v: F.size(F.filter(a, lambda z: z == v))
    more = F.aggregate(F.array_intersect(repeated(x), repeated(y)), F.lit(0), lambda s, v: s + F.least(times(x, v), times(y, v)) - 1)
    both = F.size(F.array_intersect(x, y)) + F.when((F.size(x) > F.size(F.array_distinct(x))) & (F.size(y) > F.size(F.array_distinct(y))), more).otherwise(0)
    return let(both, lambda n: n / (F.size(x) + F.size(y) - n))


def least_common(k: Column, m: Column) -> Column:
    """Of windows with k shingles and items with m: how many must be common to both."""
    return F.ceil((k + m) * LEAST / (100 + LEAST) - 1e-9).cast("int")


def _items(benchmark: DataFrame) -> DataFrame:
    w = words(F.col("text"))
    rows = benchmark.filter("item_id is not null").select("item_id", w.alias("w")).distinct().withColumn("shingles", shingles(F.col("w")))
    return staged(rows.filter(F.size("shingles") > 0).select("item_id", "shingles", F.size("shingles").alias("m"), F.xxhash64("w").alias("item_row")), "items")


def _windows(hits: Column, size: Column, sizes: list[int]) -> Column:
    """Where windows of each of sizes begin in a text of size shingles that hold enough of the sorted places hits."""

    def of(m: Column) -> Column:
        k, last = F.least(size, m), F.greatest(size - m, F.lit(0))
        need = least_common(k, m)
        # each run of as many places as are needed that fits into a window allows some beginnings
        ends = F.transform(F.slice(hits, need, F.greatest(F.size(hits) - need + 1, F.lit(0))), lambda to, i: F.struct(F.greatest(to - k + 1, F.lit(0)).alias("a"), F.least(F.get(hits, i), last).alias("b")))
        starts = F.array_distinct(F.flatten(F.transform(F.filter(ends, lambda e: e["a"] <= e["b"]), lambda e: F.sequence(e["a"], e["b"]))))
        return F.when(F.size(hits) >= need, F.transform(starts, lambda x: F.struct(m.alias("m"), x.alias("start")))).otherwise(F.array().cast("array<struct<m:int,start:int>>"))

    return F.flatten(F.transform(F.array(*map(F.lit, sizes)).cast("array<int>"), of))


def _blocks(rows: DataFrame, keep: list[str], near: bool) -> DataFrame:
    """A row for each block of simhash, and with near for each value near its own."""
    each = rows.select(*keep, "simhash", F.posexplode(F.array(*[block(F.col("simhash"), k) for k in range(BLOCKS)])).alias("block", "value"))
    if near:
        each = each.withColumn("value", F.explode(F.array(*[F.col("value").bitwiseXOR(F.lit(x)) for x in near_values()])))
    return each


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start (word), similarity: the best window of each document and item that match."""
    items = _items(benchmark)
    sizes = sorted(r["m"] for r in items.select("m").distinct().collect())  # lengths, not items
    known = items.select(F.explode("shingles").alias("shingle")).distinct()
    texts = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), words(F.col("text")).alias("w"))
    each = texts.select("doc_id", "row", F.posexplode(shingles(F.col("w"))).alias("at", "shingle"))
    hits = each.join(maybe_broadcast(known, BROADCAST_ROWS), "shingle").groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("at")).alias("hits"))
    # fewer than the shortest item (or a text of one shingle) needs: no window
    hits = staged(hits.filter(F.size("hits") >= least_common(F.lit(1), F.lit(min(sizes, default=1)))), "window-hits")
    # only keys may be sent to all: texts and places, whose size nothing bounds, meet by a shuffle of the texts found
    found = texts.join(maybe_broadcast(hits.select("doc_id", "row"), KEY_ROWS), ["doc_id", "row"], "left_semi").select("doc_id", "row", shingles(F.col("w")).alias("s"))
    # tables of their own: what is read more than once in a row must be a stored column
    found = staged(found.withColumn("size", F.size("s")), "leak-texts")
    some = found.dropDuplicates(["doc_id", "row"]).join(hits.hint("merge"), ["doc_id", "row"])
    some = staged(some.withColumn("windows", _windows(F.col("hits"), F.col("size"), sizes)).filter(F.size("windows") > 0).drop("hits"), "windowed-texts")
    per = lanes(max([*sizes, some.agg(F.max("size")).first()[0] or 1]))
    printed = some.withColumn("sums", votes(F.col("s"), per)).select("doc_id", "row", "size", "sums", F.explode("windows").alias("w"))
    # a table of its own: every block of the value would repeat the expression
    printed = staged(printed.select("doc_id", "row", "w.m", "w.start", simhash(F.col("sums"), F.col("w.start"), F.least(F.col("size"), F.col("w.m")), per).alias("simhash")), "window-prints")
    marked = items.withColumn("sums", votes(F.col("shingles"), per))
    marked = staged(marked.select("item_id", "item_row", "m", simhash(F.col("sums"), F.lit(0), F.col("m"), per).alias("simhash")), "item-prints")
    index = staged(_blocks(marked, ["item_id", "item_row", "m"], near=True).withColumnRenamed("simhash", "item_hash"), "item-blocks")
    near = _blocks(printed, ["doc_id", "row", "m", "start"], near=False).join(maybe_broadcast(index, BROADCAST_ROWS), ["m", "block", "value"])
    near = near.filter(F.bit_count(F.col("simhash").bitwiseXOR(F.col("item_hash"))) <= RADIUS).select("doc_id", "row", "m", "start", "item_id", "item_row").distinct()
    near = staged(near, "near-windows")
    both = near.join(some.select("doc_id", "row", "s").hint("merge"), ["doc_id", "row"])
    both = both.join(maybe_broadcast(items.select("item_id", "item_row", "shingles"), BROADCAST_ROWS, F.size("shingles")), ["item_id", "item_row"])
    both = both.select("doc_id", "item_id", "start", F.slice("s", F.col("start") + 1, F.col("m")).alias("own"), "shingles")
    exact = both.withColumn("similarity", multiset_jaccard(F.col("own"), F.col("shingles"))).filter(F.col("similarity") >= SIMILARITY)
    best = exact.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("b"))
    out = staged(best.select("doc_id", "item_id", (-F.col("b.back")).cast("int").alias("start"), F.col("b.similarity").alias("similarity")), "leaked")
    discard(items, hits, found, some, printed, marked, index, near)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any item of the benchmark, columns unchanged."""
    bad = staged(find_leaks(docs, benchmark).select("doc_id").distinct(), "leaks")
    return docs.join(maybe_broadcast(bad, BROADCAST_ROWS), "doc_id", "left_anti").select(*docs.columns)

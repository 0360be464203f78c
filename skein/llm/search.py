"""Ranked lexical search: a tree of maxima over document ranges, searched best bound first.

Words are runs of ASCII letters and digits and of anything beyond ASCII, only A-Z lower-cased; what a word adds to a
document's score depends on its weight, how often it occurs and how long the document is (whole numbers, div rounding down).

Documents are read once and stored as their length and the numbers and counts of the queries' words, so N, L and each word's
document frequency cover all documents. Each task then takes its documents in blocks. In a block, documents stand in ranges
of 64, ranges in nodes of 16, nodes in nodes of 16; every node holds, for each word, the most that the word adds to any of
its documents, and the least key. A query opens nodes by the highest sum of its words' maxima, equal sums by the least key;
a range's documents are scored exactly. It ends when the best node left can't beat the last of its 20: a node with an equal
bound is opened as long as its least key is below that document's. What was found narrows the task's next blocks. Tasks
shuffle 20 rows a query each.

The queries are the broadcast side. They go in blocks of at most QUERY_WORDS words (a larger query is a block of its own)
against all documents, however many there are; a block's words with their weights are what the driver sends.

Defined results: a null or wordless text has no words, counts nowhere and is never found; texts of any length are read whole;
each distinct (id, text) of the queries is a query, a repeated row is one, two texts of one id are answered each; a null id is
an id; every row of the documents is a document, rows of one key are found each; a null key ranks after all others among
equal scores; an empty table on either side gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import python_batches, staged

#: Results of a query.
TOP = 20
#: Score constants: length norm 100 - B + B * (n / mean), saturation K (in twelfths of the norm), scale of a word's share.
B, K, SCALE = 25, 12, 1_000_000_000
#: Documents of a range, and children of a node above.
RANGE, FAN = 64, 16
#: Words times ranges that a block's lowest tables hold (8 bytes each).
CELLS = 1 << 22
#: Postings of a block, but for its last batch.
POSTINGS = 1 << 21
#: Words of the queries that go together.
QUERY_WORDS = 1 << 17
_LAST = np.iinfo(np.int64).max
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """A text's words, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def shares(weights: np.ndarray, tf: np.ndarray, length: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """What each posting adds to a score: its word's weight, its count, its document's length."""
    norm = 100 - B + (B * length * n_docs) // max(n_words, 1)
    return weights * ((SCALE * tf) // (1000 * tf + K * norm))


def postings(docs: DataFrame, words: dict[bytes, int]) -> DataFrame:
    """_key, n (words with repeats), _terms (numbers of the known words, ascending), _counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, terms, counts = [], [], []
            for text in b.column(1).to_pylist():
                found = words_of(text)
                tally = Counter(found)
                known = sorted((words[w], tally[w]) for w in words.keys() & tally.keys())
                n.append(len(found))
                terms.append([t for t, _ in known])
                counts.append([c for _, c in known])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], names=["_key", "n", "_terms", "_counts"])

    return docs.mapInArrow(run, f"_key {docs.schema['_key'].dataType.simpleString()}, n long, _terms array<int>, _counts array<long>")


class Tree:
    """A block of documents: postings by document, and maxima by word and node, from ranges up to one root."""

    def __init__(self, keys: np.ndarray, starts: np.ndarray, terms: np.ndarray, adds: np.ndarray, n_terms: int):
        self.keys, self.starts, self.terms, self.adds = keys, starts, terms, adds
        n = len(keys)
        doc = np.repeat(np.arange(n), np.diff(starts))
        ranges = -(-n // RANGE)
        most = np.zeros((ranges, n_terms), np.int64)
        np.maximum.at(most.reshape(-1), (doc // RANGE) * n_terms + terms, adds)
        least = np.minimum.reduceat(keys, np.arange(0, n, RANGE))
        self.levels = [(most, least)]
        while len(most) > 1:
            at = np.arange(0, len(most), FAN)
            most, least = np.maximum.reduceat(most, at, axis=0), np.minimum.reduceat(least, at)
            self.levels.append((most, least))

    def search(self, terms: np.ndarray, times: np.ndarray, best: list[tuple[int, int, int]], top: int, base: int) -> int:
        """Puts (score, -key, place) of documents into best, a heap of at most top; returns how many ranges were opened."""
        lookup = np.zeros(self.levels[0][0].shape[1], np.int64)
        lookup[terms] = times
        opened = 0
        heap: list[tuple[int, int, int, int]] = []

        def offer(level: int, first: int, last: int) -> None:
            most, least = self.levels[level]
            bounds = most[first:last][:, terms] @ times
            for k in np.flatnonzero(bounds).tolist():
                node = (int(bounds[k]), -int(least[first + k]))
                if len(best) < top or node > best[0][:2]:
                    heapq.heappush(heap, (-node[0], -node[1], level, first + k))

        offer(len(self.levels) - 1, 0, 1)
        while heap:
            bound, least, level, at = heapq.heappop(heap)
            if len(best) == top and (-bound, -least) < best[0][:2]:
                break
            if level:
                offer(level - 1, at * FAN, min((at + 1) * FAN, len(self.levels[level - 1][0])))
                continue
            opened += 1
            lo, hi = at * RANGE, min((at + 1) * RANGE, len(self.keys))
            part = slice(self.starts[lo], self.starts[hi])
            sums = np.concatenate([[0], np.cumsum(lookup[self.terms[part]] * self.adds[part])])
            edges = self.starts[lo : hi + 1] - self.starts[lo]
            scores = sums[edges[1:]] - sums[edges[:-1]]
            for k in np.flatnonzero(scores).tolist():
                found = (int(scores[k]), -int(self.keys[lo + k]), base + lo + k)
                if len(best) < top:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
        return opened


def answer(stored: DataFrame, queries: list[dict[int, int]], weights: list[int], n_docs: int, n_words: int, top: int) -> DataFrame:
    """query, _key, score: the best documents of each task for each query."""
    n_terms = len(weights)
    width = RANGE * max(16, min(1024, CELLS // max(n_terms, 1)))
    asked = [(np.array(sorted(q), np.int64), np.array([q[t] for t in sorted(q)], np.int64)) for q in queries]
    kind = stored.schema["_key"].dataType.simpleString()
    by_term = np.array(weights, np.int64)

    def block(batches: list[pa.RecordBatch]) -> tuple[pa.Array, Tree]:
        t = pa.Table.from_batches(batches).combine_chunks()
        keys = t.column("_key").combine_chunks()
        lists, counts = t.column("_terms").combine_chunks(), t.column("_counts").combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        terms, tf = lists.flatten().to_numpy(zero_copy_only=False), counts.flatten().to_numpy(zero_copy_only=False)
        length = np.repeat(t.column("n").to_numpy(), sizes)
        ranks = keys.cast(pa.int64()).fill_null(int(_LAST)).to_numpy(zero_copy_only=False)
        return keys, Tree(ranks, np.concatenate([[0], np.cumsum(sizes)]), terms, shares(by_term[terms], tf, length, n_docs, n_words), n_terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int, int]]] = [[] for _ in asked]
        held, many, size, base, found = [], 0, 0, 0, {}

        def flush() -> None:
            nonlocal held, many, size, base, found
            if many:
                keys, tree = block(held)
                for (terms, times), heap in zip(asked, best, strict=True):
                    if len(terms):
                        tree.search(terms, times, heap, top, base)
                found = {x[2]: found[x[2]] if x[2] < base else keys[x[2] - base].as_py() for heap in best for x in heap}
                held, many, size, base = [], 0, 0, base + many

        for b in batches:
            while b.num_rows:
                take = min(b.num_rows, width - many)
                held.append(b.slice(0, take))
                size += len(held[-1].column(2).flatten())
                b, many = b.slice(take), many + take
                if many == width or size >= POSTINGS:
                    flush()
        flush()
        rows = [(q, found[place], score) for q, heap in enumerate(best) for score, _, place in heap]
        if rows:
            q, key, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(key, kind_of), pa.array(score, pa.int64())], names=["query", "_key", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind_of = to_arrow_type(stored.schema["_key"].dataType)
    return stored.mapInArrow(run, f"query int, _key {kind}, score long")


def best_of(found: DataFrame, top: int) -> DataFrame:
    """The best rows of each query with their rank, in two steps: no task holds all of a query's rows."""
    order = [F.desc("score"), F.asc_nulls_last("_key")]
    part = F.pmod(F.spark_partition_id(), F.lit(256))
    some = found.withColumn("_part", part).withColumn("rank", F.row_number().over(Window.partitionBy("query", "_part").orderBy(*order))).filter(F.col("rank") <= top)
    return some.drop("_part").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= top)


def query_blocks(items: DataFrame) -> Iterator[list[tuple[object, Counter]]]:
    """The distinct queries, some at a time: (id, its words with their numbers of occurrences)."""
    block, size = [], 0
    for r in items.distinct().orderBy("_id", "_text").toLocalIterator():
        words = Counter(words_of(r["_text"]))
        if block and size + len(words) > QUERY_WORDS:
            yield block
            block, size = [], 0
        block.append((r["_id"], words))
        size += len(words)
    if block:
        yield block


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """The top documents of each item: item, rank from 1, key (a whole number), score."""
    spark = docs.sparkSession
    python_batches(spark)
    kinds = docs.schema[key].dataType.simpleString(), items.schema[item].dataType
    docs = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    out = []
    for block in query_blocks(items.select(F.col(f"`{item}`").alias("_id"), F.col(f"`{text}`").alias("_text"))):
        words = {w: i for i, w in enumerate(sorted(set().union(*(q for _, q in block))))}
        stored = staged(postings(docs, words), "postings")
        n_docs, n_words = stored.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        # a row for each of the block's words
        df = {r["t"]: r["n"] for r in stored.select(F.explode("_terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
        weights = [weight(n_docs, df.get(t, 0)) for t in range(len(words))]
        found = best_of(answer(stored, [{words[w]: n for w, n in q.items()} for _, q in block], weights, n_docs, n_words, top), top)
        ids = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(block)], f"query int, _id {kinds[1].simpleString()}")
        out.append(found.join(F.broadcast(ids), "query").select(F.col("_id").alias(item), "rank", F.col("_key").alias(key), "score"))
    if not out:
        return spark.createDataFrame([], f"`{item}` {kinds[1].simpleString()}, rank int, `{key}` {kinds[0]}, score long")
    return reduce(DataFrame.unionAll, out)

"""N-gram Jaccard join by partitions of the universe (pigeonhole), verified exactly.

Sets of hashed shingles fall into size bands. In a band the universe of hashes is cut into m segments, so many that two
sets similar enough must agree in one: their symmetric difference is at most h, and thresholds t with sum(t + 1) > h
leave some segment with a difference of at most its t. A set allocates its h + 1 units to the segments that cost least
(many elements: few false partners): t = 0 asks for an equal segment, t = 1 (only in the few segments whose
one-deletions are indexed) for one that differs by one element; costly segments, empty ones above all, get none.

Signatures travel as packed blocks of numbers, dealt by their hash. Where k sets share a signature, only the k - 1 pairs
with the least set that asked are proposed. Where such a proposal fails, the group's other pairs are looked at later, and
only those whose components differ and whose histograms (counts of elements by the top bits of their hashes) differ by no
more than the bound on the symmetric difference become proposals: histograms never differ by more than the sets do. So
copies and near copies cost proposals in proportion to their number, and no link that decides a component is lost. Equal
sets (128 bits over their shingles' hashes) are one set from the start.

The components found so hold every link. Inside each, all links are then decided by the words themselves, in blocks of
sets: a place gets two blocks, counts each set's links and keeps what connects its sets, but hands on no pairs (unless
they are asked for). Components and numbers of links follow from that.

Defined results: null and empty texts have the empty set and link with nothing; rows with a null key are returned as
components of their own (null); repeated keys are one node with the links of each of their rows; of equal sets the least
key names the class; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import discard, maybe_broadcast, parts, python_batches, staged
from skein.llm.graph import components
from skein.llm.shingles import exact_sets, mix, shingle_sets

#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
WORDS = 4
#: A band's largest size over its smallest.
BAND = 1.4
#: One segment in so many has its one-deletions indexed (one at least).
DELETIONS = 32
FLUSH_KEYS = 1_500_000
FLUSH_DOCS = 1 << 14
BROADCAST_IDS = 500_000
#: What one of the two blocks that meet in a place holds at most, on average: sets, and shingles of links.
BLOCK_SETS = 1200
BLOCK_SHINGLES = 400_000
#: Up to so many sets that share a shingle, their pairs are counted one by one.
FEW = 24
_ASKS, _HAS = 1 << 14, 1 << 15
_SALT = [np.uint64(x) for x in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


class Bands:
    """Sizes, segments and bounds for a similarity of percent / 100."""

    def __init__(self, percent: int, top: int):
        self.percent = percent
        low, high = [], []
        at = 1
        while at <= max(top, 1):
            low.append(at)
            high.append(max(at, int(at * BAND)))
            at = high[-1] + 1
        self.low, self.high = np.array(low, np.int64), np.array(high, np.int64)
        self.segments = self.bound(2 * self.high) + 1
        self.deleted = np.where(self.segments > 1, np.maximum(1, self.segments // DELETIONS), 0)

    def bound(self, total: np.ndarray) -> np.ndarray:
        """The largest symmetric difference of linked sets whose sizes add up to total."""
        return (100 - self.percent) * total // (100 + self.percent)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, side="right") - 1

    def largest_partner(self, sizes: np.ndarray) -> np.ndarray:
        return 100 * sizes // self.percent


def _cost(n: np.ndarray) -> np.ndarray:
    """What asking with a segment of n elements costs in false partners: falls steeply with n."""
    return np.where(n == 0, 1000.0, 30.0 / np.maximum(n, 1) ** 1.5)


def signatures(h: np.ndarray, at: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, document index and role (_ASKS, _HAS) of every signature of the sets h[at[d]:at[d + 1]], each ascending."""
    sizes = np.diff(at)
    band = bands.of(np.maximum(sizes, 1))
    partner = bands.largest_partner(sizes)
    # sets so small that only equal ones link need no signature
    live = (sizes > 0) & (bands.bound(sizes + partner) > 0)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h, out=sums[1:])
    top = bands.of(np.maximum(partner, 1))
    for ahead in range(int((top - band)[live].max(initial=-1)) + 1):
        docs = np.flatnonzero(live & (band + ahead <= top))
        if len(docs):
            out += _in_band(h, at, sums, docs, band[docs] + ahead, ahead == 0, bands)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint16)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _in_band(h, at, sums, docs, band, own, bands):  # noqa: ANN001, ANN202
    sizes = at[docs + 1] - at[docs]
    m, b = bands.segments[band], bands.deleted[band]
    units = bands.bound(sizes + np.minimum(bands.largest_partner(sizes), bands.high[band])) + 1
    base = np.concatenate([[0], np.cumsum(m)])
    # elements of the chosen documents, each with its document's place and its segment
    place = np.repeat(np.arange(len(docs)), sizes)
    at_element = np.arange(len(place)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(at[docs], sizes)
    values = h[at_element]
    segment = (((values >> np.uint64(32)) * m[place].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    slot = base[place] + segment
    n = np.bincount(slot, minlength=base[-1])
    # elements ascend, so a segment's are neighbours
    ends = np.repeat(at[docs], m) + (np.cumsum(n) - np.repeat(np.concatenate([[0], np.cumsum(sizes)])[:-1], m))
    total = sums[ends] - sums[ends - n]
    doc = np.repeat(np.arange(len(docs)), m)
    number = np.arange(base[-1]) - base[doc]
    salt = mix(number.astype(np.uint64) * _SALT[0] + band[doc].astype(np.uint64) * _SALT[1])
    deletes = number >= (m - b)[doc]
    # units: equality of every segment, then one difference in those with deletions
    cost = _cost(n)
    more = np.flatnonzero(deletes)
    unit_doc, unit_cost = np.concatenate([doc, doc[more]]), np.concatenate([cost, cost[more] + _cost(np.maximum(n[more] - 1, 0)) + 0.5])
    order = np.lexsort((unit_cost, unit_doc))
    rank = np.arange(len(order)) - np.repeat(np.cumsum(m + b) - (m + b), m + b)
    chosen = np.zeros(len(order), bool)
    chosen[order] = rank < units[unit_doc[order]]
    asks, asks_more = chosen[: len(doc)], np.zeros(len(doc), bool)
    asks_more[more] = chosen[len(doc) :]
    key = lambda x, s, deleted: mix(x + s + (_SALT[2] if deleted else np.uint64(0)))
    role = (asks * _ASKS + own * _HAS).astype(np.uint16)
    use = role > 0
    out = [(key(total[use], salt[use], False), docs[doc[use]], role[use])]
    if own:
        e = np.flatnonzero(deletes[slot])
        s = slot[e]
        out.append((key(total[s] - values[e], salt[s], True), docs[doc[s]], np.full(len(e), _HAS, np.uint16)))
    e = np.flatnonzero(asks_more[slot])
    s, k = slot[e], np.flatnonzero(asks_more)
    out.append((key(total[s] - values[e], salt[s], False), docs[doc[s]], np.full(len(e), _ASKS, np.uint16)))
    out.append((key(total[k], salt[k], True), docs[doc[k]], np.full(len(k), _ASKS, np.uint16)))
    return out


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, two longs that tell sets apart."""
    python_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, at = shingle_sets(b.column("text"), n)
            s1, s2 = (np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]) for x in (mix(h), mix(h ^ _SALT[0])))
            cols = [np.diff(at), (s1[at[1:]] - s1[at[:-1]]).view(np.int64), (s2[at[1:]] - s2[at[:-1]]).view(np.int64)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, cols)], ["doc_id", "n_shingles", "d1", "d2"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long")


def _proposals(docs: DataFrame, n: int, percent: int, top: int) -> DataFrame:
    """Groups of sets that share a signature: signature, head (the least that asks), other, role and size of the group."""
    buckets = 4 * parts(docs)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent, 100 * max(top, 1) // percent + 1)
        held: list[tuple] = []
        n_docs = n_keys = 0

        def flush() -> pa.RecordBatch:
            keys, ids, roles = (np.concatenate(x) for x in zip(*[h[:3] for h in held], strict=True))
            names = np.concatenate([h[3] for h in held])
            to = ((keys >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
            order = np.argsort(to, kind="stable")
            cut = np.searchsorted(to[order], np.arange(buckets + 1))
            keys, refs = keys[order], (ids.astype(np.uint16) | roles)[order]
            some = [k for k in range(buckets) if cut[k + 1] > cut[k]]
            low, mid = (keys & np.uint64(0xFFFFFFFF)).astype("<u4"), ((keys >> np.uint64(32)) & np.uint64(0xFFFF)).astype("<u2")
            part = lambda x: pa.array([x[cut[k] : cut[k + 1]].tobytes() for k in some], pa.binary())
            # ids ascend for the most part, so their steps are small
            name = zlib.compress(np.diff(names, prepend=0).astype("<i8").tobytes(), 1)
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), part(low), part(mid), part(refs.astype("<u2")), pa.array([name] * len(some), pa.binary())], ["bucket", "low", "mid", "refs", "ids"])

        for b in batches:
            h, at = shingle_sets(b.column("text"), n)
            ids = b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for lo in range(0, len(ids), 500):
                hi = min(lo + 500, len(ids))
                keys, d, roles = signatures(h[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], bands)
                if held and n_docs + hi - lo > FLUSH_DOCS:
                    yield flush()
                    held, n_docs, n_keys = [], 0, 0
                held.append((keys, d + n_docs, roles, ids[lo:hi]))
                n_docs, n_keys = n_docs + hi - lo, n_keys + len(keys)
                if n_keys > FLUSH_KEYS:
                    yield flush()
                    held, n_docs, n_keys = [], 0, 0
        if held:
            yield flush()

    packed = docs.mapInArrow(pack, "bucket int, low binary, mid binary, refs binary, ids binary")
    names = ["signature", "head", "other", "asks", "has", "size"]

    def meet(t: pa.Table) -> pa.Table:
        got: list[tuple] = []
        for r in t.to_batches():
            for low, mid, refs, ids in zip(*(r.column(c) for c in ("low", "mid", "refs", "ids")), strict=True):
                low, mid, refs = (np.frombuffer(x.as_buffer(), k) for x, k in ((low, "<u4"), (mid, "<u2"), (refs, "<u2")))
                doc = np.cumsum(np.frombuffer(zlib.decompress(ids.as_py()), "<i8"))[refs & (_ASKS - 1)]
                got.append((low.astype(np.uint64) | (mid.astype(np.uint64) << np.uint64(32)), doc, refs & (_ASKS | _HAS)))
        key, doc, role = (np.concatenate(x) for x in zip(*got, strict=True))
        got.clear()
        order = np.argsort(key, kind="stable")
        key = key[order]
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = key[1:] == key[:-1]
        shared = np.flatnonzero(same[1:] | same[:-1])
        order, key = order[shared], key[shared]
        doc, role = doc[order], role[order]
        order = np.lexsort((doc, (role & _ASKS) == 0, key))
        key, doc, role = key[order], doc[order], role[order]
        start = np.ones(len(key), bool)
        start[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(start)
        sizes = np.diff(np.concatenate([first, [len(key)]]))
        head, asked = np.repeat(doc[first], sizes), np.repeat((role[first] & _ASKS) > 0, sizes)
        size = np.repeat(sizes, sizes)
        ok = asked & (doc != head)
        cols = [key[ok].view(np.int64), head[ok], doc[ok], (role[ok] & _ASKS) > 0, (role[ok] & _HAS) > 0, size[ok].astype(np.int32)]
        return pa.Table.from_arrays(list(map(pa.array, cols)), names)

    spread = packed.groupBy("bucket").applyInArrow(meet, "signature long, head long, other long, asks boolean, has boolean, size int")
    return spread


def _sets_of(docs: DataFrame, ids: DataFrame, n: int, name: str) -> DataFrame:
    """name (an id), h_<name> (the set's hashes) of the documents with those ids; texts are read, not sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, at = shingle_sets(b.column("text"), n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([h[at[i] : at[i + 1]].tobytes() for i in range(len(at) - 1)], pa.binary())], [name, f"h_{name}"])

    texts = docs.join(maybe_broadcast(ids.withColumnRenamed(name, "doc_id"), BROADCAST_IDS), "doc_id", "left_semi")
    return texts.mapInArrow(run, f"{name} long, h_{name} binary")


def _verified(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) with ok: whether their sets link. Only sets that are in a pair are made, and those of b are sent to
    a's place once a pair."""
    pairs = staged(pairs.select("a", "b"), "pairs")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("h_a"), b.column("h_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                if 100 * len(small) < percent * len(large) or not len(small):
                    ok.append(False)
                    continue
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    theirs = _sets_of(docs, pairs.select("b").distinct(), n, "b").join(maybe_broadcast(pairs, BROADCAST_IDS), "b")
    both = theirs.join(_sets_of(docs, pairs.select("a").distinct(), n, "a"), "a")
    out = staged(both.select("a", "b", "h_a", "h_b").mapInArrow(compare, "a long, b long, ok boolean"), "verified")
    discard(pairs)
    return out


def _width(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Cells of a histogram: a power of two, four times the bound for two such sets, so that few differences cancel."""
    bound = (100 - percent) * 2 * sizes // (100 + percent)
    return np.maximum(128, 1 << np.ceil(np.log2(np.maximum(4 * bound, 1))).astype(np.int64))


def _histograms(docs: DataFrame, ids: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, cells (counts up to 255)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, at = shingle_sets(b.column("text"), n)
            sizes = np.diff(at)
            cells = []
            for k, w in enumerate(_width(sizes, percent)):
                place = (h[at[k] : at[k + 1]] >> np.uint64(64 - int(w).bit_length() + 1)).astype(np.int64)
                cells.append(np.minimum(np.bincount(place, minlength=w), 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes), pa.array(cells, pa.binary())], ["doc_id", "n_shingles", "cells"])

    texts = docs.join(maybe_broadcast(ids, BROADCAST_IDS), "doc_id", "left_semi")
    return texts.mapInArrow(run, "doc_id long, n_shingles long, cells binary")


def close_pairs(component: np.ndarray, sizes: np.ndarray, cells: list[bytes], asks: np.ndarray, has: np.ndarray, block: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs (one asks, the other has) of different components that may link by their histograms; of two
    blocks only the pairs between them."""
    width = min(map(len, cells))
    rows = [np.frombuffer(c, np.uint8) for c in cells]
    # wider histograms are folded; sums may pass 255
    table = np.stack([r if len(r) == width else np.minimum(r.reshape(width, -1).sum(1, dtype=np.uint16), 255).astype(np.uint8) for r in rows])
    left, right = [], []
    owners = np.flatnonzero(has)
    held = table[owners]
    two = block.min() != block.max()
    for i in np.flatnonzero(asks):
        ok = component[owners] != component[i]
        if two:
            ok &= block[owners] != block[i]
        small, large = np.minimum(sizes[owners], sizes[i]), np.maximum(sizes[owners], sizes[i])
        ok &= 100 * small >= percent * large
        k = np.flatnonzero(ok)
        if len(k):
            x = held[k]
            apart = (np.maximum(x, table[i]) - np.minimum(x, table[i])).sum(1, dtype=np.int64)
            k = k[apart <= (100 - percent) * (sizes[owners[k]] + sizes[i]) // (100 + percent)]
            left.append(np.full(len(k), i))
            right.append(owners[k])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _in_blocks(rows: DataFrame, group: str, member: str, blocks: DataFrame) -> DataFrame:
    """rows with block, i, j: in a group of several blocks (blocks: group, blocks) a row goes to all pairs (i <= j) of its
    block with another, so each pair of members meets in one place and no place holds more than two blocks."""
    rows = rows.join(maybe_broadcast(blocks.filter("blocks > 1"), BROADCAST_IDS), group, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(11), member), F.col("blocks")))
    rows = rows.withColumn("other_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks").cast("bigint") - 1)))
    return rows.withColumns({"i": F.least("block", "other_block"), "j": F.greatest("block", "other_block")}).drop("other_block")


def _groups(*keys: np.ndarray) -> list[np.ndarray]:
    """Places of rows with equal keys."""
    order = np.lexsort(keys[::-1])
    changes = np.zeros(max(len(order) - 1, 0), bool)
    for k in keys:
        changes |= np.diff(k[order]) != 0
    return np.split(order, np.flatnonzero(changes) + 1) if len(order) else []


def _cross(docs: DataFrame, inside: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs a, b left to try in groups with a failed proposal. Rows: head, other, asks, has, component.

    Groups with one head are taken as one (their pairs are among its pairs), in blocks of about BLOCK_SETS sets.
    """
    cells = _histograms(docs, inside.select(F.col("other").alias("doc_id")).distinct(), n, percent)
    blocks = inside.groupBy("head").agg(F.ceil(F.count("*") / BLOCK_SETS).alias("blocks"))
    spread = _in_blocks(inside, "head", "other", blocks)
    # single cells share a call, as many as the data need; those of large groups are dealt each by itself
    buckets = 4 * parts(docs)
    spread = spread.withColumn("bucket", F.when(F.col("blocks") > 1, F.xxhash64("head", "i", "j")).otherwise(F.pmod(F.xxhash64("head"), F.lit(buckets))))
    rows = spread.join(cells.withColumnRenamed("doc_id", "other"), "other")

    def run(t: pa.Table) -> pa.Table:
        head, other, component, sizes, block, i_, j_ = (t.column(c).to_numpy() for c in ("head", "other", "component", "n_shingles", "block", "i", "j"))
        asks, has = (t.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("asks", "has"))
        cells = t.column("cells").to_pylist()
        got = [np.zeros((0, 2), np.int64)]
        for k in _groups(head, i_, j_):
            i, j = close_pairs(component[k], sizes[k], [cells[x] for x in k], asks[k], has[k], block[k], percent)
            a, b = other[k[i]], other[k[j]]
            got.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0))
        pairs = np.unique(np.concatenate(got), axis=0)
        return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return rows.groupBy("bucket").applyInArrow(run, "a long, b long").distinct()


def common(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many codes each two of the sets codes[at[d]:at[d + 1]] share, as a square matrix (its diagonal means nothing).

    Codes in many sets are columns of a product of matrices; for those in few the pairs of sets are counted.
    """
    k = len(at) - 1
    out = np.zeros((k, k), np.int32)
    row = np.repeat(np.arange(k), np.diff(at))
    order = np.argsort(codes, kind="stable")
    code, row = codes[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    often = np.diff(np.concatenate([first, [len(code)]]))
    many = np.flatnonzero(often > FEW)
    for some in np.array_split(many, max(1, -(-len(many) * k // (1 << 24)))):
        if len(some):
            table = np.zeros((k, len(some)), np.float32)
            for c, f in enumerate(some):
                table[row[first[f] : first[f] + often[f]], c] = 1
            out += np.rint(table @ table.T).astype(np.int32)
    for f in range(2, FEW + 1):
        where = first[often == f]
        for some in np.array_split(where, max(1, -(-len(where) * f * f // (1 << 22)))):
            if len(some):
                sets = row[some[:, None] + np.arange(f)]
                pair = (sets[:, :, None] * k + sets[:, None, :]).ravel()
                if len(pair) * 8 < k * k:
                    where_, times = np.unique(pair, return_counts=True)
                    out.ravel()[where_] += times.astype(np.int32)
                else:
                    out += np.bincount(pair, minlength=k * k).reshape(k, k).astype(np.int32)
    return out


def linked(codes: np.ndarray, at: np.ndarray, block: np.ndarray, percent: int) -> np.ndarray:
    """Which sets link, as a square matrix; of two blocks only links between them."""
    sizes = np.diff(at)
    both = common(codes, at)
    ok = (100 * both.astype(np.int64) >= percent * (sizes[:, None] + sizes[None, :] - both)) & (both > 0)
    np.fill_diagonal(ok, False)
    if len(block) and block.min() != block.max():
        ok &= block[:, None] != block[None, :]
    return ok


def _links(docs: DataFrame, label: DataFrame, sizes: DataFrame, n: int, percent: int, pairs: bool = False) -> DataFrame:
    """Inside each component of label (id, component): all links, by the words themselves.

    Per set and place: doc_id, root (a set that it is connected with there), links (how many sets it links with there); or
    with pairs the links a, b themselves. Components of a few sets share a call; large ones go in pairs of blocks, each of
    BLOCK_SETS sets and BLOCK_SHINGLES shingles at most, so memory is bounded and no pair leaves its place.
    """
    members = label.join(sizes, label["id"] == sizes["doc_id"]).select("doc_id", "component", "n_shingles")
    members = staged(members.groupBy("doc_id", "component").agg(F.sum("n_shingles").alias("n_shingles")), "members")
    weight = members.groupBy("component").agg(F.sum("n_shingles").alias("w"), F.count("*").alias("n"))
    blocks = weight.select("component", F.greatest(F.ceil(F.col("w") / BLOCK_SHINGLES), F.ceil(F.col("n") / BLOCK_SETS)).alias("blocks"))
    total = members.agg(F.sum("n_shingles")).first()[0] or 0
    shared = max(1, -(-total // BLOCK_SHINGLES))
    spread = _in_blocks(members.select("doc_id", "component"), "component", "doc_id", blocks)
    spread = spread.withColumn("cell", F.when(F.col("blocks") > 1, F.xxhash64("component", "i", "j")).otherwise(F.pmod(F.xxhash64("component"), F.lit(shared))))
    spread = staged(spread.select("doc_id", "component", "block", "i", "j", "cell"), "member-cells")
    rows = docs.join(maybe_broadcast(spread, BROADCAST_IDS), "doc_id").select("doc_id", "text", "component", "block", "i", "j", "cell")

    def run(t: pa.Table) -> pa.Table:
        doc, component, block, i_, j_ = (t.column(c).to_numpy() for c in ("doc_id", "component", "block", "i", "j"))
        codes, at = exact_sets(t.column("text"), n)
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
        for k in _groups(component, i_, j_):
            some = np.concatenate([codes[at[x] : at[x + 1]] for x in k])
            ok = linked(some, np.concatenate([[0], np.cumsum([at[x + 1] - at[x] for x in k])]), block[k], percent)
            names, node = np.unique(doc[k], return_inverse=True)
            if len(names) < len(k):  # rows of one id are one node
                wide = np.zeros((len(names), len(k)), np.int32)
                np.add.at(wide, node, ok)
                whole = np.zeros((len(names), len(names)), np.int32)
                np.add.at(whole, node, wide.T)
                ok = whole > 0
                np.fill_diagonal(ok, False)
            else:
                order = np.argsort(doc[k])
                ok = ok[np.ix_(order, order)]
            if pairs:
                a, b = np.nonzero(np.triu(ok))
                out.append((names[a], names[b], np.ones(len(a), np.int64)))
                continue
            root = np.arange(len(names))
            while True:
                low = np.minimum(root, np.where(ok, root[None, :], len(names)).min(1, initial=len(names)))
                low = low[low]
                if (low == root).all():
                    break
                root = low
            out.append((names, names[root], ok.sum(1)))
        a, b, m = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.Table.from_arrays([pa.array(a), pa.array(b), pa.array(m, pa.int64())], ["doc_id", "root", "links"])

    return rows.groupBy("cell").applyInArrow(run, "doc_id long, root long, links long")


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components."""
    of = lambda c: label.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")


def _related(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sets (doc_id, n_shingles), copies (doc_id, class_id: the least id with the same set, another one), and components
    that hold every link between different sets (id, component)."""
    sets = staged(_sets(docs, n), "shingle-sets")
    nodes = sets.filter("n_shingles > 0 and doc_id is not null")
    top = nodes.agg(F.max("n_shingles")).first()[0] or 0
    equal = staged(nodes.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies")), "set-classes")
    member = nodes.join(equal.filter("copies > 1"), ["n_shingles", "d1", "d2"]).filter("doc_id != class_id").select("doc_id", "class_id")
    copies = staged(member.distinct(), "set-copies")
    discard(equal)
    # ids whose rows have different sets stay, whatever one of their rows is a copy of
    digest = F.struct("n_shingles", "d1", "d2")
    mixed = nodes.groupBy("doc_id").agg(F.min(digest).alias("a"), F.max(digest).alias("b")).filter("a != b").select("doc_id")
    gone = copies.select("doc_id").distinct().join(mixed, "doc_id", "left_anti")
    alone = docs.filter("doc_id is not null").join(maybe_broadcast(staged(gone, "folded"), BROADCAST_IDS), "doc_id", "left_anti")
    groups = staged(_proposals(alone, n, percent, top), "proposals")
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    # first the least head of each set; then what is left of the proposals; then the rest of groups with a failed one
    first = groups.groupBy("other").agg(F.min("head").alias("head")).select(*pair("head", "other")).distinct()
    tried = _verified(docs, first, n, percent)
    linked = tried.filter("ok")
    label = components(linked)
    rest = _apart(groups.select(*pair("head", "other")).distinct(), label).join(tried, ["a", "b"], "left_anti")
    again = _verified(docs, rest, n, percent)
    linked = linked.unionAll(again.filter("ok"))
    label = components(linked)
    failed = _apart(tried.unionAll(again).filter("not ok").select("a", "b"), label)
    large = groups.filter("size > 2")
    broken = large.select("signature", "head", *pair("head", "other")).join(failed, ["a", "b"], "left_semi").select("signature", "head").distinct()
    inside = large.join(broken, ["signature", "head"], "left_semi").groupBy("head", "other").agg(F.max("asks").alias("asks"), F.max("has").alias("has"))
    inside = staged(inside, "broken-groups")
    if not inside.isEmpty():
        of = inside.join(label.select(F.col("id").alias("other"), "component"), "other", "left").withColumn("component", F.coalesce("component", "other"))
        cross = _cross(docs, staged(of, "labelled-groups"), n, percent)
        last = _verified(docs, cross.join(tried.unionAll(again), ["a", "b"], "left_anti"), n, percent)
        label = components(linked.unionAll(last.filter("ok")))
    discard(groups, inside)
    return sets, copies, label


def jaccard_components(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, n_shingles, component_id, class_id (least id with the same set),
    n_links (how many other sets its set links with)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sets, copies, label = _related(docs, n, percent)
    sizes = sets.filter("n_shingles > 0").select("doc_id", "n_shingles")
    exact = staged(_links(docs, label, sizes, n, percent), "links-of-sets")
    edges = exact.filter("root != doc_id").select(F.col("doc_id").alias("a"), F.col("root").alias("b"))
    label = components(edges.unionAll(copies.select(F.col("class_id").alias("a"), F.col("doc_id").alias("b"))))
    counted = exact.groupBy(F.col("doc_id").alias("class_id")).agg(F.sum("links").alias("n_links"))
    own = copies.groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    known = label.withColumnRenamed("id", "doc_id").join(own, "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    known = known.join(counted, "class_id", "left")
    out = sets.join(known, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def jaccard_links(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """a, b: every link between different sets, each set as its least doc_id (class_id in jaccard_components)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sets, _, label = _related(docs, n, percent)
    found = _links(docs, label, sets.filter("n_shingles > 0").select("doc_id", "n_shingles"), n, percent, pairs=True)
    return found.select(F.col("doc_id").alias("a"), F.col("root").alias("b"))


def keep_one(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component (that of the least id).

    Rows of one id are one document: they stay or go together, and of rows with the same id and text one stays.
    """
    found = jaccard_components(docs, n, percent)
    gone = staged(found.filter("doc_id != component_id").select("doc_id").distinct(), "near-copies")
    kept = docs.join(maybe_broadcast(gone, BROADCAST_IDS), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    twice = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    return kept if twice.isEmpty() else kept.filter("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(kept.filter("doc_id is null"))

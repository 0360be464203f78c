import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from skein.llm import packing
from skein.llm.common import table
from tests.llm.helpers import docs


def plain(lengths, sources, clusters, capacity):
    pieces = [(min(capacity, n - b), r, p) for r, n in enumerate(lengths) for p, b in enumerate(range(0, n, capacity))]
    pieces.sort(key=lambda x: (-x[0], x[1], x[2]))
    bins, out = [], {}
    for n, r, p in pieces:
        fit = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= n and sources[r] not in b["s"] and clusters[r] not in b["c"]]
        if fit:
            k = min(fit)[1]
        else:
            bins.append({"room": capacity, "s": set(), "c": set()})
            k = len(bins) - 1
        out[r, p] = (bins[k]["room"], n)
        bins[k]["room"] -= n
        bins[k]["s"].add(sources[r])
        bins[k]["c"].add(clusters[r])
    return len(bins), out


@pytest.mark.parametrize("seed", range(8))
def test_tightest_compatible_bin(seed):
    rng = random.Random(seed)
    n = rng.choice([1, 5, 300, 900])
    lengths = np.array([rng.choice([0, 1, 3, 50, 99, 100, 101, 250, rng.randrange(100)]) for _ in range(n)])
    sources = np.array([rng.choice([0, 0, rng.randrange(70)]) for _ in range(n)])
    clusters = np.array([rng.randrange(200) for _ in range(n)])
    got = packing.pack_shard(lengths, sources, clusters, 100)
    count, want = plain(lengths.tolist(), sources.tolist(), clusters.tolist(), 100)
    assert len({g[4] for g in got if g[4] is not None}) == count
    assert {(g[0], g[1]): (100 - g[5], g[3]) for g in got if g[3]} == want


def valid(out, d, capacity):
    bins, size = {}, {r.doc_id: (len((r.text or "").encode()), r.source) for r in d.collect()}
    done = {}
    for r in out:
        done.setdefault(r.doc_id, []).append((r.begin, r.length))
        if r.bin is not None:
            bins.setdefault((r.shard, r.bin), []).append(r)
    for k, parts in done.items():
        at = 0
        for b, n in sorted(parts):
            assert b == at
            at += n
        assert at == size[k][0]
    for rs in bins.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.at):
            assert r.at == at
            at += r.length
        assert at <= capacity and len({size[r.doc_id][1] for r in rs}) == len(rs)
    assert done.keys() == size.keys()


def test_table(spark, sf):
    d = table(spark, sf, "documents")
    valid(packing.pack(d, shard_rows=64).collect(), d, packing.CAPACITY)


def test_corner_cases(spark):
    d = docs(spark, [None, "", "x" * 20_000, "é" * 10, "same text", "Same  text"])
    out = packing.pack(d).collect()
    valid(out, d, packing.CAPACITY)
    assert [r.bin for r in out if r.doc_id in (0, 1)] == [None, None] and packing.pack(docs(spark, [])).count() == 0
    odd = d.unionAll(d).unionAll(spark.createDataFrame([(None, "t", None, None, None)], d.schema))
    assert packing.pack(odd).filter("doc_id is null").collect()[0].length == 1


def test_equal_rows_spread_and_nothing_is_wrong(spark):
    d = docs(spark, ["some text here", None, "x" * 20_000]).withColumn("n_chars", F.lit(None).cast("long"))
    many = d.unionAll(docs(spark, ["t " * 300]).withColumn("doc_id", F.lit(None).cast("long")).crossJoin(spark.range(300)).drop("id"))
    packed = packing.pack(many, shard_rows=50)
    rows_ = packed.collect()
    assert len(rows_) == 2 + 3 + 300 and len({r.shard for r in rows_ if r.doc_id is None}) > 3
    assert all(r.faults == 0 for r in packing.audit(packing.pack(d)).collect())

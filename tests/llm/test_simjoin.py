import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import simjoin
from skein.llm.common import table
from skein.llm.graph import components
from skein.llm.shingles import exact_sets, shingle_sets
from tests.llm.helpers import docs, rows

SPACE = " \t\n\x0b\x0c\r"


def plain_set(text, n=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in SPACE[1:]:
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def expected(pairs, n=4, percent=85):
    sets = [(d, plain_set(t, n)) for d, t in pairs]
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    where = {}
    for k, (d, s) in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(k)
    for k, (d, s) in enumerate(sets):
        shared = {}
        for x in s:
            for j in where[x]:
                if j > k:
                    shared[j] = shared.get(j, 0) + 1
        for j, both in shared.items():
            if 100 * both >= percent * (len(s) + len(sets[j][1]) - both):
                a, b = root(d), root(sets[j][0])
                up[max(a, b)] = min(a, b)
    return {d: (len(s), root(d)) for d, s in sets}


def check(d, n=4, percent=85):
    got = {k: (r["n_shingles"], r["component_id"]) for k, r in rows(simjoin.jaccard_components(d, n, percent)).items()}
    assert got == expected(sorted((r.doc_id, r.text) for r in d.collect()), n, percent)


def test_sets():
    texts = ["", None, "a", "a b c", "A b\tC\nd", "a b c d e a b c d e", "é ç é ç é", "x" * 5000 + " y z w", " \x0b ", "a b c d e"]
    h, at = shingle_sets(pa.array(texts), 4)
    assert list(np.diff(at)) == [len(plain_set(t)) for t in texts]
    again, _ = shingle_sets(pa.array(["pad pad", "a b c d"]), 4)
    assert h[at[4]] == again[-1]


def family(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        k = rng.randrange(len(w))
        w[k] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_chains_and_families(spark):
    rng = random.Random(5)
    texts = [None, "", "one two", "one two", "ONE two", "one  two\n", "a b c d", "a b c d e"]
    for size in (8, 15, 30, 60, 150, 400, 1500):
        base = [f"w{rng.randrange(400)}" for _ in range(size)]
        for k in range(25):
            if k % 5 == 4:
                base = family(rng, base, max(1, size // 60)).split()  # a chain: ends need not link
            texts.append(family(rng, base, rng.choice([0, 0, 1, 1, 2, size // 50, size // 20])))
            if k % 6 == 0:
                texts.append(" ".join(base[: -max(1, size // 12)]))  # shorter partners
    check(docs(spark, texts))


@pytest.mark.parametrize(("n", "percent"), [(5, 80), (2, 50)])
def test_other_parameters(spark, n, percent):
    rng = random.Random(n)
    texts = []
    for size in (3, 9, 14, 40, 120):
        base = [f"w{rng.randrange(90)}" for _ in range(size)]
        texts += [family(rng, base, rng.randrange(1 + size // 8)) for _ in range(15)]
    check(docs(spark, texts), n, percent)


def test_all_pairs_of_signatures_are_met():
    """Pigeonhole: any two sets that link share a signature that one asks with and the other has."""
    rng = np.random.default_rng(3)
    for size in [7, 8, 9, 12, 13, 20, 33, 47, 80, 200, 700] * 6:
        x = rng.integers(0, 2**64, size, np.uint64)
        changes = int(rng.integers(0, max(2, size // 12)))
        y = np.concatenate([x[changes:], rng.integers(0, 2**64, int(rng.integers(0, changes + 2)), np.uint64)])
        x, y = np.unique(x), np.unique(y)
        both = len(np.intersect1d(x, y))
        if 100 * both < 85 * (len(x) + len(y) - both):
            continue
        bands = simjoin.Bands(85, 2000)
        key, doc, role = simjoin.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), bands)
        part = lambda d, r: set(key[(doc == d) & ((role & r) > 0)].tolist())
        small, large = (0, 1) if len(x) <= len(y) else (1, 0)
        assert part(small, simjoin._ASKS) & part(large, simjoin._HAS) or np.array_equal(x, y)


def pairs_of(texts, n=4, percent=85):
    """Links between different sets, each named by its first place."""
    sets, first = [plain_set(t, n) for t in texts], {}
    for k, s in enumerate(sets):
        first.setdefault(frozenset(s), k)
    reps = [k for s, k in first.items() if s]
    return {(a, b) for a in reps for b in reps if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}, [first[frozenset(s)] if s else k for k, s in enumerate(sets)]


def test_every_link_is_counted(spark, monkeypatch):
    """Also where a group is dealt over many pairs of blocks."""
    rng = random.Random(8)
    texts = ["", None, "a b", "A  b"]
    for size in (12, 40, 90):
        base = [f"w{rng.randrange(300)}" for _ in range(size)]
        for k in range(30):
            texts.append(family(rng, base, rng.choice([0, 1, 1, 2, size // 15])))
            base = family(rng, base, 1).split() if k % 6 == 5 else base
    want, classes = pairs_of(texts)
    for sets, shingles in ((simjoin.BLOCK_SETS, simjoin.BLOCK_SHINGLES), (7, 10**6), (10**6, 300)):
        monkeypatch.setattr(simjoin, "BLOCK_SETS", sets)
        monkeypatch.setattr(simjoin, "BLOCK_SHINGLES", shingles)
        d = docs(spark, texts)
        got = rows(simjoin.jaccard_components(d))
        assert [got[k]["class_id"] for k in range(len(texts))] == classes
        assert all(got[k]["n_links"] == sum(classes[k] in p for p in want) for k in range(len(texts)))
        assert [got[k]["component_id"] for k in range(len(texts))] == [expected(list(enumerate(texts)))[k][1] for k in range(len(texts))]
    links = [(r.a, r.b) for r in simjoin.jaccard_links(d).collect()]
    assert set(links) == want and len(links) == len(want)


def test_common_counts():
    rng = np.random.default_rng(2)
    for k, n, most in ((1, 5, 9), (40, 30, 60), (60, 8, 1000), (30, 0, 5)):
        sets = [np.unique(rng.integers(0, most, n)) for _ in range(k)]
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
        got = simjoin.common(np.concatenate([np.zeros(0, np.int64), *sets]), at)
        assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(k) for j in range(k) if i != j)


def test_words_that_polynomials_confuse(spark):
    t = [0]
    while len(t) < 4096:
        t += [1 - x for x in t]
    texts = ["".join("ab"[x] for x in t), "".join("ba"[x] for x in t)]
    got = rows(simjoin.jaccard_components(docs(spark, [*texts, *(f"{x} y z w" for x in texts)])))
    assert all(r["component_id"] == k and r["n_links"] == 0 for k, r in got.items())


def test_exact_sets():
    texts = ["a b c d e a b c d e", "a b", "A  b", "b c d e", None, "", "é É", "x " * 4000, "e a b c\x0bd", "a b c"]
    codes, at = exact_sets(pa.array(texts), 4)
    sets = [set(codes[at[k] : at[k + 1]].tolist()) for k in range(len(texts))]
    plain = [plain_set(t) for t in texts]
    assert all(len(x) == len(y) for x, y in zip(sets, plain, strict=True))
    assert all(len(sets[i] & sets[j]) == len(plain[i] & plain[j]) for i in range(len(texts)) for j in range(len(texts)))


def test_rows_of_one_id(spark):
    """Each row's links count, whatever another row of its id is a copy of; different texts of an id stay together."""
    long = [" ".join(f"{x}{i}" for i in range(40)) for x in "pqr"]
    d = docs(spark, [long[0], long[0], long[1], long[1] + " end", long[2]]).withColumn("doc_id", F.element_at(F.array(*map(F.lit, (0, 5, 5, 8, 9))), F.col("doc_id").cast("int") + 1).cast("long"))
    got = {(r.doc_id, r.component_id) for r in simjoin.jaccard_components(d).collect()}
    assert got == {(0, 0), (5, 0), (8, 0), (9, 9)}
    alone = d.filter("doc_id in (5, 9)").unionAll(d.filter("doc_id = 9"))
    assert sorted(r.doc_id for r in simjoin.keep_one(alone).collect()) == [5, 5, 9]


def test_table(spark):
    check(table(spark, "/root/testdata/sf0.01", "documents"))


def test_empty_null_repeated(spark):
    assert simjoin.jaccard_components(docs(spark, [])).count() == 0
    d = docs(spark, ["a b c d e", "x"]).unionAll(docs(spark, ["a b c d e"])).unionAll(spark.createDataFrame([(None, "x", "en", "s", 1)], docs(spark, []).schema))
    got = simjoin.jaccard_components(d).collect()
    assert len(got) == 4 and sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in got if r.doc_id is not None) == [(False, 0, 0), (False, 0, 0), (False, 1, 1)]
    assert sorted(r.doc_id is None for r in simjoin.keep_one(d).collect()) == [False, False, True]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 502)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[502] == 500


def test_keep_one(spark):
    d = docs(spark, ["a b c d e f", "A b c d e f", "g h i j k", ""])
    kept = simjoin.keep_one(d)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3] and kept.columns == d.columns

import heapq
import math
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import search
from skein.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(FOLD))


def plain(docs, items, top=20):
    """Every document scored for every item."""
    texts = [(k, Counter(split(t))) for k, t in docs]
    n_docs, n_words = sum(bool(c) for _, c in texts), sum(c.total() for _, c in texts)
    df = Counter(w for _, c in texts for w in c)
    out = []
    for item, text in dict.fromkeys(items):
        asked, scored = split(text), []
        for k, c in texts:
            score = 0
            for w in asked:
                if c[w]:
                    m = 75 + (25 * c.total() * n_docs) // n_words
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 12 * m))
            if score > 0:
                scored.append((-score, k is None, k or 0))
        out += [(item, i + 1, None if none else k, -s) for i, (s, none, k) in enumerate(sorted(scored)[:top])]
    return out


def check(spark, docs, items, **more):
    got = search.rank_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **more).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(plain(docs, items, more.get("top", 20)), key=key)
    return got


def test_tables(spark, sf):
    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
    check(spark, docs, items)


def test_small_blocks_and_query_blocks(spark, sf, monkeypatch):
    """The same with many ranges, nodes, blocks and rounds of queries."""
    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
    want = plain(docs, items, 5)
    for name, value in (("RANGE", 2), ("FAN", 3), ("CELLS", 1), ("POSTINGS", 900), ("QUERY_WORDS", 40)):
        monkeypatch.setattr(search, name, value)
    d, q = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)
    assert sorted(map(tuple, search.rank_documents(d, q, top=5).collect())) == sorted(want)


def test_words():
    for text in ("", None, "A-b_c9 Été\x00x\x7fß", "日本 語😀A", "ÀÉ Z[z]`{|}~", "İ ſ K"):
        assert [w.decode() for w in search.words_of(text)] == split(text)


def test_odd_rows(spark):
    docs = [(1, "apple pie"), (2, "Apple apple"), (2, "Apple apple"), (3, None), (4, ""), (5, "..."), (None, "apple"), (7, "pear"), (8, "word " * 200_000 + "apple")]
    items = [(1, "apple"), (1, "apple"), (1, "pear pear"), (2, None), (None, "pie apple"), (3, "unknown"), (4, "")]
    got = check(spark, docs, items)
    assert [r.doc_id for r in got if r.item_id == 1 and r.score == max(x.score for x in got if x.item_id == 1)] == [7]
    assert check(spark, [], items) == [] and check(spark, docs, []) == []
    wide = spark.createDataFrame([(1, "a b", 3, 4)], "doc_id long, text string, rank int, `score.x` int")
    assert search.rank_documents(wide, spark.createDataFrame([(5, "a", 1)], "item_id long, text string, score int")).columns == ["item_id", "rank", "doc_id", "score"]


def test_ties_in_any_order(spark):
    """A large group of copies: the least keys win, wherever they stand."""
    docs = [(k, "same text here" if k % 3 else f"other {k}") for k in range(900, 0, -1)]
    got = check(spark, docs, [(1, "same here"), (2, "other")], top=7)
    assert [r.doc_id for r in sorted(got, key=lambda r: (r.item_id, r.rank)) if r.item_id == 1] == [1, 2, 4, 5, 7, 8, 10]


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_tree_equals_scan(data):
    n, terms = data.draw(st.integers(1, 400)), 6
    rng = np.random.default_rng(data.draw(st.integers(0, 9999)))
    held = [np.sort(rng.choice(terms, rng.integers(0, terms), replace=False)) for _ in range(n)]
    starts = np.concatenate([[0], np.cumsum([len(h) for h in held])])
    flat, keys = np.concatenate(held).astype(np.int64), rng.permutation(n)
    adds = rng.integers(0, 4, len(flat))
    asked, times = np.array([0, 2, 5]), np.array([1, 2, 1])
    best = []
    opened = search.Tree(keys, starts, flat, adds, terms).search(asked, times, best, 4, 0)
    weights = np.zeros(terms, np.int64)
    weights[asked] = times
    scores = [int((weights[flat[a:b]] * adds[a:b]).sum()) for a, b in zip(starts, starts[1:], strict=False)]
    assert sorted(best) == sorted(heapq.nlargest(4, ((s, -int(k), i) for i, (s, k) in enumerate(zip(scores, keys, strict=True)) if s)))
    assert opened <= -(-n // search.RANGE)


def test_bounds_spare_work():
    """One document far above the rest: only its range, and those that tie with the last, are opened."""
    n = 64 * 200
    terms, adds = np.zeros(n, np.int64), np.ones(n, np.int64)
    adds[5_000:5_020] = 9
    best = []
    assert search.Tree(np.arange(n), np.arange(n + 1), terms, adds, 1).search(np.array([0]), np.array([1]), best, 20, 0) == 1
    assert sorted(-k for _, k, _ in best) == list(range(5_000, 5_020))

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from skein.llm import decontaminate as dc
from skein.llm.common import small_enough, table
from tests.llm.helpers import docs, rows


def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def bag(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def expected(pairs, items):
    """The best similarity of any window as long as the item, where it reaches 0.8."""
    out = {}
    bags = {i: (len(words(t)), bag(words(t))) for i, t in items if len(words(t)) >= 5}
    where = {}
    for i, (_, b) in bags.items():
        for s in b:
            where.setdefault(s, set()).add(i)
    for d, t in pairs:
        w = words(t)
        near = {i for k in range(len(w) - 4) for i in where.get(tuple(w[k : k + 5]), ())}
        for i in near:
            n, b = bags[i]
            for k in range(max(1, len(w) - n + 1)):
                x = bag(w[k : k + n])
                both = sum((x & b).values())
                sim = both / (sum(x.values()) + sum(b.values()) - both)
                if sim >= 0.8:
                    out[d, i] = max(out.get((d, i), 0), sim)
    return out


def check(d, b):
    got = {(r.doc_id, r.item_id): r.similarity for r in dc.find_leaks(d, b).collect()}
    want = expected([(r.doc_id, r.text) for r in d.collect() if r.doc_id is not None], [(r.item_id, r.text) for r in b.collect()])
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    return got


def test_tables(spark):
    assert check(table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "benchmark"))


def test_edited_passages(spark):
    base = [f"w{i}" for i in range(60)]
    items = spark.createDataFrame([(1, " ".join(base)), (2, "short one"), (3, None), (4, "a b c d e a b c d e a b c d e"), (5, "")], "item_id long, text string")
    one = [*base[:30], "other", *base[31:]]
    more = [*base[:30], "and", "more", *base[30:]]
    far = [x if i % 6 else "z" for i, x in enumerate(base)]
    texts = ["x " * 50 + " ".join(base) + " y" * 9, " ".join(one), "p q. " + " ".join(more) + " r", " ".join(far), " ".join(base[:50]), " ".join(base).upper().replace(" ", ", "), None, "", "a b c d e a b c d e a b c d e f", "a b c d e f g", "short one", "w1 w2 w3 w4 w5"]
    got = check(docs(spark, texts), items)
    assert {(0, 1), (1, 1), (2, 1), (5, 1), (8, 4)} <= got.keys() and (3, 1) not in got


def test_reordered_inserted_and_doubled_passages(spark):
    """Every window counts, wherever in the item its shingles stand and however often."""
    a, b, c = ([f"{x}{i}" for i in range(60)] for x in "abc")
    junk = [f"j{i}" for i in range(200)]
    items = spark.createDataFrame([(1, " ".join(a + b)), (2, " ".join(c)), (3, " ".join(c[:30] * 2)), (3, " ".join(a[:40])), (4, " ".join(a[:25] + b[:25]))], "item_id long, text string")
    texts = [[*junk, *b, *a, *junk], [*junk, *a[:30], "in", *a[30:], *b], [*c, *c], [*c[:30], *c[:30], *c[:30]], [*b[30:], *a, *b[:30]], [*a[:20], *b[:25], *a[20:25]], [*junk * 300, *b, *a, "end"], [*c[20:], *c[:20]]]
    d = docs(spark, [" ".join(t) for t in texts])
    got = {(r.doc_id, r.item_id): r.similarity for r in dc.find_leaks(d, items).collect()}
    want = {}
    for k in (1, 2, 3, 4):  # an id with two texts counts with the better one
        for r in items.filter(f"item_id = {k}").collect():
            for key, v in expected(list(enumerate(map(" ".join, texts))), [(k, r.text)]).items():
                want[key] = max(v, want.get(key, 0))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert {(0, 1), (1, 1), (2, 2), (3, 3), (6, 1), (7, 2)} <= got.keys() and abs(got[0, 1] - 112 / 120) < 1e-9


def test_rows_of_one_key(spark):
    """Texts of one key are searched each by itself."""
    item = [f"w{i}" for i in range(40)]
    b = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    d = docs(spark, ["x " * 9 + " ".join(item), " ".join(item[:20]) + " y" * 30, " ".join(item[20:]), " ".join(item)]).withColumn("doc_id", F.when(F.col("doc_id") == 3, 8).otherwise(7).cast("long"))
    assert sorted((r.doc_id, r.start, r.similarity) for r in dc.find_leaks(d, b).collect()) == [(7, 9, 1.0), (8, 0, 1.0)]


def test_fingerprints_are_majorities(spark):
    rng = random.Random(1)
    h = [rng.randrange(-(2**63), 2**63) for _ in range(700)]
    for per in (3, 2):
        sums = spark.createDataFrame([(h,)], "h array<long>").select(dc.votes(F.col("h"), per).alias("s"))
        for a, n in ((0, 1), (0, 6), (250, 17), (1, 600), (0, 700)):
            want = sum(((sum((v >> b) & 1 for v in h[a : a + n]) * 2 > n) << b) for b in range(64))
            assert sums.select(dc.simhash(F.col("s"), F.lit(a), F.lit(n), per).alias("x")).first().x % 2**64 == want


def test_radius_holds_the_similarity():
    """Sets of a similarity of 0.8 lie within the radius, all but a few in ten thousand."""
    rng = np.random.default_rng(0)
    for n in (9, 20, 45):
        m = n + 1
        both = -(-dc.LEAST * 2 * m // (100 + dc.LEAST))
        h = rng.integers(0, 2, (4000, 2 * m - both, 64), np.int8)
        x, y = (h[:, :m].sum(1) * 2 > m), (h[:, m - both :].sum(1) * 2 > m)
        assert ((x != y).sum(1) > dc.RADIUS).mean() < 0.002


def test_drop_and_corner_cases(spark):
    b = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    d = docs(spark, ["so one two three, four five six it is", "clean", None]).unionAll(spark.createDataFrame([(None, "one two three four five six", "en", "s", 1)], docs(spark, []).schema))
    kept = dc.drop_leaks(d, b)
    assert kept.columns == d.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 2), (True, 0)]
    assert dc.find_leaks(docs(spark, []), b).count() == 0 and dc.find_leaks(d, b.limit(0)).count() == 0
    assert dc.find_leaks(d.unionAll(d), b).count() == 1


def test_near_values_cover_the_radius():
    near = set(dc.near_values())
    assert all(bin(x).count("1") <= dc.RADIUS // dc.BLOCKS for x in near) and len(near) == sum(bin(x).count("1") <= dc.RADIUS // dc.BLOCKS for x in range(1 << dc.BITS // dc.BLOCKS))


def test_no_python(spark):
    d, b = docs(spark, ["one two three four five six"]), spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    plan = dc.find_leaks(d, b)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and rows(dc.find_leaks(d, b))


def test_sizes_are_checked_by_elements_too(spark):
    """A few rows with long arrays are no small table."""
    df = spark.range(3).select("id", F.sequence(F.lit(1), F.lit(100)).alias("a"))
    assert small_enough(df, 3) and not small_enough(df, 2)
    assert small_enough(df, 300, F.size("a")) and not small_enough(df, 299, F.size("a"))
    assert small_enough(df.filter("id < 0"), 0, F.size("a"))

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import exactdedup as ed
from skein.llm.common import table

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    """(key, keep_id, group_size, sha) of each row, by whole texts."""
    groups = {}
    for k, t in rows:
        groups.setdefault((t or "").translate(FOLD), []).append(k)
    low = lambda k: (k is not None, k or 0)
    out = []
    for k, t in rows:
        g = groups[(t or "").translate(FOLD)]
        out.append((k, max(g, key=low), len(g), hashlib.sha256((t or "").translate(FOLD).encode()).hexdigest()))
    return sorted(out, key=lambda r: (low(r[0]), r[3])), len(groups)


def check(df):
    want, groups = plain([tuple(r) for r in df.select("doc_id", "text").collect()])
    got = ed.report(df).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=lambda r: (r[0] is not None, r[0] or 0, r[3])) == want
    assert sum(r.kept for r in got) == groups and all(r.keep_id == r.doc_id for r in got if r.kept)
    kept = ed.dedup(df)
    assert kept.columns == df.columns and kept.count() == groups
    stays = {r[3]: r[1] for r in want}
    assert {(hashlib.sha256((r.text or "").translate(FOLD).encode()).hexdigest(), r.doc_id) for r in kept.collect()} == set(stays.items())


def test_odd_rows(spark):
    rows = [(1, "Abc"), (2, "aBC"), (3, "ÀB"), (4, "àb"), (5, "Àb"), (6, None), (7, ""), (8, " "), (9, "abc"), (9, "ABC"), (9, "ABC"), (None, "abc"), (None, "zz"), (None, "ZZ"), (10, "x" * 300_000), (11, "X" * 300_000), (12, "a\x00"), (13, "😀A"), (14, "😀a")]
    df = spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id long, text string, `fp.x` string")
    check(df)
    check(df.repartition(5))
    check(df.filter("false"))
    check(df.limit(1))


def test_table(spark, sf):
    df = table(spark, sf, "documents")
    want, groups = plain([tuple(r) for r in df.select("doc_id", "text").collect()])
    got = ed.report(df).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == groups and {r.doc_id for r in got if r.kept} == {k for _, k, _, _ in want}


def test_equal_fingerprints_of_different_texts(spark, monkeypatch):
    """With fingerprints of two bits all rests on the bytes."""
    real = ed.fingerprint
    monkeypatch.setattr(ed, "fingerprint", lambda body: real(body) & (3 << 62))
    check(spark.createDataFrame([(i, f"text {i % 17}" if i % 2 else f"TEXT {i % 5}") for i in range(90)], "doc_id long, text string"))


def test_hot_class_and_shuffled_joins(spark, monkeypatch):
    monkeypatch.setattr(ed, "HOT_ROWS", 20)
    df = spark.createDataFrame([(i, "Same" if i % 3 else f"other {i % 40}") for i in range(300)], "doc_id long, text string")
    check(df)
    monkeypatch.setattr(ed, "BROADCAST_KEYS", 0)
    check(df)


def test_texts_of_one_fingerprint_are_alone(spark, monkeypatch):
    monkeypatch.setattr(ed, "fingerprint", lambda body: 7)
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "_key long, _text string")
    assert ed.verified(docs, "_text", spark.createDataFrame([(7, 2)], "fp long, n long")).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, (1 << 64) - 1), st.integers(0, 40), st.integers((1 << 64) - 40, (1 << 64) - 1)), max_size=60), min_size=1, max_size=5), st.integers(0, 12))
def test_filters_lose_nothing(lists, bits):
    """Segments of several filters, merged, hold what one count of all holds; encode and decode are inverse."""
    segments = {}
    for some in lists:
        values, counts = np.unique(np.array(some, np.uint64), return_counts=True)
        for s in {v >> 64 - bits for v in some}:
            mine = np.array([int(v) >> 64 - bits == s for v in values], bool)
            data = ed.encode(values[mine], counts[mine], bits)
            back = ed.decode(data, s, bits)
            assert (back[0] == values[mine]).all() and (back[1] == counts[mine]).all()
            segments.setdefault(s, []).append(data)
    got = {}
    for s, parts in segments.items():
        values, counts = ed.decode(ed.merge(parts, s, bits), s, bits)
        assert (np.diff(values.astype(object)) > 0).all()
        got |= dict(zip(values.tolist(), counts.tolist(), strict=True))
    want = {}
    for v in sum(lists, []):
        want[v] = want.get(v, 0) + 1
    assert got == want


def test_only_repeated_texts_are_compared(spark):
    df = spark.createDataFrame([(i, f"t{max(i, 3)}") for i in range(100)], "_key long, _text string")
    prints = ed.bodies(df, "_text", "sha string", lambda some: [ed.pa.array([""] * len(some))])
    assert [(r.n) for r in ed.repeated(prints, 4).collect()] == [4]

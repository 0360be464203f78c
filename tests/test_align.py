import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.operators import align
from skein.operators.align import Rules

WORDS, FRAMES = "book string, pos long, text string", "book string, frame long, scores array<float>"


def every_way(scores, words):
    """The best total of all ways to read words through the frames."""
    sounds = [s for w in words for s in w]
    firsts = {sum(map(len, words[:k])) for k in range(len(words))}
    n, best = len(scores), -math.inf
    for cuts in itertools.combinations_with_replacement(range(n + 1), 2 * len(sounds)):
        spans = list(zip(cuts[::2], cuts[1::2], strict=True))
        if any(a == b for a, b in spans) or any(spans[k][1] != spans[k + 1][0] for k in range(len(spans) - 1) if k + 1 not in firsts):
            continue
        inside = {t: s for (a, b), s in zip(spans, sounds, strict=True) for t in range(a, b)}
        best = max(best, sum(scores[t, inside.get(t, 0)] for t in range(n)))
    return best


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_best_way_of_all(data):
    n, words = data.draw(st.integers(1, 6)), data.draw(st.lists(st.lists(st.integers(1, 3), max_size=2), min_size=1, max_size=3).filter(lambda w: sum(map(len, w)) <= 3))
    scores = np.random.default_rng(data.draw(st.integers(0, 9999))).normal(size=(n, 4)).round(1)
    want, got = every_way(scores, words), align.monotone(scores, words)
    if want == -math.inf:
        assert got is None
        return
    used = {t for a, b, _ in got for t in range(a, b)}
    total = sum(s for _, _, s in got) + sum(scores[t, 0] for t in range(n) if t not in used)
    assert total == pytest.approx(want)
    assert all(a[1] <= b[0] for a, b in itertools.pairwise(got)) and all((a < b) == bool(w) for (a, b, _), w in zip(got, words, strict=True))


def test_parts_of_the_programme_agree(monkeypatch):
    rng = np.random.default_rng(4)
    scores, words = rng.normal(size=(300, 6)), [list(rng.integers(1, 6, rng.integers(0, 4))) for _ in range(40)]
    whole = align.monotone(scores, words)
    for cells in (1, 1000, 5000):
        monkeypatch.setattr(align, "CELLS", cells)
        assert align.monotone(scores, words) == whole
    assert align.monotone(scores[:5], words) is None and align.monotone(scores[:0], [[1]]) is None
    assert align.monotone(np.full((4, 2), np.nan), [[1]]) is None
    assert align.monotone(np.zeros((4, 2)), [[1]]) == [(0, 1, 0.0)]  # as early as it can


def loop(words, scores, rate, r):
    """The rules over whole arrays."""
    n, total = len(words), len(scores)
    if total <= r.whole * rate:
        got = align.monotone(scores, words) if words else None
        return [(0, 0, total, got)] if got else []
    out, i, cursor, held = [], 0, 0, 0
    while i < n and total - cursor >= r.least * rate:
        some = words[i : i + r.words]
        last = i + len(some) >= n
        lo, hi = max(held, cursor - int(r.lead * rate)), total if last else min(total, cursor + int(r.seconds * rate))
        held = max(held, lo - int(r.seconds * rate))
        got = align.monotone(scores[lo:hi], some)
        if not got:
            break
        got = got[: len(got) if last else max(1, len(got) - r.tail)]
        out.append((i, lo, hi, [(lo + a, lo + b, s) for a, b, s in got]))
        i, cursor = i + len(got), lo + got[-1][1]
    return out


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_windows_equal_plain_loop(data):
    rng = np.random.default_rng(data.draw(st.integers(0, 9999)))
    n, frames = data.draw(st.integers(0, 60)), data.draw(st.integers(0, 200))
    words, scores = [[int(x)] for x in rng.integers(1, 5, n)], rng.normal(size=(frames, 5))
    r = Rules(whole=data.draw(st.sampled_from([0.0, 30.0])), words=data.draw(st.integers(1, 12)), seconds=data.draw(st.integers(2, 30)), lead=1.0, tail=data.draw(st.integers(0, 5)), least=1.0)
    pieces = iter([scores[k : k + 7] for k in range(0, frames, 7)])
    got = list(align.align_book([str(w[0]) for w in words], align.Feed(pieces), lambda w: [int(w)], 2, r))
    assert got == loop(words, scores, 2, r)


def test_only_a_window_is_held():
    """However long a book, no more frames are held than a window and one piece."""
    scores = np.zeros((40_000, 2))
    scores[:, 1] = -1.0
    feed = align.Feed(scores[k : k + 100] for k in range(0, len(scores), 100))
    most = 0
    for _ in align.align_book(["1"] * 200_000, feed, lambda w: [1], 1, Rules(whole=500, words=100, seconds=300, lead=8, tail=10)):
        most = max(most, sum(map(len, feed.held)))
    assert feed.first > 10_000 and most <= 1100


def test_tables(spark):
    """Many books at once, small batches, odd rows."""
    rng = np.random.default_rng(8)
    r = Rules(whole=10.0, words=10, seconds=30.0, lead=2.0, tail=3, least=1.0)
    words, frames, want = [], [], {}
    for book, n, m in (("a", 50, 300), ("b", 5, 12), ("c", 0, 9), ("d", 4, 0), ("e", 90, 120), (None, 20, 90)):
        said, scores = rng.integers(1, 4, n), rng.normal(size=(m, 4)).astype(np.float32)
        words += [(book, k, str(s)) for k, s in enumerate(said)]
        frames += [(book, k, v.tolist()) for k, v in enumerate(scores)]
        for k, (i, lo, hi, got) in enumerate(loop([[int(s)] for s in said], scores.astype(float), 2, r)):
            want |= {(book, i + j): (k, lo / 2, hi / 2, a / 2, b / 2, pytest.approx(s)) for j, (a, b, s) in enumerate(got)}
    rng.shuffle(frames)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        w, f = spark.createDataFrame(words, WORDS), spark.createDataFrame([(b, int(k), v) for b, k, v in frames], FRAMES)
        got = align.align_words(w, f, lambda x: [int(x)], 2, rules=r).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(x.book, x.pos): (x.window, x.win_start, x.win_end, x.start, x.end, x.score) for x in got} == want and len(got) == len(want)
    none = align.align_words(w.filter("false"), f, lambda x: [int(x)], 2)
    assert none.count() == 0 and align.window_report(none).count() == 0


def test_audio_that_ends_early_drops_the_tail(spark):
    r = Rules(whole=1.0, words=4, seconds=6.0, lead=1.0, tail=1, least=2.0)
    scores = np.full((9, 2), -1.0)
    got = [x for _, _, _, some in align.align_book(["1"] * 20, align.Feed(iter([scores])), lambda w: [1], 1, r) for x in some]
    assert len(got) < 20


def test_null_texts_have_no_sounds(spark):
    w = spark.createDataFrame([("a", 0, "1"), ("a", 1, None), ("a", 2, "2")], WORDS)
    f = spark.createDataFrame([("a", k, v) for k, v in enumerate([[0.0, -9.0, -9.0], [-9.0, 0.0, -9.0], [-9.0, 0.0, -9.0], [-9.0, -9.0, 0.0]])], FRAMES)
    got = align.align_words(w, f, lambda x: [int(x)] if x else [], 1).orderBy("pos").collect()
    assert [(x.text, x.start, x.end) for x in got] == [("1", 1.0, 3.0), ("", 3.0, 3.0), ("2", 3.0, 4.0)]


def heard(sounds, rng, kinds=5, other=-8.0, filler=-2.0):
    """Scores of frames that say the sounds, with pauses."""
    frames = [s for x in sounds for s in [x] * int(rng.integers(1, 4)) + [0] * int(rng.integers(0, 3))]
    out = np.full((len(frames), kinds), other)
    out[:, 0] = filler
    out[np.arange(len(frames)), frames] = 0.0
    return out


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_clear_ways_are_the_programmes(data):
    """Words of any number of sounds; words before, between and after that the text does not have; costs in and out of the rule."""
    rng = np.random.default_rng(data.draw(st.integers(0, 99999)))
    most, extra = data.draw(st.sampled_from([(1, 0), (3, 0), (1, 6)]))
    words = [[int(s) for s in rng.integers(1, 5, rng.integers(0, most + 1))] for _ in range(data.draw(st.integers(1, 8)))]
    sounds = [s for w in words for s in w]
    for _ in range(extra):
        sounds.insert(int(rng.integers(len(sounds) + 1)), int(rng.integers(1, 5)))
    scores = heard(sounds, rng, other=data.draw(st.sampled_from([-3.0, -8.0, -20.0])), filler=data.draw(st.sampled_from([-2.0, -1.0, -9.0])))
    got = align.clear_way(scores, words)
    assert got is None or list(map(list, got)) == list(map(list, align.programme(scores, words)))


def test_clear_readings_take_no_programme(monkeypatch):
    """A book that is heard as it is written, at once and in windows whose audio goes on."""
    monkeypatch.setattr(align, "programme", None)
    said = [k % 4 + 1 for k in range(300)]
    scores = np.full((1200, 5), -8.0)
    scores[np.arange(1200), [s for x in said for s in (x, x, 0, 0)]] = 0.0
    scores[:, 0] = np.where(scores[:, 0] == 0, 0.0, -2.0)
    for r in (Rules(whole=500.0), Rules(whole=1.0, words=20, seconds=20.0, lead=2.0, tail=3, least=1.0)):
        got = [x for _, _, _, some in align.align_book(list(map(str, said)), align.Feed(iter([scores])), lambda w: [int(w)], 4, r) for x in some]
        assert got == [(4 * k, 4 * k + 2, 0.0) for k in range(300)]


def test_rows_of_many_words_and_frames(spark):
    scores = [[0.0, -9.0, -9.0], [-9.0, 0.0, -9.0], [-9.0, 0.0, -9.0], [-9.0, -9.0, 0.0]]
    one = spark.createDataFrame([("a", 5, "1"), ("a", 6, None), ("a", 7, "2")], WORDS), spark.createDataFrame([("a", k, v) for k, v in enumerate(scores)], FRAMES)
    many = spark.createDataFrame([("a", 7, ["2"]), ("a", 5, ["1", None])], "book string, pos long, text array<string>"), spark.createDataFrame([("a", 3, scores[3]), ("a", 0, sum(scores[:3], []))], FRAMES)
    spell = lambda x: [int(x)] if x else []
    a, b = (sorted(map(tuple, align.align_words(*t, spell, 1, width=w).collect())) for t, w in ((one, None), (many, 3)))
    assert a == b and len(a) == 3


def test_windows_without_their_words(spark):
    rng = np.random.default_rng(3)
    w = spark.createDataFrame([(b, k, str(s)) for b, n in (("a", 70), ("b", 5), (None, 30)) for k, s in enumerate(rng.integers(1, 4, n))], WORDS)
    f = spark.createDataFrame([(b, k, v) for b, n in (("a", 300), ("b", 12), (None, 90)) for k, v in enumerate(rng.normal(size=(n, 4)).tolist())], FRAMES)
    r = Rules(whole=10.0, words=10, seconds=30.0, lead=2.0, tail=3, least=1.0)
    said, got = align.window_report(align.align_words(w, f, lambda x: [int(x)], 2, rules=r)), align.align_windows(w, f, lambda x: [int(x)], 2, rules=r)
    assert said.columns == got.columns and sorted(map(repr, said.collect())) == sorted(map(repr, got.collect())) and got.count() > 10

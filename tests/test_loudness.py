import math

import numpy as np
import pytest

from skein.operators import loudness as L

RATE = 8000


def rows(spark, sounds, chunk):
    cut = [(k, i, [float(x) for x in s[p : p + chunk]]) for k, s in sounds.items() for i, p in enumerate(range(0, len(s), chunk))]
    return spark.createDataFrame(cut, "id string, pos int, x array<double>")


def tone(amplitude, seconds, frequency=997, rate=RATE):
    return amplitude * np.sin(2 * np.pi * frequency * np.arange(int(seconds * rate)) / rate)


def plain(x, rate):
    """The standard's definition over a whole recording."""
    y, step = L.weighted(np.asarray(x), rate), rate // 10
    power = [np.mean(y[i : i + 4 * step] ** 2) for i in range(0, len(y) - 4 * step + 1, step)]
    level = lambda p: -0.691 + 10 * math.log10(p) if p > 0 else -math.inf
    some = [p for p in power if level(p) > -70]
    some = [p for p in some if level(p) > level(np.mean(some)) - 10]
    return level(np.mean(some)) if some else None


def test_weighting_at_48_khz():
    """A full tone of 997 Hz in one channel is at -3.01; slow and fast tones lose and gain what the standard says."""
    level = lambda f: -0.691 + 10 * math.log10(np.mean(L.weighted(tone(1, 2, f, 48000), 48000)[48000:] ** 2))
    assert abs(level(997) + 3.01) < 0.05 and level(30) < -7 and 0.5 < level(8000) - level(997) < 4.5
    with pytest.raises(ValueError):
        L.kernel(3000)


def test_loudness_of_chunks(spark):
    rng = np.random.default_rng(1)
    sounds = {
        "tone": tone(0.1, 3), "soft": tone(0.02, 2), "silent": np.zeros(RATE), "short": tone(0.5, 0.3), "faint": tone(1e-5, 1),
        "mixed": np.concatenate([tone(0.5, 2), tone(0.001, 3), rng.normal(0, 0.1, RATE)]),
    }
    for chunk in (700, 100_000):
        got = {r.id: r for r in L.loudness(rows(spark, sounds, chunk), "id", "pos", "x", RATE).collect()}
        for k, x in sounds.items():
            want = plain(x, RATE)
            assert got[k].loudness is None and want is None if want is None else abs(got[k].loudness - want) < 1e-6, (k, chunk)
            assert abs(got[k].peak - np.abs(x).max()) < 1e-12
    assert abs(got["tone"].loudness + 23.01) < 0.1 and got["silent"].blocks == 0 and got["tone"].blocks == 27


def test_normalised(spark):
    spiky = tone(0.01, 2)
    spiky[4000] = 0.9
    sounds = {"tone": tone(0.02, 2), "loud": tone(0.9, 2), "spiky": spiky, "silent": np.zeros(RATE)}
    out = L.normalise(rows(spark, sounds, 3000), "id", "pos", "x", RATE)
    assert out.columns == ["id", "pos", "x"] and out.count() == sum(-(-len(s) // 3000) for s in sounds.values())
    got = {r.id: r for r in L.loudness(out, "id", "pos", "x", RATE).collect()}
    assert abs(got["tone"].loudness + 23) < 0.1 and abs(got["loud"].loudness + 23) < 0.1 and got["silent"].peak == 0
    assert abs(20 * math.log10(got["spiky"].peak) + 3) < 1e-6 and got["spiky"].loudness < -23


def test_corner_cases(spark):
    odd = spark.createDataFrame([("a", 0, None), ("a", 1, []), ("b", 0, [None] * 4000), (None, 0, tone(0.1, 1).tolist()), (None, 1, None)], "id string, pos int, x array<double>")
    got = {r.id: r for r in L.loudness(odd, "id", "pos", "x", RATE).collect()}
    assert set(got) == {"b", None} and got["b"].loudness is None and abs(got[None].loudness + 23) < 0.2
    assert L.loudness(odd.limit(0), "id", "pos", "x", RATE).count() == 0
    assert [r.x for r in L.normalise(odd.filter("id = 'a'").orderBy("pos"), "id", "pos", "x", RATE).collect()] == [None, []]

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from skein.operators.collate import Ragged, collate, pad

KIND = "batch int, id string, ids array<int>, wave array<float>, mel array<array<float>>, speaker int"


@given(st.lists(st.lists(st.integers(0, 9), max_size=9), min_size=1, max_size=6), st.integers(1, 5))
def test_pad_keeps_every_cell(rows, multiple):
    flat, lengths = np.array([x for r in rows for x in r], np.int64), np.array([len(r) for r in rows])
    cells, mask = pad(flat, lengths, -7, multiple)
    assert cells.shape == mask.shape and cells.shape[1] % multiple == 0 and cells.shape[1] - max(map(len, rows)) < multiple
    for r, c, m in zip(rows, cells.tolist(), mask.tolist(), strict=True):
        assert c == r + [-7] * (len(c) - len(r)) and m == [True] * len(r) + [False] * (len(c) - len(r))


def test_batches(spark):
    rows = [
        (1, "b", [1, 2, 3], [0.5], [[1.0, 2.0]], 7),
        (1, "a", [4], [1.5, 2.5], [[3.0, 4.0], [5.0, 6.0]], None),
        (1, None, None, [], [], 9),
        (2, "z", [], [], [], 1),
        (None, "y", [1], [1.0], [], 2),
        (3, "x", [1, None], None, None, 3),
    ]
    got = {r.batch: r for r in collate(spark.createDataFrame(rows, KIND).repartition(3), "batch", "id", [Ragged("ids", fill=-1), Ragged("wave", mask=False), Ragged("mel", inner=2, multiple=4)], ("speaker",)).collect()}
    assert set(got) == {1, 2, 3}
    r = got[1]
    assert (r.rows, r["keys"], r.speaker) == (3, [None, "a", "b"], [9, None, 7])
    assert (r.ids, r.ids_width, r.ids_lengths) == ([-1, -1, -1, 4, -1, -1, 1, 2, 3], 3, [0, 1, 3]) and r.ids_mask == [0, 0, 0, 1, 0, 0, 1, 1, 1]
    assert (r.wave, r.wave_width) == ([0.0, 0.0, 1.5, 2.5, 0.5, 0.0], 2) and "wave_mask" not in r.asDict()
    assert r.mel_width == 4 and np.array(r.mel).reshape(3, 4, 2)[1].tolist() == [[3, 4], [5, 6], [0, 0], [0, 0]] and r.mel_mask == [0] * 4 + [1, 1, 0, 0] + [1, 0, 0, 0]
    assert (got[2].ids_width, got[2].ids, got[2].ids_mask) == (0, [], []) and got[3].ids == [1, -1]
    assert collate(spark.createDataFrame([], KIND), "batch", "id", [Ragged("ids")]).count() == 0


def test_entries_of_another_width_are_refused(spark):
    df = spark.createDataFrame([(1, "a", [1], [1.0], [[1.0], [1.0, 2.0]], 1)], KIND)
    with pytest.raises(Exception, match="not 2 wide"):
        collate(df, "batch", "id", [Ragged("mel", inner=2)]).collect()

"""Loudness of recordings after ITU-R BS.1770, one channel: weighted, in blocks of 400 ms every 100 ms, gated twice.

A recording is rows of samples in order, places given once each. Each row is weighted by itself, after as many samples of
the rows before it as the filter remembers, and hands on sums of squares for each 100 ms; blocks, gates and means are
aggregations over those. A window brings a recording's rows in order through one task, which holds no more of them than
the filter remembers; the weighting is dealt out again by row. Peaks are of the samples, not of what lies between them.

Defined results: silence, or less than one block above the absolute gate, has a null loudness and a gain of 0; null
samples are 0, null and empty rows of samples add nothing; a null recording is one as any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.session import share_path

# Fixed values of the standard: the offset, the gates (LUFS, and LU below the mean), blocks in hops of 100 ms.
OFFSET, ABSOLUTE, RELATIVE, BLOCK = -0.691, -70.0, -10.0, 4
# Frequency, quality and gain of the shelf and of the high pass, for any sampling rate.
SHELF = (1681.974450955533, 0.7071752369554196, 3.999843853973347, 0.4996667741545416)
HIGH_PASS = (38.13547087602444, 0.5003270373238773)
#: The filter's response is cut where what follows is less than this share of it.
CUT = 1e-12


def _response(b: list[float], a: list[float], x: np.ndarray) -> np.ndarray:
    y, s1, s2 = np.empty(len(x)), 0.0, 0.0
    for i, v in enumerate(x.tolist()):
        y[i] = out = b[0] * v + s1
        s1, s2 = b[1] * v - a[0] * out + s2, b[2] * v - a[1] * out
    return y


@cache
def kernel(rate: int) -> np.ndarray:
    """The weighting's response to one impulse."""
    if rate <= 2 * SHELF[0]:
        raise ValueError(f"the weighting needs more than {2 * SHELF[0]:.0f} samples a second")
    f, q, gain, power = SHELF
    k, high = math.tan(math.pi * f / rate), 10 ** (gain / 20)
    band, norm = high**power, 1 + k / q + k * k
    impulse = np.zeros(2 * rate)
    impulse[0] = 1
    out = _response([(high + band * k / q + k * k) / norm, 2 * (k * k - high) / norm, (high - band * k / q + k * k) / norm], [2 * (k * k - 1) / norm, (1 - k / q + k * k) / norm], impulse)
    f, q = HIGH_PASS
    k = math.tan(math.pi * f / rate)
    norm = 1 + k / q + k * k
    out = _response([1, -2, 1], [2 * (k * k - 1) / norm, (1 - k / q + k * k) / norm], out)
    return out[: np.flatnonzero(np.abs(out) > CUT * np.abs(out).max())[-1] + 1]


def weighted(samples: np.ndarray, rate: int) -> np.ndarray:
    """All samples through the weighting."""
    h = kernel(rate)
    n = len(samples) + len(h) - 1
    size = 1 << (n - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(samples, size) * np.fft.rfft(h, size), size)[: len(samples)]


def hops(rows: DataFrame, key: str, pos: str, samples: str, rate: int, weigh: bool = True) -> DataFrame:
    """key, hop, n, squares, peak: sums of squares and the highest sample for each 100 ms of each recording."""
    share_path(rows.sparkSession)
    order = Window.partitionBy("k").orderBy("pos")
    some = rows.select(F.col(key).alias("k"), F.col(pos).alias("pos"), F.transform(F.col(samples).cast("array<double>"), lambda x: F.coalesce(x, F.lit(0.0))).alias("x")).filter(F.size("x") > 0)
    reach = len(kernel(rate)) - 1 if weigh else 0
    inner = some.select(F.size("x").alias("n"), F.lead("pos").over(order).isNotNull().alias("more"))
    shortest = inner.filter("more").agg(F.min("n")).first()[0] if reach else None
    before = F.flatten(F.collect_list("x").over(order.rowsBetween(-math.ceil(reach / shortest), -1))) if shortest else F.array().cast("array<double>")
    first = F.coalesce(F.sum(F.size("x")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tail = F.slice(before, F.greatest(F.size(before) - reach, F.lit(0)) + 1, F.lit(max(reach, 1)))
    framed = some.select("k", "x", first.alias("first"), tail.alias("tail"), "pos")
    if weigh:
        framed = framed.repartition("k", "pos")
    step = rate // 10

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # k, x, first, tail
            took, at, out = [], [], []
            for i, (x, lead, start) in enumerate(zip(b.column("x"), b.column("tail"), b.column("first").to_pylist(), strict=True)):
                x, lead = (v.values.to_numpy(zero_copy_only=False) for v in (x, lead))
                y = weighted(np.concatenate([lead, x]), rate)[len(lead) :] if weigh else x
                hop = (start + np.arange(len(x))) // step
                edge = np.flatnonzero(np.diff(hop, prepend=-1))
                took += [i] * len(edge)
                at.append(hop[edge])
                out.append(np.stack([np.diff(edge, append=len(x)), np.add.reduceat(y * y, edge), np.maximum.reduceat(np.abs(x), edge)]))
            n, squares, peak = np.concatenate(out, axis=1) if out else np.zeros((3, 0))
            hop = np.concatenate([np.zeros(0, np.int64), *at])
            yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(took, pa.int64())), pa.array(hop), pa.array(n.astype(np.int64)), pa.array(squares), pa.array(peak)], ["k", "hop", "n", "squares", "peak"])

    kind = some.schema["k"].dataType.simpleString()
    parts = framed.mapInArrow(run, f"k {kind}, hop long, n long, squares double, peak double")
    return parts.groupBy("k", "hop").agg(F.sum("n").alias("n"), F.sum("squares").alias("squares"), F.max("peak").alias("peak")).withColumnRenamed("k", key)


def loudness(rows: DataFrame, key: str, pos: str, samples: str, rate: int, weigh: bool = True) -> DataFrame:
    """key, loudness (LUFS), blocks (how many count), peak (the highest sample), one row for each recording."""
    step = rate // 10
    h = hops(rows, key, pos, samples, rate, weigh).withColumnRenamed(key, "k")
    ahead = Window.partitionBy("k").orderBy("hop").rowsBetween(0, BLOCK - 1)
    block = h.select("k", "peak", F.sum("n").over(ahead).alias("n"), (F.sum("squares").over(ahead) / (BLOCK * step)).alias("power"))
    whole = (F.col("n") == BLOCK * step) & (F.col("power") > 10 ** ((ABSOLUTE - OFFSET) / 10))
    first = block.withColumn("counts", whole).withColumn("gate", F.avg(F.when(F.col("counts"), F.col("power"))).over(Window.partitionBy("k")) * 10 ** (RELATIVE / 10))
    second = F.when(F.col("counts") & (F.col("power") > F.col("gate")), F.col("power"))
    out = first.groupBy("k").agg((F.lit(OFFSET) + 10 * F.log10(F.avg(second))).alias("loudness"), F.count(second).alias("blocks"), F.max("peak").alias("peak"))
    return out.withColumnRenamed("k", key)


def normalise(rows: DataFrame, key: str, pos: str, samples: str, rate: int, target: float = -23.0, ceiling: float = -3.0) -> DataFrame:
    """rows with their samples at the target loudness, or as near as the highest sample's ceiling (dB) lets them."""
    found = loudness(rows, key, pos, samples, rate)
    room = F.lit(ceiling) - 20 * F.log10(F.nullif(F.col("peak"), F.lit(0.0)))
    gain = F.coalesce(F.least(F.lit(target) - F.col("loudness"), room), F.lit(0.0))
    factors = found.select(F.col(key).alias("_of"), F.pow(F.lit(10.0), F.when(F.col("loudness").isNull(), 0.0).otherwise(gain) / 20).alias("_factor"))
    joined = rows.join(factors, rows[key].eqNullSafe(F.col("_of")), "left")
    louder = F.transform(F.col(samples).cast("array<double>"), lambda x: x * F.coalesce(F.col("_factor"), F.lit(1.0)))
    return joined.withColumn(samples, louder).select(*rows.columns)

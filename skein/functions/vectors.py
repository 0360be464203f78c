"""Vector functions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """v over its length; null for a null vector or one of length 0."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def peak(v: Column) -> Column:
    return F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))


def peak_normalise(v: Column, to: float = 0.95) -> Column:
    """v scaled so that its largest magnitude is to; silence stays as it is."""
    p = peak(v)
    return F.when(p > 0, F.transform(v, lambda x: x.cast("double") * to / p)).otherwise(as_double(v))


def gain(db: Column | float) -> Column:
    return F.pow(F.lit(10.0), (F.lit(db) if isinstance(db, float | int) else db) / 20)


def bit_error(a: Column, b: Column, least: int = 40, most_shift: int = 120, step: int = 2) -> Column:
    """The least share of differing bits of two fingerprints (32-bit values) over shifts of one against the other.

    1.0 if either is shorter than least; a shift with a shorter overlap does not count.
    """
    mask = F.lit(0xFFFFFFFF).cast("long")
    na, nb = F.size(a), F.size(b)
    most = F.least(F.lit(most_shift), F.floor(F.least(na, nb) / 2).cast("int"))

    def at(shift: Column) -> Column:
        x = F.slice(a, F.greatest(shift, F.lit(0)) + 1, na)
        y = F.slice(b, F.greatest(-shift, F.lit(0)) + 1, nb)
        n = F.least(F.size(x), F.size(y))
        bits = F.aggregate(F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda p, q: F.bit_count(p.bitwiseXOR(q).bitwiseAND(mask))), F.lit(0), lambda s, v: s + v)
        return F.when(n >= least, bits / (n * 32))

    shifts = F.transform(F.sequence(-most, most, F.lit(step)), at)
    return F.when(F.least(na, nb) < least, F.lit(1.0)).otherwise(F.least(F.coalesce(F.array_min(shifts), F.lit(1.0)), F.lit(1.0)))


def to_grid(v: Column, multiple: int) -> Column:
    """v down to a multiple, which is also the least result."""
    return F.greatest(F.lit(multiple), (F.floor(v / multiple) * multiple).cast("int"))


def frame_count(v: Column) -> Column:
    """The largest count of the form 8 n + 1 up to v."""
    return (F.floor((v - 1) / 8) * 8 + 1).cast("int")

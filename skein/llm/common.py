"""What the operators of this subpackage share: tables, scratch storage, array functions, ordered buckets."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import share_path

#: Leaves of the CASE tree that finds a row's range; further ranges come from arithmetic inside a leaf.
MAX_LEAVES = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="skein-")


def scratch(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of our own only where none is set and all runs in this process."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{_own_folder()}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/skein/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.staged_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes that a task of an own exchange gets, by the optimiser's estimate (for texts in Parquet: compressed ones).
TASK_BYTES = 16 << 20


def parts(df: DataFrame) -> int:
    """Into how many parts to deal df: as many as the session shuffles into, more if the data are more than that holds.

    Where the optimiser knows no size (it then assumes one beyond any table), the session's number holds.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = -(-size // TASK_BYTES) if size < 1 << 56 else 0
    return max(partitions(df.sparkSession), known)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, for columns that come and go inside an operator."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often then reads it (also where a lambda does)."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


_BLOCK = 256


def scan(values: Column, plus: Callable[[Column, Column], Column], kind: str) -> Column:
    """Running totals of an array under plus, each with its own element.

    Blocks are scanned by appending, then their last totals, so an element is copied 256 times at most and the totals of
    n elements cost (n / 256) ** 2 / 2 copies: in proportion to n up to some millions.
    """
    nothing = F.array().cast(f"array<{kind}>")

    def one(some: Column) -> Column:
        return F.aggregate(some, nothing, lambda done, x: F.concat(done, F.array(F.coalesce(plus(F.try_element_at(done, F.lit(-1)), x), x))))

    def whole(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int")), lambda b: one(F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK))))

        def lift(p: Column) -> Column:
            before = F.concat(F.array(F.lit(None).cast(kind)), one(F.transform(p, lambda q: F.element_at(q, -1))))
            return F.flatten(F.zip_with(p, F.slice(before, F.lit(1), F.size(p)), lambda q, x: F.transform(q, lambda y: F.coalesce(plus(x, y), y))))

        return F.when(F.size(v) > 0, let(blocks, lift)).otherwise(nothing)

    return let(values.cast(f"array<{kind}>"), whole)


def small_enough(df: DataFrame, limit: int, weight: Column | None = None) -> bool:
    """Whether df has at most limit rows, and elements by weight if given; reads little more than that many rows."""
    n = F.count("*") if weight is None else F.greatest(F.count("*"), F.coalesce(F.sum(weight), F.lit(0)))
    return df.limit(limit + 1).agg(n).first()[0] <= limit


def maybe_broadcast(df: DataFrame, limit: int, weight: Column | None = None) -> DataFrame:
    """df with a broadcast hint if its size, checked here, is within limit; else as it is (a shuffle join).

    Rows count; where they hold arrays, give a weight: the number of their elements.
    """
    return F.broadcast(df) if small_enough(df, limit, weight) else df


def _search(value: Column, bounds: list[int], lo: int, hi: int) -> Column:
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(value < F.lit(bounds[mid]), _search(value, bounds, lo, mid)).otherwise(_search(value, bounds, mid + 1, hi))


def range_bucket(df: DataFrame, key: str, n: int) -> Column:
    """A long column, ascending with the long column key: about n ranges of like row counts.

    Equal keys share a bucket; nulls come first. Bounds come from an approximate quantile sketch (one small job; at
    most MAX_LEAVES longs reach the driver); beyond MAX_LEAVES ranges each one is divided by equal width.
    """
    leaves = max(1, min(n, MAX_LEAVES))
    parts = -(-n // leaves)
    steps = [i / leaves for i in range(leaves + 1)]
    got = df.agg(F.percentile_approx(F.col(key).cast("long"), steps, 20_000)).first()[0]
    value = F.col(key).cast("long")
    if not got:
        return F.lit(0).cast("long")
    bounds = sorted(set(got[1:-1]))
    leaf = _search(value, bounds, 0, len(bounds))
    if parts == 1:
        return F.when(value.isNull(), -1).otherwise(leaf).cast("long")
    low = F.array(*[F.lit(x) for x in [got[0], *bounds]])
    high = F.array(*[F.lit(x) for x in [*bounds, got[-1] + 1]])
    lo, hi = F.element_at(low, leaf + 1), F.element_at(high, leaf + 1)
    within = F.floor((value - lo).cast("double") / F.greatest(hi - lo, F.lit(1)).cast("double") * parts)
    within = F.greatest(F.lit(0), F.least(F.lit(parts - 1), within))
    return F.when(value.isNull(), -1).otherwise(leaf * parts + within).cast("long")


#: Rows in an Arrow batch that a Python worker gets at once: whole texts, some of them long.
BATCH_ROWS = 1000


def python_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session, unless they are smaller already; workers find this package."""
    share_path(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def held_out(key: str, folds: int, held: int) -> Column:
    """Whether crc32 of the key as text falls in the held-out fold; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == held, F.lit(False))

"""Vectors and metrics: centroids, similarity of groups, scaling, class indexes, scores, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import vectors as V


def mean_vectors(df: DataFrame, group: str, vector: str) -> DataFrame:
    """group, mean: by dimension in partial aggregates; the array has one entry a dimension."""
    one = df.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return one.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))


def trimmed_centroid(df: DataFrame, group: str, vector: str, least: float = 0.90, rounds: int = 3) -> DataFrame:
    """group, centroid, kept, total: the mean of unit vectors, then rounds times that of the vectors near it."""
    units = df.select(group, V.unit(F.col(vector)).alias("u")).filter("u is not null")
    center = lambda d: mean_vectors(d, group, "u").select(group, V.unit(F.col("mean")).alias("centroid"))
    now, near = center(units), units
    for _ in range(rounds):
        near = units.join(now, group).filter(V.dot(F.col("u"), F.col("centroid")) >= least)
        # a group that loses all its vectors keeps the centroid it had
        now = now.withColumnRenamed("centroid", "old").join(center(near.select(group, "u")), group, "left").select(group, F.coalesce("centroid", "old").alias("centroid"))
    total = units.groupBy(group).agg(F.count("*").alias("total"))
    kept = units.join(now, group).filter(V.dot(F.col("u"), F.col("centroid")) >= least).groupBy(group).agg(F.count("*").alias("kept"))
    return now.join(total, group).join(kept, group, "left").select(group, "centroid", F.coalesce("kept", F.lit(0)).alias("kept"), "total")


def cosine_gate(df: DataFrame, centroids: DataFrame, group: str, vector: str, least: float) -> DataFrame:
    """df with sim to its group's centroid, those below least out."""
    return df.join(centroids.select(group, "centroid"), group).withColumn("sim", V.cosine(F.col(vector), F.col("centroid"))).filter(F.col("sim") >= least).drop("centroid")


def group_similarity(means: DataFrame, group: str, vector: str = "mean") -> DataFrame:
    """All pairs of different groups (as many rows as groups, squared) with their cosine."""
    a, b = means.select(F.col(group).alias("a"), F.col(vector).alias("va")), means.select(F.col(group).alias("b"), F.col(vector).alias("vb"))
    return a.join(b, F.col("a") != F.col("b")).select("a", "b", V.cosine(F.col("va"), F.col("vb")).alias("sim"))


def one_reader(pairs: DataFrame, least: float = 0.80) -> DataFrame:
    """One row: least and mean similarity, and whether all groups sound alike."""
    return pairs.agg(F.min("sim").alias("least"), F.avg("sim").alias("mean"), (F.min("sim") > least).alias("one_reader"))


def zscore(train: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """other scaled by train's mean and population deviation (plus 1e-6)."""
    stats = train.agg(*[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    out = other.crossJoin(F.broadcast(stats))  # one row
    return out.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-6) for c in columns}).drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


def class_index(*splits: DataFrame, label: str) -> DataFrame:
    """label, index over the sorted distinct labels of all splits (a small table)."""
    names = splits[0].select(label)
    for s in splits[1:]:
        names = names.unionAll(s.select(label))
    return names.distinct().filter(F.col(label).isNotNull()).withColumn("index", F.dense_rank().over(Window.orderBy(label)) - 1)


def rmse(df: DataFrame, by: list[str], predicted: Column, actual: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.sqrt(F.avg(F.pow(predicted - actual, F.lit(2.0)))).alias("rmse"))


def accuracy(df: DataFrame, by: list[str], predicted: Column, actual: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((predicted == actual).cast("double")).alias("accuracy"))


def pivot_grid(df: DataFrame, row: str, column: str, value: str, columns: list[str], missing: str = "—") -> DataFrame:
    """row by column, the first value in order, missing where none; columns are given, so no extra job finds them."""
    out = df.groupBy(row).pivot(column, columns).agg(F.min(value))
    return out.select(row, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(missing)).alias(c) for c in columns])


def retention(df: DataFrame, by: str, kept: Column, size: str) -> DataFrame:
    """Per cent of size kept, 0 for none."""
    total = F.sum(size)
    return df.groupBy(by).agg(F.coalesce(F.sum(F.when(kept, F.col(size))) * 100.0 / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("retention_pct"))


def running_sums(df: DataFrame, run: str, step: str, value: str) -> DataFrame:
    """df with the sum and mean of value over a run's steps so far."""
    w = Window.partitionBy(run).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({f"{value}_sum": F.sum(value).over(w), f"{value}_mean": F.avg(value).over(w)})

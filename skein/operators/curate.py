"""Curation: first-wins dedup by key, splits, balanced selection, sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.session import stored


def first_by_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in ascending order of some columns (then of all others); rows with an empty key all stay
    and never meet in one task.

    Keys may be whole texts: 128 bits of hashes are shuffled in their place, and each task sends one row a key.
    """
    keyed = df.filter((F.col(key) != "") & F.col(key).isNotNull())
    rest = [c for c in df.columns if c not in order]
    row = F.struct(*[F.col(f"`{c}`") for c in (*order, *rest)])
    first = keyed.groupBy(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")).agg(F.min(row).alias("row"))
    first = first.select(*[F.col("row")[c].alias(c) for c in df.columns])
    return first.unionByName(df.filter((F.col(key) == "") | F.col(key).isNull()))


def merge_report(merged: DataFrame, before: DataFrame, origin: str, seconds: str) -> DataFrame:
    """By origin: rows before, kept, dropped, hours kept."""
    had = before.groupBy(origin).agg(F.count("*").alias("n"))
    kept = merged.groupBy(origin).agg(F.count("*").alias("kept"), (F.sum(seconds) / 3600).alias("hours"))
    return had.join(kept, origin, "left").select(origin, "n", F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("n") - F.coalesce("kept", F.lit(0))).alias("dropped"), F.coalesce("hours", F.lit(0.0)).alias("hours"))


def source_group(book: Column, prefixes: dict[str, str], members: dict[str, list[str]], default: str) -> Column:
    """A group by prefix first, then by membership, else the default."""
    out = F.lit(default)
    for group, names in reversed(members.items()):
        out = F.when(book.isin(*names), group).otherwise(out)
    for prefix, group in reversed(prefixes.items()):
        out = F.when(book.startswith(prefix), group).otherwise(out)
    return out


def book_of(clip: Column) -> Column:
    """The clip's id without its last part."""
    return F.regexp_replace(clip, "_[^_]*$", "")


def route(df: DataFrame, key: Column, rules: list[tuple[str, str, str]], recipes: dict[str, Column], default: str) -> DataFrame:
    """df with role and recipe: the first rule (exact name, substring, role) that holds."""
    role = F.lit(default)
    for exact, part, name in reversed(rules):
        role = F.when((key == exact) | F.contains(key, F.lit(part)), name).otherwise(role)
    return df.withColumn("role", role).withColumn("recipe", reduce(lambda c, r: F.when(F.col("role") == r[0], r[1]).otherwise(c), recipes.items(), recipes[default]))


def running_before(df: DataFrame, order: list[Column | str], cost: Column, name: str = "before") -> DataFrame:
    """df with the sum of cost over all rows before this one in a total order, without moving all rows to one task.

    Rows are dealt into ranges of the order (a fixed number of them, so that adaptive plans leave them as they are) and
    summed there; the sums of the ranges before are added, as few rows as there are ranges.
    """
    part, own = (next(c for k in range(99) if (c := f"{x}{k}") not in df.columns) for x in ("part", "cost"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # stored, as both the sums and the rows must see the same ranges
    dealt = stored(df.withColumn(own, cost).repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()))
    sums = dealt.groupBy(part).agg(F.sum(own).alias("upto"))
    upto = F.coalesce(F.sum("upto").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = F.broadcast(sums.select(F.col(part).alias(f"{part}_of"), upto.alias(f"{own}_upto")))  # a row for each range
    before = F.coalesce(F.sum(own).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = dealt.withColumn(name, before).join(sums, F.col(part) == F.col(f"{part}_of"))
    return out.withColumn(name, F.col(name) + F.col(f"{own}_upto")).drop(part, own, f"{part}_of", f"{own}_upto")


def ranked(df: DataFrame, order: list[Column | str], name: str = "rn") -> DataFrame:
    """df with a global rank from 1 in a total order."""
    return running_before(df, order, F.lit(1), name).withColumn(name, F.col(name) + 1)


def kth_split(df: DataFrame, key: str, n_eval: int) -> DataFrame:
    """df with is_eval: every k-th row by key, k from the table's size, up to n_eval of them."""
    k = max(1, df.count() // max(1, n_eval))
    at = F.col("rn") - 1
    return ranked(df, [key]).withColumn("is_eval", (at % k == 0) & (at < k * n_eval)).drop("rn")


def systematic_sample(df: DataFrame, order: list[str], step: int) -> DataFrame:
    """Every step-th row from the first on, counted over all splits in order."""
    return ranked(df, order).filter((F.col("rn") - 1) % step == 0).drop("rn")


def round_robin(df: DataFrame, group: str, quality: Column, cost: str, budget: float, tie: str) -> DataFrame:
    """Rows taken in turn from each group, best first, until their cost reaches the budget (the one that crosses it is in)."""
    one = df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(quality, tie)))
    return running_before(one, ["turn", group], F.col(cost)).filter(F.col("before") < budget)


def largest_per_group(df: DataFrame, group: str, name: str, size: str) -> DataFrame:
    return df.groupBy(group).agg(F.max_by(name, F.struct(F.col(size), F.col(name))).alias(name), F.max(size).alias(size))


def resume(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows without an output yet."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def only(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Rows whose value is listed; all for an empty list."""
    return df.filter(F.col(column).isin(*names)) if names else df


def length_between(df: DataFrame, size: Column, low: float, high: float) -> DataFrame:
    """Strictly between, nulls out."""
    return df.filter(size.isNotNull() & (size > low) & (size < high))


def token_limit(df: DataFrame, tokens: str, most: int) -> DataFrame:
    """Token arrays cut to most + 1, then those strictly shorter than most."""
    return df.withColumn(tokens, F.slice(tokens, 1, most + 1)).filter(F.size(tokens) < most)


def rotate(df: DataFrame, run: str, number: str, limit: int) -> DataFrame:
    """Checkpoints to delete before a save, so that at most limit - 1 remain: the oldest by number."""
    rank = F.row_number().over(Window.partitionBy(run).orderBy(F.desc(number)))
    return df.withColumn("_r", rank).filter(F.col("_r") > max(limit - 1, 0)).drop("_r")


def best_checkpoint(df: DataFrame, run: str) -> DataFrame:
    """Of each run the checkpoint of its best epoch if it is there, else the latest."""
    return df.groupBy(run).agg(F.max_by(F.struct("path", "epoch"), F.struct((F.col("epoch") == F.col("best_epoch")).cast("int"), F.col("epoch"))).alias("b")).select(run, "b.path", "b.epoch")


def chosen_checkpoints(df: DataFrame, epochs: list[int]) -> DataFrame:
    """epoch, path of the checkpoints asked for, path null where there is none; an error if there are none at all."""
    asked = df.sparkSession.createDataFrame([(e,) for e in dict.fromkeys(epochs)], "epoch int")
    out = asked.join(df.groupBy("epoch").agg(F.min("path").alias("path")), "epoch", "left")
    if out.filter("path is not null").isEmpty():
        raise ValueError(f"no checkpoint of epochs {epochs}")
    return out


def numeric_suffix(c: Column) -> Column:
    """The number at a name's end; names with final sort last."""
    return F.when(F.contains(c, F.lit("final")), F.lit(2**31 - 1)).otherwise(F.regexp_extract(c, r"(\d+)\D*$", 1).try_cast("int"))


def length_batches(df: DataFrame, length: str, key: str, size: int) -> DataFrame:
    """df with batch: rows of like length together, size to a batch, from the shortest on."""
    return ranked(df, [length, key], "batch").withColumn("batch", F.floor((F.col("batch") - 1) / size))


def eligible(similarity: Column, seconds: Column, least: float = 0.90, shortest: float = 4.0, longest: float = 9.0) -> Column:
    """Whether a clip may be chosen: similar enough and of a middling length, limits included."""
    return (similarity >= least) & seconds.between(shortest, longest)


def group_minutes(df: DataFrame, group: str, seconds: str) -> DataFrame:
    return df.groupBy(group).agg((F.sum(seconds) / 60).alias("minutes"))


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many distinct values each column has, nulls aside."""
    return df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in columns])

"""Joins: bands, best partners, classes of pairs, orphans, lookups, nested and outer joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, width: float, how: str = "inner") -> DataFrame:
    """Rows whose values differ by at most width.

    Values fall into cells as wide as the band, so partners lie in the same cell or one beside it: the right side is
    expanded to three cells and the join is by equality, not a nested loop. Null values join nothing.
    """
    cell = lambda v, off=0: F.floor(F.col(v) / width).cast("long") + off
    a = left.withColumn("_cell", cell(left_value))
    b = right.filter(F.col(right_value).isNotNull()).withColumn("_near", F.explode(F.array(*[cell(right_value, k) for k in (-1, 0, 1)])))
    return a.join(b, (a["_cell"] == b["_near"]) & (F.abs(a[left_value] - b[right_value]) <= width), how).drop("_cell", "_near")


def classify_pairs(pairs: DataFrame, error: str = "bit_error", delta: str = "delta", most_error: float = 0.25, most_delta: float = 2.0) -> DataFrame:
    """pairs with class duplicate or same-length; all others go."""
    kind = F.when(F.col(error) <= most_error, "duplicate").when(F.abs(F.col(delta)) <= most_delta, "same-length")
    return pairs.withColumn("class", kind).filter(F.col("class").isNotNull())


def pair_lists(classified: DataFrame, order: list[str], error: str = "bit_error", delta: str = "delta", most: int = 40) -> tuple[DataFrame, DataFrame]:
    """Of classified pairs the duplicates, least error first, and the first most of those of the same length."""
    same = classified.filter("class = 'same-length'").orderBy(F.abs(F.col(delta)), *order).limit(most)
    return classified.filter("class = 'duplicate'").orderBy(error, *order), same


def best_partner(pairs: DataFrame, key: str, order: list[str | Column]) -> DataFrame:
    """For each key the pair that comes first; a partner may serve several keys."""
    return pairs.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_rn = 1").drop("_rn")


def canonical_copy(left_rate: Column, right_rate: Column, left: str, right: str) -> Column:
    """left only if its bit rate is strictly higher."""
    return F.when(F.coalesce(left_rate, F.lit(0)) > F.coalesce(right_rate, F.lit(0)), left).otherwise(right)


def unique_counts(left: DataFrame, right: DataFrame, pairs: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """One row: pairs, rows of either side in none, distinct rows in all."""
    only = lambda df, key, name: df.select(key).distinct().join(pairs.select(key).distinct(), key, "left_anti").agg(F.count("*").alias(name))
    n = pairs.select(left_key).distinct().agg(F.count("*").alias("pairs"))
    out = n.crossJoin(only(left, left_key, "left_only")).crossJoin(only(right, right_key, "right_only"))  # three rows of one count
    return out.withColumn("distinct_all", F.col("pairs") + F.col("left_only") + F.col("right_only"))


def orphans(meta: DataFrame, media: DataFrame, key: str, meta_value: str, media_value: str, width: float) -> DataFrame:
    """Rows of meta without media, with the number of media rows in the band around their value (0 if none); keys of meta
    are distinct."""
    lost = meta.join(media.select(key), key, "left_anti")
    near = band_join(lost, media.select(F.col(media_value).alias("_media")), meta_value, "_media", width).groupBy(key).agg(F.count("*").alias("near"))
    return lost.join(near, key, "left").withColumn("near", F.coalesce("near", F.lit(0)))


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: object) -> DataFrame:
    """df with value from table (one row a key), default where there is none."""
    return df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def nested(parents: DataFrame, children: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """parents with an ordered array of their children's structs, empty if they have none: one join, one shuffle."""
    grouped = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    kind = grouped.schema[name].dataType
    return parents.join(grouped, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def metric_diff(a: DataFrame, b: DataFrame, skip: tuple[str, ...] = ("history",)) -> DataFrame:
    """key, a, b, delta, arrow over the union of two (key, value) tables; delta where both are numbers."""
    left, right = (x.filter(~F.col("key").isin(*skip)).select("key", F.col("value").alias(n)) for x, n in ((a, "a"), (b, "b")))
    number = lambda c: F.col(c).try_cast("double")
    out = left.join(right, "key", "full_outer").withColumn("delta", number("b") - number("a"))
    return out.withColumn("arrow", F.when(F.col("delta") > 0, "↑").when(F.col("delta") < 0, "↓").when(F.col("delta") == 0, "="))


def contains_join(records: DataFrame, folders: DataFrame, needle: str, hay: str, prefix: int = 12) -> DataFrame:
    """For each record the first folder whose flattened name contains the start of the record's; folders must be a small
    table: the test is no equality."""
    flat = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    part = F.substring(flat(F.col(needle)), 1, prefix)
    pairs = records.join(folders, (part != "") & F.contains(flat(F.col(hay)), part))
    return pairs.groupBy(*records.columns).agg(F.min(hay).alias(hay))


def first_existing(df: DataFrame, candidates: str, existing: DataFrame, path: str) -> DataFrame:
    """df with path: the first of an array of candidates that exists, else null."""
    one = df.select("*", F.posexplode_outer(candidates).alias("_pos", path)).join(existing.select(path).distinct().withColumn("_there", F.lit(True)), path, "left")
    keys = [c for c in df.columns if c != candidates]
    return one.groupBy(*keys).agg(F.min_by(path, F.when(F.col("_there"), F.col("_pos"))).alias(path))


def sibling_semi(candidates: DataFrame, files: DataFrame, parent: str = "parent") -> DataFrame:
    """Directories that have a project file beside them."""
    return candidates.join(files.select(parent).distinct(), parent, "left_semi")


def schedule_join(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """events (channel, start_iso) with scheduled and job_id: of active record jobs with that key the last wins."""
    field = lambda n: F.get_json_object("params", f"$.{n}").alias(n)
    active = jobs.filter("type = 'record' and status in ('queued', 'running')").select(field("channel"), field("start_iso"), "id")
    last = active.filter("channel is not null and start_iso is not null").groupBy("channel", "start_iso").agg(F.max("id").alias("job_id"))
    return events.join(last, ["channel", "start_iso"], "left").withColumn("scheduled", F.col("job_id").isNotNull())


def speaker_index(df: DataFrame, speaker: str) -> DataFrame:
    """df with a dense index of the speakers in order of their names (the ranks of a small distinct table)."""
    names = df.select(speaker).distinct().filter(F.col(speaker).isNotNull()).withColumn("speaker_index", F.dense_rank().over(Window.orderBy(speaker)) - 1)
    return df.join(names, speaker, "left").withColumn("speaker_index", F.coalesce("speaker_index", F.lit(0)))

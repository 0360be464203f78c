import pandas as pd
from pyspark.sql import functions as F

from skein.streaming import flags, monitor

KIND = "id long, ts timestamp, flag string, what string"


def run(spark, folder, *batches, **more):
    """Answers to batches of (id, second, flag, what), each a micro-batch of its own."""
    for k, rows in enumerate(batches):
        some = pd.DataFrame([(i, pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s), f, w) for i, s, f, w in rows], columns=["id", "ts", "flag", "what"])
        spark.createDataFrame(some, KIND).coalesce(1).write.parquet(f"{folder}/in/{k}")
        stream = spark.readStream.schema(KIND).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        with flags.rocks(spark):
            monitor.to_files(flags.flags(stream, "flag", F.col("what"), "id", **more), f"{folder}/out", f"{folder}/ck")
    got = spark.read.parquet(f"{folder}/out").collect()
    return {(r.id, r.wanted) for r in got if r.what != "expired"}, sorted(r.flag for r in got if r.what == "expired")


def test_time_to_live(spark, tmp_path):
    got, gone = run(spark, tmp_path, [(1, 0, "a", "ping"), (2, 149, "a", "ask"), (3, 150, "a", "ask"), (4, 151, "a", "ask"), (5, 10, "b", "ask"), (6, 151, "c", "other")])
    assert got == {(2, True), (3, False), (4, False), (5, False)} and gone == ["a"]


def test_pings_prolong_across_batches(spark, tmp_path):
    """State and timers live on between runs; a flag that ran out says so once, and may be pinged again."""
    got, gone = run(
        spark, tmp_path, [(1, 0, "a", "ping"), (2, 0, "b", "ping")], [(3, 100, "a", "ping"), (4, 149, "b", "ask")], [(5, 249, "a", "ask"), (6, 250, "a", "ask")], [(7, 300, "a", "ping"), (8, 449, "a", "ask")], [(9, 999, "z", "ask")]
    )
    assert got == {(4, True), (5, True), (6, False), (8, True), (9, False)} and gone == ["a", "a", "b"]


def test_taken_once(spark, tmp_path):
    got, _ = run(spark, tmp_path, [(1, 1, "a", "request"), (2, 2, "a", "take"), (3, 2, "a", "take"), (4, 1, "b", "take"), (5, 3, "a", "request"), (6, 4, "a", "request")], [(7, 5, "a", "take")], [(8, 6, "a", "take"), (9, 7, "b", "take")])
    assert got == {(2, True), (3, False), (4, False), (7, True), (8, False), (9, False)}


def test_null_moments_and_empty_batches(spark, tmp_path):
    got, gone = run(spark, tmp_path, [(1, 0, None, "ping"), (2, 5, None, "ask")], [], ttl=10)
    assert got == {(2, True)} and gone == []

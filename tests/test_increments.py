import pytest
from pyspark.sql import functions as F

from skein.sources.increments import Increments, follow, progress

ROWS = "job int, ts int, note string, _tmp int"


def rows(spark, *some):
    return spark.createDataFrame(list(some), ROWS)


def table(sink, spark):
    return sorted((r.job or 0, r.ts, r.note) for r in sink.rows(spark).collect())


def test_upsert_append_and_replay(spark, tmp_path):
    sink = Increments(f"{tmp_path}/s", ("job",), ("ts",))
    assert sink.rows(spark) is None and sink.lines(spark, "job int").count() == 0 and sink.done(spark) == []
    first, second = rows(spark, (1, 5, "a", 0), (2, 1, "b", 0), (None, 1, "n", 0), (1, None, "x", 0)), rows(spark, (1, 4, "older", 0), (2, 9, "c", 0), (3, 1, "d", 0))
    assert sink.write(7, first, first) and sink.write(8, second, second)
    want = [(0, 1, "n"), (1, 5, "a"), (2, 9, "c"), (3, 1, "d")]
    assert table(sink, spark) == want
    assert not sink.write(7, second, second) and not sink.write(8, first, first)  # whatever comes under a known id
    got = sink.lines(spark, "job int, ts int, note string, _tmp int")
    assert table(sink, spark) == want and got.count() == 7 and got.filter("_tmp is not null").count() == 0 and {r.batch for r in got.collect()} == {7, 8}


def test_batch_that_broke_off(spark, tmp_path):
    """What a batch left before its id was in the ledger is not read, and is replaced when it comes again."""
    sink = Increments(f"{tmp_path}/s", ("job",), ("ts",))
    one, two = rows(spark, (1, 1, "a", 0)), rows(spark, (1, 2, "b", 0), (2, 2, "b", 0))
    sink.write(0, one, one)
    two.write.parquet(f"{tmp_path}/s/rows/batch=1")
    two.drop("_tmp").write.json(f"{tmp_path}/s/lines/batch=1")
    assert table(sink, spark) == [(1, 1, "a")] and sink.lines(spark, "job int").count() == 1
    three = rows(spark, (3, 3, "c", 0))
    assert sink.write(1, three, three)
    assert table(sink, spark) == [(1, 1, "a"), (3, 3, "c")] and sink.lines(spark, "job int").count() == 2


def test_only_the_last_tables_are_kept(spark, tmp_path):
    sink = Increments(f"{tmp_path}/s", ("job",), ("ts",))
    for b in range(4):
        sink.write(b, rows(spark, (b, b, "x", 0)))
    sink.write(4, lines=rows(spark, (9, 9, "line", 0)))  # lines alone leave the table
    assert sorted(p.name for p in (tmp_path / "s/rows").iterdir()) == ["batch=2", "batch=3"] and sink.rows(spark).count() == 4 and sink.done(spark) == [0, 1, 2, 3, 4]


def test_rows_or_lines_of_odd_names(spark, tmp_path):
    sink = Increments(f"{tmp_path}/s", ("a.b",), ("c d",))
    df = spark.createDataFrame([(1, 2, {"k": 1}), (1, 3, {"k": 2})], "`a.b` int, `c d` int, m map<string, int>")
    sink.write(0, df)
    assert [tuple(r) for r in sink.rows(spark).collect()] == [(1, 3, {"k": 2})]


def test_stream_that_dies_and_restarts(spark, tmp_path):
    """A batch is written, the stream dies before its checkpoint says so, the batch comes again: nothing is there twice."""
    line = lambda k: (k % 2, k, f"Epoch [{k}/80], Step [{k}/670], Loss: {k}.50, F0 Loss: 2.00")
    kind, sink = "job int, ts int, line string", Increments(f"{tmp_path}/s", ("job",), ("ts",))
    put = lambda name, some: spark.createDataFrame([line(k) for k in some], kind).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    read = lambda: spark.readStream.schema(kind).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    put("a", range(4))
    parse, died = lambda b: progress(b, F.col("line")), []

    def dies(b):
        died.append(1)
        return parse(b)

    real = Increments.write

    def write(self, *args):
        real(self, *args)
        raise RuntimeError("gone after the write")

    Increments.write = write
    try:
        with pytest.raises(Exception, match="gone after the write"):
            follow(read(), sink, f"{tmp_path}/ck", dies)
    finally:
        Increments.write = real
    assert died and sink.done(spark) == [0]
    follow(read(), sink, f"{tmp_path}/ck", parse)
    put("b", range(4, 9))
    follow(read(), sink, f"{tmp_path}/ck", parse)
    follow(read(), sink, f"{tmp_path}/ck", parse)
    assert sink.done(spark) == [0, 1] and sorted((r.job, r.epoch, r.losses["F0"]) for r in sink.rows(spark).collect()) == [(0, 8, 2.0), (1, 7, 2.0)]
    assert sorted(r.ts for r in sink.lines(spark, kind).collect()) == list(range(9))

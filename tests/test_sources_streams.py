import pytest
from pyspark.sql import functions as F

from skein.sources import files
from skein.streaming import monitor


def test_segments_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "ñ текст", True, 1.5), ("b", None, False, None)], "id string, text string, keep boolean, dur double").withColumn("_tmp", F.lit(1))
    files.write_jsonl(df, f"{tmp_path}/s")
    got = {r.id: r for r in files.segments_qc(spark, f"{tmp_path}/s").collect()}
    assert got["a"].text == "ñ текст" and got["a"].keep is True and got["b"].keep is False and got["b"].dur is None
    (tmp_path / "t.jsonl").write_text('{"id": "x", "keep": "True"}\n\n{"id": "y", "keep": "False"}\n')
    assert {r.id: r.keep for r in files.segments_qc(spark, f"{tmp_path}/t.jsonl").collect()} == {"x": True, "y": False}


def test_json_documents(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"results": [{"a": "1", "n": 2},\n {"a": "2"}]}')
    assert [(r.a, r.n) for r in files.json_array(spark, f"{tmp_path}/d.json", "results", "a: string, n: int").collect()] == [("1", 2), ("2", None)]
    (tmp_path / "v.json").write_text('{"c1": {"verdict": "ok"}, "c2": {"verdict": "bad", "comment": "x"}}')
    assert {r.id: (r.verdict, r.comment) for r in files.verdict_map(spark, f"{tmp_path}/v.json").collect()} == {"c1": ("ok", None), "c2": ("bad", "x")}
    assert files.snapshot(spark, f"{tmp_path}/none.json", "generated_at string").first().stale is True


def test_pipe_dialects(spark, tmp_path):
    df = spark.createDataFrame([("i1", 'say "hi" | now\nthen'), ("i2", '"quoted" start')], "id string, text string")
    files.write_metadata(df, f"{tmp_path}/plain")
    assert {r.id: r.text for r in files.pipe_raw(spark, f"{tmp_path}/plain").collect()} == {"i1": 'say "hi" / now then', "i2": '"quoted" start'}
    files.write_metadata(df, f"{tmp_path}/quoted", quoted=True)
    assert {r.id: r.text for r in files.pipe_quoted(spark, f"{tmp_path}/quoted").collect()} == {r.id: r.text for r in df.collect()}
    (tmp_path / "bad").write_text("only|two\n")
    with pytest.raises(Exception, match="not three parts"):
        files.pipe_raw(spark, f"{tmp_path}/bad").collect()


def test_tables_and_splits(spark, tmp_path):
    (tmp_path / "u.csv").write_text('id,text\n1,"a, b"\n')
    assert [r.line for r in files.utterances(spark, f"{tmp_path}/u.csv").collect()] == ["text", "a, b"]
    (tmp_path / "u.txt").write_text(" one \n\ntwo\n")
    assert [r.line for r in files.utterances(spark, f"{tmp_path}/u.txt").collect()] == ["one", "two"]
    spark.range(3).write.parquet(f"{tmp_path}/train")
    got = files.splits(spark, {"train": f"{tmp_path}/train", "validation": f"{tmp_path}/none"})
    assert got.count() == 3 and got.first().split == "train"
    with pytest.raises(ValueError, match="no split"):
        files.splits(spark, {"x": f"{tmp_path}/none"})
    with pytest.raises(ValueError, match="no column"):
        files.numeric_split(spark, f"{tmp_path}/u.csv", "id string, text string", "y")


def test_folders(spark, tmp_path):
    for name in ("lib/Ali_Kitap.pdf", "lib/sources/skip.pdf", "lib/.hidden.pdf", "lib/b/two.txt"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x" * len(name))
    assert sorted(r.name for r in files.listing(spark, f"{tmp_path}/lib", (".pdf",)).collect()) == ["Ali_Kitap.pdf", "skip.pdf"]
    books = files.library(spark, f"{tmp_path}/lib", (".pdf",), ("sources",)).collect()
    assert [(r.name, r.tokens) for r in books] == [("Ali_Kitap.pdf", ["kitap"])]
    assert {r.label for r in files.labelled_files(spark, f"{tmp_path}/lib").collect()} == {"lib", "sources", "b"}


def test_small_parsers(spark):
    lines = spark.createDataFrame([("file 'a b.mp3'",), ("- book: `x/y.pdf`",), ("10, 20",), ("err",)], "value string")
    assert [r.file for r in files.parts_list(lines).collect()] == ["a b.mp3"] and [(r.key, r.value) for r in files.markdown_fields(lines).collect()] == [("book", "x/y.pdf")]
    assert [r.m for r in lines.select(files.memory_line(F.col("value")).alias("m")).collect()][2:] == [(10, 20), None]
    doc = spark.createDataFrame([('{"running": [{"progress": {"epoch": 7}}]}',), ("{}",), (None,)], "d string")
    assert [r.p for r in doc.select(files.status_progress(F.col("d")).alias("p")).collect()] == [7, 0, 0]
    assert files.query(spark, "SELECT value FROM {t} WHERE value = :v", {"v": "err"}, t=lines).count() == 1
    assert "| value |" in files.markdown_table(lines, "T", 2)
    tail = files.log_tail(spark.createDataFrame([(i, f"l{i}") for i in range(9)], "line_no int, line string"), 3)
    assert [r.line for r in tail.collect()] == ["l6", "l7", "l8"]


def test_partitioned_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", "t1", "train"), ("b", "t,2", "test")], "id string, text string, split string")
    files.write_audiofolder(df, f"{tmp_path}/af")
    got = files.csv_header(spark, f"{tmp_path}/af/split=test", "file_name string, transcription string").collect()
    assert [(r.file_name, r.transcription) for r in got] == [("b.wav", "t,2")]
    files.write_groups(df, f"{tmp_path}/g", "split")
    assert spark.read.parquet(f"{tmp_path}/g/split=train").count() == 1
    doc = files.result_document(df.agg(F.count("*").alias("n")), rows=df).first()
    assert doc.n == 2 and len(doc.rows) == 2


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1, "click", 50.0, "{}"), (2, "2024-01-01 00:01:00", 1, "click", 10.0, "{}"), (3, "2024-01-01 00:02:00", 1, "view", 5.0, "{}"), (4, "2024-01-01 00:03:00", 1, "view", 70.0, "{}"), (5, "2024-01-01 00:01:00", 2, "view", 1.0, "{}")]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/in/events.parquet")
    read = lambda: monitor.read_events(spark, f"{tmp_path}/in/events.parquet", glob="*.parquet")
    assert {(r.event_id, r.change) for r in monitor.to_memory(monitor.latch(read(), "user_id", "value", 20.0), "m1").collect()} == {(2, "raised"), (4, "cleared"), (5, "raised")}
    assert {r.user_id: r.event_id for r in monitor.to_memory(monitor.latest_by_key(read(), "user_id", ["event_id"], ["ts", "event_id"]), "m2", "complete").collect()} == {1: 4, 2: 5}
    monitor.to_files(monitor.first_seen(read().select("user_id", "event_type"), ["user_id", "event_type"]), f"{tmp_path}/out", f"{tmp_path}/ck")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
    monitor.to_files(monitor.first_seen(read().select("user_id", "event_type"), ["user_id", "event_type"]), f"{tmp_path}/out", f"{tmp_path}/ck")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3  # nothing new, nothing twice

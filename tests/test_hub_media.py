import io
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.sources import files, hub, media


@pytest.fixture
def lake(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}", [float(i)], {"k": i}) for i in range(20)], "id long, text string, wave array<float>, meta map<string, int>")
    root = tmp_path / "hub/org/speech/clean"
    for k in range(3):
        rows.filter(F.col("id") % 3 == k).toPandas()[["id", "text"]].to_parquet(_made(root) / f"train-0000{k}-of-00003.parquet", row_group_size=2)
    rows.filter("id < 4").coalesce(1).write.parquet(f"{root}/test")
    rows.limit(1).toPandas()[["id"]].to_parquet(root / "validation.parquet")
    return f"{tmp_path}/hub"


def _made(folder):
    folder.mkdir(parents=True, exist_ok=True)
    return folder


def test_splits_by_name(spark, lake):
    train = hub.load(spark, lake, "org/speech", config="clean")
    assert train.columns == ["id", "text"] and sorted(r.id for r in train.collect()) == list(range(20)) and train.rdd.getNumPartitions() == 3
    test = hub.load(spark, f"file://{lake}", "org/speech", "test", "clean", required=["meta"])
    assert {r.id: (r.wave, r.meta) for r in test.collect()} == {i: ([float(i)], {"k": i}) for i in range(4)}
    assert hub.load(spark, lake, "org/speech", "validation", "clean").count() == 1


def test_only_named_columns_are_read(spark, lake):
    got = hub.load(spark, lake, "org/speech", "test", "clean", columns=["text"])
    assert got.columns == ["text"] and sorted(r.text for r in got.collect()) == ["t0", "t1", "t2", "t3"]
    reader = hub.Hub({"path": lake, "dataset": "org/speech", "config": "clean", "split": "test", "columns": "wave,id"})
    batch = next(reader.reader(reader.schema()).read(reader.reader(reader.schema()).partitions()[0]))
    assert batch.schema.names == ["wave", "id"]


def test_large_files_by_row_groups(spark, lake):
    got = hub.load(spark, lake, "org/speech", config="clean", partitionBytes="1")
    assert got.rdd.getNumPartitions() == 11 and got.count() == 20 and got.select("id").distinct().count() == 20


def test_what_is_missing_is_named(spark, lake):
    for more, words in (({"split": "dev"}, "no split dev.*test, train, validation"), ({"columns": ["speaker"]}, "no column speaker.*id, text"), ({"required": ["audio"]}, "no column audio")):
        with pytest.raises(Exception, match=words):
            hub.load(spark, lake, "org/speech", config="clean", **more).count()


def test_npy_round_trip(spark, tmp_path):
    rows = [(f"v{i}", np.random.default_rng(i).normal(size=i).astype(np.float32).tolist()) for i in range(9)]
    df = spark.createDataFrame([*rows, ("null", [1.0, None])], "name string, v array<float>").repartition(4)
    media.write_vectors(df, f"{tmp_path}/out", "name", "v")
    found = {p.stem: np.load(p) for p in (tmp_path / "out").rglob("*.npy")}
    assert {k: v.tolist() for k, v in found.items() if k != "null"} == dict(rows) and np.isnan(found["null"][1]) and not (tmp_path / "out/_temporary").exists()
    got = {r.name: r["values"] for r in media.read_vectors(spark, f"{tmp_path}/out").collect()}
    assert {k: v for k, v in got.items() if k != "null"} == dict(rows)
    media.write_vectors(df.filter("name = 'v3'"), f"{tmp_path}/out", "name", "v", mode="overwrite")
    assert [p.stem for p in (tmp_path / "out").rglob("*.npy")] == ["v3"]


def test_failed_task_leaves_no_file(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0]), ("b", [1.0]), (None, [1.0])], "name string, v array<float>").repartition(3)
    with pytest.raises(Exception, match="not a name and a vector"):
        media.write_vectors(df, f"{tmp_path}/out", "name", "v")
    assert not list((tmp_path / "out").rglob("*.npy"))


def test_wav_and_probe(spark, tmp_path):
    tone = (0.5 * np.sin(np.arange(8000) / 9)).tolist()
    df = spark.createDataFrame([("tone", tone), ("loud", [2.0, -2.0, None, 0.25]), ("none", [])], "name string, v array<double>")
    media.write_vectors(df, f"{tmp_path}/out", "name", "v", kind="wav", rate=8000)
    got = {r.path.rsplit("/", 1)[1]: r for r in media.probe(files.listing(spark, f"{tmp_path}/out", (".wav",))).collect()}
    assert (got["tone.wav"].seconds, got["tone.wav"].bits_per_second, got["tone.wav"].rate, got["tone.wav"].channels) == (1.0, 128_000, 8000, 1) and got["none.wav"].seconds == 0.0
    with wave.open(str(next((tmp_path / "out").rglob("loud.wav")))) as w:
        assert np.frombuffer(w.readframes(9), "<i2").tolist() == [32767, -32767, 0, 8192]


def test_probe_of_odd_chunks(spark, tmp_path):
    form = struct.pack("<HHIIHH", 1, 2, 44100, 176400, 4, 16)
    chunk = lambda name, body, size=None: name + struct.pack("<I", len(body) if size is None else size) + body + b"\0" * (len(body) % 2)
    riff = lambda *chunks: b"RIFF" + struct.pack("<I", 4 + sum(map(len, chunks))) + b"WAVE" + b"".join(chunks)
    made = {
        "plain": riff(chunk(b"fmt ", form), chunk(b"data", bytes(17640))),
        "odd": riff(chunk(b"LIST", b"abc"), chunk(b"fmt ", form + b"\0\0"), chunk(b"junk", b"x" * 7), chunk(b"data", bytes(17640)), chunk(b"id3 ", b"tag")),
        "stream": riff(chunk(b"fmt ", form), chunk(b"data", bytes(17640), 0xFFFFFFFF)),
        "cut": riff(chunk(b"fmt ", form), chunk(b"data", bytes(17640)))[:-8820],
        "late": riff(chunk(b"data", bytes(17640)), chunk(b"fmt ", form)),
        "no data": riff(chunk(b"fmt ", form)), "text": b"not a wave at all", "empty": b"", "mp3": riff(chunk(b"fmt ", struct.pack("<HHIIHH", 85, 2, 44100, 16000, 1, 0)), chunk(b"data", bytes(9))), "half": riff(chunk(b"fmt ", form[:9])),
    }
    for name, data in made.items():
        (tmp_path / f"{name}.wav").write_bytes(data)
    got = {r.path.rsplit("/", 1)[1].replace("%20", " ").removesuffix(".wav"): r.seconds for r in media.probe(files.listing(spark, f"{tmp_path}")).collect()}
    assert got == {"plain": 0.1, "odd": 0.1, "stream": 0.1, "cut": 0.05, "late": 0.1, "no data": None, "text": None, "mp3": None, "half": None}

    class Counted(io.BytesIO):
        seen = 0

        def read(self, n=-1):
            out = super().read(n)
            self.seen += len(out)
            return out

    f = Counted(made["odd"])
    assert media.probe_wav(f, len(made["odd"])) and f.seen < 100  # headers only
